"""fluxsite: facility consumption analytics (energy and water per building
and occupying unit) as Spark DataFrame plans.

Entry points: ``fluxsite.plans.analysis.Analysis`` / ``run_analysis`` for the
lazy tables, ``fluxsite.sources.workbook.load_inputs`` for the sheets,
``fluxsite.sinks.export.write_outputs`` for the export, ``python -m fluxsite``
for the command line.
"""

__all__ = ["config", "functions", "operators", "plans", "sinks", "sources"]
