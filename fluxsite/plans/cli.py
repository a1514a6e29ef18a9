"""Command line: run one analysis from sheet files and export it.

python -m fluxsite.plans.cli --state etat.csv --rooms occupation.csv \
    --staff effectifs.csv --conso elec=e.csv --conso eau=w.csv ... --out results/

Prices default to the reference's values; pass --price elec=0.1 to change one.
The small building tables are written once under the session's
``spark.checkpoint.dir`` when it is set, and deleted at the end of the run.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from fluxsite.config import AnalysisConfig, Rates, known_resource
from fluxsite.plans.analysis import Analysis
from fluxsite.session import checkpoint_dir
from fluxsite.sinks.export import run_folder, write_outputs
from fluxsite.sinks.publish import publish_run
from fluxsite.sources.workbook import load_inputs


def _pairs(items) -> dict[str, str]:
    out = {}
    for it in items or []:
        k, eq, v = it.partition("=")
        if not eq:
            raise ValueError(f"expected resource=value, got {it!r}")
        out[known_resource(k)] = v
    return out


def main(argv=None) -> dict[str, str]:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--state", required=True)
    ap.add_argument("--rooms", required=True)
    ap.add_argument("--staff", required=True)
    ap.add_argument("--conso", action="append", required=True, help="resource=path (five times)")
    ap.add_argument("--price", action="append", help="resource=price")
    ap.add_argument("--format", default="csv", help="format of the sheets (csv or parquet)")
    ap.add_argument("--sep", default=",", help="separator of CSV sheets")
    ap.add_argument("--encoding", default="UTF-8")
    ap.add_argument("--decimal", default=".", help="decimal mark of the numbers")
    ap.add_argument("--unparsable", default="fail", choices=["fail", "null"], help="what a cell that is no number does")
    ap.add_argument("--one-line-records", action="store_true", help="no quoted line breaks in any cell")
    ap.add_argument("--out", required=True)
    ap.add_argument("--out-format", default="parquet")
    ap.add_argument("--publish", action="store_true", help="publish the eight tables as one numbered run: all of them, or none")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    cfg = AnalysisConfig(rates=Rates.of(_pairs(a.price)))
    scan = {"sep": a.sep, "encoding": a.encoding, "multiline": not a.one_line_records} if a.format == "csv" else {}
    inputs = load_inputs(spark, a.state, a.rooms, a.staff, _pairs(a.conso), fmt=a.format, cfg=cfg,
                         decimal=a.decimal, unparsable=a.unparsable, **scan)
    ckpt = checkpoint_dir(spark)
    analysis = Analysis(inputs, cfg, workdir=f"{ckpt.rstrip('/')}/fluxsite-work" if ckpt else None)
    try:
        if a.publish:
            run = publish_run(analysis, a.out, fmt=a.out_format)
            return {name: f"{run.path}: {entry['path']}" for name, entry in run.manifest["tables"].items()}
        return write_outputs(analysis, run_folder(a.out), fmt=a.out_format)
    finally:
        analysis.cleanup()


if __name__ == "__main__":
    for k, v in main().items():
        print(k, v)
