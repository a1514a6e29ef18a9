"""Which names occur inside labels: many patterns at once.

The names are dealt out by hash to parts of a bounded size, and each part becomes one
automaton (Aho-Corasick) that finds all its names in a label in a single pass over the
label's characters, whatever their number. The rows are dealt out by the hash of
their labels, so no task holds all rows or all names, and no pair of a row and a name is
looked at that is not a hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = 100_000  # names of a part, about


def _find(label: str):
    # the function travels by value: workers need not have this package
    def run(rows, names):
        import ahocorasick
        import pyarrow as pa

        automaton, always = ahocorasick.Automaton(), []
        for name in names["name"].to_pylist():
            automaton.add_word(name, name) if name else always.append(name)
        found = [always[:] for _ in range(len(rows))]
        if len(automaton):
            automaton.make_automaton()
            for hits, text in zip(found, rows[label].to_pylist(), strict=True):
                if text is not None:
                    hits.extend(sorted({name for _, name in automaton.iter(text)}))
        return rows.drop_columns(["_salt", "_part"]).append_column("names", pa.array(found, pa.list_(pa.string())))

    return run


def names_in_labels(rows: DataFrame, label: str, names: DataFrame, most: int = NAMES) -> DataFrame:
    """``rows`` with ``names``: the distinct names (column ``name``) inside the column
    ``label``; the empty name is inside every label. With more than ``most`` names a row
    comes once for each part of the names, with the names of that part."""
    spark = rows.sparkSession
    names = names.where(F.col("name").isNotNull()).select("name").distinct()
    parts = F.greatest(F.ceil(names.agg(F.count(F.lit(1))).scalar() / most), F.lit(1)).cast("int")
    salts = F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(label), salts).cast("int")).withColumn("_part", every(parts))
    right = names.withColumn("_part", F.pmod(F.xxhash64("name"), parts).cast("int")).withColumn("_salt", every(salts))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", names array<string>"
    by = ["_salt", "_part"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_find(label), schema)
