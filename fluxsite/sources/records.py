"""Records of CSV files whose quoted cells may hold line breaks, many tasks a file.

A line ends a record where the quotes up to it are even in number (a quote inside a
quoted cell is doubled, so it never changes that). First pass: the quotes of each split
of each file are counted, and a prefix sum over the splits tells which begin inside a
quoted cell. Second pass: each task cuts its lines at the true ends of records. A
record that crosses splits leaves a fragment in each; only these are shuffled and put
together. The cells are read from the records by Spark's own CSV parser.

Files whose quotes are odd in number fail the read: somewhere a cell is not closed. A
quote inside a cell that is not quoted is not CSV; ``read_sheet(..., split=False)`` reads
such files, a task for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Encodings in which the bytes of a quote and of a line break are never part of other characters.
SPLITTABLE = {"UTF-8": None, "UTF8": None, "ISO-8859-1": "ISO-8859-1", "US-ASCII": "US-ASCII"}
WHOLE, BEGINS, INSIDE, ENDS = range(4)  # what a task found of a record
SCHEMA = "_file long, _at long, _kind int, record string"


def plain_path(path: Column) -> Column:
    """A file's path without the differences between writings of one path."""
    # no regular expression: this is worked out for every line of a sheet
    return F.replace(F.replace(path, F.lit("///"), F.lit("/")), F.lit("//"), F.lit("/"))


def file_key(path: Column) -> Column:
    return F.xxhash64(plain_path(path))


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(line, _file, _block): the physical lines, in file order within a split. A
    carriage return before the line feed stays."""
    value, charset = F.col("value"), SPLITTABLE[encoding.upper()]
    line = F.decode(value.cast("binary"), charset) if charset else value
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(line.alias("line"), file_key(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def split_states(lines: DataFrame, quote: str = '"') -> DataFrame:
    """(_file, _block, _open, _ends_open): whether a split begins, and ends, inside a
    quoted cell. One row per split."""
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit(quote), F.lit("")))
    counts = lines.groupBy("_file", "_block").agg(F.sum(quotes).alias("n"))
    upto = Window.partitionBy("_file").orderBy("_block")
    file = Window.partitionBy("_file")
    odd = lambda n: n % 2 == 1
    unclosed = F.raise_error(F.lit("a CSV file holds an odd number of quotes: a quoted cell is not closed")).cast("boolean")
    return counts.select(
        "_file", "_block",
        F.when(odd(F.sum("n").over(file)), unclosed).otherwise(odd(F.sum("n").over(upto) - F.col("n"))).alias("_open"),
        odd(F.sum("n").over(upto)).alias("_ends_open"),
    )


def _cut(quote: str):
    # the function travels by value: workers need not have this package
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names, types = ["_file", "_at", "_kind", "record"], [pa.int64(), pa.int64(), pa.int32(), pa.string()]
        whole, begins, inside, ends = range(4)
        key, inner, row, held, held_at, began = None, False, 0, [], 0, False

        def rows(found):
            columns = zip(*found, strict=True) if found else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        def rest():
            """The record that is still open at the end of a split."""
            return [(key[0], held_at, begins if began else inside, "\n".join(held))] if inner and held else []

        for batch in batches:
            if not len(batch):
                continue
            files, blocks = (batch.column(c).to_numpy() for c in ("_file", "_block"))
            changes = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            for a, b in zip([0, *changes.tolist()], [*changes.tolist(), len(batch)], strict=True):
                found = []
                if (files[a], blocks[a]) != key:
                    found += rest()
                    key, inner, row, held, began = (int(files[a]), int(blocks[a])), bool(batch.column("_open")[a].as_py()), 0, [], False
                lines = batch.column("line").slice(a, b - a)
                quotes = pc.count_substring(lines, quote).to_numpy(zero_copy_only=False)
                after = ((np.cumsum(quotes) + inner) & 1).astype(bool)
                before = np.append(inner, after[:-1])
                at = key[1] + row + np.arange(b - a)
                alone = ~before & ~after
                if alone.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(int(alone.sum()), key[0])), pa.array(at[alone]), pa.array(np.full(int(alone.sum()), whole, np.int32)), lines.filter(pa.array(alone)).cast(pa.string())],
                        names,
                    )
                # the lines of longer records: the rest of one, whole ones, the first of another
                at, goes_on, ended = at[~alone], before[~alone], ~after[~alone]
                lines = lines.filter(pa.array(~alone)).cast(pa.string())
                begin = 0
                if len(at) and goes_on[0]:
                    begin = int(ended.argmax()) + 1 if ended.any() else len(at)
                    held_at = held_at if held else int(at[0])  # or it goes on from the split before
                    held += lines.slice(0, begin).to_pylist()
                    if ended[begin - 1]:
                        found.append((key[0], held_at, whole if began else ends, "\n".join(held)))
                        held, began = [], False
                starts, stops = begin + np.flatnonzero(~goes_on[begin:]), begin + np.flatnonzero(ended[begin:]) + 1
                n = len(stops)
                if n:
                    each = pa.ListArray.from_arrays(pa.array(np.append(starts[:n], stops[-1]), pa.int32()), lines)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, key[0])), pa.array(at[starts[:n]]), pa.array(np.full(n, whole, np.int32)), pc.binary_join(each, "\n")],
                        names,
                    )
                if len(starts) > n:
                    held, held_at, began = lines.slice(int(starts[n])).to_pylist(), int(at[starts[n]]), True
                inner, row = bool(after[-1]), row + b - a
                if found:
                    yield rows(found)
        if key is not None:
            yield rows(rest())

    return run


def csv_records(spark: SparkSession, path: str, encoding: str = "UTF-8", quote: str = '"') -> DataFrame:
    """(_file, _at, record): every record of the files, header records and blank lines
    included. ``_at`` grows with the place in the file and is 0 for its first record."""
    lines = _lines(spark, path, encoding)
    states = split_states(lines, quote)
    # one row per split; a join on the map side keeps the order of the lines
    lines = lines.join(F.broadcast(states), ["_file", "_block"], "left")
    lost = F.raise_error(F.lit("the files changed while they were read")).cast("boolean")
    lines = lines.withColumn("_open", F.coalesce("_open", lost))
    whole = lines.select("line", "_file", "_block", "_open").mapInArrow(_cut(quote), SCHEMA).where(F.col("_kind") == WHOLE)
    cut = lines.where(F.col("_open") | F.col("_ends_open")).select("line", "_file", "_block", "_open")
    cut = cut.mapInArrow(_cut(quote), SCHEMA).where(F.col("_kind") != WHOLE)
    # at most two fragments a split
    number = F.sum(F.when(F.col("_kind") == BEGINS, 1).otherwise(0)).over(Window.partitionBy("_file").orderBy("_at"))
    parts = cut.withColumn("_number", number).groupBy("_file", "_number").agg(F.sort_array(F.collect_list(F.struct("_at", "record"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
    joined = parts.select("_file", F.col("parts")[0]["_at"].alias("_at"), text.alias("record"))
    records = whole.select("_file", "_at", "record").unionByName(joined)
    return records.withColumn("record", F.when(F.endswith("record", F.lit("\r")), F.regexp_replace("record", "\r$", "")).otherwise(F.col("record")))


def csv_cells(records: DataFrame, header: list[str], names: list[str], sep: str = ",", quote: str = '"') -> DataFrame:
    """The cells of the records as strings under ``names``, beside ``_file`` and ``_at``.
    The first record of each file has to be ``header``; records of another number of
    cells fail the read; blank lines are left out."""
    fields = [f"c{k}" for k in range(len(header))]
    options = {"sep": sep, "quote": quote, "escape": quote, "mode": "FAILFAST"}
    schema = ", ".join(f"{c} string" for c in fields)
    records = records.where((F.col("_at") == 0) | (F.btrim("record") != ""))
    text = F.when(F.col("_at") == 0, F.regexp_replace("record", "^\ufeff", "")).otherwise(F.col("record"))
    cells = records.select("_file", "_at", F.from_csv(text, schema, options).alias("c"))
    given = F.array(*[F.coalesce(F.col(f"c.{c}"), F.lit("")) for c in fields])
    other = F.raise_error(F.concat(F.lit("the first record of a CSV file is not the header: "), F.array_join(given, sep))).cast("boolean")
    is_header = F.when(F.col("_at") != 0, False).when(given == F.array(*map(F.lit, header)), True).otherwise(other)
    return cells.where(~is_header).select("_file", "_at", *[F.col(f"c.{c}").alias(name) for c, name in zip(fields, names, strict=True)])
