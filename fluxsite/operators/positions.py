"""Row positions in file order, and the building codes that go by them.

A sheet's rows carry a key that grows in file order. Keys are cut into buckets of a
bounded width; the buckets' row counts give, by a prefix sum, how many rows come before
each, and a row's position is that number and its rank inside its bucket. No task
sorts the sheet, and nothing but the keys is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE_SHIFT = 44  # bits of a row key below its file's number
BUCKET = 20  # bits of a row key inside a bucket: so many rows at most


def with_position(df: DataFrame, ordinal: str = "ordinal", position: str = "position") -> DataFrame:
    """``df`` with the contiguous position (from 0) of each row in the order of its unique key."""
    bucket = F.shiftright(F.col(ordinal), BUCKET)
    sizes = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_file", F.shiftright("_bucket", FILE_SHIFT - BUCKET))
    in_file = Window.partitionBy("_file").orderBy("_bucket")
    sizes = sizes.withColumn("_inside", F.sum("_n").over(in_file) - F.col("_n"))
    files = sizes.groupBy(F.col("_file").alias("_of")).agg(F.sum("_n").alias("_total"))
    # one row per file
    files = files.select("_of", (F.sum("_total").over(Window.orderBy("_of")) - F.col("_total")).alias("_before"))
    offsets = sizes.join(files, F.col("_file") == F.col("_of")).select("_bucket", (F.col("_before") + F.col("_inside")).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(ordinal)) - 1
    placed = df.withColumn("_bucket", bucket).join(offsets, "_bucket")
    return placed.withColumn(position, F.col("_offset") + rank).select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns], position)


def _refused(resource: str, codes) -> Column:
    many = "as many" if isinstance(codes, DataFrame) else f"exactly {len(codes)}"
    return F.raise_error(F.lit(f"the {resource} sheet must hold {many} rows, one per positional building code"))


def positional_code_map(sheet: DataFrame, resource: str, codes) -> DataFrame:
    """(resource, ordinal, num_bat): the i-th row of ``sheet`` takes the i-th code.

    ``codes`` is a list, or a table (position, num_bat) of any length. The sheet must
    hold exactly as many rows as there are codes; any other number fails the job. It
    may also be a {label: code} mapping, which needs no positions.
    """
    if isinstance(codes, dict):
        label = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[F.col("batiment")]
        return sheet.select(F.lit(resource).alias("resource"), "ordinal", label.alias("num_bat"))
    table = codes if isinstance(codes, DataFrame) else sheet.sparkSession.createDataFrame(list(enumerate(codes)), "position long, num_bat string")
    rows = with_position(sheet.select("ordinal")).withColumnRenamed("position", "_at")
    both = table.select("position", "num_bat").join(rows, F.col("position") == F.col("_at"), "full")
    wrong = F.col("position").isNull() | F.col("_at").isNull()
    code = F.when(wrong, _refused(resource, codes).cast("string")).otherwise(F.col("num_bat"))
    return both.select(F.lit(resource).alias("resource"), "ordinal", code.alias("num_bat"))


def as_many_rows(sheet: DataFrame, resource: str, codes) -> Column:
    """A condition that holds, or fails the job: the sheet has as many rows as ``codes``.
    It is a scalar subquery, so it is tested even where no row of the sheet is left."""
    if isinstance(codes, dict):
        return F.lit(True)
    rows = F.count(F.lit(1))
    if isinstance(codes, DataFrame):
        wanted = codes.agg(F.count(F.lit(1))).scalar()
    else:
        wanted = F.lit(len(codes))
    counted = sheet.agg(rows.alias("n")).select(F.when(F.col("n") == wanted, F.lit(True)).otherwise(_refused(resource, codes).cast("boolean")))
    return counted.scalar()
