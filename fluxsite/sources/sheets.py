"""Sheet scans: one CSV or Parquet path per workbook sheet.

A sheet is read with its header row, every cell as a string; cells are
trimmed, blank cells and NA tokens become NULL in one projection. Records that
do not fit the header fail the read instead of losing cells, and so do numbers
that cannot be read, unless the caller asks for NULL.
Column positions only matter where the input layout is positional; they are
resolved to names on the driver before planning, never inside a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fluxsite import config as C
from fluxsite.functions.nulls import sql_name
from fluxsite.operators.positions import FILE_SHIFT
from fluxsite.sources.records import SPLITTABLE, csv_cells, csv_records, file_key, plain_path

WHITE = " \t\r\n\u00a0"
_ROW_MASK = (1 << 33) - 1  # monotonically_increasing_id: row in its partition
MOST_FILES = 1 << (63 - FILE_SHIFT)


def named(name: str) -> Column:
    """The column of exactly this name (headers may hold dots and backticks)."""
    return F.col(sql_name(name))


def apply_na_tokens(df: DataFrame, tokens=C.NA_TOKENS) -> DataFrame:
    """String cells without the white space around them; blank cells and the
    tokens become NULL."""
    missing = ["", *tokens]
    cols = []
    for f in df.schema.fields:
        c = named(f.name)
        if isinstance(f.dataType, StringType):
            c = F.btrim(c, F.lit(WHITE))
            c = F.when(~c.isin(missing), c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _csv(spark: SparkSession, path: str, sep: str, encoding: str, multiline: bool) -> DataFrame:
    """Every record of a CSV sheet, read by Spark's own reader: with ``multiline`` a file
    is one split, without it quoted line breaks are not allowed. All columns are
    parsed whatever the plan needs, so a ragged record is always found."""
    options = {"header": True, "sep": sep, "encoding": encoding, "multiLine": multiline, "quote": '"', "escape": '"'}
    header = spark.read.options(**options).csv(path).columns
    schema = StructType([StructField(c, StringType()) for c in header])
    return spark.read.options(**options, mode="FAILFAST", enforceSchema=False, columnPruning=False).schema(schema).csv(path)


def _file_numbers(df: DataFrame) -> DataFrame | None:
    """(_number, _path) of the files of ``df`` in order of their paths; None for one file."""
    files = sorted(df.inputFiles())
    if len(files) > MOST_FILES:
        raise ValueError(f"a sheet of {len(files)} files; its row keys have room for {MOST_FILES}")
    if len(files) < 2:
        return None
    return df.sparkSession.createDataFrame(list(enumerate(files)), "_number long, _path string")


def _numbered(df: DataFrame, numbers: DataFrame | None, on: Column, at: Column, ordinal: str) -> DataFrame:
    """Add the key of file order: the file's number, then the place in the file."""
    if numbers is None:
        return df.withColumn(ordinal, at)
    return df.join(numbers, on).withColumn(ordinal, F.shiftleft("_number", FILE_SHIFT) + at)


def _beyond_a_split(spark: SparkSession, files: list[str]) -> bool:
    """Whether a file is larger than what one task reads."""
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    conf, Path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    return any(Path(f).getFileSystem(conf).getFileStatus(Path(f)).getLen() > most for f in files)


def _split_csv(spark: SparkSession, path: str, sep: str, encoding: str, ordinal: str | None) -> DataFrame:
    """A CSV sheet whose quoted cells may hold line breaks, read by many tasks a file."""
    options = {"sep": sep, "encoding": encoding, "multiLine": True, "quote": '"', "escape": '"'}
    reader = spark.read.options(header=True, **options).csv(path)
    names = reader.columns  # Spark numbers names that repeat
    spelled = [c or "" for c in spark.read.options(header=False, **options).csv(path).first()]
    cells = csv_cells(csv_records(spark, path, encoding), spelled, names, sep)
    if ordinal:
        numbers = _file_numbers(reader)
        on = None if numbers is None else F.col("_file") == file_key(F.col("_path"))
        cells = _numbered(cells, numbers, on, F.col("_at"), ordinal)
    return cells.select(*[named(c) for c in names], *([ordinal] if ordinal else []))


def _with_ordinal(df: DataFrame, fmt: str, ordinal: str) -> DataFrame:
    """Add the key of file order: files by path, then blocks, then rows.

    Within a file a row's key is the start of its block plus its number in its
    task; a task's rows are fewer than the bytes of a block, so keys grow with
    the row. Parquet has the row number itself."""
    if fmt == "parquet":
        at = F.col("_metadata.row_index")
    else:
        at = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_MASK))
    cells = df.columns
    out = df.select("*", plain_path(F.col("_metadata.file_path")).alias("_file"), at.alias("_at"))
    out = _numbered(out, _file_numbers(df), F.col("_file") == plain_path(F.col("_path")), F.col("_at"), ordinal)
    return out.select(*[named(c) for c in cells], ordinal)


def read_sheet(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    na_tokens=C.NA_TOKENS,
    ordinal: str | None = "ordinal",
    sep: str = ",",
    encoding: str = "UTF-8",
    multiline: bool = True,
    split: bool | None = None,
) -> DataFrame:
    """Scan one sheet; trimmed string cells, header row, NA tokens as NULL.

    ``ordinal`` keeps the file order (the reference addresses some rows by
    position and keeps the first of duplicates). A quoted cell of a CSV sheet may hold
    separators, quotes (doubled) and, with ``multiline``, line breaks. ``split`` lets many
    tasks read such a file (see ``records``); by default that is done where a file is
    larger than a task's share and its encoding allows it.
    """
    if fmt != "csv":
        df = spark.read.format(fmt).load(path)
        df = _with_ordinal(df, fmt, ordinal) if ordinal else df
    else:
        df = _csv(spark, path, sep, encoding, multiline)
        if split is None:
            split = multiline and encoding.upper() in SPLITTABLE and _beyond_a_split(spark, df.inputFiles())
        if split:
            df = _split_csv(spark, path, sep, encoding, ordinal)
        elif ordinal:
            df = _with_ordinal(df, fmt, ordinal)
    return apply_na_tokens(df, na_tokens)


def apply_schema(df: DataFrame, names, keep=()) -> DataFrame:
    """Positional renaming; the sheet must hold exactly ``len(names)`` columns
    besides the ones listed in ``keep`` (e.g. the ordinal)."""
    body = [c for c in df.columns if c not in keep]
    if len(body) != len(names):
        raise ValueError(f"sheet has {len(body)} columns, expected {len(names)}: {body}")
    return df.select(*[named(c).alias(n) for c, n in zip(body, names)], *[F.col(k) for k in keep])


def drop_positions(df: DataFrame, positions, keep=()) -> DataFrame:
    """Drop columns by 1-based position (among the non-``keep`` columns)."""
    body = [c for c in df.columns if c not in keep]
    gone = {body[p - 1] for p in positions if 0 < p <= len(body)}
    return df.select(*[named(c) for c in df.columns if c not in gone])


def number(cell: Column, decimal: str = ".", unparsable: str = "fail") -> Column:
    """A cell as a double. ``decimal`` is its decimal mark; a cell that is no
    number fails the job, or becomes NULL with ``unparsable="null"``."""
    if unparsable not in ("fail", "null"):
        raise ValueError(f"unparsable must be 'fail' or 'null', not {unparsable!r}")
    text = cell.cast("string")
    read = (text if decimal == "." else F.replace(text, F.lit(decimal), F.lit("."))).try_cast("double")
    if unparsable == "null":
        return read
    refused = F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double")
    return F.when(cell.isNotNull() & read.isNull(), refused).otherwise(read)


def cast_columns(df: DataFrame, columns, decimal: str = ".", unparsable: str = "fail") -> DataFrame:
    """The named columns as numbers, the others as they are."""
    return df.select(
        *[(number(named(c), decimal, unparsable) if c in columns else named(c)).alias(c) for c in df.columns]
    )


def require_columns(df: DataFrame, names, what: str = "input") -> None:
    """Fail before planning when a required column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks required column(s): {missing}")
