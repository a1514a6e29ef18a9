"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are maximal runs of characters outside these ASCII white-space codes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_LOCAL_WORK: dict[str, str] = {}
_SENT: set[str] = set()
PACKAGE = Path(__file__).resolve().parents[1]


def work_root(spark: SparkSession) -> str:
    """Folder of this application's work tables, inside ``spark.checkpoint.dir``.

    A scratch folder is chosen only where the setting is absent and the
    session is local (tests); a cluster has to name a shared folder.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = _LOCAL_WORK.setdefault(sc.applicationId, "")
        if not base:
            base = _LOCAL_WORK[sc.applicationId] = tempfile.mkdtemp(prefix="llm-work-")
    return f"{base.rstrip('/')}/llm-{sc.applicationId}"


def send_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application: as a zip that
    Spark distributes, unless PYTHONPATH already names the folder it lies in."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT or str(PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = Path(tempfile.mkdtemp(prefix="llm-package-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(str(target))
    _SENT.add(sc.applicationId)


def work_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder, and reread.

    Cuts the lineage: lost executors cost only the tasks that read the table,
    and every reader sees the same rows whatever the plan above it does.
    """
    spark = df.sparkSession
    send_package(spark)
    path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_work_tables(spark: SparkSession) -> None:
    """Delete every work table of this application (results read from them end too)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def column(name: str) -> Column:
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def word_count(col: Column) -> Column:
    """Number of words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def hash52(*parts: Column) -> Column:
    """52 uniform bits of the MD5 of the parts joined by ``/`` (NULL counts as ``~``)."""
    text = F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def unit_draw(*parts: Column) -> Column:
    """A draw in [0, 1) that the parts alone decide."""
    return hash52(*parts) / F.lit(float(1 << 52))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of an input folder; the workers are given this package first."""
    send_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_named(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``stay`` (doc_id, sha: SHA-256 of the text) names,
    same columns; rows equal in doc_id and text are one row."""
    id_, sha = F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.sha2(F.encode(text_or_empty(F.col("text")), "UTF-8"), 256)
    names = stay.select(id_.alias("__id"), F.col("sha").alias("__sha"))
    rows = docs.withColumns({"__id": id_, "__sha": sha})
    rows = rows.join(names, ["__id", "__sha"], "left_semi").dropDuplicates(["__id", "__sha"])
    return rows.select(*[column(c) for c in docs.columns])
