"""Session helpers for tests, the bench and scripts.

On a cluster the session comes from the platform; these helpers only fill in
what is unset. The checkpoint folder is read from ``spark.checkpoint.dir``
and a scratch folder is chosen only when the setting is absent (local runs).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # no Python call-site capture on every DataFrame call (plan building cost)
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "fluxsite", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (a scratch checkpoint folder
    is set only because a local run has no cluster setting)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    if "spark.checkpoint.dir" not in conf:
        conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="fluxsite-ckpt-")
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder named by the cluster (``spark.checkpoint.dir``)."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir", None)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names; in a machine-local
    folder only where the session is local and none is named."""
    base = checkpoint_dir(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="fluxsite-scratch-")
    return f"{base.rstrip('/')}/fluxsite-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession, folder: str) -> str:
    """``folder``, refused where executors could not share it: outside local
    mode a local path must lie in the folder that the cluster names."""
    named = checkpoint_dir(spark)
    plain = lambda p: "/" + p.removeprefix("file:").lstrip("/")
    inside = bool(named) and f"{plain(folder)}/".startswith(f"{plain(named).rstrip('/')}/")
    if folder.startswith("file:") and not inside and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{folder} is local to one machine; use a folder in spark.checkpoint.dir")
    return folder.rstrip("/")
