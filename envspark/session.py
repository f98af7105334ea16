"""Session helpers.

The library never creates machine-local scratch folders on a cluster: the
lineage-cutting folder is read from ``spark.checkpoint.dir`` (the shared
folder the cluster names).  Only when that setting is absent (local tests,
``local[*]`` master) do we set our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "envspark", conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    merged = {**DEFAULT_CONF, **(conf or {})}
    if master and master.startswith("local") and "spark.checkpoint.dir" not in merged:
        merged["spark.checkpoint.dir"] = tempfile.mkdtemp(
            prefix="envspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    for k, v in merged.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared lineage-cut folder configured for the cluster, if any."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    return spark.sparkContext.getConf().get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set our own only when unset
    and the master is local (tests)."""
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir()
    d = checkpoint_dir(spark)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="envspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


_WRITTEN: list[tuple[str, str]] = []


def record_path(spark: SparkSession, path: str) -> str:
    """Remember a table written to the shared folder, for ``drop_tables``."""
    _WRITTEN.append((spark.sparkContext.applicationId, path))
    return path


def drop_tables(spark: SparkSession) -> None:
    """Remove the tables that this session wrote to the shared folder; called
    at its end, when nothing reads them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    app = spark.sparkContext.applicationId
    for owner, path in list(_WRITTEN):
        if owner == app:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
            _WRITTEN.remove((owner, path))


def materialize(df, name: str, partition_by: list[str] | None = None):
    """Cut lineage by writing ``df`` as a Parquet table under the shared
    ``spark.checkpoint.dir`` and reading it back.

    Unlike an eager ``checkpoint()`` (which computes the plan twice unless it
    is persisted) the plan runs once; the files live on shared storage, so a
    lost executor does not lose them; and later scans get column pruning,
    filter pushdown and, with ``partition_by``, partition pruning."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = record_path(spark, f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    out = spark.read.parquet(path)
    if partition_by:
        out = out.select(*df.columns)   # keep the original column order
    return out


def one_row(df):
    """A one-row parameter table read back from storage, re-derived through a
    global aggregate so the plan PROVES it has one row (Catalyst maxRows = 1):
    cross joins with it are then bounded by construction."""
    from pyspark.sql import functions as F
    return df.agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in df.columns])
