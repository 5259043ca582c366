"""SparkSession defaults for the library.

The settings are the ones the operators rely on:

* ``spark.sql.session.timeZone=UTC`` - day arithmetic and ``to_date`` are
  defined in UTC.
* AQE with skew-join splitting and runtime broadcast demotion: a join side
  is broadcast only once its *measured* shuffle size is under the AQE
  threshold, never on a compile-time guess.
* ANSI mode stays on (Spark 4 default); every division goes through
  ``try_divide``.

On a cluster the session already exists; :func:`get_session` only fills in
settings that still have Spark's own default and never overrides
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "8MB",
    # compile-time broadcast only for relations whose file size is known small
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.files.maxPartitionBytes": "256MB",
    # generated methods beyond this are never compiled by the JVM and run interpreted; such stages do without
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
#: Spark's own values of the settings above; anything else was set by someone
_SPARK_OWN = {
    "spark.sql.autoBroadcastJoinThreshold": {"10485760b", "10MB", "10485760"},
    "spark.sql.files.maxPartitionBytes": {"134217728b", "128MB", "134217728"},
    "spark.sql.codegen.hugeMethodLimit": {"65535"},
}


def get_session(master: str | None = None, app: str = "churnkit",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build a local one with library defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        configure(active)
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false")
    b = b.config("spark.driver.memory", os.environ.get("CHURNKIT_DRIVER_MEM", "8g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply defaults that are not yet set on an existing session."""
    for k, v in _DEFAULTS.items():
        if k == "spark.sql.session.timeZone":
            spark.conf.set(k, v)  # correctness: day boundaries are UTC
            continue
        try:
            cur = spark.conf.get(k)
        except Exception:  # pragma: no cover - unset key
            cur = None
        if cur is None or cur in _SPARK_OWN.get(k, ()):
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` from the session.  Only where it is unset and
    driver and executors share one machine (a ``local`` master, as in tests) a
    scratch folder is created; on a cluster that folder would not be shared, so
    an unset directory is an error there.
    """
    cur = spark.sparkContext.getCheckpointDir()
    if cur:
        return cur
    try:
        conf = spark.conf.get("spark.checkpoint.dir")
    except Exception:
        conf = None
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="churnkit-ckpt-")
    spark.sparkContext.setCheckpointDir(conf)
    return spark.sparkContext.getCheckpointDir() or conf


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name: str = "stored"):
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Like a checkpoint it cuts the lineage with files that survive executor loss,
    and later reads keep column pruning and file statistics."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
