"""Spark session settings used by the library, the tests and the benchmark.

The library never creates a session behind the caller's back: operators take
DataFrames.  ``get_session`` is a convenience for scripts and tests; on a
cluster the caller's own session (with its own ``spark.checkpoint.dir``) is
used as is.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import weakref

from pyspark.sql import SparkSession

# Settings every job relies on: UTC for date formatting, ANSI semantics,
# AQE for runtime re-planning (partition coalescing, skew-join splitting,
# broadcast conversion from measured shuffle sizes).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Sizing for a ~100 TB run on ~1000 executors.  The largest shuffle (actions
# keyed by bill: a few tens of bytes x ~10^12 rows, tens of TB) is cut into
# ~256 MB partitions: 100k initial partitions, which AQE coalesces for the
# many small shuffles (per-bill aggregates, type pairs, top-k).  Scan splits
# of 512 MB keep task counts sane; the skew-join threshold matches the
# advisory size so a heavy key is split rather than run in one task.
# Broadcasts stay at AQE's measured-size threshold.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "100000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
}


def get_session(master: str | None = None, app: str = "caseflow",
                shuffle_partitions: int | None = None,
                extra: dict | None = None, profile: str = "local") -> SparkSession:
    """Build (or reuse) a session with the settings above (``profile="cluster"``
    adds the 100 TB sizing; on a cluster the submitter's own settings win)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if profile == "cluster":
        conf.update(CLUSTER_CONF)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor (no effect once a JVM runs)
        conf["spark.driver.memory"] = "12g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared file system and is used as is; a
    cluster session without it is an error, because a folder on one machine
    cannot be read by the others.  Only a local master (tests) gets a fresh
    scratch folder, removed when the process ends.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="caseflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        atexit.register(shutil.rmtree, conf_dir, ignore_errors=True)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def reliable_checkpoint(df):
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage
    (survives executor loss; never a machine-local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_shared: list[str] = []


def note_shared(path: str) -> None:
    """A folder written for this process only: ``drop_shared_tables`` removes it with the others."""
    _shared.append(path)


def shared_table(df, name: str):
    """``df`` written once as Parquet in the shared checkpoint folder and read back:
    cuts the lineage, fixes sampled and generated values, survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    note_shared(path)
    return spark.read.schema(df.schema).parquet(path)


_of_frame: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_of_frame_lock = threading.RLock()


def once_per_frame(name: str, df, make):
    """``make(df)``, made once for each DataFrame object and name while its tables last: learners that
    start from the same rows share their first passes."""
    with _of_frame_lock:
        made = _of_frame.setdefault(df, {})
        if name not in made:
            made[name] = make(df)
        return made[name]


def drop_shared_tables(spark: SparkSession) -> int:
    """Delete the intermediate tables this process has written; call it when the
    results that read them have been written.  Returns how many were removed."""
    jvm, conf, gone = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    _of_frame.clear()
    while _shared:
        path = jvm.org.apache.hadoop.fs.Path(_shared.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone
