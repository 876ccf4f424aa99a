"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Settings every job relies on. Broadcast joins are left to Spark's own size check
#: (``autoBroadcastJoinThreshold`` and the adaptive twin); no job hints ``broadcast``.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


#: Target size of one shuffle partition; the adaptive planner merges smaller ones.
PARTITION_BYTES = 128 * 1024 * 1024
#: Most shuffle partitions of a job. Map tasks times reduce tasks is what the driver keeps track of, so beyond
#: this number partitions grow instead (and spill), and the adaptive planner splits the skewed ones.
MOST_PARTITIONS = 16_000
#: Shuffle partitions, and so state stores, of a stream. A stream keeps this number for its whole life.
STREAM_PARTITIONS = 200


def shuffle_partitions(input_bytes: int) -> int:
    """Shuffle partitions for a batch job that reads ``input_bytes``."""
    return min(MOST_PARTITIONS, max(200, -(-input_bytes // PARTITION_BYTES)))


def build_session(app_name: str, master: str | None = None, input_bytes: int | None = None,
                  **conf: str) -> SparkSession:
    """Session with :data:`DEFAULTS`; ``conf`` keys use ``__`` for dots.

    ``input_bytes`` sizes the shuffles of the job (:func:`shuffle_partitions`). The adaptive planner joins
    partitions that turn out small.
    """
    if input_bytes:
        conf.setdefault("spark__sql__shuffle__partitions", str(shuffle_partitions(input_bytes)))
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@lru_cache(maxsize=None)
def _local_folder() -> str:
    """One temporary folder per process, for local masters only; it goes when the process ends."""
    folder = tempfile.mkdtemp(prefix="lectern-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def stream_session(spark: SparkSession, partitions: int = STREAM_PARTITIONS) -> SparkSession:
    """A session for streams beside the caller's: the same context, its own number of shuffle partitions."""
    session = spark.newSession()
    for key, value in DEFAULTS.items():
        session.conf.set(key, spark.conf.get(key, value) if key == "spark.sql.session.timeZone" else value)
    session.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return session


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings of the session for one write; ``conf`` keys use ``__`` for dots. Those of before hold again afterwards."""
    keys = {key.replace("__", "."): value for key, value in conf.items()}
    before = {key: spark.conf.get(key, None) for key in keys}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables and stream checkpoints.

    It lies under the shared folder named in ``spark.checkpoint.dir``. Only a local master may do without
    that setting: driver and executors of a cluster see no common temporary folder, so there an unset
    setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on master {master}")
        base = _local_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the work folder and read it back.

    For a reduced intermediate result that several branches of a plan read: it is computed once, its size
    is known to the planner, and a lost executor costs no recomputation.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
