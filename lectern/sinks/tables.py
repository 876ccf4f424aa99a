"""Warehouse writes and versioned result tables on plain parquet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.operators.grouping import first_per_key
from lectern.operators.upsert import upsert
from lectern.session import settings


#: Partitions that a task of a write has files open for at a time.
OPEN_FILES = 8


def write_partitions(df: DataFrame, path: str, partitions: Sequence[str] = (), mode: str = "overwrite",
                     compression: str = "snappy", rebalance: bool = True) -> None:
    """Write by column name; ``overwrite`` replaces only the partitions present in ``df``, ``replace`` all of ``path``.

    ``append`` adds files as they are. Before the write
    rows are rebalanced on the partition columns: Spark joins small partitions and splits large ones, so
    neither many small files nor one task per tenant results. A task keeps the files of up to :data:`OPEN_FILES` partitions open
    instead of sorting its rows by partition; with more, Spark sorts the rest.
    """
    whole, mode = mode == "replace", "overwrite" if mode == "replace" else mode
    if rebalance:
        df = df.hint("rebalance", *partitions)
    writer = df.write.mode(mode).option("compression", compression)
    if partitions:
        writer = writer.partitionBy(*partitions)
    with settings(df.sparkSession, spark__sql__maxConcurrentOutputFileWriters=str(OPEN_FILES)):
        writer.option("partitionOverwriteMode", "static" if whole or not partitions else "dynamic").parquet(path)


class _Folders:
    """Numbered result folders ``<kind>=<n>`` below ``path``; one counts once its success marker is there."""

    def __init__(self, spark: SparkSession, path: str, run: str | None = None):
        self.spark, self.path, self.run = spark, path.rstrip("/"), run

    def claim(self) -> None:
        """Bind the folders to the stream run that writes them.

        Batch ids only mean something within one run, that is, one checkpoint: a new checkpoint counts from 0 again. The
        first write stores the run; a write of another run fails instead of being taken for a replay.
        """
        if self.run is None:
            return
        fs, marker = self._hadoop(f"{self.path}/_run")
        if fs.exists(marker):
            stream = fs.open(marker)
            owner = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if owner != self.run:
                raise ValueError(f"{self.path} holds results of the stream run {owner}; run {self.run} has another "
                                 "checkpoint and needs an output folder of its own")
        else:
            stream = fs.create(marker, False)
            stream.writeBytes(self.run)
            stream.close()

    def _hadoop(self, path: str):
        sc = self.spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(sc._jsc.hadoopConfiguration()), target

    def _done(self, kind: str) -> list[int]:
        fs, root = self._hadoop(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        numbers = [int(n[len(kind) + 1:]) for n in names if n.startswith(f"{kind}=")]
        return sorted(n for n in numbers if fs.exists(self._hadoop(f"{self.folder(kind, n)}/_SUCCESS")[1]))

    def folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}={number}"

    def _drop(self, kind: str, number: int) -> None:
        fs, target = self._hadoop(self.folder(kind, number))
        fs.delete(target, True)


class Published(_Folders):
    """Which batch the tables of a stream have all reached.

    A job that writes several tables publishes a batch after the last of them. Readers take the tables as of that batch
    (``through``), so those of one batch appear together, also while the next one is written or after it has failed midway.
    """

    def publish(self, batch_id: int) -> None:
        fs, marker = self._hadoop(f"{self.folder('published', batch_id)}/_SUCCESS")
        fs.create(marker, True).close()
        for old in self._done("published"):
            if old < batch_id:
                self._drop("published", old)

    def last(self) -> int | None:
        return max(self._done("published"), default=None)


class VersionedTable(_Folders):
    """A result table whose every version is a complete folder ``v=<n>`` below ``path``.

    A version counts once its success marker is there, so readers never see a half-written one, a
    repeated commit of the same version is skipped, and a plan may read the current version while it
    writes the next. Meant for results (totals, histories), not for raw logs.
    """

    def __init__(self, spark: SparkSession, path: str, retain: int = 3, run: str | None = None):
        super().__init__(spark, path, run)
        self.retain = retain

    def versions(self) -> list[int]:
        return self._done("v")

    def current(self) -> int | None:
        return max(self.versions(), default=None)

    def read(self, through: int | None = None) -> DataFrame | None:
        """The current version, or the latest one up to ``through``; None before the first commit."""
        version = max((v for v in self.versions() if through is None or v <= through), default=None)
        return None if version is None else self.spark.read.parquet(self.folder("v", version))

    def commit(self, df: DataFrame, version: int | None = None) -> bool:
        """Write ``df`` as ``version`` (default: the next one). False if it was already committed."""
        self.claim()
        current = self.current()
        if version is None:
            version = 0 if current is None else current + 1
        elif current is not None and version <= current:
            return False
        df.write.mode("overwrite").parquet(self.folder("v", version))
        for old in self.versions()[:-self.retain]:
            self._drop("v", old)
        return True

    def merge(self, updates: DataFrame, version: int, keys: Sequence[str], **columns: Sequence[str]) -> bool:
        """Upsert ``updates`` into the current version (see :func:`lectern.operators.upsert.upsert`)."""
        self.claim()
        current = self.current()
        if current is not None and version <= current:
            return False
        target = self.read()
        return self.commit(updates if target is None else upsert(target, updates, keys, **columns), version)


class ChangeLog(_Folders):
    """Keyed results of a stream: every batch writes only the rows it changed, with their full totals.

    A batch owns the folder ``batch=<id>``, so a replayed batch overwrites itself. The table is the latest
    row per key. :meth:`compact` folds finished batches into ``base=<id>``. With ``buckets`` rows lie in that many folders by
    their keys, and :meth:`read` can leave out the folders that hold no key of a batch.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], run: str | None = None, buckets: int | None = None):
        super().__init__(spark, path, run)
        self.keys, self.buckets = list(keys), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def _store(self, rows: DataFrame, folder: str) -> None:
        if self.buckets:
            rows = rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_bucket").parquet(folder)
        else:
            rows.hint("rebalance").write.mode("overwrite").parquet(folder)

    def write(self, changed: DataFrame, batch_id: int) -> bool:
        self.claim()
        if batch_id <= max(self._done("base"), default=-1):
            return False
        self._store(changed, self.folder("batch", batch_id))
        return True

    def add(self, counts: DataFrame, batch_id: int, columns: Sequence[str]) -> bool:
        """Write the new totals of the keys in ``counts``: their ``columns`` plus what earlier batches have.

        Totals are read up to the batch before, so a batch that runs again writes the same rows.
        """
        before = self.read(batch_id - 1)
        if before is None:
            return self.write(counts, batch_id)
        same = reduce(and_, [counts[k].eqNullSafe(before[k]) for k in self.keys])
        names = [c for c in counts.columns if c not in columns]
        return self.write(counts.join(before, same, "left").select(
            *[counts[c] for c in names],
            *[(counts[c] + F.coalesce(before[c], F.lit(0))).alias(c) for c in columns]), batch_id)

    def _filled(self, kind: str) -> list[int]:
        """Folders with rows; one without any has no bucket in it."""
        done = self._done(kind)
        if not self.buckets:
            return done
        return [n for n in done if any(s.isDirectory() for s in self._hadoop(self.path)[0].listStatus(
            self._hadoop(self.folder(kind, n))[1]))]

    def _rows(self, through: int | None = None) -> DataFrame | None:
        base = max(self._filled("base"), default=None)
        batches = [b for b in self._filled("batch") if (base is None or b > base) and (through is None or b <= through)]
        frames = [] if base is None else [
            self.spark.read.parquet(self.folder("base", base)).withColumn("_batch", F.lit(base).cast("bigint"))]
        if batches:
            rows = (self.spark.read.option("basePath", self.path)
                    .parquet(*[self.folder("batch", b) for b in batches]))
            frames.append(rows.withColumn("_batch", F.col("batch").cast("bigint")).drop("batch"))
        if not frames:
            return None
        return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])

    def read(self, through: int | None = None, touching: DataFrame | None = None) -> DataFrame | None:
        """Latest row per key, or None before the first batch. With ``touching``, only of the buckets its keys are in."""
        rows = self._rows(through)
        if rows is None:
            return None
        if touching is not None and self.buckets:
            touched = [r[0] for r in touching.select(self._bucket()).distinct().collect()]  # self.buckets numbers at most
            rows = rows.where(F.col("_bucket").isin(touched))
        return first_per_key(rows.withColumn("_order", -F.col("_batch")), self.keys, ("_order",)).drop(
            "_order", "_batch", "_bucket")

    def compact(self, through: int) -> None:
        """Fold batches up to ``through`` into one folder and drop them."""
        current = self.read(through)
        if current is None or through <= max(self._done("base"), default=-1):
            return
        self._store(current, self.folder("base", through))
        for base in self._done("base"):
            if base < through:
                self._drop("base", base)
        for batch in self._done("batch"):
            if batch <= through:
                self._drop("batch", batch)
