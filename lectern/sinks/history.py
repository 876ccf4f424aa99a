"""A history of versions on parquet that grows by the day without being rewritten."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lectern.operators.history import OPEN_END, scd2_apply, scd2_history
from lectern.session import materialize
from lectern.sinks.tables import _Folders

OPEN, CLOSED = "open", "closed"


class HistoryTable(_Folders):
    """Versions with validity ranges, by buckets of their keys, open and closed ones apart.

    A commit writes the folder ``v=<n>``: the open versions of the buckets its rows are in, and the versions it closes. Closed
    versions of earlier commits stay where they are. Only rows that are not later than their key's open version, and days that
    run again, need them: then the whole bucket is read and written anew. Every ``fold_every`` commits of a bucket its closed
    versions are put together. The file ``_live`` of a commit says where the buckets are as of it; it appears last, by a
    rename, so readers never see half of a commit.

    ``start`` is text that sorts by time, with one row per key and day. Null key values are values. What is collected is at
    most one number per bucket.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], start: str, measure: str,
                 end: str = "end_time", buckets: int = 64, fold_every: int = 60, retain: int = 3):
        super().__init__(spark, path)
        self.keys, self.start, self.measure, self.end = list(keys), start, measure, end
        self.buckets, self.fold_every, self.retain = buckets, fold_every, retain

    def _marker(self, version: int) -> str:
        return f"{self.folder('v', version)}/_live"

    def _committed(self) -> list[int]:
        return [v for v in self._done("v") if self._hadoop(self._marker(v))[0].exists(self._hadoop(self._marker(v))[1])]

    def versions(self) -> list[int]:
        """Commits that can be read."""
        return self._committed()[-self.retain:]

    def _live(self, version: int) -> dict:
        fs, marker = self._hadoop(self._marker(version))
        stream = fs.open(marker)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def _publish(self, version: int, live: dict) -> None:
        fs, marker = self._hadoop(self._marker(version))
        draft = self._hadoop(f"{self._marker(version)}.tmp")[1]
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(live).encode()))
        stream.close()
        fs.rename(draft, marker)

    def _bucket(self) -> Column:
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def _rows(self, version: int, state: str | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """Versions as of a commit, with their ``_bucket``; the conditions prune folders."""
        live = self._live(version)
        schema = T.StructType.fromJson(live["schema"])
        for name, kind in (("v", T.IntegerType()), ("_state", T.StringType()), ("_bucket", T.IntegerType())):
            schema = schema.add(name, kind)
        folders = [self.folder("v", v) for v in self._committed() if v <= version]
        df = self.spark.read.schema(schema).option("basePath", self.path).parquet(*folders)
        open_at, closed_from = (F.get(F.lit(live[name]), F.col("_bucket")) for name in ("open_at", "closed_from"))
        if state != CLOSED:
            wanted = (F.col("_state") == OPEN) & (F.col("v") == open_at)
        if state != OPEN:
            closed = (F.col("_state") == CLOSED) & (F.col("v") >= closed_from)
            wanted = closed if state == CLOSED else wanted | closed
        if buckets is not None:
            wanted = wanted & F.col("_bucket").isin(list(buckets))
        return df.where(wanted).drop("v", "_state")

    def read(self, version: int | None = None) -> DataFrame | None:
        """All versions as of the last commit, or as of ``version``; None before the first commit."""
        last = max((v for v in self.versions() if version is None or v <= version), default=None)
        return None if last is None else self._rows(last).drop("_bucket")

    def _rewritten(self, before: int, rows: DataFrame, touched: set[int], days: Sequence[str]) -> set[int]:
        """Buckets whose closed versions change: with a row not after its key's open version, or a version on one of ``days``."""
        opened = self._rows(before, OPEN)
        latest = opened.agg(F.max(self.start)).first()[0]
        first = rows.agg(F.min(F.coalesce(self.start, F.lit("")))).first()[0]
        earliest = min([d for d in (first, *days) if d is not None], default=None)
        if latest is None or earliest is None or earliest > latest:
            return set()
        now, then = rows.alias("now"), opened.where(F.col("_bucket").isin(sorted(touched))).alias("then")
        same = [F.col(f"now.{k}").eqNullSafe(F.col(f"then.{k}")) for k in self.keys]
        late = F.col(f"now.{self.start}").isNull() | (F.col(f"now.{self.start}") <= F.col(f"then.{self.start}"))
        found = now.join(then, reduce(and_, same) & late, "left_semi").select("_bucket")
        if days:
            found = found.union(self._rows(before).where(F.col(self.start).isin(list(days))).select("_bucket"))
        return {r[0] for r in found.distinct().collect()}

    def commit(self, day_rows: DataFrame, days: Sequence[str] = (), version: int | None = None) -> bool:
        """Fold daily amounts in, as :func:`lectern.operators.history.scd2_apply` does. False if ``version`` is there already."""
        committed = self._committed()
        before = committed[-1] if committed else None
        if version is None:
            version = 0 if before is None else before + 1
        elif before is not None and version <= before:
            return False
        live = {"open_at": [-1] * self.buckets, "closed_from": [0] * self.buckets, "parts": [0] * self.buckets}
        if before is not None:
            live = self._live(before)
            self.buckets = len(live["open_at"])  # the table keeps its first number
        rows = materialize(day_rows.withColumn("_bucket", self._bucket()), "history-rows")
        touched = {r[0] for r in rows.select("_bucket").distinct().collect()}
        anew = set() if before is None else self._rewritten(before, rows, touched, days)
        grown = sorted(touched - anew)
        folded = [b for b in grown if live["parts"][b] >= self.fold_every]

        columns = [c for c in rows.columns if c != "_bucket"]
        later = rows.where(F.col("_bucket").isin(grown)).select(*columns)
        if before is None:
            money, names = day_rows.schema[self.measure].dataType, [*columns, self.end]
        else:
            schema = T.StructType.fromJson(live["schema"])
            money, names = schema[self.measure].dataType, schema.names
            # an open version counts as a day with everything up to it, so totals go on from there
            later = later.unionByName(self._rows(before, OPEN, grown).select(*columns))
        out = scd2_history(later, self.keys, self.start, self.measure, self.end).select(*names)
        if folded:
            out = out.unionByName(self._rows(before, CLOSED, folded).select(*names))
        if anew:
            whole = self._rows(before, None, sorted(anew)).select(*names)
            out = out.unionByName(scd2_apply(whole, rows.where(F.col("_bucket").isin(sorted(anew))).select(*columns),
                                             self.keys, self.start, self.measure, self.end, days))
        out = out.withColumn(self.measure, F.col(self.measure).cast(money))
        live["schema"] = out.schema.jsonValue()
        state = F.when(F.col(self.end) == OPEN_END, F.lit(OPEN)).otherwise(F.lit(CLOSED))
        (out.withColumn("_state", state).withColumn("_bucket", self._bucket()).hint("rebalance", "_state", "_bucket")
         .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_state", "_bucket")
         .parquet(self.folder("v", version)))
        for b in touched | anew:
            live["open_at"][b] = version
            live["parts"][b] += 1
        for b in {*anew, *folded}:
            live["closed_from"][b], live["parts"][b] = version, 1
        self._publish(version, live)
        self._clear(committed + [version])
        return True

    def _clear(self, committed: list[int]) -> None:
        """Drop the folders of buckets that only the commit before the oldest readable one still used."""
        if len(committed) <= self.retain:
            return
        gone, kept = (self._live(v) for v in committed[-self.retain - 1:][:2])
        fs, _ = self._hadoop(self.path)
        for b, (old, new) in enumerate(zip(gone["open_at"], kept["open_at"])):
            dead = [f"{self.folder('v', old)}/_state={OPEN}/_bucket={b}"] if 0 <= old != new else []
            dead += [f"{self.folder('v', v)}/_state={CLOSED}/_bucket={b}" for v in committed
                     if gone["closed_from"][b] <= v < kept["closed_from"][b]]
            for folder in dead:
                fs.delete(self._hadoop(folder)[1], True)
