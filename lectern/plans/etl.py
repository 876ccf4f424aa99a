"""Raw logs -> cleaned warehouse tables (23 logs, one generic job)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, functions as F

from lectern.functions import scalars as S
from lectern.sources.logs import clean_json
from lectern.sources.specs import EXAM_LOGS, LOGS, MEMBER_LOGS
from lectern.sources.warehouse import Warehouse


def mask_member(member: DataFrame) -> DataFrame:
    """Personal data leaves the raw layer masked."""
    return (member.withColumn("fullname", S.mask_name(F.col("fullname")))
            .withColumn("phone", S.mask_phone(F.col("phone")))
            .withColumn("password", S.mask_password()))


def decode_regtype(regtype: DataFrame) -> DataFrame:
    return regtype.withColumn("regsourcename", S.source_name(F.col("regsourcename")))


EXTRA_STEPS = {"dwd_member": mask_member, "dwd_member_regtype": decode_regtype}


def load_id(lines: DataFrame) -> str:
    """What identifies the content of a load: the number of its lines and the sum of their hashes, in any order."""
    found = lines.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("value").cast("decimal(38,0)")), F.lit(0))).first()
    return hashlib.sha256(repr(tuple(map(int, found))).encode()).hexdigest()[:16]


def load_log(wh: Warehouse, table: str, raw_dir: str, on_bad: str = "quarantine",
             quarantine_dir: str | None = None, load: str | None = None) -> int:
    """Clean one log file into its table; returns the number of bad lines.

    Bad lines go to ``quarantine_dir/<table>`` when given. They are counted while the good rows are
    written, and read again only if there are any. Dimensions are replaced. Daily logs grow by the rows of the load,
    whatever days these are of; ``load`` names it, by default after its content (:func:`load_id`), and the same load again
    replaces itself, so loading a file twice changes nothing and a late row never costs a day. ``on_bad="fail"`` fails the job at the first bad line;
    ``on_bad="spec"`` does so for the logs marked strict.
    """
    spec = LOGS[table]
    if on_bad == "spec":
        on_bad = "fail" if spec.strict else "quarantine"
    lines = wh.spark.read.text(f"{raw_dir.rstrip('/')}/{spec.file}")
    seen = Observation()
    good, bad = clean_json(lines, spec, on_bad, observation=seen)
    good = EXTRA_STEPS.get(table, lambda df: df)(good)
    if spec.mode == "append":
        wh.write_load(table, good, load or load_id(lines))
    else:
        wh.write(table, good, "replace")
    count = seen.get["bad"] or 0
    if count and quarantine_dir:
        bad.write.mode("overwrite").text(f"{quarantine_dir.rstrip('/')}/{table}")
    return count


def load_logs(wh: Warehouse, raw_dir: str, tables: Iterable[str], **options) -> dict[str, int]:
    """Bad lines per table."""
    return {table: load_log(wh, table, raw_dir, **options) for table in tables}


def load_member_logs(wh: Warehouse, raw_dir: str, **options) -> dict[str, int]:
    return load_logs(wh, raw_dir, MEMBER_LOGS, **options)


def load_exam_logs(wh: Warehouse, raw_dir: str, **options) -> dict[str, int]:
    return load_logs(wh, raw_dir, EXAM_LOGS, **options)
