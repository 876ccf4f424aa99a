"""Scalar column expressions: masking, decoding, bands, rounding, text fields.

All stay inside built-in Spark functions, so they fuse into the surrounding codegen stage.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Registration source codes and the names reports show for them.
SOURCE_NAMES = {"1": "PC", "2": "Mobile", "3": "APP", "4": "WeChat"}
SOURCE_OTHER = "other"
# Platform codes of the registration stream.
PLATFORM_NAMES = {"1": "PC", "2": "APP"}
PLATFORM_OTHER = "Other"
# Score band upper bounds and labels; the first band includes 0.
SCORE_BANDS = [(20, "0-20"), (40, "20-40"), (60, "40-60"), (80, "60-80"), (100, "80-100")]

PASSWORD_MASK = "******"
QUESTIONS_PER_POINT = 30


def mask_name(name: Column) -> Column:
    """First character followed by ``XX``; null stays null."""
    return F.concat(F.substring(name, 1, 1), F.lit("XX"))


def mask_phone(phone: Column) -> Column:
    """Digits 1-3, four stars, digits 9-11: an 11-digit number comes out 10 characters long.

    Null stays null and short numbers never raise.
    """
    return F.concat(F.substring(phone, 1, 3), F.lit("****"), F.substring(phone, 9, 3))


def mask_password(_password: Column | None = None) -> Column:
    return F.lit(PASSWORD_MASK)


def decode(code: Column, names: dict[str, str], other: str) -> Column:
    """Code -> name, anything else (null too) -> ``other``."""
    (first, label), *rest = names.items()
    out = F.when(code == first, F.lit(label))
    for key, label in rest:
        out = out.when(code == key, F.lit(label))
    return out.otherwise(F.lit(other))


def source_name(code: Column) -> Column:
    return decode(code, SOURCE_NAMES, SOURCE_OTHER)


def platform_name(code: Column) -> Column:
    return decode(code, PLATFORM_NAMES, PLATFORM_OTHER)


def score_band(score: Column) -> Column:
    """Band label of a 0-100 score; below 0, above 100 and null give null."""
    out = F.when(score < 0, F.lit(None).cast("string"))
    for upper, label in SCORE_BANDS:
        out = out.when(score <= upper, F.lit(label))
    return out


def half_up(value: Column, places: int = 1) -> Column:
    """Decimal rounded HALF_UP, once, from up to 18 places; text that is no number gives null."""
    return F.round(value.try_cast("decimal(38,18)"), places).try_cast(f"decimal(18,{places})")


def int_or_zero(value: Column) -> Column:
    """Integer of a JSON scalar read as text: quoted numbers count, fractions are cut, else 0.

    The plain cast answers for whole numbers; only what it rejects is tried as a decimal.
    """
    return F.coalesce(value.try_cast("int"), value.try_cast("decimal(24,6)").try_cast("int"), F.lit(0))


def bigint_or_null(value: Column) -> Column:
    return F.coalesce(value.try_cast("bigint"), value.try_cast("decimal(38,6)").try_cast("bigint"))


def money(value: Column) -> Column:
    """``decimal(10,4)``; null where the text is no number or does not fit."""
    return value.try_cast("decimal(10,4)")


def day_to_iso(day: Column) -> Column:
    """``yyyyMMdd`` -> ``yyyy-MM-dd``; null for text that is no such day."""
    return F.date_format(F.try_to_date(day, "yyyyMMdd"), "yyyy-MM-dd")


def day_of(ts: Column) -> Column:
    """Timestamp -> ``yyyyMMdd`` in the session zone."""
    return F.date_format(ts, "yyyyMMdd")


def now_text() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def elapsed_seconds(start_ms: Column, end_ms: Column) -> Column:
    """Whole seconds between two epoch-millisecond stamps, rounded towards zero."""
    return F.call_function("div", end_ms - start_ms, F.lit(1000).cast("bigint"))


def percent_text(numerator: Column, denominator: Column) -> Column:
    """``57%``: no decimals, ties to the even digit; a zero base gives ``0%``."""
    ratio = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce(F.concat(F.format_number(ratio * 100, 0), F.lit("%")), F.lit("0%"))


def rate(part: Column, other: Column, scale: int = 2) -> Column:
    """``part / (part + other)`` as ``decimal(4, scale)``."""
    return F.try_divide(part, part + other).cast(f"decimal(4,{scale})")


def correct_rate(right: Column, total: Column) -> Column:
    return right.cast("double") / total.cast("double")


def mastery_rate(distinct_questions: Column, right: Column, total: Column,
                 questions_per_point: int = QUESTIONS_PER_POINT) -> Column:
    share = distinct_questions.cast("double") / F.lit(float(questions_per_point))
    return share * correct_rate(right, total)


def effective_seconds(wall_seconds: Column, start: Column, end: Column, new: Column) -> Column:
    """Wall seconds scaled by the share of the play that was new, cut to whole seconds.

    Integer arithmetic, so no float can fall just below a whole number. A play of zero
    length has no new share and counts 0.
    """
    length = (end - start).cast("bigint")
    scaled = F.call_function("div", wall_seconds * new, F.when(length != 0, length))
    return F.coalesce(scaled, F.lit(0).cast("bigint"))


def region_part(region: Column, part: int = 2) -> Column:
    """Field of a ``country|area|province|city|isp`` text (0-based)."""
    return F.get(F.split(region, r"\|"), F.lit(part))


def ip_number(ip: Column) -> Column:
    """Dotted IPv4 text -> bigint; null for anything else."""
    octets = F.split(ip, r"\.")
    value = F.lit(0).cast("bigint")
    valid = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    for i in range(4):
        octet = F.get(octets, F.lit(i)).try_cast("int")
        valid = valid & (octet <= 255)
        value = value * 256 + octet
    return F.when(valid, value)


def format_intervals(intervals: Column) -> Column:
    """``array<struct<s,e>>`` -> ``"s-e,s-e"``."""
    return F.array_join(
        F.transform(intervals, lambda i: F.concat_ws("-", i["s"].cast("string"), i["e"].cast("string"))), ",")


def parse_intervals(text: Column) -> Column:
    """``"s-e,s-e"`` -> ``array<struct<s:int,e:int>>``; empty or null text -> empty array. Starts may be negative."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.length(p) > 0)
    return F.transform(parts, lambda p: F.struct(
        F.substring_index(p, "-", 1).cast("int").alias("s"),
        F.substring_index(p, "-", -1).cast("int").alias("e")))
