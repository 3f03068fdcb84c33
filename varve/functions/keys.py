"""Time and identity keys: hours, weeks, UUIDv7, digests. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NS_PER_HOUR = 3_600_000_000_000
US_PER_HOUR = 3_600_000_000
HOURS_PER_DAY = 24
HOURS_PER_WEEK = 168
SETTLE_WEEKS = 4


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, read as UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def epoch_hour(ts_ns: str) -> Column:
    return F.expr(f"{ts_ns} div {NS_PER_HOUR}")


def week_start_hour(hour: str) -> Column:
    return F.expr(f"{hour} - pmod({hour}, {HOURS_PER_WEEK})")


def day_start_hour(hour: str) -> Column:
    return F.expr(f"{hour} - pmod({hour}, {HOURS_PER_DAY})")


def settle_before_hour(now_hour: str) -> Column:
    """Weeks that end by here may settle: four whole weeks back."""
    return week_start_hour(now_hour) - SETTLE_WEEKS * HOURS_PER_WEEK


UUID7 = "^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def is_uuid7(value: str) -> Column:
    """False for null, as an absent id isn't one."""
    return F.coalesce(F.lower(F.col(value)).rlike(UUID7), F.lit(False))


def uuid7_millis(value: str) -> Column:
    """The 48 leading bits; null where the id isn't a UUIDv7."""
    digits = F.substring(F.replace(F.lower(F.col(value)), F.lit("-"), F.lit("")), 1, 12)
    return F.when(is_uuid7(value), F.conv(digits, 16, 10).cast("long"))


def uuid7_hour(value: str) -> Column:
    return F.floor(uuid7_millis(value) / 3_600_000).cast("long")


def uuid7_day(value: str) -> Column:
    return F.floor(uuid7_millis(value) / 86_400_000).cast("long")


def mint_uuid7(df: DataFrame, millis: str, key: str, out: str = "uuid") -> DataFrame:
    """UUIDv7 for each row: its millisecond, a counter within it, bits from the key.

    Deterministic, so a repeated task mints the same ids. Within a millisecond
    the order is that of the key; more than 4096 ids spill into the next ones.
    """
    n = F.row_number().over(Window.partitionBy(millis).orderBy(key)) - 1
    ms = F.lpad(F.lower(F.hex(F.col(millis) + F.floor(n / 4096))), 12, "0")
    count = F.lpad(F.lower(F.hex(n % 4096)), 3, "0")
    noise = F.md5(F.col(key).cast("string"))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(noise, 1, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return df.withColumn(out, F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), count, F.lit("-"), variant, F.substring(noise, 2, 3), F.lit("-"), F.substring(noise, 5, 12)))


def quarantine(df: DataFrame, id_col: str, authority: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a UUIDv7, the others with what is wrong with them)."""
    kind = F.when(F.col(id_col).isNull(), "missing").when(F.lower(F.col(id_col)).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), "wrong-version").otherwise("malformed")
    issue = F.struct(kind.alias("kind"), F.col(id_col).alias("offending"), F.lit("a transaction id has to be a UUIDv7").alias("reason"), F.lit(authority).alias("authority"))
    return df.where(is_uuid7(id_col)), df.where(~is_uuid7(id_col)).withColumn("issue", issue)


def digest_key(*parts: str) -> Column:
    """The first 16 bytes (hex) of the SHA-256 of the parts, joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def iso_week(day: str) -> Column:
    """Like 2024-W03."""
    return F.expr(f"concat(cast(extract(YEAROFWEEK FROM {day}) AS string), '-W', lpad(cast(extract(WEEK FROM {day}) AS string), 2, '0'))")


def day_windows(span: DataFrame, first: str, last: str, backwards: bool = False, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(*keep, place, day, week) of each UTC day of spans in either order of their ends, from the first day or from the last."""
    low, high = F.least(first, last), F.greatest(first, last)
    days = F.sequence(high, low, F.expr("INTERVAL -1 DAY")) if backwards else F.sequence(low, high)
    # a span of one day has no direction
    days = F.when(low == high, F.array(low)).otherwise(days)
    out = span.select(*keep, F.posexplode(days).alias("place", "day"))
    return out.select(*keep, "place", "day", iso_week("day").alias("week"))
