"""Clock values of event ids: 100 ns since 1582, and packed calendar fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog import types

#: 100 ns between 1582-10-15 and 1970-01-01: a fixed value.
EPOCH = 0x01B21DD213814000


def epoch_encode(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 10 + F.lit(EPOCH)


def epoch_decode(v: Column) -> Column:
    """The instant, floored to a microsecond."""
    d = v - F.lit(EPOCH)
    return F.timestamp_micros(_floor_tenth(d))


def _floor_tenth(d: Column) -> Column:
    return F.call_function("div", d - F.pmod(d, F.lit(10)), F.lit(10))


def calendar_encode(ts: Column) -> Column:
    """Months since 2010, day from 0, hour, minute, second and 100 ns in 12, 6, 6, 6, 6 and 24 bits."""
    t = ts.cast("timestamp")
    months = ((F.year(t) - 2010) * 12 + F.month(t) - 1).cast("bigint")
    fraction = F.pmod(F.unix_micros(t), F.lit(1_000_000)) * 10
    out = F.shiftleft(months, 48)
    for part, at in ((F.dayofmonth(t) - 1, 42), (F.hour(t), 36), (F.minute(t), 30), (F.second(t), 24)):
        out = out.bitwiseOR(F.shiftleft(part.cast("bigint"), at))
    return out.bitwiseOR(fraction)


def calendar_decode(v: Column) -> Column:
    field = lambda at, bits: F.shiftright(v, at).bitwiseAND((1 << bits) - 1).cast("int")
    months = field(48, 12)
    date = F.make_date(F.lit(2010) + F.floor(months / 12).cast("int"), months % 12 + 1, field(42, 6) + 1)
    micros = F.unix_micros(date.cast("timestamp")) + ((field(36, 6) * 3600 + field(30, 6) * 60 + field(24, 6)).cast("bigint") * 1_000_000) + _floor_tenth(v.bitwiseAND((1 << 24) - 1))
    return F.timestamp_micros(micros)


def calendar_value(year: Column, month: Column, day: Column, hour: Column | int = 0, minute: Column | int = 0, second: Column | int = 0, hundreds_ns: Column | int = 0) -> Column:
    """The packed calendar time of a date, a day time and a fraction in 100 ns; null where one of them does not exist or the year is before 2010."""
    c = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("bigint")
    year, month, day, hour, minute, second, hundreds_ns = map(c, (year, month, day, hour, minute, second, hundreds_ns))
    months = (year - 2010) * 12 + month - 1
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    ok = (year >= 2010) & (months < 4096) & month.between(1, 12) & day.between(1, days) & hour.between(0, 23) & minute.between(0, 59) & second.between(0, 60) & hundreds_ns.between(0, 9_999_999)
    out = F.shiftleft(months, 48)
    for part, at in ((day - 1, 42), (hour, 36), (minute, 30), (second, 24)):
        out = out.bitwiseOR(F.shiftleft(part, at))
    return F.when(ok, out.bitwiseOR(hundreds_ns))


#: Varieties of times: fixed values.
CALENDAR, LOGICAL, EPOCH_TIME = 0, 1, 2


def time(variety: Column | int, value: Column) -> Column:
    """A time from its variety (two bits) and its clock's value."""
    v = variety if isinstance(variety, Column) else F.lit(variety)
    return F.struct(v.cast("tinyint").alias("variety"), value.cast("bigint").alias("value"))


def replica(variety: Column | int, origin: Column) -> Column:
    """A replica from its origin's variety (two bits) and number."""
    v = variety if isinstance(variety, Column) else F.lit(variety)
    return F.struct(v.cast("tinyint").alias("variety"), origin.cast("bigint").alias("origin"))


def event(time: Column, replica: Column) -> Column:
    """The id of an event, version 2."""
    return types.uuid(time["variety"] * 4 + replica["variety"], time["value"], 0, 2, replica["origin"])


def time_of(u: Column) -> Column:
    return time((u["variety"] / 4).cast("int"), u["value"])


def replica_of(u: Column) -> Column:
    return replica(u["variety"] % 4, u["origin"])


def decode_event(u: Column) -> Column:
    """(time, replica) of an event's id; null for other ids."""
    return F.when(types.is_event(u), F.struct(time_of(u).alias("time"), replica_of(u).alias("replica")))


def _integer(v: Column) -> Column:
    none = lambda t: F.lit(None).cast(t)
    return F.struct(F.lit("integer").alias("tag"), v.cast("bigint").alias("i"), none("double").alias("f"), none("string").alias("s"), none(types.UUID).alias("u"))


def day_payload(day: Column) -> Column:
    """A date as three integers: year, month, day."""
    return F.array(_integer(F.year(day)), _integer(F.month(day)), _integer(F.dayofmonth(day)))


def payload_day(payload: Column) -> Column:
    """The date of three integers, months and days clipped to what exists; null for other payloads."""
    part = lambda k: F.get(payload, F.lit(k))["i"].cast("int")
    first = F.make_date(part(0), F.greatest(F.lit(1), F.least(F.lit(12), part(1))), F.lit(1))
    last = F.dayofmonth(F.last_day(first))
    ok = (F.size(payload) == 3) & F.forall(payload, lambda a: a["tag"] == "integer")
    return F.when(ok, F.date_add(first, F.greatest(F.lit(1), F.least(last, part(2))) - 1))


def seen(log: DataFrame, key: list[str]) -> DataFrame:
    """(key, seen): the greatest clock value of the events among the ids of each group of log rows: objects, ops, references and payloads."""
    ids = F.concat(F.array("object_id", "op_id", "ref_id"), F.transform(F.filter("payload", lambda a: a["tag"] == "uuid"), lambda a: a["u"]))
    values = F.transform(F.filter(ids, types.is_event), lambda u: u["value"])
    return log.groupBy(*key).agg(F.max(F.array_max(values)).alias("seen"))


def issued(rows: DataFrame, key: list[str], order: list[str], clock: DataFrame, now: Column) -> DataFrame:
    """rows with value: successive clock values of each group, from now or the value after what its clock (key, seen) has seen, the greater."""
    by = ", ".join(key)
    x = rows.join(clock.select(*key, "seen"), key, "left").withColumn("_n", F.expr(f"row_number() OVER (PARTITION BY {by} ORDER BY {', '.join(order)}) - 1"))
    return x.withColumn("value", F.greatest(now, F.coalesce(F.col("seen") + 1, now)) + F.col("_n")).drop("_n", "seen")
