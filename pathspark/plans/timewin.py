"""Time expressions as columns: 31 identifiers, each a window [lo, hi] over event times, a phrase, and a sampler of anchors.

One plan serves all identifiers: unit, interval and anchor are columns of the questions. `compat` windows keep the anchor's time of
day, as literals made from it do; `calendar` windows (the default) cover whole years, months and days.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TimeExpression:
    id: str
    kind: str  # absolute, relative, exact, blank
    unit: str | None = None  # year, month, day
    interval: str | None = None  # in, since, until, at
    back: str | None = None  # relative: last (1 unit ago), this (0), n (n units ago)


def _registry() -> dict[str, TimeExpression]:
    out = [TimeExpression(f"abs-{u}-{i}", "absolute", u, i) for u in ("year", "month", "day") for i in ("in", "until", "since")]
    out.append(TimeExpression("abs-exact-in", "absolute", "day", "at"))
    for u in ("year", "month", "day"):
        out += [TimeExpression(f"rel-{u}-{i}-last", "relative", u, i, "last") for i in ("in", "until", "since")]
        out.append(TimeExpression(f"rel-{u}-in-this", "relative", u, "in", "this"))
        out += [TimeExpression(f"rel-{u}-{i}", "relative", u, i, "n") for i in ("until", "since")]
    out += [TimeExpression("exact-first", "exact"), TimeExpression("exact-last", "exact"), TimeExpression("blank", "blank")]
    return {t.id: t for t in out}


TIME_EXPRESSIONS = _registry()
#: The windows that a template's global slot allows.
GLOBAL = tuple(t for t, e in TIME_EXPRESSIONS.items() if e.kind != "exact")


def register_time_expression(expression: TimeExpression) -> None:
    if expression.id in TIME_EXPRESSIONS:
        raise ValueError(f"time expression {expression.id} is registered already")
    TIME_EXPRESSIONS[expression.id] = expression


def definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.id, t.kind, t.unit, t.interval, t.back) for t in TIME_EXPRESSIONS.values()], "time_id string, kind string, unit string, interval string, back string")


def _minus(t: Column, n: Column, unit: Column) -> Column:
    months = F.when(unit == "year", n * 12).when(unit == "month", n).otherwise(F.lit(0))
    days = F.when(unit == "day", n).otherwise(F.lit(0))
    return t - F.make_ym_interval(F.lit(0), months) - F.make_dt_interval(days)


def anchor(kind: Column, unit: Column, back: Column, date: Column, n: Column, now: Column) -> Column:
    """The instant that a window is built on: a given date, or now less some units. Month ends are clamped."""
    q = F.when(back == "last", F.lit(1)).when(back == "this", F.lit(0)).otherwise(n)
    return F.when(kind == "absolute", date).when(kind == "relative", _minus(now, q.cast("int"), unit))


def bounds(unit: Column, interval: Column, d: Column, mode: str = "calendar") -> tuple[Column, Column]:
    """(lo, hi), both inclusive and null where open. Calendar windows end at the last microsecond."""
    first, last = F.when(unit == "year", F.date_trunc("year", d)).when(unit == "month", F.date_trunc("month", d)).otherwise(F.date_trunc("day", d)), None
    if mode == "compat":
        tod = d - F.date_trunc("day", d)
        month_end = F.last_day(d).cast("timestamp")
        year_end = F.make_timestamp(F.year(d), F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0.0))
        first = F.when(unit == "day", d).otherwise(first + tod)
        last = F.when(unit == "year", year_end + tod).when(unit == "month", month_end + tod).otherwise(d)
    else:
        length = F.when(unit == "year", F.add_months(first, 12)).when(unit == "month", F.add_months(first, 1)).otherwise(F.date_add(first, 1))
        last = length.cast("timestamp") - F.expr("interval 1 microsecond")
    lo = F.when(interval == "at", d).when(interval.isin("in", "since"), first)
    hi = F.when(interval == "at", d).when(interval.isin("in", "until"), last)
    return lo, hi


def with_windows(questions: DataFrame, mode: str = "calendar") -> DataFrame:
    """Adds lo, hi and pick to questions with time_id, and date, n, now as far as their kinds need them. exact_id, if there, sets pick."""
    defs = F.broadcast(definitions(questions.sparkSession).withColumnRenamed("time_id", "d_id"))  # one row per registered expression
    q = questions
    for name, kind in (("date", "timestamp"), ("n", "int"), ("now", "timestamp"), ("exact_id", "string")):
        q = q if name in q.columns else q.withColumn(name, F.lit(None).cast(kind))
    q = q.join(defs, F.col("time_id") == F.col("d_id"), "left")
    d = anchor(F.col("kind"), F.col("unit"), F.col("back"), F.col("date").cast("timestamp"), F.col("n"), F.col("now").cast("timestamp"))
    lo, hi = bounds(F.col("unit"), F.col("interval"), d, mode)
    pick = F.when(F.coalesce("exact_id", "time_id") == "exact-last", "last").otherwise("first")
    return q.withColumn("lo", lo).withColumn("hi", hi).withColumn("pick", pick).drop("d_id", "kind", "unit", "interval", "back")


def in_window(t: Column, lo: Column, hi: Column) -> Column:
    return (lo.isNull() | (t >= lo)) & (hi.isNull() | (t <= hi))


def phrase(time_id: Column, date: Column, n: Column) -> Column:
    """How a question words its time expression."""
    out = F.lit("")
    word = {"in": "in", "until": "until", "since": "since"}
    for e in TIME_EXPRESSIONS.values():
        if e.kind == "exact":
            text = F.lit(e.id.split("-")[1])
        elif e.kind == "absolute":
            shown = F.date_format(date, {"year": "yyyy", "month": "MM/yyyy", "day": "dd/MM/yyyy"}[e.unit])
            text = F.concat(F.lit("at "), F.date_format(date, "yyyy-MM-dd HH:mm:ss")) if e.interval == "at" else F.concat(F.lit(("on" if e.unit == "day" and e.interval == "in" else word[e.interval]) + " "), shown)
        elif e.kind == "relative":
            day = {"last": "yesterday", "this": "today"}.get(e.back) if e.unit == "day" else None
            said = F.lit(day or f"{e.back} {e.unit}") if e.back != "n" else F.concat(n.cast("string"), F.lit(f" {e.unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
            text = said if e.interval == "in" else F.concat(F.lit(word[e.interval] + " "), said)
        else:
            text = F.lit("")
        out = F.when(time_id == e.id, text).otherwise(out)
    return out


#: The largest n of relative expressions, by unit.
MOST_BACK = {"year": 10, "month": 36, "day": 800}


def sample_anchor(key: Column, first: Column, last: Column, unit: Column) -> tuple[Column, Column]:
    """A whole second between first and last, and an n of 1 to MOST_BACK, drawn by the hash of key."""
    span = F.greatest(F.unix_timestamp(last) - F.unix_timestamp(first), F.lit(0)) + 1
    date = F.timestamp_seconds(F.unix_timestamp(first) + F.pmod(F.xxhash64(key, F.lit("date")), span))
    most = F.when(unit == "year", MOST_BACK["year"]).when(unit == "month", MOST_BACK["month"]).otherwise(MOST_BACK["day"])
    return date, (F.pmod(F.xxhash64(key, F.lit("n")), most.cast("long")) + 1).cast("int")
