"""Cron schedules as arrays of allowed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.binding import let
from corpusmap.functions.text import trim_space
from corpusmap.operators.ranking import last_by

# Names, shorthands and bounds of the five fields.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
WEEKDAYS = {"sun": 0, "mon": 1, "tue": 2, "wed": 3, "thu": 4, "fri": 5, "sat": 6}
SHORTHANDS = {
    "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0",
    "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *",
}
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("dom", 1, 31), ("month", 1, 12), ("dow", 0, 7))
PART = r"^(\*|\d+-\d+|\d+)(?:/(\d+))?$"
NAME_RANGE = r"^([a-zA-Z]{3})-([a-zA-Z]{3})$"


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _named(field: Column, names: dict[str, int]) -> Column:
    """A field with names and ranges of names turned into numbers."""
    table = _table({k: str(v) for k, v in names.items()})

    def number(part: Column) -> Column:
        low = table[F.lower(F.regexp_extract(part, NAME_RANGE, 1))]
        high = table[F.lower(F.regexp_extract(part, NAME_RANGE, 2))]
        return F.coalesce(F.concat(low, F.lit("-"), high), table[F.lower(trim_space(part))], part)

    return F.array_join(F.transform(F.split(field, ","), number), ",")


def _part_values(part: Column, low: int, high: int) -> Column:
    """Allowed values of one part, with the kind of mistake if there is one."""
    huge = F.lit(1 << 20)

    def number(text: Column) -> Column:
        return F.coalesce(text.try_cast("int"), huge)

    base, step_text = F.regexp_extract(part, PART, 1), F.regexp_extract(part, PART, 2)
    read = let(base, lambda b: F.struct(
        b.alias("base"), F.when(step_text == "", 1).otherwise(number(step_text)).alias("step"),
        number(F.substring_index(b, "-", 1)).alias("first"), number(F.substring_index(b, "-", -1)).alias("last"),
    ))

    def judged(p: Column) -> Column:
        star, is_range = p["base"] == "*", p["base"].contains("-")
        return (
            F.when(p["base"] == "", "invalid cron field")
            .when(p["step"] < 1, "invalid cron step")
            .when(is_range & ((p["first"] < low) | (p["last"] > high) | (p["first"] > p["last"])), "invalid cron range")
            .when(~star & ~is_range & ((p["first"] < low) | (p["first"] > high)), "cron value out of range")
        )

    def allowed(p: Column, error: Column) -> Column:
        return (
            F.when(error.isNotNull(), F.array().cast("array<int>"))
            .when(p["base"] == "*", F.sequence(F.lit(low), F.lit(high), p["step"]))
            .when(p["base"].contains("-"), F.sequence(p["first"], p["last"], p["step"]))
            .otherwise(F.array(p["first"]))
        )

    return let(read, lambda p: let(
        judged(p), lambda error: F.struct(allowed(p, error).alias("values"), error.alias("error"))
    ))


def _field(text: Column, low: int, high: int) -> Column:
    def merged(parts: Column) -> Column:
        first_error = F.try_element_at(F.filter(parts, lambda p: p["error"].isNotNull()), F.lit(1))["error"]
        values = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: p["values"]))))
        return F.struct(values.alias("values"), F.concat(first_error, F.lit(": "), text).alias("error"))

    return let(F.transform(F.split(text, ","), lambda p: _part_values(p, low, high)), merged)


def parsed_expr(expr: Column) -> Column:
    """An expression as one struct: minute, hour, dom, month and dow as sorted arrays, and error."""

    def parts_of(text: Column) -> Column:
        def part(i: int) -> Column:
            raw = F.coalesce(F.try_element_at(F.split(text, r"\s+"), F.lit(i + 1)), F.lit(""))
            return _named(raw, MONTHS) if i == 3 else _named(raw, WEEKDAYS) if i == 4 else raw

        n = F.size(F.split(text, r"\s+"))
        shape = F.when(n != 5, F.concat(F.lit("cron needs 5 fields, got "), n.cast("string"), F.lit(": "), text))
        fields = F.array(*[_bound_field(part(i), i) for i in range(5)])

        def merged(fs: Column) -> Column:
            dow = F.array_sort(F.array_distinct(F.transform(fs[4]["values"], lambda d: F.pmod(d, F.lit(7)))))
            return F.struct(
                F.coalesce(shape, *[fs[i]["error"] for i in range(5)]).alias("error"),
                *[fs[i]["values"].alias(FIELDS[i][0]) for i in range(4)], dow.alias("dow"),
            )

        return let(fields, merged)

    given = trim_space(expr)
    return let(F.coalesce(_table(SHORTHANDS)[F.lower(given)], given), parts_of)


def _bound_field(text: Column, i: int) -> Column:
    _, low, high = FIELDS[i]
    return let(text, lambda t: _field(t, low, high))


def _parsed(tasks: DataFrame) -> DataFrame:
    """Each distinct expression, parsed once: (_expr, _p).

    The explode of one value keeps Spark from copying the parser into every later mention of its result.
    """
    each = tasks.select(F.col("expr").alias("_expr")).distinct()
    return each.select("_expr", F.explode_outer(F.array(parsed_expr(F.col("_expr")))).alias("_p"))


def parse_schedules(tasks: DataFrame) -> DataFrame:
    """Adds minute, hour, dom, month and dow as sorted arrays and `error`, null for a valid expression.

    Both 0 and 7 mean Sunday and come out as 0. Many tasks share few expressions, so these are parsed and joined.
    """
    found = _parsed(tasks)
    parsed = tasks.join(found, tasks["expr"].eqNullSafe(found["_expr"]), "left")
    valid = F.col("_p.error").isNull()
    return parsed.select(
        *tasks.columns, F.col("_p.error").alias("error"),
        *[F.when(valid, F.col(f"_p.{name}")).alias(name) for name, _, _ in FIELDS],
    )


def day_matches(day: Column, dom: Column, month: Column, dow: Column) -> Column:
    """Whether a schedule allows a date. Where day of month and weekday are both limited, either is enough."""
    dom_ok = F.array_contains(dom, F.dayofmonth(day))
    dow_ok = F.array_contains(dow, (F.dayofweek(day) - 1).cast("int"))
    dom_limited, dow_limited = F.size(dom) < 31, F.size(dow) < 7
    days = (
        F.when(dom_limited & dow_limited, dom_ok | dow_ok)
        .when(dom_limited, dom_ok).when(dow_limited, dow_ok).otherwise(F.lit(True))
    )
    return F.array_contains(month, F.month(day)) & days


def expand_schedule(tasks: DataFrame, start: Column, end: Column) -> DataFrame:
    """Every minute from start up to and including end at which a valid task fires: (repo, id, fire_at).

    Times are found once per distinct expression: days are tested first, and only allowed days get hours and minutes.
    """
    days = F.sequence(start.cast("date"), end.cast("date"))
    at = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("h"), F.col("m"), F.lit(0))
    valid = _parsed(tasks).filter(F.col("_p.error").isNull())
    times = (
        valid.withColumn("day", F.explode(days))
        .filter(day_matches(F.col("day"), F.col("_p.dom"), F.col("_p.month"), F.col("_p.dow")))
        .withColumn("h", F.explode("_p.hour")).withColumn("m", F.explode("_p.minute"))
        .select("_expr", at.alias("fire_at"))
        .filter(F.col("fire_at").between(start, end))
    )
    return tasks.join(times, tasks["expr"] == times["_expr"]).select("repo", "id", "fire_at")


def due_tasks(tasks: DataFrame, now: Column) -> DataFrame:
    """Enabled tasks that fire in this minute and have not run in it."""
    minute = F.date_trunc("minute", now)

    def fires(p: Column) -> Column:
        return (
            p["error"].isNull()
            & F.array_contains(p["minute"], F.minute(now)) & F.array_contains(p["hour"], F.hour(now))
            & day_matches(now.cast("date"), p["dom"], p["month"], p["dow"])
        )

    waiting = tasks.filter(F.col("enabled") & (F.col("last_run").isNull() | (F.col("last_run") < minute)))
    firing = _parsed(tasks).filter(fires(F.col("_p")))
    return waiting.join(firing, waiting["expr"] == firing["_expr"], "left_semi")


def apply_task_changes(tasks: DataFrame, upserts: DataFrame, removals: DataFrame, runs: DataFrame) -> DataFrame:
    """The task table after upserts by id, removals and run outcomes (repo, id, at, status, detail)."""
    key = ["repo", "id"]
    kept = tasks.join(upserts.select(*key), key, "left_anti").unionByName(upserts.select(*tasks.columns))
    kept = kept.join(removals.select(*key), key, "left_anti")
    last = runs.groupBy(*key).agg(
        F.max("at").alias("ran_at"),
        last_by("status", "at", "status").alias("ran_status"),
        F.max_by("detail", F.when(F.col("detail").isNotNull(), F.struct("at", "detail"))).alias("ran_detail"),
    )
    return kept.join(last, key, "left").select(
        *[c for c in tasks.columns if c not in ("last_run", "last_status", "last_detail")],
        F.coalesce("ran_at", "last_run").alias("last_run"),
        F.coalesce("ran_status", "last_status").alias("last_status"),
        F.coalesce("ran_detail", "last_detail").alias("last_detail"),
    )
