"""Confidence of a document from its type, status and date, and times named in queries."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import Confidence

#: What a chunk without the key counts as.
MISSING_TYPE, MISSING_STATUS = "technical", "active"
#: Factors for the same day, month and year; otherwise less by YEAR_STEP a year down to LEAST_MATCH.
SAME_DAY, SAME_MONTH, SAME_YEAR, YEAR_STEP, LEAST_MATCH = 2.0, 1.8, 1.5, 0.3, 0.2
#: Times in a query, as dashed numbers or Chinese dates; or a year before 年.
TIME = r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2}))?|年(\d{1,2})(?:月(\d{1,2})日)?)"
YEAR = r"(\d{4})年(?!\d)"


@dataclass(frozen=True)
class QueryTime:
    year: int
    month: int | None = None
    day: int | None = None


def query_time(query: str | None) -> QueryTime | None:
    """The first time a query names; numbers are not checked for range, a bare year is none."""
    if m := re.search(TIME, query or ""):
        year, month, day, month_zh, day_zh = m.groups()
        number = lambda *x: next((int(v) for v in x if v), None)
        return QueryTime(int(year), number(month, month_zh), number(day, day_zh))
    m = re.search(YEAR, query or "")
    return QueryTime(int(m.group(1))) if m else None


def query_time_columns(query: Column) -> list[Column]:
    """The same for a column of queries: year, month, day."""
    part = lambda k: F.nullif(F.regexp_extract(query, f"(?U){TIME}", k), F.lit("")).cast("int")
    alone = F.nullif(F.regexp_extract(query, f"(?U){YEAR}", 1), F.lit("")).cast("int")
    return [F.coalesce(part(1), alone).alias("year"), F.coalesce(part(2), part(4)).alias("month"), F.coalesce(part(3), part(5)).alias("day")]


def date_of(text: Column) -> Column:
    """A date written year-month-day, leading zeros or not; null for anything else."""
    good = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    return F.when(good, F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date"))


def time_match(date: Column, time: QueryTime) -> Column:
    """How well a document's date fits a query's time; 1 for an unreadable date."""
    d = date_of(date)
    lit = lambda x: F.lit(x).cast("int")
    same_year = F.year(d) == lit(time.year)
    same_month = same_year & F.coalesce(F.month(d) == lit(time.month), F.lit(False))
    same_day = same_month & F.coalesce(F.dayofmonth(d) == lit(time.day), F.lit(False))
    gap = F.greatest(F.lit(LEAST_MATCH), F.lit(1.0) - F.lit(YEAR_STEP) * F.abs(F.year(d) - lit(time.year)))
    return F.when(d.isNull(), F.lit(1.0)).when(same_day, SAME_DAY).when(same_month, SAME_MONTH).when(same_year, SAME_YEAR).otherwise(gap)


def _weight(rules, key: Column) -> Column:
    if not rules:
        return F.lit(1.0)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in rules.items() for x in (k, float(v)))), key), F.lit(1.0))


def _field(parsed: Column, name: str, missing: str | None) -> Column:
    """A string field of a JSON object: ``missing`` if the key is absent, null if its value is null."""
    there = F.array_contains(F.coalesce(F.json_object_keys(parsed), F.array().cast("array<string>")), name)
    return F.when(there, F.get_json_object(parsed, f"$.{name}")).otherwise(F.lit(missing))


def confidence(json: Column, rules: Confidence, as_of: dt.date, time: QueryTime | None = None) -> list[Column]:
    """(confidence_score, confidence_reason) of a chunk's JSON at the date ``as_of``.

    Broken or empty JSON counts as an object without keys. The score is log1p of the product of three weights: of
    the type and of the status, 1 where no rule names them, and of the date: 1 without a date, the time match if
    the query names a time, else a decay by half-lives that never falls below the least weight and is the least
    weight for a date that can't be read. Dates to come weigh more than 1.
    """
    parsed = F.when(F.try_parse_json(json).isNotNull() & json.rlike(r"^\s*\{"), json).otherwise(F.lit("{}"))
    kind, status = _field(parsed, "doc_type", MISSING_TYPE), _field(parsed, "status", MISSING_STATUS)
    date = F.nullif(_field(parsed, "final_date", None), F.lit(""))
    decay = rules.date_decay
    half = F.lit(float(decay.half_life_days))
    if decay.type_specific_decay:
        lives = F.create_map(*(F.lit(x) for k, v in decay.type_specific_decay.items() for x in (k, float(v))))
        half = F.coalesce(F.try_element_at(lives, kind), half)
    days = F.datediff(F.lit(as_of), date_of(date))
    least = F.lit(float(decay.min_weight))
    aged = F.coalesce(F.greatest(least, F.pow(F.lit(0.5), F.try_divide(days.cast("double"), half))), least)
    dated = time_match(date, time) if time else aged
    date_weight = F.when(date.isNull(), F.lit(1.0)).otherwise(dated)
    type_weight, status_weight = _weight(rules.doc_type_rules, kind), _weight(rules.status_rules, status)
    age = F.when(date.isNotNull() & F.lit(time is not None), F.lit("TimeMatch")).otherwise(F.concat(F.lit("Age:"), F.coalesce(days, F.lit(365)).cast("string"), F.lit("d")))
    reason = F.concat(
        F.lit("Type:"), F.coalesce(kind, F.lit("None")), F.lit("("), type_weight.cast("string"), F.lit(") | Status:"), F.coalesce(status, F.lit("None")), F.lit("("), status_weight.cast("string"), F.lit(") | "), age
    )
    return [F.log1p(type_weight * status_weight * date_weight).alias("confidence_score"), reason.alias("confidence_reason")]
