"""Scores and levels, as column expressions over feature columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, places: int) -> Column:
    """floor(x * 10^p + 0.5) / 10^p: halves go up, negative ones too."""
    k = 10.0**places
    return F.floor(x * k + 0.5) / k


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def level(score: Column, *steps: tuple[float, str], top: str) -> Column:
    """The label of the first step that the score does not exceed, else `top`."""
    out = None
    for most, label in steps:
        out = F.when(score <= most, label) if out is None else out.when(score <= most, label)
    return out.otherwise(top)


def tier(count: Column, *steps: tuple[float, str], low: str) -> Column:
    """The label of the first (highest) step that the count exceeds, else `low`."""
    out = None
    for more, label in steps:
        out = F.when(count > more, label) if out is None else out.when(count > more, label)
    return out.otherwise(low)


def interface_score(direct: Column, inherited: Column, frameworks: Column) -> Column:
    """direct + inherited / 2 + 1.5 frameworks, half as much again above ten in all, to two places."""
    raw = direct * 1.0 + inherited * 0.5 + frameworks * 1.5
    return round_half_up(raw * F.when(direct + inherited > 10, 1.5).otherwise(1.0), 2)


def type_score(primitive, reference, collection, framework, generic, categories, unique) -> Column:
    raw = primitive * 1.0 + reference * 2.0 + collection * 3.0 + framework * 2.5 + generic * 4.0 + categories * 1.5
    return F.when(unique == 0, 0.0).otherwise(round_half_up(raw / F.sqrt(unique), 2))


def type_level(score: Column) -> Column:
    return tier(score, (10, "HIGH"), (5, "MEDIUM"), low="LOW")


def state_score(fields: Column, cross: Column) -> Column:
    return fields * 2 + cross * 3


def state_level(score: Column) -> Column:
    return level(score, (8, "LOW"), (16, "MEDIUM"), (24, "HIGH"), top="CRITICAL")


def quality_score(reply: Column) -> Column:
    """The first number of a reply: above 10 and up to 100 it is a percentage; 1 to 10, one place, 5.0 without one."""
    n = F.regexp_extract(reply, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    n = F.when((n > 10) & (n <= 100), n / 10).otherwise(n)
    return F.when(n.isNull(), 5.0).otherwise(round_half_up(F.greatest(F.lit(1.0), F.least(F.lit(10.0), n)), 1))


def reply_label(reply: Column, labels: tuple[str, ...]) -> Column:
    """The first of the labels that a free reply names as a word, in any case; null if none."""
    return F.nullif(F.regexp_extract(F.upper(reply), r"\b(" + "|".join(labels) + r")\b", 1), F.lit(""))
