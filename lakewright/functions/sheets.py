"""Spreadsheet functions as expressions: criteria, rounding, numbers in text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), for which the value is found once a row, however often f names it, in lambdas too."""
    return F.transform(F.array(value), f)[0]


def criterion(cell: Column, rule: str) -> Column:
    """A criterion such as '>=10', '<>x' or 'Br*d?': numbers compare as numbers, * and ? match any case, other text exactly."""
    op, value = re.match(r"(>=|<=|<>|>|<|=)?(.*)", rule, re.S).groups()
    op = op or "="
    try:
        number = float(value)
    except ValueError:
        number = None
    if number is not None:
        left = F.expr("NULL") if cell is None else cell.try_cast("double")
        hit = {">=": left >= number, "<=": left <= number, "<>": left != number, ">": left > number, "<": left < number, "=": left == number}[op]
        return F.coalesce(hit, F.lit(op == "<>"))
    text = cell.cast("string")
    if op in ("=", "<>") and re.search(r"[*?]", value):
        pattern = "(?is)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in value) + "$"
        hit = text.rlike(pattern)
    else:
        hit = {">=": text >= value, "<=": text <= value, ">": text > value, "<": text < value}.get(op, text == value)
    hit = F.coalesce(hit, F.lit(False))
    return ~hit if op == "<>" else hit


def criteria(pairs: list[tuple[Column, str]]) -> Column:
    out = F.lit(True)
    for cell, rule in pairs:
        out = out & criterion(cell, rule)
    return out


def sumifs(target: Column, pairs: list[tuple[Column, str]]) -> Column:
    return F.coalesce(F.sum(F.when(criteria(pairs), target)), F.lit(0.0))


def averageifs(target: Column, pairs: list[tuple[Column, str]]) -> Column:
    return F.avg(F.when(criteria(pairs), target))


def countifs(pairs: list[tuple[Column, str]]) -> Column:
    return F.count_if(criteria(pairs))


def sheet_round(x: Column, digits: int = 0) -> Column:
    """Half goes toward plus infinity."""
    return F.floor(x * 10**digits + 0.5).cast("double") / 10**digits


def number_in(text: Column) -> Column:
    """Thousands commas and a final percent sign go; the value isn't divided."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), ",", ""), "%$", "").try_cast("double")


def nice_max(x: Column) -> Column:
    """The next whole number up to 5, beyond that the next 1, 2, 5 or 10 times a power of ten; 1 for what isn't above zero or finite."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    ratio = x / power
    large = power * F.when(ratio <= 1, 1.0).when(ratio <= 2, 2.0).when(ratio <= 5, 5.0).otherwise(10.0)
    return F.when(x.isNull() | F.isnan(x) | (x <= 0) | (x == float("inf")), 1.0).when(x <= 5, F.ceil(x).cast("double")).otherwise(large)


def tick_unit(step: Column) -> Column:
    """The least of 1, 2, 5 and 10 times a power of ten that is not below step; 1 if step is not above 0."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(step)))
    part = step / base
    return F.when(step > 0, base * F.when(part <= 1, 1).when(part <= 2, 2).when(part <= 5, 5).otherwise(10)).otherwise(1.0)


def axis_ticks(low: Column, high: Column, unit: Column) -> Column:
    """low if it is no multiple of unit, eight multiples at most up to high, high if it is none; the first seven of these. Null unit: a round one for four steps."""
    none = F.array().cast("array<double>")

    def from_first(a: Column) -> Column:
        low, high, u, first = a["low"], a["high"], a["u"], a["first"]
        near = u * 0.001
        own = F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: first + i * u), lambda x: x <= high + near)

        def ended(own: Column) -> Column:
            end = F.coalesce(F.try_element_at(own, F.lit(-1)), low)
            return F.concat(F.when(F.abs(first - low) > near, F.array(low)).otherwise(none), own, F.when(F.abs(end - high) > near, F.array(high)).otherwise(none))

        return once(own, ended)

    def from_unit(a: Column) -> Column:
        first = F.ceil(a["low"] / a["u"]) * a["u"]
        return once(F.struct(a["low"].alias("low"), a["high"].alias("high"), a["u"].alias("u"), first.alias("first")), from_first)

    def from_ends(a: Column) -> Column:
        return once(F.greatest(a["high"] - a["low"], F.lit(1e-9)) / 4, lambda step: once(F.struct(a["low"].alias("low"), a["high"].alias("high"), F.when(a["unit"] > 0, a["unit"]).otherwise(tick_unit(step)).alias("u")), from_unit))

    ticks = once(F.struct(low.alias("low"), high.alias("high"), unit.alias("unit")), from_ends)
    return F.transform(F.slice(ticks, 1, 7), lambda x: F.round(x, 6) + 0)
