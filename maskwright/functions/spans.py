"""Match positions as columns: built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "struct<start:int,m:string,pre:string,val:string>"


def find_matches(text: Column, pattern: str, grouped: bool = False, gate: str | None = None) -> Column:
    """array<MATCH> of all matches in order; ``pre`` and ``val`` are groups 1 and 2 of a grouped pattern, else '' and the match.

    The pieces between matches are one more than the matches, so running sums of both lengths give each start (code
    points, from 0). Matches must not be empty. ``gate`` is a cheaper pattern found in every text with a match.
    """
    none = F.array().cast(f"array<{MATCH}>")

    def located(x: Column) -> Column:
        gaps = x["gaps"]
        before = running_sums(F.zip_with(x["m"], gaps, lambda m, g: F.length(m) + g))
        rows = F.arrays_zip(x["m"].alias("m"), x["pre"].alias("pre"), x["val"].alias("val"), gaps.alias("gap"), before.alias("at"))
        return F.transform(rows, lambda r: F.struct((r["at"] + r["gap"]).alias("start"), r["m"].alias("m"), r["pre"].alias("pre"), r["val"].alias("val")))

    def lengths(m: Column) -> Column:
        pre = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if grouped else F.transform(m, lambda x: F.lit(""))
        val = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if grouped else m
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(m))
        return let(F.struct(m.alias("m"), pre.alias("pre"), val.alias("val"), gaps.alias("gaps")), located)

    return F.when(text.rlike(gate or pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lengths)).otherwise(none)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body and the lambdas in it name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _short_sums(values: Column) -> Column:
    """Sums of what precedes each element; every step copies the sums so far."""

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["s"] + x).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out"))

    return F.aggregate(values, F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])


def running_sums(values: Column) -> Column:
    """Sums of the integers that precede each element: in about sqrt(n) blocks of as many, so that copies stay few."""

    def blocked(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda b: F.slice(v, b * width + 1, width))

    def summed(blocks: Column) -> Column:
        offsets = _short_sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x)))
        return F.flatten(F.zip_with(F.transform(blocks, _short_sums), offsets, lambda sums, o: F.transform(sums, lambda s: s + o)))

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocked(v), summed)).otherwise(F.array().cast("array<int>")))


def is_ipv4(s: Column) -> Column:
    from maskwright.functions.patterns import VALID_IPV4

    return s.rlike(VALID_IPV4)


def is_private_ipv4(s: Column) -> Column:
    from maskwright.functions.patterns import PRIVATE_IPV4

    return s.rlike(PRIVATE_IPV4)


def is_ipv6(s: Column) -> Column:
    """Eight groups, or at most seven around one ``::``."""
    from maskwright.functions.patterns import IPV6_FULL, IPV6_SHORT

    groups = F.size(F.filter(F.split(s, ":", -1), lambda g: g != ""))
    return s.rlike(IPV6_FULL) | (s.rlike(IPV6_SHORT) & (groups <= 7))
