"""Spans of pattern matches as DataFrame expressions: code-point offsets, validity tests, and their digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of a span, in an order that sorts by start and then by kind.
SPAN = "struct<start:int,kind:int,end:int,hit:string>"
#: Without the matched text, for tables that are kept.
PLACE = "struct<start:int,kind:int,end:int>"
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, even where body uses it within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, base: Column, op: Callable[[Column, Column], Column]) -> Column:
    """What op makes of base and the elements before each."""
    zero = F.struct(base.alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, n: F.struct(op(acc["at"], n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(values, zero, step, lambda acc: acc["out"])


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def running(values: Column, op: Callable[[Column, Column], Column] = _plus, zero: int = 0) -> Column:
    """The sum of the elements before each element of an array<int>, or what another op makes of them and zero; in blocks, so that long arrays cost little more than their length."""

    def of(whole: Column) -> Column:
        last = ((F.size(whole) - 1) / _BLOCK).cast("int")
        return let(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(whole, b * _BLOCK + 1, _BLOCK)), joined)

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(zero), op))
        return F.flatten(F.zip_with(blocks, _before(totals, F.lit(zero), op), lambda block, at: _before(block, at, op)))

    return let(values, of)


def pieces(text: Column) -> Column:
    """The text in pieces of _BLOCK code points, from which window() reads without counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def window(parts: Column, start: Column, length: Column) -> Column:
    """Up to length (at most _BLOCK) code points from start (from 0) of the text that parts are the pieces of."""
    at = F.floor(start / _BLOCK).cast("int")
    both = F.concat(F.coalesce(F.get(parts, at), F.lit("")), F.coalesce(F.get(parts, at + 1), F.lit("")))
    return F.substring(both, start - at * _BLOCK + 1, length)


def clear_of(found: Column, taken: Column) -> Column:
    """The spans of found that overlap none of taken, by one sweep over both in order of their starts."""
    low = -(1 << 30)
    item = lambda s, role: F.struct(s["start"].alias("start"), F.lit(role).alias("role"), s["end"].alias("end"), s["kind"].alias("kind"), s["hit"].alias("hit"))
    both = F.sort_array(F.concat(F.transform(taken, lambda s: item(s, 0)), F.transform(found, lambda s: item(s, 1))))

    def swept(items: Column) -> Column:
        ends = F.transform(items, lambda x: F.when(x["role"] == 0, x["end"]).otherwise(low))
        starts = F.reverse(F.transform(items, lambda x: F.when(x["role"] == 0, -x["start"]).otherwise(low)))
        sides = F.struct(running(ends, _larger, low).alias("reached"), F.reverse(running(starts, _larger, low)).alias("ahead"))
        return let(sides, lambda side: F.filter(items, lambda x, i: (x["role"] == 1) & (F.get(side["reached"], i) <= x["start"]) & (-F.get(side["ahead"], i) >= x["end"])))

    return F.transform(let(both, swept), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["hit"].alias("hit")))


def find(text: Column, pattern: str, kind: int, *, gate: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of a pattern, as an array of spans; gate: a cheap test that must hold for any match.

    Matches and the gaps between them alternate, so a match starts after the lengths of all gaps and matches before it.
    """
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece)).alias("gaps"),
    )

    def spans(part: Column) -> Column:
        steps = F.zip_with(part["gaps"], part["hits"], lambda gap, hit: gap + F.coalesce(F.length(hit), F.lit(0)))
        return let(running(steps), lambda before: placed(part, before))

    def placed(part: Column, before: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            start = F.get(before, i) + F.get(part["gaps"], i)
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(hit)).alias("end"), hit.alias("hit"))

        return F.transform(part["hits"], one)

    there = F.regexp_like(text, F.lit(pattern))
    return F.when(there if gate is None else gate & there, let(parts, spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def places(spans: Column) -> Column:
    """Spans without their text."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def passes_luhn(hit: Column, low: int, high: int) -> Column:
    """Whether a hit has low to high digits and their Luhn sum is a multiple of ten."""
    number = F.reverse(digits(hit))
    value = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.transform(F.split(number, ""), lambda d, i: value(d.cast("int"), i)), F.lit(0), lambda a, d: a + d)
    return F.when(F.length(number).between(low, high), total % 10 == 0).otherwise(False)


def valid_address(hit: Column) -> Column:
    """Whether every dot-separated number is at most 255."""
    return F.forall(F.split(hit, "\\."), lambda part: F.ltrim(part, F.lit("0")).rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def digest_text(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    name = lambda s: F.get(F.array(*[F.lit(k) for k in kinds]), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
