"""Match positions with DataFrame functions only.

Spark extracts all matches of a pattern but not where they are. The pieces
between matches come from a split by the same pattern, so positions are sums of
lengths. Sums and running maxima are taken in blocks, spans are looked up by
bisection and texts are cut from pieces of fixed length, so that a text with
very many spans costs about as much per span as one with few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"
_BLOCK = 64
#: Code points of a piece of text.
_PIECE = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(size: Column) -> Column:
    """The numbers of the blocks of so many items (one at least)."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(size / _BLOCK) - 1, F.lit(0)).cast("int"))


def _block(items: Column, b: Column) -> Column:
    return F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK))


def positions(text: Column, pattern: str, found: Column) -> Column:
    """(start, end, text) in code points of the matches ``found`` = regexp_extract_all(text, pattern, 0)."""
    pair = lambda m, p: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("text"))

    def block(items: Column, offset: Column) -> Column:
        start = lambda acc, x: acc["at"] + x["gap"]
        end = lambda acc, x: start(acc, x) + x["size"]
        one = lambda acc, x: F.array(F.struct(start(acc, x).alias("start"), end(acc, x).alias("end"), x["text"].alias("text")))
        step = lambda acc, x: F.struct(end(acc, x).alias("at"), F.concat(acc["out"], one(acc, x)).alias("out"))
        return F.aggregate(items, F.struct(offset.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

    def whole(pairs: Column) -> Column:
        size = lambda b: F.aggregate(_block(pairs, b), F.lit(0), lambda n, x: n + x["gap"] + x["size"])
        before = lambda sizes, b: F.aggregate(F.slice(sizes, F.lit(1), b), F.lit(0), lambda n, x: n + x)
        return let(F.transform(_blocks(F.size(pairs)), size), lambda sizes: F.flatten(F.transform(_blocks(F.size(pairs)), lambda b: block(_block(pairs, b), before(sizes, b)))))

    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    return F.when(F.size(found) > 0, let(F.zip_with(found, pieces, pair), whole)).otherwise(F.array().cast(SPAN))


def running_max(values: Column) -> Column:
    """Of each place the largest value up to it."""
    own = lambda b: F.array_max(_block(values, b))
    upto = lambda tops, b: F.coalesce(F.array_max(F.slice(tops, F.lit(1), b)), F.lit(-1))
    inner = lambda tops, b: let(F.struct(_block(values, b).alias("v"), upto(tops, b).alias("t")), lambda s: F.transform(s["v"], lambda _, i: F.greatest(s["t"], F.array_max(F.slice(s["v"], F.lit(1), i + 1)))))
    whole = let(F.transform(_blocks(F.size(values)), own), lambda tops: F.flatten(F.transform(_blocks(F.size(values)), lambda b: inner(tops, b))))
    return F.when(F.size(values) > 0, whole).otherwise(F.array().cast("array<int>"))


def _below(values: Column, limit: Column) -> Column:
    """How many of the values, which ascend, are less than the limit (bisection)."""
    middle = lambda acc: ((acc["low"] + acc["high"]) / 2).cast("int")
    less = lambda acc: F.get(values, middle(acc)) < limit
    step = lambda acc, _: F.when(acc["low"] >= acc["high"], acc).otherwise(F.struct(F.when(less(acc), middle(acc) + 1).otherwise(acc["low"]).alias("low"), F.when(less(acc), acc["high"]).otherwise(middle(acc)).alias("high")))
    turns = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    return F.aggregate(turns, F.struct(F.lit(0).alias("low"), F.size(values).alias("high")), step, lambda acc: acc["low"])


def pieces(text: Column) -> Column:
    """The text in pieces of equal length, from which any part is cut without going through what stands before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def part(cut: Column, start: Column, end: Column) -> Column:
    """The text from code point start to end (exclusive), from its pieces."""
    first = F.floor(start / _PIECE).cast("int")
    held = F.array_join(F.slice(cut, first + 1, F.greatest(F.floor((end - 1) / _PIECE).cast("int") - first + 1, F.lit(0))), "")
    return F.when(end > start, F.substring(held, start - first * _PIECE + 1, end - start)).otherwise("")


def all_matches(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """regexp_extract_all of the whole pattern, empty at once where the cheap ``gate`` is false."""
    out = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return out if gate is None else F.when(gate, out).otherwise(F.array().cast("array<string>"))


def tagged(spans: Column, order: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["text"].alias("text")))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then by the kinds' order, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["order"].alias("o"), s["end"].alias("b"), s["kind"].alias("k"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["k"], s["a"].cast("string"), s["b"].cast("string"))), ",")


def apart(spans: Column, taken: Column) -> Column:
    """The spans that overlap none of ``taken``: of those that start before a span ends, none ends behind its start."""

    def free(t: Column) -> Column:
        ends = lambda s: F.coalesce(F.get(t["upto"], _below(t["starts"], s["end"]) - 1), F.lit(-1))
        return F.filter(spans, lambda s: ends(s) <= s["start"])

    ordered = F.array_sort(F.transform(taken, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))))
    table = let(ordered, lambda t: F.struct(F.transform(t, lambda x: x["start"]).alias("starts"), running_max(F.transform(t, lambda x: x["end"])).alias("upto")))
    return F.when((F.size(taken) == 0) | (F.size(spans) == 0), spans).otherwise(let(table, free))


def replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """The text with each span replaced; of overlapping spans the first (by start, then end) counts."""

    def whole(w: Column) -> Column:
        at = lambda i: F.coalesce(F.get(w["upto"], i - 1), F.lit(0))  # noqa: E731 - where the spans before this one end
        placed = F.transform(w["spans"], lambda s, i: F.struct(at(i).alias("at"), s.alias("s")))
        kept = F.filter(placed, lambda p: p["at"] <= p["s"]["start"])
        out = F.transform(kept, lambda p: F.concat(part(w["cut"], p["at"], p["s"]["start"]), by(p["s"])))
        return F.concat(F.array_join(out, ""), part(w["cut"], F.element_at(w["upto"], -1), F.length(text)))

    ordered = F.array_sort(spans)
    table = let(ordered, lambda o: F.struct(o.alias("spans"), running_max(F.transform(o, lambda s: s["end"])).alias("upto"), pieces(text).alias("cut")))
    return F.when(F.size(spans) > 0, let(table, whole)).otherwise(text)
