"""Maximum matching of call specs with calls (E10, D4, F8), for groups of any size.

A spec and a call can only match if their names agree, so every (case, name) is
a matching of its own. Where all of its specs want exact arguments, the largest
matching is the intersection of two multisets, which is counted by key. Other
groups go to tasks: an inverted index over paths and values gives each spec the
set of calls that it fits as a bit set, and Hopcroft-Karp augments along all
shortest paths of a layered graph at once, layer by layer of bit sets.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.jsonx import canonical


def frozen(value: Any) -> Hashable:
    """A key that is equal for strictly equal JSON values: booleans are no numbers, 1 is 1.0."""
    if isinstance(value, dict):
        return "o", frozenset((k, frozen(v)) for k, v in value.items())
    if isinstance(value, list):
        return "l", tuple(map(frozen, value))
    return ("b" if isinstance(value, bool) else "s" if isinstance(value, str) else "z" if value is None else "n"), value


def features(value: Any, path: tuple = ()) -> Iterator[tuple]:
    """What a value has as far as subsets are concerned: that there is an object at a path, and each other value at its path."""
    if isinstance(value, dict):
        yield path, "object"
        for k, v in value.items():
            yield from features(v, (*path, k))
    else:
        yield path, frozen(value)


def fits(specs: list[tuple[bool, Any]], calls: list[Any]) -> list[int]:
    """Of each spec (exact or subset, arguments) the calls that it fits, as a bit set."""
    having: dict[tuple, int] = defaultdict(int)
    same: dict[Hashable, int] = defaultdict(int)
    by_key = [(frozen(c), set(features(c))) for c in calls]
    places: dict[tuple, list[int]] = defaultdict(list)
    alike: dict[Hashable, list[int]] = defaultdict(list)
    for j, (key, own) in enumerate(by_key):
        alike[key].append(j)
        for f in own:
            places[f].append(j)
    for table, out in ((places, having), (alike, same)):
        for k, found in table.items():
            mask = bytearray(len(calls) // 8 + 1)
            for j in found:
                mask[j >> 3] |= 1 << (j & 7)
            out[k] = int.from_bytes(mask, "little")
    every, out = (1 << len(calls)) - 1, []
    for exact, wanted in specs:
        mask = same.get(frozen(wanted), 0) if exact else every
        for f in () if exact else features(wanted):
            mask &= having.get(f, 0)
        out.append(mask)
    return out


def _bits(mask: int) -> Iterator[int]:
    """Places of the set bits, by bytes, so that a long mask is read once."""
    for at, byte in enumerate(mask.to_bytes((mask.bit_length() + 7) // 8, "little")):
        while byte:
            low = byte & -byte
            yield 8 * at + low.bit_length() - 1
            byte ^= low


def maximum(options: list[int], n_calls: int) -> int:
    """The size of the largest matching; options[i] is the bit set of the calls that spec i fits."""
    of_call: list[int] = [-1] * n_calls
    free, waiting = (1 << n_calls) - 1, []
    for i, own in enumerate(options):  # what can be matched at once
        hit = own & free
        if hit:
            low = hit & -hit
            of_call[low.bit_length() - 1] = i
            free ^= low
        elif own:
            waiting.append(i)
    while waiting:
        layers, seen, front = [], 0, waiting
        while front:  # calls by their distance from an unmatched spec
            layer = 0
            for i in front:
                layer |= options[i]
            layer &= ~seen
            if not layer:
                return n_calls - free.bit_count()
            if layer & free:
                layers.append(layer & free)
                break
            layers.append(layer)
            seen |= layer
            front = [of_call[j] for j in _bits(layer)]
        else:
            return n_calls - free.bit_count()
        left = []
        for start in waiting:  # disjoint shortest paths: a call is used once in a phase
            path: list[int] = []
            specs = [start]
            while specs:
                hit = options[specs[-1]] & layers[len(path)]
                if not hit:
                    specs.pop()
                    if path:
                        path.pop()
                    continue
                low = hit & -hit
                layers[len(path)] ^= low
                path.append(low.bit_length() - 1)
                if len(path) == len(layers):
                    break
                specs.append(of_call[path[-1]])
            if path:
                for i, j in zip(specs, path, strict=True):
                    of_call[j] = i
                free ^= 1 << path[-1]
            else:
                left.append(start)
        waiting = left
    return n_calls - free.bit_count()


def most_matches(specs: list[tuple[bool, Any]], calls: list[Any]) -> int:
    return maximum(fits(specs, calls), len(calls)) if specs and calls else 0


def matched(specs: DataFrame, calls: DataFrame, case: str = "case_id") -> DataFrame:
    """Per case: specs, matches, accuracy. specs: case, name, exact, arguments; calls: case, name, arguments (JSON texts; null counts as {}).

    A spec without a name matches nothing. What does not parse is a string value. Cases without specs have no row.
    """
    kind = specs.schema[case].dataType.simpleString()
    text = F.coalesce(F.col("arguments"), F.lit("{}")).alias("arguments")
    wanted = specs.select(F.col(case).alias("_case"), "name", F.lit(0).alias("kind"), F.coalesce("exact", F.lit(False)).alias("exact"), text)
    made = calls.select(F.col(case).alias("_case"), "name", F.lit(1).alias("kind"), F.lit(None).cast("boolean").alias("exact"), text)
    # one shuffle and one sort for both ways: by a hash of the keys, as for the keys themselves Spark may leave the shuffle out and count on both halves being dealt alike
    dealt = wanted.unionByName(made).filter("_case IS NOT NULL AND name IS NOT NULL").withColumn("_at", F.xxhash64("_case", "name")).repartition("_at")
    groups = dealt.withColumn("all_exact", F.bool_and("exact").over(Window.partitionBy("_at", "_case", "name")))
    key = F.coalesce(canonical(F.col("arguments")), F.to_json(F.array("arguments"))).alias("key")
    alike = groups.filter("all_exact").select("_at", "_case", "name", "kind", key).groupBy("_at", "_case", "name", "key").agg(F.count_if(F.col("kind") == 0).alias("s"), F.count_if(F.col("kind") == 1).alias("c"))
    none, of = F.lit(0).cast("bigint").alias("specs"), ("_case", "specs", "m")
    exact = alike.select("_case", none, F.least("s", "c").alias("m"))
    rest = groups.filter("NOT all_exact").sortWithinPartitions("_at", "_case", "name").select("_case", "name", "kind", "exact", "arguments").mapInArrow(_streamed, f"_case {kind}, m bigint").select("_case", none, "m")
    each = wanted.select("_case", F.lit(1).cast("bigint").alias("specs"), F.lit(0).cast("bigint").alias("m"))
    found = each.unionByName(exact.select(*of)).unionByName(rest.select(*of)).groupBy("_case").agg(F.sum("specs").alias("specs"), F.sum("m").alias("matches"))
    return found.select(F.col("_case").alias(case), "specs", "matches", (F.col("matches") / F.col("specs")).alias("accuracy"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of each (case, name) of a sorted partition; one group is held at a time, however small the groups are."""
    now: tuple | None = None
    specs: list = []
    made: list = []
    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        cases, sizes = [], []
        for of, name, which, exact, arguments in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (of, name) != now:
                if specs and made:
                    cases.append(now[0])
                    sizes.append(most_matches(specs, made))
                now, specs, made = (of, name), [], []
            if which:
                made.append(_loads(arguments))
            else:
                specs.append((exact, _loads(arguments)))
        yield pa.RecordBatch.from_arrays([pa.array(cases, kind), pa.array(sizes, pa.int64())], names=["_case", "m"])
    if specs and made:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([most_matches(specs, made)], pa.int64())], names=["_case", "m"])


def _loads(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return text
