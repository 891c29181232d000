"""Templated call skeletons and their overlap.

The skeleton of a trace is its calls as canonical JSON in which every value is a
typed placeholder, numbered within its type by first use: two traces have the
same skeleton if one becomes the other by renaming values one to one. Keys, the
shape of nested values and named keys' own values stay. All of it is windows and
string functions over tokens of the canonical text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.jsonx import canonical

_STRING = r'"(?:[^"\\]|\\.)*"'
#: A key with its colon, a value, or punctuation of compact JSON.
_TOKEN = rf'{_STRING}:|{_STRING}|-?[0-9][0-9.eE+-]*|true|false|null|[{{}}\[\],]'


def unordered(arguments: Column, keys: list[str]) -> Column:
    """JSON text of an object in which the arrays under these keys are sorted by their items' texts; other texts as they are."""
    fields = F.try_variant_get(F.try_parse_json(arguments), "$", "map<string,variant>")
    items = lambda v: F.array_sort(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.to_json(x)))
    is_list = lambda k, v: k.isin(keys) & F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))
    text = lambda k, v: F.when(is_list(k, v), F.concat(F.lit("["), F.array_join(items(v), ","), F.lit("]"))).otherwise(F.to_json(v))
    pairs = F.transform(F.map_entries(fields), lambda e: F.concat(F.to_json(F.try_parse_json(F.concat(F.lit('"'), F.replace(F.replace(e["key"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))), F.lit(":"), text(e["key"], e["value"])))
    return F.coalesce(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")), arguments)


def skeletons(calls: DataFrame, case: list[str], *, order: str = "idx", name: str = "tool", arguments: str = "arguments", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per case: ``skeleton`` and its ``digest``.

    Arguments are JSON texts; what does not parse is kept as one string value. Values directly under the keys of
    ``keep`` (wherever these stand) stay as they are. Tool names always stay.
    """
    text = F.coalesce(canonical(F.col(arguments)), F.to_json(F.array(F.col(arguments))).substr(F.lit(2), F.greatest(F.length(F.to_json(F.array(F.col(arguments)))) - 2, F.lit(0))), F.lit("null"))
    tokens = calls.select(*case, F.col(order).alias("_at"), F.col(name).alias("_name"), F.posexplode(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))).alias("_pos", "_token"))
    is_value = ~F.col("_token").rlike(r'^[{}\[\],]$') & ~(F.startswith("_token", F.lit('"')) & F.endswith("_token", F.lit(":")))
    kind = F.when(is_value, F.when(F.startswith("_token", F.lit('"')), "string").when(F.col("_token").isin("true", "false"), "boolean").when(F.col("_token") == "null", "null").otherwise("number"))
    if keep:
        before = F.lag("_token").over(Window.partitionBy(*case, "_at").orderBy("_pos"))
        kind = F.when(F.coalesce(before.isin([f'"{k}":' for k in keep]), F.lit(False)), None).otherwise(kind)
    typed = tokens.withColumn("_kind", kind)
    first = F.min(F.struct("_at", "_pos")).over(Window.partitionBy(*case, "_kind", "_token"))
    number = F.dense_rank().over(Window.partitionBy(*case, "_kind").orderBy("_first")) - 1
    numbered = typed.withColumn("_first", first).withColumn("_number", number)
    shown = F.when(F.col("_kind").isNull(), F.col("_token")).otherwise(F.concat(F.lit("<"), "_kind", F.lit(":"), F.col("_number").cast("string"), F.lit(">")))
    each = numbered.groupBy(*case, "_at").agg(F.first("_name").alias("_name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", shown.alias("t")))), lambda x: x["t"]), "").alias("_call"))
    whole = each.groupBy(*case).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_name", "_call"))), lambda x: F.concat(F.coalesce(x["_name"], F.lit("")), x["_call"])), ";").alias("skeleton"))
    return whole.withColumn("digest", F.sha2(F.col("skeleton").cast("binary"), 256))


def reused(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of ``new`` with ``seen``: whether ``old`` has the skeleton. Digests of the old ones are made distinct first, so a frequent skeleton joins one row."""
    known = old.select("digest").distinct().withColumn("_old", F.lit(True))
    return new.join(known, "digest", "left").withColumn("seen", F.coalesce("_old", F.lit(False))).drop("_old")


def fresh(new: DataFrame, old: DataFrame) -> DataFrame:
    """The traces whose skeleton no old trace has."""
    return new.join(old.select("digest").distinct(), "digest", "left_anti")


def crossing(rows: DataFrame, split: str = "split") -> DataFrame:
    """Skeletons that more than one split has, with the number of splits and traces."""
    return rows.groupBy("digest").agg(F.count_distinct(split).alias("splits"), F.count(F.lit(1)).alias("n")).filter("splits > 1")
