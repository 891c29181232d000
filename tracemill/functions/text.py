"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tool_calls(text: Column) -> Column:
    """All ``<tool_call>`` bodies as structs (raw, valid, call): call is the JSON text, null where it is no JSON."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)(?U:<tool_call>\s*)(.*?)(?U:\s*</tool_call>)"), F.lit(1))
    return F.transform(bodies, lambda b: F.struct(b.alias("raw"), F.try_parse_json(b).isNotNull().alias("valid"), F.when(F.try_parse_json(b).isNotNull(), b).alias("call")))


def has_call_marker(text: Column) -> Column:
    """An opening or closing marker, in any case, even where nothing parses."""
    return F.coalesce(text.rlike(r"(?iU)</?tool_call(?=\s|>|$)"), F.lit(False))


def folded(text: Column) -> Column:
    """Lower case, with the one common letter that folds to two."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def answer_matches(text: Column, *, required: bool = False, contains_all: list[str] = (), contains_any: list[str] = (), regex_any: list[str] = (), forbidden_any: list[str] = (), regex_none: list[str] = ()) -> Column:
    """D6 with constant rules: every rule that is given must hold; patterns ignore case and know Unicode classes."""
    present = F.coalesce(F.trim(text) != "", F.lit(False))
    own, plain = folded(F.coalesce(text, F.lit(""))), F.coalesce(text, F.lit(""))
    has = lambda needles: [F.contains(own, folded(F.lit(n))) for n in needles]
    like = lambda patterns: [plain.rlike(f"(?iU){p}") for p in patterns]
    any_of = lambda checks: F.array_contains(F.array(*checks), True) if checks else F.lit(False)
    rules = [F.lit(True)]
    if required or contains_all or contains_any or regex_any:
        rules.append(present)
    rules += has(contains_all)
    if contains_any:
        rules.append(any_of(has(contains_any)))
    if regex_any:
        rules.append(any_of(like(regex_any)))
    rules += [~any_of(has(forbidden_any)), ~any_of(like(regex_none))]
    return ~F.array_contains(F.array(*rules), False)


# fixed values: words without weight in a search
STOP_WORDS = ("一个", "一下", "什么", "是否", "当前", "帮我", "怎么", "怎样", "版本", "问题", "请问", "这个")


def search_terms(query: Column) -> Column:
    """Latin words, dotted versions and CJK runs; runs of over four characters as all their 2-, 3- and 4-grams; stop words and lone integers are dropped."""
    low = F.lower(query)
    latin = F.regexp_extract_all(low, F.lit(r"([a-z]+|[0-9]+(?:\.[0-9]+)+)"), F.lit(1))
    runs = F.filter(F.regexp_extract_all(low, F.lit(r"([\x{4e00}-\x{9fff}]+)"), F.lit(1)), lambda r: ~r.isin(*STOP_WORDS))
    grams = lambda r: F.flatten(F.transform(F.array(F.lit(2), F.lit(3), F.lit(4)), lambda n: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, n))))
    cjk = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) > 4, grams(r)).otherwise(F.array(r))))
    return F.array_distinct(F.filter(F.concat(latin, cjk), lambda t: ~t.isin(*STOP_WORDS)))


def search_score(text: Column, terms: Column) -> Column:
    """H1: the sum of max(1, length - 1) over the terms that the text contains."""
    return F.aggregate(terms, F.lit(0), lambda n, t: n + F.when(F.contains(F.lower(text), t), F.greatest(F.lit(1), F.length(t) - 1)).otherwise(0))


def without_end_marks(text: Column, mark: str) -> Column:
    """The text without end-of-sequence marks and white space at its end."""
    import re

    return F.regexp_replace(text, rf"(?U)(?:\s*{re.escape(mark)})+\s*$", "")


def clauses(text: Column) -> Column:
    """The clauses between full stops, line feeds and semicolons, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "[。\n；;]"), lambda c: F.trim(c)), lambda c: c != "")


def rendered(entries: Column, style: str) -> Column:
    """Evidence (array of structs of the texts tool_call and result, canonical JSON) as JSON, numbered records or a table."""
    if style == "json":
        return F.concat(F.lit("["), F.array_join(F.transform(entries, lambda e: F.format_string('{"result":%s,"tool_call":%s}', e["result"], e["tool_call"])), ","), F.lit("]"))
    # fixed values: the layouts' words
    pattern, head = ("记录%d 输入：%s\n返回：%s", "") if style == "records" else ("%d | %s | %s", "序号 | 工具输入JSON | 实际返回JSON\n")
    return F.concat(F.lit(head), F.array_join(F.transform(entries, lambda e, i: F.format_string(pattern, i + 1, e["tool_call"], e["result"])), "\n"))
