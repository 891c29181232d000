"""URL filters: host and path rules, then a weighted vocabulary by Aho-Corasick.

A rule is ``host/path prefix``; it fits its host and all subdomains if the
path starts with the rule's. The longest rule that fits decides. Where none
fits, an Aho-Corasick automaton counts the terms of the vocabulary that stand
between boundaries (no ASCII letter or digit beside them) in the lower-cased
URL: one strict term, or ``soft_limit`` distinct soft terms, reject it.

Defined results: a null URL or one without ``://`` has an empty host and path
and fits no rule; an empty vocabulary allows what no rule blocks; overlapping
terms all count, a term that occurs again counts once; rows are independent.
Columns other than the two that are named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import LOWER_BYTES, UPPER, map_texts

# fixed values of the contract
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
# fixed values: the production vocabulary
STRICT = ("cialis", "escort", "hentai", "keygen", "malware", "phishing", "porn", "viagra", "warez", "xxx")
SOFT = ("adult", "bet", "bonus", "casino", "cheap", "click", "crack", "farm", "free", "jackpot", "loan", "pills", "poker", "replica", "sex", "spam", "torrent", "win")
SOFT_LIMIT = 2


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton | None:
    a = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):
        for t in terms:
            if t:
                a.add_word(t.lower(), (kind, t.lower()))
    if not len(a):
        return None
    a.make_automaton()
    return a


def _inside(text: str, i: int) -> bool:
    return 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()


def count_terms(url: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """Distinct strict and soft terms between boundaries."""
    found: dict[str, set[str]] = {"strict": set(), "soft": set()}
    a = automaton(strict, soft)
    for end, (kind, term) in a.iter(url) if a is not None else ():
        if not _inside(url, end - len(term)) and not _inside(url, end + 1):
            found[kind].add(term)
    return len(found["strict"]), len(found["soft"])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(whole, pattern, 1)), F.regexp_extract(whole, pattern, 2)


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, prefix = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + prefix)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, n_strict, n_soft."""

    def rows_of(urls: list[bytes]) -> Iterable[tuple]:
        for u in urls:
            yield u.decode("utf-8", "replace"), *count_terms(u.translate(LOWER_BYTES).decode("utf-8", "replace"), strict, soft)

    counted = map_texts(pages, id_col, url_col, [("url", "string"), ("n_strict", "bigint"), ("n_soft", "bigint")], rows_of)
    host, path = host_and_path(F.col("url"))
    own = F.when((F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_limit), "block").otherwise("allow")
    ruled = counted.select(id_col, host.alias("host"), path.alias("path"), "n_strict", "n_soft").withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    return ruled.select(id_col, "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), own).alias("verdict"), "n_strict", "n_soft")
