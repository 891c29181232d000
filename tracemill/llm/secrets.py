"""Secrets: fixed shapes, and character Markov models of random strings and identifiers, with DataFrame functions only.

Three shapes (assign, access, hex) give the base spans. Other tokens of at
least 16 characters (the length of the shortest base shape) are scored by two
first-order Markov models over characters, one of random strings and one of
ordinary identifiers; a token whose log-likelihood ratio is at least
``min_ratio`` is added as kind ``random`` unless it overlaps a base span. The
models are trained from labelled samples: random strings made from digests, and
identifiers made of the words of ``sample_docs`` documents (the bound of the
sample; those with the least hash of their id) and a fixed list of names and of
rules (lines of one repeated character). A fifth of the sampled identifiers is
kept out of the training and calibrates ``min_ratio`` where none is named: it is
the ratio that one of them in a thousand exceeds, but at least ``PRIOR``. Every
such token is scored, with or without digits.

Defined results: a null text counts as empty and has no spans; overlapping base
spans of different kinds all stay; rows are independent but for the models, so
equal texts give equal spans; an empty table gives no rows. Columns other than
the two that are named are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import checkpointed, id_and_text
from tracemill.llm.spans import all_matches, apart, joined, positions, tagged

KINDS = ("assign", "access", "hex")
SAMPLE_DOCS, RANDOM_STRINGS = 2000, 600
#: The least ratio at any rate: the logarithm of 160,000 ordinary tokens to one random string.
PRIOR = 12.0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
SIZE = len(ALPHABET) + 1

ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}+"
# fixed values: identifiers as programs and settings have them
IDENTIFIERS = ("get_user_account_by_id", "maximum_retry_interval_seconds_2", "application-config-v2-production", "HttpServletRequestWrapper3", "create_table_if_not_exists_v1", "test_case_number_0123_should_pass", "invoice-2024-01-15-customer-summary", "DatabaseConnectionPoolManager2", "release_candidate_2023_10_final", "image-thumbnail-640x480-preview", "very_long_variable_name_number_42", "src/main/java/com/example/service", "user-profile-picture-large-2x", "content/uploads/2023/09/report-final")

RULES = tuple(c * 40 for c in ALPHABET)


def transitions(samples: DataFrame) -> DataFrame:
    """(label, a, b, n): counted pairs of neighbouring characters of the column token; a and b are alphabet places, 0 the rest."""
    pairs = samples.filter(F.length("token") >= 2).select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))).alias("pair"))
    # the alphabets' square bounds the rows, so they are counted before anything else is done with them
    return pairs.groupBy("label", "pair").count()


def samples(docs: DataFrame, *, id_col: str, text_col: str, sample_docs: int, random_strings: int) -> DataFrame:
    """Labelled tokens: 1 random, 0 ordinary."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")).cast("binary"), 256)
    letters = F.translate(F.base64(F.unhex(digest)), "+/=", "xYz")
    made = spark.range(random_strings).select(F.explode(F.array(F.substring(F.base64(F.unhex(digest)), 1, 40), digest, F.substring(letters, 1, 32), F.upper(F.substring(letters, 3, 24)))).alias("token"))
    texts = id_and_text(docs, id_col, text_col).filter(F.col("_text").isNotNull())
    # the sample is chosen by id alone; sample_docs bounds what is broadcast
    ids = texts.select(F.col("_id").alias("_own")).distinct().orderBy(F.xxhash64("_own"), "_own").limit(sample_docs)
    chosen = texts.join(F.broadcast(ids), F.col("_id") == F.col("_own"), "left_semi")
    found = chosen.select(F.regexp_extract_all("_text", F.lit("[A-Za-z]{3,24}"), F.lit(0)).alias("w"), F.col("_id"))
    three = lambda i: F.slice("w", i * 3 + 1, F.lit(3))
    named = found.filter(F.size("w") >= 3).select("_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / 3).cast("int") - 1), three)).alias("i", "w"))
    # snake, kebab and camel case and plain words, some with a number as names have them
    shape = F.col("i") % 4
    number = F.when(F.col("i") % 3 == 0, F.concat(F.lit("_"), (F.col("i") % 100).cast("string"))).otherwise("")
    camel = F.array_join(F.transform("w", lambda x: F.initcap(x)), "")
    ordinary = named.select(F.concat(F.when(shape == 0, F.array_join("w", "_")).when(shape == 1, F.array_join("w", "-")).when(shape == 2, camel).otherwise(F.array_join("w", "/")), number).alias("token"))
    fixed = spark.range(1).select(F.explode(F.split(F.lit(" ".join((IDENTIFIERS + RULES) * 20)), " ")).alias("token"))
    return made.select(F.lit(1).alias("label"), "token").union(ordinary.select(F.lit(0), "token")).union(fixed.select(F.lit(0), "token"))


def fit(counted: list[tuple[int, str, int]], weight: float = 4.0) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) of each pair of places, row by row.

    A pair's share is smoothed by the class's single characters, which count ``weight``
    times for each first character; one of each single character is added.
    """
    n = {label: [[0.0] * SIZE for _ in range(SIZE)] for label in (0, 1)}
    for label, pair, count in counted:
        a, b = (ALPHABET.find(c) + 1 for c in pair)
        n[label][a][b] += count
    logs = {}
    for label, rows in n.items():
        single = [1.0 + sum(row[b] for row in rows) for b in range(SIZE)]
        total = sum(single)
        logs[label] = [[math.log((x + weight * single[b] / total) / (sum(row) + weight)) for b, x in enumerate(row)] for row in rows]
    return [logs[1][a][b] - logs[0][a][b] for a in range(SIZE) for b in range(SIZE)]


def _kept_out() -> Column:
    return (F.pmod(F.xxhash64("token"), F.lit(5)) == 0) & ~F.col("token").isin(*IDENTIFIERS, *RULES)  # the fixed list is for training


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, random_strings: int = RANDOM_STRINGS) -> tuple[list[float], float]:
    """The models' table of ratios, and the calibrated least ratio."""
    held = checkpointed(samples(docs, id_col=id_col, text_col=text_col, sample_docs=sample_docs, random_strings=random_strings))
    counted = transitions(held.filter(~_kept_out()))
    model = fit([(r["label"], r["pair"], r["count"]) for r in counted.collect()])  # two labels by the alphabet's square, at most
    own = F.when((F.col("label") == 0) & (F.length("token") >= 16), ratio(F.col("token"), model))
    usual = held.filter(_kept_out()).agg(F.percentile_approx(own, 0.999, 10000)).first()[0]
    return model, max(PRIOR, usual or 0.0)


def ratio(token: Column, model: list[float]) -> Column:
    """The token's log-likelihood ratio, random against ordinary."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")  # folded into one constant
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    first = F.struct(F.lit(-1).alias("a"), F.lit(0.0).alias("sum"))
    step = lambda acc, b: F.struct(b.alias("a"), (acc["sum"] + F.when(acc["a"] < 0, 0.0).otherwise(F.element_at(table, acc["a"] * SIZE + b + 1))).alias("sum"))
    # the characters are split off once, so that a token's cost is in proportion to its length
    return F.aggregate(F.transform(F.split(token, ""), place), first, step, lambda acc: acc["sum"])


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: list[float] | None = None, min_ratio: float | None = None, **sample: int) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_added, all_spans (array)."""
    if model is None:
        model, calibrated = train(docs, id_col=id_col, text_col=text_col, **sample)
        min_ratio = calibrated if min_ratio is None else min_ratio
    min_ratio = PRIOR if min_ratio is None else min_ratio
    text = F.col("_text")
    out = id_and_text(docs, id_col, text_col).withColumn("_text", F.coalesce(text, F.lit("")))
    cue = F.lower(text)
    shapes = {
        "assign": (ASSIGN, cue.rlike("passw|secret|token|api_?key")), "access": (ACCESS, F.contains(text, F.lit("AKIA"))),
        "hex": (HEX, None), "random": (TOKEN, None),
    }
    out = out.withColumns({f"m_{n}": all_matches(text, p, gate) for n, (p, gate) in shapes.items()})
    spans = {n: positions(text, p, F.col(f"m_{n}")) for n, (p, _) in shapes.items()}
    value = lambda s: F.regexp_extract(s["text"], ASSIGN, 1)
    out = out.withColumns({f"s_{n}": s for n, s in spans.items()})
    kept = {"assign": F.filter("s_assign", lambda s: F.length(value(s)) >= 12), "access": F.col("s_access"), "hex": F.col("s_hex")}
    out = out.withColumn("base", F.concat(*(tagged(kept[k], i, k) for i, k in enumerate(KINDS))))
    loose = apart(tagged(F.col("s_random"), len(KINDS), "random"), F.col("base"))
    out = out.withColumn("added", F.filter(loose, lambda s: ratio(s["text"], model) >= min_ratio))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    whole = F.concat("base", "added")
    return out.select(
        F.col("_id").alias(id_col), *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(whole).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"), F.transform(whole, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("all_spans"),
    )
