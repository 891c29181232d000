"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-case letters with single spaces between words; everything
else counts as a space. Training counts all 4-grams of every labelled text (no
sample): each task sorts the 64-bit keys of its texts and emits one row per
language and key, which Spark adds up. Lower orders are continuation counts,
so they follow from the distinct 4-grams. The model keeps sorted key arrays
with one column of log-probabilities per language; a text's score under a
language is its cross-entropy per character, over all its characters, and the
lowest wins (ties: the first language by name).

A model of at most ``max_ngrams`` distinct 4-grams in every language, and of at
most 8 * ``max_ngrams`` table cells (4-grams of all languages times languages),
is fitted on the driver and broadcast. A larger one stays in Spark tables: discounts,
totals and continuation counts come from all 4-grams, the most frequent 4-grams
(as many as give 8 * ``max_ngrams`` cells, at most) are broadcast with their
probabilities, and a text's other 4-grams find theirs by joins. Nothing is pruned, so the two ways agree (to the
2^-24 bits to which the second rounds each 4-gram); ``max_ngrams`` only bounds
what the driver collects and the executors hold.

Rejection is calibrated per language: the limit lies midway between the upper
quartile of the labelled training documents' own cross-entropies and the entropy of the
language's single characters, which is what text without its structure costs.
Short texts vary more, so ``slack`` / sqrt(characters) is added. A text over
its limit, or without letters, is rejected.

Defined results: null, empty or letter-free texts are ``und`` with score 0 and
rejected; without any labelled text all are ``und``; rows are independent, so
repeated texts give equal results; no documents give no rows. Columns other
than those that are named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import checkpointed, map_texts, slices, small_batches

ORDER = 4
MAX_NGRAMS = 1_000_000
#: Distinct 4-grams that a counting task holds, about; and bytes of text whose other 4-grams are joined from one part of a batch.
HELD_KEYS, PART_BYTES = 4_000_000, 1 << 20
#: Two standard errors of a mean over characters whose costs spread by about two bits.
SLACK = 4.0
UND = "und"
_BOTH = "__tracemill_both"  # a name that no input has


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point, 16 bits of its lower-case letter, or 0; letters beyond the first 65,536 code points share them with others."""
    out = np.zeros(0x110000, np.uint16)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = (ord(low if len(low) == 1 else c) & 0xFFFF) or 1
    return out


def symbols(text: str) -> np.ndarray:
    """Letters with single zeros between, before and after words; empty if there is no letter."""
    a = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    full = a != 0
    if not full.any():
        return a[:0]
    keep = full.copy()
    keep[1:] |= full[:-1]  # the first space after a letter
    a = a[keep]
    lead = np.zeros(ORDER - 1, np.uint16)
    return np.concatenate([lead, a, a[:0] if not a[-1] else lead[:1]])


def keys(s: np.ndarray) -> np.ndarray:
    """The 64-bit keys of all 4-grams."""
    w = s.astype(np.uint64)
    return w[:-3] << np.uint64(48) | w[1:-2] << np.uint64(32) | w[2:-1] << np.uint64(16) | w[3:]


def key_parts(s: np.ndarray, step: int = 1 << 19) -> Iterator[np.ndarray]:
    """The keys in parts of at most ``step``, so that a very long text takes no more memory than that."""
    for at in range(0, len(s) - 3, step):
        yield keys(s[at : at + step + 3])


def _tally(k: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts."""
    if n is None:
        k = np.sort(k)
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
        return k[at], np.diff(np.r_[at, len(k)])
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return k[at], np.add.reduceat(n, at) if len(at) else n


def count_ngrams(labelled: DataFrame, lang_col: str, text_col: str, held_keys: int = HELD_KEYS) -> DataFrame:
    """(lang, key, n) over all rows; a task that holds more than ``held_keys`` emits its counts so far and starts anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        size = 0

        def merge() -> None:
            nonlocal size
            for lang, found in waiting.items():
                k, n = _tally(np.concatenate(found))
                if lang in held:
                    k, n = _tally(np.concatenate([held[lang][0], k]), np.concatenate([held[lang][1], n]))
                held[lang] = k, n
            waiting.clear()
            size = 0

        def emitted() -> Iterator[pa.RecordBatch]:
            for lang, (k, n) in held.items():
                for at in range(0, len(k), 1 << 16):
                    part = k[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part.view(np.int64)), pa.array(n[at : at + (1 << 16)].astype(np.int64))], names=["lang", "key", "n"])
            held.clear()

        for batch in batches:
            for part in slices(batch, 4 << 20):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for k in key_parts(symbols(text)) if lang is not None and text else ():
                        waiting.setdefault(lang, []).append(k)
                        size += len(k)
                        if size > 2_000_000:
                            merge()
                            if sum(len(k) for k, _ in held.values()) > held_keys:
                                yield from emitted()
        merge()
        yield from emitted()

    small_batches(labelled.sparkSession)
    found = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "lang string, key bigint, n bigint")
    return found.groupBy("lang", "key").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    grams: list[np.ndarray] = field(default_factory=list)  # of orders 4, 3, 2, 1: sorted keys
    logs: list[np.ndarray] = field(default_factory=list)  # of each, log2 probabilities, one column per language
    contexts: list[np.ndarray] = field(default_factory=list)  # of orders 4, 3, 2: sorted contexts
    weights: list[np.ndarray] = field(default_factory=list)  # of each, log2 of what goes to the lower order
    floor: float = -16.0
    entropy: list[float] = field(default_factory=list)  # of single characters, by language

    def score(self, k: np.ndarray) -> np.ndarray:
        """log2 probabilities of the last character of each 4-gram, a column per language."""
        out = np.empty((len(k), len(self.langs)), np.float32)
        rest, mask = np.arange(len(k)), np.uint64(0xFFFFFFFFFFFFFFFF)
        spent = np.zeros((len(k), len(self.langs)), np.float32)
        for i, grams in enumerate(self.grams):
            own = k[rest] & mask
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            hit = grams[at] == own
            if i == 0 and hit.all():
                return self.logs[0][at]
            out[rest[hit]] = self.logs[i][at[hit]] + spent[rest[hit]]
            rest, own = rest[~hit], own[~hit]
            if not len(rest):
                return out
            if i < len(self.contexts):
                c = own >> np.uint64(16)
                at = np.minimum(np.searchsorted(self.contexts[i], c), len(self.contexts[i]) - 1)
                spent[rest] += np.where((self.contexts[i][at] == c)[:, None], self.weights[i][at], 0)
            mask >>= np.uint64(16)
        out[rest] = self.floor + spent[rest]
        return out


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney models from the 4-gram counts of each language."""
    langs = sorted(counts)
    if not langs:
        return Model()
    per = []  # of each language and order, (keys, counts): raw for 4-grams, continuations below
    for lang in langs:
        k, n = _tally(*counts[lang])
        orders = [(k, n.astype(np.float64))]
        for order in (3, 2, 1):
            mask = np.uint64((1 << 16 * order) - 1)
            low, types = _tally(np.sort(orders[-1][0] & mask))
            orders.append((low, types.astype(np.float64)))
        per.append(orders)
    grams = [np.unique(np.concatenate([p[i][0] for p in per])) for i in range(4)]
    size = len(grams[3]) + 1
    model = Model(langs, grams, [], [], [], float(-np.log2(size)))
    below: list[np.ndarray] = []  # probabilities of the order below, for all its grams, by language
    for i in (3, 2, 1, 0):
        probs, columns = [], []
        contexts = np.unique(grams[i] >> np.uint64(16)) if i < 3 else np.zeros(1, np.uint64)
        for j, orders in enumerate(per):
            k, n = orders[i]
            ones, twos = (n == 1).sum(), (n == 2).sum()
            d = min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5
            own = k >> np.uint64(16) if i < 3 else np.zeros(len(k), np.uint64)
            at = np.searchsorted(contexts, own)
            total, types = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
            back = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
            n_all = np.zeros(len(grams[i]))
            n_all[np.searchsorted(grams[i], k)] = np.maximum(n - d, 0)
            of = np.searchsorted(contexts, grams[i] >> np.uint64(16)) if i < 3 else np.zeros(len(grams[i]), np.int64)
            lower = 1.0 / size if i == 3 else below[j][np.searchsorted(grams[i + 1], grams[i] & np.uint64((1 << 16 * (3 - i)) - 1))]
            probs.append(n_all / np.maximum(total[of], 1) + back[of] * lower)
            columns.append(back)
        below = probs
        if i == 3:
            model.entropy = [float(-(p * np.log2(p)).sum()) for p in probs]
        model.logs.insert(0, np.log2(np.column_stack(probs)).astype(np.float32))
        if i < 3:
            model.contexts.insert(0, contexts)
            model.weights.insert(0, np.log2(np.column_stack(columns)).astype(np.float32))
    return model


@dataclass
class Joined:
    """A model too large for the driver: the frequent 4-grams at hand, the others by joins."""

    langs: list[str]
    entropy: list[float]  # of single characters, by language
    hot: np.ndarray  # sorted keys of the frequent 4-grams
    bits: np.ndarray  # of each, log2 probabilities in units of 2^-24, one column per language
    logs: Callable[[DataFrame], DataFrame]  # distinct keys to (key, such logs)


UNIT = 1 << 24


def join_model(counts: DataFrame, langs: list[str], max_ngrams: int) -> Joined:
    """What ``fit`` gives, from checkpointed counts, with tables in place of arrays."""
    low = lambda i: F.col("key").bitwiseAND(F.lit((1 << 16 * (3 - i)) - 1))  # noqa: E731 - a key's part of the next order
    context = F.shiftrightunsigned("key", 16)
    wide = lambda c: F.array(*(F.coalesce(F.max(F.when(F.col("lang") == x, F.col(c))), F.lit(0)) for x in langs))
    orders = [counts]
    for i in range(3):
        orders.append(checkpointed(orders[-1].groupBy("lang", low(i).alias("key")).agg(F.count(F.lit(1)).alias("n"))))
    discounts = []  # of each order, by language
    for o in orders:
        found = {r["lang"]: (r["ones"], r["twos"]) for r in o.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()}
        discounts.append([min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5 for ones, twos in (found[x] for x in langs)])
    grams = [checkpointed(o.groupBy("key").agg(wide("n").alias("of"))) for o in orders]
    sums = [o.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types")) for o in orders]
    sums = [checkpointed(x.groupBy("context").agg(wide("total").alias("total"), wide("types").alias("types"))) for x in sums]  # the context of a single character is 0
    floor = 1.0 / (grams[3].count() + 1)

    def probs(rows: DataFrame, i: int, lower: Callable[[int], Column]) -> DataFrame:
        """(key, p) of distinct keys of an order; lower gives a row's probability of the order below."""

        def p(j: int) -> Column:
            d, total = discounts[i][j], F.coalesce(F.col("total")[j], F.lit(0))
            own = F.greatest(F.coalesce(F.col("of")[j], F.lit(0)) - F.lit(d), F.lit(0.0)) / F.greatest(total, F.lit(1))
            return own + F.when(total > 0, d * F.col("types")[j] / total).otherwise(1.0) * lower(j)

        rows = rows.withColumn("context", context).join(grams[i], "key", "left").join(sums[i], "context", "left")
        return rows.select("key", F.array(*map(p, range(len(langs)))).alias("p"))

    single = checkpointed(probs(grams[3].select("key"), 3, lambda j: F.lit(floor)))
    table = single.toArrow().sort_by("key")  # 65,536 rows at most
    at_hand = np.array(table.column("p").to_pylist())
    entropy = [float(x) for x in -(at_hand * np.log2(at_hand)).sum(axis=0)]

    def logs(keys: DataFrame) -> DataFrame:
        levels = [keys]
        for i in range(2):
            levels.append(levels[-1].select(low(i).alias("key")).distinct())
        below = single
        for i in (2, 1, 0):
            rows = levels[i].withColumn("low", low(i)).join(below.select(F.col("key").alias("low"), F.col("p").alias("lower")), "low", "left")
            below = checkpointed(probs(rows, i, lambda j: F.coalesce(F.col("lower")[j], F.lit(floor))))
        return below.select("key", F.transform("p", lambda x: F.round(F.log2(x) * UNIT).cast("bigint")).alias("logs"))

    # the most frequent keys: the count they need comes from a histogram of counts
    total = grams[0].select("key", F.aggregate("of", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    share = total.groupBy("n").count().withColumn("upto", F.sum("count").over(Window.orderBy(F.col("n").desc())))
    least = share.filter(F.col("upto") <= 8 * max_ngrams // len(langs)).agg(F.min("n")).first()[0]
    hot = logs(total.filter(F.lit(False) if least is None else F.col("n") >= least).select("key")).toArrow()
    keys_at_hand = hot.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys_at_hand)
    flat = hot.column("logs").combine_chunks().flatten().to_numpy().astype(np.int32)
    return Joined(langs, entropy, keys_at_hand[order], flat.reshape(-1, len(langs))[order], logs)


def train(labelled: DataFrame, *, lang_col: str = "lang", text_col: str = "text", max_ngrams: int = MAX_NGRAMS) -> Model | Joined:
    counts = checkpointed(count_ngrams(labelled, lang_col, text_col))
    size = counts.groupBy("lang").count().collect()  # a row per language
    if any(r["count"] > max_ngrams for r in size) or sum(r["count"] for r in size) * len(size) > 8 * max_ngrams:
        return join_model(counts, sorted(r["lang"] for r in size), max_ngrams)
    table = counts.toArrow()
    found = {}
    lang, key, n = (table.column(c).combine_chunks() for c in ("lang", "key", "n"))
    code = lang.dictionary_encode()
    names, codes = code.dictionary.to_pylist(), code.indices.to_numpy()
    for i, name in enumerate(names):
        at = codes == i
        found[name] = key.to_numpy()[at].view(np.uint64), n.to_numpy()[at]
    return fit(found)


def judge(text: str, model: Model) -> tuple[str, float, float | None, int]:
    """Language, score, cross-entropy and characters of a text."""
    s = symbols(text) if text and model.langs else np.empty(0, np.uint16)
    if not len(s):
        return UND, 0.0, None, 0
    n, bits = len(s) - 3, np.zeros(len(model.langs))
    for k in key_parts(s):
        bits -= model.score(k).sum(axis=0, dtype=np.float64)
    rate = bits / n
    best = int(np.argmin(rate))
    # the share of the best among the languages, at the evidence of 32 characters at most
    share = 1.0 / np.exp2((rate[best] - rate) * min(n, 32)).sum()
    return model.langs[best], float(min(max(share, 0.0), 1.0)), float(rate[best]), n


def _part_scores(text: str, hot: np.ndarray, bits: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Characters of a text, the summed logs of its 4-grams at hand, and its other 4-grams with their counts."""
    s = symbols(text)
    done = np.zeros(bits.shape[1], np.int64)
    other, times = np.empty(0, np.uint64), np.empty(0, np.int64)
    for part in key_parts(s):
        k, n = _tally(part)
        hit = np.zeros(len(k), bool)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, k), len(hot) - 1)
            hit = hot[at] == k
            done += n[hit] @ bits[at[hit]].astype(np.int64)
        other, times = _tally(np.concatenate([other, k[~hit]]), np.concatenate([times, n[~hit]]))
    return max(len(s) - 3, 0), done, other.view(np.int64), times


def _join_scores(docs: DataFrame, model: Joined, id_col: str, text_col: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((model.hot, model.bits))
    rows_of = lambda texts: [_part_scores(t.decode("utf-8", "replace"), *sent.value) for t in texts]
    held = map_texts(docs, id_col, text_col, [("n_symbols", "bigint"), ("done", "array<bigint>"), ("other", "array<bigint>"), ("times", "array<bigint>")], rows_of, most_bytes=PART_BYTES)
    held = checkpointed(held.withColumn("row", F.monotonically_increasing_id()))
    other = held.select("row", F.explode(F.arrays_zip("other", "times")).alias("o")).select("row", F.col("o.other").alias("key"), F.col("o.times").alias("times"))
    found = other.join(model.logs(other.select("key").distinct()), "key")
    size = range(len(model.langs))
    rest = found.groupBy("row").agg(F.array(*(F.sum(F.col("logs")[j] * F.col("times")) for j in size)).alias("rest"))
    rate = F.array(*((F.col("done")[j] + F.coalesce(F.col("rest")[j], F.lit(0))) / (F.lit(-float(UNIT)) * F.col("n_symbols")) for j in size))
    rows = held.join(rest, "row", "left").withColumn("rate", F.when(F.col("n_symbols") > 0, rate)).withColumn("best", F.array_min("rate"))
    ways = F.aggregate("rate", F.lit(0.0), lambda a, x: a + F.pow(F.lit(2.0), (F.col("best") - x) * F.least("n_symbols", F.lit(32))))
    name = F.element_at(F.array(*map(F.lit, model.langs)), F.array_position("rate", F.col("best")).cast("int"))
    some = F.col("n_symbols") > 0
    return rows.select(id_col, F.when(some, name).otherwise(UND).alias("lang_pred"), F.when(some, 1.0 / ways).otherwise(0.0).alias("score"), F.col("best").alias("cross_entropy"), "n_symbols")


def score_texts(docs: DataFrame, model: Model | Joined, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    if isinstance(model, Joined):
        return _join_scores(docs, model, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows_of(texts: list[bytes]) -> Iterable[tuple]:
        m = sent.value
        return [judge(t.decode("utf-8", "replace"), m) for t in texts]

    return map_texts(docs, id_col, text_col, [("lang_pred", "string"), ("score", "double"), ("cross_entropy", "double"), ("n_symbols", "bigint")], rows_of)


def is_held_out(id_col: str, folds: int = 5):
    """crc32 of the id as text, modulo the folds, is 0; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def identify(docs: DataFrame, *, id_col: str = "doc_id", fold_col: str | None = None, text_col: str = "text", lang_col: str = "lang", max_ngrams: int = MAX_NGRAMS, slack: float = SLACK) -> DataFrame:
    """Train on the documents that are not held out and judge all: id, held_out, lang_pred, score, cross_entropy, rejected.

    fold_col: the column whose hash decides what is held out, if it is not the id.
    """
    held_out = is_held_out(fold_col or id_col)
    model = train(docs.filter(~held_out & F.col(lang_col).isNotNull()), lang_col=lang_col, text_col=text_col, max_ngrams=max_ngrams)
    # what decides the limits goes through the scoring with the id: the fold, and whether the row has a label
    both = F.struct(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(lang_col).isNotNull().alias("labelled"))
    scored = score_texts(docs.withColumn(_BOTH, both), model, id_col=_BOTH, text_col=text_col)
    found = ("lang_pred", "score", "cross_entropy", "n_symbols")
    scored = checkpointed(scored.select(F.col(f"{_BOTH}.id").alias(id_col), *(F.col(f"{_BOTH}.{n}").alias(n) for n in ("held_out", "labelled")), *found))
    learned = scored.filter(~F.col("held_out") & F.col("labelled") & F.col("cross_entropy").isNotNull())
    quartiles = learned.groupBy("lang_pred").agg(F.percentile_approx("cross_entropy", 0.75, 10000).alias("usual")).collect()  # a row per language
    usual = {r["lang_pred"]: r["usual"] for r in quartiles}
    limit = F.lit(None).cast("double")
    for lang, entropy in zip(model.langs, model.entropy, strict=True):
        limit = F.when(F.col("lang_pred") == lang, F.lit((usual.get(lang, entropy) + entropy) / 2)).otherwise(limit)
    limit = limit + slack / F.sqrt("n_symbols")
    rejected = F.col("cross_entropy").isNull() | F.coalesce(F.col("cross_entropy") > limit, F.lit(False))
    return scored.select(id_col, "held_out", "lang_pred", "score", "cross_entropy", "n_symbols", rejected.alias("rejected"))
