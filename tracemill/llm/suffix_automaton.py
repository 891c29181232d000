"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built over the words of all benchmark items. A document is
streamed through it word by word while the longest match that ends at each
word is tracked; wherever that match covers a whole window (13 consecutive
item words, or all words of a shorter item), the words of the window are hit.
Words that no item holds reset the automaton, so only runs of known words at
least as long as the shortest window are walked; that is exact. ``cleaned``
applies both limits: documents over the coverage limit go, and from the others
the spans of at least ``least_words`` hit words are cut.

Defined results: a null, empty or word-free text has no words and no hits; an
item with a null or word-free text has no window; an item whose id is null
counts for hits but is not listed; repeated items and rows count as they stand
(one output row for each input row); no items or no documents give no hits or
no rows. Columns other than the two that are named are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import LOWER_BYTES, checkpointed, map_texts
from tracemill.llm.spans import running_max

WINDOW = 13
#: Items are taken in blocks of at most so many characters, each with an automaton of its own.
BLOCK_CHARS = 1_000_000
_ROW, _TEXT = "__tracemill_whole_row", "__tracemill_text"  # names that no input has
_WORD_BYTES = bytes(LOWER_BYTES[c] if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
FIELDS = [("n_words", "bigint"), ("n_hit", "bigint"), ("longest", "bigint"), ("items", "array<string>"), ("spans", "array<struct<start:bigint,end:bigint>>")]


def words(text: bytes) -> list[bytes]:
    """Lower-cased words: ASCII letters and digits and everything beyond ASCII."""
    return text.translate(_WORD_BYTES).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the windows of each state."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for name, ws in items if ws]
        for _, ids in texts:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.shortest = min((min(len(ids), window) for _, ids in texts), default=0)
        self._mark(texts)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:  # another item already has this sequence
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def _holder(self, state: int, size: int) -> int:
        """The state on the suffix path that holds the suffix of ``size`` words."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _mark(self, texts: list[tuple[str | None, list[int]]]) -> None:
        names: dict[tuple[int, int], set[str | None]] = defaultdict(set)
        for name, ids in texts:
            size, state = min(len(ids), self.window), 0
            for i, c in enumerate(ids):
                state = self.step[state][c]
                if i + 1 >= size:
                    names[self._holder(state, size), size].add(name)
        at_state: dict[int, list[tuple[int, frozenset]]] = defaultdict(list)
        for (state, size), who in names.items():
            at_state[state].append((size, frozenset(who)))
        #: Of each state, the windows that end where it ends, from its own and its suffixes.
        self.windows: list[tuple] = [()] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.windows[state] = (*at_state.get(state, ()), *self.windows[self.link[state]])

    def matches(self, ids: list[int]) -> Iterator[tuple[int, int, frozenset, int]]:
        """(end, size, names, longest match) of each window that ends in a run of known words."""
        step, link, length, windows = self.step, self.link, self.length, self.windows
        state = match = 0
        for i, c in enumerate(ids):
            to = step[state].get(c)
            while to is None and state:
                state = link[state]
                match = length[state]
                to = step[state].get(c)
            if to is None:
                continue
            state, match = to, match + 1
            for size, who in windows[state]:
                if size <= match:
                    yield i + 1, size, who, match

    def scan(self, text: bytes) -> tuple[int, int, int, list[str], list[dict]]:
        ws = words(text)
        n = len(ws)
        if not self.shortest or n < self.shortest:
            return n, 0, 0, [], []
        ids = list(map(self.vocabulary.get, ws))
        known = np.fromiter((x is not None for x in ids), np.int8, n)
        edge = np.flatnonzero(np.diff(known, prepend=0, append=0))
        hit: np.ndarray | None = None
        found: set[str] = set()
        longest = 0
        for start, end in edge.reshape(-1, 2).tolist():
            if end - start < self.shortest:
                continue
            for at, size, who, match in self.matches(ids[start:end]):
                if hit is None:
                    hit = np.zeros(n + 1, np.int64)
                hit[start + at - size] += 1
                hit[start + at] -= 1
                found |= who
                longest = max(longest, match)
        if hit is None:
            return n, 0, 0, [], []
        inside = (np.cumsum(hit[:-1]) > 0).astype(np.int8)
        spans = np.flatnonzero(np.diff(inside, prepend=0, append=0)).reshape(-1, 2).tolist()
        return n, int(inside.sum()), longest, sorted(x for x in found if x is not None), [{"start": a, "end": b} for a, b in spans]


def _blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in blocks of at most ``most`` characters (a longer item stands alone), streamed partition by partition."""
    block, size = [], 0
    for name, text in items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).filter(F.col(text_col).isNotNull()).toLocalIterator():
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((name, text.encode()))
        size += len(text)
    if block:
        yield block


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: word and hit counts, longest match, items with occurring windows, hit spans (in words).

    What is broadcast is one automaton of at most ``block_chars`` item characters;
    more items make more blocks and one scan of the documents for each.
    """
    blocks = _blocks(items, item_col, item_text_col, block_chars)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _scan(docs, first, id_col, text_col, window)
    # several blocks: number the rows once, so that each block's findings can be put together by number
    numbered = checkpointed(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_key"), F.col(text_col).alias("_text")))
    whole = _scan(numbered, first, "_row", "_text", window)
    for block in (second, *blocks):
        whole = checkpointed(whole.unionByName(_scan(numbered, block, "_row", "_text", window)).transform(_merged))
    return numbered.select("_row", "_key").join(whole, "_row").select(F.col("_key").alias(id_col), *(n for n, _ in FIELDS))


def _scan(docs: DataFrame, block: list[tuple[str | None, bytes]], id_col: str, text_col: str, window: int) -> DataFrame:
    automaton = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(((name, words(text)) for name, text in block), window))

    def rows_of(texts: list[bytes]) -> Iterable[tuple]:
        scan = automaton.value.scan
        return [scan(t) for t in texts]

    return map_texts(docs, id_col, text_col, FIELDS, rows_of)


def _merged(both: DataFrame) -> DataFrame:
    """One row for each _row from those of two blocks: items and spans united."""
    one = both.groupBy("_row").agg(
        F.first("n_words").alias("n_words"), F.max("longest").alias("longest"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    one = one.withColumn("_upto", running_max(F.transform("spans", lambda s: s["end"].cast("int"))))
    # a span opens a stretch if it starts behind the end of all before it; the stretch ends where the next one's predecessors end
    opens = F.filter(F.sequence(F.lit(0), F.size("spans") - 1), lambda i: (i == 0) | (F.get("spans", i)["start"] > F.coalesce(F.get("_upto", i - 1), F.lit(-1))))
    one = one.withColumn("_opens", F.when(F.size("spans") > 0, opens).otherwise(F.array().cast("array<int>")))
    end = lambda k: F.get("_upto", F.coalesce(F.get("_opens", k + 1), F.size("spans")) - 1)
    union = F.transform("_opens", lambda i, k: F.struct(F.get("spans", i)["start"].alias("start"), end(k).cast("bigint").alias("end")))
    one = one.withColumn("spans", union)
    return one.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])).select("_row", *(n for n, _ in FIELDS))


def verdicts(scanned: DataFrame, *, share: int = 20) -> DataFrame:
    """Adds n_items, items_sha256 and contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    return scanned.withColumns({
        "n_items": F.size("items").cast("bigint"),
        "items_sha256": F.sha2(F.concat_ws(",", "items").cast("binary"), 256),
        "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")),
    })


def cut_spans(text: str | None, spans: list[dict]) -> str | None:
    """The text without the words of the spans; what stands between other words stays."""
    if text is None or not spans:
        return text
    raw = text.encode()
    marked = raw.translate(_WORD_BYTES)
    places, at = [], 0
    for w in marked.split():
        at = marked.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    out, kept = [], 0
    for s in spans:
        out.append(raw[kept : places[s["start"]][0]])
        kept = places[s["end"] - 1][1]
    return b"".join([*out, raw[kept:]]).decode("utf-8", "replace")


def without_spans(text: Column, spans: Column) -> Column:
    """``cut_spans`` of columns, in Arrow batches; texts without spans are not sent."""
    cut = F.pandas_udf(lambda texts, found: texts.combine(found, lambda t, s: cut_spans(t, s if s is not None else [])), "string")
    return F.when(F.size(spans) > 0, cut(F.when(F.size(spans) > 0, text), spans)).otherwise(text)


def cleaned(docs: DataFrame, items: DataFrame, *, text_col: str = "text", least_words: int = WINDOW, share: int = 20, **options) -> DataFrame:
    """The documents under the coverage limit, in the same columns, without the hit spans of ``least_words`` words or more. Nothing is shuffled where one block holds the items."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(_ROW))
    found = verdicts(decontaminate(rows.withColumn(_TEXT, F.col(f"{_ROW}.`{text_col}`")), items, id_col=_ROW, text_col=_TEXT, **options), share=share)
    kept = found.filter(~F.col("contaminated")).withColumn("spans", F.filter("spans", lambda s: s["end"] - s["start"] >= least_words))
    clean = without_spans(F.col(f"{_ROW}.`{text_col}`"), F.col("spans"))
    return kept.withColumn(_TEXT, clean).select(*(F.col(_TEXT).alias(c) if c == text_col else F.col(f"{_ROW}.`{c}`").alias(c) for c in docs.columns))


def items_digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
