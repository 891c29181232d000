import random
import re
import time

import pytest

from tracemill.llm import suffix_automaton as sa

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=13):
    words = brute_words(text)
    hit, found = set(), set()
    for name, item in items:
        iw = brute_words(item)
        size = min(len(iw), window)
        for a in range(len(iw) - size + 1) if size else ():
            for b in range(len(words) - size + 1):
                if words[b : b + size] == iw[a : a + size]:
                    hit |= set(range(b, b + size))
                    found.add(name)
    return len(words), len(hit), sorted(str(x) for x in found if x is not None)


@pytest.mark.parametrize("seed", range(30))
def test_scan_equals_brute_force(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "c", "É", "d1"])
    items = [(str(i), " ".join(word() for _ in range(rng.choice([0, 1, 3, 6, 9])))) for i in range(5)]
    text = ", ".join(word() if rng.random() < 0.9 else "zz" for _ in range(60))
    window = rng.choice([3, 4, 5])
    found = sa.SuffixAutomaton([(n, sa.words(t.encode())) for n, t in items], window).scan(text.encode())
    assert (found[0], found[1], found[3]) == brute(text, items, window)
    assert found[1] == sum(s["end"] - s["start"] for s in found[4])


def item_table(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


ITEMS = [(1, "The quick brown fox jumps over the lazy dog"), (10, "lazy dog"), (2, None), (None, "quick brown"), (3, " .. "), (10, "lazy dog")]


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_odd_rows_in_one_or_several_blocks(spark, odd, nothing, block):
    items = item_table(spark, ITEMS)
    got = sa.verdicts(sa.decontaminate(odd, items, block_chars=block)).collect()
    want = sorted((str(r.doc_id), *brute(r.text, ITEMS)[:2], brute(r.text, ITEMS)[2]) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == want
    for r in got:
        assert r.items_sha256 == sa.items_digest(r["items"]) and r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) and r.n_items == len(r["items"])
    assert sa.decontaminate(nothing, items).count() == 0
    assert {r.n_hit for r in sa.decontaminate(odd, item_table(spark, [])).collect()} == {0}


def test_spans_are_cut():
    text = "Keep this. Drop, THESE words! And keep é that."
    spans = [{"start": 2, "end": 5}]
    assert sa.cut_spans(text, spans) == "Keep this. ! And keep é that." and sa.cut_spans(None, spans) is None and sa.cut_spans(text, []) == text


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_cleaned_documents_equal_brute_force(spark, odd, block):
    rng = random.Random(6)
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = []
    for i in range(40):
        words = [rng.choice("alpha beta gamma delta".split()) for _ in range(rng.choice([10, 200, 600]))]
        at = rng.randrange(len(words))
        rows.append((i, ", ".join([*words[:at], *(item.split() if i % 2 else item.split()[: i % 14]), *words[at:]]), i))
    docs = spark.createDataFrame([*rows, (None, None, 1), (7, "", 2)], "doc_id bigint, text string, spans int")
    items = [(1, item), (2, "short item of six words here"), (3, "alpha omega")]
    got = {r["spans"]: (r.doc_id, r.text) for r in sa.cleaned(docs, item_table(spark, items), block_chars=block).filter("doc_id is not null and text <> ''").collect()}
    for i, text, _ in rows:
        n, hit, _ = brute(text, items)
        assert (i in got) == (not hit or 20 * hit < n)
        if i in got:
            left = brute_words(text)
            whole = [w for w in brute_words(item)]
            places = [k for k in range(len(left) - 12) if any(left[k : k + 13] == whole[a : a + 13] for a in range(2))]
            gone = {p for k in places for p in range(k, k + 13)}
            assert brute_words(got[i][1]) == [w for k, w in enumerate(left) if k not in gone] and got[i][0] == i
    assert sa.cleaned(docs, item_table(spark, items), block_chars=block).columns == docs.columns
    assert sa.cleaned(odd, item_table(spark, [])).count() == odd.count()


def test_spans_of_several_blocks_are_united_in_linear_time(spark):
    rng = random.Random(8)
    texts = [[sorted({rng.randrange(60) for _ in range(rng.randrange(12))}) for _ in range(3)] for _ in range(60)]
    spans = lambda starts, n: [(a, a + 1 + n) for a in starts]
    rows = [(i, 100, 0, 5, [f"i{b}"], spans(starts, b)) for i, parts in enumerate(texts) for b, starts in enumerate(parts)]
    n = 20_000
    rows += [(1000, 10 * n, 0, 1, [], [(4 * k, 4 * k + 2) for k in range(n)]), (1000, 10 * n, 0, 2, [], [(4 * k + 1, 4 * k + 3) for k in range(n)])]
    frame = spark.createDataFrame(rows, "_row bigint, n_words bigint, n_hit bigint, longest bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>")
    began = time.time()
    got = {r["_row"]: r for r in sa._merged(frame).collect()}
    assert time.time() - began < 20
    for i, parts in enumerate(texts):
        inside = {p for b, starts in enumerate(parts) for a, z in spans(starts, b) for p in range(a, z)}
        edges = {a for a, z in ((a, z) for b, starts in enumerate(parts) for a, z in spans(starts, b))}
        assert got[i].n_hit == len(inside) and {p for s in got[i].spans for p in range(s.start, s.end)} == inside
        assert all(a.end < b.start for a, b in zip(got[i].spans, got[i].spans[1:], strict=False)) and {s.start for s in got[i].spans} <= edges
    assert got[1000].n_hit == 3 * n and len(got[1000].spans) == n and got[1000].longest == 2
