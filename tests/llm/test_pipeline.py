import hashlib

import corpus_pipeline
from tests.llm.test_pii_and_secrets import PII
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_suffix_automaton import WORD, brute_words
from tests.llm.test_suffix_automaton import brute as brute_hits
from tracemill.llm import byte_bpe, language_id
from tracemill.llm.common import read
from tracemill.llm.queries import PATTERN, RANKS


def without(text, items):
    """The text without the words of passages of 13 words and more that items have too."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text or "")]
    low = brute_words(text)
    known = {tuple(iw[a : a + 13]) for _, item in items for iw in [brute_words(item)] for a in range(len(iw) - 12)}
    gone = sorted({p for k in range(len(low) - 12) if tuple(low[k : k + 13]) in known for p in range(k, k + 13)})
    for p in reversed([(a, b) for a, b in runs(gone)]):
        text = text[: words[p[0]][0]] + text[words[p[1]][1] :]
    return text


def runs(places):
    out = []
    for p in places:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return out


def test_run_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in read(spark, sf_dir, "documents").collect()}
    items = [(r.item_id, r.text) for r in read(spark, sf_dir, "benchmark").collect()]
    # the language stage is judged by its own tests; here it only names what goes
    rejected = {r.doc_id for r in language_id.identify(read(spark, sf_dir, "documents")).filter("rejected").collect()}
    left = {i: t for i, t in docs.items() if i not in rejected}
    rows = [(i, brute_fingerprint(t)) for i, t in left.items()]
    component = brute_components(rows)
    left = {i: left[i] for i, f in rows if component[i, f] == i}
    dirty = {i for i, t in left.items() if (n := brute_hits(t, items))[1] and 20 * n[1] >= n[0]}
    left = {i: t for i, t in left.items() if i not in dirty}
    assert dirty and len(left) < len(docs)

    def clean(text):
        found = sorted((m.start(), o, m.end(), k) for o, (k, p, keep) in enumerate(PII) for m in p.finditer(text) if keep(m))
        out, at = "", 0
        for a, _, b, k in found:
            if a >= at:
                out += text[at:a] + f"<{k.upper()}>"
            at = max(at, b)
        return out + text[at:]

    enc = byte_bpe.encoding(RANKS, PATTERN)
    left = {i: without(t, items) for i, t in left.items()}
    want = {i: (len(enc.encode_ordinary(c)), hashlib.sha256(c.encode()).hexdigest()) for i, t in left.items() for c in [clean(t)]}
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_stages_take_odd_rows(spark, sf_dir, odd, nothing):
    from pyspark.sql import functions as F

    for docs in (odd, nothing):
        docs = docs.withColumns({"lang": F.when(F.col("doc_id") > 4, "de").otherwise("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("bigint"), "all_spans": F.lit(1)})
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, sf_dir).cache()
            assert docs.count() >= 0 and ("n_tokens" in docs.columns if i == 4 else docs.columns == corpus_pipeline.COLUMNS), name


def test_same_columns_and_types(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert dict(stage(spark, docs, sf_dir).dtypes) == dict(docs.dtypes), name


def test_rows_without_an_id_or_with_another_ones_are_decided_by_their_text(spark, sf_dir):
    item = read(spark, sf_dir, "benchmark").first().text
    clean = read(spark, sf_dir, "documents").first().text
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(None, item, "en", "s", 1), (None, clean, "en", "s", 2), (5, item, "en", "s", 3), (5, clean, "en", "s", 4), (6, clean + " a@b.org", "en", "s", 5), (None, "a@b.org", "en", "s", 6)], schema)
    kept = corpus_pipeline.decontamination(spark, docs, sf_dir)
    assert sorted(r.n_chars for r in kept.collect()) == [2, 4, 5, 6]
    texts = {r.text for r in corpus_pipeline.personal_data(spark, kept, sf_dir).collect()}
    assert texts == {clean, clean + " <EMAIL>", "<EMAIL>"}
    again = corpus_pipeline.personal_data(spark, docs.union(docs), sf_dir)
    assert again.count() == 12
