import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracemill.llm import language_id as li
from tracemill.llm.common import read


def brute_model(texts):
    """Interpolated Kneser-Ney over dictionaries, for one language."""
    grams = Counter()
    for t in texts:
        s = li.symbols(t).tolist()
        grams.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    orders = [grams]
    for n in (3, 2, 1):
        orders.append(Counter(g[-n:] for g in {g for g in orders[-1]}))
    d = []
    for o in orders:
        ones, twos = (sum(v == k for v in o.values()) for k in (1, 2))
        d.append(min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5)
    total = [defaultdict(float) for _ in orders]
    types = [defaultdict(float) for _ in orders]
    for i, o in enumerate(orders):
        for g, v in o.items():
            total[i][g[:-1]] += v
            types[i][g[:-1]] += 1

    def p(g, size):
        if not g:
            return 1 / size
        i = 4 - len(g)
        if not total[i][g[:-1]]:
            return p(g[1:], size)
        return (max(orders[i][g] - d[i], 0) + d[i] * types[i][g[:-1]] * p(g[1:], size)) / total[i][g[:-1]]

    return p


def test_model_equals_dictionaries():
    texts = {"aa": ["abra cadabra", "abba ab", "ba ba black sheep"], "bb": ["xyz zyx", "xx yy zz black", "Öl und öl"]}
    model = li.fit({lang: li._tally(np.concatenate([li.keys(li.symbols(t)) for t in ts])) for lang, ts in texts.items()})
    brutes = {lang: brute_model(ts) for lang, ts in texts.items()}
    size = len(model.grams[3]) + 1
    for t in ("abra xyz", "black Öl", "cadaver zyzzy", "b"):
        s = li.symbols(t)
        got = model.score(li.keys(s))
        for i in range(len(s) - 3):
            g = tuple(s[i : i + 4].tolist())
            for j, lang in enumerate(model.langs):
                if (g[3],) in {(int(x),) for x in model.grams[3]}:
                    assert got[i, j] == pytest.approx(math.log2(brutes[lang](g, size)), abs=1e-4)


def test_symbols():
    assert li.symbols("a1 Bß!").tolist() == [0, 0, 0, ord("a"), 0, ord("b"), ord("ß"), 0]
    assert not len(li.symbols("12 !?")) and not len(li.symbols(""))
    assert li.judge("abc", li.Model()) == (li.UND, 0.0, None, 0)


def test_held_out_accuracy(spark, sf_dir):
    docs = read(spark, sf_dir.replace("0.001", "0.01"), "documents")
    got = li.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.99 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) == 0  # no document of the table is foreign


def sentences(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_rejection_and_odd_rows(spark, odd, nothing):
    rng = random.Random(5)
    de, en = "der die das und nicht einer schon haben werden".split(), "the and that which have been with from they".split()
    rows = [(i, sentences(rng, de if i % 2 else en, 60), "de" if i % 2 else "en") for i in range(300)]
    noise = "".join(rng.choice("qxzjvkwpyq") for _ in range(400))
    rows += [(1000, noise, None), (1001, "たちつてと" * 60, None), (1002, "das", None), (1003, None, "de"), (1004, "4 + 4", "en"), (1005, "", None)]
    got = {r.doc_id: r for r in li.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[i].rejected for i in (1000, 1001, 1003, 1004, 1005)) and not any(got[i].rejected for i in (*range(300), 1002))
    assert [got[i].lang_pred for i in (1002, 1003, 1004, 1005)] == ["de", "und", "und", "und"] and got[1003].score == 0
    assert all(got[i].lang_pred == ("de" if i % 2 else "en") for i in range(300))
    from pyspark.sql import functions as F

    bare = li.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(bare) == odd.count() and {r.lang_pred for r in bare} == {"und"}
    labelled = li.identify(odd.withColumn("lang", F.when(F.col("doc_id") > 4, "de").otherwise("en"))).collect()
    assert len(labelled) == odd.count()
    assert li.identify(nothing.withColumn("lang", F.lit("en"))).count() == 0


def test_small_models_still_judge(spark):
    rng = random.Random(6)
    rows = [(i, sentences(rng, ["abcd", "bcde", "efgh", "hgfe"] if i % 2 else ["zyxw", "wxyz", "vuvu", "tsts"], 40), "aa" if i % 2 else "zz") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = li.identify(df, max_ngrams=12).collect()
    assert all(r.lang_pred == ("aa" if r.doc_id % 2 else "zz") for r in got)


def test_a_model_over_the_bound_loses_nothing(spark, odd):
    rng = random.Random(7)
    letters = {"aa": "abcdefgh", "bb": "cdefghij", "cc": "日月火水木金土本"}  # mostly 4-grams that occur once or twice
    rows = [(i, "".join(rng.choice(letters[lang] + " ") for _ in range(300)), lang) for i in range(150) for lang in [rng.choice(list(letters))]]
    rows += [(1000, "zzzz qqqq" * 20, None), (1001, "12", None), (1002, None, "aa"), (None, "bad cab", None), (None, "bad cab", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    docs = docs.unionByName(odd.selectExpr("doc_id + 2000 as doc_id", "text", "'aa' as lang"))
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: (str(r[:3]), r[3:5] != (0.0, None), r[3]))
    whole = order(li.identify(docs))
    for bound in (12, 300):
        joined = order(li.identify(docs, max_ngrams=bound))
        assert len(joined) == len(whole) == docs.count()
        for a, b in zip(joined, whole, strict=True):
            assert a[:3] == b[:3] and a[5:] == b[5:] and a[3] == pytest.approx(b[3], abs=1e-4)
            assert a[4] == pytest.approx(b[4], abs=1e-5) if b[4] is not None else a[4] is None


def test_limits_are_learned_from_labelled_rows_alone(spark):
    rng = random.Random(10)
    de = "der die das und nicht einer schon haben werden".split()
    rows = [(i, sentences(rng, de, 60), "de") for i in range(200)]
    noise = [(1000 + i, "".join(rng.choice("derianst ") for _ in range(400)), None) for i in range(400)]
    limit = lambda rows: {r.doc_id for r in li.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).filter("rejected").collect()}
    assert limit(rows + noise) == {i for i, _, _ in noise} | limit(rows)


def test_sixty_languages_stay_within_the_table_and_none_is_lost(spark):
    rng = random.Random(11)
    rows = []
    for k in range(60):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)]
        rows += [(k * 10 + i, sentences(rng, words, 30), f"l{k:02d}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for bound in (li.MAX_NGRAMS, 2000):  # fitted on the driver; kept in tables, since 60 columns make too many cells
        got = li.identify(docs, max_ngrams=bound).collect()
        assert len(got) == len(rows) and all(r.lang_pred == f"l{r.doc_id // 10:02d}" for r in got if not r.held_out)


def test_counts_that_a_task_emits_early_add_up(spark):
    rng = random.Random(12)
    text = "".join(rng.choices("abcdefghijkl ", k=1_200_000))
    rows = [(lang, text[i * 1000 :]) for i, lang in enumerate(["aa", "bb", "aa", "aa"])]  # over two million 4-grams, so tasks merge in between
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    table = lambda df: {(r.lang, r.key): r.n for r in df.collect()}
    assert table(li.count_ngrams(docs, "lang", "text", held_keys=100)) == table(li.count_ngrams(docs, "lang", "text"))
