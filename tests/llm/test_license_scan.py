import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import license_scan as ls


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=14), st.lists(st.sampled_from("abcdefgh"), max_size=14))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = ls.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert len(ls.align(a, a)) == len(a)


@settings(max_examples=100, deadline=None)
@given(st.permutations(list("abcdefghij")))
def test_unique_words_give_the_longest_subsequence(b):
    a = list("abcdefghij")
    t = [[0] * 11 for _ in range(11)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    mid = ls._increasing([(i, b.index(x)) for i, x in enumerate(a)])
    assert len(mid) == t[-1][-1]


def test_notices_whole_edited_and_repeated(spark, odd, nothing):
    rng = random.Random(1)
    filler = " ".join(rng.choice("the of and this is to in or be with for work software license".split()) for _ in range(400))
    mit = ls.TEMPLATES["MIT"]
    edited = mit.replace("free of charge", "at no charge").replace("THE", "the").upper()
    rows = [(1, f"{filler} {mit} {filler}"), (2, edited), (3, "Released under the MIT License.\n" * 3), (4, filler), (5, " ".join(mit.split()[:40])), (6, "This work is licensed under the GNU General Public License, version 3."), (7, ls.TEMPLATES["Apache-2.0"])]
    got = {r.doc_id: r for r in ls.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].license == "MIT" and got[1].coverage == 1.0 and got[1].finds[0].start == 400
    assert got[2].license == "MIT" and 0.9 < got[2].coverage < 1
    assert got[3].n_licenses == 3 and got[3].license == "MIT-line" and got[4].n_licenses == got[5].n_licenses == 0
    assert got[6].license == "GPL-3.0-line" and [f.template for f in got[7].finds] == ["Apache-2.0"]
    assert len(ls.scan_licenses(odd).collect()) == odd.count() and ls.scan_licenses(nothing).count() == 0
    assert {r.n_licenses for r in ls.scan_licenses(odd, templates={"empty": " "}).collect()} == {0}


def test_planted_lines_of_the_table_are_all_found(spark, sf_dir):
    from tracemill.llm.common import read

    docs = read(spark, sf_dir.replace("0.001", "0.01"), "documents")
    got = ls.scan_licenses(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all((r.n_licenses > 0) == ("licen" in r.text.lower()) for r in got)


def brute_align(a, b):
    """Patience alignment as it is defined, by recursion."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0), *((i + 1, j + 1) for i, j in brute_align(a[1:], b[1:]))]
    if a[-1] == b[-1]:
        return [*brute_align(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    once = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == b.count(w) == 1]
    # the longest subsequence; of equally long ones each word takes the predecessor that comes first in b
    best = []
    for p in once:
        before = [c for c in best if c[-1][1] < p[1]]
        longest = max(map(len, before), default=0)
        best.append([*min((c for c in before if len(c) == longest), key=lambda c: c[-1][1], default=[]), p])
    anchors = min((c for c in best if len(c) == max(map(len, best))), key=lambda c: c[-1][1], default=[])
    if not anchors:
        return []
    out = []
    for (i, j), (i2, j2) in zip([(-1, -1), *anchors], [*anchors, (len(a), len(b))]):
        out += [(x + i + 1, y + j + 1) for x, y in brute_align(a[i + 1 : i2], b[j + 1 : j2])]
        out += [(i2, j2)] * (i2 < len(a))
    return sorted(set(out))


def brute_finds(words, templates, coverage, density):
    """Every template from every word, both stretches, no bound that passes a start over."""
    found = []
    for name, own in sorted(templates.items()):
        at = 0
        while at < len(words):
            best = ()
            for width in (len(own) + max(3, len(own) // 4), int(-(-len(own) // density))):
                pairs = brute_align(own, words[at : at + width])
                if pairs and pairs[0][1] == 0 and len(pairs) >= len(own) * coverage and len(pairs) >= density * (pairs[-1][1] + 1):
                    best = max(best, (len(pairs), -pairs[-1][1]))
            if best:
                found.append((name, at, at - best[1] + 1, best[0] / len(own), best[0]))
            at = at - best[1] + 1 if best else at + 1
    out = []
    for name, start, end, share, _ in sorted(found, key=lambda f: (-f[4], -f[3], f[1], f[0])):
        if all(end <= a or b <= start for _, a, b, _ in out):
            out.append((name, start, end, share))
    return sorted(out, key=lambda f: (f[1], f[0]))


def test_finds_equal_brute_force():
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for _ in range(150):
        templates = {f"t{i}": [rng.choice(letters) for _ in range(rng.randint(3, 14))] for i in range(3)}
        words = []
        for _ in range(rng.randint(1, 5)):
            words += [rng.choice(letters) for _ in range(rng.randint(0, 8))]
            own = list(rng.choice(list(templates.values())))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(own) + 1)
                if rng.random() < 0.5:
                    own[at:at] = [rng.choice(letters)] * rng.randint(1, 6)
                else:
                    del own[at : at + 1]
            words += own
        scanner = ls.Scanner({n: " ".join(t) for n, t in templates.items()}, 0.75, 0.5)
        assert scanner.scan(" ".join(words).encode()) == brute_finds(words, templates, 0.75, 0.5)


def test_a_notice_with_other_text_inside_is_found():
    mit = ls.TEMPLATES["MIT"].split()
    own = len(ls.words(ls.TEMPLATES["MIT"].encode()))
    for n in (10, 45, 80):
        inside = [f"other{i}" for i in range(n)]
        finds = ls.Scanner(ls.TEMPLATES).scan(" ".join(["before"] * 30 + mit[: len(mit) // 2] + inside + mit[len(mit) // 2 :] + ["after"]).encode())
        assert finds == [("MIT", 30, 30 + own + n, 1.0)]
    thin = " ".join(f"{w} x y" for w in mit)
    assert not ls.Scanner(ls.TEMPLATES).scan(thin.encode())


def test_long_texts_of_common_words_cost_in_proportion():
    began = time.monotonic()
    rng = random.Random(9)
    common = "the of and this is to in or be with for work software license version public general under".split()
    text = " ".join(rng.choice(common) for _ in range(200_000))
    ls.Scanner(ls.TEMPLATES).scan(text.encode())
    assert time.monotonic() - began < 60
