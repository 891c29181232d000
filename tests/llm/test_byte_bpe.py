import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import byte_bpe
from tracemill.llm.queries import PATTERN, RANKS

ENC = byte_bpe.encoding(RANKS, PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 2\n\t'sé日！\u00a0\u1680\u3000\x1c\x85<|>.-"), max_size=80), st.integers(1, 12))
def test_splitting_changes_nothing(text, chunk):
    whole = ENC.encode_ordinary(text)
    assert byte_bpe.encode(text, ENC, chunk).tolist() == whole
    assert byte_bpe.decode(whole, ENC) == text.encode()


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 100_000, "ab1" * 50_000, "é" * 50_000, "x y" * 40_000, "日本" * 40_000])
def test_long_texts(text):
    assert byte_bpe.decode(byte_bpe.encode(text, ENC).tolist(), ENC).decode() == text


def test_odd_rows(odd, nothing):
    texts = sorted((str(r.doc_id), r.text or "") for r in odd.collect())
    got = sorted(byte_bpe.encode_and_decode(odd, RANKS, PATTERN, with_ids=True).collect(), key=lambda r: (str(r.doc_id), r.decoded_sha256))
    want = sorted(((i, t, ENC.encode_ordinary(t)) for i, t in texts), key=lambda x: (x[0], hashlib.sha256(x[1].encode()).hexdigest()))
    for r, (i, t, ids) in zip(got, want, strict=True):
        assert str(r.doc_id) == i and r.n_tokens == len(ids) and list(r.ids) == ids
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert byte_bpe.encode_column(nothing, RANKS, PATTERN).count() == 0
    assert {r.n_tokens for r in byte_bpe.encode_column(odd.filter("text is null or text = ''"), RANKS, PATTERN).collect()} == {0}
