"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The ranks are read from a path (a parameter) on each Python worker. Long texts
are pre-split where the pattern always ends a match: before a space or line
feed that follows a character that is no white space, and between an ASCII
letter and an ASCII digit. Decoding joins the raw bytes of the ids.

Defined results: a null or empty text has no tokens; a text of special-token
strings is ordinary text; rows are independent, so repeated rows and ids give
repeated results; no documents give no rows. Columns other than the two that
are named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame

from tracemill.llm.common import map_texts

#: Texts of more characters are cut at the next safe boundary.
CHUNK = 1 << 15
_SAFE = re.compile(r"(?<=[!-~¡-ᙿ぀-鿿가-힣])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


@lru_cache(maxsize=4)
def encoding(rank_path: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, chunk: int = CHUNK) -> Iterator[str]:
    """The text in parts of about ``chunk`` characters, cut only where a match of the pattern always ends."""
    at = 0
    while len(text) - at > chunk:
        cut = _SAFE.search(text, at + chunk)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str, enc: tiktoken.Encoding, chunk: int = CHUNK) -> np.ndarray:
    if not text:
        return np.empty(0, np.uint32)
    parts = [np.array(enc.encode_ordinary(p), np.uint32) for p in pieces(text, chunk)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode(ids: Iterable[int], enc: tiktoken.Encoding) -> bytes:
    return enc.decode_bytes(list(ids))


def encode_column(docs: DataFrame, rank_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """id, n_tokens and ids (array of int)."""

    def rows_of(texts: list[bytes]) -> Iterable[tuple]:
        enc = encoding(rank_path, pattern)
        for t in texts:
            ids = encode(t.decode("utf-8", "replace"), enc, chunk)
            yield len(ids), ids.astype(np.int32)

    return map_texts(docs, id_col, text_col, [("n_tokens", "bigint"), ("ids", "array<int>")], rows_of)


def encode_and_decode(docs: DataFrame, rank_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, with_ids: bool = False) -> DataFrame:
    """id, n_tokens, digests of the ids (little-endian unsigned 32-bit) and of the decoded bytes; with_ids adds the ids."""
    fields = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")] + [("ids", "array<int>")] * with_ids

    def rows_of(texts: list[bytes]) -> Iterable[tuple]:
        enc = encoding(rank_path, pattern)
        for t in texts:
            ids = encode(t.decode("utf-8", "replace"), enc, chunk)
            row = len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode(ids.tolist(), enc)).hexdigest()
            yield (*row, ids.astype(np.int32)) if with_ids else row

    return map_texts(docs, id_col, text_col, fields, rows_of)
