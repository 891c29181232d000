"""What SQL can express of operators 2, 6, 8 and 10: their contracts' fixed columns, each through its operator, with that SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm import mpeg_audio, pii, secrets, sharding
from tracemill.llm.common import read


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.detect(read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.store_and_read(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and law of each document, and whether its shard's slots are gapless from 0."""
    rows = sharding.shard(read(spark, sf_dir, "documents"))
    own = Window.partitionBy("shard")
    gapless = (F.min("slot").over(own) == 0) & (F.max("slot").over(own) == F.count(F.lit(1)).over(own) - 1)
    return rows.select("doc_id", "size", "law", gapless.alias("gapless"))


QUERIES = {f.__name__: f for f in (pii_base_spans, secret_base_spans, media_payloads, shard_sizes)}


def _spans_sql(kinds: dict[str, tuple[str, str]]) -> str:
    """Counts and digest of the matches of each kind (pattern, condition on the match m) at their places in code points."""
    parts = []
    for order, (kind, (pattern, keep)) in enumerate(kinds.items()):
        parts.append(f"""SELECT doc_id, '{kind}' AS kind, {order} AS o, start, start + length(m) AS stop FROM (
  SELECT doc_id, m, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (
    SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM d) WHERE len(ms) > 0)
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {keep}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in kinds)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(parts)})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o), '')) AS base_sha256 FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_X = "substr(reverse(g), k + 1, 1)::INTEGER"
_LUHN = f"list_sum(list_transform(range(length(g)), lambda k: CASE WHEN k % 2 = 1 AND {_X} > 4 THEN 2 * {_X} - 9 WHEN k % 2 = 1 THEN 2 * {_X} ELSE {_X} END)) % 10"
_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(m, '.'), lambda p: coalesce(TRY_CAST(p AS HUGEINT), 999))) <= 255"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN.replace('(g)', f'({_DIGITS})')} = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
}
_ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = {
    "assign": (_ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 1)) >= 12"), "access": ("AKIA[A-Z0-9]+", "length(m) >= 18"), "hex": ("[0-9a-f]+", "length(m) >= 16"),
}

_CRC_STEP = "CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384::UBIGINT) ELSE b // 2 END"
_MEDIA = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, strlen(t)::BIGINT AS n, t || repeat(' ', (CASE WHEN strlen(t) = 0 THEN 192 ELSE (192 - strlen(t) % 192) % 192 END)::INTEGER) AS p FROM d),
h AS (SELECT *, right(hex(encode(p)), 32) AS tail FROM p)
SELECT doc_id, n AS n_bytes, strlen(p)::BIGINT AS payload_bytes, sha256(p) AS payload_sha256,
xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(16), lambda i: ('0x' || substr(tail, 1 + 2 * i, 2))::UBIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), [z::UBIGINT FOR z IN range(8)]), lambda b, z: {_CRC_STEP})), 4294967295::UBIGINT)::BIGINT AS tail_crc32 FROM h"""

SQL = {
    "pii_base_spans": _spans_sql(_PII), "secret_base_spans": _spans_sql(_SECRETS), "media_payloads": _MEDIA,
    "shard_sizes": "SELECT doc_id, (strlen(coalesce(text, '')) + 16)::BIGINT AS size, 'bytes' AS law, true AS gapless FROM documents",
}
