"""The queries of this folder's operators, over whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import base_queries, byte_bpe, hard_negatives, language_id, license_scan, merkle, mpeg_audio, pii, secrets, sharding, simhash, suffix_automaton, url_filter, warc
from tracemill.llm.common import UPPER, read, shared_folder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read(spark, sf_dir, "documents")).drop("all_spans")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_automaton.verdicts(suffix_automaton.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_and_decode(read(spark, sf_dir, "documents"), RANKS, PATTERN)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(read(spark, sf_dir, "documents"))
    one = lambda f: F.concat_ws(":", f["template"], f["start"].cast("string"), f["end"].cast("string"))
    return found.select("doc_id", "n_licenses", "license", "coverage", F.array_join(F.transform("finds", one), ",").alias("finds"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.store_and_read(read(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents")).drop("n_symbols")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.detect(read(spark, sf_dir, "documents")).drop("all_spans")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = [merkle.lowered(F.col("text")) if c == "text" else F.col(c) for c in merkle.COLUMNS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf(changed))
    return merkle.manifest(read(spark, sf_dir, "documents"), tampered=tampered)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(read(spark, sf_dir, "pages"), folder)
    return warc.records(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_pii, op3_decontamination, op4_byte_bpe, op5_licenses, op6_media, op7_url_filter, op8_sharding, op9_language_id, op10_secrets, op11_merkle_manifest, op12_warc, op13_hard_negatives)} | base_queries.QUERIES


def _url_sql() -> str:
    lower = lambda c: f"translate({c}, '{UPPER}', '{UPPER.lower()}')"
    has = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::BIGINT"
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1]))

    def fits(rule: str) -> str:
        own, _, prefix = rule.partition("/")
        return f"((host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{prefix}'))"

    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in rules)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in rules)
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return f"""
WITH p AS (
  SELECT page_id, {lower(f"regexp_extract(coalesce(url, ''), '{pattern}', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '{pattern}', 2) AS path, {lower("coalesce(url, '')")} AS u
  FROM pages),
c AS (
  SELECT page_id, host, path, {" + ".join(map(has, url_filter.STRICT))} AS n_strict, {" + ".join(map(has, url_filter.SOFT))} AS n_soft
  FROM p)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN n_strict >= 1 OR n_soft >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft
FROM c"""


def _decontamination_sql() -> str:
    words = lambda c: rf"regexp_extract_all(translate(coalesce({c}, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH i AS (SELECT item_id, {words("text")} AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), {suffix_automaton.WINDOW}) AS size FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS gram FROM (SELECT *, unnest(generate_series(1, len(w) - size + 1)) AS p FROM s)),
d AS (SELECT doc_id, {words("text")} AS w FROM documents),
g AS (SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS gram FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
m AS (SELECT DISTINCT g.doc_id, g.p, g.size, win.item_id FROM g JOIN win USING (size, gram)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + size - 1)) AS q FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


_HARD_NEGATIVES_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e AS a JOIN e AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""

def _merkle_sql(levels: int = 8) -> str:
    """Trees of up to 8 ** levels leaves, level by level; a level of one node stays as it is."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    step = "CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384::UBIGINT) ELSE b // 2 END"
    byte = f"list_reduce(list_prepend(xor(a, c), [z::UBIGINT FOR z IN range(8)]), lambda b, z: {step})"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, [ord(c)::UBIGINT FOR c IN string_split(doc_id::VARCHAR, '')]), lambda a, c: {byte}), 4294967295::UBIGINT)"

    def tree(name: str, group: str, base: str) -> str:
        """CTEs name0, name1, ... of (group, rank, n, d, l, r): digest, and siblings to the left and right."""
        out, beside = [], lambda rows: f"coalesce(string_agg(d, '') OVER (PARTITION BY {group}, rank // 8 ORDER BY rank ROWS BETWEEN {rows}), '')"
        sides = f"{beside('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {beside('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r"
        for k in range(levels + 1):
            nodes = base if k == 0 else f"SELECT {group}, rank // 8 AS rank, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY rank)) END AS d FROM {name}{k - 1} GROUP BY ALL"
            out.append(f"{name}{k} AS (SELECT *, {sides} FROM ({nodes}))")
        return ",\n".join(out)

    def path(name: str, group: str, rank: str) -> tuple[str, str]:
        joins = " ".join(f"JOIN {name}{k} ON {name}{k}.{group} = {group}_ AND {name}{k}.rank = {rank} // {8**k}" for k in range(levels))
        return joins, " || ".join(f"{name}{k}.l || {name}{k}.r" for k in range(levels))

    own, own_proof = path("a", "g", "rank_")
    top, top_proof = path("b", "t", "place_")
    rows = f"SELECT doc_id, coalesce('=' || lang, '') AS g_, row_number() OVER w - 1 AS rank_, count(*) OVER (PARTITION BY coalesce('=' || lang, '')) AS n_, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} ELSE {leaf('text')} END AS found FROM documents WINDOW w AS (PARTITION BY coalesce('=' || lang, '') ORDER BY doc_id NULLS FIRST, {leaf('text')})"
    steps = [(n, k) for n in "ab" for k in range(levels)]
    folded = ""
    for i, (n, k) in enumerate(steps):
        folded += f",\nf{i + 1} AS (SELECT * EXCLUDE (found), CASE WHEN n{n}{k} = 1 THEN found ELSE sha256(l{n}{k} || found || r{n}{k}) END AS found FROM f{i})"
    sides = ", ".join(f"{n}{k}.n AS n{n}{k}, {n}{k}.l AS l{n}{k}, {n}{k}.r AS r{n}{k}" for n, k in steps)
    return f"""
WITH x AS ({rows}),
{tree("a", "g", "SELECT g_ AS g, rank_ AS rank, n_ AS n, leaf AS d FROM x")},
{tree("b", "t", f"SELECT 0 AS t, row_number() OVER (ORDER BY g) - 1 AS rank, count(*) OVER () AS n, d FROM a{levels}")},
y AS (SELECT x.*, 0 AS t_, dense_rank() OVER (ORDER BY g_) - 1 AS place_ FROM x),
f0 AS (SELECT doc_id, leaf, found, a{levels}.d AS subroot, b{levels}.d AS root, sha256({own_proof} || {top_proof}) AS proof_sha256, {sides}
       FROM y {own} JOIN a{levels} ON a{levels}.g = g_ {top} CROSS JOIN b{levels}){folded}
SELECT doc_id, leaf, subroot, root, proof_sha256, found AS folded_root, found = root AS verified FROM f{len(steps)}"""


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4))) & 31))::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM f"""


SQL: dict[str, str] = {"op3_decontamination": _decontamination_sql(), "op7_url_filter": _url_sql(), "op11_merkle_manifest": _merkle_sql(), "op12_warc": _WARC_SQL, "op13_hard_negatives": _HARD_NEGATIVES_SQL} | base_queries.SQL
