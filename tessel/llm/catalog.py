"""The queries opN_<name> of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import codes, decontaminate, html, jaccard, langid, mixing, recompress, repeats, sharding, tokens, topk, warc, whitening
from .common import drop, shared_dir


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark, sf_dir):
    return sharding.minimax_shards(_read(spark, sf_dir, "documents"))


def op2_langid(spark, sf_dir):
    return langid.identify(_read(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    return mixing.taken(_read(spark, sf_dir, "documents"))


def op4_warc(spark, sf_dir):
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op5_decontamination(spark, sf_dir):
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_tokens(spark, sf_dir):
    import public_tokenizers

    path = f"{shared_dir(spark)}/tessel/tokens-{uuid.uuid4().hex}"
    tokens.write(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    out = tokens.positions(tokens.read(spark, path))
    drop(spark, path)
    return out


def op7_repeats(spark, sf_dir):
    return repeats.dedup(_read(spark, sf_dir, "documents"))


def op8_topk(spark, sf_dir):
    return topk.top(_read(spark, sf_dir, "embeddings"))


def op9_html(spark, sf_dir):
    return html.extract(_read(spark, sf_dir, "pages"))


def op10_jaccard(spark, sf_dir):
    return jaccard.report(_read(spark, sf_dir, "documents"))


def op11_codes(spark, sf_dir):
    return codes.compress(_read(spark, sf_dir, "embeddings"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op13_recompression(spark, sf_dir):
    return recompress.report(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_langid, op3_mixing, op4_warc, op5_decontamination, op6_tokens, op7_repeats, op8_topk, op9_html, op10_jaccard, op11_codes, op12_whitening, op13_recompression)}


def _lloyd(rounds: int) -> str:
    """SQL of the product codes: all distances of each round."""
    sql = r"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, vec_id, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS x FROM v, (SELECT unnest(range(4)) AS part)),
c0 AS MATERIALIZED (SELECT part, entry, x FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id NULLS LAST, rid) - 1 AS entry, x FROM p) WHERE entry < 256),"""
    nearest = "min({{'d': list_inner_product(p.x::DOUBLE[], p.x::DOUBLE[]) - 2 * list_inner_product(p.x::DOUBLE[], c.x::DOUBLE[]) + list_inner_product(c.x::DOUBLE[], c.x::DOUBLE[]), 'e': entry}}) AS m FROM p JOIN c{0} c USING (part) GROUP BY rid, part"
    for i in range(rounds):
        sql += f"""
a{i} AS MATERIALIZED (SELECT rid, part, {nearest.format(i)}),
s{i} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (SELECT part, m.e AS entry, i, sum(p.x[i])::BIGINT AS s, count(*) AS n FROM a{i} JOIN p USING (rid, part), (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(s{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN s{i} USING (part, entry)),"""
    return sql + f"""
a AS (SELECT rid, part, {nearest.format(rounds)}),
r AS (SELECT rid, string_agg(lower(printf('%02x', m.e)), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256 FROM v JOIN r USING (rid)"""


SQL = {
    "op3_mixing": r"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
k AS (SELECT *, lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 2, 3) AS cls, substr(digest, 1, 2) AS sub FROM d),
s AS (SELECT skey, sum(size)::BIGINT AS source_size FROM k GROUP BY skey),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::BIGINT AS weight, 2 * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER b, 0)::DOUBLE) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
    FROM w WINDOW b AS (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM l WHERE cap / weight > level ORDER BY cap / weight, skey LIMIT 1),
t AS (SELECT skey, source_size, CASE WHEN cap / weight <= level THEN cap::DOUBLE ELSE weight * (SELECT level FROM f) END AS target,
    ('0x' || substr(md5('mix' || skey), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS shift FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY cls, sub, size, digest) AS rank FROM k)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size > 0 THEN
    (floor(rank::DOUBLE * (target / source_size::DOUBLE) + shift) - floor((rank - 1)::DOUBLE * (target / source_size::DOUBLE) + shift))::BIGINT * size ELSE 0 END)::BIGINT AS taken
FROM r JOIN t USING (skey)""",
    "op4_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM p""",
    "op5_decontamination": r"""
WITH b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, w[i:i + least(13, len(w)) - 1] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w, row_number() OVER () AS rid FROM documents),
p AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
h AS (SELECT rid, i, p.n AS n, item_id FROM p JOIN g ON g.n = p.n AND g.win = p.w[i:i + p.n - 1]),
c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM h) GROUP BY rid),
a AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN a USING (rid)""",
    "op7_repeats": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT rid, o, substr(x, 2 * o + 1, 2 * (1024 + 199)) AS part FROM (SELECT rid, x, unnest(range(0, greatest(length(x) // 2 - 199, 0), 1024)) AS o FROM d)),
w AS (SELECT rid, o + i AS p, md5(substr(part, 2 * i + 1, 400)) AS h FROM (SELECT rid, o, part, unnest(range(0, least(1024, length(part) // 2 - 199))) AS i FROM c)),
r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
m AS (SELECT rid, p FROM w SEMI JOIN r ON w.h = r.h),
n AS (SELECT rid, p, CASE WHEN p > lag(p) OVER (PARTITION BY rid ORDER BY p) + 200 THEN 1 ELSE 0 END AS fresh FROM m),
g AS (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS k FROM n),
s AS (SELECT rid, min(p) AS a, max(p) + 200 AS z FROM g GROUP BY rid, k),
k AS (SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS f, a - coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS size FROM s UNION ALL SELECT rid, max(z), NULL FROM s GROUP BY rid),
t AS (SELECT rid, string_agg(substr(x, 2 * f + 1, 2 * coalesce(size, length(x) // 2)), '' ORDER BY f) AS kept FROM k JOIN d USING (rid) GROUP BY rid),
u AS (SELECT rid, sum(z - a) AS removed, count(*) AS spans FROM s GROUP BY rid)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN t USING (rid) LEFT JOIN u USING (rid)""",
    "op8_topk": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_jaccard": r"""
WITH RECURSIVE t AS (SELECT text AS raw, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents)),
s AS (SELECT raw, row_number() OVER (ORDER BY raw) AS tid, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS items FROM t),
e AS (SELECT tid, unnest(items) AS item FROM s),
i AS (SELECT a.tid AS u, b.tid AS v, count(*) AS shared FROM e a JOIN e b ON a.item = b.item AND a.tid < b.tid GROUP BY 1, 2),
l AS (SELECT u, v FROM i JOIN s a ON a.tid = u JOIN s b ON b.tid = v WHERE 100 * shared >= 90 * (len(a.items) + len(b.items) - shared)),
g AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT tid AS u, tid AS v FROM s WHERE len(items) > 0 UNION SELECT r.u, g.v FROM r JOIN g ON g.u = r.v),
m AS (SELECT coalesce(text, '') AS raw, min(doc_id) AS least FROM documents GROUP BY 1),
c AS (SELECT r.u AS tid, min(least) AS least FROM r JOIN s ON s.tid = r.v JOIN m USING (raw) GROUP BY 1)
SELECT doc_id, len(items)::BIGINT AS n_shingles, CASE WHEN len(items) > 0 THEN least ELSE doc_id END AS component_id FROM documents d JOIN s ON s.raw = coalesce(d.text, '') LEFT JOIN c USING (tid)""",
    "op11_codes": _lloyd(4),
    "op13_recompression": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
h AS (SELECT rid, doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS k FROM g),
f AS (SELECT k, min({'d': doc_id, 's': s}) AS first FROM h GROUP BY k HAVING count(*) > 1),
m AS (SELECT rid, s FROM h JOIN f USING (k) WHERE doc_id <> first.d OR s > first.s),
c AS (SELECT DISTINCT rid, unnest(range(s, s + 20)) AS i FROM m),
r AS (SELECT rid, list(i) AS gone, count(*) AS n FROM c GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
    sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ') END) AS kept_sha256
FROM d LEFT JOIN r USING (rid)""",
}
