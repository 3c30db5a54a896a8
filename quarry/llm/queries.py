"""The registered queries of this subpackage, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, byte_bpe, cross_polytope, exact_topk, filter_audit, html_text, mixing, ngram_join, quality, suffix_dedup, unigram, vector_codes, warc
from quarry.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_round_trip(table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 comes as hexadecimal digits; base32 takes five of its bits at a time.
ORACLES["op5_warc"] = """
WITH s AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha1(h) AS x FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', x[i])]), '') AS bits,
 min(page_id) OVER (PARTITION BY x, n) AS first FROM s)
SELECT page_id, n AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(16 * CAST(bits[5*i+1] AS INTEGER) + 8 * CAST(bits[5*i+2] AS INTEGER) + 4 * CAST(bits[5*i+3] AS INTEGER)
  + 2 * CAST(bits[5*i+4] AS INTEGER) + CAST(bits[5*i+5] AS INTEGER) AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""


@query
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(table(spark, sf_dir, "embeddings"), k=5, every=50)


ORACLES["op8_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


@query
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.join_groups(table(spark, sf_dir, "documents"), width=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


#: Linked pairs (x, y) of documents, x < y, with i shingles in common of m in both, from all pairs that share a shingle.
NGRAM_PAIRS = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
 ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i, any_value(a.n) + any_value(b.n) AS m FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y, i, m FROM p WHERE 100 * i >= 90 * (m - i)),
k AS (SELECT y AS doc_id, min(x) AS class_id FROM p WHERE 2 * i = m GROUP BY y),
"""

ORACLES["op3_ngram_jaccard"] = NGRAM_PAIRS + """
g AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, g.y FROM r JOIN g ON r.node = g.x),
c AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id),
n AS (SELECT x AS doc_id, count(*) AS n_links FROM g GROUP BY x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, coalesce(class_id, s.doc_id) AS class_id, coalesce(n_links, 0) AS n_links
FROM s JOIN c ON s.doc_id = c.doc_id LEFT JOIN k ON s.doc_id = k.doc_id LEFT JOIN n ON s.doc_id = n.doc_id
"""


@query
def op3_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_links(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


#: Between the smallest documents of different sets.
ORACLES["op3_ngram_jaccard_links"] = NGRAM_PAIRS + """
h AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM k))
SELECT x AS a, y AS b, i / (m - i) AS similarity FROM l WHERE 2 * i < m AND x IN (SELECT doc_id FROM h) AND y IN (SELECT doc_id FROM h)
"""


@query
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), span=400, passage=suffix_dedup.PASSAGE)


@query
def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query
def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = {"good": 0.85, "good_toxic": 0.05, "low": 0.08, "low_toxic": 0.02}
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), weights)


@query
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


def codebook_round(i: int) -> str:
    """One round of assigning parts to codebook c{i} and averaging them to c{i + 1}."""
    return f"""
a{i} AS MATERIALIZED ({assigned(i)}),
m{i} AS (SELECT a.part, a.entry, k, CAST(sum(p.x[k]) AS BIGINT) AS s, count(*) AS n FROM a{i} a JOIN p USING (vec_id, part), range(1, 5) r(k) GROUP BY a.part, a.entry, k),
n{i} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY k) AS x FROM m{i} GROUP BY part, entry),
c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN n{i} n USING (part, entry)),
"""


def assigned(i: int) -> str:
    d = " + ".join(f"(p.x[{k}] - c.x[{k}]) * (p.x[{k}] - c.x[{k}])" for k in range(1, 5))
    return f"SELECT vec_id, p.part, arg_min(entry, ({d}) * 64 + entry) AS entry, min({d}) AS d FROM p JOIN c{i} c ON p.part = c.part GROUP BY vec_id, p.part"


#: For vectors of 64 components with distinct ids.
ORACLES["op12_vector_codes"] = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, e[4 * part + 1 : 4 * part + 4] AS x FROM v, range(16) r(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < 64),
{codebook_round(0)}{codebook_round(1)}
z AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM ({assigned(2)}) GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256
FROM z JOIN v USING (vec_id)
"""


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op13_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps FROM d),
f AS (SELECT doc_id, part, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b, 100 * caps > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS e,
 coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS g FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN e THEN 'D' ELSE '' END) || (CASE WHEN g THEN 'E' ELSE '' END) AS fails,
 count(*) AS n, count_if(coalesce(good, false)) AS good, count_if(coalesce(toxic, false)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM s a, s b, s c, s d, s e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
k AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own, left(filter_order, step - 1) AS before FROM o, range(1, 6) r(step)),
-- A mask with none of the letters of a string stays as it is without them.
r AS (SELECT part, filter_order, step, own,
 CAST(coalesce(sum(n) FILTER (WHERE translate(fails, before || own, '') = fails), 0) AS BIGINT) AS kept,
 CAST(coalesce(sum(n) FILTER (WHERE translate(fails, before, '') = fails AND contains(fails, own)), 0) AS BIGINT) AS removed,
 CAST(coalesce(sum(n) FILTER (WHERE translate(fails, before, '') <> fails AND contains(fails, own)), 0) AS BIGINT) AS redundant,
 CAST(coalesce(sum(n) FILTER (WHERE fails = own), 0) AS BIGINT) AS unique_fails,
 CAST(coalesce(sum(good) FILTER (WHERE translate(fails, before, '') = fails AND contains(fails, own)), 0) AS BIGINT) AS good_lost,
 CAST(coalesce(sum(toxic) FILTER (WHERE translate(fails, before, '') = fails AND contains(fails, own)), 0) AS BIGINT) AS toxic_lost
 FROM m, k GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
