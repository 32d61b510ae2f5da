"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from growthcast.llm import alignment, bpe, collisions, jaccard, language, mixing, negatives, pages, substrings, tokens, topk, toxicity, warc
from growthcast.llm.common import table
from growthcast.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


@query("op1_ngram_jaccard", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS x FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
linked AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, linked.b FROM reach JOIN linked ON linked.a = reach.r)
SELECT reach.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id""")
def op1(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query("op2_page_text")
def op2(spark, sf_dir):
    return pages.extract(table(spark, sf_dir, "pages"))


def token_digests(encoded):
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op3_bpe_round_trip")
def op3(spark, sf_dir):
    return token_digests(bpe.encode(table(spark, sf_dir, "documents")))


@query("op4_toxicity")
def op4(spark, sf_dir):
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op5_embedding_near_dedup")
def op5(spark, sf_dir):
    return collisions.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op6_token_counts")
def op6(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


@query("op7_exact_top_k", """
WITH v AS (SELECT vec_id, [floor(x::DOUBLE * 256) FOR x IN embedding] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op7(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SIZES = r"""
sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS most FROM sources),
filled AS (SELECT *, row_number() OVER (ORDER BY most / weight, source ASC NULLS LAST) AS r,
    (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS lvl FROM weighted),
opened AS (SELECT *, min(CASE WHEN most / weight >= lvl THEN r END) OVER () AS first_open FROM filled),
targets AS (SELECT source, source_size, CASE WHEN r >= first_open THEN weight * (SELECT lvl FROM opened WHERE r = first_open) ELSE most::DOUBLE END AS target FROM opened),
queued AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target, md5(coalesce(doc_id::VARCHAR, '')) AS k,
    sum(size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS run
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
items AS (SELECT *, (run + source_size * p)::BIGINT / target AS t FROM queued, (VALUES (0), (1), (2)) AS passes(p) WHERE size > 0),
taken AS (SELECT doc_id, source, k, size, t, sum(size) OVER (ORDER BY t, k) AS upto FROM items),
sums AS (SELECT doc_id, source, size, sum(size) AS taken FROM taken WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY ALL)
"""


@query("op8_source_mixing", f"""WITH {SIZES}
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(s.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN sums s ON q.doc_id = s.doc_id AND q.source IS NOT DISTINCT FROM s.source AND q.size = s.size""")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_substring_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
again AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM again),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""")
def op10(spark, sf_dir):
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op9_warc_revisits")
def op9(spark, sf_dir):
    """Both captures of every page, written as WARC bytes and read again, with revisits resolved."""
    captures = warc.records(warc.captures_of_pages(table(spark, sf_dir, "pages")))
    return warc.resolve(captures).withColumn("headers", warc.sorted_json(F.col("headers")))


@query("op11_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(x::DOUBLE * 256) FOR x IN embedding] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS anchor_id, c.vec_id, c.label = q.label AS alike, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND len(q.e) = len(c.e) WHERE c.label <> q.label OR c.vec_id <> q.vec_id),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM scored WHERE alike) WHERE r <= 5),
ranked AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3""")
def op11(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


@query("op12_language_id")
def op12(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query("op13_token_alignment")
def op13(spark, sf_dir):
    return alignment.alignment(table(spark, sf_dir, "documents"))
