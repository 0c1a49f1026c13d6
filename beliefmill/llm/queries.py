"""The registered queries of this folder and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from beliefmill.llm import bit_slices, bpe_pairs, jaccard_join, language_id, license_scan, merkle_manifest, order_minhash, periodic_runs, run_index, stable_projection, token_edits, vector_packing, warc
from beliefmill.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {
    "op1_language_id": lambda spark, d: language_id.identify(table(spark, d, "documents")),
    "op2_license_scan": lambda spark, d: license_scan.scan(table(spark, d, "documents")),
    "op3_repeat_removal": lambda spark, d: run_index.repeat_report(table(spark, d, "documents")),
    "op4_token_recount": lambda spark, d: token_edits.recount(table(spark, d, "documents"), tokenizer("byte_bpe_50k.json")),
    "op5_exact_topk": lambda spark, d: bit_slices.search(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0),
    "op6_near_duplicates": lambda spark, d: order_minhash.near_duplicates(table(spark, d, "documents")),
    "op7_warc_salvage": lambda spark, d: warc.archive_report(table(spark, d, "pages")),
    "op8_stable_neighbours": lambda spark, d: stable_projection.search(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0),
    "op9_bpe_round_trip": lambda spark, d: bpe_pairs.round_trip(table(spark, d, "documents"), tokenizer("byte_bpe_50k.json")),
    "op10_vector_packing": lambda spark, d: vector_packing.pack_documents(table(spark, d, "documents"), tokenizer("word_bpe_49k.json")),
    "op11_jaccard_join": lambda spark, d: jaccard_join.components_of_links(table(spark, d, "documents")),
    "op12_periodic_runs": lambda spark, d: periodic_runs.periodic_runs(table(spark, d, "documents"), plant=True),
    "op13_merkle_manifest": lambda spark, d: merkle_manifest.tampered_manifest(table(spark, d, "documents")),
}

#: Every 400-byte string of every text, counted; what the repeated ones cover; what is left.
REPEATS_SQL = """
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    w AS (SELECT r, i, md5_number(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT r, x, unnest(range(greatest(len(x) // 2 - 399, 0))) AS i FROM t)),
    g AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
    c AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM w SEMI JOIN g USING (h)),
    n AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS s FROM c),
    s AS (SELECT r, min(i) AS lo, max(i) + 400 AS hi FROM n GROUP BY r, s),
    e AS (SELECT r, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY r ORDER BY lo) AS q FROM s),
    k AS (SELECT r, string_agg(substr(x, 2 * q + 1, 2 * (lo - q)), '' ORDER BY lo) AS head, max(hi) AS hi, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM e JOIN t USING (r) GROUP BY r)
    SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
           sha256(unhex(CASE WHEN hi IS NULL THEN x ELSE head || substr(x, 2 * hi + 1) END)) AS kept_sha256
    FROM t LEFT JOIN k USING (r)"""

CHECKS = {"op2_license_scan": license_scan.scan_sql(), "op3_repeat_removal": REPEATS_SQL, "op5_exact_topk": bit_slices.SEARCH_SQL, "op7_warc_salvage": warc.ARCHIVE_SQL, "op11_jaccard_join": jaccard_join.COMPONENTS_SQL, "op13_merkle_manifest": merkle_manifest.manifest_sql()}
