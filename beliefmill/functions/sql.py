"""SQL surface: scalar functions by name (they inline into the plan) and a
tokeniser as a table function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLIP = "CASE WHEN p < 0.01D THEN 0.01D WHEN p > 0.99D THEN 0.99D ELSE p END"
DEFINITIONS = {
    "bm_logit(p DOUBLE) RETURNS DOUBLE": f"ln(({CLIP}) / (1 - ({CLIP})))",
    "bm_sigmoid(x DOUBLE) RETURNS DOUBLE": "1 / (1 + exp(-x))",
    "bm_logodds(p DOUBLE, delta DOUBLE) RETURNS DOUBLE": "greatest(0.01D, least(0.99D, bm_sigmoid(bm_logit(p) + delta)))",
    "bm_tier(c FLOAT) RETURNS STRING": "CASE WHEN CAST(c AS DOUBLE) > 0.85D THEN 'hot' WHEN CAST(c AS DOUBLE) > 0.70D THEN 'warm' WHEN CAST(c AS DOUBLE) > 0.40D THEN 'cold' ELSE 'archive' END",
    "bm_decay_status(c FLOAT) RETURNS STRING": "CASE WHEN c >= CAST(0.7 AS FLOAT) THEN 'healthy' WHEN c >= CAST(0.4 AS FLOAT) THEN 'decaying' ELSE 'at_risk' END",
    "bm_binding(anchor BIGINT, session BIGINT) RETURNS STRING": "CASE WHEN session IS NOT NULL THEN 'session' WHEN anchor IS NOT NULL THEN 'anchored' ELSE 'private' END",
    "bm_recency(days DOUBLE) RETURNS DOUBLE": "exp(-days / 30)",
}


def register_functions(spark: SparkSession) -> list[str]:
    names = []
    for head, body in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.split("(")[0])
    return names


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def register_table_functions(spark: SparkSession) -> None:
    """SELECT * FROM bm_tokens('some text')"""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION bm_tokens(content STRING) RETURNS TABLE(token STRING, pos INT) "
              "RETURN SELECT t.token, t.pos FROM posexplode(regexp_extract_all(lower(content), '[a-z0-9]+', 0)) AS t(pos, token)")
