"""Stems and keyword search."""

import pytest
from pyspark.sql import functions as F

from beliefmill.functions.stems import stems
from beliefmill.operators import recall as rc

# published pairs of the algorithm
KNOWN = """consigned consign consignment consign consistency consist consistently consist consolatory consolatori console consol consolingly consol
consonant conson conspicuously conspicu conspiracy conspiraci conspirator conspir constable constabl knackeries knackeri knaves knave kneading knead
kneeling kneel knees knee knightly knight knitting knit knives knive knockers knocker topics topic users user hopping hop hoping hope flies fli ties tie
cries cri gas gas this this gaps gap agreed agre feed feed luxuriated luxuri generate generat generic generic generously generous communism communism
community communiti arsenal arsenal skis ski dying die news news inning inning proceed proceed happy happi say say cry cri by by relational relat
rational ration conditional condit sensitivity sensit adoption adopt replacement replac adjustable adjust youth youth boys boy a1s a1s été été""".split()


def test_stems_known_answers(spark):
    words, want = KNOWN[::2], KNOWN[1::2]
    assert spark.createDataFrame([(words,)], "w array<string>").select(stems(F.col("w"))).first()[0] == want


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, 1, i % 3, t) for i, t in enumerate(["users like topics", "the user likes a topic", "a topic of topics", "users", None, "", "Running topics, user run"] + ["common words"] * 40)]
    return spark.createDataFrame(rows, "id long, tenant_id long, agent_id long, content string")


def found(spark, corpus, *queries):
    q = spark.createDataFrame([(i, 1, a, t) for i, (a, t) in enumerate(queries)], "query_id long, tenant_id long, agent_id long, text string")
    return {(r.query_id, r.id) for r in rc.lexical_scores(corpus, q).collect()}


def test_other_forms_are_found(spark, corpus):
    assert found(spark, corpus, (None, "topics user")) == {(0, 0), (0, 1), (0, 6)} == found(spark, corpus, (None, "users topic"))
    assert found(spark, corpus, (1, "topic user"), (0, "ran topic"), (0, "runs topic")) == {(0, 1), (2, 6)}


def test_queries_without_hits(spark, corpus):
    assert found(spark, corpus, (None, ""), (None, "the of"), (None, "topic nowhere"), (7, "topic"), (None, None)) == set()
    assert rc.lexical_scores(corpus.limit(0), spark.createDataFrame([(1, 1, None, "topic")], "query_id long, tenant_id long, agent_id long, text string")).count() == 0
