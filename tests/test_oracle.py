"""Registered queries against their check SQL at the smallest scale. By default a
sample that touches every module; BELIEFMILL_ALL=1 runs all of them."""

import os

import pytest

from beliefmill.plans import registry
from tests.oracle import compare, connect

registry.load_all()
SF = "/root/testdata/sf0.001"
SAMPLE = """recall_similarity recall_rrf recall_composed rerank_weighted list_page validate resolve_settings firewall log_odds event_dates
classify_type conversation_user_memories upsert_union apply_feedback feedback_log competition decay_pass seal_chain verify_tampered
beliefs_as_of confidence_history calibration learning_stats tune_policies adjusted_confidence reflect belief_cube entity_link_edges
resolve_entities activate_graph recall_hybrid derived_closure prune_graph admit_decisions admit_effects expire_log policy_excess
purge_subject_kept consolidate_beliefs form_schemas_new merge_activations spread assemble_context usage_stream learning_stream learning_stream_tumbling session_stream session_expiry_stream feedback_stream access_stream seal_stream
admit_in_order admit_stream build_graph build_graph_links activate_graph_links recall_hybrid_links
match_schemas active_schemas seal_canonical verify_canonical
sql_functions token_rows""".split()
NAMES = sorted(registry.CHECKS) if os.environ.get("BELIEFMILL_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    _, diff = compare(spark, con, name, SF)
    assert diff == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.CHECKS) - {"activate_context", "consolidate_counts"}))
def test_unchecked_query_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
