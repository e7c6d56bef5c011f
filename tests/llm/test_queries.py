"""The registered queries that have SQL against DuckDB, the others against their operators' columns."""

import pytest

from check_oracle import compare
from sslspark.llm.queries import ORACLE, QUERIES
from tests.conftest import SF01, SF001

COLUMNS = {
    "op1_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op2_simhash": ["doc_id", "fingerprint", "component_id"],
    "op3_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op7_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op10_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op11_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12_source_divergence": ["lang", "source", "part", "item", "value", "rank"],
    "op13_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck01, name):
    ok, message = compare(QUERIES[name](spark, SF01).toPandas(), duck01.sql(ORACLE[name]).df())
    assert ok, message


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_has_the_agreed_columns(spark, name):
    out = QUERIES[name](spark, SF001)
    assert out.columns[:len(COLUMNS[name])] == COLUMNS[name]
    assert out.count() > 0
