"""Physical plans: what is pushed to scans, and that Python stays out of relational queries."""

from __future__ import annotations

import re

import pytest

from loomstone.plans.registry import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["status_rows"](spark, sf)._jdf.queryExecution().toString()
    assert "EqualTo(event_type,purchase)" in plan and "EqualTo(user_id,7)" in plan
    assert re.search(r"ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>", plan)


PYTHON = {"short_folders_blake2b", "general_number_format", "bit_error_rates", "stochastic_tags", "cache_keys", "principal_order", "greedy_order", "gaussian_statistics", "injected_tokenizer"}


@pytest.mark.parametrize("name", ["language_token_entropy", "distinct_3", "vocabulary", "token_bits", "secded_repairs", "speaker_conditioned_rows", "upserted_results", "neighbourhoods", "word_error_rate", "noise_schedule"])
def test_no_python_and_no_cartesian_product(spark, sf, name):
    plan = _plan(QUERIES[name](spark, sf))
    assert not re.search(r"Python|Arrow|Pandas|CartesianProduct", plan)


@pytest.mark.parametrize("name", ["language_token_entropy", "repetition_2", "detokenised_text"])
def test_words_of_documents_are_not_shuffled(spark, sf, name):
    """What moves is partial sums per language, or nothing."""
    plan = _plan(QUERIES[name](spark, sf))
    assert not re.search(r"Exchange hashpartitioning\([^)]*doc_id", plan) and "Generate" not in plan


@pytest.mark.parametrize("name", ["encoded_documents", "packed_blocks", "wrapped_blocks", "flat_stream"])
def test_tokens_are_looked_up_in_their_rows(spark, sf, name):
    """What is moved are whole runs of ids and parts of them; no row per token is made."""
    plan = _plan(QUERIES[name](spark, sf))
    explodes = re.findall(r"Generate (\w+)\(", plan)
    assert "posexplode" not in explodes and "MapInArrow" in plan and not re.search(r"Exchange hashpartitioning\(word", plan) and len(explodes) <= 1
