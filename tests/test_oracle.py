"""Registered queries vs their DuckDB oracle at sf0.001 (a fast subset)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SMALL
from threadmill.plans import catalog
from tools.check_oracle import duck, rows_of

FAST = [
    "clean_posts", "drop_repeated_text", "replace_emoji", "label_pipeline", "keyword_search", "multi_seed_search",
    "store_upsert", "build_vocab", "wordpiece", "merge_short_sentences", "negative_pairs", "pad_and_mask",
    "mask_positions", "score_classifier", "f1_macro", "bce_loss", "sink_label_sheet", "stream_repeated_text",
    "pair_counts", "encode_claims", "encode_masked", "masked_predictor", "project_fields", "encode_pairs_topic", "batch_predict",
    "stream_upsert", "scan_sheet",
]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    df = E.queries()[name](spark, SMALL)
    cols = df.columns
    srows = [tuple(r) for r in df.collect()]
    cur = duck(SMALL).execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    assert rows_of(cols, srows) == rows_of(dcols, cur.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "text" in df.columns


def test_every_query_has_oracle_or_is_known_rows_only():
    rows_only = {"learn_merges", "build_vocab_merges"}
    catalog.load_all()
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == rows_only
