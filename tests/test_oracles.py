"""Every query of a family against its SQL at the smallest size."""

import pytest

import __spark_entry__ as entry
from conftest import comparable
from textquarry.plans.oracles import oracle_sql
from textquarry.plans.queries import queries

CHECKED = [
    "clean_text", "tokenize", "split_compounds", "camel_split", "stopword_filter", "stem_vocabulary", "analysis_stage_counts", "field_view", "snippet",
    "chunk_overlap", "postings_field", "positions", "vbyte_sizes", "index_stats", "term_detail", "bm25_topk", "bm25f_topk", "maxp_topk", "zipf_fit",
    "rank_sample", "heaps_curve", "url_normalize", "url_classify", "sitemap_locs", "to_int", "clean_ws", "content_hash", "exact_duplicates", "frontier_next",
    "frontier_dedup", "frontier_counts", "requeue", "seed_cross", "hint_left_join", "robots_match", "outcome_histogram", "error_count", "crawl_rate", "fill_rate",
    "hourly_timeline", "crawl_summary", "last_block", "systematic_sample", "incident_runs", "hold_backoff", "stream_dedup", "stream_hourly",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, small, name):
    df = queries()[name](spark, small)
    cursor = duck.execute(oracle_sql()[name])
    want = comparable([c[0] for c in cursor.description], cursor.fetchall())
    assert comparable(df.columns, [tuple(r) for r in df.collect()]) == want


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
