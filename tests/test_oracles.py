"""Queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

from folioscan.plans import registry

SF = "/root/testdata/sf0.001"
SOME = [
    "src2_checksums", "ext2_merged_spans", "ext11_blocks", "ent2_matches", "sec12_decisions", "sec14_canonical",
    "chk13_chunks", "chk10_packing", "trm5_term_buckets", "qry1_normalized", "ret13_candidates", "ans9_answers",
    "ext1_rich_text", "sec15_validation", "chk14_validation", "ret4_match", "ret2_bm25", "ret4_top_search", "trm3_title_terms", "evd4_spans", "evd7_pack", "evl6_outcomes", "snk15_candidate_rows", "snk15_segment_rows", "snk15_citation_rows", "snk15_history",
]


def rows(df):
    cell = lambda v: "" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    df = df.astype(object).where(df.notna(), None)
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].values.tolist())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "events"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_twin(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry_imports_without_training_data():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
