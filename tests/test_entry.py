"""The driver's contract: names, columns, and every query with a DuckDB twin against it."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from refrain import queries

SF = "/root/testdata/sf0.001"
QUICK = ["clean_a", "count_correlation", "csv_lists", "csv_songs_a", "csv_songs_b", "dedupe_first", "default_columns", "filler_words", "group_mean_score_rounded", "langid_filter", "lemma_rules", "lexicon_group_counts", "lexicon_tsv", "ratio_regression", "regression_line", "sample_n", "score_histogram", "song_stats", "song_stats_rounded", "stage_parquet", "tfidf_similar", "top_songs", "translation_fix", "treebank_tokens", "word_freq", "year_filter"]


def rows(frame):
    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return round(float(x), 6) if isinstance(x, int | float) or hasattr(x, "dtype") else str(x)

    names = sorted(frame.columns)
    return names, sorted((tuple(map(value, r)) for r in frame[names].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_twin(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(queries.ORACLES[name]).df())


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries()) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert contract.entry(spark).columns
