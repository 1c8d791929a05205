"""What must hold for larger tables and odd texts, shown on small ones."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from refrain import queries
from refrain.functions import text
from refrain.plans import pipelines
from tests.test_entry import rows

SF = "/root/testdata/sf0.001"


def test_kmeans_cleans_each_song_once(spark, monkeypatch):
    seen, clean = spark.sparkContext.accumulator(0), pipelines.clean_b

    def counted(df):
        return clean(df).withColumn("lyrics_tokens", F.udf(lambda x: seen.add(1) or x, "array<string>")("lyrics_tokens"))

    monkeypatch.setattr(pipelines, "clean_b", counted)
    assert sum(r.n for r in queries.QUERIES["kmeans"](spark, SF).collect()) == seen.value > 0


ODD = ["\n a", "a \n", "\t\ttab\t", "\r\na\r\n", " NA ", '"', '"a" "', 'a\n"b",c\n', "\\", '\\"', ",", "\x00a\x00", "\ufeffa", "　a ", " ", "\n", "", None, "NA", "#a"]


@pytest.mark.parametrize("name", ["csv_songs_a", "csv_songs_b"])
def test_csv_keeps_odd_texts(spark, tmp_path, name):
    df = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(queries.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(duck.sql(queries.ORACLES[name]).df())


def test_cleaning_runs_side_by_side(spark):
    """Four tasks on four cores take little longer than one: no thread waits for what another writes."""

    def took(tasks):
        df = spark.range(0, 100 * tasks, 1, tasks).select(F.repeat(F.concat(F.lit("Some words, of a song "), F.col("id").cast("string"), F.lit(" that's sung.\n")), 800).alias("t"))
        began = time.perf_counter()
        df.select(text.clean(F.col("t"))).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    took(4)
    assert min(took(4) for _ in range(3)) < 2.5 * min(took(1) for _ in range(3))
