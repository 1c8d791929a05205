"""The pipeline over sf0.001, stage by stage against what each stage's operator is defined to do."""

import base64
import random

import public_tokenizers
import sentencepiece

import corpus_pipeline
from refrain.llm import decontamination
from tests.llm.test_operators import cut, dedup_by_definition, exact_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9000, None, "en", "s", 0), (9001, "12 34", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    now = stages["language_id"](spark, docs, SF).cache()
    assert now.columns == columns
    kept = {r.doc_id for r in now.collect()}
    assert not kept & {9000, 9001} and len(kept) == docs.count() - 2

    rows = [(r.doc_id, r.text) for r in now.collect()]
    after = stages["line_dedup"](spark, now, SF).cache()
    assert after.columns == columns
    lines_of, gone = dedup_by_definition(rows, 50)
    got = {r.doc_id: r for r in after.collect()}
    for i, t in rows:
        lines, out = lines_of[True, i, t], gone[True, i, t]
        if lines and len(out) == len(lines):
            assert i not in got
        else:
            assert [x for x in got[i].text.split("\n") if cut(x)] == [x for k, x in enumerate(lines) if k not in out] and got[i].n_chars == len(got[i].text)

    rows = [(r.doc_id, r.text) for r in after.collect()]
    single = stages["near_duplicates"](spark, after, SF).cache()
    _, component = exact_components(rows, 5, 80, 100)
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(i for i in component if component[i] == i)

    rows = [(r.doc_id, r.text) for r in single.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stages["decontamination"](spark, single, SF).cache()
    hit = {i for (i, _), x in zip(rows, decontamination.brute_force([t for _, t in rows], items, 10), strict=True) if x[1]}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - hit

    pieces = stages["packing"](spark, clean, SF)
    totals = {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert totals == {r.doc_id: len(sp.encode(r.text)) for r in clean.collect()}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_language_rejects_texts_in_no_language(spark):
    rng = random.Random(12)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(2, 9)))
    prose = ["ja ei on se hän että mutta niin kuin olla voida kaikki sekä joka minä sinä talo järvi metsä kaupunki puhua kävellä aurinko", "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой"]
    bad = [base64.b64encode(rng.randbytes(300)).decode() for _ in range(20)]
    bad += [rng.randbytes(300).hex() for _ in range(20)]
    bad += [" ".join(word("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(20)]
    bad += [x * 200 for x in "aeqxz"]
    bad += [" ".join(rng.choices(prose[i % 2].split(), k=60)) for i in range(40)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = [" ".join(r.text.split()[:2]) for r in docs.where("text is not null").orderBy("doc_id").limit(50).collect()]
    short = [t for t in short if 0 < sum(map(str.isalpha, t)) < 30]
    extra = [(9000 + i, t, None, "s", len(t)) for i, t in enumerate(bad + short)]
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(spark.createDataFrame(extra, docs.schema)), SF).collect()}
    missed = [i for i in range(len(bad)) if 9000 + i in kept]
    assert len(missed) <= 0.03 * len(bad), missed
    assert short and kept >= {9000 + len(bad) + i for i in range(len(short))}
    assert kept >= {r.doc_id for r in docs.where("text rlike '[a-zA-Z]'").collect()}
