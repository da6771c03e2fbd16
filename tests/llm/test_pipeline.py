"""The pipeline's stages, each on what the one before kept."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from engramlake.llm import decontamination, mixing

from .test_ops import brute_links


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        kept[name] = [r.doc_id for r in docs.collect()]
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if name == "language_id":
            assert {i for i, t in rows if re.search(r"[a-z]{4}", t or "")} <= set(kept[name]) <= {i for i, t in rows if re.search(r"[^\W\d_]", t or "")}
        if name == "ngram_join":
            assert set(kept[name]) == set(brute_links(rows)[1].values())
        if name == "decontamination":
            low = lambda t: " ".join(re.findall(r"\w+", t.lower()))
            exact = {i for i, t in rows if any(low(b) in low(t) for _, b in bench)}
            assert exact and not exact & set(kept[name])
            assert set(kept[name]) | {r.doc_id for r in decontamination.contaminated_passages(before, spark.createDataFrame(bench, "item_id long, text string")).collect()} == {i for i, _ in rows}
        if name == "mixing":
            rates = {r.doc_id: r.rate for r in mixing.mixing_rates(before, mixing.document_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), mixing.TARGETS).collect()}
            assert all(abs(kept[name].count(i) - r) < 1 + 1e-6 for i, r in rates.items())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(kept["mixing"])
    starts = sorted((r.start, r.n_tokens) for r in out)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_run_leaves_only_its_result(spark, sf_dir):
    from engramlake.llm import common

    with common.scratch_paths() as made:
        out = corpus_pipeline.run(spark, sf_dir)
    left = [p for p in made if _exists(p)]
    assert len(made) > 10 and out.count() > 0 and sorted(p.rpartition("/")[2].rpartition("-")[0] for p in left) == ["token-records", "token_records"]


def _exists(path):
    import os

    return os.path.exists(path.removeprefix("file://"))


def test_stages_on_nulls_empty_texts_and_repeats(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(900_001, None, None, None, None), (900_002, "", "en", "src1", 0), (None, "words without an id, but words they are", "en", "src1", 5), (900_003, "123 456", None, "src1", 7)]
    first = docs.limit(5)
    mixed = docs.union(first).union(spark.createDataFrame(odd, docs.schema)).withColumn("rate", F.lit("x")).withColumn("class_id", F.lit("y"))
    for few in (mixed, mixed.filter("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            few = corpus_pipeline.stored(stage(spark, few, sf_dir), "odd")
            assert few.columns == mixed.columns
        out = corpus_pipeline.STAGES[-1][1](spark, few, sf_dir)
        assert out.count() == few.count()
        ids = {r.doc_id for r in few.collect()}
        assert not ids & {900_001, 900_002, 900_003}
