"""The pipeline against the same five decisions taken by plain code on the operators' contracts."""

from collections import Counter

import corpus_pipeline
import pytest
from lexloom.llm import mixing, quality
from lexloom.llm.common import fold
from pyspark.sql import functions as F
from test_dedup import SPACES, brute_components, plain_fingerprint
from test_texts import plain_contamination


def staged(spark, docs, sf_dir, tmp_path, stages):
    for k, (_, stage) in enumerate(stages):
        path = str(tmp_path / f"stage{k}-{len(stages)}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def plain_pipeline(spark, rows, bench, keep):
    """rows: dicts with id, text, source and more; keep: ids that the classifier keeps."""
    rows = [r for r in rows if r["doc_id"] in keep]
    best = {}
    for r in rows:
        key, rank = SPACES.sub("", r["text"] or ""), (-len(r["text"] or ""), r["doc_id"])
        best[key] = min(best.get(key, (rank, r["doc_id"])), (rank, r["doc_id"]), key=lambda x: x[0])
    firsts = {x[1] for x in best.values()}
    rows = sorted((r for r in rows if r["doc_id"] in firsts), key=lambda r: r["doc_id"])
    top = brute_components([plain_fingerprint(r["text"]) for r in rows])
    seen, kept = set(), []
    for r, t in zip(rows, top, strict=True):
        if t not in seen:
            seen.add(t)
            kept.append(r)
    dirty = {c[0] for c in plain_contamination([(r["doc_id"], r["text"]) for r in kept], bench) if c[5]}
    return [r["doc_id"] for r in kept if r["doc_id"] not in dirty]


def test_pipeline_is_the_plain_one(spark, tmp_path):
    sf = tmp_path / "in"
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet").where("length(text) < 20000 or text is null").dropDuplicates(["doc_id"])
    docs.coalesce(2).write.parquet(str(sf / "documents.parquet"))
    spark.read.parquet(f"{source}/labels.parquet").write.parquet(str(sf / "labels.parquet"))
    bench = spark.read.parquet(f"{source}/benchmark.parquet")
    bench.write.parquet(str(sf / "benchmark.parquet"))
    docs = spark.read.parquet(str(sf / "documents.parquet"))
    labels = spark.read.parquet(str(sf / "labels.parquet"))
    model = quality.fit(docs.where(fold("doc_id", 4) != 2), labels.where(fold("doc_id", 4) != 2))
    keep = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    want = plain_pipeline(spark, [r.asDict() for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()], keep)
    before = staged(spark, docs, str(sf), tmp_path, corpus_pipeline.STAGES[:-1])
    assert before.columns == docs.columns and sorted(r.doc_id for r in before.collect()) == sorted(want)
    copies = {r.doc_id: r.copies for r in mixing.mix(before).select("doc_id", "copies").collect()}
    got = corpus_pipeline.run(spark, str(sf))
    assert Counter(r.doc_id for r in got.collect()) == Counter({d: c for d, c in copies.items() if c})


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_stages_on_odd_tables(spark, clashing, odd_labels, no_labels, tmp_path, kind):
    sf = str(tmp_path / "in")
    docs = clashing if kind == "odd" else clashing.where("false")
    docs.write.parquet(f"{sf}/documents.parquet")
    (odd_labels if kind == "odd" else no_labels).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k in range(1, 5):
        left = staged(spark, docs, sf, tmp_path, corpus_pipeline.STAGES[k:])
        assert left.count() > 0 if kind == "odd" else left.count() == 0
        if k < 4:
            assert corpus_pipeline.STAGES[k][1](spark, docs, sf).columns == docs.columns
    kept = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert kept.columns == docs.columns and kept.where(F.col("score") != 0.5).count() == 0
    assert corpus_pipeline.run(spark, sf).columns == docs.columns
