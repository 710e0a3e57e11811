"""The pipeline's stages take effect, in order, over what their predecessors kept."""

import os

from pyspark.sql import functions as F

import corpus_pipeline
from paymatch.llm import decontaminate, mixing, near_dups, quality, store

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF).cache())
    ids = [sorted(r.doc_id for r in k.select("doc_id").collect()) for k in kept]
    good = quality.score(docs, quality.fit(docs, labels)).where(f"score >= {quality.THRESHOLD}")
    assert ids[1] == sorted(r.doc_id for r in good.collect())
    assert ids[2] == sorted(r.doc_id for r in near_dups.near_duplicates(kept[1]).where("kept").collect())
    leaked = {r.doc_id for r in decontaminate.leaks(kept[2], items).collect()}
    assert leaked and ids[3] == [i for i in ids[2] if i not in leaked]
    uses = {r.doc_id: r.uses for r in mixing.mix(kept[3], F.array("source")).collect()}
    assert ids[4] == sorted(i for i, n in uses.items() for _ in range(n))
    assert ids[5] == ids[4]
    assert {r.shard for r in kept[5].collect()} <= set(range(40))
    for k in kept:
        k.unpersist()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "shard", "slot"]
    assert out.count() > 0


def test_clear_deletes_the_applications_tables(spark):
    df = store.save(spark.range(3), "three")
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder) and store.save(spark.range(2), "two").count() == 2
    store.drop(df)
    assert not os.path.exists(folder)
    store.clear(spark)
    assert not os.path.exists(os.path.dirname(folder))
