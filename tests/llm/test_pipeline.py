"""The stages' decisions on the given rows, against what the operators say."""

import corpus_pipeline
from pyspark.sql import functions as F

from signalbox.llm import decontaminate, secret_scan, simhash

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    given = docs.columns
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(i))
        stage(spark, docs, DATA).write.parquet(out)
        after = spark.read.parquet(out)
        rows = {r["doc_id"]: r for r in after.collect()}
        assert len(rows) == after.count() and set(rows) <= set(kept)
        if i < 4:
            assert after.columns == given
        if name == "near-duplicates":
            found = simhash.near_duplicates(docs).collect()
            assert set(rows) == {r["component_id"] for r in found}
        elif name == "decontamination":
            marked = decontaminate.decontaminate(docs, spark.read.parquet(f"{DATA}/benchmark.parquet"))
            assert set(rows) == {r["doc_id"] for r in marked.filter("not contaminated").collect()}
        elif name == "secrets":
            assert set(rows) == set(kept)
            for k, r in rows.items():
                clean = not secret_scan.find_in(kept[k] or "")
                assert (r["text"] == kept[k]) == clean
        elif name == "token ids":
            assert set(rows) == set(kept) and all(r["n_tokens"] == len(r["token_ids"]) for r in rows.values())
        kept = {k: r["text"] for k, r in rows.items()} if "text" in after.columns else kept
        docs = after


def test_clashing_names_and_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0).withColumn("score", F.lit(1)).withColumn("row", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.collect() == []
