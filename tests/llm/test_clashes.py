"""Every operator and stage on tables whose extra columns bear the names of helpers: all columns come back unchanged."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from signalbox.llm import chat_format, chat_repair, decontaminate, huffman, quality_model, secret_scan, simhash, whitening
from signalbox.llm.common import own_prefix
from signalbox.llm.queries import FILE_VOCABULARY, vocabulary
from signalbox.session import work_dir
from tests.llm.test_edges import LONG, OPERATORS

HELPERS = (
    "__text ___text __t __rests __m_email __p_iban __b_ssn __s_ip __e_card __h_phone __x_iban __key __given __clean __n __r __i __nrow __n0 __r0 __i0 "
    "__parts key row given text_ number block label order weight buckets shares table bias place least root component_ a b c d k r t x there kind "
    "piece steps ways audit ids file first n low high o0 id v __row __at"
).split()
TEXTS = [
    "My password: hunter2Zq9x and mail jane@example.org. " + "Some plain words follow here, and then others. " * 12,
    "My password: hunter2Zq9x and mail jane@example.org. " + "Some plain words follow here, and then others. " * 12, None, "", "one two three four five six", LONG,
]
DATA = "/root/testdata/sf0.001"


def table(spark, **more):
    rows = [(i if i != 2 else None, t, "en", *[f"{h}-{i}" for h in HELPERS]) for i, t in enumerate(TEXTS)]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, " + ", ".join(f"`{h}` string" for h in HELPERS))


def kept(rows, names):
    return sorted(tuple(str(r[n]) for n in names) for r in rows)


CASES = {
    **{name: operator for name, (operator, _) in OPERATORS.items() if name != "decontaminate"},
    "decontaminate": lambda df: decontaminate.decontaminate(df, df.sparkSession.createDataFrame([(1, "two three four")], "item_id int, text string")),
    "decontaminate in blocks": lambda df: decontaminate.decontaminate(df, df.sparkSession.createDataFrame([(i, f"two three {w}") for i, w in enumerate("four five six words".split())], "item_id int, text string"), block_bytes=40),
}


@pytest.mark.parametrize("name", CASES)
def test_operators_keep_all_columns(spark, name):
    df = table(spark)
    out = CASES[name](df)
    names = [c for c in df.columns if c in out.columns]
    assert set(HELPERS) - set(names) <= {"bits", "ids"}
    assert kept(out.collect(), ["doc_id", *HELPERS]) == kept(df.collect(), ["doc_id", *HELPERS])


def test_redact_and_deduplicate(spark):
    df = table(spark).withColumn("n_chars", F.length("text"))
    clean = secret_scan.redact(df, length="n_chars")
    assert clean.columns == df.columns and kept(clean.collect(), ["doc_id", *HELPERS]) == kept(df.collect(), ["doc_id", *HELPERS])
    for r in clean.collect():
        assert (r["n_chars"] is None) == (r["text"] is None) and (r["text"] is None or r["n_chars"] == len(r["text"]))
        assert "hunter2Zq9x" not in (r["text"] or "")
    once = simhash.deduplicate(df)
    rows = once.collect()
    assert once.columns == df.columns and {r["doc_id"] for r in rows} == {0, 3, 4, 5}  # 1 is a copy of 0; null and empty texts are alike
    assert set(kept(rows, HELPERS)) <= set(kept(df.collect(), HELPERS))
    assert secret_scan.redact(df.limit(0)).collect() == []


def test_operators_that_take_columns_by_name(spark):
    df = table(spark)
    chat = df.withColumn("conv_id", F.lit(1)).withColumn("turn", F.col("doc_id")).withColumn("role", F.lit("user"))
    assert sum(r["n_turns"] for r in chat_format.format_chat(chat).collect()) == 7
    assert chat_repair.repair(chat).summary().count() == 1
    folder = huffman.write_ids(df, vocabulary(FILE_VOCABULARY), work_dir(spark, "clash"))
    assert huffman.read_ids(spark, folder).count() == 7
    points = df.withColumn("vec_id", F.col("doc_id")).withColumn("embedding", F.array(F.lit(1.0) * F.coalesce("doc_id", F.lit(9)), F.rand(1)))
    assert whitening.whiten(points, whitening.fit(points)).count() == 14
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), *[c for c in HELPERS if c != "label"])
    assert quality_model.classify(df, quality_model.fit(df, labels)).count() == 7


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, number):
    df = table(spark).withColumn("n_chars", F.length("text"))
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, df, DATA)
    rows = out.collect()
    if number < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == df.columns and set(kept(rows, HELPERS)) <= set(kept(df.collect(), HELPERS))
    else:
        assert len(rows) == 7
    assert stage(spark, df.limit(0), DATA).collect() == []


def test_an_empty_benchmark_and_a_benchmark_of_blocks(spark):
    df = table(spark)
    none = spark.createDataFrame([], "item_id int, text string")
    assert {(r["n_hit"], r["contaminated"]) for r in decontaminate.decontaminate(df, none).collect()} == {(0, False)}
    bench = spark.createDataFrame([(i, f"{w} {v}") for i, (w, v) in enumerate(zip("plain words follow two".split(), "words follow here, three".split()))] + [(9, None)], "item_id int, text string")
    same = lambda out: sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"], r["runs"], r["contaminated"]) for r in out.collect())
    whole = same(decontaminate.decontaminate(df, bench))
    assert whole == same(decontaminate.decontaminate(df, bench, block_bytes=30)) and max(w[2] for w in whole) >= 40


def test_own_prefix(spark):
    assert own_prefix(spark.range(1)) == "__"
    assert own_prefix(spark.range(1).select(F.lit(1).alias("__A"), F.lit(2).alias("____b"))) == "_____"
