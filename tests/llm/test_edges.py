"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from signalbox.llm import byte_bpe, decontaminate, license_scan, pii, quality_model, quality_rules, secret_scan, simhash, token_counts
from signalbox.llm.queries import COUNT_VOCABULARY, ENCODE_VOCABULARY, vocabulary

LONG = "Mail jane.doe@example.org or 10.0.0.1, then read the rest of it. " * 800 + "x" * 20000
ROWS = [(1, "one two three four five", "a", 1), (1, "one two three four five", "a", 1), (2, None, None, None), (3, "", "b", 2), (None, "one two three", "c", 3), (4, LONG, "d", 4)]
SCHEMA = "doc_id bigint, text string, lang string, {} int"


def _bpe(df):
    import public_tokenizers

    return byte_bpe.encode_and_decode(df, vocabulary(ENCODE_VOCABULARY), public_tokenizers.PATTERN)


def _decontaminate(df):
    bench = df.sparkSession.createDataFrame([(1, "two three four"), (1, "two three four"), (None, None), (2, "")], "item_id int, text string")
    return decontaminate.decontaminate(df, bench)


OPERATORS = {
    "pii": (pii.find_pii, "pii"),
    "quality_model": (lambda df: quality_model.classify(df, quality_model.Model(quality_model.np.ones(1 << quality_model.BUCKET_BITS, "f4"), -1.0)), "score"),
    "quality_rules": (quality_rules.apply_rules, "kept"),
    "token_counts": (lambda df: token_counts.count_tokens(df, vocabulary(COUNT_VOCABULARY)), "n_tokens"),
    "byte_bpe": (_bpe, "n_tokens"),
    "decontaminate": (_decontaminate, "n_hit"),
    "secret_scan": (secret_scan.find_secrets, "secrets"),
    "license_scan": (license_scan.scan_licenses, "licenses"),
    "fingerprints": (simhash.fingerprints, "bits"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_survive(spark, name):
    operator, column = OPERATORS[name]
    out = operator(spark.createDataFrame(ROWS, SCHEMA.format(column.upper())))
    assert [c.lower() for c in out.columns].count(column) == 1  # replaced, whatever its case
    rows = out.collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["text"]), []).append(r[column])
    assert len(by[1, ROWS[0][1]]) == 2 and by[1, ROWS[0][1]][0] == by[1, ROWS[0][1]][1]
    assert by[2, None] == by[3, ""]  # null is the empty text
    assert all(v is not None for values in by.values() for v in values)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    operator, column = OPERATORS[name]
    assert operator(spark.createDataFrame([], SCHEMA.format("other"))).select(column).collect() == []


def test_edge_values(spark):
    df = spark.createDataFrame(ROWS, SCHEMA.format("other"))
    spans = {r["doc_id"]: r["pii"] for r in pii.find_pii(df).filter("doc_id is not null").collect()}
    assert spans[2] == spans[3] == [] and len(spans[4]) == 1600
    unit = len("Mail jane.doe@example.org or 10.0.0.1, then read the rest of it. ")
    assert [(s["kind"], s["start"]) for s in spans[4][:2]] == [("email", 5), ("email", 5 + unit)]
    hits = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in _decontaminate(df).filter("doc_id is not null").collect()}
    assert hits[1] == (5, 3, ["1"], True) and hits[2] == hits[3] == (0, 0, [], False)


def test_long_runs_take_linear_time(spark):
    n = 20_000
    texts = [c * (n // len(c)) for c in ("a", "1", "A", "1.", "+1", "(", "AB12", "a@", "a@b.", "'", "password", "AKIA")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    assert df.count() == pii.find_pii(df).select(F.size("pii")).filter("size(pii) >= 0").count()
    assert [len(secret_scan.find_in(t)) >= 0 for t in texts]
    assert [len(license_scan.recognise(t + "license")) >= 0 for t in texts]
