"""The operator's rule and its SQL on texts that the given tables lack."""

import duckdb

from signalbox.llm.oracles import ORACLES
from signalbox.llm.queries import op1_pii

TEXTS = [
    "ssn 123-45-6789, 234-56-7890 and 345-67-8901", "GB82 WEST 1234 5698 7654 32 Please call", "GB82 WEST 1234 5698 7654 32 DE89 3704 0044 0532 0130 00 X",
    "x" * 60 + "123-45-6789" + " " * 30 + "taxpayer", "taxpayer" + "." * 41 + "123-45-6789", "order 4111 1111 1111 1111 paid by card, +1 (386) 555-3733", None, "",
    "é contact a@b.c, d@e.f noreply g@h.i", "IBAN AB12 CODES FOR GB82 WEST 1234 5698 7654 32 BIC", "1.2.3.4 host 300.1.1.1 version 1.2.3.4", "GB82WEST12345698765432", "AB12" * 20,
]


def test_sql_states_the_rule(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = op1_pii(spark, str(tmp_path))
    result = db.execute(ORACLES["op1_pii"])
    names = [d[0] for d in result.description]
    want = {r[0]: dict(zip(names, r)) for r in result.fetchall()}
    assert {r["doc_id"]: {n: r[n] for n in names} for r in got.collect()} == want
    assert want[0]["spans"].count("ssn") == 3 and want[1]["spans"] == "iban:0:27"
