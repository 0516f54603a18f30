"""Raw documents to token ids in five stages; each is written and read again before the next.

A stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``. A lost executor costs
the tasks of the running stage, not the stages before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.llm import byte_bpe, decontaminate, quality_model, secret_scan, simhash
from signalbox.llm.common import table
from signalbox.llm.queries import ENCODE_VOCABULARY, held_out, vocabulary
from signalbox.session import remove_work, work_dir, work_folders


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of its own input.

    Null and empty texts have the score of the bias; repeated rows are judged each for itself; an empty table stays
    empty; columns of any name come back unchanged. Texts of any length are read as a whole, here and in all stages.
    """
    model = quality_model.fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    marked = quality_model.classify(docs.select(F.struct("*").alias("row"), F.col("text").alias("__t")), model, "__t")
    return marked.filter("predicted = 1").select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.

    Null and empty texts are copies of each other; of repeated rows one stays; of a group without any doc_id one row
    stays; an empty table stays empty; columns of any name come back unchanged.
    """
    return simhash.deduplicate(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no, or hardly any, benchmark passages.

    Null and empty texts hold none; repeated rows are judged each for itself; an empty table stays empty, and an empty
    benchmark lets all pass; columns of any name come back unchanged.
    """
    marked = decontaminate.decontaminate(docs.select(F.struct("*").alias("row"), F.col("text").alias("__t")), table(spark, sf_dir, "benchmark"), "__t")
    return marked.filter(~F.col("contaminated")).select("row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts and n_chars brought up to date.

    Null texts stay null; repeated rows are cleaned each for itself; an empty table stays empty; other columns of any
    name come back unchanged.
    """
    return secret_scan.redact(docs, length="n_chars")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, and the digest of the bytes that they decode to.

    Null and empty texts have no ids; null keys and repeated rows stay; an empty table gives no rows; other columns are
    left out.
    """
    import public_tokenizers

    coded = byte_bpe.encode_and_decode(docs.select("doc_id", "text"), vocabulary(ENCODE_VOCABULARY), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("secrets", without_secrets),
    ("token ids", token_ids),
]

#: The classifier and the fingerprints have no SQL form; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, applied to the whole table ``documents``.

    What a stage has written for itself, and the result of the stage before it, go once its own result is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        known = set(work_folders(spark))
        out = work_dir(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        made = [f for f in work_folders(spark) if f not in known and f != out]
        remove_work(spark, made + ([before] if before else []))
        before = out
    return docs
