"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.llm import chat_format, chat_repair, decontaminate, huffman, license_scan, pii, quality_model, quality_rules, secret_scan, simhash, token_counts, whitening
from signalbox.llm.common import hex_digest, table
from signalbox.session import work_dir

#: Vocabularies, found by ``vocabulary``.
COUNT_VOCABULARY, ENCODE_VOCABULARY, FILE_VOCABULARY = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(key: str = "doc_id"):
    """Rows that a fit must not see."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["order"] < 4)
    of = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    counts = [of(k.name) for k in pii.KINDS if k.base]
    best = F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0))
    return found.select("doc_id", *counts, hex_digest(pii.joined(base)).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"), best.alias("best_score"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit(documents, table(spark, sf_dir, "labels").filter(~held_out()))
    scored = quality_model.classify(documents, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    parts = chat_format.format_chat(rows, block_turns=chat_format.BLOCK_TURNS)
    # Read back part by part; only the digests need a conversation's parts together.
    turns = chat_format.read_turns(F.col("formatted"))
    masked = chat_format.read_loss(F.col("formatted"), F.col("loss_spans"))
    read = parts.select(
        F.col("conversation").alias("conv_id"), "part", F.size(turns).cast("bigint").alias("n_turns"),
        F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join(masked, "").alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars"), "n_tokens",
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("part", "turns", "loss"))).alias("parts"),
        F.sum("formatted_chars").alias("formatted_chars"), F.sum("n_tokens").alias("n_tokens"),
    )
    join = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return whole.select(
        "conv_id", "n_turns", hex_digest(join("turns")).alias("turns_sha256"), F.length(join("loss")).cast("bigint").alias("loss_chars"),
        hex_digest(join("loss")).alias("loss_sha256"), "formatted_chars", "n_tokens",
    )


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.drop("text")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(COUNT_VOCABULARY))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from signalbox.llm import byte_bpe

    coded = byte_bpe.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(ENCODE_VOCABULARY), public_tokenizers.PATTERN, with_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        hex_digest(F.concat_ws(",", "items")).alias("items_sha256"), "contaminated",
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("secrets", lambda s: s["kind"] != "credential")
    return found.select("doc_id", *map(of, secret_scan.KINDS[:3]), hex_digest(written(base)).alias("base_sha256"), written(F.col("secrets")).alias("spans"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("licenses", lambda s: F.concat_ws(":", s["license"], s["start"].cast("string"), s["end"].cast("string")))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda s: s["license"])))
    return found.select("doc_id", F.size("licenses").cast("bigint").alias("n_licenses"), F.concat_ws(",", names).alias("licenses"), F.concat_ws(",", spans).alias("spans"))


def op11_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = huffman.write_ids(table(spark, sf_dir, "documents"), vocabulary(FILE_VOCABULARY), work_dir(spark, "token-files"))
    return huffman.read_ids(spark, folder, with_ids=False)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return whitening.whiten(embeddings, whitening.fit(embeddings))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = chat_repair.damage(table(spark, sf_dir, "conversations"))
    return chat_repair.repair(damaged, present="present").summary()


QUERIES = {f.__name__: f for f in (op1_pii, op2_quality, op3_chat, op4_rules, op5_simhash, op6_tokens, op7_bpe, op8_decontaminate, op9_secrets, op10_licenses, op11_huffman, op12_whitening, op13_repair)}
