"""The operators over the tables of a data folder, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomlake.llm import bpe, cdc, chat, crf, lines, mixing, simhash, tokenscan, warc, weak
from roomlake.llm.memory import bounded_batches
from roomlake.storage import Workspace

#: Parameters of the queries.
RANKS = "byte_bpe_multi_50k.tiktoken"
END_OF_DOCUMENT = 50_256
SCORE_AT_LEAST = 0.3
MIX = mixing.MixPlan(
    levels=("domain", "lang", "source"),
    weights={"domain0": 40, "domain1": 30, "domain2": 20, "domain3": 10, "*/en": 50, "*/de": 20, "*/fr": 20, "*/es": 10},
    budget_percent=60,
    max_epochs=2,
    seed=7,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_labels(docs: DataFrame) -> dict[str, Column]:
    """The levels of the mixture: sources are dealt to four domains by their number."""
    number = F.regexp_extract(F.col("source"), r"(\d+)$", 1).try_cast("int")
    return {"domain": F.concat(F.lit("domain"), (number % 4).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def tokenizer(spark: SparkSession) -> bpe.Tokenizer:
    bounded_batches(spark)
    return bpe.Tokenizer(spark, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    read = warc.archive_and_deduplicate(pages, Workspace(spark, "warc"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixture = spark.createDataFrame([(-1, t, role, "</s>[INST] ok [/INST]") for t, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixture)
    read = chat.format_conversations(rows).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_trained(F.col("formatted"), F.col("loss_spans")).alias("trained"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        sha256(F.col("trained")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_simhash_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "simhash"), words=3)
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tokenizer(spark)
    return token_digests(tokens.decode(tokens.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))), "doc_id")


def token_digests(decoded: DataFrame, *keep: str) -> DataFrame:
    return decoded.select(
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, MIX, Workspace(spark, "mix"), labels=source_labels(docs)).select("doc_id", "domain", "lang", "source", "epoch")


def op6_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weak.quality_rules(table(spark, sf_dir, "documents"), Workspace(spark, "weak"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.drop_boilerplate(docs, Workspace(spark, "lines"), host=F.col("source"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    space, dtype = Workspace(spark, "tokens"), tokenscan.token_type(END_OF_DOCUMENT + 1)
    encoded = tokenizer(spark).encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = space.save(tokenscan.write_token_files(encoded, space.path("files"), separator=END_OF_DOCUMENT, dtype=dtype), "written")
    counted = tokenscan.count_tokens(written.select("path").distinct(), space, separator=END_OF_DOCUMENT, dtype=dtype)
    return written.join(counted, ["path", "ordinal"]).select("doc_id", "n_tokens")


def op9_chunk_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = crf.train(docs, table(spark, sf_dir, "labels"))
    scored = crf.score_documents(docs, field)
    return scored.select("doc_id", crf.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= SCORE_AT_LEAST).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc_revisit, op2_chat_format, op3_simhash_pivot, op4_byte_bpe, op5_source_mix, op6_weak_quality, op7_line_dedup, op8_token_counts, op9_chunk_fingerprint, op10_line_crf)
}
