"""The operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.llm import (
    classifier, conversations, decontaminate, fingerprints, hard_negatives, licenses, lm_trie, near_dups, oracles,
    packing, quality_rules, secrets, sharding, token_counts)
from canvass.llm.common import small_batches

QUERIES: dict = {}
ORACLES: dict = {}
TOKENIZER = "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark, sf_dir):
            small_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def laid_out(docs):
    """Documents as files: source, language and thousand of ids are directories.

    A text that opens with a notice is the licence file of its directory.
    """
    opens = F.regexp_like(F.coalesce(F.substring_index("text", "\n", 1), F.lit("")), F.lit(licenses.CUES))
    name = F.when(opens, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), name)
    return docs.select("doc_id", path.alias("path"), "text")


@query("op1_licenses")
def op1(spark, sf_dir):
    return licenses.scan(laid_out(table(spark, sf_dir, "documents")))


@query("op2_packing")
def op2(spark, sf_dir):
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op3_decontamination", oracles.DECONTAMINATION)
def op3(spark, sf_dir):
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        decontaminate.items_digest().alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
        "longest", "longest_at", "longest_item")


@query("op4_quality_rules", oracles.QUALITY)
def op4(spark, sf_dir):
    return quality_rules.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"))


@query("op5_quality_classifier")
def op5(spark, sf_dir):
    path = F.concat_ws("/", "source", "lang")
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), path)


MAIL = r"[A-Za-z0-9._-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"


def mail_edits(text):
    """Every mail address gives way to a mark."""
    spans = secrets.matches(F.coalesce(text, F.lit("")), f"({MAIL})", 1, 1)
    return F.transform(spans, lambda s: F.struct(s["start"], s["end"], F.lit("[mail]").alias("text")))


@query("op6_token_counts")
def op6(spark, sf_dir):
    import public_tokenizers

    return token_counts.counts_after_edits(
        table(spark, sf_dir, "documents"), mail_edits(F.col("text")), tokenizer_path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN)


@query("op7_lm_scores")
def op7(spark, sf_dir):
    return lm_trie.score(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op8_near_dups")
def op8(spark, sf_dir):
    return near_dups.classes(table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


@query("op9_secrets", oracles.SECRETS)
def op9(spark, sf_dir):
    s = F.col("spans")
    return secrets.secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", *[secrets.count(s, k).alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(secrets.text_of(s, secrets.BASE), 256).alias("base_sha256"), secrets.text_of(s).alias("spans"),
        "n_live", "n_example", "n_weak", "most_owners")


@query("op10_sharding")
def op10(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op11_fingerprints", oracles.FINGERPRINTS)
def op11(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query("op12_hard_negatives", oracles.HARD_NEGATIVES)
def op12(spark, sf_dir):
    every = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, every)


@query("op13_conversations", oracles.CONVERSATIONS)
def op13(spark, sf_dir):
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.repaired(rows, F.col("here"))
