"""Registered queries of the corpus operators, each over its whole table with production parameters, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline.llm import bpe, chat, exact_dedup, licenses, merkle, mixing, pii, prefix_trie, quality, simhash, token_counts, topk, warc
from pitline.llm.common import ascii_lowered, read, scratch_path, text_of

#: Part of every run's documents: more than this many tokens is over the limit.
TOKEN_LIMIT = 512
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weighed by the square root of their counts, as many rows as there are documents, in random order."""
    return mixing.mix(read(spark, sf_dir, "documents"), power=0.5).select("row.*", "copy")


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.format_windows(turns, together=True))  # the digests need a conversation in one row
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )


def vocabulary(spark: SparkSession) -> bpe.Vocabulary:
    return bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary(spark)
    encoded = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), words).select("row.doc_id", "ids", "n_tokens")
    back = bpe.decode(encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids"), words, ["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined(F.concat("base", "terms")).alias("spans"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    table = token_counts.CountTable(spark, public_tokenizers.path("byte_bpe_50k.json"), docs)
    return token_counts.count_tokens(docs, table).select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    manifest = warc.write(warc.with_revisits(pages), scratch_path(spark, "archives"), warc.payloads(pages))
    return warc.read_back(manifest, with_payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(ascii_lowered(text_of()).cast("binary"), 256).alias("text_sha256")  # of every row, as the result asks for it
    found = exact_dedup.groups(read(spark, sf_dir, "documents"), carry=F.struct("doc_id", digest))
    return found.select("row.doc_id", "keep_id", "group_size", "kept", "row.text_sha256")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    lowered = merkle.record([*values[:-1], ascii_lowered(F.col("text"))])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(docs, values, changed=F.when(chosen, lowered))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = prefix_trie.forked(prefix_trie.sequences(read(spark, sf_dir, "conversations")))
    return prefix_trie.trie(convs)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_chat_windows, op3_byte_bpe, op4_private_data, op5_quality_rules, op6_exact_top_k, op7_token_counts,
    op8_simhash_groups, op9_license_scan, op10_warc_archives, op11_exact_dedup, op12_merkle_manifest, op13_prefix_trie, pipeline,
)}
