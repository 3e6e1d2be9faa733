"""The queries of this subpackage, by name: each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, audit, chat, mixing, nearest, odd_sketch, pieces, prefix_trie, sharding, simhash, style_tree, toxicity, warc
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "pieces")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.slotted(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(audio.analysed(audio.store(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("\\### Assistant: </turn> ok")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return chat.digests(chat.read_back(chat.windows(turns.unionByName(own))))


#: A vocabulary of merges with byte fallback; only the driver reads the file.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    found = pieces.encoded(docs.withColumn("text_crc32", crc), pieces.load(VOCABULARY))
    return found.select("doc_id", "n_ids", "ids", "text_crc32", "decoded_crc32")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def op12_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_mixing, op2_simhash, op3_html, op4_warc, op5_sharding, op6_nearest, op7_audio, op8_chat, op9_sentencepiece, op10_toxicity, op11_prefix_trie, op12_odd_sketch, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": warc.SQL, "op8_chat": chat.SQL, "op11_prefix_trie": prefix_trie.SQL, "op12_odd_sketch": odd_sketch.SQL, "op13_filter_audit": audit.SQL}
