"""One query per training-data operator, over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import chat, decontaminate, jaccard, language_model, licenses, media, oracles, pieces, pii, quality, repeats

#: The tokenizer file that queries use; operators take the path as a parameter.
PIECES_FILE = "piece_bpe_32k.model"


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECES_FILE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A conversation whose texts hold control strings.
HARD_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and conversation -7, and returns what reading the output back gives."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame(HARD_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(rows.unionByName(extra)))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text as a medium in a container with a wrong type, and returns what sniffing and carving read back."""
    return media.stored_and_sniffed(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item found in it, with the edit distance."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that also start elsewhere."""
    return repeats.removed(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of every document, and the spans of terms that disclose their entities."""
    return pii.found(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learnt from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (F.coalesce(quality.remainder(), F.lit(-1)) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every document by smoothed counts and by the recurrent model, learnt from those not held out."""
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(quality.remainder(n=10), F.lit(-1)) == 0
    found = language_model.scored(docs, ~out)
    return found.withColumn("held_out", out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near copies of every document."""
    return jaccard.near_copies(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or the nearest directory's."""
    return licenses.scan(licenses.path_of_documents(table(spark, sf_dir, "documents")), "path", "text")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document."""
    return pieces.encode_documents(table(spark, sf_dir, "documents"), piece_model_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_media_columns": op2_media_columns,
    "op3_decontaminate": op3_decontaminate,
    "op4_repeats": op4_repeats,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_lm_score": op7_lm_score,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_license_scan": op9_license_scan,
    "op10_pieces": op10_pieces,
}

#: The others hold what SQL can't express (models, merges, edit distances, media bytes) or not on whole tables (400-byte strings).
ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": oracles.chat_sql(chat.CHAT, HARD_CONVERSATION),
    "op8_jaccard_join": oracles.NEAR_COPIES_SQL,
    "op9_license_scan": oracles.licenses_sql(0.8, licenses.templates()),
}
