"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.encode_digests(table(spark, sf_dir, "documents"), bpe.Vocabulary(bpe.read_ranks(tokenizer_path())))


def op2_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sentence_spans

    out = sentence_spans.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_removed", "removed_bytes", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared")


def op4_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import audio

    return audio.digests(audio.audio_features(table(spark, sf_dir, "documents")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix

    # Passages of fifty words are shorter than 400 bytes as often as not: they are reported besides, as echoes.
    out = suffix.removed(table(spark, sf_dir, "documents"), 400, echo=160)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_echoed")


def op6_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.posterior(docs, quality.train(docs, labels), F.col("source"), F.col("lang"))


def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op8 on pages, whose addresses have hosts and paths; evidence is learned from the labelled documents."""
    from . import quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    pages = table(spark, sf_dir, "pages")
    host, path = quality.site(F.col("url"))
    texts = pages.select(F.col("page_id").alias("doc_id"), quality.page_text(F.col("html")).alias("text"), host.alias("host"), path.alias("path"))
    out = quality.posterior(texts, quality.train(docs, labels), F.col("host"), F.col("path"))
    return out.withColumnRenamed("doc_id", "page_id")


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, "op9", counts=True)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import collocations

    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import filter_audit

    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def op13_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import odd_sketch

    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if (name.startswith("op") or name == "page_quality") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import collocations, filter_audit, mixing, odd_sketch

    return {"op6_water_filling": mixing.SQL, "op11_collocations": collocations.SQL, "op12_filter_audit": filter_audit.SQL, "op13_odd_sketches": odd_sketch.SQL}
