"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, embeddings, importance, jaccard, language_model, licences, lines, mixing, quality, site_trees, token_files, toxicity, vector_codes
from tidemark.llm.labelled import fold
from tidemark.session import write_through


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of documents that match a licence template."""
    return licences.scan(table(spark, folder, "documents").select("doc_id", "text"))


def _classified(scored: DataFrame, folds: int, out: int) -> DataFrame:
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; learnt from rows outside fold 0 of 5."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels"), fold(F.col("doc_id"), 5) != 0)
    return _classified(toxicity.tag(docs, model), 5, 0)


def op3_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return jaccard.near_duplicates(table(spark, folder, "documents"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document; learnt from rows outside fold 1 of 3."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, folder, "labels"), fold(F.col("doc_id"), 3) != 1)
    return _classified(quality.score(docs, model), 3, 1)


def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = site_trees.extract(table(spark, folder, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of all documents; learnt from those outside fold 2 of 7."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return language_model.score(docs, fold(F.col("doc_id"), 7) == 2)


def op7_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors."""
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's place, length and checksum, from the files of ids."""
    written = token_files.write(table(spark, folder, "documents").select("doc_id", "text"))
    return token_files.documents(spark, written).withColumnRenamed("key", "doc_id")


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of each document."""
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document inside benchmark windows, and the items they come from."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    marked = decontamination.contaminated(docs, table(spark, folder, "benchmark"))
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's lines, and what stays of it once shared lines are gone."""
    kept = lines.kept_text(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of all usable vectors, and the error of each label."""
    coded, books = vector_codes.compress(table(spark, folder, "embeddings"), keep=["vec_id", "label"])
    coded = write_through(coded, "codes")
    # One row per label; Spark sees its size before it chooses the join.
    per = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    joined = coded.join(per, coded["label"].eqNullSafe(per["of"]))
    digest = F.lit(books.sha256 if books else None).cast("string")
    return joined.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of all documents towards the benchmark, and the ranks of those drawn."""
    drawn = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_quality": op4_quality,
    "op5_html_extraction": op5_html_extraction,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_token_files": op8_token_files,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
    "op11_line_dedup": op11_line_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_importance_resampling": op13_importance_resampling,
}
