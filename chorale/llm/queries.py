"""The registered queries of this package, each the thin application of its operator to a whole table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm import sql
from chorale.llm.exact_dedup import exact_dedup
from chorale.llm.jaccard_join import jaccard_join
from chorale.llm.language_id import held_out, identify, learn
from chorale.llm.language_model import score_texts
from chorale.llm.line_dedup import line_dedup
from chorale.llm.packing import pack_documents
from chorale.llm.pieces import encode_and_decode
from chorale.llm.quality import quality_cascade
from chorale.llm.resampling import resample
from chorale.llm.runs import find_runs
from chorale.llm.shared import let, n_words, words
from chorale.llm.sharding import shard_documents
from chorale.llm.url_filter import UrlRule, url_verdicts, with_parts
from chorale.llm.warc import archive_pages


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_read(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    docs = quality_cascade(_read(spark, sf_dir, "documents"), keep_stats=shown)
    base_failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return docs.select("doc_id", *shown, base_failed.alias("base_failed"), F.col("_kept").alias("kept"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_documents(_read(spark, sf_dir, "documents"), 24)
    return shards.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "set_id", "set_size", "n_links")


#: The model that op5 encodes with; only the driver reads it.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    out = encode_and_decode(_read(spark, sf_dir, "documents"), Path(model).read_bytes())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_xxhash64"), "n_chunks", F.md5("decoded").alias("decoded_md5"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents")).withColumnRenamed("fingerprint", "text_sha256")


URL_RULES = (
    UrlRule("allow", "com"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)
#: First labels of the sites whose pages are listed as unwanted; besides, every URL is whose canonical form has an MD5 that begins with LISTED_MD5.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_MD5 = "0"


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    listed = with_parts(pages.select("url"), "url").where(F.md5("canonical").startswith(LISTED_MD5) | F.col("host").rlike(rf"(^|\.)({'|'.join(LISTED_SITES)})\."))
    out = url_verdicts(pages.select("page_id", "url"), listed, URL_RULES)
    return out.select("_row.page_id", "host", "path", "rule", "verdict")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), profiles, carry=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("_row.doc_id", "n_lines", "n_removed_chunks", "n_removed_lines", F.md5("cleaned").alias("cleaned_md5"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, in which every tenth document by hash repeats a stretch of its words to its end.

    With h = crc32(doc_id) and g = h div 10, a text of n > 0 words whose h is a multiple of 10 becomes the words
    from a = g mod n on in a period of 1 + (n - a) div (3 + g mod 8). A null id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")

    def planted(w):
        n = F.size(w).cast("long")
        return let(g % n, lambda a: let((F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("long"), lambda p: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")))

    text = F.when((h % 10 == 0) & (n_words(F.col("text")) > 0), let(words(F.col("text")), planted)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_runs(with_planted_period(_read(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    length = -F.col("best.l")
    return out.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(length * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2
    out, _ = score_texts(_read(spark, sf_dir, "documents"), trained)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc, op2_quality_rules, op3_sharding, op4_ngram_jaccard_join, op5_sentencepiece, op6_exact_dedup, op7_url_filters, op8_language_id, op9_best_fit_packing, op10_line_dedup, op11_periodic_runs, op12_lm_scoring, op13_importance_resampling, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": sql.OP1, "op2_quality_rules": sql.OP2, "op6_exact_dedup": sql.OP6, "op7_url_filters": sql.OP7, "op10_line_dedup": sql.OP10, "op13_importance_resampling": sql.OP13}
