"""Importance resampling towards a target distribution by hashed n-gram features (Xie et al., 2023).

All distinct features are counted in one dictionary and each is hashed once; buckets are sums over the
dictionary. A bucket's gain is the smoothed logarithm of its share in the target over its share in the
documents; the gains go back through the dictionary's answers to the features of each document, whose mean
gain is its weight. Weights with Gumbel noise, drawn from the id, rank the documents: taking the highest is
sampling without replacement by importance.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorale.llm.chunks import CHUNK, NO_WORD, answered, byte_table, chunk_table, dictionary, in_order, n_parts, per_document, unpack
from chorale.llm.shared import table

BUCKETS = 10_000
BECOME = byte_table(NO_WORD, lower=True)


def gains(features: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share in ``target`` over that in ``features``, by bucket."""
    n = len(features)
    s, t = features.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def bucket_counts(known: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences by bucket over a dictionary's parts; a row for each bucket comes to the driver."""
    each = known.where("chunk IS NULL").select(F.explode(F.arrays_zip("marks", "counts")).alias("f"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in each.groupBy("f.marks").agg(F.sum("f.counts")).collect():
        out[bucket] = n
    return out


def _dictionary(docs: DataFrame, row: Column, text_col: str, buckets: int, shortest: int, longest: int, most: int) -> tuple[DataFrame, DataFrame]:
    parts = n_parts(docs, text_col)
    chunks = chunk_table(docs, row, text_col, BECOME, parts, shortest=shortest, longest=longest, most=most)
    return chunks, dictionary(chunks, parts, lambda words: [zlib.crc32(w) % buckets for w in words])


def document_weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = BUCKETS, shortest: int = 1, longest: int = 1, most: int = CHUNK) -> DataFrame:
    """(id, mark, n_words, n_features, weight), one row per input row; mark is a hash of the text.

    Features are all runs of ``shortest`` to ``longest`` words, joined by a space, with repeats. Weights are
    floored means; a document without features, such as a null or empty text, has 0. Repeated rows and null ids
    are rows like any other; an empty table gives an empty result, an empty target makes rare buckets the
    better ones. Other columns are not looked at.
    """
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"))
    chunks, known = _dictionary(docs, row, text_col, buckets, shortest, longest, most)
    _, wanted = _dictionary(target, F.struct(F.lit(0).alias("id")), target_text, buckets, shortest, longest, most)
    gain = gains(bucket_counts(known, buckets), bucket_counts(wanted, buckets))

    def finish(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        n = chunk.column("n").combine_chunks().flatten().to_numpy()
        of_feature = gain[in_order(answers, "marked")]
        sums = per_document(of_feature[unpack(chunk.column("codes")[0].as_py())], n)
        rows = chunk.column("rows").combine_chunks().flatten()
        return pa.table({"id": rows.field("id"), "mark": rows.field("mark"), "n_words": chunk.column("n_words").combine_chunks().flatten(), "n_features": pa.array(n, pa.int64()), "weight": pa.array(sums // np.maximum(n, 1), pa.int64())})

    kinds = chunks.schema["rows"].dataType.elementType
    schema = T.StructType([kinds["id"], kinds["mark"], T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])
    return answered(chunks.select("chunk", "rows", "n_words", "n", "codes"), known.where("chunk IS NOT NULL").select("chunk", "part", "marked"), finish, schema)


def draw(weighted: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(id, n_features, weight, score, rank): of the documents with ``least_words`` words the ``percent`` in a
    hundred with the highest scores are ranked; ties go to the smaller id, null last, then by text.

    A score is the weight and noise drawn from seed and id; a null id is drawn for like an empty one. Ranks are
    places within a score, of which there are as many as thousandths of the noise, shifted by the number of
    higher scores.
    """
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = table(weighted.withColumn("score", (F.col("weight") + noise).cast("long")), "scores")
    counts = [(r["score"], r["count"]) for r in scored.where(F.col("n_words") >= least_words).groupBy("score").count().orderBy(F.desc("score")).collect()]  # a row for each score: thousandths of noise and gain
    left, steps, above = sum(n for _, n in counts) * percent // 100, [], 0
    for score, n in counts:
        if above >= left:
            break
        steps.append((score, above))
        above += n
    offsets = F.broadcast(scored.sparkSession.createDataFrame(steps, "score long, above long"))
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.desc(able), F.asc_nulls_last("id"), "mark"))
    rank = F.when(able, F.col("above") + place)
    return scored.join(offsets, "score", "left").withColumn("rank", rank.cast("long")).select("id", "n_features", "weight", "score", F.when(F.col("rank") <= left, F.col("rank")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = 10, least_words: int = 20, seed: int = 2024, **features) -> DataFrame:
    """:func:`document_weights` and :func:`draw`: one row per input row under the name of its id."""
    return draw(document_weights(docs, target, id_col, text_col, target_text, **features), percent, least_words, seed).withColumnRenamed("id", id_col)
