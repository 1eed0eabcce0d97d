"""Language identification by rank-order n-gram profiles.

A profile is the most frequent letter n-grams (one to three letters, word ends marked) in order of their
frequency. A document is given the language to whose profile its own has the least out-of-place distance.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorale.llm.shared import discard, small_batches, table

UNKNOWN = "und"
#: Stands for a word's end in n-gram codes; a control character, so never a letter.
EDGE = 1
#: Distinct n-grams of documents that a task holds for a language before it sums them.
HELD = 1 << 18
#: n-grams in a profile.
PROFILE = 400
#: A text is taken for no learned language below this part of the score that all but FLOOR_SHARE of its own texts reach.
FLOOR_PART, FLOOR_SHARE = 0.8, 0.001
#: Scores are counted in steps of its inverse, so a percentile holds no more of them.
STEPS = 1_000_000


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a text, ascending, and their counts; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    marked = np.where(letter, points, EDGE).astype(np.int64)
    s = np.concatenate(([EDGE], marked, [EDGE]))
    s = s[np.concatenate(([True], (s[1:] != EDGE) | (s[:-1] != EDGE)))]
    pairs = (s[:-1] << 21) | s[1:]
    triples = ((pairs[:-1] << 21) | s[2:])[s[1:-1] != EDGE]
    return np.unique(np.concatenate((s[s != EDGE], pairs, triples)), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def _count_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, code, n), each language's n-grams summed over the partition in steps of bounded size."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}

    def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            parts = held.setdefault(lang, [])
            parts.append(ngrams(text.as_py() or ""))
            size[lang] = size.get(lang, 0) + len(parts[-1][0])
            if size[lang] > HELD:
                held[lang] = [summed(parts)]
                size[lang] = 0
    for lang, parts in held.items():
        codes, counts = summed(parts)
        if len(codes):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])


def _sampled(labelled: DataFrame, lang_col: str, text_col: str, sample_docs: int) -> DataFrame:
    """(lang, text) of about ``sample_docs`` distinct whole texts of each language, however often they are copied."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col, F.lit("sample")).alias("mark"))
    totals = table(rows.select("lang", "mark").distinct().groupBy("lang").count(), "languages")
    chance = (F.col("mark").cast("double") / F.lit(2.0**64)) + 0.5
    return rows.join(totals, "lang").where(chance * F.col("count") < sample_docs).groupBy("lang", "mark").agg(F.min("text").alias("text")).select("lang", "text")


def _distinct(labelled: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, text): every whole text of each language once, however often it is copied."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).distinct()


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_docs: int | None = None, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles by language, fitted on all distinct whole texts of each language, or on about ``sample_docs`` of each.

    Copies count once; rows with null language or text don't count; a sample is chosen by hash.
    What returns to the driver is ``size`` codes for each language.
    """
    return _profiles(_distinct(labelled, lang_col, text_col) if sample_docs is None else _sampled(labelled, lang_col, text_col, sample_docs), size)


def learn_with_floors(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> tuple[dict[str, list[int]], dict[str, float]]:
    """What :func:`learn` gives, and the least score with which a text is taken for each language, both from all distinct texts."""
    chosen = table(_distinct(labelled, lang_col, text_col), "language-texts")
    profiles = _profiles(chosen, size)
    floors = _floors(chosen, profiles, size)
    discard(chosen)
    return profiles, floors


def _profiles(chosen: DataFrame, size: int) -> dict[str, list[int]]:
    small_batches(chosen.sparkSession)
    counts = chosen.mapInArrow(_count_by_language, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= size).collect()
    out: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["code"])
    return out


def _floors(chosen: DataFrame, profiles: dict[str, list[int]], size: int) -> dict[str, float]:
    """FLOOR_PART of the score that all but FLOOR_SHARE of a language's rightly told texts reach."""
    told = identify(chosen, profiles, "text", size, carry=["lang"]).where(F.col("lang") == F.col("_lang"))
    counts = told.groupBy("lang", (F.floor(F.col("_score") * STEPS) / STEPS).alias("score")).agg(F.count("*").alias("n"))  # no more rows than steps for a language
    low = counts.groupBy("lang").agg((F.percentile("score", F.lit(FLOOR_SHARE), F.col("n")) * FLOOR_PART).alias("floor"))
    return {r["lang"]: r["floor"] for r in low.collect()}  # a row per language


class Profiles:
    """Ranks of every profile's n-grams, ready for whole documents."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE) -> None:
        self.size, self.langs = size, sorted(profiles)
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], dtype=np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes)), -1, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[k, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and 1 - distance / greatest distance; ties go to the first language by name."""
        own = ranked(*ngrams(text or ""), self.size)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        theirs = np.where(self.codes[at] == own, self.ranks[:, at], -1)
        places = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(places))
        return self.langs[best], float(1 - places[best] / (self.size * len(own)))


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 5 == 0


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", size: int = PROFILE, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with ``_lang`` and ``_score``.

    ``und`` and 0 for null texts and texts without a letter. Whole texts are read. Without profiles
    everything is ``und``; an empty table gives an empty result.
    """
    names = docs.columns if carry is None else carry
    out = _identified(docs, profiles, text_col, size, names)
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in names if c not in ("_lang", "_score")], "_lang", "_score")


def _identified(docs: DataFrame, profiles: dict[str, list[int]], text_col: str, size: int, names: list[str]) -> DataFrame:
    """The columns ``names`` as struct _row, _lang and _score."""
    small_batches(docs.sparkSession)
    inside = names.index(text_col) if text_col in names else None
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *([] if inside is not None else [F.col(text_col).alias("_text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles, size)
        for part in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            texts = part.column(0).field(inside) if inside is not None else part.column(1)
            said = [known.predict(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], names=["_row", "_lang", "_score"])

    schema = T.StructType([wrapped.schema["_row"], T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType())])
    return wrapped.mapInArrow(run, schema)


def keep_languages(docs: DataFrame, profiles: dict[str, list[int]], langs: tuple[str, ...] | None = None, min_score: float = 0.0, text_col: str = "text", least: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs`` in a learned language (or one of ``langs``) with at least ``min_score`` and the language's score in ``least``.

    Null texts and texts without a letter have no language and go; rows that repeat stay or go together; whole texts
    are read, of any length; an empty table, and one without profiles, gives an empty result. Columns are unchanged,
    whatever their names.
    """
    out = _identified(docs, profiles, text_col, PROFILE, docs.columns).where((F.col("_lang") != UNKNOWN) & (F.col("_score") >= min_score))
    if langs is not None:
        out = out.where(F.col("_lang").isin(list(langs)))
    if least:
        known = F.create_map(*[F.lit(x) for pair in sorted(least.items()) for x in pair])
        out = out.where(F.col("_score") >= F.coalesce(known[F.col("_lang")], F.lit(0.0)))
    return out.select("_row.*")
