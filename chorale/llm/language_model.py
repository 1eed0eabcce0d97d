"""Katz backoff over words: Good-Turing discounts, exactly normalised backoff weights, a score for every text.

    P(w | v) = d(c(v, w)) c(v, w) / c(v)   if the pair (v, w) was seen in training
             = alpha(v) P(w)               otherwise
    P(w)     = d(c(w)) c(w) / N            if w was seen, else the mass that the discounts left
    alpha(v) = (1 - sum of P(w | v)) / (1 - sum of P(w)), both over the words seen after v

Every discount is below 1, so every history leaves mass, and the weights make each P(. | v) sum to 1 over the
known words and one class of unknown ones. Words get numbers from the dictionary of :mod:`chunks`; pairs of
numbers are dealt to parts by their hash, each once for a chunk, so neither a frequent pair nor a frequent
history lands in one task. The model is three written tables: words, pairs and backoff weights.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorale.llm.chunks import CHUNK, SPACES, answered, byte_table, chunk_table, dictionary, in_order, mixed, n_parts, pack, part_of, per_document, unpack
from chorale.llm.shared import discard, release, table

BECOME = byte_table(SPACES, lower=True)
#: Numbers of the mark before the first word, which is only a history, and of the token that ends a text; words follow.
START, END, FIRST_WORD = 0, 1, 2
#: Counts up to TURING have Turing's estimate where it is below the count; a line through the logarithms of the counts of counts up to FITTED smooths the others.
TURING, FITTED = 5, 64
#: Words and histories with this part of all tokens are joined by broadcast: there can be no more than its inverse.
HOT = 1 / (1 << 18)


@dataclass(frozen=True)
class Discount:
    """What is left of a count: r* / r by Good and Turing."""

    low: tuple[float, ...]
    slope: float

    def array(self, c: np.ndarray) -> np.ndarray:
        c = np.maximum(c, 1)
        return np.where(c <= len(self.low), np.array(self.low)[np.minimum(c, len(self.low)) - 1], (1 + 1 / c) ** (self.slope + 1))

    def column(self, c: Column) -> Column:
        table_ = F.array(*[F.lit(x) for x in self.low])
        return F.when(c <= len(self.low), F.get(table_, (c - 1).cast("int"))).otherwise(F.pow(1 + 1 / c, F.lit(self.slope + 1)))


def good_turing(counts_of_counts: dict[int, int]) -> Discount:
    """Discounts from how many n-grams occur once, twice, ...; of each the counts up to FITTED + 1 are looked at.

    The smooth estimate is r (1 + 1 / r) ** (slope + 1), below r for a slope below -1; where the line is not
    that steep, or there are fewer than two points, the slope is -2.
    """
    seen = [(math.log(r), math.log(n)) for r, n in sorted(counts_of_counts.items()) if r <= FITTED and n > 0]
    slope = -2.0
    if len(seen) > 1:
        x, y = np.array(seen).T
        slope = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
    slope = slope if slope < -1.01 else -2.0
    low = []
    for r in range(1, TURING + 1):
        n, more = counts_of_counts.get(r, 0), counts_of_counts.get(r + 1, 0)
        turing = (r + 1) * more / (n * r) if n and more else 1.0
        low.append(turing if turing < 1 else (1 + 1 / r) ** (slope + 1))
    return Discount(tuple(low), slope)


def _counts_of_counts(counts: DataFrame) -> dict[int, int]:
    return {r["c"]: r["count"] for r in counts.where(F.col("c").between(1, FITTED + 1)).groupBy("c").count().collect()}  # FITTED + 1 rows


def _pairs(parts: int):
    """A finisher of chunks with the dictionary's answers: what each document has of words, and the chunk's distinct pairs dealt to parts."""

    def finish(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        n = chunk.column("n").combine_chunks().flatten().to_numpy()
        rows = chunk.column("rows").combine_chunks().flatten()
        codes = unpack(chunk.column("codes")[0].as_py())
        number, count = in_order(answers, "at"), in_order(answers, "count")
        order = np.sort(answers.column("part").to_numpy())
        sizes = [len(unpack(answers.column("at")[int(k)].as_py())) for k in np.argsort(answers.column("part").to_numpy(), kind="stable")]
        number = FIRST_WORD + number * parts + np.repeat(order, sizes)
        count = count[codes]
        ends = np.cumsum(n + 1) - 1  # every text has its words and then END
        words = np.ones(int(ends[-1]) + 1 if len(n) else 0, bool)
        words[ends] = False
        now = np.full(len(words), END, np.int64)
        now[words] = number[codes]
        before = np.empty_like(now)
        before[1:] = now[:-1]
        before[np.concatenate(([0], ends[:-1] + 1))[: len(n)]] = START
        # distinct (now, before) of the chunk, by part and then in order
        local, small = np.unique(now, return_inverse=True)
        history, small_before = np.unique(before, return_inverse=True)
        pairs, of_token = np.unique(small * len(history) + small_before, return_inverse=True)
        w, v = local[pairs // len(history)], history[pairs % len(history)]
        part = part_of(mixed(mixed(v) ^ w.astype(np.uint64)), parts)
        by_part = np.argsort(part, kind="stable")
        place = np.empty_like(by_part)
        place[by_part] = np.arange(len(by_part))
        trained = np.repeat(np.array(rows.field("trained").to_pylist(), bool), n + 1)
        counts = np.bincount(of_token[trained], minlength=len(pairs))
        w, v, counts, part = w[by_part], v[by_part], counts[by_part], part[by_part]
        edges = np.searchsorted(part, np.arange(parts + 1))
        asks = [{"part": int(p), "w": pack(np.diff(w[a:b], prepend=0)), "v": pack(v[a:b]), "c": pack(counts[a:b])} for p, a, b in zip(range(parts), edges[:-1], edges[1:], strict=True) if b > a]
        known = (count > 0).astype(np.int64)
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.table(
            {
                "chunk": chunk.column("chunk"), "rows": chunk.column("rows"), "n": one(n, pa.int64()), "n_known": one(per_document(known, n), pa.int64()),
                "known": one(per_document(np.log10(count + 1.0), n), pa.float64()), "history": one(per_document(np.log10(np.maximum(count, 1)), n), pa.float64()),
                "pairs": pa.array([pack(place[of_token])], pa.binary()), "asks": pa.array([asks], pa.list_(pa.struct([("part", pa.int32()), ("w", pa.binary()), ("v", pa.binary()), ("c", pa.binary())]))),
            }
        )

    return finish


def _merge_pairs(group: pa.Table) -> pa.Table:
    """The pairs of a part: rows of kind 0 are pairs seen in training, of kind 1 the answers to chunks, of kind 2 what a chunk has that training has not."""
    chunk, part = group.column("chunk").to_numpy(), group.column("part")[0].as_py()
    each = [[unpack(x.as_py()) for x in group.column(c)] for c in ("w", "v", "c")]
    sizes = [len(x) for x in each[0]]
    w, v, c = np.concatenate([np.cumsum(x) for x in each[0]]), np.concatenate(each[1]), np.concatenate(each[2])
    order = np.lexsort((v, w))
    w1, v1 = w[order], v[order]
    first = np.concatenate(([True], (w1[1:] != w1[:-1]) | (v1[1:] != v1[:-1])))
    at = np.flatnonzero(first)
    totals = np.add.reduceat(c[order], at)
    mine = np.empty(len(w), np.int64)
    mine[order] = totals[np.cumsum(first) - 1]
    offset = np.concatenate(([0], np.cumsum(sizes)))
    seen = totals > 0
    asked = np.repeat(np.arange(len(sizes)), sizes)
    new = np.flatnonzero(mine == 0)
    k, a, b = int(seen.sum()), len(sizes), len(new)
    none = lambda n: np.full(n, -1, np.int64)
    return pa.table(
        {
            "kind": pa.array(np.repeat([0, 1, 2], [k, a, b]), pa.int32()), "part": pa.array(np.full(k + a + b, part), pa.int32()), "chunk": np.concatenate((none(k), chunk, chunk[asked[new]])),
            "v": np.concatenate((v1[at][seen], none(a), v[new])), "w": np.concatenate((w1[at][seen], none(a), w[new])), "c": np.concatenate((totals[seen], none(a), new - offset[asked[new]])),
            "answer": pa.array([None] * k + [pack(x) for x in np.split(mine, offset[1:-1])] + [None] * b, pa.binary()),
        }
    )


def _looked_up(rows: DataFrame, key: str, facts: DataFrame, weight: Column, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``facts`` (key, ...): facts that are hot by ``weight`` are broadcast, the rest is shuffled."""
    names = [c for c in facts.columns if c != key]
    hot = F.broadcast(facts.where(weight).select(F.col(key).alias("_hot"), F.struct(*names).alias("_fact")))  # no more than 1 / HOT rows
    told = rows.join(hot, F.col(key) == F.col("_hot"), "left")
    found = told.where("_hot IS NOT NULL").select(*rows.columns, *[F.col(f"_fact.{c}").alias(c) for c in names])
    rest = told.where("_hot IS NULL").select(*rows.columns).join(facts.where(~weight), key, how)
    return found.unionByName(rest.select(*rows.columns, *names))


@dataclass(frozen=True)
class Model:
    """The written tables of a model and what is small enough for the driver."""

    words: DataFrame  # (w, c): every word and END
    pairs: DataFrame  # (v, w, c)
    backoffs: DataFrame  # (v, c, log_mass): log10 of alpha(v) c(v)
    tokens: int
    distinct: int
    texts: int
    single: Discount
    double: Discount
    unknown: float


def _word_table(known: DataFrame, parts: int, texts: int) -> DataFrame:
    numbered = known.where("chunk IS NULL").select("part", F.posexplode("counts").alias("at", "c")).where("c > 0").select((FIRST_WORD + F.col("at").cast("long") * parts + F.col("part")).alias("w"), "c")
    return table(numbered.unionByName(known.sparkSession.createDataFrame([(END, texts)] if texts else [], "w long, c long")), "words")


def _fit(words: DataFrame, pairs: DataFrame, texts: int) -> Model:
    tokens, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    single, double = good_turing(_counts_of_counts(words)), good_turing(_counts_of_counts(pairs))
    c = F.col("c")
    prob = words.select("w", (single.column(c) * c / float(max(tokens, 1))).alias("p"))
    unknown = 1 - (prob.agg(F.coalesce(F.sum("p"), F.lit(0.0))).first()[0])
    hot = F.col("p") >= HOT  # probabilities sum to 1
    seen = _looked_up(pairs.select("v", "w", "c"), "w", prob, hot)
    sums = seen.groupBy("v").agg(F.sum("c").alias("c"), F.sum(double.column(c) * c).alias("held"), F.sum("p").alias("below"))
    mass = F.log10((1 - F.col("held") / F.col("c")) / F.greatest(1 - F.col("below"), F.lit(unknown))) + F.log10("c")
    backoffs = table(sums.select("v", "c", mass.alias("log_mass")), "backoffs")
    return Model(words, pairs, backoffs, int(tokens), int(distinct), texts, single, double, unknown)


def _unseen(rows: DataFrame, model: Model) -> DataFrame:
    """(chunk, part, at, x) of pairs that training has not: log10 of alpha(v) c(v) P(w)."""
    c, n = F.col("c"), float(max(model.tokens, 1))
    prob = model.words.select("w", (model.single.column(c) * c / n).alias("p"))
    slim = rows.select("chunk", "part", F.col("c").alias("at"), "v", "w")
    with_p = _looked_up(slim, "w", prob, F.col("p") >= HOT, "left")
    with_both = _looked_up(with_p, "v", model.backoffs.select("v", "c", "log_mass"), F.col("c") >= HOT * n, "left")
    x = F.coalesce("log_mass", F.lit(0.0)) + F.log10(F.coalesce("p", F.lit(model.unknown)))
    return with_both.select("chunk", "part", "at", x.alias("x"))


def score_texts(docs: DataFrame, trained: Column, id_col: str = "doc_id", text_col: str = "text", most: int = CHUNK) -> tuple[DataFrame, Model]:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every text, and the model learnt from those ``trained``.

    Tokens are words, A to Z lower-cased, and an END for every text; null and empty texts have END alone. n_known
    tokens occur in training. base_score is with add-one counts of single tokens, score is the model's; both are
    log10 of the text's probability. Null in ``trained`` counts as false, repeated rows and null ids are rows like
    any other. Without training texts every token has probability 1, being unknown; an empty table gives an empty
    result. Other columns are not looked at.
    """
    parts = n_parts(docs, text_col)
    trained = F.coalesce(trained, F.lit(False))
    row = F.struct(F.col(id_col).alias("id"), trained.alias("trained"))
    chunks = chunk_table(docs, row, text_col, BECOME, parts, counted=trained, most=most)
    known = dictionary(chunks, parts)
    kinds = chunks.schema["rows"].dataType
    texts = chunks.select(F.coalesce(F.sum(F.size(F.filter("rows", lambda r: r["trained"]))), F.lit(0))).first()[0]
    longs, doubles = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())
    ask = T.StructType([T.StructField("part", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("w", "v", "c")]])
    schema = T.StructType([T.StructField(c, k) for c, k in (("chunk", T.LongType()), ("rows", kinds), ("n", longs), ("n_known", longs), ("known", doubles), ("history", doubles), ("pairs", T.BinaryType()), ("asks", T.ArrayType(ask)))])
    told = table(answered(chunks.select("chunk", "rows", "n", "codes"), known.where("chunk IS NOT NULL").select("chunk", "part", "at", "count"), _pairs(parts), schema), "told")
    words = _word_table(known, parts, int(texts))
    discard(chunks)
    discard(known)
    asked = told.select("chunk", F.explode("asks").alias("a")).select("chunk", "a.part", "a.w", "a.v", "a.c").repartition(parts, "part")
    merged = table(asked.groupBy("part").applyInArrow(_merge_pairs, "kind int, part int, chunk long, v long, w long, c long, answer binary"), "pairs", ["kind"])
    release(merged.sparkSession)
    model = _fit(words, merged.where("kind = 0").select("v", "w", "c"), int(texts))
    release(merged.sparkSession)
    unseen = table(_unseen(merged.where("kind = 2"), model).groupBy("chunk").agg(*[F.collect_list(c).alias(c) for c in ("part", "at", "x")]), "unseen")  # a chunk's own pairs at most
    answers = merged.where("kind = 1").select("chunk", "part", "answer", *[F.lit(None).cast(f"array<{k}>").alias(c) for c, k in (("parts", "int"), ("at", "bigint"), ("x", "double"))])
    new = unseen.select("chunk", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("answer"), F.col("part").alias("parts"), "at", "x")
    scored = answered(told.select("chunk", "rows", "n", "n_known", "known", "history", "pairs"), answers.unionByName(new), _score(model), T.StructType([kinds.elementType["id"], T.StructField("trained", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]]))
    return scored.withColumnRenamed("id", id_col), model


def _score(model: Model):
    """A finisher of chunks with the counts of their pairs."""
    tokens, distinct, texts, double = model.tokens, model.distinct, model.texts, model.double

    def finish(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        flat = lambda c: chunk.column(c).combine_chunks().flatten().to_numpy()
        rows, n = chunk.column("rows").combine_chunks().flatten(), flat("n")
        parts = answers.column("part").to_numpy()
        counts, begins, at = [], {}, 0
        for k in np.argsort(parts, kind="stable"):
            if parts[k] >= 0:
                counts.append(unpack(answers.column("answer")[int(k)].as_py()))
                begins[int(parts[k])] = at
                at += len(counts[-1])
        c = np.concatenate(counts)
        x = np.log10(double.array(c) * np.maximum(c, 1))
        for k in np.flatnonzero(parts < 0):
            where = np.array([begins[p] for p in answers.column("parts")[int(k)].as_py()], np.int64)
            x[where + answers.column("at")[int(k)].values.to_numpy()] = answers.column("x")[int(k)].values.to_numpy()
        ended = math.log10(texts) if texts else 0.0
        score = per_document(x[unpack(chunk.column("pairs")[0].as_py())], n + 1) - flat("history") - ended
        base = flat("known") + math.log10(texts + 1) - (n + 1) * math.log10(tokens + distinct + 1)
        return pa.table({"id": rows.field("id"), "trained": rows.field("trained"), "n_tokens": n + 1, "n_known": flat("n_known") + (texts > 0), "train_tokens": np.full(len(n), tokens), "base_score": base, "score": score})

    return finish
