"""All maximal periodic runs of words, by Lempel-Ziv blocks from the longest-previous-factor array.

Many texts are treated at once: their words are numbered so that no number is in two texts, and the arrays of
all lie end to end. Ranks of all stretches of 1, 2, 4, ... words come from sorting pairs of ranks, only where they
still tie; the last gives the suffix array, and any two places are compared over all ranks from the longest
down. The nearest smaller places on both sides in the suffix array give the longest previous factors, and those
the blocks. A run that touches a boundary between blocks is found by extending equal stretches from there to
both sides, for periods that Main's lemma allows; any other lies inside a block and is copied, from buckets by
start, from where the block occurred before.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorale.llm.chunks import SPACES, byte_table, cut, pieces

BECOME = byte_table(SPACES, lower=False)
#: Words that are treated at a time, about; a longer text by itself.
AT_A_TIME = 1 << 17
#: Words of the shortest run.
SHORTEST = 12


class Ranks:
    """Ranks of the stretches of 1, 2, 4, ... codes that begin at each place, up to the length at which all differ."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        self.n, self.levels = n, []
        order = np.argsort(codes, kind="stable")
        now, open_ = self._ranked(order, codes[order], np.zeros(n, np.int64), np.empty(n, np.int64))
        self._add(now)
        step = 1
        while len(open_):
            beyond = np.where(open_ + step < n, now[np.minimum(open_ + step, n - 1)] + 1, 0)
            order = np.lexsort((beyond, now[open_]))
            s = open_[order]
            now, open_ = self._ranked(s, beyond[order], now[s], now.copy())
            self._add(now)
            step *= 2
        self.place = now  # of each suffix among the sorted ones
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[now] = np.arange(n)

    def _add(self, now: np.ndarray) -> None:
        self.levels.append(np.append(now, -1).astype(np.int32))

    @staticmethod
    def _ranked(s: np.ndarray, key: np.ndarray, old: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New ranks of the places ``s``, sorted by old rank and key: where a group begins in the suffix array; and the places that still tie."""
        at = np.arange(len(s))
        fresh = np.ones(len(s), bool)
        fresh[1:] = old[1:] != old[:-1]
        base = np.maximum.accumulate(np.where(fresh, at, 0))
        fresh[1:] |= key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(fresh, at, 0))
        now[s] = old + first - base
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        return now, s[tied]

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the texts from i < j on are equal."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the texts that end with the places i < j are equal; i may be -1."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - (1 << k) + 1, j - (1 << k) + 1
            step = ((a >= 0) & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])).astype(np.int64) << k
            i -= step
            j -= step
        return start - i

    def may_share(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether two words from i and j on, or the two before them, are equal; else they touch in no run of SHORTEST words."""
        level = self.levels[1]
        a, b = i - 2, j - 2
        return (level[i] == level[j]) | ((a >= 0) & (level[np.maximum(a, 0)] == level[np.maximum(b, 0)]))


def _nearest_smaller(values: np.ndarray, step: int) -> np.ndarray:
    """For each place the nearest one in direction ``step`` with a smaller value; -1 or the length if there is none."""
    n = len(values)
    padded = np.append(values, [-1])  # at n, and as -1
    at = np.arange(n) + step
    todo = np.flatnonzero(padded[at] > values)
    while len(todo):
        at[todo] = at[at[todo]]
        todo = todo[padded[at[todo]] > values[todo]]
    return at


def longest_previous(ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """For each place the longest stretch from it on that also begins earlier, and where."""
    n, s = ranks.n, ranks.suffixes
    length, where = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for step in (-1, 1):
        near = _nearest_smaller(s, step)
        there = (near >= 0) & (near < n)
        later, earlier = s[there], s[near[there]]
        tied = ranks.levels[0][later] == ranks.levels[0][earlier]
        later, earlier = later[tied], earlier[tied]
        found = ranks.forward(earlier, later)
        better = found > length[later]
        length[later[better]], where[later[better]] = found[better], earlier[better]
    return length, where


def _blocks(length: np.ndarray) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin; each is the longest previous factor, or a word that is new."""
    steps, out, at = np.maximum(length, 1).tolist(), [], 0
    while at < len(steps):
        out.append(at)
        at += steps[at]
    return np.array(out, np.int64)


def _touching(ranks: Ranks, begins: np.ndarray, ends: np.ndarray, edges: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of runs that touch a boundary of blocks; may repeat, and with multiples of the period.

    ``edges`` are where texts begin and end. Right of a boundary a block is at least a period long, left of it
    the period is shorter than the two blocks together.
    """
    size = ends - begins
    text = np.searchsorted(edges, begins, side="right") - 1
    first, last = edges[text], edges[text + 1]
    before = np.where(begins > first, np.concatenate(([0], size[:-1])), 0)
    closing = ends == last
    found = []
    # a period to the right
    b, q = np.repeat(begins, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + 1
    ok = b + q < np.repeat(last, size)
    found.append((b[ok], b[ok] + q[ok], q[ok]))
    # a period to the left, also from the end of each text
    at = np.concatenate((begins, ends[closing]))
    low = np.concatenate((first, first[closing]))
    most = np.minimum(np.concatenate((np.where(before > 0, size + before - 1, 0), size[closing])), at - low)
    b, q = np.repeat(at, most), np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most) + 1
    found.append((b - q, b, q))
    i, j, q = (np.concatenate(x) for x in zip(*found, strict=True))
    maybe = ranks.may_share(i, np.minimum(j, ranks.n))
    i, j, q = i[maybe], j[maybe], q[maybe]
    ahead, behind = ranks.forward(i, j), ranks.backward(i - 1, j - 1)
    start, end = i - behind, j + ahead
    whole = end - start >= np.maximum(shortest, 2 * q)
    return start[whole], end[whole], q[whole]


def runs_of(codes: np.ndarray, n: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of texts that lie end to end, ``n`` words each, by start and period.

    ``codes`` number words so that no number is in two texts. A run has a smallest period, at least ``shortest``
    words (six or more) and twice its period, and cannot be extended.
    """
    none = np.empty(0, np.int64)
    if not len(codes):
        return none, none, none
    ranks = Ranks(codes)
    if len(ranks.levels) < 2:
        return none, none, none
    length, where = longest_previous(ranks)
    begins = _blocks(length)
    ends = np.append(begins[1:], len(codes))
    edges = np.concatenate(([0], np.cumsum(n[n > 0])))
    start, end, period = _touching(ranks, begins, ends, edges, shortest)
    buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
    known: dict[tuple[int, int], int] = {}
    for a, b, q in sorted(zip(start.tolist(), end.tolist(), period.tolist(), strict=True)):
        if (a, b) not in known:  # the smallest period comes first
            known[a, b] = q
            buckets[a].append((b, q))
    if known:
        has_run = np.zeros(len(edges) - 1, bool)
        has_run[np.searchsorted(edges, start, side="right") - 1] = True
        long_ = np.flatnonzero((ends - begins > shortest + 1) & has_run[np.searchsorted(edges, begins, side="right") - 1])
        for s, e in zip(begins[long_].tolist(), ends[long_].tolist(), strict=True):
            back = s - int(where[s])
            for p in range(s - back + 1, e - back - shortest):
                for b, q in buckets.get(p, ()):
                    if b < e - back and (p + back, b + back) not in known:
                        known[p + back, b + back] = q
                        buckets[p + back].append((b + back, q))
    out = np.array(sorted((a, q, b) for (a, b), q in known.items()), np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 2], out[:, 1]


def _texts_with_runs(ids: pa.Array, n: np.ndarray, words: pa.Array, shortest: int) -> pa.RecordBatch:
    coded = words.dictionary_encode()
    text = np.repeat(np.arange(len(n)), n)
    start, end, period = runs_of(text * len(coded.dictionary) + coded.indices.to_numpy(), n, shortest)
    total = len(text)
    gone = np.zeros(total + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    kept = np.cumsum(gone[:total]) == 0
    offsets = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    left = pa.ListArray.from_arrays(offsets(np.bincount(text[kept], minlength=len(n))), words.filter(pa.array(kept)))
    begin = np.concatenate(([0], np.cumsum(n)))
    of = text[start] if total else np.empty(0, np.int64)
    runs = pa.StructArray.from_arrays([pa.array(start - begin[of]), pa.array(end - start), pa.array(period)], names=["start", "length", "period"])
    runs = pa.ListArray.from_arrays(offsets(np.bincount(of, minlength=len(n))), runs)
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), runs, pc.binary_join(left, b" ").cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """One row per input row: id, n_words, runs (start, length and period in words, by start and period), collapsed.

    ``collapsed`` has the words that no run contains after its first period, joined by one space. A null text
    has no words, as an empty one, no runs and an empty ``collapsed``. Null and repeated ids are rows like any
    other; an empty table gives an empty result; other columns of ``docs`` are not looked at. Texts are whole,
    each in one task, where it takes some 4 bytes a word for every doubling of its longest repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for b in batches for p in pieces(b, 1)):
            n, words = cut(piece.column(1), BECOME)
            at = np.concatenate(([0], np.cumsum(n)))
            slot = at[1:] // AT_A_TIME
            edges = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(n)] if len(n) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield _texts_with_runs(piece.column(0).slice(a, b - a), n[a:b], words.slice(at[a], at[b] - at[a]), shortest)

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    run_kind = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    schema = T.StructType([slim.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("runs", run_kind), T.StructField("collapsed", T.StringType())])
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)
