"""SentencePiece encoding and decoding, giant documents in parallel by a max-plus scan.

A giant document is cut at fixed places, through words if need be. Each chunk gives, from its own text and a
few characters around it, a matrix of weights from the states at its start to those at its end. The matrices
of a document are combined, which is associative and fixes the state at every cut; then every chunk traces
its own pieces between its two states, independent of the others.

In a unigram model the lattice holds every piece at every place with its score, and a path's weight is the
sum of its scores. The state at a cut is how far the piece over it reaches. Scores are fixed-point numbers,
so sums are exact in any order; of paths with equal weights the one wins whose pieces, read from the end, begin
further left, as in the library, and the products of matrices carry that order along.

In a BPE model the segmentation is the only sequence of pieces in which every two neighbours, encoded by
themselves, stay as they are. In the lattice of all pieces a compatible step weighs 0 and any other is left
out, so it is the one path. The state at a cut is the piece that holds the character before it. A word's start
is a cut that no piece crosses, so inside a chunk only the words that its ends cut through need the lattice;
other words are looked up.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.shared import let, table

SPACE = "▁"
#: Characters in a chunk; documents up to this length are one chunk.
CHUNK = 1 << 15
#: Words that a worker remembers.
MEMORY = 100_000
#: Modulus of the position-weighted sum of ids.
MODULUS = 2_147_483_647
#: Fixed-point scores: so many parts of one.
PARTS = 1 << 20
#: What the library takes off the least score for a character that no piece holds.
UNKNOWN_PENALTY = 10.0
UNIGRAM, BPE = 1, 2
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


def model_type(proto: bytes) -> int:
    """The kind of a model; unigram if it does not say."""
    trainer = next((v for k, v in _fields(proto) if k == 2), b"")
    return next((v for k, v in _fields(trainer) if k == 3), UNIGRAM)


def piece_types(proto: bytes) -> list[int]:
    """The type of every piece, 1 for an ordinary one and 4 for one that the user defined."""
    return [next((v for k, v in _fields(piece) if k == 3), 1) for number, piece in _fields(proto) if number == 1]


class Pieces:
    """A SentencePiece BPE or unigram model from its serialised bytes."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.library.get_piece_size()
        self.text = [self.library.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_byte(i) or self.library.is_unknown(i) or self.library.is_unused(i))]
        self.ids = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: self.library.get_score(i) for i in plain}
        self.bytes = {b: self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # what an id spells on its own; bytes from 128 on only spell together
        self.spelt = [chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else p for i, p in enumerate(self.text)]
        self.high = {i for i, b in self.byte_of.items() if b >= 128}
        self.longest = max(map(len, self.ids))
        self.unigram = model_type(proto) == UNIGRAM
        if not self.unigram and model_type(proto) != BPE or 4 in piece_types(proto):
            raise ValueError("only BPE and unigram models without pieces of the user are supported")
        fixed = {p: round(x * PARTS) for p, x in self.score.items()}
        self.fixed, self.unknown = fixed, min(fixed.values()) - round(UNKNOWN_PENALTY * PARTS)
        if not self.unigram and any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("pieces that reach over the start of a word are not supported")
        probe = "a  ÀＡb"
        if not self.library.is_byte(self.bytes[0]) or self.library.decode(self.library.encode(probe)) != probe or "".join(self.library.encode("a", out_type=str)) != SPACE + "a":
            raise ValueError("only models with byte fallback, a dummy prefix and no normalisation are supported")
        self.words: dict[str, tuple[int, ...]] = {}
        self.number = list(range(n))  # so that equal ids are one object
        self.fits = functools.lru_cache(1 << 18)(self._fits)

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: join the best-scored neighbours, leftmost first, until none can be joined."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        return self.merge(left + right) == ([left, right] if right else [left])

    def starts(self, text: str, at: int) -> Iterator[str]:
        """The pieces, or the single character without one, that may start at a place."""
        for n in range(1, min(self.longest, len(text) - at) + 1):
            part = text[at : at + n]
            if n == 1 or part in self.ids and self.fits(part, ""):
                yield part

    def units(self, part: str) -> list[int]:
        """The ids of a piece, of its bytes if it has none."""
        return [self.ids[part]] if part in self.ids else [self.bytes[b] for b in part.encode("utf-8", "surrogatepass")]

    def scored(self, text: str, at: int) -> Iterator[tuple[int, int]]:
        """(length, weight) of the pieces that start at a place of a unigram lattice, shortest first."""
        one = self.fixed.get(text[at : at + 1])
        yield 1, self.unknown if one is None else one
        for n in range(2, min(self.longest, len(text) - at) + 1):
            weight = self.fixed.get(text[at : at + n])
            if weight is not None:
                yield n, weight

    def encode_text(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return self.library.encode(text, num_threads=1) if self.unigram else self.encode_words(mark(text))

    def encode_words(self, marked: str) -> list[int]:
        """Ids of a text that begins at a word's start, with spaces marked."""
        found = WORD.findall(marked)
        if missing := [w for w in dict.fromkeys(found) if w not in self.words]:
            if len(self.words) + len(missing) > MEMORY:
                self.words.clear()
                missing = list(dict.fromkeys(found))
            self.words |= {w: tuple(i for p in self.merge(w) for i in self.units(p)) for w in missing if not w.strip(SPACE)}
            missing = [w for w in missing if w.strip(SPACE)]
            # the library puts a mark of its own before each word
            found_ids = self.library.encode([w[1:].replace(SPACE, " ") for w in missing], num_threads=1)
            self.words |= {w: tuple(map(self.number.__getitem__, ids)) for w, ids in zip(missing, found_ids, strict=True)}
        return [i for w in found for i in self.words[w]]

    def decode(self, ids: list[int]) -> str:
        """The marked text of ids; bytes that are no text become replacement characters."""
        if self.high.isdisjoint(ids):
            return "".join([self.spelt[i] for i in ids])
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.text[i])
        return "".join(out) + held.decode("utf-8", "replace")


def mark(text: str) -> str:
    """A text as pieces see it; a mark that is in the text itself is a space to them."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def unmark(marked: str) -> str:
    return marked[1:].replace(SPACE, " ")


class Chunk:
    """Part [start, stop) of a marked text, with ``text`` holding what lies around it from ``base`` on."""

    def __init__(self, pieces: Pieces, text: str, base: int, start: int, stop: int, last: bool) -> None:
        self.pieces, self.text, self.last = pieces, text, last
        self.start, self.stop, self.first = start - base, stop - base, start == 0
        cuts = [i for i in (self._cut(self.start, self.stop, 1), self._cut(self.stop - 1, self.start - 1, -1)) if i is not None]
        self.cuts = (cuts[0], cuts[1]) if len(cuts) == 2 else None

    def _cut(self, a: int, b: int, step: int) -> int | None:
        return next((i for i in range(a, b, step) if i > 0 and self.text[i] == SPACE and self.text[i - 1] != SPACE), None)

    def crossing(self, at: int) -> list[tuple[int, str]]:
        """(start, piece) of those that may hold the character before ``at``."""
        return [(q, p) for q in range(max(0, at - self.pieces.longest), at) for p in self.pieces.starts(self.text, q) if q + len(p) >= at]

    def _lattice(self, entries: list[tuple[int, str]], stop: int, over: bool) -> dict:
        """Arrivals {(end, piece): {entry: state before}}; pieces start before ``stop`` and, unless ``over``, end by it."""
        states = {(q + len(p), p, q): {k: None} for k, (q, p) in enumerate(entries)}
        at = {}
        for s in states:
            at.setdefault(s[0], []).append(s)
        done = {}
        place = min(at, default=stop)
        while place < stop:
            for part in self.pieces.starts(self.text, place) if place in at else ():
                end = place + len(part)
                if end > stop and not over:
                    continue
                for s in at[place]:
                    if s[1] and not self.pieces.fits(s[1], part):
                        continue
                    new = (end, part, place)
                    if new not in states:
                        states[new] = {}
                        at.setdefault(end, []).append(new)
                    for k in states[s]:
                        states[new].setdefault(k, s)
            place += 1
        for s in [x for end in at if end >= stop for x in at[end]]:
            done[s] = states[s]
        return {"states": states, "done": done}

    def _trace(self, lattice: dict, state: tuple, entry: int) -> list[str]:
        parts = []
        while True:
            before = lattice["states"][state][entry]
            if before is None:
                return parts[::-1]
            parts.append(state[1])
            state = before

    def entries(self) -> list[tuple[int, str]]:
        return [(0, "")] if self.first else self.crossing(self.start)

    def state(self, at: int, q: int, part: str) -> str:
        return f"{at - q}:{part}"

    def _parts(self) -> tuple[dict, dict]:
        """Lattices from the entries to the first word's start, and from the last one to the exits; the same without such starts."""
        if self.cuts is None:
            both = self._lattice(self.entries(), self.stop, True)
            return both, both
        head = self._lattice(self.entries(), self.cuts[0], False)
        return head, self._lattice([(self.cuts[1], "")], self.stop, True)

    def _exits(self, lattice: dict) -> dict[tuple, str]:
        keep = {s: self.state(self.stop, s[2], s[1]) for s in lattice["done"] if s[2] < self.stop <= s[0] and s[1]}
        return {s: k for s, k in keep.items() if not self.last or s[0] == self.stop}

    def matrix(self) -> list[tuple[str, str, int, int]]:
        """(entry, exit, weight, rank): all weigh 0 and none is tied with another."""
        entries = self.entries()
        names = ["" if self.first else self.state(self.start, *e) for e in entries]
        head, tail = self._parts()
        exits = self._exits(tail)
        if self.cuts is None:
            return [(names[k], name, 0, k) for s, name in exits.items() for k in head["done"][s]]
        into = {k for s, found in head["done"].items() if s[0] == self.cuts[0] for k in found}
        return [(names[k], name, 0, k) for k in into for s, name in exits.items() if tail["done"][s]]

    def ids(self, entry: str, exit_: str) -> list[int]:
        """Ids of the pieces after the entry up to the exit, both included in the path of their chunks once."""
        names = ["" if self.first else self.state(self.start, *e) for e in self.entries()]
        k = names.index(entry)
        head, tail = self._parts()
        end = next(s for s, name in self._exits(tail).items() if name == exit_)
        if self.cuts is None:
            return [i for p in self._trace(head, end, k) for i in self.pieces.units(p)]
        to = next(s for s, found in head["done"].items() if s[0] == self.cuts[0] and k in found)
        out = [i for p in self._trace(head, to, k) for i in self.pieces.units(p)]
        out += self.pieces.encode_words(self.text[self.cuts[0] : self.cuts[1]])
        return out + [i for p in self._trace(tail, end, 0) for i in self.pieces.units(p)]


class ScoredChunk:
    """Part [start, stop) of a marked text under a unigram model; ``text`` holds it and what follows it."""

    def __init__(self, pieces: Pieces, text: str, base: int, start: int, stop: int, last: bool) -> None:
        self.pieces, self.text = pieces, text[start - base :]
        self.n, self.first, self.last = stop - start, start == 0, last

    def entries(self) -> list[int]:
        return [0] if self.first else list(range(min(self.pieces.longest, len(self.text) + 1)))

    def _forward(self, entries: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Best weights to every place from every entry, and where the last piece of that path begins."""
        none = np.iinfo(np.int64).min // 2
        best = np.full((self.n + self.pieces.longest, len(entries)), none, dtype=np.int64)
        back = np.full(best.shape, -1, dtype=np.int32)
        best[entries, np.arange(len(entries))] = 0
        for p in range(self.n):
            row = best[p]
            if row.max() <= none // 2:
                continue
            for length, weight in self.pieces.scored(self.text, p):
                end = p + length
                if end > len(self.text):
                    break
                got = row + weight
                better = got > np.maximum(best[end], none // 2)
                np.copyto(best[end], got, where=better)
                back[end, better] = p
        return best, back

    def _ranked(self, back: np.ndarray, end: int, columns: np.ndarray) -> list[int]:
        """Columns in the order of their paths, read from ``end``: pieces that begin further left come first."""
        out, todo = [], [(end, columns)]
        while todo:
            at, group = todo.pop()
            if len(group) < 2:
                out += group.tolist()
                continue
            while (before := back[at, group]).min() == before.max():  # two columns never begin at one place
                at = before[0]
            todo += [(p, group[before == p]) for p in sorted(set(before.tolist()), reverse=True)]
        return out

    def matrix(self) -> list[tuple[str, str, int, int]]:
        """(entry, exit, weight, rank): ``rank`` orders the paths of different entries to an exit."""
        entries, out = self.entries(), []
        best, back = self._forward(entries)
        exits = [0] if self.last else range(min(self.pieces.longest, len(self.text) - self.n + 1))
        for g in exits:
            reached = np.flatnonzero(best[self.n + g] > np.iinfo(np.int64).min // 4)
            for rank, k in enumerate(self._ranked(back, self.n + g, reached)):
                out.append(("" if self.first else str(entries[k]), str(g), int(best[self.n + g, k]), rank))
        return out

    def ids(self, entry: str, exit_: str) -> list[int]:
        """Ids of the pieces that begin in the chunk."""
        end = self.n + int(exit_)
        back = self._forward([int(entry or 0)])[1][:, 0]
        parts = []
        while (p := back[end]) >= 0:
            parts.append(self.text[p:end])
            end = p
        return [i for part in reversed(parts) for i in self.pieces.units(part)]


#: A matrix {entry: {exit: (weight, rank)}}.
Matrix = dict[str, dict[str, tuple[int, int]]]


def _best(left: dict[str, tuple[int, int]], right: Matrix, end: str) -> tuple[str, int] | None:
    """The state between two matrices on the best path to ``end``, and the path's weight."""
    found = [(-w - right[mid][end][0], right[mid][end][1], mid) for mid, (w, _) in left.items() if end in right.get(mid, {})]
    return (min(found)[2], -min(found)[0]) if found else None


def compose(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product of two matrices; ties go to the path that comes first, read from its end."""
    out: Matrix = {e: {} for e in a}
    for end in {x for row in b.values() for x in row}:
        paths = [(e, *found) for e, row in a.items() if (found := _best(row, b, end))]
        paths.sort(key=lambda p: (b[p[1]][end][1], a[p[0]][p[1]][1]))
        for rank, (e, _, weight) in enumerate(paths):
            out[e][end] = (weight, rank)
    return {e: row for e, row in out.items() if row}


def boundary_states(matrices: list[Matrix]) -> list[str]:
    """The state at every cut, the ends included, on the best path; halves are combined, then split again."""

    @functools.cache
    def product(i: int, j: int) -> Matrix:
        return matrices[i] if j == i + 1 else compose(product(i, (i + j) // 2), product((i + j) // 2, j))

    states = [""] * (len(matrices) + 1)
    states[-1] = min(product(0, len(matrices))[""].items(), key=lambda x: (-x[1][0], x[0]))[0]
    todo = [(0, len(matrices))]
    while todo:
        i, j = todo.pop()
        if j == i + 1:
            continue
        m = (i + j) // 2
        states[m] = _best(product(i, m)[states[i]], product(m, j), states[j])[0]
        todo += [(i, m), (m, j)]
    return states


_loaded: dict[int, Pieces] = {}


def _pieces(proto: bytes) -> Pieces:
    key = hash(proto)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(proto)
    return _loaded[key]


#: Documents that a worker holds as Python objects at a time.
DOCS = 128


def _rows(part: pa.RecordBatch, ids: list, pieces: Pieces | None) -> pa.RecordBatch:
    """(row, id, k, ids), and what the ids decode to if ``pieces`` is given."""
    columns = {c: part.column(c) for c in ("row", "id", "k")} | {"ids": pa.array(ids, pa.list_(pa.int32()))}
    if pieces:
        columns["marked"] = pa.array([pieces.decode(x) for x in ids], pa.string())
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _whole(proto: bytes, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(proto)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                yield _rows(part, [pieces.encode_text(t.as_py() or "") for t in part.column("text")], pieces if decoded else None)

    return run


def _chunk(pieces: Pieces, *place) -> Chunk | ScoredChunk:
    return (ScoredChunk if pieces.unigram else Chunk)(pieces, *place)


def _matrices(proto: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(proto)
        for batch in batches:
            for row, k, text, base, start, stop, last in zip(*[batch.column(c).to_pylist() for c in ("row", "k", "text", "base", "start", "stop", "last")], strict=True):
                found = _chunk(pieces, text, base, start, stop, last).matrix()
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), pa.array([k] * len(found), pa.int32()), *[pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int32()), strict=True)]], names=["row", "k", "entry", "exit", "weight", "rank"])

    return run


def _states(pdf: pd.DataFrame) -> pd.DataFrame:
    n = int(pdf["k"].max()) + 1
    matrices: list[Matrix] = [{} for _ in range(n)]
    for k, e, x, w, r in zip(*[pdf[c].tolist() for c in ("k", "entry", "exit", "weight", "rank")], strict=True):
        matrices[k].setdefault(e, {})[x] = (w, r)
    states = boundary_states(matrices)
    return pd.DataFrame({"row": pdf["row"].iloc[0], "k": np.arange(n, dtype=np.int32), "entry": states[:-1], "exit": states[1:]})


def _traced(proto: bytes, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(proto)
        for batch in batches:
            for i in range(batch.num_rows):
                text, base, start, stop, last, entry, exit_ = (batch.column(c)[i].as_py() for c in ("text", "base", "start", "stop", "last", "entry", "exit"))
                ids = _chunk(pieces, text, base, start, stop, last).ids(entry, exit_)
                yield _rows(batch.slice(i, 1), [ids], pieces if decoded else None)

    return run


def _encode_parts(docs: DataFrame, proto: bytes, id_col: str, text_col: str, chunk: int, decoded: bool = False) -> tuple[DataFrame, DataFrame]:
    """(row, id, k, ids) of the documents of one chunk, and of the chunks of all others; with ``decoded`` also marked."""
    around = Pieces(proto).longest + 1
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(slim.dtypes)["id"]
    schema = f"row long, id {kind}, k int, ids array<int>" + ", marked string" * decoded
    long_text = F.coalesce(F.length("text"), F.lit(0)) >= chunk  # the mark before the text counts
    plain = slim.where(~long_text).select(F.lit(None).cast("long").alias("row"), "id", F.lit(0).alias("k"), "text").mapInArrow(_whole(proto, decoded), schema)
    giant = slim.where(long_text).withColumn("row", F.monotonically_increasing_id())
    if chunk < around:
        raise ValueError(f"chunks need {around} characters")
    marked = F.concat(F.lit(SPACE), F.translate("text", " ", SPACE))
    # cut in one pass, then each part takes along the ends of its neighbours
    cut = F.regexp_extract_all(marked, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    ends = lambda parts: F.transform(parts, lambda c, k: F.struct(F.coalesce(F.right(F.get(parts, k - 1), F.lit(around)), F.lit("")).alias("before"), c.alias("part"), F.coalesce(F.left(F.get(parts, k + 1), F.lit(around)), F.lit("")).alias("after"), (k + 1 == F.size(parts)).alias("last")))
    spread = giant.select("row", "id", F.posexplode(let(cut, ends)).alias("k", "c"))
    start = F.col("k") * chunk
    chunks = spread.select("row", "id", "k", F.concat("c.before", "c.part", "c.after").alias("text"), (start - F.length("c.before")).alias("base"), start.alias("start"), (start + F.length("c.part")).alias("stop"), "c.last")
    chunks = table(chunks.repartition("row", "k"), "chunks")
    states = chunks.mapInArrow(_matrices(proto), "row long, k int, entry string, exit string, weight long, rank int").groupBy("row").applyInPandas(_states, "row long, k int, entry string, exit string")
    return plain, chunks.join(states, ["row", "k"]).mapInArrow(_traced(proto, decoded), schema)


def encode(docs: DataFrame, proto: bytes, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(row, id, k, ids): the ids of chunk ``k`` of every document, the same as the library's for the whole text.

    A null or empty text has one chunk without ids. Chunks of a giant document share their number in ``row``,
    which is null for others, so null and repeated ids do no harm. An empty table gives an empty result.
    """
    plain, giant = _encode_parts(docs, proto, id_col, text_col, chunk)
    return plain.unionByName(giant)


def encode_and_decode(docs: DataFrame, proto: bytes, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per document: id, n_chunks, ids and the text that they decode to (empty for null).

    The ids are the library's for the whole text, of any length; under a unigram model they can differ where
    two segmentations are so close that the library's 32-bit sums cannot tell them apart. Null and empty
    texts have one chunk and no ids. Null and repeated ids are rows like any other, other columns are not
    looked at, and an empty table gives an empty result.
    """
    plain, giant = _encode_parts(docs, proto, id_col, text_col, chunk, decoded=True)
    parts = F.array_sort(F.collect_list(F.struct("k", "ids", "marked")))
    whole = giant.groupBy("row", "id").agg(parts.alias("p")).select("id", F.size("p").alias("n_chunks"), F.flatten("p.ids").alias("ids"), F.array_join("p.marked", "").alias("marked"))
    both = plain.select("id", F.lit(1).alias("n_chunks"), "ids", "marked").unionByName(whole)
    return both.select(F.col("id").alias(id_col), "n_chunks", "ids", F.translate(F.expr("substring(marked, 2)"), SPACE, " ").alias("decoded"))



def decode(encoded: DataFrame, proto: bytes) -> DataFrame:
    """``encoded`` (what :func:`encode` gives) with ``marked``: the text of each chunk's ids as pieces spell it.

    Chunks in order spell the document; a chunk without ids spells an empty text. Characters of several bytes
    that no piece holds are spelt whole, for a chunk never ends inside one. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(proto)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                said = [pieces.decode(x.as_py()) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.string())], names=[*part.schema.names, "marked"])

    return encoded.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema) + ", marked string")
