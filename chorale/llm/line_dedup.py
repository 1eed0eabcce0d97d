"""Removal of multi-line chunks that repeat across a corpus.

Each line becomes a 48-bit code, and a rolling hash runs over the codes of two lines. SCALES says at which of its
values, by divisor and remainder, a line ends a chunk, so there are several cuts of a text, finer and coarser, that
depend on nearby lines only: an insertion elsewhere does not move them. From every boundary a chunk goes to the
first one that is LEAST lines or more away, or MOST lines after which it is closed anyhow. Chunks with several
worded lines are named by hash and counted over the corpus; the bytes of those found twice are compared, and all
but the first occurrence are removed. Lines at the ends of a passage that no
scale's chunk covers stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.shared import SPACE, bounded, fits, is_empty, let, table

#: Multipliers and modulus of the rolling hash; products stay below 2 ** 63.
FACTORS = (31, 1_000_003)
MODULUS = 2_147_483_647
#: Lines of a chunk: no fewer from a boundary to the one that closes it, no more in any chunk.
LEAST, MOST = 2, 64
#: A line is a boundary of a scale if the rolling hash has this remainder by this divisor.
SCALES = ((2, 0), (2, 1), (3, 0), (3, 1), (3, 2))


def line_code(line: Column) -> Column:
    """The first 48 bits of a line's MD5, reduced."""
    return F.pmod(F.conv(F.substring(F.md5(line), 1, 12), 16, 10).cast("long"), F.lit(MODULUS))


def chunk_spans(lines: Column, scales: tuple[tuple[int, int], ...] = SCALES) -> Column:
    """Array of (start, lines): the different chunks of a text's lines by all scales, counted from 1."""

    def by_codes(codes: Column) -> Column:
        roll = lambda i: sum((F.coalesce(F.get(codes, i - k), F.lit(0)) * factor for k, factor in enumerate(FACTORS)), F.lit(0).cast("long"))
        return let(F.transform(codes, lambda c, i: roll(i) % MODULUS), lambda rolled: F.array_distinct(F.concat(*[by_scale(rolled, *scale) for scale in scales])))

    def by_scale(rolled: Column, divisor: int, remainder: int) -> Column:
        last = F.size(rolled)
        closed = F.filter(F.transform(rolled, lambda x, i: F.when(x % divisor == remainder, i + 1)), lambda x: x.isNotNull())
        return let(F.array_union(F.concat(F.array(F.lit(0)), closed), F.array(last)), spans)

    def spans(ends: Column) -> Column:
        def one(at: Column, j: Column) -> Column:
            far = [F.get(ends, j + k) for k in range(1, LEAST + 1)]
            stop = F.coalesce(*[F.when(x - at >= LEAST, x) for x in far[:-1]], *far[::-1])
            return F.transform(F.sequence(at + 1, stop, F.lit(MOST)), lambda a: F.struct(a.alias("start"), F.least(F.lit(MOST), stop - a + 1).alias("lines")))

        return F.flatten(F.transform(F.slice(ends, 1, F.size(ends) - 1), one))

    return let(F.transform(lines, line_code), by_codes)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _part(lines: Column, span: Column) -> Column:
    return F.array_join(F.slice(lines, span["start"], span["lines"]), "\n")


#: A text with two worded lines.
SEVERAL = rf"[^{SPACE}][^\n]*\n(?s:.*)[^{SPACE}]"


def _name(text: Column) -> Column:
    """The first 128 bits of a text's SHA-256."""
    return F.unhex(F.left(F.sha2(text, 256), F.lit(32)))


def chunk_texts(lines: Column, scales: tuple[tuple[int, int], ...] = SCALES) -> Column:
    """Array of (start, lines, chunk): the chunks with two worded lines or more and their texts."""

    def text(s: Column) -> Column:
        return F.when(s["lines"] > 1, let(_part(lines, s), lambda t: F.when(t.rlike(SEVERAL), F.struct(s["start"].alias("start"), s["lines"].alias("lines"), t.alias("chunk")))))

    return F.filter(F.transform(chunk_spans(lines, scales), text), lambda x: x.isNotNull())


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scales: tuple[tuple[int, int], ...] = SCALES) -> DataFrame:
    """One row per input row: the row as struct ``_row``, cleaned, n_lines, n_removed_chunks, n_removed_lines.

    The first occurrence of a repeated chunk, by id (null last) and place, stays, and with it the first of every
    worded line. Rows that repeat both id and text count as one document and get the same result. Null and empty
    texts have one empty line and lose nothing; a null text stays null; whole texts of any length are cut; an
    empty table gives an empty result. A text of which everything is removed becomes empty. A chunk that overlaps
    its first occurrence stays. Chunks whose 128-bit names are equal and bytes are not go by their bytes.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("t"))
    cut = lambda: slim.select("id", "mark", F.explode(let(_lines(F.col("t")), lambda x: chunk_texts(x, scales))).alias("s")).select("id", "mark", F.col("s.start").alias("start"), F.col("s.lines").alias("lines"), F.col("s.chunk").alias("chunk")).withColumn("key", _name(F.col("chunk")))
    spans = table(cut().drop("chunk"), "spans")
    place = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark", "start", "lines")).alias("first")
    repeated = table(spans.groupBy("key").agg(place, F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    names = bounded(table(repeated.select("key"), "chunk-names"))
    texts = cut().select("key", "chunk").join(names, "key", "left_semi").distinct()  # of the same bytes one is left before the shuffle
    clashes = table(texts.groupBy("key").count().where("count > 1").select("key"), "clashes")
    if not is_empty(clashes):  # different texts of one name: their bytes tell them apart
        told = cut().join(F.broadcast(clashes) if fits(clashes) else clashes, "key", "left_semi").withColumn("key", F.concat("key", F.col("chunk").cast("binary")))
        spans = table(spans.join(clashes, "key", "left_anti").unionByName(told.drop("chunk")), "spans")
        repeated = table(spans.groupBy("key").agg(place, F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    found = spans.alias("k").join(bounded(repeated).alias("r"), F.col("k.key") == F.col("r.key"))
    extra = found.where(~(F.col("k.id").eqNullSafe(F.col("r.first.id")) & (F.col("k.mark") == F.col("r.first.mark")) & (F.col("k.start") < F.col("r.first.start") + F.col("r.first.lines"))))
    # touching and overlapping spans of a document become one
    own = extra.select("k.id", "k.mark", "k.start", (F.col("k.start") + F.col("k.lines") - 1).alias("stop")).distinct()
    doc = Window.partitionBy("id", "mark")
    before = F.max("stop").over(doc.orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    runs_of = own.withColumn("new", (F.col("start") > F.coalesce(before, F.lit(-1)) + 1).cast("int")).withColumn("run", F.sum("new").over(doc.orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs_of.groupBy("id", "mark", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("chunks"))
    cuts = table(merged.groupBy(F.col("id").alias("cut_id"), F.col("mark").alias("cut_mark")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"), F.sum("chunks").alias("chunks")), "cuts")

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("t"))
    cuts = bounded(cuts)
    joined = row.join(cuts, row["id"].eqNullSafe(cuts["cut_id"]) & (row["mark"] == cuts["cut_mark"]), "left")
    gone = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["stop"])))

    def without(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(1), F.size(lines)), gone)
        return let(kept, lambda k: F.struct(F.array_join(F.transform(k, lambda i: F.get(lines, i - 1)), "\n").alias("text"), (F.size(lines) - F.size(k)).alias("lines")))

    split = F.when(F.col("spans").isNotNull(), let(F.split("t", "\n"), without))
    out = joined.select("_row", "t", "spans", "chunks", split.alias("split"))
    return out.select(
        "_row",
        F.when(F.col("spans").isNull(), F.col("t")).otherwise(F.col("split.text")).alias("cleaned"),
        F.size(F.split(F.coalesce("t", F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.coalesce("chunks", F.lit(0).cast("long")).alias("n_removed_chunks"),
        F.coalesce("split.lines", F.lit(0)).cast("long").alias("n_removed_lines"),
    )
