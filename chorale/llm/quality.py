"""Quality rules as a short-circuit cascade ordered by rejection per cost."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.llm.shared import SPACE, let, table, words


def _removed(text: Column, pattern: str) -> Column:
    """How many characters the pattern's matches have."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeat_words(tokens: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that the text has twice or more, each word once.

    Windows are 64-bit hashes of their words; sorted with their places, equal neighbours are repeats.
    """
    hashes = F.when(F.size(tokens) >= width, F.slice(F.transform(tokens, lambda w, i: F.xxhash64(w, *[F.get(tokens, i + k) for k in range(1, width)])), F.lit(1), F.greatest(F.size(tokens) - (width - 1), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
            found = F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
            steps = lambda p: F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(width)), F.lit(width)))
            return F.aggregate(let(found, steps), F.lit(0).cast("long"), lambda a, x: a + x)

        return let(placed, places)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def text_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{SPACE}]"))


@dataclass(frozen=True)
class Stat:
    """A statistic from the text (``t``) and statistics named before it, and what it costs."""

    value: Callable[[], Column]
    #: Nanoseconds for each character, word or line. Measured once and fixed, so that an order can be repeated.
    price: float
    unit: str = "chars"


STATS = {
    "words": Stat(lambda: words(F.col("t")), 220),
    "n_words": Stat(lambda: F.size("words").cast("long"), 1, "words"),
    "word_chars": Stat(lambda: F.length(F.regexp_replace(F.col("t"), rf"[{SPACE}]+", "")).cast("long"), 210),
    "n_symbols": Stat(lambda: _removed(F.col("t"), r"[#*$%&|<>]+"), 100),
    "lines": Stat(lambda: text_lines(F.col("t")), 45),
    "n_lines": Stat(lambda: F.size("lines").cast("long"), 1, "lines"),
    "n_dup_lines": Stat(lambda: (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), 500, "lines"),
    "n_repeat_words": Stat(lambda: repeat_words(F.col("words")), 2600, "words"),
    "n_upper": Stat(lambda: _removed(F.col("t"), r"\p{Lu}+"), 100),
    "n_letters": Stat(lambda: _removed(F.col("t"), r"\p{L}+"), 90),
    "n_letterless": Stat(lambda: F.size(F.filter("words", lambda w: ~w.rlike(r"\p{L}"))).cast("long"), 150, "words"),
    "n_distinct": Stat(lambda: F.size(F.array_distinct("words")).cast("long"), 300, "words"),
    "n_bullets": Stat(lambda: F.size(F.filter("lines", lambda x: x.rlike(rf"^[{SPACE}]*[-*\u2022]"))).cast("long"), 300, "lines"),
    "n_ellipses": Stat(lambda: F.size(F.filter("lines", lambda x: x.rlike(rf"(\.\.\.|\u2026)[{SPACE}]*$"))).cast("long"), 500, "lines"),
}
#: Statistics that are computed from others.
NEEDS = {"n_words": ("words",), "n_repeat_words": ("words",), "n_letterless": ("words",), "n_distinct": ("words",)} | {s: ("lines",) for s in ("n_lines", "n_dup_lines", "n_bullets", "n_ellipses")}


def with_needs(stats: Iterable[str]) -> tuple[str, ...]:
    """``stats``, each after those that it is computed from."""
    return tuple(dict.fromkeys(s for k in stats for s in (*NEEDS.get(k, ()), k)))


#: Distinct whole texts, about, on which the rules are tried before they are ordered.
SAMPLE = 2000


@dataclass(frozen=True)
class Rule:
    """Rejects a document if ``reject`` holds over the statistics that it names."""

    name: str
    stats: tuple[str, ...]
    reject: str
    #: On a sample, as of its place in the order and over the documents that reach it: nanoseconds of what it adds for one, and the share that it rejects.
    cost: float = field(default=0.0, compare=False)
    rejects: float = field(default=0.0, compare=False)


BASE_RULES = (
    Rule("too_few_words", ("words", "n_words"), "n_words < 50"),
    Rule("repeated_windows", ("words", "n_words", "n_repeat_words"), "100 * n_repeat_words > 50 * n_words"),
)
METHOD_RULES = (
    Rule("symbols", ("words", "n_words", "n_symbols"), "10 * n_symbols > n_words"),
    Rule("word_length", ("words", "n_words", "word_chars"), "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    Rule("repeated_lines", ("lines", "n_lines", "n_dup_lines"), "10 * n_dup_lines > 4 * n_lines"),
    Rule("capitals", ("n_letters", "n_upper"), "10 * n_upper > 3 * n_letters"),
    Rule("letterless_words", ("words", "n_words", "n_letterless"), "10 * n_letterless > 2 * n_words"),
    Rule("few_distinct_words", ("words", "n_words", "n_distinct"), "20 * n_distinct < n_words"),
    Rule("bullets", ("lines", "n_lines", "n_bullets"), "10 * n_bullets > 9 * n_lines"),
    Rule("ellipses", ("lines", "n_lines", "n_ellipses"), "10 * n_ellipses > 3 * n_lines"),
)
RULES = BASE_RULES + METHOD_RULES


def _cascade(docs: DataFrame, rules: tuple[Rule, ...], always: tuple[str, ...] = ()) -> DataFrame:
    """Adds _failed (first failing rule, else null) and the statistics; those not in ``always`` are computed only while no rule has failed."""
    have: set[str] = set()
    out = docs.withColumn("_failed", F.lit(None).cast("string"))
    for stat in with_needs(always):
        out = out.withColumn(stat, STATS[stat].value())
        have.add(stat)
    for rule in rules:
        for stat in rule.stats:
            if stat not in have:
                out = out.withColumn(stat, F.when(F.col("_failed").isNull(), STATS[stat].value()))
                have.add(stat)
        out = out.withColumn("_failed", F.when(F.col("_failed").isNull(), F.when(F.expr(rule.reject), F.lit(rule.name))).otherwise(F.col("_failed")))
    return out


def _fenced(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``df`` with columns that no condition is pushed through: below, the rules would be run again and again, for every word."""
    here = F.monotonically_increasing_id() >= 0
    return df.withColumns({c: F.when(here, F.col(c)) for c in names})


def _patterns(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int) -> list[dict]:
    """For each set of rules that reject a document of the sample: how many do, and their characters, words and lines."""
    total = docs.count()
    if not total:
        return []
    mark = F.xxhash64("t", F.lit("rules"))
    chosen = docs.select("t", mark.alias("m")).where(F.col("m").cast("double") / F.lit(2.0**64) + 0.5 < min(1.0, sample_rows / total))
    sample = chosen.groupBy("m").agg(F.min("t").alias("t"), F.count("*").alias("n"))
    every = tuple(dict.fromkeys(s for r in rules for s in r.stats))
    judged = _fenced(_cascade(sample, (), every), every).select("n", F.array(*[F.coalesce(F.expr(r.reject), F.lit(False)) for r in rules]).alias("hit"), F.length("t").alias("chars"), F.regexp_count("t", F.lit(rf"[^{SPACE}]+")).alias("words"), F.regexp_count("t", F.lit("\n")).alias("lines"))
    sums = table(judged, "rules").groupBy("hit").agg(F.sum("n").alias("docs"), *[F.sum(F.col(u) * F.col("n")).alias(u) for u in ("chars", "words", "lines")])
    return [r.asDict() for r in sums.collect()]  # 2 ** rules rows at most


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE, always: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """Rules by rejection per cost, highest first, each as of its place in the order.

    ``docs`` has the text as ``t``. About ``sample_rows`` distinct whole texts are chosen by their hash and
    weigh as much as they have copies. A rule's cost is the work of those of its statistics that neither
    ``always`` nor an earlier rule has computed, its rejection what it rejects, both for a document that
    earlier rules let through. Work is counted, not timed, so a table gives the same order in every run and partitioning. Only
    the order depends on the sample, never a verdict.
    """
    alive = _patterns(docs, rules, sample_rows)
    if not alive:
        return tuple(rules)
    have, left, out = set(with_needs(always)), list(enumerate(rules)), []
    while left:
        reached = max(sum(p["docs"] for p in alive), 1)

        def weigh(rule: Rule, k: int, reached: int = reached) -> Rule:
            work = sum(STATS[s].price * p[STATS[s].unit] for s in rule.stats if s not in have for p in alive)
            return replace(rule, cost=max(work / reached, 1.0), rejects=sum(p["docs"] for p in alive if p["hit"][k]) / reached)

        k, best = min(((k, weigh(r, k)) for k, r in left), key=lambda x: (-x[1].rejects / x[1].cost, x[1].cost, x[1].name))
        out.append(best)
        have |= set(best.stats)
        alive = [p for p in alive if not p["hit"][k]]
        left = [x for x in left if x[0] != k]
    return tuple(out)


def quality_cascade(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE, keep_stats: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``_kept`` and ``_failed`` (the first rule that rejected it in the chosen order).

    The statistics in ``keep_stats`` are computed for every row and added under their names; columns of
    ``docs`` with the same names are replaced. All others are computed only for rows that no rule has
    rejected so far. Null text counts as empty and has no words; an empty table gives an empty result. A row
    is kept if no rule rejects it, whatever the order.
    """
    out = _judge(docs, text_col, rules, sample_rows, keep_stats)
    own = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in (*keep_stats, "_failed", "_kept")]
    return out.select(*own, *keep_stats, "_failed", F.col("_failed").isNull().alias("_kept"))


def _judge(docs: DataFrame, text_col: str, rules: tuple[Rule, ...], sample_rows: int, keep_stats: tuple[str, ...]) -> DataFrame:
    """The rows as struct _row beside _failed and the statistics."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("t")
    always = with_needs(keep_stats)
    order = order_rules(docs.select(text), rules, sample_rows, always)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text)
    return _fenced(_cascade(rows, order, always), (*always, "_failed"))


def keep_quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, columns unchanged, whatever their names.

    A null text has no words and is rejected like an empty one; rows that repeat stay or go together; an
    empty table gives an empty result.
    """
    return _judge(docs, text_col, rules, SAMPLE, ()).where(F.col("_failed").isNull()).select("_row.*")
