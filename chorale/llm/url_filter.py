"""URL verdicts: ordered host and path rules, then a listed set behind a blocked Bloom filter.

The filter is a table of 512-bit blocks, each eight 64-bit words; a URL picks one block and sets one bit
in every word, so a probe touches a single row. Only URLs whose eight bits are all set reach the hash join
with the list itself, which removes the false positives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.llm.shared import bounded, fits, table

WORDS_IN_BLOCK = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not change what a URL shows.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def url_parts(url: Column) -> dict[str, Column]:
    """host, path, query; all empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return {
        "host": F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        "query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1),
    }


def canonical_url(host: Column, path: Column, query: Column) -> Column:
    """Host and path without closing slashes, then the sorted query without tracking parameters; empty without a host."""
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.when(host == "", F.lit("")).otherwise(F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def with_parts(pages: DataFrame, url_col: str) -> DataFrame:
    """One struct column ``_row`` of the input beside host, path and canonical.

    A null URL, or one without a host, has three empty strings; rows that repeat and long URLs are like any other, an
    empty table gives an empty result, and names of the input clash with nothing, being inside the struct.
    """
    parts = url_parts(F.col(url_col))
    out = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"), *[v.alias(k) for k, v in parts.items()])
    return out.withColumn("canonical", canonical_url(F.col("host"), F.col("path"), F.col("query"))).drop("query")


def _spots(url: Column) -> dict[str, Column]:
    second = F.xxhash64(url, F.lit(1))
    place = lambda k: F.shiftrightunsigned(second, 6 * k).bitwiseAND(F.lit(63)).cast("int")
    return {f"w{k}": F.call_function("shiftleft", F.lit(1).cast("long"), place(k)) for k in range(WORDS_IN_BLOCK)}


def build_filter(listed: DataFrame, bits_per_url: int = 16) -> tuple[DataFrame, int]:
    """Blocks (block, w0..w7) over the distinct ``canonical`` urls of ``listed``, and how many blocks there can be."""
    n_blocks = max(1, -(-listed.count() * bits_per_url // (64 * WORDS_IN_BLOCK)))
    spots = listed.select(F.pmod(F.xxhash64("canonical"), F.lit(n_blocks)).alias("block"), *[c.alias(k) for k, c in _spots(F.col("canonical")).items()])
    return table(spots.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS_IN_BLOCK)]), "bloom"), n_blocks


def probe(rows: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """``rows`` with ``_possible``: false only if ``canonical`` is surely not listed."""
    hit = F.lit(True)
    for k, spot in _spots(F.col("canonical")).items():
        hit = hit & (F.col(k).bitwiseAND(spot) != 0)
    joined = rows.withColumn("block", F.pmod(F.xxhash64("canonical"), F.lit(n_blocks))).join(bounded(blocks), "block", "left")
    return joined.withColumn("_possible", F.coalesce(hit, F.lit(False))).select(*rows.columns, "_possible")


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: tuple[UrlRule, ...], url_col: str = "url", bits_per_url: int = 16) -> DataFrame:
    """``pages`` (as struct ``_row``) with host, path, canonical, rule and verdict.

    ``listed`` has blocked urls in a column ``canonical``; repeats and nulls in it do no harm. The longest
    fitting rule decides, a block rule before an allow rule of the same length; without one, a listed
    url is blocked and any other allowed. A null url has an empty host and path, fits no rule, is not
    listed and is allowed. Rows are never lost or repeated; an empty table gives an empty result.
    """
    urls = table(listed.select("canonical").where("canonical IS NOT NULL AND canonical <> ''").distinct(), "listed")
    blocks, n_blocks = build_filter(urls, bits_per_url)
    rows = with_parts(pages, url_col)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block")):
        hit = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(hit, F.lit(r.name)).otherwise(rule), F.when(hit, F.lit(r.verdict)).otherwise(verdict)
    probed = probe(rows.withColumns({"rule": rule, "verdict": verdict}), blocks, n_blocks)
    open_case = F.col("verdict").isNull() & F.col("_possible")
    columns = ["_row", "host", "path", "canonical", "rule"]
    told = urls.select(F.col("canonical").alias("_url"), F.lit("block").alias("_listed"))
    if fits(urls):  # one pass; rows that are no possible hits have no key to join by
        joined = probed.join(F.broadcast(told), F.when(open_case, F.col("canonical")) == F.col("_url"), "left")
        return joined.select(*columns, F.coalesce("verdict", "_listed", F.lit("allow")).alias("verdict"))
    hits = probed.where(open_case).join(told, F.col("canonical") == F.col("_url"), "left").select(*columns, F.coalesce("_listed", F.lit("allow")).alias("verdict"))
    return hits.unionByName(probed.where(~open_case).select(*columns, F.coalesce("verdict", F.lit("allow")).alias("verdict")))
