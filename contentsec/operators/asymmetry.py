"""Fetch asymmetry: what a page shows to people and what it shows to bots.

Fetching itself stays outside Spark; fetches(url, ua, is_human, status, content_length, body) has its results.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentsec.config import Config
from contentsec.functions import html as H
from contentsec.functions.batches import in_parts


#: What is compared of two pages.
_COMPARED = ("visible_text", "tag_counts", "meta_signatures", "canonical", "og")


@functools.cache
def _ratio() -> Callable[..., Column]:
    @F.arrow_udf("double")
    def run(texts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        from contentsec.functions.likeness import ratio

        def least(*sides: list) -> list:
            rows = zip(*(zip(a, b, strict=True) for a, b in zip(sides[::2], sides[1::2], strict=True)), strict=True)
            return [min((ratio(a, b) for a, b in pairs if a is not None), default=None) for pairs in rows]

        yield from in_parts(texts, least, pa.float64())

    return run


def similarity(a: Column, b: Column, *more: Column) -> Column:
    """How much of two texts is in common, in order; of further pairs of texts too, the least. All pairs share one Arrow
    step, so a task has one Python worker for them, which only texts that differ reach."""
    sides, known = [], []
    for x, y in zip((a, *more[::2]), (b, *more[1::2]), strict=True):
        x, y = F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))
        differ = (x != y) & (x != "") & (y != "")
        known.append(F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0))
        sides += [F.when(differ, x), F.when(differ, y)]
    return F.least(*known, _ratio()(*sides))


#: White space as (?U)\s has it, spaces left out. Single characters, and few classes in one, cost Java's matcher least.
_ODD = r"\t\n\x0B\f\r\x{85}\x{A0}[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"


def content_hash(visible: Column) -> Column:
    """Of the lower case with each run of white space as one space, none at the ends; single spaces are left alone."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(visible, f"[{_ODD}][ {_ODD}]*| [ {_ODD}]+", " "))), 256)


def _same_content(a: Column, b: Column) -> Column:
    """Whether the hashes are the same; they are worked out for texts that differ."""
    return F.when(a == b, True).otherwise(content_hash(a) == content_hash(b))


def tag_delta(human: Column, bot: Column) -> Column:
    """Elements that the bot's page has more (or less) of than the human's."""
    return F.map_filter(F.map_zip_with(bot, human, lambda _, b, h: F.coalesce(b, F.lit(0)) - F.coalesce(h, F.lit(0))), lambda _, d: d != 0)


def _size(delta: Column) -> Column:
    return F.aggregate(F.map_values(delta), F.lit(0), lambda n, d: n + F.abs(d))


def compare(fetches: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """One row for each url with a human fetch: the worst bot's differences, and whether they show asymmetry."""
    parsed = fetches.select("url", "ua", "is_human", "status", "content_length", "body", H.parse(F.col("body"), *_COMPARED).alias("p"))
    page = lambda is_human, alias: parsed.filter(F.col("is_human") == is_human).select("url", *(["ua"] if not is_human else []), F.struct("status", "content_length", "body", "p").alias(alias))
    pairs = page(True, "h").join(page(False, "b"), "url", "left")
    some_bot = F.col("b").isNotNull()
    difference = F.when(some_bot, 1 - similarity(F.col("h.p.visible_text"), F.col("b.p.visible_text"), F.col("h.body"), F.col("b.body"))).otherwise(0.0)
    metas = F.array_sort(F.concat(F.array_except("b.p.meta_signatures", "h.p.meta_signatures"), F.array_except("h.p.meta_signatures", "b.p.meta_signatures")))
    canonical = F.coalesce((F.col("h.p.canonical") != F.col("b.p.canonical")) & (F.col("h.p.canonical") != "") & (F.col("b.p.canonical") != ""), F.lit(False))
    og = F.coalesce(F.exists(F.map_values(F.map_zip_with("h.p.og", "b.p.og", lambda _, x, y: F.coalesce(x != y, F.lit(False)))), lambda d: d), F.lit(False))
    rows = pairs.select(
        "url",
        "ua",
        difference.alias("difference"),
        F.coalesce(F.col("h.status") != F.col("b.status"), F.lit(False)).alias("status"),
        F.coalesce(F.col("h.content_length") != F.col("b.content_length"), F.lit(False)).alias("length"),
        (canonical | og).alias("canonical"),
        (some_bot & ~_same_content(F.col("h.p.visible_text"), F.col("b.p.visible_text"))).alias("hash"),
        F.when(some_bot, tag_delta(F.col("h.p.tag_counts"), F.col("b.p.tag_counts"))).alias("delta"),
        F.coalesce(metas, F.array().cast("array<string>")).alias("metas"),
    )
    by = rows.groupBy("url").agg(
        F.max("difference").alias("asymmetry_score"),
        F.array_sort(F.collect_set(F.when(F.col("difference") > config.asymmetry_threshold, F.col("ua")))).alias("suspicious_agents"),
        F.bool_or("status").alias("status_mismatch"),
        F.bool_or("length").alias("content_length_mismatch"),
        F.bool_or("canonical").alias("canonical_mismatch"),
        F.bool_or("hash").alias("hash_mismatch"),
        F.max_by(F.to_json("delta"), _size(F.col("delta"))).alias("dom_delta"),
        F.bool_or(F.coalesce(F.exists(F.map_values("delta"), lambda d: d > 0), F.lit(False))).alias("dom_grew"),
        F.max_by("metas", F.size("metas")).alias("meta_difference"),
    )
    detected = (F.col("asymmetry_score") > config.asymmetry_threshold) | F.col("status_mismatch") | F.col("canonical_mismatch") | F.col("hash_mismatch") | F.col("dom_grew") | (F.size("meta_difference") > 0)
    return by.withColumn("asymmetry_detected", detected)


def against_archive(pages: DataFrame, archive: DataFrame) -> DataFrame:
    """(url, matches) of pages(url, visible_text) against archive(url, visible_text)."""
    both = pages.join(archive.select("url", F.col("visible_text").alias("old")), "url").withColumn("same", _same_content(F.col("visible_text"), F.col("old")))
    text = lambda c: F.when(F.coalesce("same", F.lit(True)), F.col(c))  # noqa: E731  of others it doesn't matter how like they are
    return both.select("url", ((similarity(text("visible_text"), text("old")) > 0.9) & F.col("same")).alias("matches"))
