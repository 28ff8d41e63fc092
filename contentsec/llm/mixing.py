"""Mixing sources to target weights by capped water-filling, DataFrame functions only.

Each source's target is the smaller of its cap (max_epochs times its size) and a common level times its weight; the
level that spends the whole budget follows in closed form from running sums over sources in order of cap per weight.
A source's target becomes whole repetitions of every document, and a remainder that documents fill in the order of a
seeded hash; the last of them gives part of its words. The remainder is found without sorting a source: sizes are
summed by the hash's first 12 bits, the running sum shows the one bin in which the remainder ends, and only that bin
(1/4096 of the source) is ordered. A hot source is thus never in one task.

Sizes are words `[^\\x20\\x09-\\x0D]+`; null text has none and takes none. A null source is a source, the last. Rows with
the same doc_id, source and size are alike: what they take together is divided evenly, rounded down. A budget above
all caps gives every source its cap. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentsec.llm.common import materialize

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5, 2, 1), 1.5, 2, "mix"
WORD = r"[^\x20\x09-\x0D]+"


def _source_key(col: str):
    """Never null: equal for equal sources."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit(""))


def _order(doc_id: str, seed: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))


def sized(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, key, h): what the mix needs of each document, written out once."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("bigint")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    return materialize(rows.select("*", _source_key("source").alias("key"), _order("doc_id", seed).alias("h")), "sized")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(key, source, source_size, target): water-filling over (key, source, size) rows.

    Its windows run over one row for each source."""
    per = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = per.select("*", weight.alias("w"), (F.col("source_size") * max_epochs).alias("cap"))
    rising = Window.orderBy(F.col("cap") / F.col("w"), "key")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", (F.sum("source_size").over(whole) * F.lit(share)).alias("budget"), F.sum("w").over(whole).alias("w_all"), F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"))
    rows = rows.withColumn("level", (F.col("budget") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")))
    free = F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct("w_before", "level"))
    rows = rows.withColumn("level", F.min(free).over(whole)["level"])  # that of the first source below its cap
    return rows.select("key", "source", "source_size", F.coalesce(F.least(F.col("level") * F.col("w"), F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))


def plan(sizes: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """For each source (key, source_size, target, whole, rest, edge, edge_before), and what documents of the edge bins
    take of the remainder (key, doc_id, size, extra). Both are written out, so later joins know their sizes."""
    quota = F.floor(F.col("target") + 0.5).cast("bigint")
    of = materialize(targets(sizes, **how).select("key", "source_size", "target", F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.lit(0)).alias("whole"), quota.alias("quota")), "targets")
    of = of.select("*", (F.col("quota") - F.col("whole") * F.col("source_size")).alias("rest"))
    bins = sizes.groupBy("key", F.substring("h", 1, 3).alias("bin")).agg(F.sum("size").alias("bin_size"))
    upto = bins.select("*", F.sum("bin_size").over(Window.partitionBy("key").orderBy("bin")).alias("upto")).join(of.select("key", "rest"), "key")
    edges = upto.filter(F.col("upto") > F.col("rest")).groupBy("key").agg(F.min(F.struct("bin", (F.col("upto") - F.col("bin_size")).alias("before"))).alias("e"))
    of = materialize(of.join(edges, "key", "left").select("key", "source_size", "target", "whole", "rest", F.col("e.bin").alias("edge"), F.col("e.before").alias("edge_before")), "plan")
    alike = sizes.join(of.select("key", "rest", "edge", "edge_before"), "key").filter(F.substring("h", 1, 3) == F.col("edge")).groupBy("key", "rest", "edge_before", "h", "doc_id", "size").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("key").orderBy("h", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("edge_before")
    given = F.greatest(F.lit(0), F.least(F.col("size") * F.col("n"), F.col("rest") - before))
    return of, materialize(alike.select("key", "doc_id", "size", "n", given.alias("given")).selectExpr("key edge_key", "doc_id edge_id", "size edge_doc_size", "given div n extra"), "edges")


def _taken(rows: DataFrame, of: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (with doc_id, key, h, size) with source_size, target, taken."""
    rows = rows.join(of, "key").join(edges, (F.col("key") == F.col("edge_key")) & F.col("doc_id").eqNullSafe(F.col("edge_id")) & (F.col("size") == F.col("edge_doc_size")) & (F.substring("h", 1, 3) == F.col("edge")), "left")
    extra = F.when(F.col("edge").isNull() | (F.substring("h", 1, 3) < F.col("edge")), F.col("size")).when(F.substring("h", 1, 3) > F.col("edge"), F.lit(0)).otherwise(F.coalesce("extra", F.lit(0)))
    return rows.withColumn("taken", F.col("whole") * F.col("size") + extra)


def mixture(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row for each row of docs."""
    sizes = sized(docs, seed, id_col, text_col, source_col)
    return _taken(sizes, *plan(sizes, **how)).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """The mix itself, with the columns of docs (doc_id, text, source, n_chars and others): each document as often as
    it is taken, a part of a repetition as its first words, one space between; documents of which nothing is taken go."""
    sizes = sized(docs, seed)
    of, edges = plan(sizes, **how)
    named = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"), _source_key("source").alias("key"), _order("doc_id", seed).alias("h"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("size"))
    rows = _taken(named, of, edges).filter("taken > 0")
    rows = rows.select("_row", "size", F.expr("explode(concat(array_repeat(size, cast(taken div size as int)), if(taken % size > 0, array(taken % size), array())))").alias("words"))
    text = F.when(F.col("words") == F.col("size"), F.col("_row.text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("_row.text", F.lit(WORD), F.lit(0)), 1, F.col("words").cast("int")), " "))
    rows = rows.withColumn("_text", text)
    kept = {"text": F.col("_text"), "n_chars": F.length("_text").cast("bigint")}
    return rows.select(*(kept.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
