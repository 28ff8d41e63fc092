"""Signals: what detectors return, as a struct column, an array of them, or a long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIND = "struct<trap_class:string,signal_name:string,confidence:double,evidence:string,raw_payload:string,detector:string>"
INJECTION, SEMANTIC, CONTROL = "content_injection", "semantic_manipulation", "behavioral_control"


def signal(trap_class: str, name: str | Column, confidence: float | Column, evidence: Column, detector: str, raw: Column | None = None) -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(col(trap_class).alias("trap_class"), col(name).alias("signal_name"), col(confidence).cast("double").alias("confidence"), evidence.cast("string").alias("evidence"), (F.lit(None) if raw is None else F.substring(raw, 1, 1000)).cast("string").alias("raw_payload"), F.lit(detector).alias("detector"))


def some(*signals: Column) -> Column:
    """An array of the signals that aren't null."""
    return F.filter(F.array(*(s.cast(KIND) for s in signals)), lambda s: s.isNotNull())


def joined(*arrays: Column) -> Column:
    """All signals of several arrays, in order; a null array has none."""
    none = F.array().cast(f"array<{KIND}>")
    return F.concat(*(F.coalesce(a.cast(f"array<{KIND}>"), none) for a in arrays))


def long_table(df: DataFrame, signals: str = "signals", id_col: str = "content_id") -> DataFrame:
    """(content_id, ord, the signal's fields), one row for each signal.

    Exploded by the outer form: for the other one Spark adds a filter on the array's size below, and works out all
    detectors a second time for it."""
    return df.select(F.col(id_col).alias("content_id"), F.posexplode_outer(signals).alias("ord", "s")).filter("ord IS NOT NULL").select("content_id", "ord", "s.*")


def array_column(table: DataFrame) -> DataFrame:
    """The reverse: (content_id, signals), in order of ord. One shuffle, by content_id."""
    fields = [f.split(":")[0] for f in KIND[7:-1].split(",")]
    rows = table.groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("s")))).alias("x"))
    return rows.select("content_id", F.transform("x", lambda x: x["s"]).alias("signals"))
