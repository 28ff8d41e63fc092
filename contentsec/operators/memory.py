"""Memory provenance: trust decays with each hop, weak writes are refused, conflicting ones are flagged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentsec.config import Config

FLOOR, PROTECTED = 0.02, 0.35
TIERS = (("GREEN", 0.65), ("YELLOW", 0.35), ("RED", 0.15), ("QUARANTINE", 0.0))


def tier(trust: Column) -> Column:
    out = F.lit("QUARANTINE")
    for name, least in reversed(TIERS[:3]):
        out = F.when(trust >= least, name).otherwise(out)
    return out


def gate(log: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """log(seq, key, value, trust, chain, ...) with effective_trust, trust_tier, content_hash and outcome: circular,
    too_long, rejected, quarantined or stored."""
    hops = F.coalesce(F.size("chain"), F.lit(0))
    hops = F.when(hops < 0, 0).otherwise(hops)
    trust = F.greatest(F.col("trust") * F.pow(F.lit(0.5), hops), F.lit(FLOOR))
    outcome = (
        F.when(F.coalesce(F.size(F.array_distinct("chain")) < F.size("chain"), F.lit(False)), "circular")
        .when(hops > config.most_hops, "too_long")
        .when(F.col("effective_trust") < config.memory_trust, "rejected")
        .when(F.col("effective_trust") < config.memory_quarantine, "quarantined")
        .otherwise("stored")
    )
    rows = log.withColumn("effective_trust", trust)
    return rows.select("*", tier(F.col("effective_trust")).alias("trust_tier"), F.sha2(F.col("value").cast("string"), 256).alias("content_hash"), outcome.alias("outcome"))


def latest(gated: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """The memory after all writes: the last kept write of each key in each place (stored or quarantined)."""
    order = Window.partitionBy("key", "outcome").orderBy(F.col("seq").desc())
    rows = gated.filter(F.col("outcome").isin("stored", "quarantined")).withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")
    return rows.orderBy(F.col("seq").desc()).limit(config.memory_entries) if config.memory_entries else rows


def read(memory: DataFrame) -> DataFrame:
    """One row for each key: what is stored, or else what is quarantined."""
    order = Window.partitionBy("key").orderBy(F.when(F.col("outcome") == "stored", 0).otherwise(1))
    return memory.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def unlike(old: Column, new: Column) -> Column:
    """Whether two texts differ much: in length by half, or in half of the places."""
    a, b = F.length(old), F.length(new)
    most = F.greatest(a, b)
    chars = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    same = F.aggregate(F.zip_with(chars(old), chars(new), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda n, x: n + x)
    return F.when(most == 0, False).when(F.least(a, b) / most < 0.5, True).otherwise(same / most < 0.5)


def conflicts(gated: DataFrame) -> DataFrame:
    """(seq, key, violation): whether each write differs much from what the key held, if that deserves protection.

    What it held is the last stored value before the write, an as-of look back over the key's writes."""
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    held = F.last(F.when(F.col("outcome") == "stored", F.struct("value", "effective_trust")), ignorenulls=True).over(before)
    rows = gated.withColumn("held", held)
    bad = (F.col("held.effective_trust") >= PROTECTED) & unlike(F.col("held.value").cast("string"), F.col("value").cast("string"))
    return rows.select("seq", "key", F.coalesce(bad, F.lit(False)).alias("violation"))


def clear(memory: DataFrame, at_least: str | None = None) -> DataFrame:
    """What is left after clearing all entries with the trust of a tier or more; all of them without a tier."""
    return memory.filter(F.col("effective_trust") < dict(TIERS)[at_least]) if at_least else memory.limit(0)


def context(memory: DataFrame) -> DataFrame:
    """(key, trust_context): each entry's provenance in words."""
    return read(memory).select("key", F.format_string("[%s] trust %.2f, %d hops, source %s", "trust_tier", "effective_trust", F.greatest(F.size("chain"), F.lit(0)), F.coalesce(F.col("source_url") if "source_url" in memory.columns else F.lit(None).cast("string"), F.lit("unknown"))).alias("trust_context"))


def provenance(memory: DataFrame) -> DataFrame:
    """(key, entry): each entry as JSON."""
    return memory.select("key", F.to_json(F.struct("value", "effective_trust", "trust_tier", "chain", "content_hash", "outcome")).alias("entry"))


def quarantined(memory: DataFrame) -> DataFrame:
    """The entries in quarantine, for a person to look at."""
    return memory.filter("outcome = 'quarantined'").select("key", "seq", "value", "effective_trust", "trust_tier", "content_hash")
