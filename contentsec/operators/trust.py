"""Trust scores: signals are clustered by detector, weighed, scaled and summed, and the score is given a tier.

score_array() works inside a row, without a shuffle, on the array that a scan makes; score_table() does the same on a
long signal table with one shuffle by content_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentsec import patterns
from contentsec.config import Config

BOOST_OVER, BOOST, STEP, AMPLIFY = 0.85, 1.5, 0.3, 1.3


def weight(detector: Column, config: Config) -> Column:
    out = F.lit(config.other_weight)
    for name, w in config.weights:
        out = F.when(detector == name, w).otherwise(out)
    return out


def _penalty(confidence: Column, detector: Column, place: Column, config: Config) -> Column:
    raised = F.when(confidence > BOOST_OVER, confidence * BOOST).otherwise(confidence)
    return raised * weight(detector, config) * (1 + STEP * F.log1p(place.cast("double")))


def tier(score: Column, config: Config) -> Column:
    yellow, red = config.thresholds()
    return F.when(score >= yellow, "GREEN").when(score >= red, "YELLOW").when(score >= config.quarantine, "RED").otherwise("QUARANTINE")


def action(tier_col: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in patterns.TIER_ACTIONS for x in pair))[tier_col]


def _clamped(total: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - total))


def score_array(signals: Column, config: Config = Config(), asymmetry: Column | None = None) -> Column:  # noqa: B008
    """The score of an array of signals in order; asymmetry: the score of a detected asymmetry, or null."""
    detectors = F.array_distinct(F.transform(signals, lambda s: s["detector"]))

    def winner(d: Column) -> Column:
        own = F.filter(signals, lambda s: s["detector"] == d)
        most = F.array_max(F.transform(own, lambda s: s["confidence"]))
        return F.element_at(F.filter(own, lambda s: s["confidence"] == most), 1)

    won = F.transform(detectors, winner)
    total = F.aggregate(F.transform(won, lambda s, i: _penalty(s["confidence"], s["detector"], i, config)), F.lit(0.0), lambda a, b: a + b)
    total = total + F.coalesce(asymmetry if asymmetry is not None else F.lit(0.0), F.lit(0.0)) * dict(config.weights)["asymmetry"]
    classes = F.array_distinct(F.transform(won, lambda s: s["trap_class"]))
    high = F.array_distinct(F.transform(F.filter(won, lambda s: s["confidence"] > 0.7), lambda s: s["trap_class"]))
    return _clamped(F.when((F.size(classes) >= 3) & (F.size(high) >= 2), total * AMPLIFY).otherwise(total))


def clusters(signals: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """(content_id, detector, trap_class, confidence, place, penalty): the strongest signal of each detector, the first
    of equals; place counts detectors from 0 by first appearance. One shuffle: by content_id, which serves both steps."""
    by = signals.repartition("content_id").groupBy("content_id", "detector").agg(F.max_by(F.struct("trap_class", "confidence"), F.struct("confidence", -F.col("ord"))).alias("best"), F.min("ord").alias("first"))
    place = F.row_number().over(Window.partitionBy("content_id").orderBy("first")) - 1
    rows = by.select("content_id", "detector", "best.trap_class", "best.confidence", place.alias("place"))
    return rows.withColumn("penalty", _penalty(F.col("confidence"), F.col("detector"), F.col("place"), config))


def score_table(signals: DataFrame, asymmetry: DataFrame | None = None, config: Config = Config()) -> DataFrame:  # noqa: B008
    """(content_id, n_detectors, amplified, composite_score, trust_tier, action_taken) of ids with a signal or a row in
    asymmetry (content_id, asymmetry_score, asymmetry_detected)."""
    won = clusters(signals, config)
    sums = won.groupBy("content_id").agg(F.sum("penalty").alias("total"), F.count("*").alias("n_detectors"), F.count_distinct("trap_class").alias("classes"), F.count_distinct(F.when(F.col("confidence") > 0.7, F.col("trap_class"))).alias("high"))
    if asymmetry is not None:
        sums = sums.join(asymmetry.select("content_id", F.when(F.col("asymmetry_detected"), F.col("asymmetry_score")).alias("asymmetry")), "content_id", "full")
    else:
        sums = sums.withColumn("asymmetry", F.lit(0.0))
    total = F.coalesce("total", F.lit(0.0)) + F.coalesce("asymmetry", F.lit(0.0)) * dict(config.weights)["asymmetry"]
    amplified = F.coalesce((F.col("classes") >= 3) & (F.col("high") >= 2), F.lit(False))
    rows = sums.select("content_id", F.coalesce("n_detectors", F.lit(0)).cast("bigint").alias("n_detectors"), amplified.alias("amplified"), _clamped(F.when(amplified, total * AMPLIFY).otherwise(total)).alias("composite_score"))
    level = tier(F.col("composite_score"), config)
    return rows.select("*", level.alias("trust_tier"), action(level).alias("action_taken"))


def top(signals: DataFrame, most: int = 5) -> DataFrame:
    """The strongest signals of each content, at most `most`, earlier ones first among equals."""
    order = Window.partitionBy("content_id").orderBy(F.col("confidence").desc(), "ord")
    return signals.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def summary(reports: DataFrame) -> DataFrame:
    """(content_id, summary): a report in words, its five strongest signals with evidence cut to 150 characters."""
    strongest = F.slice(F.array_sort(F.transform("signals", lambda s, i: F.struct((-s["confidence"]).alias("c"), i.alias("i"), s.alias("s")))), 1, 5)
    lines = F.transform(strongest, lambda x: F.concat(F.lit("- "), x["s"]["signal_name"], F.lit(" ("), F.format_number(x["s"]["confidence"], 2), F.lit("): "), F.substring(x["s"]["evidence"], 1, 150)))
    head = F.concat(F.lit("Tier "), F.col("trust_tier"), F.lit(", score "), F.format_number("composite_score", 2), F.lit(", action "), F.col("action_taken"))
    return reports.select("content_id", F.concat_ws("\n", head, F.array_join(lines, "\n")).alias("summary"))


def as_json(reports: DataFrame) -> DataFrame:
    """(content_id, report): each report as JSON; nulls are left out."""
    return reports.select("content_id", F.to_json(F.struct("*")).alias("report"))
