"""Semantic manipulation: framing, personas and self-replication in plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentsec import patterns
from contentsec.functions import text as T
from contentsec.operators.signals import SEMANTIC, joined, signal, some

DETECTOR = "semantic_manipulation"
SCALES = ((200, 0.80), (500, 0.70), (1000, 0.55), (2000, 0.40))
CHUNK, OVERLAP = 1500, 500
REACH = SCALES[-1][0]


def _signal(name: str, confidence: float | Column, evidence: Column, text: Column) -> Column:
    return signal(SEMANTIC, name, confidence, evidence, DETECTOR, text)


def _graded(text: Column, these: tuple[str, ...], name: str, levels: tuple[float, float, float], low: Column | None) -> Column:
    def judged(found: Column) -> Column:
        n = F.size(found)
        confidence = F.when(n == 1, levels[0]).when(n == 2, levels[1]).otherwise(levels[2])
        return F.when(n > 0, _signal(name, confidence, F.array_join(F.slice(found, 1, 5), "; "), text))

    return T.let(T.matched_patterns(text, these, low), judged)


def authority(text: Column, low: Column | None = None) -> Column:
    return _graded(text, patterns.AUTHORITY, "authority_urgency_framing", (0.40, 0.65, 0.85), low)


def replication(text: Column, low: Column | None = None) -> Column:
    return _graded(text, patterns.REPLICATION, "self_replication_instruction", (0.50, 0.70, 0.90), low)


def capable(text: Column, low: Column | None = None) -> Column:
    """Whether a capability phrase occurs anywhere, without which most rules here have nothing to say."""
    return T.found(text, "|".join(patterns.CAPABILITY), low=low)


def persona(text: Column, low: Column | None = None, capability: Column | None = None) -> Column:
    """For each persona pattern, its first match if a capability phrase is within 300 characters."""
    found = []
    for p in patterns.PERSONA:
        first = F.when(T.found(text, p, low=low), F.struct(T.first_start(text, p, low=low).alias("start"), F.regexp_substr(text, F.lit(patterns.java(p))).alias("match")))
        near = T.let(first, lambda m: F.struct(m["match"].alias("match"), T.first_match(T.around(text, m["start"], m["start"] + F.length(m["match"]), 300), patterns.CAPABILITY).alias("near")))
        found.append(T.let(near, lambda x: F.when(x["near"].isNotNull(), _signal("persona_replacement", 0.85, F.concat_ws(" / ", x["match"], x["near"]), text))))
    return F.when(capable(text, low) if capability is None else capability, some(*found))


def multilingual(text: Column, low: Column | None = None) -> Column:
    near, matches = F.lit(False), []
    for p, case in patterns.MULTILINGUAL:
        flags = patterns.SAME_CASE if case else patterns.ANY_CASE
        match, start = T.first_match(text, [p], flags, low), T.first_start(text, p, flags, low)
        matches.append(match)
        window = T.around(text, start, start + F.length(match), 500)
        near = near | F.coalesce(T.found(window, "|".join(patterns.CAPABILITY)), F.lit(False))
    def judged(found: Column) -> Column:
        confidence = F.when(near, 0.80).when(F.size(found) >= 2, 0.65).otherwise(0.45)
        return F.when(F.size(found) > 0, _signal("multilingual_jailbreak", confidence, F.array_join(F.slice(found, 1, 3), ", "), text))

    return T.let(F.filter(F.array(*matches), lambda m: m.isNotNull()), judged)


_PAIR = "struct<frame:string,capability:string,confidence:double>"


def _pair(frame: Column, capability: Column, confidence: float | Column) -> Column:
    return F.struct(frame.alias("frame"), capability.alias("capability"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"))


def _within(apart: Column) -> Column:
    out = F.lit(SCALES[-1][1])
    for reach, confidence in reversed(SCALES[:-1]):
        out = F.when(apart <= reach, confidence).otherwise(out)
    return out


def _around_frames(text: Column, low: Column | None) -> Column:
    """A pair for each framing match and scale in whose reach, behind or before it, the first capability phrase is."""

    def scales(m: Column) -> Column:
        def hit(reach: int) -> Column:
            behind = F.substring(text, m["stop"] + 1, F.lit(reach))
            begin = F.greatest(F.lit(0), m["start"] - reach)
            before = F.substring(text, begin + 1, m["start"] - begin)

            def first(x: Column) -> Column:
                return F.coalesce(*(T.first_match(x[side], [c], low=x[f"{side}_low"]) for c in patterns.CAPABILITY for side in ("behind", "before")))

            return T.let(F.struct(behind.alias("behind"), before.alias("before"), T.folded(behind).alias("behind_low"), T.folded(before).alias("before_low")), first)

        every = F.filter(F.array(*(_pair(m["match"], hit(reach), confidence) for reach, confidence in SCALES)), lambda x: x["capability"].isNotNull())
        begin = F.greatest(F.lit(0), m["start"] - REACH)
        near = capable(F.substring(text, begin + 1, m["stop"] + REACH - begin))  # else no scale has anything
        return F.when(near, every).otherwise(F.array().cast(f"array<{_PAIR}>"))

    return F.flatten(F.array(*(F.flatten(F.transform(T.spans(text, p, low=low), scales)) for p in patterns.FRAMING)))


def _first_pairs(pairs: Column) -> Column:
    """Of pairs of the same phrases, the first."""
    named = lambda all_: F.transform(all_, lambda x: F.struct(x["frame"], x["capability"]))
    return T.let(pairs, lambda all_: T.let(named(all_), lambda names: F.filter(all_, lambda x, i: F.array_position(names, F.struct(x["frame"], x["capability"])) == i + 1)))


def _in_chunks(text: Column, seen: Column) -> Column:
    """seen, and for each overlapping chunk and framing pattern the first capability pattern whose match there isn't paired
    with the framing match yet."""

    def offers(chunk: Column) -> Column:
        """For each framing pattern that occurs, its first match and all capability patterns' first matches."""

        def firsts(these: tuple[str, ...], x: Column) -> Column:
            each = [F.struct(T.first_match(x["chunk"], [p], low=x["low"]).alias("match"), T.first_start(x["chunk"], p, low=x["low"]).alias("start")) for p in these]
            return F.filter(F.array(*each), lambda m: m["match"].isNotNull())

        def paired(x: Column) -> Column:
            return T.let(firsts(patterns.FRAMING, x), lambda frames: F.when(F.size(frames) > 0, T.let(firsts(patterns.CAPABILITY, x), lambda held: F.transform(frames, lambda f: F.transform(held, lambda h: _pair(f["match"], h["match"], _within(F.abs(f["start"] - h["start"]))))))))

        return F.coalesce(T.let(F.struct(chunk.alias("chunk"), T.folded(chunk).alias("low")), paired), F.array().cast(f"array<array<{_PAIR}>>"))

    def step(done: Column, pairs: Column) -> Column:
        new = F.filter(pairs, lambda x: ~F.exists(done, lambda y: (x["frame"] == y["frame"]) & (x["capability"] == y["capability"])))
        return F.concat(done, F.slice(new, 1, 1))

    places = F.sequence(F.lit(0), F.length(text) - 1, F.lit(CHUNK - OVERLAP))
    every = F.flatten(F.transform(places, lambda at: offers(F.substring(text, at + 1, F.lit(CHUNK)))))
    return F.when(F.length(text) > CHUNK, F.aggregate(every, seen, step)).otherwise(seen)


def jailbreak(text: Column, low: Column | None = None, capability: Column | None = None) -> Column:
    """Framing phrases near capability phrases: by scale around each framing, then by overlapping chunks, then anywhere in
    the text if neither found any. Which chunk gives what depends on the finds before it, so chunks are folded in order.
    All native, and only for texts that hold a phrase of both kinds."""
    both = T.found(text, "|".join(patterns.FRAMING), low=low) & (capable(text, low) if capability is None else capability)
    near = T.let(_first_pairs(_around_frames(text, low)).cast(f"array<{_PAIR}>"), lambda seen: _in_chunks(text, seen))
    named = lambda pairs, name: F.transform(pairs, lambda x: _signal(name, x["confidence"], F.concat(x["frame"], F.lit(" / "), x["capability"]), F.lit(None)))
    wide = F.array(_pair(T.first_match(text, patterns.FRAMING, low=low), T.first_match(text, patterns.CAPABILITY, low=low), 0.30))
    found = T.let(near, lambda pairs: F.when(F.size(pairs) > 0, named(pairs, "jailbreak_wrapper")).otherwise(named(wide, "jailbreak_wrapper_document_wide")))
    return F.when(both, found)


def text_signals(text: Column, low: Column | None = None, model: Column | None = None) -> Column:
    """All signals of a text in the detectors' order. low: its folded form, worked out here unless given. model: what an
    outside classifier said, see scored()."""

    def of(t: Column, x: Column) -> Column:
        def rules(capability: Column) -> Column:
            return joined(some(authority(t, x)), jailbreak(t, x, capability), persona(t, x, capability), some(replication(t, x)), some(multilingual(t, x)))

        return T.let(F.coalesce(capable(t, x), F.lit(False)), rules)

    found = of(text, low) if low is not None else T.let(text, lambda t: T.let(T.folded(t), lambda x: of(t, x)))
    return found if model is None else joined(found, some(scored(model)))


def scored(model: Column) -> Column:
    """The signal of an outside classifier's verdict, a column struct<is_injection boolean, confidence double,
    injection_type string, evidence string> that the caller has filled by any model (null where it said nothing; a null
    confidence counts as 0.5)."""
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(model["confidence"], F.lit(0.5))))
    evidence = F.concat_ws(": ", F.coalesce(model["injection_type"], F.lit("unknown")), model["evidence"])
    return F.when(model["is_injection"], signal(SEMANTIC, "llm_classifier", confidence, evidence, "semantic_manipulation_llm"))


def document_wide(text: Column) -> Column:
    """Whether both kinds of phrases occur anywhere (without regard to where; jailbreak() says so only if nothing is near)."""
    return T.found(text, "|".join(patterns.FRAMING)) & T.found(text, "|".join(patterns.CAPABILITY))


def proximity(df: DataFrame, text: str = "body", id_col: str = "content_id") -> DataFrame:
    """(content_id, frame, capability, distance, confidence): all pairs of phrases at most REACH characters apart, at their
    least distance. A range join by buckets of REACH characters: a frame meets the phrases of its own and the neighbouring
    buckets only, so a long text is joined in as many parts as it has buckets."""
    any_frame, any_capability = "|".join(patterns.FRAMING), "|".join(patterns.CAPABILITY)
    both = df.select(F.col(id_col).alias("content_id"), F.col(text).alias("t")).filter(T.found(F.col("t"), any_frame) & T.found(F.col("t"), any_capability))
    bucket = lambda c: F.floor(c / REACH)
    frames = both.select("content_id", F.explode(T.spans(F.col("t"), any_frame)).alias("f"))
    # a phrase that starts at most REACH behind a frame's end or ends at most REACH before its start lies in these buckets
    frames = frames.select("*", F.explode(F.sequence(bucket(F.col("f.start")) - 1, bucket(F.col("f.stop")) + 1)).alias("part"))
    capabilities = both.select(F.col("content_id").alias("other_id"), F.explode(T.spans(F.col("t"), any_capability)).alias("c"))
    capabilities = capabilities.select("*", F.explode(F.array_distinct(F.array(bucket(F.col("c.start")), bucket(F.col("c.stop"))))).alias("other_part"))
    near = (F.col("content_id") == F.col("other_id")) & (F.col("part") == F.col("other_part")) & (F.col("c.start") - F.col("f.stop") <= REACH) & (F.col("f.start") - F.col("c.stop") <= REACH)
    apart = F.when(F.col("c.start") >= F.col("f.stop"), F.col("c.start") - F.col("f.stop")).otherwise(F.col("f.start") - F.col("c.stop"))
    pairs = frames.join(capabilities, near).select("content_id", F.lower("f.match").alias("frame"), F.lower("c.match").alias("capability"), apart.alias("distance")).filter("distance >= 0")
    nearest = pairs.groupBy("content_id", "frame", "capability").agg(F.min("distance").alias("distance"))
    return nearest.withColumn("confidence", _within(F.col("distance")))
