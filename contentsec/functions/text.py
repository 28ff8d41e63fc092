"""Text functions on columns, built from Spark's own functions."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from contentsec import patterns
from contentsec.functions.batches import in_parts


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once for each row however often it is used."""
    return F.transform(F.array(value), of)[0]


def strip(text: Column) -> Column:
    """Without white space of any kind on either side (Spark's trim removes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def folded(text: Column) -> Column:
    """The lower case in which plain searches find all that a pattern could match in any case: letters that Java and
    Python take for `s` and `i`, though their lower case isn't, are folded too. Worked out once for each text, it serves
    the guards of all patterns."""
    low = F.lower(text)
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(low, "ſı\u0307", "si")).otherwise(low)


def _may(low: Column, pattern: str) -> Column | None:
    """Whether a text with this folded form can match at all, by plain searches, which cost far less than the pattern."""
    needs = patterns.required(pattern)
    if needs is None:
        return None
    out = None
    for all_of in needs:
        held = low.contains(all_of[0])
        for more in all_of[1:]:
            held = held & low.contains(more)
        out = held if out is None else out | held
    return out


def _guarded(low: Column, pattern: str, value: Column) -> Column:
    may = _may(low, pattern)
    return value if may is None else F.when(may, value)


def _with_low(text: Column, low: Column | None, of: Callable[[Column, Column], Column]) -> Column:
    """of(text, its folded form), which is made here unless it is given."""
    return of(text, low) if low is not None else let(text, lambda t: let(folded(t), lambda x: of(t, x)))


def found(text: Column, pattern: str, flags: str = patterns.ANY_CASE, low: Column | None = None) -> Column:
    """Whether the pattern occurs; null for a null text."""
    return _with_low(text, low, lambda t, x: F.when(t.isNotNull(), F.coalesce(_guarded(x, pattern, t.rlike(flags + pattern)), F.lit(False))))


def first_match(text: Column, these: Iterable[str], flags: str = patterns.ANY_CASE, low: Column | None = None) -> Column:
    """What the first pattern that occurs matches first; null if none occurs."""
    these = list(these)
    return _with_low(text, low, lambda t, x: F.coalesce(*(_guarded(x, p, F.regexp_substr(t, F.lit(flags + p))) for p in these)))


def count_patterns(text: Column, these: Iterable[str], low: Column | None = None) -> Column:
    """How many of the patterns occur."""
    return F.when(text.isNotNull(), F.size(matched_patterns(text, these, low)))


def matched_patterns(text: Column, these: Iterable[str], low: Column | None = None) -> Column:
    """The first match of each pattern that occurs, in the patterns' order."""
    these = list(these)
    every = _with_low(text, low, lambda t, x: F.array(*(_guarded(x, p, F.regexp_substr(t, F.lit(patterns.ANY_CASE + p))) for p in these)))
    return F.filter(every, lambda m: m.isNotNull())


_LATIN = str.maketrans(patterns.LOOKALIKES)


def unmask(text: Column) -> Column:
    """Lookalike letters replaced by Latin ones."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, "".join(patterns.LOOKALIKES), "".join(patterns.LOOKALIKES.values()))).otherwise(text)


@functools.cache
def _nfkc() -> Callable[[Column], Column]:
    """Made when first used: Spark needs a session for it."""
    @F.arrow_udf("string")
    def run(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import unicodedata

        yield from in_parts(text, lambda part: [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in part], pa.string())

    return run


def composed(text: str) -> str | None:
    """What normalize() gives for a text, for Arrow functions that hold it anyway; null for ASCII, which stays as it is."""
    import unicodedata

    return None if text.isascii() else unicodedata.normalize("NFKC", text.translate(_LATIN))


def normalize(text: Column, compatibility: bool = True) -> Column:
    """unmask(), then Unicode compatibility composition, which Spark lacks (the one Python step; leave it out for a
    native plan where texts are composed already)."""
    plain = unmask(text)
    if not compatibility:
        return plain
    other = text.rlike("[^\\x00-\\x7F]")  # only these reach Python
    return F.when(other, _nfkc()(F.when(other, plain))).otherwise(plain)


def keyword(text: Column, keywords: Iterable[str] = patterns.KEYWORDS) -> Column:
    """The predicate kernel: the first keyword's match in the unmasked text, or null."""
    return first_match(unmask(text), keywords)


def base64_runs(text: Column) -> Column:
    """Decoded texts of all base64 runs of 20 characters or more that hold a letter.

    Data characters modulo 4 decide what padding a strict decoder takes: none for 0, two for 2, one for 3."""
    runs = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/]{20,}={0,2}"), F.lit(0))

    def decoded(run: Column) -> Column:
        data = F.regexp_replace(run, "=+$", "")
        pads = F.length(run) - F.length(data)
        rest = F.length(data) % 4
        fits = ((rest == 0) | ((rest == 2) & (pads == 2)) | ((rest == 3) & (pads >= 1)))
        whole = F.concat(data, F.when(rest == 2, "==").when(rest == 3, "=").otherwise(""))
        raw = F.when(fits, F.try_to_binary(whole, F.lit("base64")))
        return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))

    runs = F.when(text.rlike("(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20}"), runs).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(runs, decoded), lambda t: t.isNotNull() & t.rlike("(?U)\\p{IsAlphabetic}"))


def percent_decoded(text: Column) -> Column:
    """Percent escapes decoded; `+` and broken escapes stay."""
    safe = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(safe), text)).otherwise(text)


def payloads(text: Column) -> Column:
    """What the text's base64 runs hold, and its percent-decoded form where that differs; usually nothing."""
    other = let(percent_decoded(text), lambda d: F.when(d != text, F.array(d)).otherwise(F.array().cast("array<string>")))
    return F.concat(base64_runs(text), other)


def decode_payloads(text: Column) -> Column:
    """The text, what its base64 runs hold, and its percent-decoded form where that differs, one to a line."""
    return let(text, lambda t: let(percent_decoded(t), lambda d: F.concat_ws("\n", t, base64_runs(t), F.when(d != t, d))))


def spans(text: Column, pattern: str, flags: str = patterns.ANY_CASE, low: Column | None = None) -> Column:
    """array<struct<start int, stop int, match string>>: all matches, in code points from 0.

    Spark has no positions of matches; the pieces between them give the starts."""
    matches = F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(0))
    pieces = F.split(text, flags + pattern, -1)
    empty = F.array().cast("array<struct<start:int,stop:int,match:string>>")

    def step(done: Column, pair: Column) -> Column:
        start = F.coalesce(F.try_element_at(done, F.lit(-1))["stop"], F.lit(0)) + F.length(pair["piece"])
        return F.concat(done, F.array(F.struct(start.alias("start"), (start + F.length(pair["match"])).alias("stop"), pair["match"].alias("match"))))

    pairs = F.filter(F.arrays_zip(pieces.alias("piece"), matches.alias("match")), lambda p: p["match"].isNotNull())
    return F.when(found(text, pattern, flags, low), F.aggregate(pairs, empty, step)).otherwise(empty)


def first_start(text: Column, pattern: str, flags: str = patterns.ANY_CASE, low: Column | None = None) -> Column:
    """Where the first match starts, in code points from 0; null without one."""
    return F.when(found(text, pattern, flags, low), F.length(F.element_at(F.split(text, flags + pattern, 2), 1)))


def around(text: Column, start: Column, stop: Column, reach: int) -> Column:
    """The text from `reach` before start to `reach` behind stop."""
    begin = F.greatest(F.lit(0), start - reach)
    return F.substring(text, begin + 1, stop + reach - begin)
