"""Content injection: instructions hidden in markup or behind encodings.

The detectors here that need no element tree run on the raw text in native expressions; those on elements take the
struct that functions.html.parse() makes, once for each page.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentsec import patterns
from contentsec.functions import text as T
from contentsec.operators.signals import INJECTION, joined, signal, some

DETECTOR = "content_injection"


def _signal(name: str, confidence: float | Column, evidence: Column, raw: Column | None = None) -> Column:
    return signal(INJECTION, name, confidence, evidence, DETECTOR, raw)


def comments(html: Column) -> Column:
    """The stripped texts of all comments."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<!--(.*?)-->"), F.lit(1)), T.strip)


def _each(values: Column, name: str, confidence: float, least: int) -> Column:
    """A signal for each text of `least` characters or more with a keyword."""
    hits = F.transform(F.filter(values, lambda v: F.length(v) >= least), lambda v: F.struct(v.alias("v"), T.keyword(v).alias("hit")))
    return F.transform(F.filter(hits, lambda x: x["hit"].isNotNull()), lambda x: _signal(name, confidence, x["hit"], x["v"]))


def comment_injection(html: Column) -> Column:
    return F.when(html.contains("<!--"), _each(comments(html), "html_comment_injection", 0.90, 10))


def zero_width_count(html: Column) -> Column:
    held = F.when(html.rlike(f"[{patterns.ZERO_WIDTH}]"), F.length(html) - F.length(F.translate(html, patterns.ZERO_WIDTH, "")))
    return F.when(html.isNotNull(), F.coalesce(held, F.lit(0)))


def zero_width(html: Column) -> Column:
    """More than 5 zero-width characters: a keyword within 50 characters of the first, or else more than 50 of them."""
    any_of = f"[{patterns.ZERO_WIDTH}]"

    def of(t: Column) -> Column:
        first = F.length(F.element_at(F.split(t, any_of, 2), 1))
        begin = F.greatest(F.lit(0), first - 50)
        context = F.translate(F.substring(t, begin + 1, first + 50 - begin), patterns.ZERO_WIDTH, "")
        judged = lambda count: lambda hit: some(F.when(hit.isNotNull(), _signal("zero_width_char_injection", 0.70, hit)), F.when(hit.isNull() & (count > 50), _signal("zero_width_char_anomaly", 0.55, count)))
        return T.let(zero_width_count(t), lambda count: F.when(count > 5, T.let(T.keyword(context), judged(count))))

    return F.when(html.rlike(any_of), T.let(html, of))


def preprocessed(html: Column, compatibility: bool = False, low: Column | None = None, composed: Column | None = None) -> Column:
    """Keywords in the whole document after normalising and after decoding. composed: the normalised document, if it is
    there already, null where it is html.

    What normalising leaves as it is, and a text that holds nothing to decode, have the hits of the plain text, which are
    looked for once."""
    judged = lambda hit, name: F.when(hit.isNotNull(), _signal(name, 0.75, hit, html))
    normal = T.normalize(html, compatibility) if composed is None else F.coalesce(composed, html)
    both = F.struct(T.unmask(html).alias("plain"), normal.alias("normal"), T.payloads(html).alias("held"))

    def of(x: Column) -> Column:
        masked = T.first_match(x["plain"], patterns.KEYWORDS)
        plain = masked if low is None else F.when(html == x["plain"], T.first_match(x["plain"], patterns.KEYWORDS, low=low)).otherwise(masked)

        def hits(hit: Column) -> Column:
            composed = F.when(x["normal"] == x["plain"], hit).otherwise(T.first_match(x["normal"], patterns.KEYWORDS))
            decoded = F.when(F.size(x["held"]) == 0, hit).otherwise(T.keyword(F.concat_ws("\n", html, x["held"])))
            return some(judged(composed, "preprocessed_normalized_text_injection"), judged(decoded, "preprocessed_decoded_text_injection"))

        return T.let(plain, hits)

    return T.let(both, of)


def hidden_css(page: Column) -> Column:
    hidden = F.filter(page["elements"], lambda e: (e["hidden_inline"] | F.arrays_overlap(e["classes"], page["hidden_classes"])))
    return _each(F.transform(hidden, lambda e: e["text"]), "hidden_css_text", 0.85, 5)


def aria_hidden(page: Column) -> Column:
    return _each(F.transform(F.filter(page["elements"], lambda e: e["attrs"]["aria-hidden"] == "true"), lambda e: e["text"]), "aria_hidden_injection", 0.75, 10)


def meta(page: Column) -> Column:
    return _each(F.transform(F.filter(page["elements"], lambda e: e["tag"] == "meta"), lambda e: e["attrs"]["content"]), "meta_injection", 0.80, 11)


def data_attributes(page: Column) -> Column:
    values = F.flatten(F.transform(page["elements"], lambda e: F.map_values(F.map_filter(e["attrs"], lambda k, v: k.startswith("data-")))))
    return _each(values, "data_attr_injection", 0.80, 10)


def links(page: Column) -> Column:
    values = F.flatten(F.transform(F.filter(page["elements"], lambda e: e["tag"] == "link"), lambda e: F.array(e["attrs"]["title"], e["attrs"]["href"])))
    return _each(values, "link_attr_injection", 0.80, 11)


def scripts(page: Column) -> Column:
    """What scripts write into the page, and elements that they make and hide."""
    code = F.array_join(page["scripts"], "\n")
    write = F.regexp_extract_all(code, F.lit(r"""(?i)document\.write(?:ln)?\s*\(\s*['"`]([^'"`]*)['"`]"""), F.lit(1))
    inner = F.regexp_extract_all(code, F.lit(r"""(?i)\.innerHTML\s*\+?=\s*['"`]([^'"`]*)['"`]"""), F.lit(1))
    made = F.filter(page["scripts"], lambda s: s.rlike(r"(?is)createElement\s*\(.*?style\.display\s*=\s*['\"]none"))
    return joined(_each(write, "js_document_write_injection", 0.65, 11), _each(inner, "js_innerhtml_injection", 0.65, 11), F.transform(made, lambda s: _signal("js_hidden_element_creation", 0.65, F.lit("hidden element"), s)))


def _character(n: Column) -> Column:
    """The character of any code point (Spark's chr() knows 256), spelt out as UTF-8; nothing for what is none."""
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    tail = lambda bits: byte(F.shiftright(n, bits).bitwiseAND(63) + 128)
    code = (
        F.when(n < 0x80, byte(n))
        .when(n < 0x800, F.concat(byte(F.shiftright(n, 6) + 0xC0), tail(0)))
        .when((n >= 0xD800) & (n < 0xE000), "")
        .when(n < 0x10000, F.concat(byte(F.shiftright(n, 12) + 0xE0), tail(6), tail(0)))
        .when(n < 0x110000, F.concat(byte(F.shiftright(n, 18) + 0xF0), tail(12), tail(6), tail(0)))
    )
    return F.coalesce(F.unhex(code).cast("string"), F.lit(""))


def script_strings(page: Column) -> Column:
    """Strings put together by code: a keyword in what they resolve to or in themselves, or else merely suspicious."""
    long = F.filter(page["scripts"], lambda s: F.length(s) >= 20)

    def of(code: Column) -> Column:
        return F.flatten(F.array(*(F.regexp_extract_all(code, F.lit("(?i)" + p), F.lit(0)) for p in patterns.SCRIPT_STRINGS)))

    def judged(call: Column) -> Column:
        numbers = F.split(F.regexp_replace(F.regexp_extract(call, r"(?i)fromCharCode\s*\(([\d\s,]+)\)", 1), r"\s", ""), ",")
        chars = F.array_join(F.transform(numbers, lambda n: _character(n.try_cast("int"))), "")
        held = F.regexp_extract(call, r"""(?i)atob\s*\(\s*['"]([0-9A-Za-z+/=]+)['"]""", 1)
        resolved = F.when(call.rlike("(?i)fromCharCode") & call.rlike(r"(?i)fromCharCode\s*\([\d\s,]+\)"), chars).when(held != "", F.make_valid_utf8(F.try_to_binary(held, F.lit("base64")).cast("string"))).otherwise(call)
        hit = F.coalesce(T.keyword(resolved), T.keyword(call))
        return F.when(hit.isNotNull(), _signal("js_dynamic_string_construction", 0.85, hit, call)).otherwise(_signal("js_dynamic_string_suspicious", 0.55, call, call))

    return F.transform(F.flatten(F.transform(long, of)), judged)


def fragments(page: Column) -> Column:
    """Keywords that come together only over 2 to 5 neighbouring hidden fragments."""
    pieces = page["fragments"]
    windows = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(5)), lambda w: F.when(F.size(pieces) >= w, F.transform(F.sequence(F.lit(1), F.size(pieces) - w + 1), lambda i: F.struct(w.alias("w"), F.array_join(F.slice(pieces, i, w), " ").alias("t")))).otherwise(F.array().cast("array<struct<w:int,t:string>>"))))
    hits = F.transform(windows, lambda x: F.struct(x["w"].alias("w"), x["t"].alias("t"), T.keyword(x["t"]).alias("hit")))
    return F.transform(F.filter(hits, lambda x: x["hit"].isNotNull()), lambda x: _signal("fragmented_injection", F.least(F.lit(0.85), F.lit(0.70) + F.lit(0.05) * x["w"]), x["hit"], x["t"]))


def css_variables(page: Column) -> Column:
    """Texts in CSS variables, and inline styles that resolve to one (at most ten substitutions deep)."""
    variables = page["css_variables"]
    using = F.filter(F.transform(page["elements"], lambda e: e["attrs"]["style"]), lambda s: s.contains("var("))

    def resolved(style: Column) -> Column:
        once = lambda s: F.aggregate(F.map_entries(variables), s, lambda x, kv: F.replace(x, F.concat(F.lit("var("), kv["key"], F.lit(")")), kv["value"]))
        return F.aggregate(F.sequence(F.lit(1), F.lit(10)), style, lambda s, _: once(s))

    return joined(_each(F.transform(using, resolved), "css_variable_obfuscation", 0.80, 1), _each(F.map_values(variables), "css_variable_definition_injection", 0.75, 1))


def foreign_objects(page: Column) -> Column:
    def judged(o: Column) -> Column:
        hit = F.coalesce(F.when(F.length(o["text"]) >= 5, T.keyword(o["text"])), F.when(F.length(o["html"]) >= 10, T.keyword(o["html"])))
        return F.when(hit.isNotNull(), _signal("svg_foreign_object_injection", 0.90, hit, o["html"])).otherwise(_signal("svg_foreign_object_suspicious", 0.60, o["text"], o["html"]))

    return F.transform(page["foreign_objects"], judged)


def text_signals(html: Column, compatibility: bool = False) -> Column:
    """The signals that need no element tree."""
    return joined(comment_injection(html), zero_width(html), preprocessed(html, compatibility))


def page_signals(html: Column, page: Column, compatibility: bool = False, low: Column | None = None, composed: Column | None = None) -> Column:
    """All signals of a page, in the detectors' order. low and composed: the folded and the normalised form of html, if
    they are there already."""
    return joined(comment_injection(html), hidden_css(page), aria_hidden(page), zero_width(html), meta(page), data_attributes(page), links(page), scripts(page), fragments(page), css_variables(page), script_strings(page), foreign_objects(page), preprocessed(html, compatibility, low, composed))


def sanitize_text(html: Column) -> Column:
    """The native part of sanitizing: no comments, no zero-width characters."""
    return F.translate(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), patterns.ZERO_WIDTH, "")
