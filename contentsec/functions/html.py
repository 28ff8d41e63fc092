"""One pass over a page's markup that gives all that the page detectors look at, and the page without what is hidden, as
a struct column.

Spark has no HTML parser; this Arrow function runs the standard library's once for each page. Elements without
attributes are not listed, and only hidden ones have their text, so the struct doesn't grow with the depth of the page.
A page that can't be parsed gives what was read of it, never an error.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from contentsec import patterns
from contentsec.functions.batches import in_parts
from contentsec.functions.text import composed

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_INLINE = [re.compile(p, re.IGNORECASE) for p in patterns.HIDDEN_CSS[:4]]
_RULE = [re.compile(p, re.IGNORECASE) for p in patterns.HIDDEN_CSS]
_TOGETHER = [[re.compile(p, re.IGNORECASE) for p in both] for both in patterns.HIDDEN_INLINE]

PAGE = (
    "struct<elements:array<struct<tag:string,attrs:map<string,string>,classes:array<string>,text:string,hidden_inline:boolean>>,"
    "hidden_classes:array<string>,scripts:array<string>,css_variables:map<string,string>,fragments:array<string>,"
    "foreign_objects:array<struct<text:string,html:string>>,images:array<string>,visible_text:string,"
    "tag_counts:map<string,int>,meta_signatures:array<string>,canonical:string,og:map<string,string>,sanitized:string>"
)
_TEXT = pa.string()
_STRINGS = pa.map_(_TEXT, _TEXT)
_ARROW = pa.struct(
    [
        ("elements", pa.list_(pa.struct([("tag", _TEXT), ("attrs", _STRINGS), ("classes", pa.list_(_TEXT)), ("text", _TEXT), ("hidden_inline", pa.bool_())]))),
        ("hidden_classes", pa.list_(_TEXT)),
        ("scripts", pa.list_(_TEXT)),
        ("css_variables", _STRINGS),
        ("fragments", pa.list_(_TEXT)),
        ("foreign_objects", pa.list_(pa.struct([("text", _TEXT), ("html", _TEXT)]))),
        ("images", pa.list_(_TEXT)),
        ("visible_text", _TEXT),
        ("tag_counts", pa.map_(_TEXT, pa.int32())),
        ("meta_signatures", pa.list_(_TEXT)),
        ("canonical", _TEXT),
        ("og", _STRINGS),
        ("sanitized", _TEXT),
    ]
)


def hides(style: str) -> bool:
    """Whether an inline style hides its element."""
    return any(p.search(style) for p in _INLINE) or any(all(p.search(style) for p in both) for both in _TOGETHER)


_DROP = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)


class _Page(HTMLParser):
    """Elements, texts and the page's kept parts. An event reaches from its place to the next event's, so what is kept
    is cut from the page as it is, references and all."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.html = html
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.at, self.keeps, self.kept = 0, True, []
        self.open: list[dict] = []
        self.seen: list[dict] = []
        self.pieces: list[str] = []
        self.visible: list[str] = []
        self.scripts: list[str] = []
        self.styles: list[str] = []
        self.comments: list[str] = []
        self.counts = dict.fromkeys(patterns.COUNTED, 0)
        self.skip = 0

    def _event(self, keep: bool) -> None:
        line, offset = self.getpos()
        place = self.lines[line - 1] + offset if line <= len(self.lines) else len(self.html)
        if self.keeps and place > self.at:
            self.kept.append(self.html[self.at : place])
        self.at, self.keeps = max(self.at, place), keep

    def sanitized(self) -> str:
        rest = self.html[self.at :] if self.keeps else ""
        return re.sub(f"[{patterns.ZERO_WIDTH}]", "", "".join(self.kept) + rest)

    def _gone(self) -> bool:
        return bool(self.open) and self.open[-1]["gone"]

    def _start(self, tag: str, attrs: list[tuple[str, str | None]], ends: bool) -> None:
        if tag in _CLOSES_P and any(e["tag"] == "p" for e in self.open[-3:]):
            self._close("p")
        if tag == "li" and self.open and self.open[-1]["tag"] == "li":
            self._close("li")
        attributes = {k: v or "" for k, v in attrs}
        gone = self._gone() or tag == "foreignobject" or attributes.get("aria-hidden") == "true" or bool(_DROP.search(attributes.get("style", "")))
        self._event(not gone)
        raw = self.get_starttag_text() or ""
        element = {"tag": tag, "attrs": attributes, "first": len(self.pieces), "last": len(self.pieces), "raw": [raw], "gone": gone}
        for outer in self.open:
            if outer["tag"] == "foreignobject":
                outer["raw"].append(raw)
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.seen.append(element)
        if tag not in _VOID:
            self.open.append(element)
            self.skip += tag in ("script", "style", "foreignobject")
            if ends:
                self._close(tag)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._start(tag, attrs, False)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._start(tag, attrs, True)

    def _close(self, tag: str) -> bool | None:
        """Ends the innermost open element of this name and all in it; whether it was kept, None if there is none."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                for e in self.open[i:]:
                    e["last"] = len(self.pieces)
                    self.skip -= e["tag"] in ("script", "style", "foreignobject")
                    for o in self.open[:i]:
                        if o["tag"] == "foreignobject":
                            o["raw"].append(f"</{e['tag']}>")
                kept = not self.open[i]["gone"]
                del self.open[i:]
                return kept
        return None

    def handle_endtag(self, tag: str) -> None:
        keep = not self._gone()
        kept = self._close(tag)
        self._event(keep if kept is None else kept)

    def handle_data(self, data: str) -> None:
        self._event(not self._gone())
        inner = self.open[-1]["tag"] if self.open else ""
        if inner == "script":
            self.scripts.append(data)
        elif inner == "style":
            self.styles.append(data)
        else:
            if (piece := data.strip()):
                self.pieces.append(piece)
                if not self.skip:
                    self.visible.append(piece)
            for e in self.open:
                if e["tag"] == "foreignobject":
                    e["raw"].append(data)

    def handle_comment(self, data: str) -> None:
        self._event(False)
        self.comments.append(data.strip())

    def handle_decl(self, decl: str) -> None:
        self._event(not self._gone())

    def handle_pi(self, data: str) -> None:
        self._event(not self._gone())

    def unknown_decl(self, data: str) -> None:
        self._event(not self._gone())

    def text(self, element: dict) -> str:
        return "".join(self.pieces[element["first"] : element["last"]])


def page_features(html: str) -> dict:
    page = _Page(html)
    try:
        page.feed(html)
        page.close()
    except (AssertionError, ValueError, RecursionError):  # what was read so far counts
        pass
    for e in page.open:
        e["last"] = len(page.pieces)
    css = "\n".join(page.styles)
    hidden = [name for selector, body in re.findall(r"([^{}]+)\{([^{}]*)\}", css) if any(p.search(body) for p in _RULE) for name in re.findall(r"\.([\w-]+)", selector)]
    unseen = set(hidden)
    inline = [e["attrs"]["style"] for e in page.seen if e["attrs"].get("style")]
    variables = dict(re.findall(r"(--[\w-]+)\s*:\s*([^;{}]+)", "\n".join([css, *inline])))
    variables = {k: v.strip().strip("\"'") for k, v in variables.items()}
    elements, metas, og, canonical, images, objects = [], [], {}, None, [], []
    styled = []
    for e in page.seen:
        attrs = e["attrs"]
        if attrs:
            classes, inline_hidden = attrs.get("class", "").split(), bool(attrs.get("style")) and hides(attrs["style"])
            text = page.text(e) if inline_hidden or attrs.get("aria-hidden") == "true" or not unseen.isdisjoint(classes) else None
            elements.append({"tag": e["tag"], "attrs": list(attrs.items()), "classes": classes, "text": text, "hidden_inline": inline_hidden})
        if e["tag"] == "meta":
            for key in ("charset", "http-equiv", "name", "property"):
                if attrs.get(key):
                    metas.append(f"{key}={attrs[key]}")
                    break
            if attrs.get("property", "").startswith("og:"):
                og[attrs["property"]] = attrs.get("content", "")
        elif e["tag"] == "link" and "canonical" in attrs.get("rel", "").split():
            canonical = canonical or attrs.get("href")
        elif e["tag"] == "img" and (source := attrs.get("src") or attrs.get("data-src")):
            images.append(source)
        elif e["tag"] == "foreignobject":
            objects.append({"text": page.text(e), "html": "".join(e["raw"])})
        if attrs.get("style") and any(p.search(attrs["style"]) for p in _RULE) and len(text := page.text(e)) >= 3:
            styled.append(text)
    aria = [page.text(e) for e in page.seen if e["attrs"].get("aria-hidden") == "true"]
    visible = re.sub(f"[{patterns.ZERO_WIDTH}]", "", " ".join(page.visible)).strip()
    return {
        "elements": elements, "hidden_classes": hidden, "scripts": page.scripts, "css_variables": list(variables.items()),
        "fragments": [*page.comments, *(t for t in aria if len(t) >= 3), *styled], "foreign_objects": objects, "images": images, "visible_text": visible,
        "tag_counts": [(t, page.counts[t]) for t in patterns.COUNTED], "meta_signatures": sorted(set(metas)), "canonical": canonical, "og": list(og.items()), "sanitized": page.sanitized(),
    }


@functools.cache
def _function(of: Callable[[str], object], kind: pa.DataType, ddl: str) -> Callable[[Column], Column]:
    """An Arrow function of a string column, null for null; made when first used, as Spark needs a session for it."""

    @F.arrow_udf(ddl)
    def run(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_parts(html, lambda part: [None if h is None else of(h) for h in part], kind)

    return run


@functools.cache
def _kinds(fields: tuple[str, ...]) -> tuple[pa.DataType, str]:
    """The Arrow and the Spark type of a page's struct with these fields; of all of them if none is named."""
    if not fields:
        return _ARROW, PAGE
    whole = from_arrow_schema(pa.schema(list(_ARROW)))
    return pa.struct([_ARROW.field(f) for f in fields]), "struct<" + ",".join(f"{f}:{whole[f].dataType.simpleString()}" for f in fields) + ">"


def parse(html: Column, *fields: str) -> Column:
    """The page's struct, or only the named fields of it: what isn't named is neither sent nor kept with the row."""
    return _function(page_features, *_kinds(fields))(F.coalesce(html, F.lit("")))


def _composed_features(html: str) -> dict:
    return page_features(html) | {"composed": composed(html)}


def parse_composed(html: Column) -> Column:
    """The page's struct and `composed`, its markup as text.composed() gives it, so that one Python worker has both."""
    return _function(_composed_features, pa.struct([*_ARROW, ("composed", _TEXT)]), PAGE[:-1] + ",composed:string>")(F.coalesce(html, F.lit("")))


def sanitize(html: Column) -> Column:
    """Without comments, zero-width characters and hidden elements; null for null. What isn't dropped stays as it is."""
    return F.when(html.isNotNull(), parse(html, "sanitized")["sanitized"])
