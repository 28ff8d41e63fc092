"""Main text of web pages by tag-path ratios.

A page is cut into tags and texts without building a tree. Each text run's character references are decoded by
themselves; runs are gathered into blocks. A block's tag path goes from the root to the innermost element that holds all
of its text; a step is the element's name and, as an opaque label, its class.

Over all blocks of one path, text length and punctuation per node are aggregated and fused into the path's ratio,
length * (1 + marks); paths through an article or main element weigh HELD times as much, paths through an element whose
class or id has a name of side content as a whole word NAMED times (unless a main element is inside it). Ratios are
smoothed along the tree: a block takes the ratio of the text around it, the mean over its own box weighted by text, and
a share of those of the boxes further out (LIST from inside a list, table or figure, and for headings; BOX from another
box; nothing if all of a box's text is links). Blocks whose smoothed ratio reaches SHARE of the page's ratio, the
geometric mean weighted by text and those weights, are the content nodes, each judged by itself, and make up the text.

A filter before that leaves out what isn't the article whatever its text is like: scripts, styles, hidden elements and
controls, elements whose tag or role is that of a menu, header, footer, sidebar, notice or form, and reader comments,
which read like articles and are known by their class or id. Such an element stays if it holds the main element, or, on
a page without an article or main element elsewhere, most of the page's text or an article longer than all that is
outside.

Null html is empty and gives an empty text. Broken markup never raises: unclosed elements end with their parents, end
tags without a start are skipped, an unfinished comment or tag ends the page. Pages are read whole; rows are
independent, so repeated rows need no care. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentsec.llm.common import blocks

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<(?:!|\?)[^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+>|[^>]*+>?)""", re.DOTALL)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html head body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is no markup, or is shown only where the element itself isn't.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template video audio".split())
OUT = frozenset("head nav aside footer form menu dialog search button select datalist fieldset input label desc metadata".split()) | RAW
#: Left out whatever share of the text they hold.
NEVER = frozenset("select datalist button desc metadata".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEPT = frozenset("html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status note".split())
#: Names of reader comments.
COMMENTS = re.compile(r"(?:^|\s)(?:comments?\w*|disqus\w*|repl(?:y|ies)|respond)(?=$|\s)", re.IGNORECASE)
#: Names of other side content.
NAMES = re.compile(r"(?:^|\s)(?:ads?|adverts?|advertis\w*|sponsor\w*|promo\w*|banner|side-?bar|side|nav\w*|menu\w*|site-?header|page-?header|masthead|foot\w*|cookies?\w*|consent|gdpr|notices?|alerts?|pop-?up|modal|overlay|newsletter|subscri\w*|sign-?up|log-?in|shar\w+|social\w*|related\w*|recommend\w*|breadcrumbs?|paginat\w*|pager|widgets?|disclaimer|copyright|toolbar|tags|skip\w*|search\w*|form)(?=$|\s)", re.IGNORECASE)
_CLOSES_P = BLOCK - frozenset("html head body caption tbody td tfoot th thead tr title option optgroup legend summary figcaption".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
_SCOPE = frozenset("html body table ul ol dl div article section main aside nav header footer form blockquote".split())
_MARKS = ".,;:!?…。，、！？"
#: Blocks of text in a box; any other block element is a box of its own.
_TEXT = frozenset("p pre li dt dd td th caption figcaption legend summary address".split()) | HEADINGS
_LISTS = frozenset("ul ol dl table thead tbody tfoot tr blockquote figure details hgroup".split())
#: The share of the page's ratio that a content node needs, the weights of paths through an article or main element and
#: through a named one, and what a box takes of the ratio of the box around it.
SHARE, HELD, NAMED, LIST, BOX = 0.35, 4.0, 0.05, 0.5, 0.2


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]
    #: Numbers of the boxes around it, and which of them are lists.
    boxes: tuple[int, ...]
    lists: tuple[bool, ...]
    heading: bool
    linked: bool
    held: bool
    #: Number of the innermost element that is named as side content; 0 if there is none.
    named: int


class _Open(NamedTuple):
    name: str
    number: int
    label: str
    #: Left-out elements that it is in or is.
    outs: tuple[tuple[int, int], ...]
    #: The innermost named element that it is in or is.
    named: int


def _judged(name: str, attributes: str, inside: bool) -> tuple[int, str, bool]:
    """0 if an element stays, 1 if it is left out, 2 if that doesn't depend on its text; its label; whether it is named
    as side content. inside: it stands in an article."""
    out, label, named = 2 if name in NEVER else int(name in OUT or name == "header" and not inside), name, False
    if len(attributes) < 5:
        return out, label, named
    for m in _ATTR.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "class":
            label = f"{name}.{' '.join(value.split())}"
        if name in KEPT:
            continue
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            out = 2
        elif key in ("class", "id") and COMMENTS.search(value) or key == "role" and value.lower() in ROLES or key == "aria-hidden" and value.lower() == "true":
            out = max(out, 1)
        elif key in ("class", "id") and NAMES.search(value):
            named = True
    return out, label, named


def _staying(found: list[tuple[Block, tuple[int, ...], tuple[str, ...], tuple[tuple[int, int], ...]]]) -> list[Block]:
    """The blocks outside left-out elements, and those inside the ones that hold the page's article."""
    if not any(x[3] for x in found):
        return [x[0] for x in found]
    outside = sum(len(x[0].text) for x in found if not x[3])
    total = sum(len(x[0].text) for x in found if all(kind == 1 for _, kind in x[3]))
    spare = any(not x[3] and ("article" in x[2] or "main" in x[2]) for x in found)
    held: dict[int, int] = {}
    articles: dict[int, int] = {}
    stay: set[int] = set()
    for block, ids, names, outs in found:
        main = max((i for i, name in zip(ids, names, strict=True) if name == "main"), default=-1)
        article = max((i for i, name in zip(ids, names, strict=True) if name == "article"), default=-1)
        shown = all(kind == 1 for _, kind in outs)
        for number, _ in outs:
            if main > number:
                stay.add(number)
            if shown:
                held[number] = held.get(number, 0) + len(block.text)
                articles[number] = articles.get(number, 0) + (article > number) * len(block.text)
    if not spare and not stay:
        stay = {n for n, size in held.items() if 2 * size > total or articles[n] > outside}
    return [x[0] for x in found if all(number in stay for number, _ in x[3])]


def page_blocks(page: str) -> list[Block]:
    """The blocks that aren't left out, in page order."""
    found: list[tuple[Block, tuple[int, ...], tuple[str, ...], tuple[tuple[int, int], ...]]] = []
    stack: list[_Open] = []
    pieces: list[tuple[str, tuple[tuple[tuple[int, int], ...], int], tuple[_Open, ...]]] = []
    number, at, articles = 0, 0, 0

    def piece(text: str) -> None:
        """A run of text, with the inline elements around it."""
        k = len(stack)
        while k and stack[k - 1].name not in BLOCK:
            k -= 1
        pieces.append((text, (stack[-1].outs, stack[-1].named) if stack else ((), 0), tuple(stack[k:])))

    def end_block() -> None:
        if not pieces:
            return
        apart: dict[tuple[tuple[tuple[int, int], ...], int], list[tuple[str, tuple[_Open, ...]]]] = {}  # left-out or named inline elements don't split the text around them
        for text, kind, inline in pieces:
            apart.setdefault(kind, []).append((text, inline))
        pieces.clear()
        around = [x for x in stack if x.name in BLOCK]
        for (outs, named), own in apart.items():
            if text := " ".join("".join(t for t, _ in own).split()):
                shared = None  # inline elements that hold all of the text
                for t, inline in own:
                    if t.strip():
                        k = 0
                        while shared is not None and k < min(len(shared), len(inline)) and shared[k] is inline[k]:
                            k += 1
                        shared = inline if shared is None else shared[:k]
                names = tuple(x.name for x in around)
                boxes = around[:-1] if around and around[-1].name in _TEXT else around
                path = (*(x.label for x in around), *(x.label for x in shared or ()), *("named",) * bool(named))
                block = Block(text, path, tuple(x.number for x in boxes), tuple(x.name in _LISTS for x in boxes), bool(names) and names[-1] in HEADINGS, any(x.name == "a" for x in shared or ()), "article" in names or "main" in names, named)
                found.append((block, tuple(x.number for x in around), names, outs))

    def pop_to(depth: int) -> None:
        nonlocal articles
        for x in stack[depth:]:
            articles -= x.name in ("article", "main")
        del stack[depth:]

    def close(names: tuple[str, ...], scope: frozenset[str]) -> None:
        """Ends the innermost open element of these names inside the scope, and all it holds."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in names:
                end_block()
                pop_to(i)
                return
            if stack[i].name in scope:
                return

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            piece(entities.unescape(page[at : m.start()]))
        at = m.end()
        if not (name := m[2]):
            continue
        name = name.lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    if any(x.name in BLOCK for x in stack[i:]):
                        end_block()
                    pop_to(i)
                    break
                if name not in BLOCK and stack[i].name in BLOCK and stack[i].name not in ("p", "li"):
                    break
            continue
        if name in ("br", "hr"):
            piece("\n")
        if name in BLOCK:
            end_block()
            if name in _CLOSES_P:
                close(("p",), _SCOPE)
            if name in _SIBLINGS:
                for _ in range(3):
                    close(_SIBLINGS[name], frozenset(("table", "ul", "ol", "dl", "html", "body", "select")))
        if name in VOID or m[3].endswith("/>") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            over = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = over.end() if over else len(page)
            continue
        number += 1
        articles += name in ("article", "main")
        outs, named = (stack[-1].outs, stack[-1].named) if stack else ((), 0)
        kind, label, side = _judged(name, m[3], articles > (name in ("article", "main")))
        if kind:
            outs = (*outs, (number, kind))
        stack.append(_Open(name, number, label, outs, number if side else 0 if name == "main" else named))
    if at < len(page):
        piece(entities.unescape(page[at:]))
    end_block()
    return _staying(found)


def _weight(block: Block) -> float:
    return (HELD if block.held else 1) * (NAMED if block.named else 1)


def path_ratios(found: list[Block]) -> dict[tuple[str, ...], float]:
    """Each path's fused ratio: text length per node, times one and the punctuation marks per node."""
    sums: dict[tuple[str, ...], list[float]] = {}
    for block in found:
        own = sums.setdefault(block.path, [0, 0, 0, _weight(block)])
        own[0] += len(block.text)
        own[1] += sum(map(block.text.count, _MARKS))
        own[2] += 1
    return {path: weight * size / n * (1 + marks / n) for path, (size, marks, n, weight) in sums.items()}


def smoothed(found: list[Block], ratios: dict[tuple[str, ...], float]) -> list[float]:
    """Each block's ratio: that of its path, or what it takes from the boxes around it if that is more."""
    boxes: dict[int, list[float]] = {}  # text, text times ratio, text that is no link
    for block in found:
        if block.boxes:
            own = boxes.setdefault(block.boxes[-1], [0, 0, 0])
            own[0] += len(block.text)
            own[1] += len(block.text) * ratios[block.path]
            own[2] += 0 if block.linked else len(block.text)
    out = []
    for block in found:
        best, share = ratios[block.path], 1.0
        for number, is_list in zip(reversed(block.boxes), reversed(block.lists), strict=True):
            text, weighed, plain = boxes.get(number, (0, 0, 0))
            if text:
                best = max(best, share * weighed / text * (NAMED if number < block.named else 1))
                if not plain:
                    break
            share *= LIST if is_list or block.heading else BOX
        out.append(best)
    return out


def content_nodes(found: list[Block], share: float = SHARE) -> list[Block]:
    """The blocks whose smoothed ratio reaches the threshold."""
    if not found:
        return []
    ratios = path_ratios(found)
    sizes = [len(b.text) * _weight(b) for b in found]
    page = math.exp(sum(size * math.log(ratios[b.path]) for b, size in zip(found, sizes, strict=True)) / sum(sizes))
    return [b for b, ratio in zip(found, smoothed(found, ratios), strict=True) if ratio >= share * page]


def main_text(page: str, share: float = SHARE) -> str:
    """The content nodes, joined by two line ends."""
    return "\n\n".join(b.text for b in content_nodes(page_blocks(page), share))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "html"):
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
