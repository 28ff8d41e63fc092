"""Hidden instructions and active content in PDF, spreadsheet and calendar files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentsec import patterns
from contentsec.config import Config
from contentsec.functions import text as T
from contentsec.functions.binary import calendars, pdfs, workbooks
from contentsec.operators.signals import CONTROL, INJECTION, joined, signal, some

DETECTOR = "document_scanner"


def _signal(name: str, confidence: float | Column, evidence: Column, trap: str = INJECTION, raw: Column | None = None) -> Column:
    return signal(trap, name, confidence, evidence, DETECTOR, raw)


def _hit(text: Column) -> Column:
    return T.first_match(text, patterns.KEYWORDS)


def _judged(read: Column, good: Column, error: str, evidence: str) -> Column:
    """The signals of a file that could be read, or one that says that it couldn't, or that its reader failed."""
    failed = some(_signal("document_scan_error", 0.30, F.lit("the reader failed")))
    return F.when(read["status"] == "ok", good).when(read["status"] == "error", failed).when(read.isNotNull(), some(_signal(error, 0.35, F.lit(evidence))))


def unread(reason: Column) -> Column:
    """The signal of a file that was not read, with the reason why."""
    return some(F.when(reason.isNotNull(), _signal("document_read_error", 0.30, reason)))


def cut(data: Column, config: Config = Config()) -> Column:  # noqa: B008
    """How many pages and streams of a PDF were left out because of the limits; 0 for other files."""
    return F.coalesce(pdfs(F.when(kind(data, config) == "pdf", data), config.pdf_pages)["cut"], F.lit(0))


def kind(data: Column, config: Config = Config()) -> Column:  # noqa: B008
    """pdf, zip, ics or null, by the first bytes."""
    head = F.hex(F.substring(data, 1, 15))
    out = F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip")
    return out.when(head.startswith(b"BEGIN:VCALENDAR".hex().upper()), "ics") if config.route_ics else out


def mismatch(data: Column, filename: Column, config: Config = Config()) -> Column:  # noqa: B008
    extension = F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    known = F.create_map(*(x for k, v in patterns.EXTENSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    of = kind(data, config)
    return some(F.when((extension != "") & of.isNotNull() & ~F.array_contains(known[of], extension), _signal("document_extension_mismatch", 0.45, F.concat(of, F.lit(" named ."), extension))))


def pdf_bytes(data: Column, config: Config = Config()) -> Column:  # noqa: B008
    """Signals that need no PDF parser: they look for constructs in the file's bytes, as Latin-1 text."""
    raw = F.decode(data, "ISO-8859-1")
    white = r"(?is)1\s+1\s+1\s+(?:rg|RG)\b.{0,200}?(?:Tj|TJ|')\s"
    script = F.regexp_extract_all(raw, F.lit(r"(?i)/JS\s*(\([^)]*\)|<[^>]*>|\d+\s+\d+\s+R)"), F.lit(1))
    form = F.substring(raw, F.locate("/AcroForm", raw), 10_000)
    found = [
        F.when(raw.rlike(white), _signal("pdf_white_text_detected", 0.75, F.size(F.regexp_extract_all(raw, F.lit(white), F.lit(0))))),
        F.when(F.size(script) > 0, _signal("pdf_javascript_detected", 0.80, F.element_at(script, 1), CONTROL)),
        F.when(raw.rlike(r"/OpenAction\b"), _signal("pdf_open_action", 0.60, F.lit("/OpenAction"), CONTROL)),
    ]
    if config.check_acroform:
        found.append(F.when(raw.contains("/AcroForm") & _hit(form).isNotNull(), _signal("pdf_acroform_injection", 0.75, _hit(form))))
    return some(*found)


def pdf(data: Column, config: Config = Config()) -> Column:  # noqa: B008
    read = pdfs(F.when(kind(data, config) == "pdf", data), config.pdf_pages)
    info = F.filter(read["info"], lambda x: _hit(x["text"]).isNotNull())
    good = joined(pdf_bytes(data, config), F.transform(info, lambda x: _signal("pdf_metadata_injection", 0.80, F.concat(x["key"], F.lit(": "), _hit(x["text"])))), some(F.when(_hit(read["text"]).isNotNull(), _signal("pdf_text_injection", 0.85, _hit(read["text"]), raw=read["text"]))))
    return _judged(read, good, "pdf_parse_error", "not a readable PDF")


def spreadsheet(data: Column, config: Config = Config()) -> Column:  # noqa: B008
    book = workbooks(F.when(kind(data, config) == "zip", data), config.sheets)
    hidden = F.filter(book["cells"], lambda c: (c["place"] < config.sheets) & c["state"].isin("hidden", "veryHidden") & (F.length(c["text"]) > 5) & _hit(c["text"]).isNotNull())
    comments = F.filter(book["comments"], lambda c: _hit(c).isNotNull())

    def calls_out(pattern: str, confidence: float) -> Column:
        return F.transform(F.filter(book["cells"], lambda c: c["formula"].rlike("(?i)" + pattern)), lambda c: _signal("excel_dangerous_formula", confidence, c["formula"], CONTROL))

    dangerous = [calls_out(p, v) for p, v in patterns.FORMULAS]
    formulas = F.filter(book["cells"], lambda c: (c["formula"] != "") & _hit(c["formula"]).isNotNull())
    named = F.filter(book["names"], lambda n: _hit(n["text"]).isNotNull())
    calls = F.filter(book["names"], lambda n: n["text"].rlike("(?i)" + "|".join(p for p, _ in patterns.FORMULAS)))
    good = joined(
        some(F.when(book["macros"], _signal("excel_vba_macro_detected", 0.85, F.lit("xl/vbaProject.bin"), CONTROL))),
        F.transform(hidden, lambda c: _signal("excel_hidden_sheet_injection", 0.80, F.concat(c["sheet"], F.lit("!"), c["cell"]), raw=c["text"])),
        F.transform(comments, lambda c: _signal("excel_cell_comment_injection", 0.70, _hit(c), raw=c)),
        *dangerous,
        F.transform(formulas, lambda c: _signal("excel_formula_injection", 0.75, c["formula"])),
        F.transform(calls, lambda n: _signal("excel_defined_name_formula", 0.70, n["text"], CONTROL)),
        F.transform(named, lambda n: _signal("excel_defined_name_injection", 0.70, n["text"])),
    )
    return _judged(book, good, "excel_parse_error", "not a readable workbook")


def calendar(data: Column, config: Config = Config()) -> Column:  # noqa: B008
    read = calendars(F.when(kind(data, config) == "ics", data), config.events)
    properties = read["properties"]
    of = lambda names, test: F.filter(properties, lambda p: p["name"].isin(*names) & test(p))
    hit = lambda p: _hit(p["text"]).isNotNull()
    custom = F.filter(properties, lambda p: p["name"].startswith("X-") & (F.length(p["text"]) > 10) & hit(p))
    good = joined(
        F.transform(of(("SUMMARY", "DESCRIPTION", "LOCATION", "COMMENT"), lambda p: (F.length(p["text"]) > 5) & hit(p)), lambda p: _signal("ics_field_injection", 0.85, F.concat(p["name"], F.lit(": "), _hit(p["text"])), raw=p["text"])),
        F.transform(of(("DESCRIPTION",), lambda p: p["text"].rlike("(?i)" + patterns.MARKUP)), lambda p: _signal("ics_html_in_description", 0.70, F.substring(p["text"], 1, 150))),
        F.transform(of(("URL", "ORGANIZER", "ATTENDEE"), hit), lambda p: _signal("ics_url_field_injection", 0.75, p["text"])),
        F.transform(custom, lambda p: _signal("ics_custom_property_injection", 0.65, F.concat(p["name"], F.lit(": "), _hit(p["text"])))),
        F.transform(of(("ATTACH",), hit), lambda p: _signal("ics_attach_url_injection", 0.75, p["text"])),
    )
    return _judged(read, good, "ics_parse_error", "not a readable calendar")


def document_signals(data: Column, filename: Column, config: Config = Config()) -> Column:  # noqa: B008
    """Signals of a file's bytes, whatever its format."""
    return joined(mismatch(data, filename, config), pdf(data, config), spreadsheet(data, config), calendar(data, config))
