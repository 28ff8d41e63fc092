"""Files made from texts, on the standard library, for queries and tests of the file scanners."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from contentsec import patterns
from contentsec.functions.batches import in_parts

#: UTF-16 units that a cell holds.
CELL = 32_767


def pdf(text: str, extra: bytes = b"") -> bytes:
    shown = text.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    stream = zlib.compress(b"BT (" + shown + b") Tj ET")
    return b"%PDF-1.4\n1 0 obj\n<< /Title (a title) " + extra + b" >>\nendobj\n2 0 obj\n<< /Length " + str(len(stream)).encode() + b" /Filter /FlateDecode >>\nstream\n" + stream + b"\nendstream\nendobj\n%%EOF\n"


def cells(text: str) -> list[tuple[str, str]]:
    """The whole text in as many cells of a row as it needs; no keyword's match is cut unless it is longer than a cell."""
    most = CELL if text.isascii() or max(text) <= "\uffff" else CELL // 2  # Excel counts UTF-16 units
    spans = [m.span() for p in patterns.KEYWORDS for m in re.finditer(p, text, re.IGNORECASE)] if len(text) > most else []
    out: list[tuple[str, str]] = []
    at = 0
    while at < len(text) or not out:
        stop = min(at + most, len(text))
        while stop < len(text) and (crossed := [a for a, b in spans if at < a < stop < b]):
            stop = min(crossed)
        name, k = "", len(out) + 1
        while k:
            k, rest = divmod(k - 1, 26)
            name = chr(65 + rest) + name
        out.append((f"{name}1", text[at:stop]))
        at = stop
    return out


def workbook(cells: list[tuple[str, str]], state: str = "visible", formula: str = "", macros: bool = False, comment: str = "") -> bytes:
    from xml.sax.saxutils import escape

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = "".join(f'<c r="{r}" t="inlineStr"><is><t>{escape(t)}</t></is></c>' for r, t in cells) + (f'<c r="Z9"><f>{escape(formula)}</f><v>0</v></c>' if formula else "")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="S" sheetId="1" state="{state}"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData><row>{rows}</row></sheetData></worksheet>")
        if macros:
            z.writestr("xl/vbaProject.bin", b"\0")
        if comment:
            z.writestr("xl/comments1.xml", f"<comments {main}><commentList><comment><text><t>{escape(comment)}</t></text></comment></commentList></comments>")
    return out.getvalue()


def calendar(text: str) -> bytes:
    flat = text.replace("\n", " ").replace("\r", " ")
    return f"BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:meeting\r\nDESCRIPTION:{flat}\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n".encode()


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(message: str = "", text: str = "", side: int = 40) -> bytes:
    """A grey gradient whose red channel's lowest bits spell the message, with the text in a tEXt chunk,
    or an iTXt chunk if Latin-1 can't hold it."""
    bits = [int(b) for byte in message.encode() + b"\0" for b in f"{byte:08b}"] if message else []
    rows = []
    for y in range(side):
        row = bytearray(b"\0")
        for x in range(side):
            k = y * side + x
            v = (k * 7) % 256
            row += bytes(((v & 254) | (bits[k] if k < len(bits) else k & 1), v, (v + 1) % 256))
        rows.append(bytes(row))
    out = b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 2, 0, 0, 0))
    if text:
        latin = all(c <= "\xff" for c in text)  # others need the UTF-8 chunk
        out += _chunk(b"tEXt", b"Comment\0" + text.encode("latin-1")) if latin else _chunk(b"iTXt", b"Comment\0\0\0\0\0" + text.encode())
    return out + _chunk(b"IDAT", zlib.compress(b"".join(rows))) + _chunk(b"IEND", b"")


_FILE = pa.struct([("content_id", pa.int64()), ("filename", pa.string()), ("data", pa.binary())])


def _file(i: int | None, body: str) -> dict:
    k = (i or 0) % 4
    if k == 0:
        data = pdf(body, b"/OpenAction 3 0 R" if i % 8 == 0 else b"")
    elif k == 1:
        data = workbook(cells(body), "hidden" if i % 8 == 1 else "visible", 'WEBSERVICE("http://x")' if i % 12 == 1 else "")
    elif k == 2:
        data = calendar(body)
    else:
        data = png("ignore previous instructions" if i % 8 == 3 else "", body)
    return {"content_id": i, "filename": f"f{i}." + ("pdf", "xlsx", "ics", "png")[k], "data": data}


def files(texts: DataFrame) -> DataFrame:
    """(content_id, filename, data) of texts(content_id, body): formats alternate by id, each holds the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ((batch.column("body"), batch.column("content_id")) for batch in batches)
        for part in in_parts(columns, lambda bodies, ids: [_file(i, body) for i, body in zip(ids, bodies, strict=True)], _FILE):
            yield pa.RecordBatch.from_struct_array(part)

    return texts.mapInArrow(run, "content_id bigint, filename string, data binary")
