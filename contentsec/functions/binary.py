"""Readers of binary formats that Spark lacks, on the standard library and numpy, as Arrow functions.

None of them raises for broken input: each returns a struct or an array with what could be read, and `status`. JPEG pixels
are not decoded (status `undecodable`); their EXIF texts are read.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from contentsec.functions.batches import in_parts
from contentsec.patterns import EXIF_TAGS

PNG = b"\x89PNG\r\n\x1a\n"


def png_chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 8
    while data[:8] == PNG and at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if at + 8 + size > len(data):
            break
        out.append((kind, data[at + 8 : at + 8 + size]))
        at += 12 + size
    return out


def inflate(data: bytes, most: int = 1 << 20) -> bytes:
    """At most `most` bytes, so that a small chunk can't grow without bound."""
    try:
        return zlib.decompressobj().decompress(data, most)
    except zlib.error:
        return b""


def png_texts(data: bytes) -> list[dict]:
    out = []
    for kind, body in png_chunks(data):
        key, _, rest = body.partition(b"\0")
        if kind == b"tEXt":
            text = rest.decode("latin-1")
        elif kind == b"zTXt" and rest:
            text = inflate(rest[1:]).decode("latin-1")
        elif kind == b"iTXt" and len(rest) >= 2:
            packed = rest[0] == 1
            parts = rest[2:].split(b"\0", 2)
            text = (inflate(parts[2]) if packed else parts[2]).decode("utf-8", "ignore") if len(parts) == 3 else ""
        else:
            continue
        out.append({"kind": kind.decode(), "key": key.decode("latin-1"), "text": text})
    return out


#: Pixels above which an image isn't decoded; its texts are read all the same, and its status says so.
MOST_PIXELS = 1 << 26


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Rows of filtered bytes (the first names the filter) to bytes; step: bytes of a pixel. Bytes depend on their left,
    upper and upper left neighbours only, so each diagonal of pixels is made at once."""
    height, width = lines.shape[0], (lines.shape[1] - 1) // step
    kinds, raw = lines[:, 0], lines[:, 1:].reshape(height, width, step).astype(np.int16)
    if (kinds <= 1).all():  # no row looks at the one above
        sums = np.cumsum(raw, axis=1, dtype=np.int64) & 255
        return np.where((kinds == 1)[:, None, None], sums, raw).astype(np.uint8).reshape(height, -1)
    out = np.zeros((height + 1, width + 1, step), np.int16)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, above, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        kind = kinds[y][:, None]
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, (left + above) >> 1, paeth], 0)
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, -1)


#: First column and row, and steps, of the seven passes of an interlaced PNG.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def png_pixels(data: bytes) -> np.ndarray | None:
    """rows x columns x channels, 8 bits each: grey, RGB or RGBA, palettes resolved, of any depth, interlaced or not."""
    parts = dict.fromkeys((b"IHDR", b"IDAT", b"PLTE"), b"")
    for kind, body in png_chunks(data):
        if kind in parts:
            parts[kind] += body
    if len(parts[b"IHDR"]) != 13:
        return None
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if not channels or depth not in (1, 2, 4, 8, 16) or not width * height or width * height > MOST_PIXELS:
        return None
    bits = channels * depth
    areas = [(x, y, dx, dy, -(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in (_PASSES if interlace else ((0, 0, 1, 1),))]
    need = sum(h * (-(-w * bits // 8) + 1) for *_, w, h in areas if w > 0 and h > 0)
    raw, at = np.frombuffer(inflate(parts[b"IDAT"], need), np.uint8), 0
    if len(raw) < need:
        return None
    out = np.zeros((height, width, channels), np.uint8)
    for x, y, dx, dy, w, h in areas:
        if w <= 0 or h <= 0:
            continue
        size = -(-w * bits // 8) + 1
        row = _unfiltered(raw[at : at + h * size].reshape(h, size), max(1, bits // 8))
        at += h * size
        if depth == 16:
            values = row.reshape(h, w, channels, 2)[..., 0]
        elif depth == 8:
            values = row.reshape(h, w, channels)
        else:
            single = np.unpackbits(row, axis=1)[:, : w * bits].reshape(h, w, depth)
            values = (single @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[..., None]
            if colour == 0:
                values = values * (255 // ((1 << depth) - 1))
        out[y::dy, x::dx] = values
    if colour == 3:
        palette = np.frombuffer(parts[b"PLTE"][: len(parts[b"PLTE"]) // 3 * 3], np.uint8).reshape(-1, 3)
        out = palette[np.minimum(out[..., 0], len(palette) - 1)] if len(palette) else None
    return out


def _gif_codes(data: bytes, start: int, most: int) -> bytes:
    """Palette indices of LZW data, at most `most`."""
    clear, end = 1 << start, (1 << start) + 1
    table: list[bytes] = []
    width, before, out = start + 1, b"", bytearray()
    bits = have = 0
    for byte in data:
        bits |= byte << have
        have += 8
        while have >= width:
            code = bits & (1 << width) - 1
            bits >>= width
            have -= width
            if code == clear:
                table = [bytes([i]) for i in range(clear)] + [b"", b""]
                width, before = start + 1, b""
                continue
            if code == end or not table or len(out) >= most or code > len(table):
                return bytes(out[:most])
            if code == len(table) and not before:
                return bytes(out[:most])
            entry = table[code] if code < len(table) else before + before[:1]
            out += entry
            if before and len(table) < 4096:
                table.append(before + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            before = entry
    return bytes(out[:most])


def gif_pixels(data: bytes) -> np.ndarray | None:
    """rows x columns x 3 of a GIF's first frame."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return None
    flags = data[10]
    shared = 3 << (flags & 7) + 1 if flags & 128 else 0
    palette, at = data[13 : 13 + shared], 13 + shared
    while at < len(data):
        if data[at] == 0x21:  # an extension
            at += 2
            while at < len(data) and data[at]:
                at += data[at] + 1
            at += 1
        elif data[at] == 0x2C and at + 10 <= len(data):
            _, _, width, height, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            if flags & 128:
                size = 3 << (flags & 7) + 1
                palette, at = data[at : at + size], at + size
            start, at, body = data[at] if at < len(data) else 0, at + 1, bytearray()
            while at < len(data) and data[at]:
                body += data[at + 1 : at + 1 + data[at]]
                at += data[at] + 1
            if not 2 <= start <= 8 or not width * height or width * height > MOST_PIXELS or len(palette) < 3:
                return None
            codes = np.frombuffer(_gif_codes(bytes(body), start, width * height), np.uint8)
            if len(codes) < width * height:
                return None
            rows = codes.reshape(height, width)
            if flags & 64:  # rows come in four passes
                order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, height, step)]
                rows = rows[np.argsort(order)]
            colours = np.frombuffer(palette[: len(palette) // 3 * 3], np.uint8).reshape(-1, 3)
            return colours[np.minimum(rows, len(colours) - 1)]
        else:
            return None
    return None


def pixel_statistics(pixels: np.ndarray) -> dict:
    """Of the first three channels: chi-square of the lowest bits against an even split, Shannon entropy of the values;
    and the text that the first channel's lowest bits spell."""
    flat = pixels.reshape(-1, pixels.shape[2])[:, :3]
    n = len(flat)
    ones = (flat & 1).sum(axis=0).astype(float)
    chi = ((n - 2 * ones) ** 2 / max(n, 1)).tolist()
    entropy = []
    for c in range(flat.shape[1]):
        p = np.bincount(flat[:, c], minlength=256) / max(n, 1)
        entropy.append(float(-(p[p > 0] * np.log2(p[p > 0])).sum()))
    bits = np.packbits(flat[: 2048 * 8, 0] & 1).tobytes()
    end = bits.find(b"\0", 4)
    message = bits if end < 0 else bits[:end]
    printable = sum(32 <= b < 127 or b in (9, 10, 13) for b in message)
    text = message.decode("ascii", "ignore") if message and printable / len(message) > 0.2 else ""
    return {"chi_square": chi, "entropy": entropy, "message": text}


def tiff_texts(data: bytes) -> list[dict]:
    """Text tags of a TIFF header, which an EXIF block starts with (after `Exif\\0\\0` in other files)."""
    at = data.find(b"Exif\0\0")
    tiff = data[at + 6 :] if at >= 0 else data
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(tiff[:4])
    out: list[dict] = []
    todo, seen = ([struct.unpack(order + "I", tiff[4:8])[0]] if order and len(tiff) >= 8 else []), set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        for i in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
            entry = tiff[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(entry) < 12:
                break
            tag, kind, count, value = struct.unpack(order + "HHII", entry)
            if tag == 0x8769:
                todo.append(value)
            elif tag in EXIF_TAGS and kind in (1, 2, 7):
                raw = entry[8 : 8 + count] if count <= 4 else tiff[value : value + count]
                raw = raw[8:] if tag == 0x9286 else raw
                out.append({"kind": "exif", "key": EXIF_TAGS[tag], "text": raw.rstrip(b"\0").decode("utf-8", "ignore")})
    return out


def image_features(data: bytes) -> dict:
    pixels = gif_pixels(data) if data[:3] == b"GIF" else png_pixels(data)
    return {"texts": png_texts(data), "exif": tiff_texts(data)} | (pixel_statistics(pixels) if pixels is not None else {"chi_square": [], "entropy": [], "message": ""}) | {"status": "ok" if pixels is not None else "undecodable"}


#: Inflated bytes of a stream; what is longer is cut, and said to be.
STREAM = 16 << 20


def _shown(body: bytes) -> list[bytes]:
    found = re.findall(rb"\(((?:\\.|[^()\\])*)\)\s*(?:Tj|')|\[((?:\((?:\\.|[^()\\])*\)|[^\]])*)\]\s*TJ", body, re.DOTALL)
    return [a or b"".join(re.findall(rb"\(((?:\\.|[^()\\])*)\)", b)) for a, b in found]


def pdf_text(data: bytes, pages: int) -> dict:
    """Shown text of the first `pages` pages and the metadata strings; streams are inflated if need be. A file whose page
    objects can't be seen (none, or packed in streams) gives the text of all its streams. cut: pages and streams of which
    something was left out."""
    if not data.startswith(b"%PDF"):
        return {"status": "pdf_parse_error", "text": "", "info": [], "cut": 0}
    streams, owners, contents, cut = [], {}, [], 0
    for m in re.finditer(rb"(?:(\d+)\s+\d+\s+obj\b((?:(?!endobj).)*?))?stream\r?\n(.*?)\r?\nendstream", data, re.DOTALL):
        if m[1]:
            owners[int(m[1])] = len(streams)
        streams.append((m[2] or b"", m[3]))
    for m in re.finditer(rb"\bobj\b((?:(?!endobj|stream\r?\n).)*?/Type\s*/Page\b(?:(?!endobj).)*)", data, re.DOTALL):
        found = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|(\d+\s+\d+\s+R))", m[1])
        contents.append([int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", found[1] or found[2])] if found else [])
    if any(contents):
        cut += max(0, len(contents) - pages)
        chosen = [streams[owners[k]] for own in contents[:pages] for k in own if k in owners]
    else:
        chosen = [x for x in streams if not re.search(rb"/Subtype\s*/Image|/FontFile|/Length1", x[0])]
    texts = []
    for _, packed in chosen:
        body = inflate(packed, STREAM) or packed
        cut += len(body) >= STREAM
        texts += _shown(body)
    info = [{"key": k.decode(), "text": re.sub(rb"\\(.)", rb"\1", v).decode("latin-1")} for k, v in re.findall(rb"/(Title|Author|Subject|Keywords|Creator|Producer)\s*\(((?:\\.|[^()\\])*)\)", data)]
    return {"status": "ok" if b"%%EOF" in data or b"endobj" in data else "pdf_parse_error", "text": " ".join(re.sub(rb"\\(.)", rb"\1", t).decode("latin-1") for t in texts), "info": info, "cut": cut}


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook(data: bytes, sheets: int) -> dict:
    """Cells of all sheets (order: of the workbook), comments, defined names, and whether there are macros."""
    out: dict = {"status": "ok", "macros": False, "cells": [], "comments": [], "names": []}
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            out["macros"] = "xl/vbaProject.bin" in names
            book = ElementTree.fromstring(z.read("xl/workbook.xml"))
            shared = [("".join(t.text or "" for t in si.iter(f"{_MAIN}t"))) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
            out["names"] = [{"key": n.get("name", ""), "text": n.text or ""} for n in book.iter(f"{_MAIN}definedName")]
            parts = {r.get("Id"): posixpath.normpath(posixpath.join("xl", r.get("Target", ""))).lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in names else {}
            for k, sheet in enumerate(book.iter(f"{_MAIN}sheet")):
                part = parts.get(sheet.get(_RELATION), f"xl/worksheets/sheet{k + 1}.xml")
                if part not in names:
                    continue
                for c in ElementTree.fromstring(z.read(part)).iter(f"{_MAIN}c"):
                    value, formula = c.findtext(f"{_MAIN}v") or "", c.findtext(f"{_MAIN}f") or ""
                    kind = c.get("t", "n")
                    if kind == "s" and value.isdigit() and int(value) < len(shared):
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    out["cells"].append({"sheet": sheet.get("name", ""), "place": k, "state": sheet.get("state", "visible"), "cell": c.get("r", ""), "text": value if kind in ("s", "str", "inlineStr") else "", "formula": f"={formula}" if formula else ""})
            for name in names:
                if re.fullmatch(r"xl/comments\d*\.xml", name):
                    out["comments"] += ["".join(t.text or "" for t in c.iter(f"{_MAIN}t")) for c in ElementTree.fromstring(z.read(name)).iter(f"{_MAIN}comment")]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error, ValueError, NotImplementedError, EOFError, RuntimeError):  # the last: encrypted
        out["status"] = "excel_parse_error"
    return out


def calendar(data: bytes, events: int) -> dict:
    """Properties of all components (at most `events` events), lines unfolded."""
    text = data.decode("utf-8", "ignore")
    if "BEGIN:VCALENDAR" not in text:
        return {"status": "ics_parse_error", "properties": []}
    stack, seen, out = [], 0, []
    for line in re.sub(r"\r?\n[ \t]", "", text).splitlines():
        head, _, value = line.partition(":")
        name, *parameters = head.split(";")
        name = name.strip().upper()
        if name == "BEGIN":
            stack.append(value.strip().upper())
            seen += stack[-1] == "VEVENT"
        elif name == "END":
            stack = stack[:-1]
        elif name and stack and seen <= events:
            out.append({"component": stack[-1], "name": name, "parameters": ";".join(parameters), "text": value.replace("\\n", "\n").replace("\\,", ",").replace("\\;", ";")})
    return {"status": "ok", "properties": out}


_PAIR = [("key", pa.string()), ("text", pa.string())]
_IMAGE = pa.struct([("texts", pa.list_(pa.struct([("kind", pa.string()), *_PAIR]))), ("exif", pa.list_(pa.struct([("kind", pa.string()), *_PAIR]))), ("chi_square", pa.list_(pa.float64())), ("entropy", pa.list_(pa.float64())), ("message", pa.string()), ("status", pa.string())])
_PDF = pa.struct([("status", pa.string()), ("text", pa.string()), ("info", pa.list_(pa.struct(_PAIR))), ("cut", pa.int32())])
_CELL = [("sheet", pa.string()), ("place", pa.int32()), ("state", pa.string()), ("cell", pa.string()), ("text", pa.string()), ("formula", pa.string())]
_BOOK = pa.struct([("status", pa.string()), ("macros", pa.bool_()), ("cells", pa.list_(pa.struct(_CELL))), ("comments", pa.list_(pa.string())), ("names", pa.list_(pa.struct(_PAIR)))])
_CALENDAR = pa.struct([("status", pa.string()), ("properties", pa.list_(pa.struct([("component", pa.string()), ("name", pa.string()), ("parameters", pa.string()), ("text", pa.string())])))])


def _function(of: Callable[[bytes], dict], kind: pa.DataType, ddl: str) -> Callable[[Column], Column]:
    """An Arrow function of a binary column; null gives null. A reader that fails on a file gives the status `error`
    for it, whatever went wrong, so one file never fails the job."""

    def one(b: bytes) -> dict:
        try:
            return of(b)
        except Exception as e:  # noqa: BLE001
            return {"status": "error", "text": type(e).__name__}

    @F.arrow_udf(ddl)
    def run(data: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_parts(data, lambda part: [None if b is None else one(b) for b in part], kind)

    return run


def images(data: Column) -> Column:
    text = "array<struct<kind:string,key:string,text:string>>"
    return _function(image_features, _IMAGE, f"struct<texts:{text},exif:{text},chi_square:array<double>,entropy:array<double>,message:string,status:string>")(data)


def pdfs(data: Column, pages: int) -> Column:
    return _function(lambda b: pdf_text(b, pages), _PDF, "struct<status:string,text:string,info:array<struct<key:string,text:string>>,cut:int>")(data)


def workbooks(data: Column, sheets: int) -> Column:
    return _function(lambda b: workbook(b, sheets), _BOOK, "struct<status:string,macros:boolean,cells:array<struct<sheet:string,place:int,state:string,cell:string,text:string,formula:string>>,comments:array<string>,names:array<struct<key:string,text:string>>>")(data)


def calendars(data: Column, events: int) -> Column:
    return _function(lambda b: calendar(b, events), _CALENDAR, "struct<status:string,properties:array<struct<component:string,name:string,parameters:string,text:string>>>")(data)
