"""Document fingerprints by locally consistent parsing.

A text is a sequence of bytes. On each level, runs of one symbol become one symbol; deterministic coin tossing (which
bit is the lowest that differs from the symbol before, and its value) turns the distinct neighbours into a few small
labels in ROUNDS steps; places where a label is a local maximum start the phrases. A phrase's name is a hash of the
symbols in it, and the names are the next level's symbols. Where a phrase starts depends on a few symbols around it
only, so equal substrings have the same names inside, wherever they stand.

The fingerprint holds, for each of the LEVELS, the SKETCH smallest of the text's distinct phrase names. Likeness is the
share of names in both of two texts, estimated from the smallest names of their union; equal fingerprints have 1.

Null text is empty and has an empty fingerprint; an empty text is like another empty one (1) and like no other (0).
"The next document" is the next row by (doc_id, hash of the text), null ids last, and the first row after the last; so
repeated rows follow one another, and a sole row follows itself. The edited text is empty only where the text is. A
common id, or many null ids, are split over several tasks by that hash; copies of one row are counted where they are
read, and move as one row with a count.

Texts are parsed whole; the memory for one is about 60 times its bytes.
"""

from __future__ import annotations

import collections
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentsec.llm.common import blocks, id_and_text, mix64, random_table

ROUNDS, LEVELS, SKETCH = 3, (2, 3), 32
#: Bytes parsed at once, and neighbouring ids that are in one task at least, in parts of all.
BLOCK, BUCKETS = 1 << 19, 4
_BYTE = random_table(256, 17)
_POWER = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _toss_table() -> np.ndarray:
    """The label of a small symbol after another: twice the lowest bit that differs, plus that bit."""
    x, y = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    low = (x ^ y) & -(x ^ y)
    bit = np.bitwise_count(np.maximum(low, 1) - 1)
    return (2 * bit + (y >> bit & 1)).astype(np.uint8)


_TOSS = _toss_table()


def _before(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each symbol's predecessor; a text's first symbol has one that differs in its lowest bit."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = x[starts] ^ x.dtype.type(1)
    return out


def phrases(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of several texts, one after the other, none of them empty; starts: of the texts in symbols."""
    fresh = np.ones(len(symbols), bool)
    fresh[1:] = symbols[1:] != symbols[:-1]
    fresh[starts] = True
    at = np.flatnonzero(fresh)
    if len(at) < len(symbols):
        starts = np.searchsorted(at, starts)
        length = np.diff(np.append(at, len(symbols))).astype(np.uint64)
        symbols = symbols[at] + (length - np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    apart = symbols ^ _before(symbols, starts)
    apart = np.maximum(apart, np.uint64(1))  # runs of one symbol could meet only by a collision
    bit = np.bitwise_count((apart & -apart.astype(np.int64).view(np.uint64)) - np.uint64(1))
    label = (2 * bit + (symbols >> bit.astype(np.uint64) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(ROUNDS - 1):
        label = _TOSS[_before(label, starts), label]
    head = np.zeros(len(label), bool)
    head[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    head[starts[1:] - 1] = False  # a text's last symbol has nothing behind it
    head[starts] = True
    first = np.flatnonzero(head)
    place = np.arange(len(label)) - np.repeat(first, np.diff(np.append(first, len(label))))
    names = mix64(np.add.reduceat(symbols * _POWER[place & 63], first))
    return names, np.searchsorted(first, starts)


def fingerprints(texts: list[bytes]) -> list[str]:
    """Of each text: its smallest names of each level in hexadecimal, 8 digits each, levels parted by a full stop."""
    out = [""] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    sizes = np.array([len(texts[i]) for i in full])
    symbols, starts = _BYTE[np.frombuffer(b"".join(texts[i] for i in full), np.uint8)], np.cumsum(sizes) - sizes
    found: list[list[str]] = [[] for _ in full]
    for level in range(1, max(LEVELS) + 1):
        symbols, starts = phrases(symbols, starts)
        if level in LEVELS:
            short = (symbols >> np.uint64(32)).astype(np.uint32)
            bounds = [*starts.tolist(), len(short)]
            for k in range(len(full)):
                own = short[bounds[k] : bounds[k + 1]]
                if len(own) > 8 * SKETCH:  # enough for the smallest, unless names repeat much
                    least = np.unique(np.partition(own, 4 * SKETCH)[: 4 * SKETCH])
                    own = least if len(least) >= SKETCH else np.unique(own)
                else:
                    own = np.unique(own)
                found[k].append(own[:SKETCH].astype(">u4").tobytes().hex())
    for k, i in enumerate(full):
        out[i] = ".".join(found[k])
    return out


def likeness(a: str, b: str) -> float:
    """The estimated share of phrase names that two fingerprints have in common, over all levels."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    both = either = 0
    for x, y in zip(a.split("."), b.split("."), strict=True):
        p, q = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (x, y))
        least = sorted(p | q)[:SKETCH]
        either += len(least)
        both += len(p & q & set(least))
    return both / either


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint), one row for each row of docs; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, limit=BLOCK):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            yield pa.record_batch([part.column("doc_id"), pa.array(fingerprints(texts), pa.string())], ["doc_id", "fingerprint"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, fingerprint string")


def _bounds(docs: DataFrame, buckets: int) -> list[tuple[bool, int, int]]:
    """First keys (id is null, id, hash of the text) of the buckets but the first, from a quantile sketch of the ids alone.
    An id that is several quantiles is split evenly by the hash, and so are null ids."""
    asked = [k / buckets for k in range(1, buckets)] or [0.5]
    r = docs.agg(F.percentile_approx("doc_id", asked, 10 * buckets), F.count("*"), F.count("doc_id"), F.min("doc_id")).first()
    times = collections.Counter(r[0] or [])
    nulls = r[1] - r[2]
    keys = [(False, x, j * 2**63 // n) for x, n in times.items() for j in range(n)]
    if nulls:
        n = max(1, round(buckets * nulls / r[1]))
        keys += [(True, 0, j * 2**63 // n) for j in range(n)]
    return sorted(k for k in keys if k != (False, r[3], 0))


def _keyed(part: pa.RecordBatch) -> Iterator[tuple[tuple[bool, int, int], int | None, bytes]]:
    for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
        yield (doc_id is None, doc_id or 0, xxhash.xxh3_64_intdigest(text) >> 1), doc_id, text


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, ahead, doc_id, tie, m, text binary): docs(doc_id, text) in buckets of neighbouring keys, sorted in each
    partition, m alike rows as one; at the end of each bucket, marked as ahead, a copy of the next bucket's first row.

    The driver holds one key for each bucket. One shuffle moves compressed texts."""
    bounds = _bounds(docs, buckets)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[bool, int, int]] = {}
        for part in blocks(batches, limit=BLOCK):
            for key, _, _ in _keyed(part):
                own = bisect_right(bounds, key)
                found[own] = min(found.get(own, key), key)
        yield pa.record_batch([pa.array(list(found), pa.int32()), *(pa.array([k[i] for k in found.values()], t) for i, t in enumerate((pa.bool_(), pa.int64(), pa.int64())))], ["bucket", "a", "b", "c"])

    firsts = docs.mapInArrow(least, "bucket int, a boolean, b bigint, c bigint").groupBy("bucket").agg(F.min(F.struct("a", "b", "c")).alias("k")).orderBy("bucket").collect()
    before = {tuple(r.k): firsts[i - 1].bucket for i, r in enumerate(firsts)}  # the bucket before, the last for the first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for part in blocks(batches, limit=BLOCK):
            alike = collections.Counter(_keyed(part))
            rows: list[tuple] = []
            for (key, doc_id, text), m in alike.items():
                packed = press.compress(text)
                rows.append((bisect_right(bounds, key), False, doc_id, key[2], m, packed))
                if key in before:
                    rows.append((before[key], True, doc_id, key[2], 1, packed))
            cols = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "ahead", "doc_id", "tie", "m", "text"])

    placed = docs.mapInArrow(run, "bucket int, ahead boolean, doc_id bigint, tie bigint, m bigint, text binary")
    return placed.repartition("bucket").sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_last(), "tie")


def edited(text: str, after: str) -> str:
    """text with its last quarter replaced by as many code points from the start of another."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, held = zstandard.ZstdDecompressor(), []

        def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            """Of all rows but the last, which is only looked at."""
            real = [i for i in range(len(rows) - 1) if not rows[i][1]]
            # a row and the one behind it; of m alike rows all but one are followed by themselves
            pairs = [(i, j, n) for i in real for j, n in ((i, rows[i][4] - 1), (i + 1, 1)) if n]
            own = fingerprints([r[3].encode() for r in rows])
            for at in range(0, len(pairs), 4096):
                some = pairs[at : at + 4096]
                new = [edited(rows[i][3], rows[j][3]).encode() for i, j, _ in some]
                for (i, j, n), e, f in zip(some, new, fingerprints(new), strict=True):
                    row = (rows[i][2], len(rows[i][3]), hashlib.sha256(e).hexdigest(), own[i], f, likeness(own[i], f), likeness(own[i], own[j]))
                    for k in range(0, n, 10_000):
                        out.extend([row] * min(10_000, n - k))
                        if len(out) >= 10_000:
                            yield batch_of(out)
                            out.clear()
            if out:
                yield batch_of(out)
                out.clear()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        size, out = 0, []
        for batch in batches:
            for bucket, ahead, doc_id, m, text in zip(*(batch.column(c) for c in ("bucket", "ahead", "doc_id", "m", "text")), strict=True):
                if ahead.as_py() and held and held[-1][1] and held[-1][0] == bucket.as_py():
                    continue
                held.append((bucket.as_py(), ahead.as_py(), doc_id.as_py(), press.decompress(text.as_py()).decode(), m.as_py()))
                size += len(held[-1][3])
                if size >= BLOCK:
                    yield from solve(held)
                    held, size = held[-1:], len(held[-1][3])
        if held:
            yield from solve([*held, held[-1]])  # each bucket ends with a row ahead, so nothing is behind the last

    docs = id_and_text(docs, id_col, text_col)
    buckets = buckets or min(20_000, BUCKETS * max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.select("doc_id").rdd.getNumPartitions()))
    return in_order(docs, buckets).select("bucket", "ahead", "doc_id", "m", "text").mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
