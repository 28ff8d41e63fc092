"""Removal of repeated 200-byte strings by a hash-compared suffix sort.

Every 200-byte window has an anchor: the leftmost least hash of its 48-byte grams. Equal windows have equal grams at
equal distances, so only windows with equal anchor grams can be equal. Each anchor is written down once with the run of
windows that it serves and a hash of their bytes (the run's context), about one row for 75 bytes of text.

Anchor grams that occur once are done: their windows are unique. The contexts of all others are cut from their texts and
grouped by their bytes, copies within a task first, so that what counts as equal has been compared byte by byte; the
hashes of gram and context only bring together what is compared. A context that occurs twice repeats with all its
windows. Where a gram has several contexts, the texts behind and before the anchors are sorted as suffixes: a mergesort
whose comparisons find the common extension by binary search over prefix polynomial hashes. Neighbours' extensions are
then verified byte by byte (and a wrong order sorted again by bytes), and windows are equal if they share a long enough
extension on both sides. A gram with over GROUP different contexts would be too much for one task: its windows are
taken in ranges of neighbours, whose shared bytes are grouped in aggregates that Spark spreads over all tasks, and cut
smaller only where they are neither unlike all others nor wholly alike. These too are compared by their bytes.

Null text is empty. Texts below 200 bytes lose nothing. Repeated rows are documents of their own, so all their windows
repeat; a null doc_id is an id. Very long texts are read in overlapping pieces of PIECE windows. Matches never cross
documents. An empty table gives no rows.
"""

from __future__ import annotations

import collections
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentsec.llm.common import blocks, flat, id_and_text, materialize, mix64, random_table

WINDOW, GRAM, GROUP, PIECE = 200, 48, 256, 1 << 20
WIDTH = WINDOW - GRAM + 1
#: Different contexts that a task holds before it hands them on.
HELD = 1 << 15
#: Bits of the hashes of grams and contexts; tests take few, so that they collide.
BITS = 64
_BYTE = random_table(256, 29)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, made when first needed."""

    of: np.ndarray = np.zeros(0, np.uint64)
    inverse: np.ndarray = np.zeros(0, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.of) < n:
            size = max(n, 1 << 14)
            cls.of, cls.inverse = _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
        return cls.of[:n], cls.inverse[:n]


def anchored(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, distance of the anchor from the first window, hash of its gram) of each run."""
    n = len(text)
    windows = n - WINDOW + 1
    power, inverse = _Powers.upto(n)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(_BYTE[text] * power, out=prefix[1:])
    gram = mix64((prefix[GRAM:] - prefix[:-GRAM]) * inverse[: n - GRAM + 1])
    least = gram & np.uint64(0xFFFFFFFF00000000) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= WIDTH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:windows], least[WIDTH - width : WIDTH - width + windows])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    return first, np.diff(np.append(first, windows)), at[first] - first, gram[at[first]]


def occurrences(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, k, h, c, s, n, a) of each anchor of docs(doc_id, text); k names the text, c the bytes of the run."""
    mask = (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, limit=1 << 20):
            data, offsets = flat(part.column("text"))
            cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
            rows = np.zeros(part.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if y - x < WINDOW:
                    continue
                view = memoryview(data[x:y])
                key = xxhash.xxh3_64_intdigest(view)
                for at in range(0, y - x - WINDOW + 1, PIECE):
                    first, n, a, h = anchored(data[x + at : min(y, x + at + PIECE + WINDOW - 1)])
                    first = first + at
                    c = [xxhash.xxh3_64_intdigest(view[s:e], seed=d) for s, e, d in zip(first.tolist(), (first + n + WINDOW - 1).tolist(), a.tolist(), strict=True)]
                    rows[i] += len(first)
                    for col, v in zip(cols, (np.full(len(first), key, np.uint64).view(np.int64), (h & np.uint64(mask)).view(np.int64), (np.array(c, np.uint64) & np.uint64(mask)).view(np.int64), first, n, a), strict=True):
                        col.append(v)
            whole = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            ids = part.column("doc_id").take(pa.array(np.repeat(np.arange(part.num_rows), rows)))
            yield pa.record_batch([ids, *(pa.array(v, pa.int64()) for v in whole[:4]), pa.array(whole[4], pa.int16()), pa.array(whole[5], pa.int16())], ["doc_id", "k", "h", "c", "s", "n", "a"])

    return docs.mapInArrow(run, "doc_id bigint, k bigint, h bigint, c bigint, s bigint, n smallint, a smallint")


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, k, text binary) with compressed texts, for joins that move them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for part in blocks(batches):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            keys = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([part.column("doc_id"), pa.array(keys, pa.int64()), pa.array([press.compress(t) for t in texts], pa.binary())], ["doc_id", "k", "text"])

    return docs.mapInArrow(run, "doc_id bigint, k bigint, text binary")


def suffix_order(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of equally long byte rows by (group, bytes), and how many bytes each shares with the row before it in
    that order (-1 at a group's first)."""
    m, width = rows.shape
    prefix = np.zeros((m, width + 1), np.uint64)
    np.cumsum(_BYTE[rows] * _powers(_BASE, width), axis=1, out=prefix[:, 1:])

    def below(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether row x comes before row y; the common extension is found by binary search over prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), width, np.int64)
        for _ in range(width.bit_length()):
            mid = (low + high + 1) // 2
            same = prefix[x, mid] == prefix[y, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        at = np.minimum(low, width - 1)
        return np.where(group[x] != group[y], group[x] < group[y], (low < width) & (rows[x, at] < rows[y, at]))

    order, run = np.arange(m), 1
    place = np.arange(m)
    while run < m:  # merges of neighbouring runs, all at once: each row's rank in the other run
        start = place // (2 * run) * (2 * run)
        left = place - start < run
        low = np.where(left, start + run, start).clip(max=m)
        high = np.where(left, start + 2 * run, start + run).clip(max=m)
        first = low.copy()
        for _ in range(run.bit_length()):
            open_ = low < high
            mid = np.minimum((low + high) // 2, m - 1)
            other = np.where(left, below(order[mid], order), ~below(order, order[mid]))
            low, high = np.where(open_ & other, mid + 1, low), np.where(open_ & ~other, mid, high)
        to = np.where(left, place, place - run) + low - first
        merged = np.empty(m, np.int64)
        merged[to] = order
        order, run = merged, 2 * run
    for again in (False, True):  # verification
        sorted_rows = rows[order]
        differ = sorted_rows[1:] != sorted_rows[:-1]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if m > 1 else np.zeros(0, np.int64)
        at = np.minimum(shared, width - 1)[:, None]
        rising = np.where(group[order][1:] != group[order][:-1], group[order][1:] > group[order][:-1], (shared == width) | (np.take_along_axis(sorted_rows[:-1], at, 1) < np.take_along_axis(sorted_rows[1:], at, 1))[:, 0])
        if again or rising.all():
            break
        order = np.lexsort((*rows.T[::-1], group))
    shared = np.where(group[order][1:] == group[order][:-1], shared, -1)
    return order, np.concatenate(([-1], shared))[:m]


def repeated(group: np.ndarray, contexts: list[bytes], a: np.ndarray, n: np.ndarray, times: np.ndarray) -> np.ndarray:
    """(context x window) True where a window of a context occurs twice at least among its group's contexts."""
    m = len(contexts)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    ends = np.cumsum([len(c) for c in contexts])
    anchor = np.concatenate(([0], ends[:-1])) + a
    step = np.arange(WINDOW)
    behind = np.where(step < (ends - anchor)[:, None], data[np.minimum(anchor[:, None] + step, len(data) - 1)], 0)
    before = np.where(step[:WIDTH] < a[:, None], data[np.maximum(anchor[:, None] - 1 - step[:WIDTH], 0)], 0)
    classes = []
    for rows in (behind, before):
        order, shared = suffix_order(np.ascontiguousarray(rows, np.uint8), group)
        classes.append((order, shared))
    found = np.zeros((m, WIDTH), bool)
    of = np.zeros((2, m), np.int64)
    for d in range(int((a - n + 1).min()), int(a.max()) + 1):  # windows that start d bytes before their anchor
        own = np.flatnonzero((a - n + 1 <= d) & (d <= a))
        for i, ((order, shared), need) in enumerate(zip(classes, (WINDOW - d, d), strict=True)):
            of[i, order] = np.cumsum(shared < need)
        _, inverse = np.unique(of[0, own] * (m + 1) + of[1, own], return_inverse=True)
        twice = np.bincount(inverse, weights=times[own])[inverse] > 1
        found[own[twice], a[own[twice]] - d] = True
    return found


def _runs(flags: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge.reshape(-1, 2).tolist()


#: A context's group, its class (hash, and a number where classes share the hash), and its runs of repeated windows.
_FOUND = "h bigint, c bigint, e int, runs array<array<int>>"
_CUT = "h bigint, c bigint, a smallint, n smallint, times bigint, context binary"


def _sorted_groups(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows (h, c, e, a, n, times, context) that come sorted by h, many groups at once."""
    held: list[tuple] = []

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        h, c, e, a, n, times, contexts = zip(*rows, strict=True)
        _, group = np.unique(np.array(h, np.int64), return_inverse=True)
        flags = repeated(group, list(contexts), np.array(a, np.int64), np.array(n, np.int64), np.array(times, float))
        return pa.record_batch([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(e, pa.int32()), pa.array([_runs(f) for f in flags], pa.list_(pa.list_(pa.int32())))], ["h", "c", "e", "runs"])

    for batch in batches:
        held += zip(*(batch.column(x).to_pylist() for x in ("h", "c", "e", "a", "n", "times", "context")), strict=True)
        while len(held) > most:
            cut = most
            while cut < len(held) and held[cut][0] == held[cut - 1][0]:
                cut += 1
            if cut == len(held):
                break
            yield solve(held[:cut])
            held = held[cut:]
    if held:
        yield solve(held)


#: Widths of the ranges of windows into which a gram's contexts are cut when they are too many for one task.
RANGES = (64, 16, 4, 1)
_RANGE = "h bigint, c bigint, e int, times bigint, a int, d int, core binary, whole binary"


def _cut_ranges(width: int):
    """Rows (h, c, e, a, n, context, asks) to one row for each range of `width` windows, d..d + width - 1 bytes before the
    anchor, that is asked for and meets the context's own windows. core has the bytes that all windows of the range
    share, whole all their bytes; whole is null where the context lacks some of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for h, c, e, a, n, context, asks in zip(*(batch.column(x).to_pylist() for x in ("h", "c", "e", "a", "n", "context", "asks")), strict=True):
                least = a - n + 1
                for ask in asks:
                    d, last = ask["d"], ask["d"] + width - 1
                    if last < least or d > a:
                        continue
                    whole = context[a - last : a + WINDOW - d] if last <= a and d >= least else None
                    for col, v in zip(cols, (h, c, e, ask["times"], a, d, context[max(a - d, 0) : a + WINDOW - last], whole), strict=True):
                        col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], ["h", "c", "e", "times", "a", "d", "core", "whole"])

    return run


def _counted_ranges(contexts: DataFrame) -> DataFrame:
    """(h, c, e, runs) of contexts(h, c, e, a, n, times, context), by aggregates only, so that no task needs a whole
    group.

    Ranges whose shared bytes nothing else has are done: none of their windows repeats. Ranges that are wholly equal are
    done too: all of their windows repeat, and one of them goes on for the rest. What goes on is cut into smaller ones."""
    one = ["h", "c", "e"]
    found = contexts.filter("times > 1").select(*one, F.array(F.lit(0), F.col("n").cast("int")).alias("run"))
    asks = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1), F.lit(RANGES[0])), lambda d: F.struct(d.cast("int").alias("d"), F.col("times").alias("times")))
    asked = contexts.select(*one, "a", "n", "context", asks.alias("asks"))
    for width, smaller in zip(RANGES, (*RANGES[1:], 0), strict=True):
        each = materialize(asked.mapInArrow(_cut_ranges(width), _RANGE), "ranges")
        own = F.when(F.col("whole").isNull(), F.struct("c", "e"))  # a range that lacks windows is like no other
        kinds = materialize(each.groupBy("h", "d", "core", "whole", own.alias("own")).agg(F.sum("times").alias("all_times"), F.min(F.struct("c", "e")).alias("least")), "kinds")
        same = materialize(kinds.filter("whole is not null and all_times > 1").select("h", "d", "whole"), "same")
        equal = each.filter("whole is not null").join(same, ["h", "d", "whole"]).select(*one, F.array(F.col("a") - F.col("d") - (width - 1), F.col("a") - F.col("d") + 1).alias("run"))
        found = found.union(equal)
        if smaller:
            several = materialize(kinds.groupBy("h", "d", "core").count().filter("count > 1").drop("count"), "several")
            on = kinds.join(several, ["h", "d", "core"]).select("h", "least.c", "least.e", F.col("all_times").alias("times"), F.explode(F.sequence(F.col("d"), F.col("d") + (width - 1), F.lit(smaller))).alias("d"))
            asked = contexts.drop("times").join(materialize(on.groupBy(*one).agg(F.collect_list(F.struct("d", "times")).alias("asks")), "on"), one)
    return materialize(found, "runs").groupBy(*one).agg(F.collect_set("run").alias("runs"))


def _cut(counted: bool):
    """Texts with their anchors (asks) to the bytes of each anchor's context: counted, equal ones of a task together, or
    one by one with the place that each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, held = zstandard.ZstdDecompressor(), collections.Counter()

        def counts() -> pa.RecordBatch:
            h, c, a, contexts = zip(*held, strict=True)
            n = [len(x) - WINDOW + 1 for x in contexts]
            out = pa.record_batch([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(a, pa.int16()), pa.array(n, pa.int16()), pa.array(list(held.values()), pa.int64()), pa.array(contexts, pa.binary())], ["h", "c", "a", "n", "times", "context"])
            held.clear()
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                text = press.decompress(batch.column("text")[i].as_py())
                asks = batch.column("asks")[i].values
                h, c, s, n, a = (asks.field(x).to_pylist() for x in ("h", "c", "s", "n", "a"))
                contexts = [text[x : x + y + WINDOW - 1] for x, y in zip(s, n, strict=True)]
                if counted:
                    held.update(zip(h, c, a, contexts, strict=True))
                    if len(held) >= HELD:
                        yield counts()
                else:
                    m = len(h)
                    yield pa.record_batch([pa.array([batch.column(x)[i].as_py()] * m, pa.int64()) for x in ("doc_id", "k")] + [pa.array(s, pa.int64()), pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(a, pa.int16()), pa.array(contexts, pa.binary())], ["doc_id", "k", "s", "h", "c", "a", "context"])
        if held:
            yield counts()

    return run


def _with_text(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(doc_id, k, text, asks): the texts that hold anchors of shared, packed, with those anchors, each once."""
    asks = shared.groupBy(F.col("doc_id").alias("_id"), F.col("k").alias("_k")).agg(F.collect_set(F.struct("h", "c", "s", "n", "a")).alias("asks"))
    there = packed(docs).join(materialize(asks, "asked"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("k") == F.col("_k")))
    return there.select("doc_id", "k", "text", "asks")


def repeats(docs: DataFrame, group: int = GROUP, bits: int = BITS) -> DataFrame:
    """(doc_id, k, start, stop): byte ranges of docs(doc_id, text) that repeated windows cover; ranges may overlap."""
    occ = materialize(occurrences(docs, bits), "anchors")
    grams = materialize(occ.groupBy("h").count().filter("count > 1").select("h"), "grams")
    shared = materialize(occ.join(grams, "h"), "shared")
    cut = _with_text(docs, shared).mapInArrow(_cut(True), _CUT)
    classes = materialize(cut.groupBy("h", "c", "a", "n", "context").agg(F.sum("times").alias("times")), "contexts")

    clash = materialize(classes.groupBy("h", "c").count().filter("count > 1").drop("count"), "clashes")
    located = shared.select("doc_id", "k", "s", "n", "h", "c", F.lit(0).alias("e"))
    if clash.isEmpty():
        classes = classes.withColumn("e", F.lit(0))
    else:  # hashes that different contexts share: their classes are numbered, and found again by their bytes
        order = Window.partitionBy("h", "c").orderBy("a", "context")
        mixed = materialize(classes.join(clash, ["h", "c"]).withColumn("e", F.row_number().over(order)), "clashing")
        classes = classes.join(clash, ["h", "c"], "left_anti").withColumn("e", F.lit(0)).unionByName(mixed)
        odd = shared.join(clash, ["h", "c"])
        places = _with_text(docs, odd).mapInArrow(_cut(False), "doc_id bigint, k bigint, s bigint, h bigint, c bigint, a smallint, context binary")
        places = places.join(mixed.select("h", "c", "a", "context", "n", "e"), ["h", "c", "a", "context"]).select("doc_id", "k", "s", "n", "h", "c", "e")
        located = located.join(clash, ["h", "c"], "left_anti").unionByName(materialize(places, "places"))

    sizes = materialize(classes.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    alone = classes.join(sizes, "h", "left_anti").filter("times > 1").select("h", "c", "e", F.array(F.array(F.lit(0), F.col("n").cast("int"))).alias("runs"))
    few = classes.join(sizes.filter(F.col("size") <= group).select("h"), "h").select("h", "c", "e", "a", "n", "times", "context")
    few = few.repartition("h").sortWithinPartitions("h").mapInArrow(_sorted_groups, _FOUND)
    many = materialize(sizes.filter(F.col("size") > group).select("h"), "many")
    found = alone.union(few)
    if not many.isEmpty():
        found = found.union(_counted_ranges(materialize(classes.join(many, "h"), "crowded")))
    found = materialize(found.filter(F.size("runs") > 0), "found")
    covered = located.join(found, ["h", "c", "e"]).select("doc_id", "k", "s", F.explode("runs").alias("r"))
    return covered.select("doc_id", "k", (F.col("s") + F.col("r")[0]).alias("start"), (F.col("s") + F.col("r")[1] + WINDOW - 1).alias("stop"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, bits: int = BITS) -> DataFrame:
    """(doc_id, n_bytes, spans array<array<bigint>>, kept binary), one row for each row of docs: the maximal byte runs
    that go, and the bytes that stay."""
    docs = id_and_text(docs, id_col, text_col)
    spans = repeats(docs, group, bits).distinct().groupBy("doc_id", "k").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).withColumnsRenamed({"doc_id": "_id", "k": "_k"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, runs, kept = [], [], []
            for i in range(batch.num_rows):
                text = press.decompress(batch.column("text")[i].as_py())
                sizes.append(len(text))
                merged: list[list[int]] = []
                for start, stop in sorted((x["start"], x["stop"]) for x in batch.column("spans")[i].as_py() or ()):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], stop)
                    else:
                        merged.append([start, stop])
                runs.append(merged)
                cuts = [0, *itertools.chain.from_iterable(merged), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    joined = packed(docs).join(materialize(spans, "spans"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("k") == F.col("_k")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, n_bytes bigint, spans array<array<bigint>>, kept binary")
