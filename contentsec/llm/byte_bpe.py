"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The corpus is the set of distinct pre-tokens of all texts. Rows are read in blocks of about BLOCK text bytes; each block
becomes codes of its distinct words, and hands those words out, dealt by a hash of the word into slices. Each slice is
encoded in one task, so a word is encoded once however many blocks hold it. A slice's words are laid out side by side
with an inverted index from the rank of a pair's merge to its positions. The index is replayed in rank order over all
words at once: a merge touches its own position only and updates the two pairs next to it. The encodings go back to the
blocks that asked for them, where each text's ids are gathered by its codes. Words that are entries of the vocabulary,
among them all that are frequent in usual text, are their own encoding and aren't moved; the vocabulary bounds them.

Three shuffles: a block's codes, words by slice, and encodings by block, all packed. The codes are cut once and used on
both sides. No task holds more than a block, its distinct words, and SLICE words with their index at once.

A block is named by its place in the input, so a lost task must read the same rows again, as scans of files do; a block
whose encodings don't fit its words raises an error. Null text counts as empty (no tokens). Rows are independent, so
repeated rows, ties and empty tables need no care; null ids pass through. A very long text is a block of its own, cut
into runs of whole pre-tokens, never truncated.
"""

from __future__ import annotations

import array
import base64
import functools
import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentsec.llm.common import blocks, flat, id_and_text

#: Text bytes of a block; words that are put together, and bytes that are decoded, at once.
BLOCK, PART = 8 << 20, 1 << 18
#: Characters from which a text is cut into runs, and pre-tokens of a run.
LONG_TEXT, RUN = 1 << 20, 1 << 16
#: Words of a slice that are replayed together, and encoded words that a task keeps for its later blocks.
SLICE = 1 << 16
_NONE = 1 << 40


class Encoder:
    """Ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.vocabulary = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        left, right, made = array.array("q"), array.array("q"), array.array("q")
        for t, r in ranks.items():
            for i in range(1, len(t)):
                if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None:
                    left.append(a)
                    right.append(b)
                    made.append(r)
        #: The rank of each pair's merge, under left * stride + right, as a table and sorted for look-ups in bulk.
        self.stride = len(self.vocabulary)
        keys = np.array(left, np.int64) * self.stride + np.array(right, np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.append(keys[order], _NONE), np.append(np.array(made, np.int64)[order], _NONE)
        self.pairs = dict(zip(self.pair_keys[:-1].tolist(), self.pair_ranks[:-1].tolist(), strict=True))
        self.of_byte = [ranks.get(bytes([b]), -1) for b in range(256)]
        if min(self.of_byte) < 0:
            raise ValueError("the vocabulary lacks single bytes")
        self.pattern = regex.compile(pattern)
        #: Entries that are texts, with their own encoding.
        self.entries: dict[str, bytes] = {}
        for token, rank in ranks.items():
            try:
                self.entries[token.decode()] = rank.to_bytes(4, "little")
            except UnicodeDecodeError:
                continue

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The encodings of words, none of them empty, as little-endian unsigned 32-bit ids."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        first = np.array(self.of_byte, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        n = len(first)
        # the inverted index: for each rank the positions, in order, whose pair merges to it
        key = first[:-1] * self.stride + first[1:]
        key[ends[:-1] - 1] = _NONE - 1  # a word's last symbol has no pair
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)
        order = np.argsort(rank, kind="stable")
        order = order[: np.searchsorted(rank[order], _NONE)]
        cut = np.flatnonzero(np.diff(rank[order])) + 1
        index = {int(rank[p[0]]): p.tolist() for p in np.split(order, cut) if len(p)}
        word_of = np.repeat(np.arange(len(words)), sizes).tolist()
        ids, after, before = first.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        for e in ends.tolist():
            after[e - 1] = -1
            if e < n:
                before[e] = -1
        get, stride = self.pairs.get, self.stride
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            rank_ = heapq.heappop(queue)
            places = index.pop(rank_, None)
            if places is None:
                continue
            places.sort()
            late: set[int] = set()  # words in which a lower rank has come up, which goes first there
            for place in places:
                to = after[place]
                if to < 0 or get(ids[place] * stride + ids[to]) != rank_:
                    continue
                if late and word_of[place] in late:
                    index.setdefault(rank_, []).append(place)
                    continue
                far = after[to]
                ids[place], ids[to] = rank_, -_NONE
                after[place], after[to] = far, -1
                if far >= 0:
                    before[far] = place
                    if (new := get(rank_ * stride + ids[far])) is not None:
                        if new in index:
                            index[new].append(place)
                        else:
                            index[new] = [place]
                            heapq.heappush(queue, new)
                        if new < rank_:
                            late.add(word_of[place])
                left = before[place]
                if left >= 0 and (new := get(ids[left] * stride + rank_)) is not None:
                    if new in index:
                        index[new].append(left)
                    else:
                        index[new] = [left]
                        heapq.heappush(queue, new)
                    if new < rank_:
                        late.add(word_of[place])
            if rank_ in index:
                heapq.heappush(queue, rank_)
        final = np.array(ids, np.int64)
        stay = final >= 0
        kept = [0, *np.cumsum(stay)[ends - 1].tolist()]
        packed = final[stay].astype("<u4").tobytes()
        return [packed[4 * a : 4 * b] for a, b in itertools.pairwise(kept)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The encodings of words, none of them empty. An entry of the vocabulary is its own."""
        out = [self.entries.get(w) for w in words]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.replay([words[i].encode("utf-8", "surrogatepass") for i in rest]), strict=True):
            out[i] = ids
        return out

    def runs(self, text: str) -> Iterator[list[str]]:
        """The text's pre-tokens, a bounded number at a time if it is very long."""
        if len(text) <= LONG_TEXT:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while run := [m[0] for m in itertools.islice(found, RUN)]:
            yield run

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Of texts that are the whole corpus."""
        words = list({w for t in texts for run in self.runs(t) for w in run})
        get = dict(zip(words, self.encode_words(words), strict=True)).__getitem__
        return [b"".join(b"".join(map(get, run)) for run in self.runs(t)) for t in texts]

    def decode(self, ids: np.ndarray) -> bytes:
        get, step = self.vocabulary.__getitem__, 1 << 16
        return b"".join(b"".join(map(get, ids[i : i + step].tolist())) for i in range(0, len(ids), step))


@functools.lru_cache(4)
def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file, one in each Python worker."""
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(name, rows) of each block: consecutive rows of the task's input with about BLOCK text bytes."""
    block, held, size = TaskContext.get().partitionId() << 40, [], 0
    for part in blocks(batches, limit=BLOCK):
        _, offsets = flat(part.column("text"))
        if held and size + int(offsets[-1]) > BLOCK:
            yield block, held
            block, held, size = block + 1, [], 0
        held.append(part)
        size += int(offsets[-1])
    if held:
        yield block, held


def _packed(*arrays: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([len(a) for a in arrays], "<u8").tobytes(), *arrays]))


def _unpacked(data: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = (8 * n + np.cumsum(np.frombuffer(raw[: 8 * n], "<u8"))).tolist()
    return [raw[a:b] for a, b in zip([8 * n, *ends], ends, strict=False)]


def _joined(words: list[bytes]) -> tuple[bytes, bytes]:
    """Lengths and bytes of several values."""
    return np.array([len(w) for w in words], "<u4").tobytes(), b"".join(words)


def _parted(sizes: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class _Codes(dict):
    """Numbers of words, given in order of their first look-up."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


def _cut(path: str, pattern: str, slices: int):
    """One row for each block: its name, its rows' ids, its texts as codes of its distinct words, and those words that
    aren't entries of the vocabulary, by slice. More frequent words have smaller codes. slots has a number for each code:
    the token of an entry, or -1 - k for the k-th word of all slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path, pattern)
        for block, parts in _numbered(batches):
            table = pa.Table.from_batches(parts).select(["doc_id", "text"])
            codes, sizes, found = _Codes(), [], []
            for text in table.column("text").to_pylist():
                own = [np.fromiter(map(codes.__getitem__, words), np.int32, len(words)) for words in of.runs(text)]
                sizes.append(sum(map(len, own)))
                found += own
            whole = np.concatenate(found) if found else np.zeros(0, np.int32)
            order = np.argsort(-np.bincount(whole, minlength=len(codes)), kind="stable")
            place = np.empty(len(codes), np.uint32)
            place[order] = np.arange(len(codes), dtype=np.uint32)
            whole = place[whole]
            slots = np.zeros(len(codes), np.int64)
            dealt: list[list[tuple[bytes, int]]] = [[] for _ in range(slices)]
            for word, code in zip(codes, place.tolist(), strict=True):
                if (token := of.entries.get(word)) is not None:
                    slots[code] = int.from_bytes(token, "little")
                else:
                    raw = word.encode("utf-8", "surrogatepass")
                    dealt[zlib.crc32(raw) % slices].append((raw, code))
            k, words = 0, []
            for own in dealt:
                own.sort()
                slots[[code for _, code in own]] = -1 - np.arange(k, k + len(own))
                k += len(own)
                words.append(_packed(*_joined([raw for raw, _ in own])) if own else None)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.select(["doc_id"]).schema) as out:
                out.write_table(table.select(["doc_id"]))
            planes = [(whole >> np.uint32(8 * b)).astype(np.uint8).tobytes() for b in range(3 if len(codes) < 1 << 24 else 4)]
            texts = _packed(sink.getvalue().to_pybytes(), np.array(sizes, "<u8").tobytes(), slots.astype("<i8").tobytes(), *planes, *[b""] * (4 - len(planes)))
            yield pa.record_batch([pa.array([block], pa.int64()), pa.array([texts], pa.binary()), pa.array([words], pa.list_(pa.binary()))], ["block", "texts", "words"])

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, slice, words) for each slice of which a block has words."""
    for batch in batches:
        for block, words in zip(batch.column("block"), batch.column("words"), strict=True):
            block, words = block.as_py(), words.as_py()
            full = [k for k, own in enumerate(words) if own is not None]
            yield pa.record_batch([pa.array([block] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array([words[k] for k in full], pa.binary())], ["block", "slice", "words"])


def _answered(path: str, pattern: str):
    """(block, slice, codes) with the encodings of the words in their order; words of several blocks are encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path, pattern)
        known: dict[bytes, bytes] = {}
        held: list[tuple[int, int, list[bytes]]] = []

        def solve() -> pa.RecordBatch:
            new = list({w for *_, words in held for w in words if w not in known})
            known.update(zip(new, of.replay(new), strict=True))
            rows = [_packed(*_joined([known[w] for w in words])) for *_, words in held]
            out = pa.record_batch([pa.array([b for b, *_ in held], pa.int64()), pa.array([k for _, k, _ in held], pa.int32()), pa.array(rows, pa.binary())], ["block", "slice", "codes"])
            held.clear()
            if len(known) > SLICE:
                known.clear()
            return out

        size = 0
        for batch in batches:
            for block, k, words in zip(*(batch.column(c).to_pylist() for c in ("block", "slice", "words")), strict=True):
                held.append((block, k, _parted(*_unpacked(words, 2))))
                size += len(held[-1][2])
                if size > SLICE:
                    yield solve()
                    size = 0
        if held:
            yield solve()

    return run


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Values one after the other in data, of which each ends where the next one starts."""
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return values.cast(pa.binary())


def _coded(path: str, pattern: str, decoded: bool):
    """Blocks with all their encodings to (doc_id, n_tokens, ids) and maybe decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path, pattern)
        spelt = pa.array(of.vocabulary, pa.binary())
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("block", "texts", "words", "codes")), strict=True):
                block, texts, words, codes = (x.as_py() for x in row)  # one block at a time, of the many that a batch may hold
                ids, sizes, slots, *planes = _unpacked(texts, 7)
                doc_ids = pa.ipc.open_stream(ids).read_all().column("doc_id").combine_chunks()
                slots = np.frombuffer(slots, "<i8")
                whole = sum(np.frombuffer(p, np.uint8).astype(np.int64) << 8 * b for b, p in enumerate(planes) if p or not b)
                # a pool of tokens: the entries' own, then the encodings of the other words, slice by slice
                parts = [_unpacked(x["codes"], 2) for x in sorted(codes or (), key=lambda x: x["slice"])]
                lengths = np.concatenate([np.frombuffer(a, "<u4") for a, _ in parts]).astype(np.int64) // 4 if parts else np.zeros(0, np.int64)
                if [x["slice"] for x in sorted(codes or (), key=lambda x: x["slice"])] != [k for k, x in enumerate(words) if x is not None] or len(lengths) != (slots < 0).sum():
                    raise RuntimeError(f"block {block} was read with other rows before: its encodings don't fit its words")
                pool = np.concatenate([np.where(slots < 0, 0, slots), *(np.frombuffer(b, "<u4").astype(np.int64) for _, b in parts)])
                starts = len(slots) + np.cumsum(lengths) - lengths
                k = np.maximum(-1 - slots, 0)
                start = np.where(slots < 0, np.append(starts, 0)[k], np.arange(len(slots)))
                length = np.where(slots < 0, np.append(lengths, 0)[k], 1)
                ends = np.cumsum(np.frombuffer(sizes, "<u8").astype(np.int64))
                at, total = 0, len(ends)
                before = 0
                while at < total:
                    stop = max(at + 1, int(np.searchsorted(ends, before + PART, "right")))
                    own = whole[before : ends[stop - 1]]
                    n = length[own]
                    tokens = np.append(0, np.cumsum(n))
                    out = pool[np.repeat(start[own] - tokens[:-1], n) + np.arange(tokens[-1])].astype("<u4")
                    cut = tokens[ends[at:stop] - before]
                    columns = [doc_ids.slice(at, stop - at), pa.array(np.diff(cut, prepend=0), pa.int64()), _binaries(out, 4 * cut)]
                    if decoded:
                        text = spelt.take(pa.array(out))
                        bytes_, upto = flat(text)
                        columns.append(_binaries(bytes_, upto[cut]))
                    yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])
                    at, before = stop, int(ends[stop - 1])

    return run


_CODED = "doc_id bigint, n_tokens bigint, ids binary"


def _encoded(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    docs = id_and_text(docs, id_col, text_col)
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = docs.mapInArrow(_cut(path, pattern, slices), "block bigint, texts binary, words array<binary>")
    cut = cut.repartition(slices, "block")  # few blocks a task; both uses read all its columns, so Spark runs it once
    asked = cut.mapInArrow(_asked, "block bigint, slice int, words binary").repartitionById(slices, F.col("slice"))
    answers = asked.mapInArrow(_answered(path, pattern), "block bigint, slice int, codes binary")
    codes = answers.groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct("slice", "codes")).alias("codes"))  # of a block's distinct words
    joined = cut.join(codes, F.col("block") == F.col("of"), "left").select("block", "texts", "words", "codes")
    return joined.mapInArrow(_coded(path, pattern, decoded), _CODED + ", decoded binary" * decoded)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens bigint, ids binary): token ids of each text as little-endian unsigned 32-bit integers.

    path is a rank file that every executor can open at the same place (it comes with an installed package)."""
    return _encoded(docs, path, pattern, id_col, text_col, False)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of encode() with decoded binary, the bytes of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path, pattern)
        for part in blocks(batches, "ids", PART):
            texts = [of.decode(np.frombuffer(x or b"", "<u4")) for x in part.column("ids").to_pylist()]
            yield pa.record_batch([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, _CODED + ", decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)), decoded in the step that puts the ids together."""
    return _encoded(docs, path, pattern, id_col, text_col, True)
