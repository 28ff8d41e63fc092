"""Exact duplicates by content-defined chunk recipes.

Each normalised text is cut where a rolling hash of its last bytes has a fixed pattern, so equal texts have equal cuts.
A chunk is named by a 64-bit key; its 128-bit digest verifies the name: where one key has several digests, each digest
gets an identifier of its own. The ordered list of identifiers is the text's recipe, and texts are equal when their
recipes are. Only recipes move between tasks, about 1 % of the text; the text itself never does.

Equal texts are counted by partial aggregation. The groups of two or more are written out and joined back, so that
Spark measures them: it broadcasts them below its own threshold, and otherwise splits a hot group while joining.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentsec.llm.common import blocks, flat, id_and_text, materialize, random_table

#: Bytes of the rolling window, mean chunk (a power of two) and longest chunk.
WINDOW, MEAN, LONGEST = 16, 1 << 11, 1 << 14
_GEAR = random_table(256, 3)


def cuts(data: np.ndarray) -> np.ndarray:
    """True behind which byte a chunk may end: a hash of the last WINDOW bytes has its top bits zero."""
    h = _GEAR[data]
    width, factor = 1, 0x9E3779B97F4A7C15
    while width < WINDOW:  # h[i] covers the last `width` bytes; bytes before the start count as absent
        wider = h.copy()
        wider[width:] += h[:-width] * np.uint64(factor)
        h, width, factor = wider, 2 * width, factor * factor % 2**64
    return h >> np.uint64(64 - MEAN.bit_length() + 1) == 0


def bounds(data: np.ndarray) -> list[int]:
    """Ends of a text's chunks, the last of which is its length."""
    n, last, ends = len(data), 0, []
    for end in (np.flatnonzero(cuts(data)) + 1).tolist() if n > WINDOW else []:
        while end - last > LONGEST:
            last += LONGEST
            ends.append(last)
        last = end
        ends.append(last)
    while n - last > LONGEST:
        last += LONGEST
        ends.append(last)
    return ends if last == n else [*ends, n]


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """(doc_id, n_bytes, text_sha256, keys array<bigint>, digests binary): each text's chunks in order.

    key_bits below 64 makes keys collide, which tests use."""
    mask = (1 << key_bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            data, offsets = flat(part.column("text"))
            upper = (data >= 65) & (data <= 90)
            data = data | (upper.view(np.uint8) << 5)
            keys, sizes, digests, sums = [], [0], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = data[a:b]
                view, last, named = memoryview(own), 0, []
                for end in bounds(own):
                    keys.append(xxhash.xxh3_64_intdigest(view[last:end]) & mask)
                    named.append(xxhash.xxh3_128_digest(view[last:end], seed=0x5DEECE66D))
                    last = end
                sizes.append(len(keys))
                digests.append(b"".join(named))
                sums.append(hashlib.sha256(view).hexdigest())
            names = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.array(keys, np.uint64).view(np.int64), pa.int64()))
            yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.string()), names, pa.array(digests, pa.binary())], ["doc_id", "n_bytes", "text_sha256", "keys", "digests"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_bytes bigint, text_sha256 string, keys array<bigint>, digests binary")


def verified(made: DataFrame) -> DataFrame:
    """The recipes with ids array<string or bigint>, the chunks' verified identifiers, instead of keys and digests.

    An identifier is the key, unless the key has several digests; then those chunks are named by key and digest. Few
    keys collide (hundreds in 10^11 chunks), so recipes are rebuilt only if a look at the chunk table finds any."""
    chunks = made.filter(F.size("keys") > 0).select(F.explode(F.arrays_zip("keys", F.transform(F.sequence(F.lit(0), F.size("keys") - 1), lambda i: F.substring(F.col("digests"), i * 16 + 1, F.lit(16))).alias("d"))).alias("c")).select(F.col("c.keys").alias("key"), F.col("c.d").alias("digest"))
    clash = materialize(chunks.groupBy("key").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("key"), "chunk-clashes")
    plain = made.select("doc_id", "n_bytes", "text_sha256", F.transform("keys", lambda k: k.cast("string")).alias("ids"))
    if clash.isEmpty():
        return plain
    hit = made.select("*", F.posexplode("keys").alias("seq", "key")).join(clash.withColumn("hit", F.lit(True)), "key", "left")
    row = ["doc_id", "n_bytes", "text_sha256"]
    named = F.concat_ws(":", F.col("key").cast("string"), F.when(F.col("hit"), F.hex(F.expr("substring(digests, seq * 16 + 1, 16)"))))
    whole = hit.select(*row, "seq", named.alias("id"), F.xxhash64("keys", "digests").alias("recipe")).distinct().groupBy(*row, "recipe").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias("ids"))
    copies = made.withColumn("recipe", F.xxhash64("keys", "digests")).groupBy(*row, "recipe").count()
    back = copies.join(whole.withColumn("same", F.struct(*row, "recipe")).select("same", "ids"), F.struct(*row, "recipe").eqNullSafe(F.col("same")), "left")
    return back.select(*row, F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy")).drop("copy")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty, and all empty texts are one
    group. The largest doc_id of a group stays; rows with that same id and equal text all count in group_size and only
    share keep_id, so kept is true for each of them. A null doc_id is smaller than any other; a group of only null ids
    has a null keep_id and keeps its rows. An empty table gives no rows."""
    made = materialize(recipes(docs, id_col, text_col, key_bits), "recipes")
    rows = verified(made).select("doc_id", "text_sha256", "n_bytes", "ids")
    groups = rows.groupBy("ids", "n_bytes").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")).filter("group_size > 1")
    groups = materialize(groups, "copies")
    joined = rows.join(groups, ["ids", "n_bytes"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


#: Dropped rows up to which their table (about 100 bytes a row in memory) is sent to every executor.
SENT = 500_000


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, whole and with all their columns: of equal texts that of the largest doc_id (of
    repeated rows with that id, each stays; identical whole rows are the caller's to drop).

    Each text is recognised in place by its id and digest. The dropped rows are counted: up to SENT of them are sent to
    every executor, so that no text moves at all; beyond, Spark joins them as their size demands."""
    gone = exact_groups(docs, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("_gone_id"), F.unhex("text_sha256").alias("_gone_sha")).distinct()
    gone = materialize(gone, "dropped")
    key = F.unhex(F.sha2(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256))
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("_gone_id")) & (key == F.col("_gone_sha"))
    return docs.join(F.broadcast(gone) if gone.count() <= SENT else gone, same, "left_anti")
