"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are split into parts of correlated bits, so that parts are nearly independent of each other. Parts get
unequal thresholds t (-1: not probed) with sum(t + 1) = 3: any two fingerprints that differ in 2 bits or fewer then
agree within its threshold on one part at least. A dynamic programme picks the thresholds, and the number of parts,
from candidate counts that are estimated from all fingerprints. Fingerprints are probed by part and verified.

Work is on distinct fingerprints. Within a bucket the verified links are reduced to a spanning forest, never listed as
all pairs. A bucket of over BUCKET fingerprints goes another exact way that is linear whatever the data: two
fingerprints differ in 2 bits or fewer exactly if some value is within 1 bit of both, so each of them is grouped under
its 65 values within 1 bit; such a group has 65 members at most, all linked to each other.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentsec.llm.common import blocks, id_and_text, materialize
from contentsec.llm.components import components

BITS, NEAR, SHINGLE, SEED = 64, 2, 3, 42
PARTS = (2, 3)
BUCKET = 128
_RUN = 1 << 15


def fingerprint(text: bytes) -> int:
    """Bit k is 1 if it is set in over half the XXH64 of the 3-word shingles of a text in lower case (A-Z only)."""
    words = text.lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    starts, ends, joined = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), b" ".join(words)
    of, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, len(starts), _RUN):
        h = np.array([of(joined[a:b], SEED) for a, b in zip(starts[i : i + _RUN], ends[i : i + _RUN], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, fp bigint), and text_sha256 if digests. Null and blank texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t) for t in texts], np.uint64)
            sums = [pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())] if digests else []
            yield pa.record_batch([part.column("doc_id"), pa.array(found.view(np.int64), pa.int64()), *sums], ["doc_id", "fp", "text_sha256"][: 2 + digests])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, fp bigint" + ", text_sha256 string" * digests)


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints, and in how many of them bits i and j are both set; 4096 sums, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            bits = np.unpackbits(batch.column("fp").to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            sums += bits.T @ bits
            n += len(bits)
        yield pa.record_batch([pa.array(range(BITS * BITS + 1), pa.int32()), pa.array([*sums.ravel().astype(np.int64).tolist(), n], pa.int64())], ["k", "n"])

    got = dict(prints.select("fp").mapInArrow(run, "k int, n bigint").groupBy("k").agg(F.sum("n")).collect())
    return got.get(BITS * BITS, 0), np.array([got.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS)


def split_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of equal size, correlated bits together, greedily."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    alike = np.abs(cov / np.outer(sd, sd))
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        rest = sorted(left)
        first = rest[int(alike[np.ix_(rest, rest)].sum(axis=1).argmax())]
        group = [first]
        left.discard(first)
        while len(group) < size:
            rest = sorted(left)
            best = rest[int(alike[np.ix_(rest, group)].sum(axis=1).argmax())]
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def within(p: np.ndarray, bits: list[int], most: int) -> list[float]:
    """The share of pairs that differ in at most 0..most of the bits, were the bits independent."""
    dist = np.zeros(most + 1)
    dist[0] = 1
    for b in bits:
        d = 2 * p[b] * (1 - p[b])
        dist = dist * (1 - d) + np.concatenate(([0], dist[:-1])) * d
    return np.cumsum(dist).tolist()


def allocate(costs: list[list[float]], total: int = NEAR + 1) -> tuple[float, list[int]]:
    """Thresholds t of least cost with sum(t + 1) = total; costs[i][t + 1] is that of part i."""
    best: list[tuple[float, list[int]] | None] = [(0.0, []), *[None] * total]
    for row in costs:
        best = [min((b[0] + row[u], [*b[1], u - 1]) for u in range(s + 1) if (b := best[s - u]) is not None) if any(best[s - u] is not None for u in range(s + 1)) else None for s in range(total + 1)]
    return best[total]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def choose(prints: DataFrame) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed."""
    n, both = bit_counts(prints)
    p = np.diag(both) / max(n, 1)
    splits = [split_bits(n, both, m) for m in PARTS]
    masks = [F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits)))).alias("value")) for k, bits in enumerate(itertools.chain(*splits))]
    sizes = prints.select(F.explode(F.array(*masks)).alias("x")).groupBy("x.part", "x.value").count()
    pairs = dict(sizes.groupBy("part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2)).collect())
    plans, k = [], 0
    for groups in splits:
        costs = []
        for bits in groups:
            same = within(p, bits, NEAR)
            probes = np.cumsum([1, len(bits), len(bits) * (len(bits) - 1) // 2])
            costs.append([0.0] + [float(n * probes[t] + pairs.get(k, 0) * same[t] / max(same[0], 1e-30)) for t in range(NEAR + 1)])
            k += 1
        cost, limits = allocate(costs)
        plans.append((cost, [(b, t) for b, t in zip(groups, limits, strict=True) if t >= 0]))
    return min(plans, key=lambda x: x[0])[1]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each bucket's links."""
    for batch in batches:
        a, b = [], []
        for members in batch.column("fps").to_pylist():
            x = np.array(members, np.int64)
            apart = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64))
            i, j = np.nonzero(np.triu(apart <= NEAR, 1))
            root = list(range(len(x)))
            for u, v in zip(i.tolist(), j.tolist(), strict=True):
                ru, rv = u, v
                while root[ru] != ru:
                    ru = root[ru] = root[root[ru]]
                while root[rv] != rv:
                    rv = root[rv] = root[root[rv]]
                if ru != rv:
                    root[rv] = ru
                    a.append(members[u])
                    b.append(members[v])
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(prints: DataFrame, plan: list[tuple[list[int], int]], bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints in prints(fp) that are within NEAR bits, step by step."""
    probes = []
    for k, (bits, t) in enumerate(plan):
        value = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
        for flips in itertools.chain.from_iterable(itertools.combinations(bits, u) for u in range(t + 1)):
            probes.append(F.struct(F.lit(k).alias("part"), value.bitwiseXOR(F.lit(_signed(sum(1 << b for b in flips)))).alias("value")))
    rows = prints.select("fp", F.explode(F.array(*probes)).alias("x")).select("fp", "x.part", "x.value")
    counts = materialize(rows.groupBy("part", "value").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    light = rows.join(counts.filter(F.col("n") <= bucket), ["part", "value"]).groupBy("part", "value").agg(F.collect_list("fp").alias("fps"))
    near = light.select("fps").mapInArrow(_verified, "a bigint, b bigint")
    heavy = rows.join(counts.filter(F.col("n") > bucket), ["part", "value"]).select("fp").distinct()
    ball = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(BITS)))
    group = heavy.select("fp", F.explode(ball).alias("centre")).groupBy("centre").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    star = group.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return near.union(star)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs.

    component_id is the smallest doc_id that is reachable over links of NEAR bits or fewer, itself included. Null and
    blank texts have fingerprint zero and are linked like any other. Null ids are never the smallest; a component of
    only null ids has a null component_id. Repeated rows share a fingerprint. An empty table gives no rows."""
    made = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    rows = made.join(_leasts(made, F.col("doc_id"), bucket), F.col("fp") == F.col("shared_fp"), "left")
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("shared_fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _leasts(made: DataFrame, row: Column, bucket: int) -> DataFrame:
    """(shared_fp, component_id): the least row of the component, for each fingerprint in made that several rows share
    or that is linked."""
    distinct = materialize(made.groupBy("fp").agg(F.min(row).alias("least"), F.count("*").alias("n")), "distinct")
    of = materialize(components(materialize(links(distinct, choose(distinct), bucket), "near")), "components")
    linked = distinct.join(of, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"), "node")
    smallest = materialize(linked.filter("node is not null").groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_least")), "smallest")
    return materialize(linked.filter("node is not null or n > 1").join(smallest, F.col("component") == F.col("c"), "left").select(F.col("fp").alias("shared_fp"), F.coalesce("component_least", "least").alias("component_id")), "shared")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, whole: of each component that of the smallest (doc_id, fingerprint, SHA-256 of the
    text), a null doc_id being larger than any other. Of repeated rows with that same id and text, each stays."""
    made = materialize(fingerprints(docs, id_col, text_col, digests=True), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "text_sha256")
    rows = made.join(_leasts(made, row, BUCKET), F.col("fp") == F.col("shared_fp"))
    gone = rows.filter(~row.eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_gone_sha")).distinct()
    key = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    return docs.join(materialize(gone, "gone"), F.col(id_col).cast("bigint").eqNullSafe(F.col("_gone")) & (key == F.col("_gone_sha")), "left_anti")
