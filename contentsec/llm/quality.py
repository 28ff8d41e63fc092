"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a sequence of tokens: runs of letters, digits, signs and line ends. Its terms are the tokens in lower case,
hashed to WORDS columns, pairs of neighbouring tokens' shapes (kind and capitals of a word, sign and length of a run of
signs), hashed to PAIRS columns, and one for words that repeat the word before; with log counts and inverse document
frequencies. A singular value decomposition of the labelled sample gives the latent space. The labelled vectors are
broadcast, every document's cosines to all of them are computed in blocks, and its NEIGHBOURS nearest vote for their
labels, weighted by similarity and by what share of its label's ids the sample holds.

The model is fitted on at most SAMPLE ids of each label and one text of each id, the least where an id has several, so
what reaches the driver is bounded, and what is broadcast is below 2 * SAMPLE * RANK + TERMS * RANK numbers (3 MB),
whatever the tables and however often an id repeats. Labels other than 0 and 1 and rows with a null id teach nothing; an
id with both labels has the larger. Without labelled rows every score is 0.5. Texts are scored whole; null counts as
empty, and an empty text has the zero vector, whose score is the share of label 1. Rows are independent: repeated rows
get equal scores, ties of similarity are broken by the sample's order, which is by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentsec.llm.common import blocks, flat, id_and_text, materialize, mix64, random_table
from contentsec.llm.sampling import bounded, remainder

WORDS, PAIRS, RANK, SAMPLE, NEIGHBOURS, POWER = 8192, 1024, 48, 1000, 15, 4
TERMS = WORDS + PAIRS + 1


def _kinds() -> np.ndarray:
    """1 letter, 2 digit, 3 line end, 4 sign, 0 white space."""
    kind = np.zeros(256, np.uint8)
    kind[33:127] = 4
    kind[97:123] = kind[65:91] = kind[128:] = 1
    kind[48:58], kind[10], kind[13] = 2, 3, 3
    return kind


_KIND = _kinds()
_BYTE = random_table(256, 11)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_POWER = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def repeats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many words of each text equal the word before (up to the order of their bytes)."""
    inside = (data > 32).astype(np.int8)
    inside[offsets[1:-1][offsets[1:-1] < len(data)]] *= 2  # a text's first word isn't a part of the text before
    starts = np.flatnonzero((inside > 0) & ((np.concatenate(([0], inside[:-1])) == 0) | (inside == 2)))
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.int64)
    word = np.add.reduceat(np.where(inside > 0, _BYTE[data], np.uint64(0)), starts)
    of = np.searchsorted(offsets, starts, "right") - 1
    same = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    return np.bincount(of[1:][same], minlength=len(offsets) - 1)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log counts of each text's terms, one row for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    kind = _KIND[data]
    if not kind.any():
        return out
    fresh = np.ones(len(data), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(data)]] = True
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(data)))
    place = np.arange(len(data)) - np.repeat(first, size)
    name = np.add.reduceat(_LOWER[data] * _POWER[place & 63], first)
    capitals = np.add.reduceat(((data >= 65) & (data <= 90)).astype(np.int32), first)
    kept = kind[first] > 0
    first, size, name, capitals = first[kept], size[kept], name[kept], capitals[kept]
    kind, of = kind[first], np.searchsorted(offsets, first, "right") - 1
    word = (mix64(name) >> np.uint64(32)).astype(np.int64) % WORDS
    case = np.where(capitals == 0, 0, np.where((capitals > 1) & (capitals == size), 1, 2))
    shape = np.where(kind == 1, case, np.where(kind == 4, 8 + data[first].astype(np.int64) + 256 * np.minimum(size - 1, 2), 2 + kind)).astype(np.uint64)
    same = of[1:] == of[:-1]
    pair = (mix64(shape[:-1] * np.uint64(1009) + shape[1:]) >> np.uint64(32)).astype(np.int64) % PAIRS
    at = np.concatenate([of * TERMS + word, of[1:][same] * TERMS + WORDS + pair[same]])
    out += np.bincount(at, minlength=n * TERMS).reshape(n, TERMS)
    out[:, -1] = repeats(data, offsets)
    return np.log1p(out, out=out)


class Model:
    """idf and axes of the latent space, unit vectors of the sample, their labels and weights."""

    def __init__(self, logs: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """logs is changed."""
        seen = (logs > 0).sum(axis=0)
        self.idf = np.log((1 + len(logs)) / (1 + seen)).astype(np.float32) + 1
        x = logs
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        value, vector = np.linalg.eigh((x @ x.T).astype(np.float64))
        top = np.argsort(-value)[:RANK]
        top = top[value[top] > 1e-6]
        self.axes = (x.T @ (vector[:, top] / np.sqrt(value[top]))).astype(np.float32)
        self.known = self._unit(x @ self.axes)
        self.labels, self.weights = labels.astype(np.float32), weights.astype(np.float32)
        self.share = float((labels * weights).sum() / max(weights.sum(), 1e-12))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, logs: np.ndarray) -> np.ndarray:
        cosine = self._unit((logs * self.idf) @ self.axes) @ self.known.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** POWER * self.weights[near]
        total = vote.sum(axis=1)
        return np.where(total > 0, (vote * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-30), self.share)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> Model | None:
    """A model from a bounded sample of the labelled documents whose remainder of 3 isn't 1; None without any."""
    known = labels.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label).cast("int").alias("_label")).filter(F.col("_label").isin(0, 1) & F.col("_id").isNotNull()).filter(remainder("_id", 3) != 1)
    known = known.groupBy("_id").agg(F.max("_label").alias("_label"))
    known = materialize(known, "known")
    sizes = dict(known.groupBy("_label").count().collect())
    chosen = F.broadcast(materialize(bounded(known, "_label", most, "_id").select("_id", "_label"), "sample"))  # 2 * most rows at the most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, limit=2 << 20):
            for i in range(0, part.num_rows, 512):
                rows = part.slice(i, 512)
                logs = counts(*flat(rows.column("text")))
                full = [np.flatnonzero(x) for x in logs]
                yield pa.record_batch([rows.column("_id"), rows.column("_label"), pa.array([k.astype(np.uint16).tobytes() for k in full], pa.binary()), pa.array([x[k].tobytes() for k, x in zip(full, logs, strict=True)], pa.binary())], ["_id", "_label", "at", "logs"])

    rows = id_and_text(docs, id_col, text_col).join(chosen, F.col("doc_id") == F.col("_id")).groupBy("_id", "_label").agg(F.min("text").alias("text"))
    got = sorted(map(tuple, rows.mapInArrow(run, "_id bigint, _label int, at binary, logs binary").collect()))
    if not got:
        return None
    y = np.array([r[1] for r in got])
    weights = np.array([sizes.get(int(k), 1) / (y == k).sum() for k in y])
    logs = np.zeros((len(got), TERMS), np.float32)
    for row, (_, _, at, values) in zip(logs, got, strict=True):
        row[np.frombuffer(at, np.uint16)] = np.frombuffer(values, np.float32)
    return Model(logs, y, weights / weights.mean())


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted), one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for part in blocks(batches, limit=2 << 20):
            for i in range(0, part.num_rows, 512):
                rows = part.slice(i, 512)
                found = of.scores(counts(*flat(rows.column("text")))) if of else np.full(rows.num_rows, 0.5)
                found = np.clip(found.astype(np.float64), 0, 1)
                yield pa.record_batch([rows.column("doc_id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs."""
    return score(docs, fit(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier doesn't reject, whole; scored in place, so nothing is joined back."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.value
        for part in blocks(batches, text_col, 2 << 20):
            for i in range(0, part.num_rows, 512):
                rows = part.slice(i, 512)
                found = of.scores(counts(*flat(rows.column(at)))) if of else np.full(rows.num_rows, 0.5)
                yield rows.filter(pa.array(found >= 0.5))

    return docs.mapInArrow(run, docs.schema)
