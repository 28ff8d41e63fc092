"""Language identification of mixtures.

Rolling byte 3-grams of the lower-cased text (signs and digits as spaces) have a smoothed probability in each language.
A text is cut into units of UNIT grams; expectation-maximisation estimates the proportions of the languages from the
units' likelihoods. The languages are then ranked by proportion, and the smallest set whose penalised likelihood
(minus PENALTY times the logarithm of the units for each language) is best gives the document's languages and final
proportions. The language with the greatest proportion is the prediction, its proportion the score.

Models are counted on at most SAMPLE ids of each language, over all rows that have them; an id counts once however many
rows it has. What is collected and broadcast is at most GRAMS numbers for each language, and there may be at most LANGS
languages, more of which raise an error: such labels name no languages. A text's set may grow to all of them. Null texts
and texts without a letter are `und` with score 0. Texts are read whole; rows are independent, so repeated rows and ties
need no care (of equal proportions the language first in code point order wins). Without any learned language every text
is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentsec.llm.common import blocks, flat, id_and_text, materialize
from contentsec.llm.sampling import bounded, remainder

GRAMS, UNIT, SAMPLE, ROUNDS, PENALTY = 1 << 16, 64, 1000, 12, 2.0
#: Languages that may be learned: 128 MB of numbers.
LANGS = 512


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint32)
    kind[97:123] = kind[65:91] = np.arange(1, 27)
    kind[128:] = np.arange(27, 155)
    return kind


_KIND = _classes()


def grams(data: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """A number below GRAMS for the gram that starts at each byte of texts that end before `ends` (else of one text); the
    last two of a text look at absent spaces."""
    kind = np.concatenate([_KIND[data], np.zeros(2, np.uint32)])
    second, third = kind[1:-1].copy(), kind[2:].copy()
    for back, column in ((1, second), (1, third), (2, third)):
        at = (np.array([len(data)]) if ends is None else ends) - back
        column[at[at >= 0]] = 0
    return (kind[:-2] * np.uint32(0x9E3779B1) + second * np.uint32(0x85EBCA77) + third * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(16)


def has_letter(text: np.ndarray) -> bool:
    kind = _KIND[text]
    if ((kind > 0) & (kind < 27)).any():
        return True
    return bool((kind >= 27).any()) and any(map(str.isalpha, text.tobytes().decode("utf-8", "replace")))


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs = langs
        total = counts.sum(axis=0, keepdims=True)
        prior = (total + 0.5) / (total.sum() + 0.5 * GRAMS)
        rate = (counts + 64 * GRAMS * prior / GRAMS) / (counts.sum(axis=1, keepdims=True) + 64)
        self.logs = np.ascontiguousarray(np.log(np.maximum(rate, 1e-9)).T.astype(np.float32))  # gram x language

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods of each unit, and the number of units before each text."""
        sizes = np.diff(offsets)
        per = -(-sizes // UNIT)
        before = np.concatenate(([0], np.cumsum(per)))
        starts = np.repeat(offsets[:-1], per) + (np.arange(before[-1]) - np.repeat(before[:-1], per)) * UNIT
        found = np.zeros((len(starts), len(self.langs)))
        gram, step = grams(data, offsets[1:]), 1 << 14
        for i in range(0, len(starts), step):
            a = starts[i]
            b = starts[i + step] if i + step < len(starts) else len(data)
            found[i : i + step] = np.add.reduceat(self.logs[gram[a:b]], starts[i : i + step] - a, axis=0)
        return found, before

    def mixtures(self, likely: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Proportions (text x language) of texts with a unit at least."""
        n, width = len(before) - 1, len(self.langs)
        of = np.repeat(np.arange(n), np.diff(before))
        top = likely.max(axis=1, keepdims=True)
        p = np.exp(likely - top)
        units = np.diff(before)[:, None]

        def fitted(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            share = mask / mask.sum(axis=1, keepdims=True)
            for _ in range(ROUNDS):
                w = p * share[of]
                w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
                share = np.add.reduceat(w, before[:-1], axis=0) / units
            value = np.log(np.maximum((p * share[of]).sum(axis=1), 1e-300)) + top[:, 0]
            return share, np.add.reduceat(value, before[:-1])

        share, _ = fitted(np.ones((n, width)))
        place = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
        best, most = np.zeros((n, width)), np.full(n, -np.inf)
        for k in range(1, width + 1):
            found, value = fitted((place < k).astype(float))
            value = value - PENALTY * k * np.log(units[:, 0] + 1)
            better = value > most
            best[better], most = found[better], np.maximum(most, value)
        return best


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE) -> Model | None:
    """A model from a bounded sample for each language, of documents whose remainder of 4 isn't 2."""
    known = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(lang_col).cast("string").alias("_lang")).filter("_id is not null and _lang is not null").filter(remainder("_id", 4) != 2)
    sample = materialize(bounded(known, "_lang", most, "_id").select("_id", "_lang"), "sample")
    found = sample.select("_lang").distinct().limit(LANGS + 1).count()
    if not found:
        return None
    if found > LANGS:
        raise ValueError(f"there are over {LANGS} different languages")
    sample = F.broadcast(sample)  # most ids of each of LANGS languages, at the most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in blocks(batches):
            langs = part.column("_lang").to_pylist()
            for i, lang in enumerate(langs):
                text, _ = flat(part.column("text").slice(i, 1))
                sums[lang] = sums.get(lang, 0) + np.bincount(grams(text), minlength=GRAMS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "gram", "n"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.join(sample, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("_lang", "text")
    table = rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    if not langs:
        return None
    counts = np.zeros((len(langs), GRAMS))
    at = {x: i for i, x in enumerate(langs)}
    np.add.at(counts, ([at[x] for x in table.column("lang").to_pylist()], table.column("gram").to_numpy()), table.column("n").to_numpy())
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, mixture), one row for each row of docs; mixture is `de:0.75,en:0.25`, largest first."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for part in blocks(batches, limit=1 << 20):
            data, offsets = flat(part.column("text"))
            n = part.num_rows
            pred, value, mix = ["und"] * n, np.zeros(n), [""] * n
            whole = [i for i in range(n) if of and has_letter(data[offsets[i] : offsets[i + 1]])]
            if whole:
                likely, before = of.units(data, offsets)
                kept = np.concatenate([np.arange(before[i], before[i + 1]) for i in whole])
                share = of.mixtures(likely[kept], np.concatenate(([0], np.cumsum(np.diff(before)[whole]))))
                first = share.argmax(axis=1)
                for i, k, row in zip(whole, first.tolist(), share, strict=True):
                    pred[i], value[i] = of.langs[k], min(1.0, row[k])
                    mix[i] = ",".join(f"{of.langs[j]}:{row[j]:.3f}" for j in np.argsort(-row, kind="stable") if row[j] > 0.0005)
            yield pa.record_batch([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(value), pa.array(mix, pa.string())], ["doc_id", "lang_pred", "score", "mixture"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, lang_pred string, score double, mixture string")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, mixture), one row for each row of docs."""
    found = predict(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "mixture")
