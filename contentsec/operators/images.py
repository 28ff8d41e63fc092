"""Steganography: messages in pixels, metadata and text chunks of images.

Features come from one Arrow step for each image; all judgements on them are native.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentsec import patterns
from contentsec.config import Config
from contentsec.functions import text as T
from contentsec.functions.binary import images
from contentsec.operators.signals import INJECTION, joined, signal, some

DETECTOR = "steganography"
#: Chi-square at one degree of freedom for p = 0.05 and 0.10.
CHI_05, CHI_10, ENTROPY = 3.8415, 2.7055, 7.9


def _signal(name: str, confidence: float | Column, evidence: Column, raw: Column | None = None) -> Column:
    return signal(INJECTION, name, confidence, evidence, DETECTOR, raw)


def _hit(text: Column) -> Column:
    return T.first_match(text, patterns.IMAGE_KEYWORDS)


def lsb(features: Column) -> Column:
    most = F.array_max(features["chi_square"])
    hidden = _hit(features["message"])
    confidence = F.when(hidden.isNotNull(), 0.95).when(most > CHI_05, 0.80).when(most > CHI_10, 0.60)
    return some(F.when(confidence.isNotNull(), _signal("lsb_steganography", confidence, F.coalesce(hidden, F.concat(F.lit("chi-square "), F.round(most, 2))), features["message"])))


def entropy(features: Column) -> Column:
    most = F.array_max(features["entropy"])
    return some(F.when(most > ENTROPY, _signal("statistical_anomaly", 0.50, F.concat(F.lit("entropy "), F.round(most, 3)))))


def texts(features: Column) -> Column:
    chunks = F.filter(features["texts"], lambda t: (F.length(t["text"]) > 10) & _hit(t["text"]).isNotNull())
    exif = F.filter(features["exif"], lambda t: (F.length(t["text"]) >= 50) & _hit(t["text"]).isNotNull())
    return joined(F.transform(exif, lambda t: _signal("exif_injection", 0.85, _hit(t["text"]), t["text"])), F.transform(chunks, lambda t: _signal("png_text_chunk_injection", 0.90, _hit(t["text"]), t["text"])))


def image_signals(data: Column, config: Config = Config()) -> Column:  # noqa: B008
    """Signals of an image's bytes; none for images below or above the size limits."""
    least, most = config.image_bytes
    features = images(F.when(F.length(data).between(least, most), data))
    return F.when(features.isNotNull(), joined(F.when(features["status"] == "ok", lsb(features)), texts(features), F.when(features["status"] == "ok", entropy(features))))
