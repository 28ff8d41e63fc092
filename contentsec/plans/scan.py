"""Scans end to end: content to signals to score to verdict, inside each row and so without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentsec.config import Config
from contentsec.functions import html as H
from contentsec.functions import text as T
from contentsec.functions.batches import in_parts
from contentsec.operators import documents, images, injection, semantic, trust
from contentsec.operators.signals import joined


def reported(df: DataFrame, config: Config = Config(), asymmetry: Column | None = None) -> DataFrame:  # noqa: B008
    """df(signals, ...) with composite_score, trust_tier, action_taken and blocked."""
    rows = df.withColumn("composite_score", trust.score_array(F.col("signals"), config, asymmetry))
    rows = rows.withColumn("trust_tier", trust.tier(F.col("composite_score"), config))
    return rows.withColumn("action_taken", trust.action(F.col("trust_tier"))).withColumn("blocked", F.col("trust_tier").isin("RED", "QUARANTINE"))


def _responses(rows: DataFrame, content: Column, only_yellow: bool) -> DataFrame:
    """With content (null if blocked), block_reason and warnings, the signals of over 0.6."""
    strong = F.transform(F.filter("signals", lambda s: s["confidence"] > 0.6), lambda s: F.concat(s["signal_name"], F.lit(": "), s["evidence"]))
    warns = F.when(F.col("trust_tier") == "YELLOW" if only_yellow else ~F.col("blocked"), strong).otherwise(F.array().cast("array<string>"))
    return rows.select("*", F.when(~F.col("blocked"), content).alias("content"), F.when(F.col("blocked"), F.concat(F.lit("Content blocked: trust tier "), F.col("trust_tier"))).alias("block_reason"), warns.alias("warnings"))


def _prepared(df: DataFrame, text: str, config: Config) -> DataFrame:
    """df with _body, the text of which nothing is cut (null is empty), and _low, in which the guards search."""
    rows = df.withColumn("_body", F.coalesce(F.col(text), F.lit("")))
    return rows.withColumn("_low", T.folded(F.col("_body")))


def scan_text(df: DataFrame, config: Config = Config(), text: str = "body", compatibility: bool = True) -> DataFrame:  # noqa: B008
    """Plain text (tool results too), which the injection detectors take for markup as well.

    df may have a column model with an outside classifier's verdicts (see semantic.scored). Texts over the length limit
    are refused whole: no signals, trust tier null, blocked, with a reason. Only texts with markup are parsed."""
    body, low = F.col("_body"), F.col("_low")
    long = F.length("_body") > config.content_length
    rows = _prepared(df, text, config).withColumn("_long", long).withColumn("_body", F.when(F.col("_long"), "").otherwise(body))
    rows = rows.withColumn("_page", H.parse(F.when(body.contains("<"), body)))
    model = F.col("model") if "model" in df.columns else None
    rows = rows.withColumn("signals", joined(injection.page_signals(body, F.col("_page"), compatibility, low), semantic.text_signals(body, low, model)))
    return _too_long(_responses(reported(rows, config), body, False), config)


def _too_long(rows: DataFrame, config: Config) -> DataFrame:
    """Refused rows: blocked, without a tier, score or content."""
    long = F.col("_long")
    keep = lambda c: F.when(~long, F.col(c)).alias(c)
    change = {"composite_score": keep("composite_score"), "trust_tier": keep("trust_tier"), "action_taken": F.when(long, "BLOCK").otherwise(F.col("action_taken")).alias("action_taken"), "blocked": (F.col("blocked") | long).alias("blocked"), "content": keep("content")}
    reason = F.when(long, F.lit(f"Content refused: over {config.content_length} characters")).otherwise(F.col("block_reason"))
    return rows.select(*(change.get(c, reason.alias(c) if c == "block_reason" else F.col(c)) for c in rows.columns if c not in ("_body", "_low", "_long", "_page")))


def scan_text_native(df: DataFrame, config: Config = Config(), text: str = "body") -> DataFrame:  # noqa: B008
    """The detectors that run on raw text, in native expressions only: one stage without Python. What stands in lambdas is
    interpreted, not compiled; the text searches, which take the time, are the same in both."""
    rows = _prepared(df, text, config)
    body, low = F.col("_body"), F.col("_low")
    return reported(rows.withColumn("signals", joined(injection.text_signals(body), semantic.text_signals(body, low))).drop("_body", "_low"), config)


def scan_pages(df: DataFrame, config: Config = Config(), html: str = "html", compatibility: bool = True) -> DataFrame:  # noqa: B008
    """Pages: df(url, html, and maybe asymmetry_score, asymmetry_detected). Too long URLs are refused, not scanned; pages
    over the length limit are refused like texts."""
    body = F.col("_body")
    long = F.length("_body") > config.content_length
    rows = _prepared(df.filter(F.length("url") <= config.url_length), html, config).withColumn("_long", long).withColumn("_body", F.when(F.col("_long"), "").otherwise(body))
    rows = rows.withColumn("_page", H.parse_composed(body) if compatibility else H.parse(body))
    composed = F.col("_page.composed") if compatibility else None
    rows = rows.withColumn("signals", joined(injection.page_signals(body, F.col("_page"), compatibility, F.col("_low"), composed), semantic.text_signals(F.col("_page.visible_text"))))
    asymmetry = F.when(F.col("asymmetry_detected"), F.col("asymmetry_score")) if "asymmetry_score" in df.columns else None
    return _too_long(_responses(reported(rows, config, asymmetry), F.col("_page.sanitized"), True), config)


def refused(df: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Pages whose URL is too long to be scanned."""
    return df.filter(F.coalesce(F.length("url") > config.url_length, F.lit(False)))


def scan_documents(df: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Files: df(data binary, filename, and maybe refused, the reason why a file was not read). Their bytes are also read
    as text for the semantic detectors. cut counts pages and streams that the limits left out."""
    text = F.replace(F.make_valid_utf8(F.col("data").cast("string")), F.lit("�"), F.lit(""))
    rows = df.withColumn("_text", text)
    unread = documents.unread(F.col("refused")) if "refused" in df.columns else documents.unread(F.lit(None).cast("string"))
    rows = rows.withColumn("signals", joined(unread, documents.document_signals(F.col("data"), F.col("filename"), config), semantic.text_signals(F.col("_text"))))
    rows = rows.withColumn("cut", documents.cut(F.col("data"), config))
    return _responses(reported(rows, config), F.col("_text"), False).drop("_text")


def scan_images(df: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Images: df(data binary)."""
    return reported(df.withColumn("signals", joined(images.image_signals(F.col("data"), config))), config)


def page_images(df: DataFrame, config: Config = Config(), html: str = "html") -> DataFrame:  # noqa: B008
    """(url, image): the addresses of each page's first images, relative ones resolved."""
    @F.arrow_udf("string")
    def absolute(pair: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from urllib.parse import urljoin

        yield from in_parts(pair, lambda base, path: [urljoin(b or "", p) for b, p in zip(base, path, strict=True)], pa.string())

    rows = df.select("url", H.parse(F.col(html), "images").alias("p")).select("url", F.explode(F.slice("p.images", 1, config.images_per_page)).alias("path"))
    return rows.select("url", absolute("url", "path").alias("image"))
