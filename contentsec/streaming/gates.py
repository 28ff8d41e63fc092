"""Streams: message verification, memory writes, action gates and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from contentsec.config import Config
from contentsec.operators import actions, exfiltration, memory, messages


def verified(stream: DataFrame, now: Column, late: str = "10 minutes", config: Config = Config()) -> DataFrame:  # noqa: B008
    """Messages with a right signature that haven't expired, each nonce once; state is dropped behind the watermark."""
    right = F.col("signature") == messages.hmac_sha256(messages.canonical(), config.secret)
    alive = F.col("expires_at").isNull() | (now <= F.col("expires_at"))
    return stream.filter(right & alive).withWatermark("ts", late).dropDuplicatesWithinWatermark(["nonce"])


def gated(stream: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Actions with allowed and reason; stateless."""
    return actions.validate(stream, config)


def outbound(stream: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Requests (url, body, maybe headers) with safe and violations; stateless, so it stands before any sink."""
    return exfiltration.check(stream, config)


def split(good: Callable[[DataFrame, int], None], bad: Callable[[DataFrame, int], None], by: str = "allowed") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows for which `by` holds (allowed actions, safe requests) to one sink, the others to another."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        good(batch.filter(F.col(by)), epoch)
        bad(batch.filter(~F.coalesce(F.col(by), F.lit(False))), epoch)
        batch.unpersist()

    return run


_ENTRY = "key string, seq bigint, value string, effective_trust double, violation boolean"


def remembered(stream: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Memory writes (seq, ts, key, value, trust, chain) that are stored, each with whether it conflicts with what its
    key held; the state of a key is its last stored value and trust."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, trust = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for row in rows.itertuples():
            bad = False
            if value is not None and trust >= memory.PROTECTED:
                a, b = value, row.value or ""
                most = max(len(a), len(b))
                bad = most > 0 and (min(len(a), len(b)) / most < 0.5 or sum(x == y for x, y in zip(a, b, strict=False)) / most < 0.5)
            value, trust = row.value or "", row.effective_trust
            out.append((key[0], row.seq, row.value, row.effective_trust, bad))
        state.update((value, trust))
        yield pd.DataFrame(out, columns=["key", "seq", "value", "effective_trust", "violation"])

    stored = memory.gate(stream, config).filter("outcome = 'stored'").select("key", "seq", "value", "effective_trust")
    return stored.groupBy("key").applyInPandasWithState(step, _ENTRY, "value string, trust double", "append", GroupStateTimeout.NoTimeout)


def counts(stream: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of tumbling or sliding windows over ts."""
    by = F.window("ts", window, slide) if slide else F.window("ts", window)
    return stream.withWatermark("ts", late).groupBy(by.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, stop, n) of each user's sessions."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
