"""Streams of page fetches: an extension, for watching what batch audits measure."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def status_counts(fetches: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """fetches (ts, status) -> window_start, status, fetches.

    In append mode a window is given out once, when the watermark has passed its end, and its state goes; in complete
    mode all windows are given out after every batch, and none goes.
    """
    out = fetches.withWatermark("ts", late).groupBy(F.window("ts", window), "status").agg(F.count("*").alias("fetches"))
    return out.select(F.col("window.start").alias("window_start"), "status", "fetches")


_CHANGES = "url_key string, ts timestamp, seq long, before string, after string"


def changes(visits: DataFrame, keep_ms: int = 30 * 86_400_000, late: str = "1 day") -> DataFrame:
    """A stream of visits (url_key, ts, seq, content) -> the visits whose content differs from the page's visit before.

    State is a page's last content, and goes when the watermark is keep_ms past the page's last visit; its next visit
    is then a first one. Visits that come in one batch are taken by ts, then seq; a visit older than the last one seen
    is late and changes nothing. A first visit is no change; null contents are contents like others.
    """

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"], kind="stable")  # of one page in one batch
        seen, last_ts, last_seq, content = (True, *state.get) if state.exists else (False, 0, 0, None)
        out = []
        for ts, seq, now in zip(rows["ts"], rows["seq"], rows["content"]):
            now, at = None if pd.isna(now) else now, pd.Timestamp(ts).value
            if seen and (at, seq) <= (last_ts, last_seq):
                continue
            if seen and now != content:
                out.append((key[0], ts, seq, content, now))
            seen, last_ts, last_seq, content = True, at, int(seq), now
        state.update((last_ts, last_seq, content))
        state.setTimeoutTimestamp(last_ts // 1_000_000 + keep_ms)
        yield pd.DataFrame(out, columns=["url_key", "ts", "seq", "before", "after"])

    by_page = visits.select("url_key", "ts", "seq", "content").withWatermark("ts", late).groupBy("url_key")
    return by_page.applyInPandasWithState(follow, _CHANGES, "ts long, seq long, content string", "append", GroupStateTimeout.EventTimeTimeout)


def weekly_p75(samples: DataFrame) -> DataFrame:
    """samples (ts, metric, value) -> week, metric, p75: the 75th percentile by week, as a batch."""
    week = F.date_trunc("week", "ts")
    return samples.groupBy(week.alias("week"), "metric").agg(F.percentile("value", 0.75).alias("p75"))
