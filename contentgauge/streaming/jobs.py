"""Streaming jobs: dedup over a day, the quality gate, and daily ratios. They share their functions with the batch jobs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from contentgauge.functions import text as T
from contentgauge.operators import detectors, normalize


#: Hours for which a fingerprint is known, how late rows may be, and groups that fingerprints are dealt into by hash.
KNOWN_HOURS, LATE, GROUPS = 24, "1 hour", 1024
_SEEN = "fingerprint string, content_id string, event_time timestamp"


def dedup_stream(content: DataFrame, hours: int = KNOWN_HOURS, late: str = LATE, groups: int = GROUPS) -> DataFrame:
    """fingerprint, content_id and event_time of the first row of each fingerprint within the hours, by event time.

    A row that comes out is known for the hours; the next one after them comes out again. Of a fingerprint's rows in one
    trigger the earliest is first, of equals the smallest content_id. Rows later than the watermark are dropped, and a
    fingerprint's state, one timestamp, goes when the watermark has passed the time until which it is known. A null title
    or text is an empty one.

    A call of the function takes a group of fingerprints with one state, the times until which each is known, as calls
    and states by fingerprint cost far more than their rows. groups stays the same for a checkpoint; the more
    fingerprints a day has, the more of them should be.
    """
    known = hours * 3_600_000

    def first(key, parts, state):
        rows = None if state.hasTimedOut else pd.concat(parts).sort_values(["at", "content_id"])
        seen, out = (dict(state.get[0]) if state.exists else {}), []
        if rows is not None:
            for fingerprint, now, content_id, at in zip(rows["fingerprint"], rows["at"].tolist(), rows["content_id"], rows["event_time"], strict=True):
                if now >= seen.get(fingerprint, now):
                    out.append((fingerprint, content_id, at))
                    seen[fingerprint] = now + known
        watermark = state.getCurrentWatermarkMs()
        if seen := {k: until for k, until in seen.items() if until > watermark}:
            state.update((seen,))
            state.setTimeoutTimestamp(min(seen.values()))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["fingerprint", "content_id", "event_time"])

    keyed = content.select(T.fingerprint(T.text_of("title"), T.text_of("body")).alias("fingerprint"), "content_id", "event_time").withWatermark("event_time", late)
    dealt = keyed.withColumns({"at": F.unix_millis("event_time"), "dealt": F.pmod(F.hash("fingerprint"), F.lit(groups))})
    return dealt.groupBy("dealt").applyInPandasWithState(first, _SEEN, "until map<string,bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def quality_gate(content: DataFrame) -> DataFrame:
    """Cleaned content with skip reason and language; a projection, the same in batch and stream."""
    return normalize.with_language(normalize.with_skip_reason(normalize.clean_content(content)))


def run_gate(content: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes through the gate; sink gets its rows and the attributes of those without a skip reason."""

    def batch(df: DataFrame, number: int) -> None:
        gated = quality_gate(df).persist()
        sink(gated, detectors.detect_attributes(gated.filter("skip_reason is null"), ["content_id"]), number)
        gated.unpersist()

    return content.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_ratio(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Volume and share of authentic items of each brand and day, for update mode: a day's row comes again when it changes.

    Rows later than the watermark are dropped, and with them the state of days that the watermark has passed.
    """
    return events.withWatermark("event_time", late).groupBy("brand_id", F.window("event_time", "1 day").alias("w")).agg(
        F.count("*").alias("n"), (100.0 * F.count_if(F.col("is_authentic")) / F.count("*")).alias("ratio_pct")
    ).select("brand_id", F.col("w.start").alias("day"), "n", "ratio_pct")


def upsert(rows: DataFrame, root: str, keys: list[str], by: str) -> None:
    """Puts rows in place of those with the same keys in a table under root, which is partitioned by a key.

    Only the partitions that rows have are read and written, and Spark's committer swaps them. Doing the same batch again
    changes nothing, so a batch that is repeated after a failure is safe.
    """
    spark = rows.sparkSession
    try:
        before = spark.read.parquet(root)
    except AnalysisException:  # no table yet
        before = None
    if before is not None:
        touched = rows.select(by).distinct()
        kept = before.join(F.broadcast(touched), by, "left_semi").join(rows.select(*keys).hint("shuffle_hash"), keys, "left_anti")
        rows = kept.select(*rows.columns).unionByName(rows)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(root)


def run_ratio(events: DataFrame, root: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """The daily ratios in update mode into a table under root, partitioned by date."""

    def batch(df: DataFrame, number: int) -> None:
        changed = df.withColumn("date", F.date_format("day", "yyyy-MM-dd")).persist()
        if not changed.isEmpty():
            upsert(changed, root, ["brand_id", "date"], "date")
        changed.unpersist()

    return daily_ratio(events, late).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
