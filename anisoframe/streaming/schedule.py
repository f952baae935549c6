"""Rules of view-driven loading: changes of views, retries, cooldown of what is no longer wanted, fades, event windows.

The rules are expressions over rows, so a stream and a batch share them; what needs memory between batches is a stateful
operator whose state is a few numbers for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..functions.scalars import lit

# Responses that are worth another try, in HTTP's numbers, and the delays in milliseconds.
RETRIED = (408, 425, 429)
FIRST_DELAY, LONGEST_DELAY, COOLDOWN, FADE = 1000, 30_000, 2000, 200


def retryable(status: Column) -> Column:
    """Statuses to try again; null stands for a lost connection or worker, which is one."""
    return F.coalesce(status.isin(*RETRIED) | (status >= 500), F.lit(True))


def retry_delay(failures: Column) -> Column:
    """Milliseconds until the next try: doubled with each failure, half a minute at most."""
    return F.least(F.lit(LONGEST_DELAY).cast("long"), (lit(FIRST_DELAY) * F.pow(lit(2), F.least(failures, F.lit(16)).cast("double"))).cast("long"))


def faded(now: Column, start: Column, begin: Column, target: Column, duration: int = FADE) -> Column:
    """Opacity on its straight way from where it began to its target."""
    done = F.least(F.greatest((now - start).cast("double") / lit(duration), lit(0)), lit(1))
    return begin + (target - begin) * done


def with_group_opacity(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Opacity of rows scaled by their group's (hidden, shown, coming, going); groups that aren't listed are shown."""
    return rows.join(groups.select("group", F.col("opacity").alias("__g")), "group", "left").withColumn("opacity", F.col("opacity") * F.coalesce("__g", lit(1))).drop("__g")


def view_changes(views: DataFrame, keys: list[str], camera: str, order: str) -> DataFrame:
    """Views that differ from the camera's one before, with a revision number; for batches."""
    by = Window.partitionBy(camera).orderBy(order)
    state = F.struct(*keys)
    new = F.when(F.lag(state).over(by).eqNullSafe(state), 0).otherwise(1)
    return views.withColumn("__new", new).withColumn("revision", F.sum("__new").over(by)).where("__new = 1").drop("__new")


def view_change_stream(views: DataFrame, value: str, camera: str) -> DataFrame:
    """(camera, revision, value) whenever a camera's value differs from its last one. State: that value and a counter."""
    kind = views.schema[camera].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, revision = state.get if state.exists else (None, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values("order")
        for v in rows["value"]:
            if v != last:
                last, revision = v, revision + 1
                out.append((key[0], revision, v))
        state.update((last, revision))
        yield pd.DataFrame(out, columns=["camera", "revision", "value"])

    rows = views.select(F.col(camera).alias("camera"), F.col(value).cast("string").alias("value"), F.col("order"))
    return rows.groupBy("camera").applyInPandasWithState(
        step, f"camera {kind}, revision long, value string", "value string, revision long", "append", GroupStateTimeout.NoTimeout
    )


def releases(demand: DataFrame, cooldown: int = COOLDOWN) -> DataFrame:
    """(page, since, released): when pages that were wanted at some times (page, at: milliseconds) are let go.

    A page stays as long as the next demand comes within the cooldown after the last; each stay is a row.
    """
    by = Window.partitionBy("page").orderBy("at")
    new = F.when(F.col("at") - F.lag("at").over(by) <= cooldown, 0).otherwise(1)
    rows = demand.withColumn("__new", new).withColumn("__stay", F.sum("__new").over(by))
    return rows.groupBy("page", "__stay").agg(F.min("at").alias("since"), (F.max("at") + cooldown).alias("released")).drop("__stay")


def release_stream(demand: DataFrame, cooldown: int = COOLDOWN) -> DataFrame:
    """The same of a stream with a watermark on ``ts``: a session window for each stay, given out when it has closed."""
    return demand.groupBy(F.session_window("ts", f"{cooldown} milliseconds"), "page").agg(F.count("*").alias("n")).select(
        "page", F.col("session_window.start").alias("since"), F.col("session_window.end").alias("released"), "n"
    )


def _watermarked(events: DataFrame, ts: str, late: str | None) -> DataFrame:
    """With a watermark if one is asked for; watermarks need a time zone, which is the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if late else events


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str | None = None, keys: tuple[str, ...] = ("event_type",), ts: str = "ts", value: str = "value") -> DataFrame:
    """Count and sum in event-time windows, for batches and, with ``late`` as watermark, for streams.

    Sums are of whole hundredths, so that they don't depend on the order of rows.
    """
    rows = _watermarked(events, ts, late)
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    cents = F.sum(F.round(F.col(value) * 100).cast("long")).alias("cents")
    return rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), cents).select(F.col("w.start").alias("start"), *keys, "n", "cents")


def sessions(events: DataFrame, gap: str, key: str = "user_id", ts: str = "ts", late: str | None = None) -> DataFrame:
    """Sessions of a key that end when nothing comes for the gap."""
    rows = _watermarked(events, ts, late)
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")
