"""Streams over events, each with a batch twin: `lateness` is how late a row may come and still count.

All take a streaming or a batch DataFrame with `ts` (timestamp) and return one of
the same kind; on a batch, watermarks have no effect, so the same function is the twin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import to_report_date
from ..operators.money import upsert


def once(rows: DataFrame, key: str, lateness: str = "1 day") -> DataFrame:
    """The first row of each key within the lateness."""
    if rows.isStreaming:
        return rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("ts"))).where("_n = 1").drop("_n")


def daily(rows: DataFrame, value: Column, lateness: str = "2 days", zone: str = "America/Los_Angeles") -> DataFrame:
    """(day, n, total) by day of the reporting zone.

    Windows of an hour close by watermark; add_up makes days of them, which UTC windows cannot be.
    """
    hours = rows.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return hours.select(to_report_date(F.col("window.start"), zone).alias("day"), "n", "total")


def add_up(hours: DataFrame) -> DataFrame:
    """Days of the parts that daily() gives."""
    return hours.groupBy("day").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def activity(rows: DataFrame, session: str = "session", idle: str = "300 seconds", lateness: str = "1 hour") -> DataFrame:
    """(session, start, end, n): bursts of events without an idle gap; end is the last event plus the gap."""
    g = rows.withWatermark("ts", lateness).groupBy(session, F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("n"))
    return g.select(session, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def pair_results(calls: DataFrame, results: DataFrame, key: str, within: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """(key, called, answered, seconds): calls joined to the results that follow within the bound."""
    c = calls.select(F.col(key).alias("_k"), F.col("ts").alias("called")).withWatermark("called", lateness)
    r = results.select(F.col(key), F.col("ts").alias("answered")).withWatermark("answered", lateness)
    j = c.join(r, F.expr(f"_k = {key} AND answered >= called AND answered <= called + INTERVAL {within}"))
    return j.select(key, "called", "answered", (F.unix_seconds("answered") - F.unix_seconds("called")).alias("seconds"))


def sliding_rate(rows: DataFrame, hit: Column, length: str = "30 days", step: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """(start, n, hits) of windows of a length that start every step."""
    g = rows.withWatermark("ts", lateness).groupBy(F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    return g.select(F.col("w.start").alias("start"), "n", "hits")


def show_holds(orders: DataFrame, windows: DataFrame, margin: str = "2 hours") -> DataFrame:
    """(order_id, show): orders of a stream or batch that fall in a show window or up to `margin` before it, the first window by start.

    windows (show, start, close) are few and static: they go to every task as one
    sorted array, so a stream needs neither a state nor a join.
    """
    w = windows.agg(F.sort_array(F.collect_list(F.struct("start", "show", "close"))).alias("w"))
    j = orders.join(F.broadcast(w))
    first = F.get(F.filter("w", lambda x: (F.col("ts") >= x["start"] - F.expr(f"INTERVAL {margin}")) & (F.col("ts") < x["close"])), F.lit(0))
    return j.select("order_id", first["show"].alias("show")).where("show is not null")


def lifecycle(events: DataFrame, key: str = "sku") -> DataFrame:
    """(sku, status, breaks) of status events (sku, pos, status): the status after all events so far and how many numbers were out of turn.

    A stream folds each key's events into one row of state, in the order of pos
    inside a batch; a batch is folded by the same function. DRAFTED overwrites
    nothing, SYNCED leaves PUBLISHED in place, all others overwrite.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(status: str | None, last: int, breaks: int, rows: pd.DataFrame) -> tuple[str, int, int]:
        for r in rows.sort_values("pos").itertuples():
            breaks += int(r.pos != last + 1)
            last = int(r.pos)
            if status is None or not (r.status == "DRAFTED" or (r.status == "SYNCED" and status == "PUBLISHED")):
                status = r.status
        return status, last, breaks

    def stateful(k, batches, state):
        was = state.get if state.exists else (None, 0, 0)
        now = fold(*was, pd.concat(batches))
        state.update(now)
        yield pd.DataFrame({"sku": [k[0]], "status": [now[0]], "breaks": [now[2]]})

    d = events.select(F.col(key).alias("sku"), "pos", "status")
    if events.isStreaming:
        return d.groupBy("sku").applyInPandasWithState(stateful, f"sku {d.schema['sku'].dataType.simpleString()}, status string, breaks long", "status string, last long, breaks long", "update", GroupStateTimeout.NoTimeout)

    def whole(k, rows: pd.DataFrame) -> pd.DataFrame:
        now = fold(None, 0, 0, rows)
        return pd.DataFrame({"sku": [k[0]], "status": [now[0]], "breaks": [now[2]]})

    return d.groupBy("sku").applyInPandas(whole, f"sku {d.schema['sku'].dataType.simpleString()}, status string, breaks long")


def price_levels(rows: DataFrame, key: str, price: str, accuracy: int = 10_000) -> DataFrame:
    """(key, n, p25, median, p75) as they stand, by mergeable sketches; for update or complete mode."""
    q = F.percentile_approx(price, [0.25, 0.5, 0.75], accuracy)
    return rows.groupBy(key).agg(F.count(price).alias("n"), q.alias("q")).select(key, "n", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"))


def upsert_to(folder: str, key: list[str], optional: tuple[str, ...] = (), frozen: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that puts the last row of each key over the table kept in folder.

    Each batch writes folder/batch=<id>, a whole table that a repeat of the
    batch overwrites, so a restart neither loses nor doubles a row.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in key]), "ts").alias("r")).select(*key, "r.*").select(*batch.columns)
        if number > 0:
            last = upsert(spark.read.parquet(f"{folder}/batch={number - 1}"), last, key, optional, frozen)
        last.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write
