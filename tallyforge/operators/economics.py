"""What sessions cost and wait for: rates by model from a table, calls paired with their results, blocking time, index quantiles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Writing to a cache costs this many times the input rate, reading from it where its model's rate is not known.
CACHE_WRITE, CACHE_READ = 1.25, 0.10


def with_rates(calls: DataFrame, rates: DataFrame, default: tuple[float, float], model: str = "model") -> DataFrame:
    """calls with rate_in, rate_out and rate_read of the longest prefix of their model in rates (prefix, rate_in, rate_out, read: a share of rate_in or null), else the default.

    Prefixes are looked up once for each model, by equality.
    """
    models = calls.select(model).where(F.col(model).isNotNull()).distinct()
    up = models.select(model, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(model), F.lit(1))), lambda n: F.left(F.col(model), n))).alias("prefix"))
    best = up.join(rates, "prefix").groupBy(model).agg(F.max_by(F.struct("rate_in", "rate_out", "read"), F.length("prefix")).alias("r"))
    j = calls.join(best, model, "left")
    rate_in = F.coalesce("r.rate_in", F.lit(default[0]))
    return j.select(*calls.columns, rate_in.alias("rate_in"), F.coalesce("r.rate_out", F.lit(default[1])).alias("rate_out"), (rate_in * F.coalesce("r.read", F.lit(CACHE_READ))).alias("rate_read"))


def cost(fresh: Column, out: Column, written: Column, read: Column) -> Column:
    """Dollars of a call with rates; null counts are none."""
    n = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return (n(fresh) * F.col("rate_in") + n(out) * F.col("rate_out") + n(written) * F.col("rate_in") * CACHE_WRITE + n(read) * F.col("rate_read")) / 1e6


def paired_calls(events: DataFrame, key: str = "session", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(session, call_id, name, started, ended, seconds, background) of results with their calls, by id.

    events: key, ts, order, call_id, type ('call' or 'result'), name, background. A
    result belongs to the last call of its id before it that has no result yet; a call that is made again
    before its result starts anew, and a result without a call is left out.
    """
    w = Window.partitionBy(key, "call_id").orderBy(ts, order)
    before = F.lag(F.struct("type", "name", F.col(ts).alias("at"), "background")).over(w)
    d = events.where("call_id is not null").withColumn("c", before).where("type = 'result' and c.type = 'call'")
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("c.at").cast("timestamp"))
    return d.select(key, "call_id", "c.name", F.col("c.at").alias("started"), F.col(ts).alias("ended"), (seconds / 1e6).alias("seconds"), "c.background")


def blocking(pairs: DataFrame, by: list[str], since: Column | None = None, until: Column | None = None) -> DataFrame:
    """(by, calls, seconds): time that calls in the foreground held their session up, of calls that began in the window."""
    d = pairs.where(~F.coalesce("background", F.lit(False)))
    d = d if since is None else d.where(F.col("started") >= since)
    d = d if until is None else d.where(F.col("started") < until)
    return d.groupBy(*by).agg(F.count("*").alias("calls"), F.sum(F.col("seconds").cast("decimal(28,6)")).alias("seconds"))


def waits(gates: DataFrame, turns: DataFrame, key: str = "session") -> DataFrame:
    """(session, turn, waited): seconds of a turn in which its session waited at a gate.

    gates: key, started, ended; turns: key, turn, started, ended. Both meet by the
    hours they touch, and an overlap counts in its first hour only, so one long session is no single pair of lists.
    """
    hour = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 3600)
    spread = lambda d: d.where("started <= ended").withColumn("hour", F.explode(F.sequence(hour("started"), hour("ended"))))
    g = spread(gates.select(key, "started", "ended")).select(key, "hour", F.col("started").alias("a"), F.col("ended").alias("b"))
    j = spread(turns.select(key, "turn", "started", "ended")).join(g, [key, "hour"])
    begin, end = F.greatest("started", "a"), F.least("ended", "b")
    first = F.floor(F.unix_seconds(begin.cast("timestamp")) / 3600) == F.col("hour")
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(begin.cast("timestamp"))
    return j.where(first & (begin < end)).groupBy(key, "turn").agg((F.sum(micros) / 1e6).alias("waited"))


def index_quantile(p: float):
    """A grouped-aggregate UDF: the value at place int(n * p), at most the last, of a group's values in order; for groups of a bounded size, such as a session's turns."""

    @pandas_udf("double")
    def quantile(values: pd.Series) -> float:
        v = values.dropna().sort_values().to_numpy()
        return float(v[min(int(len(v) * p), len(v) - 1)]) if len(v) else None

    return quantile
