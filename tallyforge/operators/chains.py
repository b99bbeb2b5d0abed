"""Hash-chained change logs: every link of every chain, the table that a chain replays to, and tables that drifted from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the first event of a chain links to.
GENESIS = "0" * 64

#: What can be wrong with an event, in the order in which it is looked for.
BREAKS = ["not an event", "edited", "prev", "seq", "key", "genesis", "removes"]


def row_balance(events: DataFrame) -> DataFrame:
    """(chain, line, row, before, gone, come): for each row that an event removes or adds, how often it stood in the table before.

    An event removes before it adds. Each (chain, row) is summed by event first.
    """
    gone = events.select("chain", "line", F.explode("remove").alias("row"), F.lit(1).alias("gone"), F.lit(0).alias("come"))
    come = events.select("chain", "line", F.explode("add").alias("row"), F.lit(0).alias("gone"), F.lit(1).alias("come"))
    d = gone.unionByName(come).groupBy("chain", "row", "line").agg(F.sum("gone").alias("gone"), F.sum("come").alias("come"))
    w = Window.partitionBy("chain", "row").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("before", F.coalesce(F.sum(F.col("come") - F.col("gone")).over(w), F.lit(0)))


def state_digest(rows: DataFrame, fields: DataFrame, shards: int = 1) -> DataFrame:
    """(chain, state): sha256 of the canonical text of a table's fields and its rows in order; rows: chain, row, n; fields: chain, fields.

    A table's rows do not depend on their order. shards > 1 hashes the rows of
    each shard first and then the shards' digests, for tables that no task should sort alone;
    such digests compare with each other only.
    """
    sorted_rows = F.array_sort(F.flatten(F.collect_list(F.array_repeat("row", F.col("n").cast("int")))))
    if shards > 1:
        part = rows.groupBy("chain", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")).agg(F.sha2(F.to_json(F.struct(sorted_rows.alias("rows"))), 256).alias("digest"))
        body = part.groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "digest"))), lambda x: F.concat_ws(":", x["shard"], x["digest"])).alias("rows"))
    else:
        body = rows.groupBy("chain").agg(sorted_rows.alias("rows"))
    j = fields.join(body, "chain", "left").select("chain", "fields", F.coalesce("rows", F.array().cast("array<string>")).alias("rows"))
    return j.select("chain", F.sha2(F.to_json(F.struct("fields", "rows")), 256).alias("state"))


def _links(events: DataFrame) -> Column:
    """The first thing that is wrong with an event by itself or with its link, null for nothing."""
    w = Window.partitionBy("chain").orderBy("line")
    differs = lambda a, b: ~a.eqNullSafe(b)
    wrong = {
        "not an event": F.col("hash").isNull(),
        "edited": differs(F.col("hash"), F.sha2("body", 256)),
        "prev": differs(F.col("prev"), F.coalesce(F.lag("hash").over(w), F.lit(GENESIS))),
        "seq": differs(F.col("seq"), F.col("line") - 1),
        "key": differs(F.col("key"), F.col("chain")),
        "genesis": (F.coalesce("kind", F.lit("")) == "genesis") != (F.col("line") == 1),
    }
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in wrong.items()])


def numbered(events: DataFrame, at: str = "at") -> DataFrame:
    """events with line, the place of each in its chain from 1 by `at`."""
    return events.withColumn("line", F.row_number().over(Window.partitionBy("chain").orderBy(at)).cast("long"))


def verify(events: DataFrame, tables: DataFrame | None = None, shards: int = 1) -> DataFrame:
    """(chain, events, rows, head, line, reason, drift) of every chain, walked from its first event to the first that is broken.

    events: chain, line, hash, body (the text that hash is of), prev, seq, key,
    kind, fields, add and remove (arrays of canonical rows), state. line and
    reason: the first break, null for none. events, rows, head: how many events
    before it are good, and of a whole chain the rows of its table and its last hash. The
    state of the last event must be the digest of the replayed table. tables: chain,
    fields, row, one for each row of the table as it stands; drift says whether
    it is another than the chain's, null for a broken chain or where there is no table.
    """
    links = events.withColumn("reason", _links(events)).where("reason is not null").select("chain", "line", "reason")
    balance = row_balance(events)
    absent = balance.where("before < gone").select("chain", "line", F.lit("removes").alias("reason"))
    order = F.array_position(F.array(*map(F.lit, BREAKS)), F.col("reason"))
    broken = links.unionByName(absent).groupBy("chain").agg(F.min(F.struct("line", order.alias("o"), "reason")).alias("b")).select("chain", "b.line", "b.reason")
    last = events.groupBy("chain").agg(F.max("line").alias("n"), F.max_by(F.struct("hash", "state", "fields"), "line").alias("last"))
    net = balance.groupBy("chain", "row").agg(F.sum(F.col("come") - F.col("gone")).alias("n")).where("n > 0")
    size = net.groupBy("chain").agg(F.sum("n").alias("rows"))
    state = state_digest(net, last.select("chain", "last.fields"), shards).withColumnRenamed("state", "replayed")
    j = last.join(broken, "chain", "left").join(size, "chain", "left").join(state, "chain", "left")
    off = F.col("line").isNull() & ~F.col("replayed").eqNullSafe(F.col("last.state"))
    j = j.select("chain", "n", "last", "rows", F.when(off, F.col("n")).otherwise(F.col("line")).alias("line"), F.when(off, F.lit("state")).otherwise(F.col("reason")).alias("reason"))
    drift = F.lit(None).cast("boolean")
    if tables is not None:
        now = state_digest(tables.where("row is not null").groupBy("chain", "row").agg(F.count("*").alias("n")), tables.select("chain", "fields").distinct(), shards)
        j = j.join(now.withColumnRenamed("state", "now"), "chain", "left")
        drift = F.when(F.col("line").isNull() & F.col("now").isNotNull(), F.col("now") != F.col("last.state"))
    good = F.col("line").isNull()
    return j.select(
        "chain", F.when(good, F.col("n")).otherwise(F.col("line") - 1).alias("events"), F.when(good, F.coalesce("rows", F.lit(0).cast("long"))).alias("rows"), F.when(good, F.col("last.hash")).alias("head"), "line", "reason", drift.alias("drift"),
    )
