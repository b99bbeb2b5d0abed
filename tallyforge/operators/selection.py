"""Choosing rows: age, price audits, latest and first rows, lots, status folds, validation, replays of change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import Money


def split_by_age(df: DataFrame, start: Column, price: Column, today: str, days: int, least: float) -> DataFrame:
    """df with age: 'seasoned' from `days` on at a price of `least` or more, else 'young'; no date is young."""
    old = (F.datediff(F.to_date(F.lit(today)), start) >= days) & (price >= least)
    return df.withColumn("age", F.when(old, "seasoned").otherwise("young"))


def top_sellers(listings: DataFrame, n: int, seller: str = "seller") -> DataFrame:
    """Listings of the n sellers that have most of them, equals by name."""
    top = listings.groupBy(seller).agg(F.count("*").alias("listed")).orderBy(F.desc("listed"), seller).limit(n)
    return listings.join(F.broadcast(top), seller)


def best_per_listing(scores: DataFrame, k: int, listing: str = "listing", image: str = "image") -> DataFrame:
    """(listing, image, score): the best image of each listing, and of these the k best."""
    best = scores.groupBy(listing).agg(F.max_by(F.struct(image, "score"), F.struct("score", image)).alias("b"))
    return best.select(listing, "b.*").orderBy(F.desc("score"), listing).limit(k)


def queue_order(df: DataFrame, statuses: list[str], store: str, days: str, key: str) -> DataFrame:
    """df sorted by the place of its status in `statuses` (others last), store, days downwards, key."""
    place = F.array_position(F.array(*map(F.lit, statuses)), F.col("status"))
    return df.orderBy(F.when(place > 0, place).otherwise(len(statuses) + 1), store, F.desc(days), key)


def price_audit(live: DataFrame, recommended: Column, age: Column, days: int) -> DataFrame:
    """Live rows asked over what is recommended for `days` or longer, with over_bp and drop_to."""
    over = F.floor((F.col("price") - recommended) * 10_000 / recommended)
    d = live.where((F.col("status") == "PUBLISHED") & (F.col("price") > recommended) & (age >= days))
    return d.withColumn("over_bp", over).withColumn("drop_to", F.ceil(recommended))


def floor_verdict(offers: Column, floor: Column, ask: Column, lowest: Column, rec: Column) -> Column:
    """What is wrong with the floor under best offers, 'ok' if nothing is."""
    return (
        F.when(~F.coalesce(offers, F.lit(False)), "no best offer").when(floor.isNull(), "NO FLOOR").when(floor >= ask, "FLOOR >= ASK")
        .when(floor < lowest, "BELOW FLOOR").when(floor < rec, "under rec").otherwise("ok")
    )


def best_answer(posts: DataFrame, thread: str, pos: str, substantive: Column, rep: Column) -> DataFrame:
    """(thread, pos) of the reply of the highest standing, a substantive one before any other, the earliest of equals."""
    return posts.groupBy(thread).agg(F.max_by(pos, F.struct(substantive.alias("a"), rep.alias("b"), (-F.col(pos)).alias("c"))).alias(pos))


def latest_per_key(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    row = F.struct(*[c for c in log.columns if c != key])
    return log.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("r")).select(key, "r.*")


def first_per_key(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row by order of each key; the result has the columns of df."""
    return df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def lot_plan(rows: DataFrame, lot: str = "lot", number: str = "number") -> DataFrame:
    """rows with lead, lead_state and unit_floor of their lot: the active row of the least number, its state, the sum of active floors.

    A lot's figures are aggregated before they are joined, so no task holds a whole lot.
    """
    on = F.col("active")
    g = rows.groupBy(lot).agg(F.min(F.when(on, F.col(number))).alias("lead"), F.min_by("state", F.when(on, F.col(number))).alias("lead_state"), F.sum(F.when(on, F.col("floor"))).cast(Money).alias("unit_floor"))
    return rows.join(g, lot, "left")


def number_lineup(existing: DataFrame, new: DataFrame, show: str, item: str, order: str) -> DataFrame:
    """(show, item, number): existing (show, item, number) unmoved, then new items by their first appearance."""
    last = existing.groupBy(show).agg(F.max("number").alias("_last"))
    fresh = new.groupBy(show, item).agg(F.min(order).alias("_at")).join(existing.select(show, item), [show, item], "left_anti")
    n = F.row_number().over(Window.partitionBy(show).orderBy("_at", item))
    fresh = fresh.withColumn("_n", n).join(last, show, "left").select(show, item, (F.coalesce("_last", F.lit(0)) + F.col("_n")).alias("number"))
    return existing.select(show, item, F.col("number").cast("long").alias("number")).unionByName(fresh)


def advance_status(events: DataFrame, key: str = "sku", pos: str = "pos") -> DataFrame:
    """(key, status, first_published): the status after all events, folded with mergeable aggregates.

    DRAFTED overwrites nothing, SYNCED leaves PUBLISHED in place, all others
    overwrite; a status is stamped the first time only.
    """
    strong, synced = ~F.col("status").isin("DRAFTED", "SYNCED"), F.col("status") == "SYNCED"
    g = events.where("status is not null").groupBy(key).agg(
        F.max_by("status", F.when(strong, F.col(pos))).alias("s"), F.max(F.when(strong, F.col(pos))).alias("p"), F.max(F.when(synced, F.col(pos))).alias("q"), F.min(F.when(F.col("status") == "PUBLISHED", F.col("ts"))).alias("first_published")
    )
    later = F.col("q").isNotNull() & (F.col("p").isNull() | (F.col("q") > F.col("p"))) & F.coalesce(F.col("s") != "PUBLISHED", F.lit(True))
    return g.select(key, F.when(later, "SYNCED").when(F.col("p").isNotNull(), F.col("s")).otherwise("DRAFTED").alias("status"), "first_published")


def rule_reasons(df: DataFrame, rules: list[tuple[Column, str]], name: str = "reasons") -> DataFrame:
    """df with an array of the labels of all rules that hold."""
    return df.withColumn(name, F.array_compact(F.array(*[F.when(c, F.lit(label)) for c, label in rules])))


def validate_rows(rows: DataFrame, key: str, row_rules: list[tuple[Column, str]], group_rules: list[tuple[list[str], Column, str]]) -> DataFrame:
    """(key, error) of all rules that are broken: by a row, or by the aggregate over the group of some columns that the row is in."""
    out = rule_reasons(rows, row_rules, "error").select(key, F.explode("error").alias("error"))
    for cols, broken, label in group_rules:
        bad = rows.groupBy(*cols).agg(broken.alias("_bad")).where("_bad").drop("_bad")
        out = out.unionByName(rows.join(bad, cols, "left_semi").select(key, F.lit(label).alias("error")))
    return out


def terms_survey(offers: DataFrame, allowed: DataFrame, served: DataFrame) -> DataFrame:
    """Live offers under a policy that is not allowed, with the terms that are served for their listing."""
    return offers.where("status = 'PUBLISHED'").join(allowed, "policy", "left_anti").join(served, "listing_id", "left")


def live_vs_local(live: DataFrame, local: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """live rows with a local counterpart or without one: (..., found), fields of the local row as local_<field>."""
    mine = local.select(key, *[F.col(f).alias(f"local_{f}") for f in fields], F.lit(True).alias("found"))
    return live.join(mine, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def replay(events: DataFrame, key: str, row: str, as_of: Column | None = None) -> DataFrame:
    """(key, row) with multiplicity after the adds (delta 1) and removals (delta -1) that as_of admits."""
    e = events if as_of is None else events.where(as_of)
    n = e.groupBy(key, row).agg(F.sum("delta").alias("n")).where("n > 0")
    return n.select(key, row, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
