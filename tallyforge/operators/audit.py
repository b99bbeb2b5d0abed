"""Audits of live listings against drafts and ledgers, and duplicate decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import checkpointed


def _one(d: DataFrame, key: str, name: str) -> DataFrame:
    """One row of each key, the least of its columns, as a struct."""
    return d.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*d.columns)).alias(name))


def audit_live(offers: DataFrame, actives: DataFrame, drafts: DataFrame, ledger: DataFrame) -> DataFrame:
    """(sku, listing_id, state, grouped, live_price, ref, issues) of each offer, and of ledger rows that say PUBLISHED without an offer.

    offers: sku, listing_id, status, listing_status, title, price; actives:
    listing_id, title, price; drafts: sku, listing_id, ref, title, price; ledger:
    sku, listing_id, status. A draft is found by sku, else by listing. State of a
    published offer is LIVE or GONE, by its listing status, or where that is
    unknown by the listing's standing among actives. Offers that share a listing
    (grouped) are compared by their own price. issues: labels, in this order.
    """
    group = offers.where("listing_id is not null").groupBy("listing_id").agg((F.count("*") > 1).alias("grouped"))
    j = offers.join(group, "listing_id", "left").join(_one(drafts.select("sku", "ref", "title", "price"), "sku", "d1"), "sku", "left").join(_one(drafts.select("listing_id", "ref", "title", "price"), "listing_id", "d2"), "listing_id", "left")
    j = j.join(_one(actives.select("listing_id", "title", "price"), "listing_id", "a"), "listing_id", "left").join(_one(ledger.select("sku", F.col("status").alias("said")), "sku", "l"), "sku", "left")
    draft = lambda c: F.coalesce(f"d1.{c}", f"d2.{c}")
    has = F.col("d1").isNotNull() | F.col("d2").isNotNull()
    on = F.when(F.coalesce(F.col("listing_status"), F.lit("")) != "", F.upper("listing_status") == "ACTIVE").otherwise(F.col("a").isNotNull())
    published = F.col("status") == "PUBLISHED"
    j = j.withColumns({"grouped": F.coalesce("grouped", F.lit(False)), "state": F.when(published & ~on, "GONE").when(published, "LIVE").otherwise(F.col("status"))})
    seen = F.when(F.col("grouped"), F.col("price")).otherwise(F.coalesce("a.price", "price"))
    title = F.coalesce(F.nullif("a.title", F.lit("")), "title")
    gone = F.col("state") == "GONE"
    issues = [
        (gone, "not purchasable"),
        (~F.col("grouped") & (F.col("a.price") != F.col("price")), "price differs from the offer's"),
        (~has & ~F.col("grouped"), "no draft"),
        (has & (title != draft("title")), "title differs"),
        (has & (seen != draft("price")), "draft price differs"),
        (gone & (F.col("l.said") == "PUBLISHED"), "ledger says published"),
    ]
    rows = j.select("sku", "listing_id", "state", "grouped", seen.alias("live_price"), draft("ref").alias("ref"), F.concat_ws("; ", *[F.when(c, F.lit(x)) for c, x in issues]).alias("issues"))
    lost = ledger.where("status = 'PUBLISHED' and sku is not null").join(offers.select("sku").distinct(), "sku", "left_anti").join(_one(drafts.select("sku", "ref"), "sku", "d"), "sku", "left")
    lost = lost.select("sku", "listing_id", F.lit("NO-OFFER").alias("state"), F.lit(False).alias("grouped"), F.lit(None).cast(rows.schema["live_price"].dataType).alias("live_price"), F.col("d.ref").alias("ref"), F.lit("published without an offer").alias("issues"))
    return rows.unionByName(lost)


def snapshot_drift(live: DataFrame, ledger: DataFrame) -> DataFrame:
    """(listing_id, sku, kind): listings of a snapshot (listing_id, sku, price, status) that the ledger (sku, price, status) lacks, or tells otherwise.

    Of a listing with several variations the least sku that the ledger has stands for it.
    """
    mine = ledger.groupBy("sku").agg(F.min(F.struct("price", "status")).alias("l"))
    best = live.join(mine, "sku", "left").groupBy("listing_id").agg(F.min_by(F.struct("sku", "price", "status", "l"), F.struct(F.col("l").isNull(), F.col("sku"))).alias("b"))
    b = best.select("listing_id", "b.*")
    kind = F.when(F.col("l").isNull(), "not in ledger").when(~F.col("status").eqNullSafe(F.col("l.status")), "status").when(F.abs(F.col("price") - F.col("l.price")) >= 0.005, "price")
    return b.select("listing_id", "sku", kind.alias("kind")).where("kind is not null")


#: Added to the cosine for one bin and for a hint, and how far rounding to two places may lift a score.
SAME_BIN, HINTED, ROUNDING = 0.1, 0.25, 0.005


def likely_pairs(left: DataFrame, right: DataFrame, least: float, also: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """(cand, row) of all pairs of token sets whose cosine is `least` or more, and some others; never rows paired by a word that cannot decide.

    left: cand, t; right: row, t2; also: columns of both that must be equal, keep: those of them in the result. Two sets of
    sizes a and b need o = ceil(least * sqrt(a b)) words in common, so with words in order of
    rarity one of them is among the first a - o + 1 of the one and b - o + 1 of the other. Pairs
    meet by word, b and o: a frequent word stands last and meets nothing but sets that need a single word.
    """
    freq = right.select(F.explode("t2").alias("w")).groupBy("w").agg(F.count("*").alias("n"))

    def ranked(d: DataFrame, key: str, words: str) -> DataFrame:
        e = d.select(key, *also, F.size(words).alias("size"), F.explode(words).alias("w")).join(freq, "w", "left")
        g = e.groupBy(key, *also, "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w"))).alias("ws"))
        return g.select(key, *also, "size", F.posexplode("ws").alias("pos", "x")).select(key, *also, "size", "pos", F.col("x.w").alias("w"))

    need = lambda a, b: F.ceil(F.lit(least) * F.sqrt(a * b) - 1e-9).cast("int")
    a = left.where(F.size("t") > 0).select("cand", F.size("t").alias("a")).distinct()
    span = F.sequence(F.ceil(F.col("a") * least**2 - 1e-9).cast("int"), F.floor(F.col("a") / least**2 + 1e-9).cast("int"))
    sizes = right.select(F.size("t2").alias("b")).distinct()
    wanted = a.select("a").distinct().select("a", F.explode(span).alias("b")).join(sizes, "b").withColumn("o", need(F.col("a"), F.col("b")))  # sizes of sets, not sets
    c = ranked(left, "cand", "t").withColumnRenamed("size", "a").join(wanted, "a").where(F.col("pos") <= F.col("a") - F.col("o")).select("cand", *also, "w", "b", "o")
    r = ranked(right, "row", "t2").withColumnRenamed("size", "b").join(wanted.select("b", "o").distinct(), "b").where(F.col("pos") <= F.col("b") - F.col("o")).select("row", *also, "w", "b", "o")
    return c.join(r, ["w", "b", "o", *also]).select("cand", "row", *keep).distinct()


def decide_duplicates(candidates: DataFrame, rows: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(cand, action, best, score, n_hard, n_soft) for each candidate against the catalogue.

    candidates: cand, description, bin, photos, folder, hint (the row a note names, or null);
    rows: row, description, bin, photos, folder, lot_id, filed (array of frames
    filed in the row's folder). score is the cosine of token sets, 0.1 more in
    one bin, 0.25 more where the hint names the row, 1 at most, to 2 places. Hard
    evidence: the same folder, outside a lot, or a frame that no other row has
    and that is filed in the row's folder. attach: hard evidence for one row;
    possible: for several, or a score of threshold or more; else new. Pairs that may
    reach the threshold come from likely_pairs, at the threshold, and in one bin
    below it, over the distinct sets of words; hard evidence and hints join by equality. All scores are computed from the sets.
    """
    c = candidates.select("cand", S.tokens(F.col("description")).alias("t"), S.norm_bin(F.col("bin")).alias("b"), S.frames(F.col("photos")).alias("f"), S.norm_folder(F.col("folder")).alias("d"), "hint")
    r = rows.select("row", S.tokens(F.col("description")).alias("t2"), S.norm_bin(F.col("bin")).alias("b2"), S.frames(F.col("photos")).alias("f2"), S.norm_folder(F.col("folder")).alias("d2"), "lot_id", "filed")
    # Sets of words stand once, however many candidates and rows have them: rows are counted by set, and by set and bin, and
    # only pairs with hard evidence or a hint, whose score is their own, are pairs of a candidate and a row.
    c, r = (checkpointed(d.withColumn(k, F.xxhash64(F.array_sort(w)))) for d, k, w in ((c, "ck", "t"), (r, "rk", "t2")))
    sets = lambda d, k, w, name, *more: d.groupBy(F.col(k).alias(name), *more).agg(F.first(w).alias(w))
    kc, kr = sets(c, "ck", "t", "cand"), sets(r, "rk", "t2", "row")
    bc, br = sets(c.where("b <> ''"), "ck", "t", "cand", F.col("b").alias("bin")), sets(r.where("b2 <> ''"), "rk", "t2", "row", F.col("b2").alias("bin"))
    cosine = F.when((F.size("t") > 0) & (F.size("t2") > 0), F.size(F.array_intersect("t", "t2")) / F.sqrt(F.size("t") * F.size("t2"))).otherwise(0.0)
    score = lambda same, hinted=F.lit(False): F.round(F.least(F.lit(1.0), cosine + F.when(same, SAME_BIN).otherwise(0.0) + F.when(hinted, HINTED).otherwise(0.0)), 2)
    many = lambda *by: r.groupBy(F.col("rk").alias("row"), *by).agg(F.count("*").alias("n"), F.min("row").alias("least"))
    top = F.min(F.struct((-F.col("score")).alias("less"), "least"))
    any_bin = likely_pairs(kc, kr, threshold - ROUNDING).join(kc, "cand").join(kr, "row").select("cand", "row", score(F.lit(False)).alias("score")).where(F.col("score") >= threshold)
    any_bin = any_bin.join(many(), "row").groupBy(F.col("cand").alias("ck")).agg(F.sum("n").alias("n_any"), top.alias("top_any"))
    one_bin = likely_pairs(bc, br, threshold - SAME_BIN - ROUNDING, ("bin",), keep=("bin",)).join(kc, "cand").join(kr, "row").select("cand", "row", "bin", score(F.lit(False)).alias("plain"), score(F.lit(True)).alias("score")).where(F.col("score") >= threshold)
    one_bin = one_bin.join(many(F.col("b2").alias("bin")).where("bin <> ''"), ["row", "bin"]).groupBy(F.col("cand").alias("ck"), F.col("bin").alias("b")).agg(F.sum(F.when(F.col("plain") < threshold, F.col("n")).otherwise(0)).alias("n_bin"), top.alias("top_bin"))
    folder = c.where("d <> ''").select("cand", "d").join(r.where("lot_id is null").select("row", F.col("d2").alias("d")), "d").select("cand", "row")
    owned = r.select("row", "filed", F.explode(F.array_distinct("f2")).alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min("filed").alias("filed")).where((F.col("n") == 1) & F.expr("array_contains(filed, f)"))
    frame = c.select("cand", F.explode(F.array_distinct("f")).alias("f")).join(owned, "f").select("cand", "row")
    hinted = c.where("hint is not null").select("cand", F.col("hint").alias("row"))
    mark = lambda d, kind: d.select("cand", "row", F.lit(kind).alias("kind"))
    pairs = mark(folder.union(frame), "hard").unionByName(mark(hinted, "hint"))
    pairs = pairs.groupBy("cand", "row").agg(F.bool_or(F.col("kind") == "hard").alias("hard"), F.bool_or(F.col("kind") == "hint").alias("hinted"))
    pairs = pairs.join(c.select("cand", "t", "b"), "cand").join(r.select("row", "t2", "b2"), "row")
    same = (F.col("b") != "") & (F.col("b") == F.col("b2"))
    pairs = pairs.select("cand", "row", "hard", score(same).alias("plain"), score(same, F.col("hinted")).alias("score"))
    soft = ~F.col("hard") & (F.col("score") >= threshold)
    g = pairs.groupBy("cand").agg(F.count_if("hard").alias("n_hard"), (F.count_if(soft) - F.count_if(F.col("plain") >= threshold)).alias("n_more"), F.min(F.when(F.col("hard"), F.struct((-F.col("score")).alias("less"), F.col("row").alias("least")))).alias("top_hard"), F.min(F.when(soft, F.struct((-F.col("score")).alias("less"), F.col("row").alias("least")))).alias("top_soft"))
    out = c.select("cand", "ck", "b").join(g, "cand", "left").join(any_bin, "ck", "left").join(one_bin, ["ck", "b"], "left").fillna(0, ["n_hard", "n_more", "n_any", "n_bin"])
    best = F.coalesce("top_hard", F.least("top_soft", "top_any", "top_bin"))
    out = out.select("cand", "n_hard", (F.col("n_any") + F.col("n_bin") + F.col("n_more")).alias("n_soft"), best.alias("top"))
    action = F.when(F.col("n_hard") == 1, "attach").when(F.col("n_hard") + F.col("n_soft") > 0, "possible").otherwise("new")
    return out.select("cand", action.alias("action"), F.col("top.least").alias("best"), (-F.col("top.less")).alias("score"), "n_hard", "n_soft")


def calibrate(scores: DataFrame, query: str = "query_id", score: str = "score", look_alike: float = 3.0, gap: float = 0.05) -> DataFrame:
    """(query, n, top, z, gap, verdict): how far the best score of a query stands from its other scores (mean and spread) and from the next one."""
    w = Window.partitionBy(query).orderBy(F.desc(score))
    d = scores.withColumns({"r": F.row_number().over(w)})
    g = d.groupBy(query).agg(F.count("*").alias("n"), F.max(score).alias("top"), F.max(F.when(F.col("r") == 2, F.col(score))).alias("next"), F.median(F.when(F.col("r") > 1, F.col(score))).alias("mid"), F.stddev_pop(F.when(F.col("r") > 1, F.col(score))).alias("spread"))
    z, ahead = (F.col("top") - F.col("mid")) / F.nullif("spread", F.lit(0.0)), F.col("top") - F.col("next")
    verdict = F.when((z >= look_alike) & (ahead >= gap), "match").when(z >= look_alike, "several").otherwise("nothing")
    return g.select(query, "n", "top", z.alias("z"), ahead.alias("gap"), verdict.alias("verdict"))


def exclude(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not among ids; null keys stay."""
    return df.join(ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def index_append(index: DataFrame, new: DataFrame) -> DataFrame:
    """index (row, item_id, url, ...) and after it rows of new whose item_id and url it lacks, one for each pair, numbered on in their order.

    Numbers come from counts of hashed shards and places inside them, so no task numbers all rows.
    """
    keys = ["item_id", "url"]
    fresh = new.join(index.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)
    fresh = fresh.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(256)))
    sizes = fresh.groupBy("shard").agg(F.count("*").alias("size"))  # at most 256 rows
    start = sizes.withColumn("start", F.coalesce(F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    last = index.agg(F.coalesce(F.max("row"), F.lit(-1)).alias("last"))
    at = F.row_number().over(Window.partitionBy("shard").orderBy(*keys))
    fresh = fresh.withColumn("at", at).join(F.broadcast(start), "shard").join(F.broadcast(last)).withColumn("row", F.col("last") + F.col("start") + F.col("at"))
    return index.unionByName(fresh.select(*index.columns))


def text_gate(docs: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(doc_id, error) of all rules whose condition holds."""
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))).alias("error"))
