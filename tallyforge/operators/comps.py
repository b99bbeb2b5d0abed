"""Comparable sales: annotating filters, price distributions, tiers, two-source merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

THIN, GOOD, TIGHT = 3, 8, 0.5
LEAST_FEEDBACK = 50
OUTLIER = 2.5


def _null_if(cond: Column, reason: str) -> Column:
    return F.when(cond, F.lit(reason))


#: Rows up to which figures by key are broadcast.
SMALL = 500_000


def _with_keys(d: DataFrame, figures: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """d with the figures of its keys (null keys too), broadcast if they are few."""
    f = figures.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & d[k].eqNullSafe(f[f"_k_{k}"])
    return d.join(F.broadcast(f) if f.count() <= SMALL else f, same, "left").drop(*[f"_k_{k}" for k in keys])


def annotate_comps(comps: DataFrame, unit: str = "single", tokens: tuple[str, ...] = (), condition: str | None = None, pool_thin: bool = True, keys: tuple[str, ...] = ("query",)) -> DataFrame:
    """comps with cohort and drop_reason: the first filter that a row fails, null if it is kept.

    Filters, in order: unit, tokens, plated, condition, exclusions. A used
    target with fewer than three rows of its cohort left keeps rows of unknown
    condition as well; that count is over `keys`.
    """
    title, multi = F.col("title"), S.looks_multi_item(F.col("title"))
    wrong = {"single": multi, "pair": ~S.looks_pair_unit(title), "lot": ~multi}[unit]
    reason = [_null_if(wrong, f"unit_match:{unit}")]
    for t in tokens:
        reason.append(_null_if(~F.lower(title).contains(t.lower()), f"same_item_tokens:{t.lower()}"))
    asked = " ".join(tokens).lower()
    solid = F.lit(asked).rlike(S.SOLID) & ~F.lit(asked).rlike("plate|filled|vermeil|rolled|overlay|gold tone|gold-tone")
    reason.append(_null_if(solid & S.is_plated(title), "plated_not_solid"))
    d = comps.withColumn("cohort", S.condition_cohort(F.col("condition"))).withColumn("_early", F.coalesce(*reason))
    target = "any" if condition is None else {"new": "new", "used": "used"}.get(condition.lower(), "any")
    if target == "any":
        cond = F.lit(None).cast("string")
    else:
        # Counts by key are added up and joined, so no task sorts all comps of a key.
        near = d.groupBy(*keys).agg(F.count(F.when(F.col("_early").isNull() & (F.col("cohort") == target), 1)).alias("_near"))
        d = _with_keys(d, near, keys)
        pooled = (F.col("_near") < THIN) & F.lit(pool_thin and target == "used")
        cond = _null_if((F.col("cohort") != target) & ~(pooled & (F.col("cohort") == "unknown")), f"condition_cohort:{target}")
    out = F.coalesce(
        "_early",
        cond,
        _null_if(F.coalesce("bo_accepted", F.lit(False)), "exclusions:best offer accepted"),
        _null_if(F.lower(F.coalesce("listing_type", F.lit(""))).contains("auction") & (F.col("bids_count") <= 1), "exclusions:single-bid auction"),
        _null_if(F.col("seller_feedback_score") < LEAST_FEEDBACK, "exclusions:seller feedback"),
    )
    return d.withColumn("drop_reason", out).drop("_early", "_near")


def filter_log(annotated: DataFrame) -> DataFrame:
    """(filter, removed): rows that each filter dropped."""
    name = F.split("drop_reason", ":")[0]
    return annotated.where("drop_reason is not null").groupBy(name.alias("filter")).agg(F.count("*").alias("removed"))


def distribution(kept: DataFrame, keys: list[str], price: str = "price", digits: int = 2, exact: bool = True, ceiling: str | None = None) -> DataFrame:
    """keys, n, min, max, median, p25, p75, iqr, dispersion, fences; linear interpolation, approximate if not exact. ceiling: a column whose maximum is added."""
    p = F.percentile(price, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.9))) if exact else F.percentile_approx(price, [0.25, 0.5, 0.75, 0.9], 10000)
    g = kept.groupBy(*keys).agg(F.count(price).alias("n"), F.min(price).alias("lo"), F.max(price).alias("hi"), p.alias("p"), *([F.max(ceiling).alias("ceiling")] if ceiling else []))
    q1, med, q3, p90 = (F.col("p")[i] for i in range(4))
    r = lambda c, n: F.round(c, digits).alias(n)
    iqr = q3 - q1
    return g.select(
        *keys, "n", r(F.col("lo"), "min"), r(F.col("hi"), "max"), r(med, "median"), r(q1, "p25"), r(q3, "p75"), r(p90, "p90"), r(iqr, "iqr"),
        F.round(iqr / F.nullif(med, F.lit(0.0)), 3).alias("dispersion"), r(q1 - 1.5 * iqr, "fence_low"), r(q3 + 1.5 * iqr, "fence_high"), *(["ceiling"] if ceiling else []),
    )


def confidence(n: Column, dispersion: Column) -> Column:
    return F.when(n < THIN, "thin").when((n >= GOOD) & (dispersion <= TIGHT), "good").otherwise("partial")


def price_tiers(annotated: DataFrame, keys: list[str], run: str = "run", price: str = "price") -> DataFrame:
    """keys, n, confidence, conservative, recommended, push_high, needs_vetting: p25, median and the highest survivor.

    The distribution is over the best-match run, or the price-high run where
    there is no best match; the ceiling is over the price-high run, if any. A
    ceiling of more than 2.5 medians needs vetting. Thin sets have no tiers.
    """
    # Which runs a key has is added up and joined: annotated is read twice, as columns of a few bytes, and not sorted.
    best, top = F.col(run) == "best_match", F.col(run) == "price_high"
    runs = annotated.groupBy(*keys).agg(F.max(best).alias("_bm"), F.max(top).alias("_ph"))
    kept = _with_keys(annotated.where("drop_reason is null").select(*keys, run, price), runs, keys)
    in_rep, in_top = ~F.coalesce("_bm", F.lit(False)) | best, ~F.coalesce("_ph", F.lit(False)) | top
    j = distribution(kept.withColumn("_rep", F.when(in_rep, F.col(price))).withColumn("_top", F.when(in_top, F.col(price))), keys, "_rep", 4, ceiling="_top").where("n > 0")
    thin = F.col("n") < THIN
    high = F.coalesce("ceiling", "p90")
    tier = lambda c, n: F.when(~thin, S.whole_dollar(c)).alias(n)
    return j.select(
        *keys, "n", confidence(F.col("n"), F.col("dispersion")).alias("confidence"), tier(F.col("p25"), "conservative"), tier(F.col("median"), "recommended"), tier(high, "push_high"),
        F.when(~thin, F.coalesce(F.col("ceiling") > OUTLIER * F.col("median"), F.lit(False))).alias("needs_vetting"),
    )


def cap_at_new(tiers: DataFrame, new_prices: DataFrame, keys: list[str], pct: float = 0.75, target: bool = False) -> DataFrame:
    """Tiers capped at a share of the price of a new item (new_price); with target the recommended one is raised to it too."""
    j = tiers.join(new_prices, keys, "left")
    cap = F.when(F.col("new_price") > 0, F.round(F.col("new_price") * pct, 2))
    rec = F.greatest("recommended", cap) if target else F.col("recommended")
    held = lambda c: F.when(cap.isNull() | c.isNull(), c).otherwise(F.least(c, cap))
    return j.select(
        *keys, held(F.col("conservative")).alias("conservative"), F.when(F.col("recommended").isNotNull(), held(rec)).alias("recommended"), held(F.col("push_high")).alias("push_high"),
        cap.alias("cap"), F.coalesce(F.when(F.col("new_price") > 0, F.col("push_high") >= F.col("new_price")), F.lit(False)).alias("above_new"),
    )


def charm_pattern(listings: DataFrame, keys: list[str], seller: str = "seller", price: str = "price", min_sellers: int = 3, min_listings: int = 5, majority: float = 0.6) -> DataFrame:
    """keys, pattern, share, n_sellers, n_listings, reason: the price ending that most competing listings have, if that can be trusted."""
    d = listings.where(F.col(seller).isNotNull() & (F.col(price) > 0)).withColumn("ending", S.charm_ending(F.col(price)))
    per = d.groupBy(*keys, "ending").agg(F.count("*").alias("c"))
    top = per.groupBy(*keys).agg(F.max(F.struct("c", "ending")).alias("t"), F.sum("c").alias("n_listings"))
    j = top.join(d.groupBy(*keys).agg(F.countDistinct(seller).alias("n_sellers")), keys)
    share = F.round(F.col("t.c") / F.col("n_listings"), 3)
    reason = F.when((F.col("n_listings") < min_listings) | (F.col("n_sellers") < min_sellers), "too few competitors").when(share < majority, "no majority ending").when(F.col("t.ending") == "other", "top ending is other")
    return j.select(*keys, F.when(reason.isNull(), F.col("t.ending")).alias("pattern"), share.alias("share"), "n_sellers", "n_listings", reason.alias("reason"))


def merge_sources(primary: DataFrame, secondary: DataFrame, key: str = "item_id", order: tuple[str, ...] = ("sold_date",)) -> DataFrame:
    """Primary rows, and the first secondary row of each id that primary does not have; null ids stay. comp_source tells which."""
    w = Window.partitionBy(key).orderBy(*order)
    one = secondary.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | F.col(key).isNull()).drop("_n")
    fresh = one.join(primary.select(key).distinct(), key, "left_anti")
    return primary.withColumn("comp_source", F.lit("primary")).unionByName(fresh.withColumn("comp_source", F.lit("secondary")), allowMissingColumns=True)


def compare_sources(a: DataFrame, b: DataFrame, keys: list[str], key: str = "item_id", price: str = "price") -> DataFrame:
    """keys, matched, same_price, differ, widest: how two sources agree on the ids they share."""
    j = a.select(*keys, key, F.col(price).alias("pa")).join(b.select(*keys, key, F.col(price).alias("pb")), [*keys, key])
    gap = F.abs(F.col("pa") - F.col("pb"))
    return j.groupBy(*keys).agg(F.count("*").alias("matched"), F.count_if(gap < 0.01).alias("same_price"), F.count_if(gap >= 0.01).alias("differ"), F.round(F.max(gap), 2).alias("widest"))


def compare_offers(a: DataFrame, b: DataFrame, keys: list[str], key: str = "item_id", price: str = "price", offer: str = "bo_accepted") -> DataFrame:
    """keys, matched, same_price, differ, offers, offers_agreed, offers_below: two sources on shared ids, accepted offers apart.

    For an accepted offer a shows what was asked and b what was paid, so its
    prices are not held against each other: offers_agreed counts those that b
    marks too, offers_below those it has at a lower price. Prices under a cent
    apart are one; an unknown mark is no offer, an unknown price counts as 0.
    """
    side = lambda d, n: d.where(F.col(key).isNotNull()).select(*keys, key, F.coalesce(F.col(price), F.lit(0)).alias(f"_p{n}"), F.coalesce(F.col(offer), F.lit(False)).alias(f"_o{n}"))
    j = side(a, "a").join(side(b, "b"), [*keys, key])
    near, oa = F.abs(F.col("_pa") - F.col("_pb")) < 0.01, F.col("_oa")
    c = lambda cond, n: F.count_if(cond).alias(n)
    return j.groupBy(*keys).agg(F.count("*").alias("matched"), c(~oa & near, "same_price"), c(~oa & ~near, "differ"), c(oa, "offers"), c(oa & F.col("_ob"), "offers_agreed"), c(oa & (F.col("_pb") < F.col("_pa") - 0.005), "offers_below"))


def capture_quality(comps: DataFrame, keys: list[str]) -> DataFrame:
    c = lambda cond, n: F.count_if(cond).alias(n)
    return comps.groupBy(*keys).agg(F.count("*").alias("n"), c(F.col("total_price").isNotNull(), "with_delivered"), c(F.col("bo_accepted"), "n_bo_accepted"), c(F.col("condition").isNull(), "no_condition"), c(S.charm_ending(F.col("price")) != "other", "n_charm"))


def seller_rollup(comps: DataFrame, seller: str = "seller", price: str = "price", kind: str = "kind") -> DataFrame:
    """seller, n, total, median_price, max_price, top_kinds (three, by count then name), best_feedback."""
    kinds = comps.groupBy(seller, kind).agg(F.count("*").alias("c"))
    w = Window.partitionBy(seller).orderBy(F.desc("c"), kind)
    top = kinds.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy(seller).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", kind))), lambda x: x[kind]), ",").alias("top_kinds"))
    g = comps.groupBy(seller).agg(F.count("*").alias("n"), F.sum(F.col(price).cast(S.Money)).alias("total"), F.round(F.percentile(price, 0.5), 4).alias("median_price"), F.max(price).alias("max_price"), F.max("seller_feedback_score").alias("best_feedback"))
    return g.join(top, seller)


def landscape(comps: DataFrame, actives: DataFrame, seller: str = "seller") -> DataFrame:
    """seller, n_sold, realized, n_active, ask_total: what each seller sold and has on offer."""
    s = comps.groupBy(seller).agg(F.count("*").alias("n_sold"), F.sum(F.col("price").cast(S.Money)).alias("realized"))
    a = actives.groupBy(seller).agg(F.count("*").alias("n_active"), F.sum(F.col("price").cast(S.Money)).alias("ask_total"))
    return s.join(a, seller, "left").select(seller, "n_sold", "realized", F.coalesce("n_active", F.lit(0)).alias("n_active"), "ask_total")
