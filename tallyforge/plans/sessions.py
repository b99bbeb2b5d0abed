"""Session, conversation, label and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asks as K
from ..operators import economics as Q
from ..operators import lookalike as L
from ..operators import sessions as E
from .views import bind, table, with_views

THRESHOLDS = [0.0, 500.0, 1000.0, 2000.0, 4000.0]


def w6(spark, d):
    return E.active_time(bind(spark, d, "calls"))


def a21(spark, d):
    return E.session_summary(bind(spark, d, "calls"))


def w10(spark, d):
    return E.repeats(bind(spark, d, "calls"))


def w9(spark, d):
    return E.pair_calls(bind(spark, d, "calls")).select("event_id", "before", "same")


def w8(spark, d):
    return E.segment_asks(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user").groupBy("conv_id", "segment").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


def _labelled(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")), "doc_id")


def a24(spark, d):
    j = _labelled(spark, d)
    return K.threshold_sweep(j, "score", "quality", THRESHOLDS).select("threshold", "kept", "right_kept", "wrong_kept")


def a24_shares(spark, d):
    """A thousand thresholds in one pass over the rows."""
    return K.threshold_sweep(_labelled(spark, d), "score", "quality", [float(10 * i) for i in range(1_000)])


def a24_bands(spark, d):
    return K.agreement_by_band(_labelled(spark, d), "score", "quality", [0, 100, 500, 1000, 2000, 4000, 100000])


#: Words by which an ask's stage is told.
STAGES = {"BUY": ["purchase", "cart"], "LOOK": ["view"], "TROUBLE": ["error", "fail"], "ACT": ["click", "sign"]}


def _asks(spark, d):
    t = bind(spark, d, "calls").withColumns({"tokens": F.col("value").cast("decimal(18,2)"), "text": F.col("kind")})
    return K.asks(t, STAGES, F.col("event_id") % 16 == 0)


def a21_asks(spark, d):
    return _asks(spark, d)


def a21_stages(spark, d):
    return K.by_stage(_asks(spark, d))


def a21_hot_spots(spark, d):
    return K.hot_spots(_asks(spark, d)).select("session", "place", "segment", "turns", "stage")


def w10_friction(spark, d):
    calls = table(spark, d, "events").select(F.col("user_id").alias("session"), F.concat_ws(":", "event_type", "props").alias("signature"))
    return K.friction(_asks(spark, d), calls)


def w10_runs(spark, d):
    return K.runs(bind(spark, d, "calls"), "kind", least=3)


#: Dollars a million tokens by prefix of a model: input, output, and what reading a cache costs of the input rate.
RATES = "VALUES ('c', 4.0D, 20.0D, CAST(NULL AS DOUBLE)), ('click', 2.0D, 10.0D, 0.05D), ('view', 1.0D, 5.0D, 0.1D), ('viewer', 9.0D, 9.0D, 0.1D)"


def a23_costs(spark, d):
    """Cost of each session: models by longest prefix, counts of tokens from the value."""
    rates = spark.sql(f"SELECT * FROM {RATES} AS r(prefix, rate_in, rate_out, read)")
    n = F.floor(F.col("value")).cast("long")
    calls = bind(spark, d, "calls").select("session", F.col("kind").alias("model"), n.alias("fresh"), (n * 2).alias("out"), F.when(F.col("event_id") % 2 == 0, n * 3).alias("written"), (n * 10).alias("read_n"))
    c = Q.with_rates(calls, rates, (3.0, 15.0)).withColumn("cost", Q.cost(F.col("fresh"), F.col("out"), F.col("written"), F.col("read_n")))
    return c.groupBy("session").agg(F.count("*").alias("n"), F.sum(F.col("cost").cast("decimal(28,10)")).cast("decimal(28,6)").alias("cost"))


def _pairs(spark, d):
    k = F.col("event_id")
    e = bind(spark, d, "calls").select("session", "ts", "event_id", (k % 7).alias("call_id"), F.when(F.floor(k / 7) % 2 == 0, "call").otherwise("result").alias("type"), F.col("kind").alias("name"), (k % 5 == 0).alias("background"))
    return Q.paired_calls(e)


def w9_by_id(spark, d):
    return _pairs(spark, d).select("session", "call_id", "name", "started", "ended", "background")


def a23_blocking(spark, d):
    return Q.blocking(_pairs(spark, d), ["session", "name"], F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-25").cast("timestamp_ntz"))


def a23_context(spark, d):
    """The p90 by index of each session's values, by the grouped aggregate."""
    return bind(spark, d, "calls").groupBy("session").agg(Q.index_quantile(0.9)("value").alias("p90"))


def a23_waits(spark, d):
    """Waiting of an hour's turns at gates, of paired calls by two names."""
    p = _pairs(spark, d)
    gates = p.where("name = 'error'").select("session", "started", "ended")
    turns = p.where("name = 'view'").select("session", F.concat_ws("-", F.col("call_id").cast("string"), F.col("started").cast("string")).alias("turn"), "started", "ended")
    return Q.waits(gates, turns).select("session", F.round("waited").cast("long").alias("waited")).groupBy("session").agg(F.count("*").alias("turns"), F.sum("waited").alias("waited"))


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("item"), "embedding"), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def v1(spark, d):
    return L.nearest(*_vectors(spark, d), 5, own=True).select("query_id", F.col("item").alias("vec_id"), "place")


def v1_recall(spark, d):
    """Whether the index finds nine tenths of what the exact way finds."""
    index, queries = _vectors(spark, d)
    r = L.recall(L.nearest_indexed(index, queries, 5, own=True), L.nearest(index, queries, 5, own=True))
    return r.select("wanted", (F.col("recall") >= 0.9).alias("reached"))


def v1_products(spark, d):
    """Products of ten images each (the queries), listings of three (the index): best image of both, and the price signal."""
    e = table(spark, d, "embeddings").withColumn("model", F.lit("m"))
    index, queries = e.select(F.floor(F.col("vec_id") / 3).alias("item"), "embedding", "model"), e.where("vec_id % 10 = 0").select(F.floor(F.col("vec_id") / 100).alias("query_id"), "embedding", "model")
    L.refuse_mixed(index, queries)
    found = L.nearest(index, queries, 5)
    prices = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    return found.select("query_id", "item", "place").join(L.price_signal(found, prices), "query_id", "left")


def x3(spark, d):
    """Batch twin of the stream of daily sales in the reporting zone."""
    from ..functions.scalars import to_report_date

    return bind(spark, d, "calls").groupBy(to_report_date(F.col("ts").cast("timestamp")).alias("day")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))


QUERIES = {"w6_active_time": w6, "a21_session_summary": a21, "w10_repeats": w10, "w9_pair_calls": w9, "w8_segment_asks": w8, "a24_threshold_sweep": a24, "a24_shares": a24_shares, "a24_bands": a24_bands, "a21_asks": a21_asks, "a21_stages": a21_stages, "a21_hot_spots": a21_hot_spots, "w10_friction": w10_friction, "w10_runs": w10_runs, "a23_costs": a23_costs, "w9_pairs_by_id": w9_by_id, "a23_blocking": a23_blocking, "a23_context": a23_context, "a23_waits": a23_waits, "v1_nearest": v1, "v1_index_recall": v1_recall, "v1_products": v1_products, "x3_daily_batch_twin": x3}

ORACLE = {
    k: with_views(v)
    for k, v in {
        "w6_active_time": "WITH e AS (SELECT *, lead(ts) OVER (PARTITION BY session ORDER BY ts, event_id) AS nx FROM {calls}), s AS (SELECT session, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(floor(epoch(nx)) AS BIGINT) AS n FROM e) SELECT session, CAST(coalesce(sum(CASE WHEN n IS NOT NULL THEN least(n - t, 300) END), 0) AS BIGINT) AS active_s, max(t) - min(t) AS wall_s FROM s GROUP BY 1",
        "a21_session_summary": "WITH p AS (SELECT session, kind, count(*) AS c FROM {calls} GROUP BY 1, 2), t AS (SELECT session, kind, row_number() OVER (PARTITION BY session ORDER BY c DESC, kind DESC) AS r FROM p), g AS (SELECT session, count(*) AS n, count(DISTINCT kind) AS kinds, sum(CAST(value AS DECIMAL(18,4))) AS total FROM {calls} GROUP BY 1) SELECT g.session, n, kinds, total, kind AS top_kind FROM g JOIN t ON g.session = t.session AND r = 1",
        "w10_repeats": "SELECT session, kind, count(*) AS times FROM {calls} GROUP BY 1, 2 HAVING count(*) >= 3",
        "w9_pair_calls": "WITH b AS (SELECT event_id, kind, lag(kind) OVER (PARTITION BY session ORDER BY ts, event_id) AS before FROM {calls}) SELECT event_id, before, coalesce(kind = before, false) AS same FROM b",
        "w8_segment_asks": "WITH s AS (SELECT conv_id, text, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS segment FROM conversations) SELECT conv_id, segment, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM s GROUP BY 1, 2",
        "a24_threshold_sweep": "WITH j AS (SELECT quality, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id)), t AS (SELECT unnest([0.0, 500.0, 1000.0, 2000.0, 4000.0])::DOUBLE AS threshold) SELECT threshold, count(*) FILTER (s >= threshold) AS kept, count(*) FILTER (s >= threshold AND quality = 1) AS right_kept, count(*) FILTER (s >= threshold AND quality = 0) AS wrong_kept FROM t, j GROUP BY 1",
        "a24_shares": "WITH j AS (SELECT quality, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL), t AS (SELECT CAST(10 * i AS DOUBLE) AS threshold FROM range(1000) x(i)), k AS (SELECT threshold, count(*) FILTER (s >= threshold) AS kept, count(*) FILTER (s >= threshold AND quality = 1) AS right_kept, count(*) AS n FROM t, j GROUP BY 1) SELECT threshold, kept, kept / n AS kept_share, right_kept, kept - right_kept AS wrong_kept, right_kept / nullif(kept, 0) AS agree FROM k",
        "a24_bands": "WITH j AS (SELECT quality, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id)), e AS (SELECT unnest([0, 100, 500, 1000, 2000, 4000])::DOUBLE AS low, unnest([100, 500, 1000, 2000, 4000, 100000])::DOUBLE AS high) SELECT low, high, count(*) AS n, count(*) FILTER (quality = 1) / count(*) AS agree FROM e JOIN j ON s >= low AND s < high GROUP BY 1, 2",
        "a21_asks": """WITH c AS (SELECT *, sum(CASE WHEN event_id % 16 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, event_id) AS segment FROM {calls}),
          h AS (SELECT session, segment, count(*) FILTER (event_id % 16 <> 0) AS turns, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds, sum(CAST(value AS DECIMAL(18,2))) AS tokens, sum(CAST((length(kind) - length(replace(kind, 'purchase', ''))) / 8 AS INTEGER) + CAST((length(kind) - length(replace(kind, 'cart', ''))) / 4 AS INTEGER)) AS h0, sum(CAST((length(kind) - length(replace(kind, 'view', ''))) / 4 AS INTEGER)) AS h1, sum(CAST((length(kind) - length(replace(kind, 'error', ''))) / 5 AS INTEGER) + CAST((length(kind) - length(replace(kind, 'fail', ''))) / 4 AS INTEGER)) AS h2, sum(CAST((length(kind) - length(replace(kind, 'click', ''))) / 5 AS INTEGER) + CAST((length(kind) - length(replace(kind, 'sign', ''))) / 4 AS INTEGER)) AS h3 FROM c GROUP BY 1, 2),
          a AS (SELECT session, CAST(segment AS BIGINT) AS segment, turns, seconds, tokens, CASE greatest(h0, h1, h2, h3) WHEN 0 THEN 'OTHER' WHEN h0 THEN 'BUY' WHEN h1 THEN 'LOOK' WHEN h2 THEN 'TROUBLE' ELSE 'ACT' END AS stage, turns >= 25 AS long_loop FROM h) SELECT * FROM a""",
        "a21_stages": """WITH c AS (SELECT *, sum(CASE WHEN event_id % 16 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, event_id) AS segment FROM {calls}),
          h AS (SELECT session, segment, count(*) FILTER (event_id % 16 <> 0) AS turns, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds, sum(CAST(value AS DECIMAL(18,2))) AS tokens, sum(CAST((length(kind) - length(replace(kind, 'purchase', ''))) / 8 AS INTEGER) + CAST((length(kind) - length(replace(kind, 'cart', ''))) / 4 AS INTEGER)) AS h0, sum(CAST((length(kind) - length(replace(kind, 'view', ''))) / 4 AS INTEGER)) AS h1, sum(CAST((length(kind) - length(replace(kind, 'error', ''))) / 5 AS INTEGER) + CAST((length(kind) - length(replace(kind, 'fail', ''))) / 4 AS INTEGER)) AS h2, sum(CAST((length(kind) - length(replace(kind, 'click', ''))) / 5 AS INTEGER) + CAST((length(kind) - length(replace(kind, 'sign', ''))) / 4 AS INTEGER)) AS h3 FROM c GROUP BY 1, 2),
          a AS (SELECT session, CAST(segment AS BIGINT) AS segment, turns, seconds, tokens, CASE greatest(h0, h1, h2, h3) WHEN 0 THEN 'OTHER' WHEN h0 THEN 'BUY' WHEN h1 THEN 'LOOK' WHEN h2 THEN 'TROUBLE' ELSE 'ACT' END AS stage, turns >= 25 AS long_loop FROM h) SELECT session, stage, count(*) AS asks, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(least(seconds, 3600)) AS BIGINT) AS seconds, sum(tokens) AS tokens FROM a GROUP BY 1, 2""",
        "a21_hot_spots": """WITH c AS (SELECT *, sum(CASE WHEN event_id % 16 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, event_id) AS segment FROM {calls}),
          h AS (SELECT session, segment, count(*) FILTER (event_id % 16 <> 0) AS turns, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds, sum(CAST(value AS DECIMAL(18,2))) AS tokens, sum(CAST((length(kind) - length(replace(kind, 'purchase', ''))) / 8 AS INTEGER) + CAST((length(kind) - length(replace(kind, 'cart', ''))) / 4 AS INTEGER)) AS h0, sum(CAST((length(kind) - length(replace(kind, 'view', ''))) / 4 AS INTEGER)) AS h1, sum(CAST((length(kind) - length(replace(kind, 'error', ''))) / 5 AS INTEGER) + CAST((length(kind) - length(replace(kind, 'fail', ''))) / 4 AS INTEGER)) AS h2, sum(CAST((length(kind) - length(replace(kind, 'click', ''))) / 5 AS INTEGER) + CAST((length(kind) - length(replace(kind, 'sign', ''))) / 4 AS INTEGER)) AS h3 FROM c GROUP BY 1, 2),
          a AS (SELECT session, CAST(segment AS BIGINT) AS segment, turns, seconds, tokens, CASE greatest(h0, h1, h2, h3) WHEN 0 THEN 'OTHER' WHEN h0 THEN 'BUY' WHEN h1 THEN 'LOOK' WHEN h2 THEN 'TROUBLE' ELSE 'ACT' END AS stage, turns >= 25 AS long_loop FROM h), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY session ORDER BY turns DESC, segment) AS INTEGER) AS place FROM a WHERE turns > 0) SELECT session, place, segment, turns, stage FROM r WHERE place <= 5""",
        "w10_friction": """WITH c AS (SELECT *, sum(CASE WHEN event_id % 16 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, event_id) AS segment FROM {calls}),
          h AS (SELECT session, segment, count(*) FILTER (event_id % 16 <> 0) AS turns, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds, sum(CAST(value AS DECIMAL(18,2))) AS tokens, sum(CAST((length(kind) - length(replace(kind, 'purchase', ''))) / 8 AS INTEGER) + CAST((length(kind) - length(replace(kind, 'cart', ''))) / 4 AS INTEGER)) AS h0, sum(CAST((length(kind) - length(replace(kind, 'view', ''))) / 4 AS INTEGER)) AS h1, sum(CAST((length(kind) - length(replace(kind, 'error', ''))) / 5 AS INTEGER) + CAST((length(kind) - length(replace(kind, 'fail', ''))) / 4 AS INTEGER)) AS h2, sum(CAST((length(kind) - length(replace(kind, 'click', ''))) / 5 AS INTEGER) + CAST((length(kind) - length(replace(kind, 'sign', ''))) / 4 AS INTEGER)) AS h3 FROM c GROUP BY 1, 2),
          a AS (SELECT session, CAST(segment AS BIGINT) AS segment, turns, seconds, tokens, CASE greatest(h0, h1, h2, h3) WHEN 0 THEN 'OTHER' WHEN h0 THEN 'BUY' WHEN h1 THEN 'LOOK' WHEN h2 THEN 'TROUBLE' ELSE 'ACT' END AS stage, turns >= 25 AS long_loop FROM h) SELECT session, 'long_loop' AS kind, CAST(segment AS VARCHAR) AS detail, turns AS times FROM a WHERE long_loop UNION ALL SELECT user_id, 'repeat', concat_ws(':', event_type, props), count(*) FROM events GROUP BY 1, 3 HAVING count(*) >= 3""",
        "w10_runs": "WITH n AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER (PARTITION BY session ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM {calls}), r AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts, event_id) AS run FROM n) SELECT session, kind, first(event_id ORDER BY ts, event_id) AS first, last(event_id ORDER BY ts, event_id) AS last, count(*) AS length FROM r GROUP BY session, run, kind HAVING count(*) >= 3",
        "a23_costs": """WITH c AS (SELECT session, kind, CAST(floor(value) AS BIGINT) AS n, event_id FROM {calls}), r AS (SELECT session, n, event_id, CASE WHEN kind LIKE 'click%' THEN 2.0 WHEN kind LIKE 'view%' THEN 1.0 WHEN kind LIKE 'c%' THEN 4.0 ELSE 3.0 END::DOUBLE AS i, CASE WHEN kind LIKE 'click%' THEN 10.0 WHEN kind LIKE 'view%' THEN 5.0 WHEN kind LIKE 'c%' THEN 20.0 ELSE 15.0 END::DOUBLE AS o, CASE WHEN kind LIKE 'click%' THEN 0.05 ELSE 0.1 END::DOUBLE AS f FROM c)
          SELECT session, count(*) AS n, CAST(sum(CAST((n * i + 2 * n * o + CASE WHEN event_id % 2 = 0 THEN 3 * n ELSE 0 END * i * 1.25::DOUBLE + 10 * n * (i * f)) / 1000000 AS DECIMAL(28,10))) AS DECIMAL(28,6)) AS cost FROM r GROUP BY 1""",
        "w9_pairs_by_id": """WITH e AS (SELECT *, event_id % 7 AS call_id, (event_id // 7) % 2 = 0 AS call FROM {calls}), b AS (SELECT *, lag(call) OVER w AS was_call, lag(kind) OVER w AS name, lag(ts) OVER w AS started, lag(event_id % 5 = 0) OVER w AS background FROM e WINDOW w AS (PARTITION BY session, call_id ORDER BY ts, event_id)),
          p AS (SELECT session, call_id, name, started, ts AS ended, background FROM b WHERE NOT call AND was_call) SELECT * FROM p""",
        "a23_blocking": """WITH e AS (SELECT *, event_id % 7 AS call_id, (event_id // 7) % 2 = 0 AS call FROM {calls}), b AS (SELECT *, lag(call) OVER w AS was_call, lag(kind) OVER w AS name, lag(ts) OVER w AS started, lag(event_id % 5 = 0) OVER w AS background FROM e WINDOW w AS (PARTITION BY session, call_id ORDER BY ts, event_id)),
          p AS (SELECT session, call_id, name, started, ts AS ended, background FROM b WHERE NOT call AND was_call) SELECT session, name, count(*) AS calls, CAST(sum(epoch_us(ended) - epoch_us(started)) / 1000000.0 AS DECIMAL(28,6)) AS seconds FROM p WHERE NOT background AND started >= TIMESTAMP '2024-01-05' AND started < TIMESTAMP '2024-01-25' GROUP BY 1, 2""",
        "a23_context": "WITH r AS (SELECT session, value, row_number() OVER (PARTITION BY session ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM {calls} WHERE value IS NOT NULL) SELECT session, max(value) FILTER (i = least(CAST(floor(n * 0.9::DOUBLE) AS BIGINT), n - 1)) AS p90 FROM r GROUP BY 1",
        "a23_waits": """WITH e AS (SELECT *, event_id % 7 AS call_id, (event_id // 7) % 2 = 0 AS call FROM {calls}), b AS (SELECT *, lag(call) OVER w AS was_call, lag(kind) OVER w AS name, lag(ts) OVER w AS started, lag(event_id % 5 = 0) OVER w AS background FROM e WINDOW w AS (PARTITION BY session, call_id ORDER BY ts, event_id)),
          p AS (SELECT session, call_id, name, started, ts AS ended, background FROM b WHERE NOT call AND was_call), o AS (SELECT t.session, t.call_id, t.started, CAST(round(sum(epoch_us(least(t.ended, g.ended)) - epoch_us(greatest(t.started, g.started))) / 1e6) AS BIGINT) AS waited FROM p t JOIN p g ON t.session = g.session AND t.name = 'view' AND g.name = 'error' AND greatest(t.started, g.started) < least(t.ended, g.ended) GROUP BY 1, 2, 3) SELECT session, count(*) AS turns, CAST(sum(waited) AS BIGINT) AS waited FROM o GROUP BY 1""",
        "v1_index_recall": "SELECT 5 * count(*) AS wanted, true AS reached FROM embeddings WHERE vec_id % 100 = 0",
        "v1_products": """WITH s AS (SELECT CAST(floor(q.vec_id / 100) AS BIGINT) AS query_id, CAST(floor(e.vec_id / 3) AS BIGINT) AS item, max(round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12)) AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 10 = 0 GROUP BY 1, 2),
          r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS INTEGER) AS place FROM s), f AS (SELECT * FROM r WHERE place <= 5),
          g AS (SELECT query_id, count(*) AS n, min(price) AS lo, max(price) AS hi, list_sort(list(price)) AS p FROM f JOIN (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS price FROM part) x ON p_partkey = item GROUP BY 1)
          SELECT f.query_id, item, place, n, lo, p[CAST(len(p) // 2 + 1 AS INTEGER)] AS middle, hi FROM f LEFT JOIN g USING (query_id)""",
        "v1_nearest": "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) SELECT query_id, vec_id, place FROM r WHERE place <= 5",
    }.items()
}
