"""Queries of saved pages: threads made of the conversations and sold-listing pages made of the order lines, read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import elements as E
from .views import table, with_views

# A user's post quotes the answer that follows it: its article lies inside.
THREADS = r"""SELECT conv_id AS thread, array_join(transform(array_sort(collect_list(struct(turn, post))), x -> x.post), ' ') AS html FROM (
  SELECT conv_id, turn, '<article id="p' || turn || '" class="cPost ipsComment"><aside><h3 class="x ipsType_break"> <b>' || role || turn || '</b></h3><ul><li>' || CASE WHEN turn % 3 = 0 THEN 'Advanced Member' WHEN turn % 3 = 1 THEN 'Moderators' ELSE 'Ohio' END || '</li><li>' || CASE WHEN turn % 2 = 0 THEN '1,204' ELSE '2.5k' END || '</li></ul></aside><!-- <article> --><div data-role=''commentContent''><p>'
    || replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;') || '</p>' || CASE WHEN turn % 2 = 0 AND has_next THEN '' ELSE '</div></article>' || CASE WHEN turn % 2 = 1 THEN '</div></article>' ELSE '' END END AS post
  FROM (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) = turn + 1 AS has_next FROM {c})) GROUP BY conv_id"""
CARDS = """SELECT order_id AS page_id, '<ul class="results">' || array_join(transform(array_sort(collect_list(struct(pos, card))), x -> x.card), '') || '</ul>' AS html FROM (
  SELECT order_id, pos, CASE WHEN pos = 6 THEN '<div><h2>Results matching fewer words</h2></div>' ELSE '' END || '<li class="s-card wide"><ul><li>new</li><li>seen</li></ul><a href="https://shop.example/itm/' || CASE WHEN part % 5 = 0 THEN '12345' ELSE CAST(100000000 + part AS STRING) END || '?x=1"><img src="u.png"></a>'
    || '<div class="s-card__title"><span>Part &amp; ' || part || '</span><span class="clipped">Opens in a new window or tab</span></div><span class="s-card__price">$' || item_price || '</span><span>Sold  ' || date_format(sold_at, 'MMM d, yyyy') || '</span>'
    || CASE pos % 3 WHEN 0 THEN '<p>Free delivery</p>' WHEN 1 THEN '<p>+$4.50 delivery</p>' ELSE '' END || CASE pos % 4 WHEN 0 THEN '<i>3 bids</i>' WHEN 1 THEN '<i>or Best Offer</i>' WHEN 2 THEN '<i>Best offer accepted</i>' ELSE '' END
    || CASE WHEN supplier % 2 = 0 THEN '<p>s' || supplier || '</p><p>99.5% positive (1.2K)</p>' ELSE '<p>s' || supplier || ' 100% positive (905)</p>' END || '</li>' AS card FROM {lines}) GROUP BY order_id"""


def s13(spark, d):
    return E.thread_posts(spark.sql(THREADS, c=table(spark, d, "conversations"))).select("thread", "i", "author", "group", "posts", "rep", "text")


def order_lines(spark, d):
    """As the view lines, as far as cards need it, numbered by the column that pages are grouped by: one shuffle serves both."""
    t = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "order_id")
    pos = F.row_number().over(Window.partitionBy("order_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"))
    return t.select("order_id", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").cast("date").alias("sold_at"), F.col("l_extendedprice").cast("decimal(18,2)").alias("item_price"), pos.alias("pos"))


def s12(spark, d):
    return E.sold_cards(spark.sql(CARDS, lines=order_lines(spark, d))).drop("i")


QUERIES = {"s12_sold_cards": s12, "s13_thread_posts": s13}

ORACLE = {
    k: with_views(v)
    for k, v in {
        "s12_sold_cards": """SELECT order_id AS page_id, CAST(100000000 + part AS VARCHAR) AS item_id, 'Part & ' || part AS title, item_price AS sold_price, sold_at AS sold_date, CAST(CASE pos % 3 WHEN 0 THEN 0 WHEN 1 THEN 4.5 END AS DECIMAL(18,2)) AS shipping_cost,
          CASE pos % 4 WHEN 0 THEN 'Auction' WHEN 1 THEN 'Buy It Now or Best Offer' WHEN 2 THEN 'Best Offer' END AS listing_type, CASE WHEN pos % 4 = 0 THEN CAST(3 AS BIGINT) END AS bids_count, pos % 4 = 2 AS bo_accepted, 's' || supplier AS seller, CASE WHEN supplier % 2 = 0 THEN 99.5 ELSE 100.0 END::DOUBLE AS seller_pct, CAST(CASE WHEN supplier % 2 = 0 THEN 1200 ELSE 905 END AS BIGINT) AS seller_score
          FROM {lines} WHERE part % 5 <> 0 AND pos < 6""",
        "s13_thread_posts": r"""WITH c AS (SELECT *, trim(regexp_replace(coalesce(text, ''), '[ \t\r\n\f\v]+', ' ', 'g'), ' ') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, lead(turn) OVER w = turn + 1 AS nx, lead(text) OVER w AS nt, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
          q AS (SELECT *, role || turn AS author, CASE turn % 3 WHEN 0 THEN 'Advanced Member' WHEN 1 THEN 'Moderators' END AS "group", CAST(CASE WHEN turn % 2 = 0 THEN 1204 ELSE 2500 END AS BIGINT) AS posts, CASE turn % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 3.5 ELSE 1.0 END AS w FROM c),
          r AS (SELECT *, CASE (turn + 1) % 3 WHEN 0 THEN 'Advanced Member' WHEN 1 THEN 'Moderators' ELSE 'Ohio' END AS ng FROM q)
          SELECT conv_id AS thread, CAST(i AS INTEGER) AS i, author, coalesce("group", CASE WHEN turn % 2 = 0 AND nx AND ng <> 'Ohio' THEN ng END) AS "group", CASE WHEN turn % 2 = 0 AND nx THEN 2500 ELSE posts END AS posts,
            round(CASE WHEN "group" IS NULL AND turn % 2 = 0 AND nx AND ng <> 'Ohio' THEN CASE WHEN ng = 'Moderators' THEN 3.5 ELSE 2.0 END ELSE w END * log10((CASE WHEN turn % 2 = 0 AND nx THEN 2500 ELSE posts END) + 10), 3) AS rep,
            CASE WHEN turn % 2 = 0 AND nx THEN trim(t || ' ' || nr || (turn + 1) || ' ' || ng || ' 2.5k ' || trim(regexp_replace(coalesce(nt, ''), '[ \t\r\n\f\v]+', ' ', 'g'), ' ')) ELSE t END AS text FROM r""",
    }.items()
}
