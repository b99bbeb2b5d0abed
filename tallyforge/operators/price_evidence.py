"""Evidence that a price must have: a sold pull that ran, an operator's own price, or the line of a one-off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import Money

# The lines of a price note, as patterns.
OPERATOR_LINE = r"(?m)^\s*OPERATOR PRICE:\s*\S"
BROWSER_LINE = r"(?m)^[ \t]*B\s*·\s*Browser\s*:\s*([A-Z]+)?([^\n]*(?:\n(?![ \t]*C\s*·\s*Chrome\s*:)[ \t]+[^\s][^\n]*)*)"
NONE_KEPT = r"n_kept\s*=\s*0\b"
ONE_OFF_LINE = r"(?m)^\s*ONE-OFF:\s*(.*)$"
HISTORIAN = r"(?i)historian\s+([^·]*)"
PUSH_HIGH = r"(?i)push-high\s*\$?\s*([\d,]+(?:\.\d+)?)"


def sold_proofs(comps: DataFrame, key: str = "sku") -> DataFrame:
    """The distinct keys with a sold row in comps (stage, url, listing_type, note): of stage B or C, with an address, no ask."""
    kind = F.lower(F.concat_ws(" ", "listing_type", "note"))
    return comps.where(F.upper(F.trim("stage")).isin("B", "C") & (F.trim("url") != "") & ~kind.rlike("active|asking")).select(key).distinct()


def price_evidence_issues(drafts: DataFrame, comps: DataFrame, key: str = "sku") -> DataFrame:
    """(key, issues) of drafts (listing_id, note, saved, format, best_offer, price): what is missing, an empty array if nothing is.

    note is the text of the price note, null where there is none; saved tells
    whether a run of the pull is on file. A listed draft, or one with an
    operator's price, needs no more. Issues: no_note; no_pull_line; no_sold_rows
    (the pull says it ran, but neither a file nor sold rows in comps show it);
    not_pulled (any other state); and of a pull without usable sales no_one_off,
    no_historian, no_best_offer, no_push_high, below_push_high. An auction needs
    the historian only. A null price is below any.
    """
    note = F.regexp_replace("note", "\r\n?", "\n")
    proven = sold_proofs(comps, key).withColumn("_sold", F.lit(True))
    d = drafts.join(proven, key, "left").withColumn("_note", note)
    d = d.withColumn("_pull", F.regexp_extract("_note", BROWSER_LINE, 1)).withColumn("_block", F.regexp_extract("_note", BROWSER_LINE, 0)).withColumn("_line", F.regexp_extract("_note", ONE_OFF_LINE, 1))
    push = F.regexp_replace(F.regexp_extract("_line", PUSH_HIGH, 1), ",", "").try_cast(Money)
    auction = F.upper(F.coalesce("format", F.lit("FIXED_PRICE"))) == "AUCTION"
    each = lambda *rules: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    one = lambda n: F.array(F.lit(n))
    none = F.array().cast("array<string>")
    one_off = (
        F.when(~F.col("_note").rlike(ONE_OFF_LINE), one("no_one_off"))
        .when(F.trim(F.regexp_extract("_line", HISTORIAN, 1)) == "", one("no_historian"))
        .when(auction, none)
        .otherwise(each(("no_best_offer", ~F.coalesce("best_offer", F.lit(False))), ("no_push_high", push.isNull()), ("below_push_high", push.isNotNull() & F.coalesce(F.col("price") < push, F.lit(True)))))
    )
    seen = F.coalesce("saved", F.lit(False)) | F.coalesce("_sold", F.lit(False))
    issues = (
        F.when(F.trim(F.coalesce(F.col("listing_id").cast("string"), F.lit(""))) != "", none)
        .when(F.col("_note").isNull(), one("no_note"))
        .when(F.col("_note").rlike(OPERATOR_LINE), none)
        .when(F.col("_block") == "", one("no_pull_line"))
        .when((F.col("_pull") == "RAN") & ~seen, one("no_sold_rows"))
        .when((F.col("_pull") == "THIN") | ((F.col("_pull") == "RAN") & F.col("_block").rlike(NONE_KEPT)), one_off)
        .when(F.col("_pull") == "RAN", none)
        .otherwise(one("not_pulled"))
    )
    return d.select(key, issues.alias("issues"))
