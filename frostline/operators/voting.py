"""Self-consistency over judges' replies: votes of mixed types decide by median or by mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Least agreement, characters of joined rationales, what is told of an item without votes.
FLOOR, RATIONALE_CHARS, NO_VOTES = 0.6, 2000, "all judge votes unparseable"
#: A rationale and its separator take two characters at least, so that no more than these can show.
_MOST_RATIONALES = RATIONALE_CHARS // 2 + 1


def parsed(reply: Column) -> Column:
    """A reply's JSON object, from its first { to its last }, as a variant; null where there is none."""
    return F.try_parse_json(F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit("")))


def typed_votes(replies: DataFrame) -> DataFrame:
    """(item, position, number, said, rationale) of replies (item, position, reply) that hold a verdict.

    number: of numbers, and of truth values as 0 and 1; null for others. said: any verdict as text, True and False for truth
    values. A missing rationale is ''. Replies without an object, a verdict, or with a null one are no votes.
    """
    v = replies.select("item", "position", parsed(F.col("reply")).alias("v"))
    v = v.select("item", "position", F.try_variant_get("v", "$.verdict", "variant").alias("verdict"), F.try_variant_get("v", "$.rationale", "string").alias("rationale"))
    kind = F.schema_of_variant("verdict")
    truth = F.try_variant_get("verdict", "$", "boolean")
    number = F.when(kind == "BOOLEAN", truth.cast("int").cast("double")).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get("verdict", "$", "double"))
    said = F.when(kind == "BOOLEAN", F.when(truth, "True").otherwise("False")).otherwise(F.try_variant_get("verdict", "$", "string"))
    said = F.coalesce(said, F.to_json("verdict"))
    return v.where(F.col("verdict").isNotNull() & ~F.is_variant_null("verdict")).select("item", "position", number.alias("number"), said.alias("said"), F.coalesce("rationale", F.lit("")).alias("rationale"))


def consensus(replies: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(item, n_votes, number, said, agreement, escalated, rationale) of replies (item, position, reply).

    If all votes of an item are numbers: their median, and the share of votes within 1e-6 of it. Otherwise the most common
    text, the first seen of equally common ones, and its share. Agreement under the floor escalates. Rationales are
    joined in order. An item without votes has agreement 0 and escalates.

    Votes are counted by value before they meet, and of rationales only as many as can show: an item of very many votes is
    no large group.
    """
    votes = typed_votes(replies)
    values = votes.groupBy("item", "said").agg(F.count("*").alias("n"), F.min("position").alias("seen"), F.max("number").alias("number"), F.count_if(F.col("number").isNull()).alias("texts"))
    decided = values.groupBy("item").agg(
        F.sum("n").alias("n_votes"), (F.sum("texts") == 0).alias("numeric"), F.percentile("number", 0.5, F.col("n")).alias("median"),
        F.max_by("said", F.struct("n", -F.col("seen"))).alias("mode"), F.max("n").alias("most"),
    )
    near = F.sum(F.when(F.abs(F.col("number") - F.col("median")) <= 1e-6, F.col("n")).otherwise(0))
    at_median = values.join(decided.where("numeric").select("item", "median"), "item").groupBy("item").agg(near.alias("near"))
    first = Window.partitionBy("item").orderBy("position")
    shown = votes.select("item", "position", "rationale", F.row_number().over(first).alias("place")).where(F.col("place") <= _MOST_RATIONALES)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place", "rationale"))), lambda x: x["rationale"])
    shown = shown.groupBy("item").agg(F.substring(F.array_join(texts, "; "), 1, RATIONALE_CHARS).alias("rationale"))
    out = replies.select("item").distinct().join(decided, "item", "left").join(at_median, "item", "left").join(shown, "item", "left")
    agreement = F.coalesce(F.when(F.col("numeric"), F.col("near")).otherwise(F.col("most")) / F.col("n_votes"), F.lit(0.0))
    return out.select(
        "item", F.coalesce("n_votes", F.lit(0)).alias("n_votes"), F.when(F.col("numeric"), F.col("median")).alias("number"), F.when(~F.col("numeric"), F.col("mode")).alias("said"),
        agreement.alias("agreement"), (agreement < floor).alias("escalated"), F.coalesce("rationale", F.lit(NO_VOTES)).alias("rationale"),
    )


def with_strict(decided: DataFrame, strict: DataFrame) -> DataFrame:
    """Consensus in which a strict judge's reply (item, reply; one an item) decides where votes escalated: with agreement 1
    and its own rationale. Replies without a verdict decide nothing, and neither does one on an item without votes."""
    told = typed_votes(strict.withColumn("position", F.lit(0))).select("item", *(F.col(c).alias(f"strict_{c}") for c in ("number", "said", "rationale")))
    taken = F.col("escalated") & (F.col("n_votes") > 0) & F.col("strict_said").isNotNull()
    out = decided.join(told, "item", "left")
    pick = lambda theirs, mine: F.when(taken, theirs).otherwise(F.col(mine)).alias(mine)
    said = F.when(F.col("strict_number").isNull(), F.col("strict_said"))
    return out.select("item", "n_votes", pick(F.col("strict_number"), "number"), pick(said, "said"), pick(F.lit(1.0), "agreement"), "escalated", pick(F.col("strict_rationale"), "rationale"))
