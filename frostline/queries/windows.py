"""Windows, sorts, limits, set operations and membership, as the pipeline uses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline.catalog import _LOG, _funnel
from frostline.registry import query
from frostline.sources.adapters import table


@query("SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), 2) AS running FROM lineitem")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(w), 2).alias("running"))


@query(_LOG + "SELECT jurisdiction AS key, count(*) AS n, count(*) FILTER (n_rules > 0) AS violations, round(avg((n_rules > 0)::INT), 6) AS rate, row_number() OVER (ORDER BY jurisdiction) AS place FROM f GROUP BY jurisdiction ORDER BY key")
def rate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted by key; the window sees one row a key."""
    hit = F.size("rules") > 0
    rates = _funnel(spark, sf_dir).groupBy(F.col("jurisdiction").alias("key")).agg(F.count("*").alias("n"), F.count_if(hit).alias("violations"), F.round(F.avg(hit.cast("int")), 6).alias("rate"))
    return rates.withColumn("place", F.row_number().over(Window.orderBy("key"))).orderBy("key")


@query(_LOG + "SELECT outcome, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, outcome) AS place FROM f WHERE outcome <> 'kept' GROUP BY outcome ORDER BY n DESC, outcome")
def drop_reasons_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _funnel(spark, sf_dir).where("outcome <> 'kept'").groupBy("outcome").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "outcome"))).orderBy(F.desc("n"), "outcome")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 3")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the limit is the feature."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(3)


@query(_LOG + "SELECT doc_id, cell FROM f WHERE outcome = 'kept' ORDER BY doc_id LIMIT 20")
def first_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's first rows: the limit is the feature."""
    return _funnel(spark, sf_dir).where("outcome = 'kept'").orderBy("doc_id").limit(20).select("doc_id", "cell")


@query("SELECT event_id FROM events ORDER BY sha256('7:' || event_id), event_id LIMIT 100")
def shuffled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay of so many records in an order that a seed decides: the limit is the feature."""
    digest = F.sha2(F.concat(F.lit("7:"), F.col("event_id").cast("string")).cast("binary"), 256)
    return table(spark, sf_dir, "events").select("event_id", digest.alias("d")).orderBy("d", "event_id").limit(100).select("event_id")


@query("SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).subtract(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT l_returnflag AS label FROM lineitem UNION SELECT l_linestatus FROM lineitem")
def label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both columns in one scan."""
    return table(spark, sf_dir, "lineitem").select(F.explode(F.array("l_returnflag", "l_linestatus")).alias("label")).distinct()


@query("SELECT 'c' AS side, c_nationkey AS nation FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier")
def bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda name, t, c: table(spark, sf_dir, t).select(F.lit(name).alias("side"), F.col(c).alias("nation"))
    return side("c", "customer", "c_nationkey").unionAll(side("s", "supplier", "s_nationkey"))


@query("SELECT text_hash, count(*) AS n FROM (SELECT sha256(text) AS text_hash FROM documents WHERE text IS NOT NULL) GROUP BY text_hash HAVING count(*) > 1")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))
    return hashed.groupBy("text_hash").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi and anti joins on the order's key; each order is in one of them."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    are = orders.join(returned, "o_orderkey", "left_semi").withColumn("returned", F.lit(True))
    return are.unionByName(orders.join(returned, "o_orderkey", "left_anti").withColumn("returned", F.lit(False)))


@query(_LOG + "SELECT wave, count(*) FILTER (outcome = 'kept') * 1.0::DOUBLE / greatest(count(*), 1) AS kept_rate, coalesce(max(wave), 0) AS last_wave FROM f GROUP BY wave")
def conditional_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.count_if(F.col("outcome") == "kept") / F.greatest(F.count("*"), F.lit(1))
    return _funnel(spark, sf_dir).groupBy("wave").agg(rate.alias("kept_rate"), F.coalesce(F.max("wave"), F.lit(0)).alias("last_wave"))


@query(_LOG + "SELECT 'all' AS log, coalesce(max(wave), 0) AS last_wave FROM f UNION ALL SELECT 'none', coalesce(max(wave), 0) FROM f WHERE wave > 1000")
def last_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last wave of the log, and of one without rows."""
    log = _funnel(spark, sf_dir).select("wave")
    last = lambda rows, name: rows.agg(F.coalesce(F.max("wave"), F.lit(0)).alias("last_wave")).select(F.lit(name).alias("log"), "last_wave")
    return last(log, "all").unionByName(last(log.where("wave > 1000"), "none"))
