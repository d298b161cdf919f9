"""Streams over the events: registered queries run to their end and return the final state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.registry import query
from frostline.sources.adapters import table
from frostline.sources.store import shared_root
from frostline.streaming import arrival, live

_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
_RECORD = """SELECT event_id, CASE WHEN event_type = 'error' THEN 'product_code=1' WHEN event_id % 50 = 0 THEN 'please expedite this sale' ELSE 'fine' END AS rendered_text, CASE event_id % 3 WHEN 0 THEN 'accept' ELSE 'reject' END AS disposition FROM events"""
_HITS = f"WITH r AS ({_RECORD}), h AS (SELECT *, CASE WHEN rendered_text LIKE 'product%' THEN 'GCC-EDGE-018' WHEN rendered_text LIKE 'please%' THEN 'GCC-EDGE-015' END AS rule FROM r)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of records. The table is one file or a folder of them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    events = live.arriving(spark, f"{sf_dir}/events.parquet" if folder else sf_dir, _EVENTS, files_per_batch=1, pattern="*.parquet" if folder else "events.parquet")
    return events.selectExpr(
        "event_id", "CASE WHEN event_type = 'error' THEN 'product_code=1' WHEN event_id % 50 = 0 THEN 'please expedite this sale' ELSE 'fine' END AS rendered_text", "'chat_message' AS artifact_type",
        "CASE event_id % 3 WHEN 0 THEN 'accept' ELSE 'reject' END AS disposition",
    )


@query(_HITS + " SELECT 'all' AS kind, 'records' AS name, count(*) AS n FROM h UNION ALL SELECT 'all', 'violations', count(*) FROM h WHERE rule IS NOT NULL HAVING count(*) > 0 UNION ALL SELECT 'disposition', disposition, count(*) FROM h GROUP BY disposition UNION ALL SELECT 'rule', rule, count(*) FROM h WHERE rule IS NOT NULL GROUP BY rule")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.run_to_end(live.running_totals(_records(spark, sf_dir)), shared_root(spark), "complete")


@query(_HITS + " SELECT event_id, disposition, rule FROM h WHERE rule IS NOT NULL")
def stream_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live.run_to_end(live.flagged(_records(spark, sf_dir)), shared_root(spark))
    return rows.select("event_id", "disposition", F.element_at("rules", 1).alias("rule"))


_SUMMARY = """WITH b AS (SELECT event_type, ceil(ln(value) / ln(1.01::DOUBLE / 0.99::DOUBLE))::INT AS bucket, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY event_type) AS every, sum(total) OVER (PARTITION BY event_type) AS whole, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS upto FROM b),
p AS (SELECT *, CASE WHEN floor(every * 0.99::DOUBLE) < 1 THEN every ELSE floor(every * 0.99::DOUBLE) END AS place FROM c)
SELECT event_type, every::BIGINT AS n, round(whole / every, 6) AS mean, round(2 * pow(1.01::DOUBLE / 0.99::DOUBLE, bucket) / (1.01::DOUBLE / 0.99::DOUBLE + 1), 6) AS p99 FROM p WHERE upto >= place AND upto - n < place"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream: their order by seed, in files of about a twentieth each."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    folder = f"{shared_root(spark)}/staged"
    arrival.stage(arrival.in_order(events, "event_id", seed=7), folder, max(1, events.count() // 20))
    return arrival.arriving_files(spark, folder, "event_id long, ts timestamp, event_type string, value double, place long")


@query(_SUMMARY)
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and p99 (within 1 %) of each kind of event, from a sketch that the stream carries over its batches."""
    sketch = live.run_to_end(live.sketched(_events(spark, sf_dir), "event_type", "value"), shared_root(spark), "complete")
    return live.summary_of(sketch, "event_type").select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("quantile", 6).alias("p99"))


@query("SELECT event_id, row_number() OVER (ORDER BY sha256('42:' || event_id)) AS place FROM events QUALIFY place <= 5000")
def seeded_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first events of a seeded order: a limit is the feature."""
    return arrival.in_order(table(spark, sf_dir, "events").select("event_id"), "event_id", seed=42, limit=5000)


@query("WITH p AS (SELECT row_number() OVER (ORDER BY sha256('7:' || event_id)) AS place, greatest(1, (SELECT count(*) FROM events) // 20) AS size FROM events) SELECT ((place - 1) // size)::INT AS batch, count(*) AS n, min(place) AS first_place, max(place) AS last_place FROM p GROUP BY 1")
def stream_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which places of the seeded order each batch of the stream brought."""
    out = shared_root(spark)
    live.log_sink(_events(spark, sf_dir), out, delay=0).awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.groupBy(F.col("batch").cast("int").alias("batch")).agg(F.count("*").alias("n"), F.min("place").alias("first_place"), F.max("place").alias("last_place"))


@query("SELECT event_id, CAST(ts AS DATE) AS date FROM events")
def stream_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log sink over the events, run twice: the second run finds nothing new."""
    out, events = shared_root(spark), _events(spark, sf_dir)
    for _ in range(2):
        live.log_sink(events, out, delay=0).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("event_id", "date")


@query("SELECT CASE event_id % 3 WHEN 0 THEN 'accept' ELSE 'reject' END AS disposition, count(*) AS n, (SELECT count(*) FROM events) AS records, (SELECT count(*) FROM events WHERE event_type = 'error' OR event_id % 50 = 0) AS violations FROM events GROUP BY ALL")
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the listener has added up at the end of the stream, from the metrics that each batch observed."""
    seen = live.Progress()
    spark.streams.addListener(seen)
    try:
        rows = live.observed(_records(spark, sf_dir))
        q = rows.writeStream.format("noop").option("checkpointLocation", f"{shared_root(spark)}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        said = live.settled(seen, q)
    finally:
        spark.streams.removeListener(seen)
    return spark.createDataFrame([(d, n, said["rows"], said["violations"]) for d, n in said["top"]], "disposition string, n long, records long, violations long")
