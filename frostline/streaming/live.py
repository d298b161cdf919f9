"""Streams over folders of records: running totals, flagged rows, log sinks, their progress, quantile sketches."""

from __future__ import annotations

import datetime
import math
import time
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .arrival import paced
from .replay import screen

# Dispositions that records may have.
DISPOSITIONS = ("accept", "hold_for_qa", "reject", "insufficient_data", "expedite_sale")

#: How often a log sink writes.
FLUSH = "500 milliseconds"


def arriving(spark: SparkSession, folder: str, schema: str, kind: str = "parquet", files_per_batch: int | None = None, pattern: str | None = None) -> DataFrame:
    """A stream of the files of a folder, so many a batch, of names like a pattern."""
    reader = spark.readStream.schema(schema).format(kind)
    for option, value in (("maxFilesPerTrigger", files_per_batch), ("pathGlobFilter", pattern)):
        if value is not None:
            reader = reader.option(option, value)
    return reader.load(folder)


def running_totals(records: DataFrame) -> DataFrame:
    """(kind, name, n): records and violations in all, by disposition and by rule; final state equals that of a table."""
    hit = screen(records)
    told = F.flatten(
        F.array(
            F.array(F.struct(F.lit("all").alias("kind"), F.lit("records").alias("name"))),
            F.when(F.size("rules") > 0, F.array(F.struct(F.lit("all").alias("kind"), F.lit("violations").alias("name")))).otherwise(F.array().cast("array<struct<kind:string,name:string>>")),
            F.array(F.struct(F.lit("disposition").alias("kind"), F.col("disposition").alias("name"))),
            F.transform("rules", lambda r: F.struct(F.lit("rule").alias("kind"), r.alias("name"))),
        )
    )
    return hit.select(F.explode(told).alias("t")).groupBy("t.kind", "t.name").agg(F.count("*").alias("n"))


def flagged(records: DataFrame) -> DataFrame:
    """Rows with violations as they arrive."""
    return screen(records).where(F.size("rules") > 0)


def run_to_end(rows: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that has arrived, into Parquet files under ``out`` (with its checkpoint beside), and reads these.

    In complete mode each batch replaces what was there, so the last state stays.
    """
    spark, schema = rows.sparkSession, rows.schema
    if mode == "complete":
        writer = rows.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/rows"))
    else:
        writer = rows.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/rows")
    writer.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows")


def batch_writer(out: str, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """Writes a batch into partitions by date and batch id, in place of what these held: a replayed batch adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumns({"date": F.to_date(ts), "batch": F.lit(batch_id)})
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(f"{out}/rows")

    return write


def log_sink(rows: DataFrame, out: str, ts: str = "ts", delay: float | None = None) -> StreamingQuery:
    """Writes log rows in short batches, each exactly once in effect, to folders by date, so that old days are dropped whole.

    A sink that dies between writing a batch and noting it writes that batch again on its next start, over itself. Sources are
    held back, not dropped from. delay: seconds between batches; 0 ends with what has arrived.
    """
    writer = rows.writeStream.foreachBatch(batch_writer(out, ts)).option("checkpointLocation", f"{out}/state")
    return (writer.trigger(processingTime=FLUSH) if delay is None else paced(writer, delay)).start()


def drop_expired(spark: SparkSession, out: str, today: datetime.date, days: int = 30) -> list[str]:
    """Deletes the date folders of a log that are older than so many days; their names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/rows")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    last = (today - datetime.timedelta(days=days)).isoformat()
    old = [x.getPath() for x in fs.listStatus(root) if x.getPath().getName().startswith("date=") and x.getPath().getName()[5:] < last]
    for path in old:
        fs.delete(path, True)
    return sorted(x.getName() for x in old)


def observed(records: DataFrame) -> DataFrame:
    """Screened records whose stream tells, with each batch, how many came, how many broke a rule, and how many of each disposition."""
    told = [F.count_if(F.col("disposition") == d).alias(d) for d in DISPOSITIONS]
    return screen(records).observe("screened", F.count(F.lit(1)).alias("records"), F.count_if(F.size("rules") > 0).alias("violations"), *told)


class Progress(StreamingQueryListener):
    """Totals of streams over all their batches: the progress that a query keeps itself is that of its last 100."""

    def __init__(self) -> None:
        self.totals: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.totals.setdefault(str(event.id), {"batches": 0, "rows": 0, "ms": 0, "last": -1, "rate": 0.0, "counts": Counter()})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        t = self.totals.get(str(p.id))
        # a trigger without rows names the batch to come
        if t is None or not p.numInputRows or p.batchId <= t["last"]:
            return
        t["last"] = p.batchId
        t["batches"] += 1
        t["rows"] += p.numInputRows
        t["ms"] += p.durationMs.get("triggerExecution", 0)
        t["rate"] = p.processedRowsPerSecond
        for row in p.observedMetrics.values():
            t["counts"].update(row.asDict())

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def status(self, query: StreamingQuery) -> dict:
        """Batches, rows and violations so far, rows a second now, mean milliseconds of a batch, the three most common dispositions."""
        t = self.totals.get(str(query.id)) or {"batches": 0, "rows": 0, "ms": 0, "rate": 0.0, "counts": Counter()}
        seen = [(d, t["counts"][d]) for d in DISPOSITIONS if t["counts"][d]]
        top = sorted(seen, key=lambda x: (-x[1], x[0]))[:3]
        return {"batches": t["batches"], "rows": t["rows"], "violations": t["counts"]["violations"], "rows_per_second": t["rate"], "mean_ms": t["ms"] / t["batches"] if t["batches"] else 0.0, "top": top}

    def line(self, query: StreamingQuery) -> str:
        """The status as one line of text."""
        s = self.status(query)
        share = 100 * s["violations"] / s["rows"] if s["rows"] else 0.0
        return f"{s['rows']} records, {s['rows_per_second']:.1f} a second, {s['violations']} violations ({share:.1f} %), " + ", ".join(f"{d}={n}" for d, n in s["top"])


def settled(seen: Progress, query: StreamingQuery, seconds: float = 30.0) -> dict:
    """The status once the listener, which hears of batches a little later, has heard of the query's last one."""
    last, began = query.lastProgress, time.monotonic()
    wanted = max((p["batchId"] for p in query.recentProgress if p["numInputRows"]), default=-1) if last else -1
    while seen.totals.get(str(query.id), {"last": -1})["last"] < wanted:
        if time.monotonic() - began > seconds:
            raise TimeoutError("the listener has not heard of the last batch")
        time.sleep(0.05)
    return seen.status(query)


#: Values up to which a quantile sketch tells nothing apart.
LEAST_VALUE = 1e-9


def sketched(rows: DataFrame, key: str, value: str, error: float = 0.01) -> DataFrame:
    """(key, bucket, n, total): a sketch of each key's values whose quantiles are off by at most ``error`` of themselves.

    Bucket b holds values of (g**(b - 1), g**b], g being (1 + error) / (1 - error): counts add up over batches, tasks and
    sketches, and there are at most some thousand buckets whatever arrives. Works on tables and on streams (complete mode).
    """
    g = (1 + error) / (1 - error)
    bucket = F.when(F.col(value) <= LEAST_VALUE, F.lit(-(1 << 31))).otherwise(F.ceil(F.ln(value) / math.log(g)).cast("int"))
    return rows.where(F.col(value).isNotNull()).groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def summary_of(sketch: DataFrame, key: str, share: float = 0.99, error: float = 0.01) -> DataFrame:
    """(key, n, mean, quantile) of a sketch: the value at place max(1, int(n share)), or of the last if that is none, within the error."""
    g = (1 + error) / (1 - error)
    w = Window.partitionBy(key)
    r = sketch.withColumns({"all": F.sum("n").over(w), "sum": F.sum("total").over(w), "upto": F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))})
    place = F.floor(F.col("all") * share)
    place = F.when(place < 1, F.col("all")).otherwise(place)
    middle = F.when(F.col("bucket") == -(1 << 31), 0.0).otherwise(2 * F.pow(F.lit(g), "bucket") / (g + 1))
    return r.where((F.col("upto") >= place) & (F.col("upto") - F.col("n") < place)).select(key, F.col("all").alias("n"), (F.col("sum") / F.col("all")).alias("mean"), middle.alias("quantile"))
