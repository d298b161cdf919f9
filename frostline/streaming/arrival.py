"""Arrival control: in which order, how many and how fast the rows of a table stream in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from frostline.sources.store import written

#: Parts that a seeded order is made in.
BUCKETS = 256
_WITHIN = (1 << 33) - 1


def in_order(rows: DataFrame, key: str, seed: int | None = None, limit: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows with their place (from 1) in the order of arrival; only the first ``limit`` ones, if one is given.

    With a seed the order is that of the digests of seed and key: the same for the same seed, whatever the partitioning.
    Leading bits of a digest deal rows into buckets; each bucket is ordered by itself, and the counts of those before give its
    first place, so nothing is sorted as a whole, and buckets beyond the limit are not read twice. Without a seed rows arrive
    as they are stored. Rows of equal keys are ordered by all their columns.
    """
    if seed is None:
        dealt = rows.withColumns({"_at": F.monotonically_increasing_id().bitwiseAND(_WITHIN), "_bucket": F.spark_partition_id()})
    else:
        digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"), 256)
        lead = F.conv(F.substring("_at", 1, 8), 16, 10).cast("long")
        dealt = rows.withColumn("_at", digest).withColumn("_bucket", F.shiftright(lead * buckets, 32).cast("int"))
    counts = dealt.groupBy("_bucket").agg(F.count("*").alias("n"))
    # one row a bucket
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select("_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")), "arrival-buckets")
    if limit is not None:
        offsets = offsets.where(F.col("_before") < limit)
    dealt = dealt.join(F.broadcast(offsets), "_bucket")
    if seed is None:
        place = F.col("_before") + F.col("_at") + 1
    else:
        place = F.col("_before") + F.row_number().over(Window.partitionBy("_bucket").orderBy("_at", *rows.columns))
    out = dealt.withColumn("place", place).drop("_bucket", "_at", "_before")
    return out if limit is None else out.where(F.col("place") <= limit)


def stage(ordered: DataFrame, folder: str, per_file: int) -> int:
    """Writes rows with a place as files of ``per_file`` rows each, in folders ``file=0`` and so on, and dates the files in
    order, which is the order that a file stream takes them in. How many files there are."""
    spark = ordered.sparkSession
    numbered = ordered.withColumn("file", F.floor((F.col("place") - 1) / per_file).cast("int"))
    numbered.repartition("file").sortWithinPartitions("file", "place").write.partitionBy("file").parquet(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [x.getPath() for x in fs.listStatus(root) if x.isDirectory()]
    began = spark._jvm.java.lang.System.currentTimeMillis() - 1000 * (len(folders) + 1)
    for path in folders:
        for x in fs.listStatus(path):
            fs.setTimes(x.getPath(), began + 1000 * int(path.getName().split("=")[1]), -1)
    return len(folders)


def arriving_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of staged files, one a batch; the columns are those of the schema, and the file's number."""
    return spark.readStream.schema(f"{schema}, file int").option("maxFilesPerTrigger", 1).parquet(folder)


def paced(writer: DataStreamWriter, delay: float = 0.0) -> DataStreamWriter:
    """A batch every ``delay`` seconds, until the query is stopped; without a delay all that has arrived, as fast as it goes."""
    return writer.trigger(processingTime=f"{delay} seconds") if delay > 0 else writer.trigger(availableNow=True)
