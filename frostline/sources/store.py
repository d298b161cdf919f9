"""Tables of the pipeline's state in a folder: wave partitions, logs, upserts, exports and reports.

A table is a folder of Parquet files under ``root``; the log of generated records is partitioned by wave, so that a
wave is read, overwritten and deleted by itself.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline.functions.guardrails import detailed

#: Tables that a reset never touches.
PROTECTED = ("access_audit",)


def shared_root(spark: SparkSession) -> str:
    """A new folder in the shared one that the session names."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='frostline-')}"
    return f"{base}/store-{uuid.uuid4().hex}"


def written(rows: DataFrame, label: str) -> DataFrame:
    """The rows, written once to a new shared folder and read back: what several steps use is computed once and survives lost executors."""
    path = f"{shared_root(rows.sparkSession)}/{label}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def append(self, name: str, rows: DataFrame, by: str | None = None) -> None:
        writer = rows.write.mode("append")
        (writer.partitionBy(by) if by else writer).parquet(self.path(name))

    def replace_waves(self, name: str, rows: DataFrame, by: str = "wave") -> None:
        """Overwrites just the partitions that the rows are of: an upsert by wave."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(self.path(name))

    def scan(self, name: str, wave: int | None = None, evolving: bool = False) -> DataFrame:
        """A whole table, or one wave of it, read from that partition alone. evolving: appended rows may have had other columns;
        all of them are there, null where a row has none."""
        rows = self.spark.read.option("mergeSchema", evolving).parquet(self.path(name))
        return rows if wave is None else rows.where(F.col("wave") == wave)

    def point(self, name: str, **key) -> DataFrame:
        """At most one row with such a key."""
        rows = self.scan(name)
        for c, value in key.items():
            rows = rows.where(F.col(c) == value)
        return rows.limit(1)

    def append_by_day(self, name: str, rows: DataFrame, ts: str = "ts") -> None:
        """Rows go to the partitions of the days of their timestamps; those without one have no day and never expire."""
        self.append(name, rows.withColumn("day", F.to_date(ts)), by="day")

    def remove_expired(self, name: str, first_day: datetime.date) -> int:
        """Removes the partitions of days before ``first_day``, by a listing of folders and without reading a row; tells how
        many. The rest of the last day goes when that day has passed as a whole; ``unexpired`` leaves it out of scans until
        then. Protected tables lose none."""
        if name in PROTECTED:
            return 0
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path(name))
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        days = [p.getPath() for p in files.listStatus(folder) if p.getPath().getName().startswith("day=")]
        # the partition of rows without a day sorts behind all dates
        old = [p for p in days if p.getName() < f"day={first_day.isoformat()}"]
        for p in old:
            files.delete(p, True)
        return len(old)

    def delete_wave(self, name: str, wave: int, dry_run: bool = False) -> int:
        """Rows of a wave; they are deleted unless it is a dry run. Protected tables lose none."""
        if name in PROTECTED:
            return 0
        n = self.scan(name, wave).count()
        if n and not dry_run:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/wave={wave}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return n

    def reset(self, names: tuple[str, ...] | None = None, wave: int | None = None, dry_run: bool = False) -> dict[str, int]:
        """Rows of each table (or of a wave of it), which are then deleted unless it is a dry run; protected tables are left out.

        A whole reset empties tables but keeps their folders; tables without waves have none of a wave.
        """
        counts = {}
        for name in names or self.tables():
            if name in PROTECTED or name not in self.tables():
                continue
            rows = self.scan(name)
            if wave is not None:
                counts[name] = self.delete_wave(name, wave, dry_run) if "wave" in rows.columns else 0
                continue
            counts[name] = rows.count()
            if not dry_run:
                self.spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(self.path(name))
        return counts

    def tables(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return sorted(x.getPath().getName() for x in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path))

    def export(self, out: str, drop: tuple[str, ...] = ("_id",)) -> list[str]:
        """Every table as JSON lines in a folder of its name."""
        for name in self.tables():
            self.scan(name).drop(*drop).write.mode("overwrite").json(f"{out}/{name}")
        return self.tables()


def merge_extras(rows: DataFrame, extras: dict[str, Column]) -> DataFrame:
    """Rows with an outcome's own fields: new ones are added, those of a known name take its place, null or not."""
    return rows.withColumns(extras)


def use_database(spark: SparkSession, wanted: str | None = None, hidden: tuple[str, ...] = ("admin", "config", "local")) -> str:
    """Makes a database current: the wanted one, or the default, or else the first in order of name that isn't hidden."""
    names = sorted(d.name for d in spark.catalog.listDatabases())
    open_ = [n for n in names if n not in hidden]
    chosen = wanted if wanted in names else "default" if wanted is None and "default" in names else next(iter(open_), None)
    if chosen is None:
        raise ValueError("no database")
    spark.catalog.setCurrentDatabase(chosen)
    return chosen


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key: what an upsert by that key leaves of appended rows."""
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r"))
    return newest.select("r.*")


def jsonl_kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines whose outcome is kept or not told; blank lines are no rows."""
    rows = spark.read.schema(schema).json(path)
    return rows.where(F.coalesce("outcome", F.lit("kept")) == "kept")


def union_of_keys(*parts: DataFrame) -> DataFrame:
    """All rows under the sorted union of their columns, as a CSV with one header needs them."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def violation_lines(hits: DataFrame, rules: str = "rules", detail: Column | None = None) -> DataFrame:
    """Rows with violations: the ids joined by ';' and the details by ' | '."""
    told = F.transform(detailed(F.col(rules)), lambda r: r["detail"]) if detail is None else detail
    return hits.where(F.size(rules) > 0).withColumns({"rule_ids": F.array_join(rules, ";"), "details": F.array_join(told, " | ")})


def key_violations(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that a unique index would reject, and how many rows have them. A key with a null counts like another."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unexpired(rows: DataFrame, now: Column, days: int = 30, ts: str = "ts") -> DataFrame:
    return rows.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def markdown(title: str, rows: DataFrame, most: int = 200) -> str:
    """A small frame (a report's rows, in its order) as a Markdown table; more rows than ``most`` are an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{title}: more than {most} rows")
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(rows.columns), line("-" * len(rows.columns)), *map(line, found), ""])


def report(title: str, facts: dict[str, object], sections: dict[str, DataFrame], most: int = 200) -> str:
    """A report as Markdown: a title, facts as lines, and a heading with a table for each section; an empty one says None.

    Sections are small frames in the order that they should show; more rows than ``most`` are an error.
    """
    lines = [f"# {title}", "", *(f"{k}: **{v}**" for k, v in facts.items()), ""]
    for heading, rows in sections.items():
        body = markdown(heading, rows, most).split("\n")[2:]
        lines += [f"## {heading}", "", *(body if len(body) > 3 else ["None.", ""])]
    return "\n".join(lines)


def joined_text(rows: DataFrame, *keys: str, text: str = "content", ts: str = "ts") -> DataFrame:
    """Texts of each key joined by newlines in order of time. A key's texts come together: for short logs."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(ts, text))), lambda x: x[text])
    return rows.groupBy(*keys).agg(F.array_join(parts, "\n").alias("joined"))


def ordered(rows: DataFrame, *columns: str, window: bool = False) -> DataFrame:
    """Rows in order; with ``window``, numbered as well (for bounded frames: the window has one partition)."""
    out = rows.orderBy(*columns)
    return out.withColumn("place", F.row_number().over(Window.orderBy(*columns))) if window else out
