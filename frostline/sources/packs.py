"""Rule packs and country profiles: dimensions that are loaded from JSON, looked up, checked and joined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The pack that holds for every country.
BASE = "GCC"
# Keys that every country profile has.
REQUIRED_KEYS = (
    "meta", "competent_authorities", "legal_framework", "standards_framework", "food_business_requirements", "labelling", "additives_contaminants_and_residues",
    "halal_requirements", "import_clearance", "enforcement_and_penalties", "recent_developments", "outdated_items_found_in_supplied_pdf", "official_sources",
)


class PackError(ValueError):
    """A pack or profile is missing or malformed."""


#: Small tables that were loaded once, by application and name.
_LOADED: dict[tuple[str, str], DataFrame] = {}
#: Rows up to which a loaded table counts as small.
SMALL_ROWS = 100_000


def dimension(spark: SparkSession, name: str, load: Callable[[], DataFrame]) -> DataFrame:
    """A small table that is loaded when first asked for and then kept in memory; more than ``SMALL_ROWS`` rows are an error.

    So its size is known, and joins may broadcast it. ``forget`` drops what was kept.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _LOADED:
        rows = load().cache()
        if rows.count() > SMALL_ROWS:
            rows.unpersist()
            raise PackError(f"{name} has more than {SMALL_ROWS} rows")
        _LOADED[key] = rows
    return _LOADED[key]


def forget(spark: SparkSession) -> None:
    """The next use of a dimension loads it again."""
    for key in [k for k in _LOADED if k[0] == spark.sparkContext.applicationId]:
        _LOADED.pop(key).unpersist()


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, v): each file's document as a variant. No file, or one that isn't JSON, raises a PackError."""
    try:
        raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
        bad = [r["path"] for r in raw.where("v IS NULL").limit(5).collect()]
    except Exception as e:
        raise PackError(f"can't read {path}: {e}") from e
    if bad:
        raise PackError(f"not JSON: {', '.join(bad)}")
    return raw


def load_lines(spark: SparkSession, path: str, schema: str, quarantine: str, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """JSON lines as typed rows, and what was malformed: (path, line, reason), written to a quarantine folder.

    A line is malformed if it is no JSON, no object, or lacks a required key (one with a null counts as there). Blank lines
    are no lines. So one bad line costs itself, not the load; a path that can't be read is an error.
    """
    try:
        raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).where("trim(line) <> ''")
        raw = raw.withColumn("v", F.try_parse_json("line"))
        keys = F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))
        lacking = F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), F.coalesce(keys, F.array().cast("array<string>")))
        reason = F.when(F.col("v").isNull(), "not JSON").when(~F.schema_of_variant("v").startswith("OBJECT"), "not an object").when(F.size(lacking) > 0, F.concat(F.lit("lacks "), F.array_join(lacking, ", ")))
        told = raw.withColumn("reason", reason)
        told.where("reason IS NOT NULL").select("path", "line", "reason").write.mode("append").parquet(quarantine)
    except Exception as e:
        raise PackError(f"can't read {path}: {e}") from e
    good = told.where("reason IS NULL").select(F.from_json("line", schema).alias("r")).select("r.*")
    return good, spark.read.schema("path string, line string, reason string").parquet(quarantine)


def rules_of(packs: DataFrame) -> DataFrame:
    """The rules of loaded packs (v with meta.iso_3166_1_alpha_2, absent: the base, and rules), one a row."""
    each = packs.select(F.coalesce(F.try_variant_get("v", "$.meta.iso_3166_1_alpha_2", "string"), F.lit(BASE)).alias("iso"), F.explode(F.try_variant_get("v", "$.rules", "array<variant>")).alias("r"))
    text = lambda key: F.try_variant_get("r", f"$.{key}", "string").alias(key.split(".")[-1])
    return each.select("iso", *map(text, ("rule_id", "class", "category", "severity", "title")), F.col("r").alias("rule"))


def rules_for(rules: DataFrame, iso: str) -> DataFrame:
    """The base rules and then those of a country; an unknown country is an error."""
    if rules.where(F.col("iso") == iso).isEmpty():
        raise PackError(f"no pack for {iso}")
    return rules.where(F.col("iso").isin(BASE, iso)).withColumn("layer", F.when(F.col("iso") == BASE, 0).otherwise(1))


def rule_by_id(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """Each wanted id with its rule, that of the base before a country's; null columns where there is none."""
    first = rules.groupBy("rule_id").agg(F.min_by(F.struct(*(c for c in rules.columns if c != "rule_id")), F.struct((F.col("iso") != BASE).alias("later"), "iso")).alias("rule"))
    return ids.join(F.broadcast(first), "rule_id", "left").select("rule_id", "rule.*")


def pack_problems(rules: DataFrame) -> DataFrame:
    """(problem, subject): rules without id, and ids that several rules have."""
    without = rules.where(F.coalesce("rule_id", F.lit("")) == "").select(F.lit("missing rule_id").alias("problem"), F.col("iso").alias("subject"))
    twice = rules.where(F.coalesce("rule_id", F.lit("")) != "").groupBy("rule_id").agg(F.count("*").alias("n")).where("n > 1")
    return without.unionByName(twice.select(F.lit("duplicate rule_id").alias("problem"), F.col("rule_id").alias("subject")))


def rule_statistics(rules: DataFrame) -> DataFrame:
    return rules.groupBy("class", "severity").agg(F.count("*").alias("n"), F.countDistinct("iso").alias("packs"))


def index_mismatches(rules: DataFrame, index: DataFrame) -> DataFrame:
    """(name, rule_id, side): what an index (name, rule_id) and the rules' classes and severities don't have in common."""
    names = rules.select(F.explode(F.array("class", "severity")).alias("name"), "rule_id").distinct()
    known = names.join(F.broadcast(index.select("name").distinct()), "name", "left_semi")
    missing = known.join(index, ["name", "rule_id"], "left_anti").withColumn("side", F.lit("not in index"))
    return missing.unionByName(index.join(names, ["name", "rule_id"], "left_anti").withColumn("side", F.lit("no such rule")))


def primary_authority(v: Column, field: str) -> Column:
    """A field of a profile's primary authority, or else of its primary federal one."""
    whole = lambda key: F.try_variant_get(v, f"$.competent_authorities.{key}", "variant")
    there = whole("primary").isNotNull() & ~F.is_variant_null(whole("primary"))
    got = lambda key: F.try_variant_get(v, f"$.competent_authorities.{key}.{field}", "string")
    return F.when(there, got("primary")).otherwise(got("primary_federal"))


def citations(profiles: DataFrame) -> DataFrame:
    """(jurisdiction, country, instrument, authority, authority_abbreviation) of profiles (code, v)."""
    return profiles.select(
        F.upper("code").alias("jurisdiction"), F.coalesce(F.try_variant_get("v", "$.meta.country", "string"), F.upper("code")).alias("country"),
        F.coalesce(F.try_variant_get("v", "$.legal_framework.primary_law.citation", "string"), F.lit("unspecified")).alias("instrument"),
        F.coalesce(primary_authority(F.col("v"), "name"), F.lit("unspecified")).alias("authority"), F.coalesce(primary_authority(F.col("v"), "abbreviation"), F.lit("")).alias("authority_abbreviation"),
    )


def profile(profiles: DataFrame, code: str) -> DataFrame:
    """The profile of a code in either case; an unknown one is an error."""
    found = profiles.where(F.upper("code") == code.upper())
    if found.isEmpty():
        raise PackError(f"no profile for {code}")
    return found


def missing_keys(profiles: DataFrame, required: tuple[str, ...] = REQUIRED_KEYS) -> DataFrame:
    """(code, missing): required top-level keys that a profile lacks, sorted; complete ones are left out."""
    keys = F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))
    lacking = F.sort_array(F.array_except(F.array(*map(F.lit, required)), F.coalesce(keys, F.array().cast("array<string>"))))
    return profiles.select("code", lacking.alias("missing")).where(F.size("missing") > 0)


def enriched(records: DataFrame, cited: DataFrame, key: str = "jurisdiction") -> DataFrame:
    """Records with their citation as a struct; a jurisdiction without one gets null. Citations are one row a country."""
    c = cited.select(key, F.struct("country", "instrument", "authority", "authority_abbreviation").alias("legal_citation"))
    return records.join(F.broadcast(c), key, "left")


def known_jurisdiction(code: Column, known: tuple[str, ...]) -> Column:
    """The code itself; a task fails on one that isn't known."""
    return F.when(code.isin(*known), code).otherwise(F.raise_error(F.concat(F.lit("unknown jurisdiction: "), F.coalesce(code, F.lit("null")))))
