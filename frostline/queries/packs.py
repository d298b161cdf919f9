"""Rule packs from ``part`` and country profiles from ``nation``, in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.catalog import _LOG, _funnel
from frostline.operators.planning import JURISDICTIONS
from frostline.registry import query
from frostline.sources import packs as K
from frostline.sources.adapters import table

_RULE = """CASE p_partkey % 7 WHEN 0 THEN 'GCC' WHEN 1 THEN 'AE' WHEN 2 THEN 'SA' WHEN 3 THEN 'QA' WHEN 4 THEN 'KW' WHEN 5 THEN 'OM' ELSE 'BH' END AS iso,
 CASE WHEN p_partkey % 50 = 3 THEN NULL WHEN p_partkey % 40 = 7 THEN 'X-7' ELSE concat('R-', CAST(p_partkey AS string)) END AS rule_id,
 CASE WHEN p_size % 5 = 0 THEN 'normal_case' ELSE 'edge_case' END AS class, p_type AS category, CASE WHEN p_size % 3 = 0 THEN 'blocking' ELSE 'advisory' END AS severity, p_name AS title"""
_RULES = f"WITH r AS (SELECT {_RULE} FROM part)"
_INDEX = """SELECT CASE WHEN p_size % 5 = 0 THEN 'normal_case' ELSE 'edge_case' END AS name, concat('R-', CAST(p_partkey AS string)) AS rule_id FROM part WHERE p_partkey % 11 <> 0"""
_PROFILE = """CASE n_nationkey % 3
 WHEN 0 THEN concat('{"meta": {"country": "', n_name, '"}, "competent_authorities": {"primary": {"name": "A', CAST(n_nationkey AS string), '", "abbreviation": "AB"}}, "legal_framework": {"primary_law": {"citation": "Law ', CAST(n_nationkey AS string), '"}}}')
 WHEN 1 THEN concat('{"meta": {}, "competent_authorities": {"primary_federal": {"name": "F', CAST(n_nationkey AS string), '"}}, "labelling": {}, "import_clearance": 1}') ELSE '{"official_sources": []}' END"""
_PROFILES = f"WITH p AS (SELECT concat('n', CAST(n_nationkey AS string)) AS code, {_PROFILE} AS j FROM nation)"
_CITED = """upper(code) AS jurisdiction, coalesce(json_extract_string(j, '$.meta.country'), upper(code)) AS country, coalesce(json_extract_string(j, '$.legal_framework.primary_law.citation'), 'unspecified') AS instrument,
 coalesce(CASE WHEN json_type(j, '$.competent_authorities.primary') IS NOT NULL THEN json_extract_string(j, '$.competent_authorities.primary.name') ELSE json_extract_string(j, '$.competent_authorities.primary_federal.name') END, 'unspecified') AS authority,
 coalesce(CASE WHEN json_type(j, '$.competent_authorities.primary') IS NOT NULL THEN json_extract_string(j, '$.competent_authorities.primary.abbreviation') ELSE json_extract_string(j, '$.competent_authorities.primary_federal.abbreviation') END, '') AS authority_abbreviation"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*_split(_RULE))


def _split(text: str) -> list[str]:
    import re

    return [x.strip() for x in re.split(r"(?<= AS iso),|(?<= AS rule_id),|(?<= AS class),|(?<= AS category),|(?<= AS severity),", text)]


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").selectExpr("concat('n', CAST(n_nationkey AS string)) AS code", f"{_PROFILE} AS j")
    return rows.select("code", F.parse_json("j").alias("v"))


@query(_RULES + " SELECT rule_id, iso, CASE WHEN iso = 'GCC' THEN 0 ELSE 1 END AS layer FROM r WHERE iso IN ('GCC', 'SA')")
def rules_for_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.rules_for(_rules(spark, sf_dir), "SA").select("rule_id", "iso", "layer")


@query(_RULES + ", ids AS (SELECT DISTINCT CASE WHEN p_partkey % 9 = 0 THEN 'none' ELSE concat('R-', p_partkey) END AS rule_id FROM part UNION SELECT 'X-7'), f AS (SELECT rule_id, min_by(struct_pack(iso := iso, title := title), (iso <> 'GCC', iso)) AS x FROM r WHERE rule_id IS NOT NULL GROUP BY rule_id) SELECT ids.rule_id, x.iso AS iso FROM ids LEFT JOIN f USING (rule_id)")
def rules_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "part").selectExpr("CASE WHEN p_partkey % 9 = 0 THEN 'none' ELSE concat('R-', CAST(p_partkey AS string)) END AS rule_id")
    wanted = ids.unionByName(spark.createDataFrame([("X-7",)], "rule_id string")).distinct()
    return K.rule_by_id(_rules(spark, sf_dir).where("rule_id IS NOT NULL"), wanted).select("rule_id", "iso")


@query(_RULES + " SELECT 'missing rule_id' AS problem, iso AS subject FROM r WHERE rule_id IS NULL UNION ALL SELECT 'duplicate rule_id', rule_id FROM r WHERE rule_id IS NOT NULL GROUP BY rule_id HAVING count(*) > 1")
def pack_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.pack_problems(_rules(spark, sf_dir))


@query(_RULES + " SELECT class, severity, count(*) AS n, count(DISTINCT iso) AS packs FROM r GROUP BY ALL")
def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.rule_statistics(_rules(spark, sf_dir))


@query(_RULES + f", i AS ({_INDEX}), n AS (SELECT DISTINCT class AS name, rule_id FROM r WHERE rule_id IS NOT NULL) SELECT name, rule_id, 'not in index' AS side FROM n WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.name = n.name AND i.rule_id = n.rule_id) UNION ALL SELECT name, rule_id, 'no such rule' FROM i WHERE NOT EXISTS (SELECT 1 FROM n WHERE i.name = n.name AND i.rule_id = n.rule_id)")
def rule_index_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "part").where("p_partkey % 11 <> 0").selectExpr("CASE WHEN p_size % 5 = 0 THEN 'normal_case' ELSE 'edge_case' END AS name", "concat('R-', CAST(p_partkey AS string)) AS rule_id")
    return K.index_mismatches(_rules(spark, sf_dir).where("rule_id IS NOT NULL"), index)


@query(_PROFILES + f" SELECT {_CITED} FROM p")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.citations(_profiles(spark, sf_dir))


@query(_PROFILES + f" SELECT {_CITED} FROM p WHERE upper(code) = 'N3'")
def profile_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.citations(K.profile(_profiles(spark, sf_dir), "n3"))


@query(_PROFILES + " SELECT code, array_to_string(list_sort(list_filter([" + ", ".join(f"'{k}'" for k in K.REQUIRED_KEYS) + "], lambda k: NOT list_contains(json_keys(j), k))), ',') AS missing FROM p")
def profile_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.missing_keys(_profiles(spark, sf_dir)).select("code", F.array_join("missing", ",").alias("missing"))


@query(_LOG + "SELECT doc_id, jurisdiction, 'Law of ' || jurisdiction AS instrument FROM f WHERE outcome = 'kept'")
def cited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = spark.createDataFrame([(j, j, f"Law of {j}", "unspecified", "") for j in JURISDICTIONS], "jurisdiction string, country string, instrument string, authority string, authority_abbreviation string")
    kept = _funnel(spark, sf_dir).where("outcome = 'kept'").withColumn("jurisdiction", K.known_jurisdiction(F.col("jurisdiction"), JURISDICTIONS))
    return K.enriched(kept, cited).select("doc_id", "jurisdiction", "legal_citation.instrument")
