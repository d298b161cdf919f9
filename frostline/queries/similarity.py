"""Near-duplicate vectors and the leakage probe over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.catalog import _funnel
from frostline.operators import similarity as S
from frostline.operators.leakage import leakage_probe as probe
from frostline.registry import query
from frostline.sources.adapters import table

_NEAR = "WITH p AS (SELECT a.vec_id, max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY a.vec_id)"


@query(_NEAR + " SELECT vec_id, coalesce(c > 0.95, false) AS near FROM embeddings LEFT JOIN p USING (vec_id)")
def near_duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.near_duplicates(table(spark, sf_dir, "embeddings"))


@query(_NEAR + " SELECT round(avg((c > 0.95)::INT), 9) AS near_duplicate_rate FROM p")
def near_duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.near_duplicate_rate(table(spark, sf_dir, "embeddings")).select(F.round("near_duplicate_rate", 9).alias("near_duplicate_rate"))


@query()
def leakage_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted classifier has no SQL; the tests plant a leak."""
    value = probe(_funnel(spark, sf_dir).where("outcome = 'kept'"))
    return spark.createDataFrame([("leakage_probe_acc", float(value))], "metric string, value double")
