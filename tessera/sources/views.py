"""Points and words derived from the star-schema tables, which have no coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x and y of every order."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("id"),
        (((F.col("o_custkey") * 7919) % 36000).cast("double") / 100.0 - 180.0).alias("x"),
        (((F.col("o_orderkey") * 104729) % 18000).cast("double") / 100.0 - 90.0).alias("y"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """str and id: the lower-case a-z words of all documents, and how often each occurs."""
    each = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("str"))
    return each.groupBy("str").agg(F.count("*").alias("id"))


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and str: names as they are, and the beginnings of texts, in any script."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    names = read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("str")).union(read("nation").select(F.col("n_nationkey").cast("long"), F.upper("n_name")))
    starts = read("documents").where("text is not null").select(F.col("doc_id").alias("id"), F.explode(F.array(*(F.substring("text", i, 9) for i in (1, 14, 40, 77)))).alias("str"))
    return names.union(starts)


#: The same in DuckDB.
STRINGS_SQL = "with strings as (select p_partkey as id, p_name as str from part union all select n_nationkey, upper(n_name) from nation union all select doc_id, substr(text, i, 9) from documents, (values (1), (14), (40), (77)) v(i) where text is not null)"
POINTS_SQL = "select o_orderkey as id, cast((o_custkey*7919)%36000 as double)/100.0e0-180.0e0 as x, cast((o_orderkey*104729)%18000 as double)/100.0e0-90.0e0 as y from orders"
WORDS_SQL = "select w as str, count(*) as id from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents) group by w"
