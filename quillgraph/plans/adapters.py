"""Reviews, mentions, triplets, entities and clusters as views of the relational tables, for Spark and as SQL.

An order is a review, its priority's digit the stars, the customer's segment the language and the order's status the
channel; a line names its part's brand as an entity of the part's type as category, with the return flag as sentiment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import slug
from .config import DEFAULT, Config


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str, config: Config = DEFAULT) -> DataFrame:
    groups = F.create_map(*(F.lit(x) for pair in config.source_groups for x in pair))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("review_id"), F.col("o_orderdate").alias("created_at"), F.substring("o_orderpriority", 1, 1).cast("int").alias("stars"), F.col("c_mktsegment").alias("language"), F.coalesce(groups[F.col("o_orderstatus")], F.lit("other")).alias("source_group")
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))


def _name(column: str):
    return F.lower(F.replace(F.col(column), F.lit("#"), F.lit(" ")))


def _sentiment():
    return F.when(F.col("l_returnflag") == "R", "negative").when(F.col("l_returnflag") == "A", "neutral").otherwise("positive")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(F.col("l_orderkey").alias("review_id"), slug(_name("p_brand")).alias("entity_id"), _name("p_brand").alias("name"), F.lower("p_type").alias("category"), F.col("p_name").alias("opinion"), _sentiment().alias("sentiment"), F.concat_ws(" ", "p_name", F.col("l_linenumber").cast("string")).alias("evidence"))


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.concat("l_returnflag", "l_linestatus")
    predicate = F.when(flags == "RO", "CAUSED_BY").when(flags == "RF", "LEADS_TO").when(flags == "AF", "REQUESTS").when(flags == "AO", "HAS_ISSUE").when(flags == "NO", "USED_FOR").otherwise("CRITICIZES")
    return _lines(spark, sf_dir).select(F.col("l_orderkey").alias("review_id"), slug(_name("p_brand")).alias("subject_id"), predicate.alias("predicate"), slug(F.lower("p_type")).alias("object_id"), _sentiment().alias("sentiment"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    brands = parts.select(slug(_name("p_brand")).alias("entity_id"), _name("p_brand").alias("name"))
    types = parts.select(slug(F.lower("p_type")).alias("entity_id"), F.lower("p_type").alias("name"))
    return brands.unionByName(types).distinct()


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed partition: brands by their number, types outside."""
    number = F.regexp_extract("entity_id", r"e_brand_(\d+)", 1)
    n = F.when(number != "", number.cast("int"))
    macro = F.coalesce(n % 5, F.lit(-1))
    micro = F.coalesce(F.concat_ws(".", (n % 5).cast("string"), F.floor(n % 10 / 5).cast("string")), F.lit("-1"))
    return entities(spark, sf_dir).select("entity_id", macro.alias("macro_cluster"), F.when(n.isNull(), F.lit("-1")).otherwise(micro).alias("micro_cluster"))


SQL = {
    "reviews": """reviews as (select o_orderkey review_id, o_orderdate created_at, cast(substr(o_orderpriority, 1, 1) as int) stars, c_mktsegment as language,
  case o_orderstatus when 'F' then 'invited' when 'O' then 'organic' else 'other' end source_group, strftime(o_orderdate, '%Y-%m') as period from orders join customer on o_custkey = c_custkey)""",
    "mentions": """mentions as (select l_orderkey review_id, 'e_' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') entity_id, lower(replace(p_brand, '#', ' ')) as name, lower(p_type) category, p_name opinion,
  case l_returnflag when 'R' then 'negative' when 'A' then 'neutral' else 'positive' end sentiment, p_name || ' ' || l_linenumber evidence from lineitem join part on l_partkey = p_partkey)""",
    "triplets": """triplets as (select l_orderkey review_id, 'e_' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') subject_id,
  case l_returnflag || l_linestatus when 'RO' then 'CAUSED_BY' when 'RF' then 'LEADS_TO' when 'AF' then 'REQUESTS' when 'AO' then 'HAS_ISSUE' when 'NO' then 'USED_FOR' else 'CRITICIZES' end predicate,
  'e_' || lower(p_type) object_id, case l_returnflag when 'R' then 'negative' when 'A' then 'neutral' else 'positive' end sentiment from lineitem join part on l_partkey = p_partkey)""",
    "entities": """entities as (select distinct 'e_' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') entity_id, lower(replace(p_brand, '#', ' ')) as name from part
  union select 'e_' || lower(p_type), lower(p_type) from part)""",
    "clusters": """clusters as (select entity_id, coalesce(n % 5, -1) macro_cluster, case when n is null then '-1' else (n % 5) || '.' || ((n % 10) // 5) end micro_cluster
  from (select entity_id, try_cast(nullif(regexp_extract(entity_id, 'e_brand_(\\d+)', 1), '') as int) n from entities))""",
}


def sql(*views: str) -> str:
    """A WITH clause of the views."""
    return "with " + ",\n".join(SQL[v] for v in views)
