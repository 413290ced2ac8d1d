"""The normalizations as functions of SQL, and frames as its relations.

``install`` defines, for the session: ``norm_text``, ``norm_name``, ``norm_address``,
``norm_country`` (one string each) and the table function ``name_tokens(name, shortest)``, to be
used with LATERAL. All but the compatibility folding of texts that are not ASCII are SQL
expressions, which Catalyst sees through. ``relation`` gives a frame a name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwork.config import Config
from tarnwork.functions import normalize as N

FUNCTIONS = ("norm_text", "norm_name", "norm_address", "norm_country", "name_tokens")


def _map(values: dict[str, str]) -> str:
    return "map(" + ", ".join(f"'{x}'" for pair in values.items() for x in pair) + ")"


def _tokens(aliases: dict[str, str]) -> str:
    return f"array_join(transform(split(norm_text(x), ' '), w -> coalesce(try_element_at({_map(aliases)}, w), w)), ' ')"


def install(spark: SparkSession) -> None:
    """Defines the functions, replacing older ones of their names."""
    spark.udf.register("nfkc", N._nfkc)
    one = lambda name, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body}")
    folded = r"CASE WHEN x RLIKE '[^\\x00-\\x7F]' THEN nfkc(x) ELSE coalesce(x, '') END"
    one("norm_text", f"trim(regexp_replace(lower({folded}), '[^a-z0-9]+', ' '))")
    one("norm_name", _tokens(N.COMPANY_TOKENS))
    one("norm_address", _tokens(N.ADDRESS_TOKENS))
    one("norm_country", f"coalesce(try_element_at({_map(N.COUNTRY_ALIASES)}, norm_text(x)), norm_text(x))")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION name_tokens(name STRING, shortest INT) RETURNS TABLE (token STRING) "
        "RETURN SELECT t.col FROM explode(array_distinct(split(name, ' '))) AS t WHERE length(t.col) >= shortest"
    )


def relation(df: DataFrame, name: str) -> str:
    """The frame under a name that SQL knows in this session."""
    df.createOrReplaceTempView(name)
    return name


NORMALIZED = """
SELECT entity_id, source, CASE WHEN length(full_name) < :shortest THEN '' ELSE full_name END AS name_norm, address_norm, country_norm,
  substring(full_name, 1, :prefix) AS name_prefix, split(full_name, ' ')[0] AS name_first_token
FROM (SELECT trim(coalesce(CAST(entity_id AS STRING), '')) AS entity_id, source, norm_name(business_name) AS full_name, norm_address(business_address) AS address_norm, norm_country(country) AS country_norm FROM {entities})
"""

RARE_TOKENS = """
WITH words AS (SELECT DISTINCT e.country_norm, e.entity_id AS target_id, e.source AS target_source, t.token
    FROM {targets} e, LATERAL name_tokens(e.name_norm, :shortest) t WHERE e.country_norm <> '' AND e.name_norm <> ''),
  counts AS (SELECT country_norm, token, count(*) AS token_df FROM (SELECT DISTINCT country_norm, token, target_id FROM words) GROUP BY ALL HAVING count(*) <= :most)
SELECT country_norm, token, target_id, target_source, token_df FROM words JOIN counts USING (country_norm, token)
"""


def normalized(entities: DataFrame, config: Config = Config()) -> DataFrame:
    """The normalized entities, said in SQL."""
    spark = entities.sparkSession
    install(spark)
    return spark.sql(NORMALIZED, args={"shortest": config.min_name_length, "prefix": config.name_prefix_length}, entities=entities)


def rare_tokens(targets: DataFrame, config: Config = Config()) -> DataFrame:
    """The rare-token index of normalized targets, said in SQL."""
    spark = targets.sparkSession
    install(spark)
    return spark.sql(RARE_TOKENS, args={"shortest": config.min_token_length, "most": config.max_token_df}, targets=targets)
