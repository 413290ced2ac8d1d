"""Normalized entity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnwork.config import Config
from tarnwork.functions import normalize as N
from tarnwork.sources.io import ENTITY_COLUMNS, require_columns


def normalize_entities(df: DataFrame, source: str | None = None, config: Config = Config(), nfkc: bool = True) -> DataFrame:
    """Normalized entities; ``source`` labels all rows, or the column ``source`` is kept.

    Prefix and first token come from the name before names that are too short are blanked.
    Rows whose texts are all ASCII never leave the JVM; the others are folded in Python.
    """
    require_columns(df, ENTITY_COLUMNS)
    label = F.lit(source) if source else F.col("source")
    raw = df.select(F.trim(F.coalesce(F.col("entity_id").cast("string"), F.lit(""))).alias("entity_id"), label.alias("source"), *ENTITY_COLUMNS[1:])
    if not nfkc:
        return _derived(raw, config, False)
    folds = F.coalesce(F.concat_ws(" ", *ENTITY_COLUMNS[1:]).rlike(r"[^\x00-\x7F]"), F.lit(False))
    return _derived(raw.filter(~folds), config, False).unionByName(_derived(raw.filter(folds), config, True))


def _derived(raw: DataFrame, config: Config, nfkc: bool) -> DataFrame:
    base = raw.select(
        "entity_id", "source", N.normalize_name(F.col("business_name"), nfkc).alias("full_name"), N.normalize_address(F.col("business_address"), nfkc).alias("address_norm"),
        N.normalize_country(F.col("country"), nfkc).alias("country_norm"),
    )
    name = F.col("full_name")
    return base.select(
        "entity_id", "source", F.when(F.length(name) < config.min_name_length, "").otherwise(name).alias("name_norm"), "address_norm", "country_norm",
        F.substring(name, 1, config.name_prefix_length).alias("name_prefix"), F.split(name, " ")[0].alias("name_first_token"),
    )


def combine_targets(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def split_sides(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source1 rows, target rows)."""
    return entities.filter(F.col("source") == "source1"), entities.filter(F.col("source") != "source1")
