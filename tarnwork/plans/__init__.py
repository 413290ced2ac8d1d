"""Registered queries and the DuckDB SQL that each is compared with."""

from tarnwork.plans.queries import ORACLE, QUERIES, flagship

__all__ = ["ORACLE", "QUERIES", "flagship"]
