"""Queries of the graph operators by name, each with SQL that computes the same rows from the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import changes, codec, files, impact, layers, parsed, scope
from .files import flagship_graph

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (files, scope, impact, layers, codec, changes, parsed):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers of the graph with their roles."""
    return layers.assignment_with_roles(flagship_graph(spark, sf_dir))
