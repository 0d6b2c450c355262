"""All queries of the library by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codecs, gops, live, media, parsing, policies, quality, sequences, sources, timed, transport, wire

PARTS = (sequences, gops, quality, policies, wire, media, parsing, codecs, transport, sources, timed, live)


def everything() -> dict:
    return {name: q for part in PARTS for name, q in part.CATALOGUE.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in everything().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in everything().items() if q.sql}
