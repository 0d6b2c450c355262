"""How queries are registered: a name, the function over (spark, sf_dir), the SQL that gives the
same rows, and the numbers of the inventory rows that the query covers."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from tidewire.sources.projections import AUDIO, PACKETS

Run = Callable[[SparkSession, str], DataFrame]


class Query(NamedTuple):
    run: Run
    sql: str | None
    rows: tuple[int, ...]


#: Views for the SQL side.
WITH = f"WITH packets AS ({PACKETS}), audio AS ({AUDIO}), frames AS (SELECT *, CAST(sum(CASE WHEN frame_type = 'IDR' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY arrival_idx) AS BIGINT) AS gop_id FROM packets)"


class Catalogue(dict):
    def add(self, *rows: int, sql: str | None = None) -> Callable[[Run], Run]:
        def keep(f: Run) -> Run:
            self[f.__name__] = Query(f, sql, rows)
            return f

        return keep
