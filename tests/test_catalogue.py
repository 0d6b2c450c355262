"""Every query of the library against its SQL, and that those without one return rows."""

import pytest

from tests.compare import same
from tidewire.plans.catalogue import everything

QUERIES = everything()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    q = QUERIES[name]
    df = q.run(spark, sf_dir)
    if q.sql:
        same(df, sf_dir, q.sql)
    else:
        assert df.columns and df.count() > 0


def test_rows_named_as_not_built_are_not_counted():
    import re
    from pathlib import Path

    covered = {n for q in QUERIES.values() for n in q.rows}
    assert not covered & {237}
    text = (Path(__file__).resolve().parent.parent / "README.md").read_text()
    said = re.search(r"covers (\d+) of the (\d+) inventory rows. No query has rows ([\d, ]+)\.", text)
    assert len(covered) == int(said[1]) and {int(x) for x in said[3].split(",")} == set(range(1, int(said[2]) + 1)) - covered
