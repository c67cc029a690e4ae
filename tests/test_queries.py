from __future__ import annotations

import pytest
from oracle import SF, connect, same

from evidgraph.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same(df, con, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry_without_oracle_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_project_digest_reads_every_document(spark, tmp_path):
    """A change in any document changes the digest."""
    digests = set()
    for changed in (None, *range(1, 12)):
        d = f"{tmp_path}/{changed}"
        rows = [(i, f"text {i}{'!' if i == changed else ''}") for i in range(1, 12)]
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
        digests.add(QUERIES["project_digest"](spark, d).head()[0])
    assert len(digests) == 12
