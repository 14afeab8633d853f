"""The corpus queries against their SQL on the smallest tables."""

import duckdb
import pytest

from kinweave.llm import shard_table
from kinweave.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_equal_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    stated = db.execute(ORACLE[name])
    columns = [c[0] for c in stated.description]
    rows = QUERIES[name](spark, SF)
    assert sorted(rows.columns) == sorted(columns)
    assert sorted(map(tuple, rows.select(columns).collect())) == sorted(stated.fetchall())


def test_filled_by_turns():
    shards, size = [f"s{k}" for k in range(7)], 101
    order = [
        [(shard_table._number(s, "offset") + k * (shard_table._number(s, "step") % (size - 1) + 1)) % size for k in range(size)]
        for s in shards
    ]
    owner, turn = {}, 0
    while len(owner) < size:
        owner[next(slot for slot in order[turn % 7] if slot not in owner)] = turn % 7
        turn += 1
    assert shard_table.fill(shards, size) == [owner[k] for k in range(size)]
