"""Queries over whole tables, against brute force."""

import pyarrow.parquet as pq
import pytest

from tessera.plans.queries import QUERIES
from tessera.sources import tables

DIR = "/root/testdata/sf0.01"


def test_generations_of_all_suppliers(spark):
    want = []
    for id_ in pq.read_table(f"{DIR}/supplier.parquet")["s_suppkey"].to_pylist():
        depth = 0
        while id_ > 0 or not depth:
            want.append((id_, depth))
            id_, depth = id_ // 2, depth + 1
    assert sorted(map(tuple, QUERIES["loop_until_empty"](spark, DIR).collect())) == sorted(want)


@pytest.mark.parametrize("lost", range(5))
def test_round_trip_of_all_regions(spark, monkeypatch, lost):
    whole = tables.Files.write_parquet
    monkeypatch.setattr(tables.Files, "write_parquet", lambda self, rows, name: whole(self, rows.filter(lambda r: r.n_regionkey != lost), name))
    with pytest.raises(RuntimeError, match="not the rows written"):
        QUERIES["parquet_roundtrip"](spark, DIR)
