"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import os

import duckdb
import pytest

from sourcefacts.jobs import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for file in os.listdir(sf_dir):
        c.execute(f"create view {file.split('.')[0]} as select * from '{sf_dir}/{file}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_oracle(spark, duck, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir)
    want = duck.sql(registry.oracles()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(repr, map(tuple, got.select(*[f"`{c}`" for c in columns]).collect())))
    assert rows == sorted(map(repr, want.project(", ".join(f'"{c}"' for c in columns)).fetchall()))


def test_every_query_is_known():
    assert set(registry.oracles()) <= set(registry.queries())
