"""Joins whose rows must not be gathered in the driver, however small the files are that they come from."""

import pytest

from sourcefacts.functions.tables import materialize
from sourcefacts.jobs import resolve_queries as C
from sourcefacts.operators import extract as E, resolve as R

JAVA = '@RestController class A { private B dep; @GetMapping("/a") String find() { return dep.load(1); } }'


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def scanned(spark):
    files = spark.createDataFrame([("r", f"src/main/java/A{i}.java", JAVA) for i in range(3)], "repository_id string, relative_path string, content string")
    return materialize(E.scan_java(files), "scanned")


def test_parents_are_joined_by_shuffle(scanned):
    symbols = E.build_symbols(E.raw_decls(scanned))
    assert "Broadcast" not in plan(symbols)
    assert "Broadcast" not in plan(E.unique_symbols(symbols))
    assert symbols.where("parent_id is not null").count() == 6


def test_endpoints_are_joined_by_shuffle(scanned):
    decls = E.raw_decls(scanned)
    symbols = materialize(E.unique_symbols(E.build_symbols(decls)), "symbols")
    endpoints = E.extract_endpoints(decls, symbols)
    assert "Broadcast" not in plan(endpoints)
    assert endpoints.count() == 3


@pytest.fixture(scope="module")
def facts(spark, sf_dir):
    return C.written_facts(spark, sf_dir)


def test_names_are_joined_by_shuffle(facts):
    """The edges of written facts (F8)."""
    symbols = facts["symbols"]
    for edges in (R.inheritance_edges(facts["type_refs"], symbols), R.injection_edges(facts["params"], symbols), R.test_convention_edges(symbols)):
        assert "Broadcast" not in plan(edges)


def test_calls_are_written_between_look_ups(spark, sf_dir, facts):
    """What is left to the result are two look-ups over a written table, so no more shuffle files are there at once (F12 to F15)."""
    outcomes = R.call_outcomes(facts["calls"], facts["symbols"], facts["fields"], facts["params"])
    assert plan(outcomes).count("Join") <= 2
    assert not any("lineitem" in file for file in C.outcomes(spark, sf_dir).inputFiles())
