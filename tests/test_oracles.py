"""Every registered query against its SQL twin, and the shape of all plans."""

import os

import pytest
from oracle_compare import DATA, compare, duck

from __spark_entry__ import entry
from sightline.plans import load_all

SF = os.environ.get("ORACLE_SF", "0.001")
QUERIES, SQL = load_all().QUERIES, load_all().ORACLES

# Operator ids of the survey that have no registered query, with the test that covers them.
TESTED_ELSEWHERE: dict[str, str] = {}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    diff, n = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert not diff, "\n".join(diff)
    assert n > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("stream_", "write_"))])
def test_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, f"{DATA}/sf{SF}")._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert bad not in plan, f"{name}: {bad}"


def test_entry(spark):
    assert entry(spark).columns[:2] == ["n_pairs", "n_objects"]


def test_every_operator_is_covered():
    ids = {i for covered in load_all().COVERS.values() for i in covered} | set(TESTED_ELSEWHERE)
    want = [f"{k}{i:02d}" for k, n in dict(A=17, B=21, C=15, D=35, E=13, F=11, G=7, H=14, I=9, J=3, L=13).items() for i in range(1, n + 1)]
    assert sorted(set(want) - ids) == []
