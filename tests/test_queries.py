import pytest
from support import TESTDATA, agrees

from tessel.plans import queries, workload
from tessel.sources import index as store


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    agrees(spark, duck, queries.QUERIES[name], queries.SQL[name])


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_entry_registers_everything():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(queries.SQL) <= set(__spark_entry__.oracle_sql())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_gathered_by_one_sort(spark):
    plan = _plan(workload.methods(spark, str(TESTDATA / "sf0.001"), False))
    assert "ObjectHashAggregate" not in plan and plan.count("RunningWindowFunction") + plan.count("Window [") == 1


def test_names_of_methods_need_no_lines(spark):
    plan = _plan(workload.surfaces(spark, str(TESTDATA / "sf0.001"), False).select("fqn"))
    assert "lineitem" not in plan


@pytest.mark.parametrize("name", ["index_roundtrip", "index_object"])
def test_indexes_take_a_small_part_of_their_text(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(queries, "shared_dir", lambda _: str(tmp_path))
    sf_dir = str(TESTDATA / "sf0.001")
    rows = queries.QUERIES[name](spark, sf_dir).count()
    taken = sum(p.stat().st_size for p in tmp_path.rglob("*.gz"))
    text = store.json_lines(workload.surfaces(spark, sf_dir, False)).selectExpr("sum(octet_length(entry)) as n", "count(*) as rows").first()
    assert rows == text["rows"] and 0 < taken < text["n"] / 8
