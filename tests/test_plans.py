"""What the engine's plans do once, and what they don't do."""

import re

import pytest
from pyspark.sql import functions as F
from support import TESTDATA

from tessel.operators import diff as d
from tessel.operators.extract import extract
from tessel.plans import engine
from tessel.plans import workload as w
from tessel.sources import index as store

SF = str(TESTDATA / "sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    out = []
    for new in (False, True):
        path = str(tmp_path_factory.mktemp("snapshots") / f"it's {new}")
        store.save(w.surfaces(spark, SF, new), path, buckets=5)
        out.append(path)
    return out


def test_snapshots_are_compared_without_a_shuffle(spark, saved):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base, new = (store.load(spark, p) for p in saved)
        for compare in (d.matched, d.removed, d.added):
            text = plan(compare(base, new))
            assert "SortMergeJoin" in text and "Exchange" not in text
        fresh = (w.surfaces(spark, SF, False), w.surfaces(spark, SF, True))
        for compare, column in ((d.matched, "base.fqn"), (d.removed, "fqn"), (d.added, "fqn")):
            names = lambda pair: sorted(r[0] for r in compare(*pair).select(column).collect())  # noqa: B023, E731
            assert names((base, new)) == names(fresh)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_snapshots_leave_no_table(spark, saved):
    for p in saved:
        assert store.load(spark, p).count() == store.load(spark, p).select("fqn").distinct().count() > 100
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("tessel_")] == []


def test_plain_and_empty_snapshots(spark, tmp_path):
    rows = w.surfaces(spark, SF, False)
    rows.write.parquet(str(tmp_path / "plain"))
    assert store.load(spark, str(tmp_path / "plain")).count() == rows.count()
    store.save(rows.where("false"), str(tmp_path / "none"))
    assert store.load(spark, str(tmp_path / "none")).collect() == []
    store.save(rows, str(tmp_path / "none"), buckets=3)
    assert store.load(spark, str(tmp_path / "none")).count() == rows.count()


def test_a_report_joins_the_snapshots_once(spark, saved):
    base, new = (store.load(spark, p) for p in saved)
    text = plan(d.diff(base, new))
    assert len(re.findall("FullOuter", text)) == 1
    assert len(re.findall("Scan parquet", text)) == 3  # both snapshots, and the base's names once more
    assert len(re.findall(r"(?:Join|Exists) ", text)) <= 2


def test_required_props_need_their_component(spark):
    sf = [w.surfaces(spark, SF, x) for x in (False, True)]
    found = sorted(r["fqn"] for r in d.diff(*sf).where("kind = 'VueRequiredPropAdded'").select("surface.fqn").collect())
    want = sorted(r["fqn"] for r in d.required_props(d.added(*sf), sf[0]).select("surface.fqn").collect())
    assert found == want and found
    other = sf[1].where("fqn not like '%.prop.%'")
    assert d.diff(other, sf[1]).where("kind = 'VueRequiredPropAdded'").count() == sf[1].where("signature.vue_prop.required is not null").join(other.select(F.col("fqn").alias("c")), F.col("c") == F.substring_index("fqn", ".prop.", 1), "left_semi").count()


def test_a_scan_extracts_once(spark, tmp_path, caplog):
    """Every file's content is asked for once, though duplicates are told and the rows are counted and saved."""
    folder = tmp_path / "src/Resources/app/administration/src"
    for name in ("a", "b", "c"):
        (folder / name).mkdir(parents=True)
        (folder / name / "index.ts").write_text("import t from './sw-x.html.twig';\nexport default { emits: ['one'] };\n")
    (tmp_path / "composer.json").write_text('{"name": "a/b"}')
    seen = spark.sparkContext.accumulator(0)
    real = engine.extract

    def extract(files):
        def run(batches):
            for b in batches:
                seen.add(len(b))
                yield b

        return real(files.mapInArrow(run, files.schema))

    engine.extract = extract
    try:
        rows = engine.scan(spark, tmp_path, "a/b")
        assert rows.count() == 2 and sorted(r["fqn"] for r in rows.collect()) == ["vue.sw-x", "vue.sw-x.emit.one"]
        assert "InMemoryTableScan" in plan(rows)
    finally:
        engine.extract = real
        spark.catalog.clearCache()
    assert seen.value == 3
    assert sorted(r.getMessage() for r in caplog.records if r.name == "tessel.plans.engine") == ["vue.sw-x is defined 3 times", "vue.sw-x.emit.one is defined 3 times"]


def test_fresh_snapshots_are_joined_as_they_lie(spark):
    """What moves is names and lines: no exchange carries a signature, nor a report's surface."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base, new = (w.surfaces(spark, SF, x) for x in (False, True))
        nodes = [d.diff(base, new, d.owned(base, new))._jdf.queryExecution().executedPlan()]
        moved, joins = [], 0
        while nodes:
            node = nodes.pop()
            name = node.nodeName()
            joins += name.startswith("SortMergeJoin")
            if name.startswith("Exchange"):
                moved.append(node.schema().catalogString())
            nodes += [node.inputPlan()] if name == "AdaptiveSparkPlan" else [node.children().apply(i) for i in range(node.children().size())]
        assert joins >= 2 and moved
        assert not [m for m in moved if "source_token" in m or "signature" in m or "ts_method" in m]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_components_known_beforehand_change_no_report(spark):
    base, new = (w.surfaces(spark, SF, x) for x in (False, True))
    rows = lambda report: sorted(map(repr, report.collect()))
    assert rows(d.diff(base, new)) == rows(d.diff(base, new, d.owned(base, new)))


def test_reports_without_source_lines_read_no_files(spark):
    from tessel.plans import queries

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = [plan(queries.QUERIES[n](spark, SF)).count("Exchange") for n in ("json_report", "human_report")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert both[0] == both[1]


def test_sources_are_extracted_once_for_each_side(spark):
    """Names of components come from the exchange that the report reads, and no place is moved with the texts."""
    from tessel.plans import queries

    df = queries.full_pipeline(spark, SF)
    assert df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("MapInArrow ") == 2 and "ReusedExchange" in final


def test_texts_lose_places_only(spark):
    rows = extract(w.sources(spark, SF).unionByName(w.prop_files(spark, SF)).unionByName(w.small_files(spark, SF)))
    bare = d.texts(rows)
    assert [(f.name, f.dataType) for f in bare.schema] == [(f.name, f.dataType) for f in rows.schema]
    cut = lambda x: {k: cut(v) for k, v in x.items() if k != "source_range"} if isinstance(x, dict) else [cut(v) for v in x] if isinstance(x, list) else x
    kept = lambda df: sorted(repr(cut(r.asDict(True))) for r in df.collect())
    assert kept(rows) == kept(bare)
    assert bare.where("source_token.source_range is not null or signature.ts_method.return_type.source_range is not null or exists(signature.ts_method.parameters, p -> p.name.source_range is not null)").isEmpty()
