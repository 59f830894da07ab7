import json

import pytest

from tessel.__main__ import main
from tessel.plans import engine, output
from tessel.sources import index as store
from tessel.sources.files import RootError, list_files, validate_root
from tessel.sources.ignore import Rule

OLD = "import t from './sw-card.html.twig';\nexport default {\n  emits: ['close'],\n  props: { title: { type: String }, size: Number },\n  methods: { load(id: A, x?) {} },\n};\n"
NEW = "import t from './sw-card.html.twig';\nexport default {\n  props: { title: { type: Number }, size: Number, extra: { type: A, required: true } },\n  methods: { load(id: A, x) {} },\n};\n"
FOLDER = "src/Resources/app/administration/src/sw-card"


@pytest.fixture
def tree(tmp_path):
    def write(path, text):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, "utf-8")

    write("composer.json", json.dumps({"name": "acme/shop"}))
    write(f"{FOLDER}/index.ts", OLD)
    write(f"{FOLDER}/index.spec.ts", OLD.replace("sw-card", "sw-spec"))
    write(f"{FOLDER}/test/x.ts", OLD.replace("sw-card", "sw-test"))
    write(f"{FOLDER}/.hidden/x.ts", OLD.replace("sw-card", "sw-hidden"))
    write(f"{FOLDER}/_kept/x.js", OLD.replace("sw-card", "sw-kept"))
    write(f"{FOLDER}/x.tsx", OLD)
    write(f"{FOLDER}/built/x.js", OLD.replace("sw-card", "sw-built"))
    write(".gitignore", "# built\nbuilt/\n")
    write("src/other/x.ts", OLD.replace("sw-card", "sw-other"))
    write("src/other/x.php", "<?php")
    return tmp_path


def listed(spark, root, **options):
    return sorted(r["repo_path"] for r in list_files(spark, root, **options).collect())


def test_listing(spark, tree):
    assert listed(spark, tree) == [f"{FOLDER}/_kept/x.js", f"{FOLDER}/index.ts", "src/other/x.php", "src/other/x.ts"]
    assert f"{FOLDER}/built/x.js" in listed(spark, tree, ignore_files=False)


@pytest.mark.parametrize(
    "line, path, is_dir, named",
    [
        ("*.js", "a/b.js", False, True), ("/*.js", "a/b.js", False, False), ("/*.js", "b.js", False, True), ("a/*.js", "a/b/c.js", False, False), ("a/**/c.js", "a/b/d/c.js", False, True),
        ("a/**/c.js", "a/c.js", False, True), ("**/b", "x/y/b", True, True), ("a/**", "a/b/c", False, True), ("a/**", "a", True, False), ("b/", "x/b", True, True), ("b/", "x/b", False, False),
        ("a?c", "abc", False, True), ("a?c", "a/c", False, False), ("[ab].ts", "x/b.ts", False, True), ("[!ab].ts", "b.ts", False, False), ("\\#x", "#x", False, True), ("a\\*", "ab", False, False),
        ("a\\*", "a*", False, True), ("trail  ", "trail", False, True), ("x/y", "z/x/y", False, False), ("a[", "a[", False, True),
    ],
)
def test_ignore_rules(line, path, is_dir, named):
    assert Rule("", line).names(path, is_dir) == named
    assert Rule("sub/dir", line).names(f"sub/dir/{path}", is_dir) == named
    assert not Rule("other", line).names(path, is_dir)


def test_nested_ignore_files(spark, tree):
    (tree / "src" / ".ignore").write_text("other/*\n!other/x.ts\n")
    assert listed(spark, tree) == [f"{FOLDER}/_kept/x.js", f"{FOLDER}/index.ts", "src/other/x.ts"]


def test_frames_of_several_lines(spark):
    row = {"line": 9, "end_line": 10, "column": 3, "end_column": 6, "label": "changed", "source": ["  é(\r", "   b) {"]}
    rest = {"code": "c", "headline": "h", "fqn": "f", "file": "a.ts", "help": "", "before": None}
    kinds = "line long, end_line long, `column` long, end_column long, label string, source array<string>, code string, headline string, fqn string, file string, help string, before string"
    text = lambda r: spark.createDataFrame([tuple((r | rest).values())], kinds).select(output.human_entry()).first()[0].split("\n")
    ends = ["    = note: API surface: f", ""]
    assert text(row) == ["[c] Error: h", "   --> a.ts:9:3", "  9 |   é(", "    |   ^^", " 10 |    b) {", "    |    ^^ changed", *ends]
    assert text(row | {"source": []})[2:] == ["    | changed", *ends]
    assert text(row | {"column": 4, "end_line": 9, "end_column": 4, "source": ["  é("]})[2:4] == [" 9 |   é(", "   |    ^ changed"]  # within é: the cut half counts


def test_root(tree, tmp_path_factory):
    assert validate_root(tree, "acme/shop") == str(tree.resolve())
    empty = tmp_path_factory.mktemp("empty")
    for root, project in ((tree, "acme/other"), (empty, "acme/shop"), (empty / "none", "acme/shop")):
        with pytest.raises(RootError):
            validate_root(root, project)
    (empty / "composer.json").write_text("[")
    with pytest.raises(RootError):
        validate_root(empty, "acme/shop")


@pytest.mark.parametrize("name", ["index.json", "index.parquet"])
def test_index_and_check(spark, tree, tmp_path_factory, name):
    index = str(tmp_path_factory.mktemp("index") / name)
    assert engine.index(spark, tree, "acme/shop", index) == 10
    assert engine.check(spark, tree, "acme/shop", index, "json") == (False, "")
    (tree / FOLDER / "index.ts").write_text(NEW)
    broken, text = engine.check(spark, tree, "acme/shop", index, "json")
    report = json.loads(text)
    assert broken and "\n" not in text
    assert [r["fqn"] for r in report["removed"]] == ["vue.sw-card.emit.close"]
    assert report["removed"][0]["signature"] == "None"
    assert sorted((c["kind"], c["old"] and c["old"]["text_normalized"], c["new"]["text_normalized"]) for c in report["breaking_changes"]) == [
        ("TsMethodParamBecameRequired", "?", "x"),
        ("VuePropTypeChanged", "String", "Number"),
        ("VueRequiredPropAdded", None, "true"),
    ]
    change = next(c for c in report["breaking_changes"] if c["kind"] == "TsMethodParamBecameRequired")
    method = change["surface"]["signature"]["TsMethod"]
    assert list(method) == ["async", "parameters", "return_type"] and method["async"] is None
    assert method["parameters"][1]["optional"]["text_normalized"] == "?"

    lines = {x.split("'")[1]: x for x in engine.check(spark, tree, "acme/shop", index, "github")[1].split("\n")}
    assert lines.pop("vue.sw-card.emit.close") == (
        f"::error file={FOLDER}/index.ts,line=3,col=12,endLine=3,endColumn=17,title=api%3Aremoved::Removed public API surface 'vue.sw-card.emit.close'. Old signature was: 'close'"
    )
    lead = "::Potential breaking change on public API surface '{}': "
    ends = {
        "vue.sw-card.method.load": "title=ts%3Amethod%3Aparam%3Abecame%3Arequired" + lead + "parameter became required Old signature was: 'load(id: A, x?)'",
        "vue.sw-card.prop.title": "title=vue%3Aprop%3Atype%3Achanged" + lead + "prop 'title' type changed from 'String' to 'Number'",
        "vue.sw-card.prop.extra": "title=vue%3Arequired%3Aprop%3Aadded" + lead + "required prop 'extra' was added to existing component",
    }
    assert set(lines) == set(ends)
    for fqn, end in ends.items():
        assert lines[fqn].endswith(end.format(fqn))

    human = engine.check(spark, tree, "acme/shop", index, "human")[1]
    assert "[ts:method:param:became:required] Error: Potential breaking change on public API surface" in human
    assert "= help: old signature was: load(id: A, x?)" in human and "= note: before: String" in human
    assert " 4 |   methods: { load(id: A, x) {} },\n   | " + " " * 25 + "^ parameter became required" in human
    assert " 3 |   props: { title: { type: Number }" in human and "^^^^^^ prop 'title' type changed" in human
    with pytest.raises(ValueError):
        engine.check(spark, tree, "acme/shop", index, "xml")


def test_json_round_trip(spark, tree, tmp_path):
    surfaces = engine.scan(spark, tree, "acme/shop")
    path = str(tmp_path / "i.json")
    store.save_json(surfaces, path)
    assert set(json.load(open(path))) == {r["fqn"] for r in surfaces.collect()}
    order = lambda df: sorted(map(repr, df.select("file_path", "source_token", "fqn", "signature").collect()))
    assert order(store.load_json(spark, path)) == order(surfaces)


def test_json_of_odd_names(spark, tmp_path):
    from tessel.operators.extract import surfaces_of
    from tessel.schema import EXTRACTED

    rows = surfaces_of('a "b"\\}/x.ts', 'export default { props: { "q\\"}": A }, emits: ["é}"] }'.encode())
    df = spark.createDataFrame(rows, EXTRACTED).drop("seq")
    path = str(tmp_path / "odd.json")
    store.save_json(df, path)
    assert sorted(json.load(open(path))) == sorted(r["fqn"] for r in rows)
    assert sorted(r["file_path"] for r in store.load_json(spark, path).collect()) == ['a "b"\\}/x.ts'] * 3


def test_overwritten_duplicates_are_logged(spark, tree, tmp_path_factory, caplog):
    index = str(tmp_path_factory.mktemp("twice") / "i.json")
    assert engine.index(spark, tree, "acme/shop", index) == 10 and not caplog.records
    again = tree / FOLDER / "again" / "index.ts"
    again.parent.mkdir()
    again.write_text(OLD)
    assert engine.index(spark, tree, "acme/shop", index) == 10
    engine.check(spark, tree, "acme/shop", index)
    assert listed(spark, tree)
    logged = [r.getMessage() for r in caplog.records if r.levelname == "ERROR" and r.name == "tessel.plans.engine"]
    assert len(logged) == 10 and logged.count("vue.sw-card.prop.title is defined 2 times") == 2


def test_rules_are_checked_before_a_run(spark, monkeypatch):
    engine.validate(spark)
    with monkeypatch.context() as m, pytest.raises(Exception, match="Unclosed|regex|pattern|REGEX"):
        m.setattr("tessel.functions.text.PRIVATE", "@(private")
        engine.validate(spark)
    with monkeypatch.context() as m, pytest.raises(Exception, match="no_such"):
        m.setattr(output, "code", lambda kind: output.F.col("no_such"))
        engine.validate(spark)


def test_counts_are_told(spark, tree, tmp_path_factory, caplog):
    index = str(tmp_path_factory.mktemp("told") / "i.json")
    with caplog.at_level("INFO", "tessel.plans.engine"):
        engine.index(spark, tree, "acme/shop", index)
        engine.check(spark, tree, "acme/shop", index)
    assert [r.getMessage() for r in caplog.records] == ["10 surfaces found", "10 surfaces loaded, 10 found"]


def test_empty_tree_saves_nothing(spark, tmp_path):
    (tmp_path / "composer.json").write_text('{"name": "a/b"}')
    assert engine.index(spark, tmp_path, "a/b", str(tmp_path / "i.json")) == 0
    assert not (tmp_path / "i.json").exists()


def test_command_line(spark, tree, tmp_path_factory, capsys):
    index = str(tmp_path_factory.mktemp("cli") / "i.json")
    assert main(["index", str(tree), "--project", "acme/shop", "-i", index]) == 0
    assert main(["check", str(tree), "--project", "acme/shop", "-i", index, "-f", "json"]) == 0
    assert capsys.readouterr().out == ""
    (tree / FOLDER / "index.ts").write_text(NEW)
    assert main(["check", str(tree), "--project", "acme/shop", "-i", index, "-f", "json"]) == 1
    assert json.loads(capsys.readouterr().out)["removed"]


def test_every_kind_has_texts():
    from tessel.schema import CODES

    assert set(output.DETAILS) == set(output.LABELS) == set(CODES)
