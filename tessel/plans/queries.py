"""One query for each operator, over the workload, and the SQL that must agree with it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import diff as d
from ..operators import surfaces as s
from ..operators.extract import extract
from ..schema import SURFACE
from ..sources import index as store
from ..sources.files import read_files
from ..sources.shared import shared_dir
from . import output
from . import workload as w


def _flat(changes: DataFrame) -> DataFrame:
    return changes.select(F.col("surface.fqn").alias("fqn"), F.col("old.text_normalized").alias("old"), F.col("new.text_normalized").alias("new"))


def _long(report: DataFrame) -> DataFrame:
    return report.select("section", F.col("surface.fqn").alias("fqn"), "kind", F.col("old.text_normalized").alias("old"), F.col("new.text_normalized").alias("new"))


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return w.surfaces(spark, sf_dir, False), w.surfaces(spark, sf_dir, True)


def _report(spark, sf_dir) -> DataFrame:
    base, new = _snapshots(spark, sf_dir)
    return d.diff(base, new, d.owned(base, new))


def _changes(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base, new = _snapshots(spark, sf_dir)
        if kind == "VueRequiredPropAdded":
            found = d.required_props(d.added(base, new), base)
        else:
            signature = "TsMethod" if kind.startswith("Ts") else "VueProp"
            of = f"signature.kind = '{signature}'"
            found = d.changes(d.matched(base.where(of), new.where(of))).where(F.col("kind") == kind)
        return _flat(found)

    return run


def _paths(column: str, f):
    return lambda spark, sf_dir: w.some_paths(spark, sf_dir).select("k", f(F.col(column)).alias("value"))


def _documents(f):
    return lambda spark, sf_dir: w.read(spark, sf_dir, "documents").select("doc_id", f(F.col("text")).alias("value"))


def _pages(column: str, f):
    return lambda spark, sf_dir: w.read(spark, sf_dir, "pages").select("page_id", f(F.col(column)).alias("value"))


def _extracted(kind: str, shape, small: bool = False):
    """Extracted surfaces of one kind of name, from the base snapshot's source text."""

    def run(spark, sf_dir):
        files = w.small_files(spark, sf_dir) if small else w.sources(spark, sf_dir)
        return shape(extract(files.where(paths.dispatch(F.col("repo_path")) == "vue")).where(F.col("fqn").contains(f".{kind}.")))

    return run


def _prop_shape(rows: DataFrame) -> DataFrame:
    return rows.select("fqn", F.col("signature.vue_prop.type_annotation.text_normalized").alias("type"))


def _required_shape(rows: DataFrame) -> DataFrame:
    return rows.where("signature.vue_prop.required is not null").select("fqn", F.col("signature.vue_prop.required.text_normalized").alias("required"))


def _method_shape(rows: DataFrame) -> DataFrame:
    return rows.select("fqn", F.col("source_token.text_normalized").alias("sig"))


def _param_shape(rows: DataFrame) -> DataFrame:
    at = rows.select("fqn", F.posexplode("signature.ts_method.parameters").alias("pos", "p"))
    t = lambda f: F.col(f"p.{f}.text_normalized").alias(f)
    return at.select("fqn", F.col("pos").cast("long").alias("pos"), t("name"), t("type_annotation"), t("default_value"), t("optional"), t("rest"))


def _fqn_shape(rows: DataFrame) -> DataFrame:
    return rows.select("fqn")


def _defined(spark, sf_dir) -> DataFrame:
    """Customers as files that define their nation's component."""
    c = w.read(spark, sf_dir, "customer")
    fqn = F.concat(F.lit("vue.sw-nation-"), F.col("c_nationkey"))
    rows = c.select(F.concat(F.lit("f"), F.col("c_custkey")).alias("file_path"), w.token(F.lit("")).alias("source_token"), fqn.alias("fqn"), F.lit(None).cast(SURFACE["signature"].dataType).alias("signature"), F.lit(0).cast("long").alias("seq"))
    return rows


def full_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source text of both snapshots to the report."""
    # no surface lacks a name or a kind: asked for everywhere, rows are whole and the same, so names come from the exchange that the report reads
    base, new = (s.upsert(d.texts(extract(w.sources(spark, sf_dir, side)))).where("fqn IS NOT NULL") for side in (False, True))
    return _long(d.diff(base, new, d.owned(base.where("signature.kind IS NOT NULL"), new)))


def _index_roundtrip(spark, sf_dir):
    """The base snapshot as JSON entries, read back."""
    base = w.surfaces(spark, sf_dir, False)
    lines = store.json_lines(base)
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    lines.select(F.concat(F.lit("{"), F.col("entry"), F.lit("}")).alias("value")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    rows = store.load_json_lines(spark, path)
    return _entries_shape(rows)


def _entries_shape(rows: DataFrame) -> DataFrame:
    return rows.select("fqn", "file_path", F.col("signature.kind").alias("kind"), F.size("signature.ts_method.parameters").cast("long").alias("n_params"), F.col("source_token.text_normalized").alias("text"))


def _index_object(spark, sf_dir):
    """The base snapshot as one JSON object, read back in blocks."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}.json.gz"
    store.save_json(w.surfaces(spark, sf_dir, False), path)
    return _entries_shape(store.load_json(spark, path))


def _saved(compare, column: str):
    """Both snapshots saved, loaded and compared, which takes no shuffle."""

    def run(spark, sf_dir):
        both = []
        for rows in _snapshots(spark, sf_dir):
            both.append(f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}")
            store.save(rows, both[-1])
        return compare(*(store.load(spark, p) for p in both)).select(column)

    return run


def _report_file(fmt: str, separator: str):
    """The report as the file that check writes, read back by its entries; without source lines."""

    def run(spark, sf_dir):
        path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
        files = w.sources(spark, sf_dir, True).where("false") if fmt == "human" else None
        output.write(_report(spark, sf_dir), path, fmt, files)
        return spark.read.option("lineSep", separator).text(path).select(F.regexp_replace("value", r"\n$", "").alias("entry"))

    return run


def _tree_files(spark, sf_dir):
    """Files as a tree, of which a scan reads the component sources."""
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    w.write_tree(spark, sf_dir, root)
    return read_files(spark, root)


def _components_only(spark, sf_dir):
    rows = extract(w.small_files(spark, sf_dir))
    return rows.where(F.size(F.split("fqn", r"\.")) == 2).select("fqn", "file_path")


def _skipped(private: bool):
    """Files without any surface: the private ones, or those that have no component."""

    def run(spark, sf_dir):
        files = w.small_files(spark, sf_dir)
        without = files.join(extract(files).select(F.col("file_path").alias("repo_path")), "repo_path", "left_anti")
        return without.where(text.is_private(F.col("content")) == private).select("repo_path")

    return run


def _broken_files(spark, sf_dir):
    """What stands around the broken parts."""
    rows = extract(w.broken_files(spark, sf_dir)).where("not fqn like '%.method.bad' and not fqn like '%.method.view'")
    return rows.select("fqn", F.col("source_token.text_normalized").alias("text"))


def _ranges(spark, sf_dir):
    """Byte and point ranges of methods."""
    rows = extract(w.sources(spark, sf_dir)).where("signature.kind = 'TsMethod'")
    r = F.col("source_token.source_range")
    points = [r[f"{p}_point"][f].alias(f"{p}_{f}") for p in ("start", "end") for f in ("row", "column")]
    return rows.select("fqn", r["start_byte"].alias("start_byte"), r["end_byte"].alias("end_byte"), *points)


def _prop_definitions(spark, sf_dir):
    rows = extract(w.prop_files(spark, sf_dir)).where("signature.kind = 'VueProp'")
    prop = lambda f: F.col(f"signature.vue_prop.{f}.text_normalized")
    return rows.select("fqn", prop("type_annotation").alias("type"), prop("required").alias("required"))


def _kind_mismatches(spark, sf_dir):
    """A new snapshot in which some props and methods have become something else."""
    base = w.surfaces(spark, sf_dir, False)
    number = F.regexp_extract("fqn", "-([0-9]+)", 1).cast("long")
    kind = F.col("signature.kind")
    other = F.when((kind == "VueProp") & (number % 3 == 0), "TsMethod").when((kind == "TsMethod") & (number % 5 == 0), "None").otherwise(kind)
    return d.mismatches(base, base.withColumn("signature", F.col("signature").withField("kind", other)))


QUERIES = {
    "normalize_ws": _documents(text.normalize_ws),
    "private_marker": _documents(text.is_private),
    "escape_data": _pages("html", text.escape_data),
    "escape_property": _pages("url", text.escape_property),
    "file_filter": _paths("path", paths.is_source),
    "spec_filter": _paths("path", paths.is_spec),
    "test_dir_prune": _paths("path", paths.in_tests),
    "admin_path": _paths("path", paths.is_admin),
    "dispatch": _paths("path", paths.dispatch),
    "component_from_template": _paths("imported", paths.component_from_template),
    "component_from_path": _paths("path", paths.component_from_path),
    "split_component_fqn": _paths("fqn", text.owner),
    "extract_emits": _extracted("emit", _fqn_shape),
    "extract_props_object": _extracted("prop", _prop_shape),
    "extract_prop_required": _extracted("prop", _required_shape),
    "extract_props_array": _extracted("prop", _method_shape, small=True),
    "extract_computed": _extracted("computed", lambda r: r.select("fqn", F.col("source_token.text_normalized").alias("sig"), F.col("signature.ts_method.return_type.text_normalized").alias("ret")), small=True),
    "extract_methods": _extracted("method", _method_shape),
    "extract_params": _extracted("method", _param_shape),
    "extract_async": _extracted("method", lambda r: r.where("signature.ts_method.async is not null").select("fqn")),
    "extract_return_type": _extracted("method", lambda r: r.select("fqn", F.col("signature.ts_method.return_type.text_normalized").alias("ret"))),
    "component_rows": _components_only,
    "private_skipped": _skipped(True),
    "no_component_skipped": _skipped(False),
    "broken_files": _broken_files,
    "extract_ranges": _ranges,
    "prop_definitions": _prop_definitions,
    "file_surface_count": lambda spark, sf_dir: s.file_counts(extract(w.small_files(spark, sf_dir))),
    "surface_dedup": lambda spark, sf_dir: s.upsert(_defined(spark, sf_dir)).select("fqn", "file_path"),
    "duplicate_fqns": lambda spark, sf_dir: s.duplicates(_defined(spark, sf_dir)),
    "surface_count": lambda spark, sf_dir: s.upsert(_defined(spark, sf_dir)).agg(F.count("*").alias("n")),
    "removed": lambda spark, sf_dir: d.removed(*_snapshots(spark, sf_dir)).select("fqn", F.col("source_token.text_normalized").alias("text")),
    "added": lambda spark, sf_dir: d.added(*_snapshots(spark, sf_dir)).select("fqn"),
    "matched": lambda spark, sf_dir: d.matched(*_snapshots(spark, sf_dir)).select("base.fqn"),
    "kind_mismatches": _kind_mismatches,
    "chg_async": _changes("TsMethodAsyncChanged"),
    "chg_return": _changes("TsMethodReturnTypeChanged"),
    "chg_param_required": _changes("TsMethodParamBecameRequired"),
    "chg_param_type": _changes("TsMethodParamTypeChanged"),
    "chg_param_rest": _changes("TsMethodParamRestChanged"),
    "chg_param_added": _changes("TsMethodRequiredParamAdded"),
    "chg_param_removed": _changes("TsMethodParamRemoved"),
    "chg_prop_type": _changes("VuePropTypeChanged"),
    "chg_prop_required": _changes("VuePropBecameRequired"),
    "chg_prop_added": _changes("VueRequiredPropAdded"),
    "report_full": lambda spark, sf_dir: _long(_report(spark, sf_dir)),
    "report_counts_by_code": lambda spark, sf_dir: _report(spark, sf_dir).groupBy(output.code(F.col("kind")).alias("code")).agg(F.count("*").alias("n")),
    "has_breaks": lambda spark, sf_dir: _report(spark, sf_dir).limit(1).agg((F.count("*") > 0).alias("breaks")),
    "github_lines": lambda spark, sf_dir: output.github_lines(_report(spark, sf_dir)),
    "json_report": lambda spark, sf_dir: output.json_entries(_report(spark, sf_dir)),
    "human_report": lambda spark, sf_dir: output.human_rows(_report(spark, sf_dir), w.sources(spark, sf_dir, True)).select("code", "headline", "fqn", "label", "help", "before", "file", "line", "column", "end_line", "end_column"),
    "index_roundtrip": _index_roundtrip,
    "index_object": _index_object,
    "matched_saved": _saved(d.matched, "base.fqn"),
    "removed_saved": _saved(d.removed, "fqn"),
    "added_saved": _saved(d.added, "fqn"),
    "github_file": _report_file("github", "\n"),
    "human_file": _report_file("human", "\n\n"),
    "tree_files": _tree_files,
    "odd_components": lambda spark, sf_dir: extract(w.odd_components(spark, sf_dir)).select("fqn", "file_path"),
    "full_pipeline": full_pipeline,
}

# What the snapshots hold, by columns; each query's SQL goes on from here.
WITH = """
WITH bp AS (SELECT 'sw-part-' || p_partkey AS comp, p_partkey AS k, 'title' AS name, CASE WHEN p_partkey % 2 = 0 THEN 'String' ELSE 'Number' END AS type, p_partkey % 3 = 0 AS req FROM part
  UNION ALL SELECT 'sw-part-' || p_partkey, p_partkey, 'size', 'Number', p_size % 4 = 0 FROM part),
np AS (SELECT comp, k, name, CASE WHEN name = 'title' AND k % 7 = 0 THEN 'Boolean' ELSE type END AS type, req OR (name = 'title' AND k % 5 = 0) AS req FROM bp WHERE k % 11 <> 0 AND NOT (name = 'size' AND k % 13 = 0)
  UNION ALL SELECT 'sw-part-' || p_partkey, p_partkey, 'extra', 'Object', p_partkey % 2 = 0 FROM part WHERE p_partkey % 11 <> 0
  UNION ALL SELECT 'sw-new-' || p_partkey, p_partkey, 'title', 'String', true FROM part WHERE p_partkey % 17 = 0),
be AS (SELECT 'sw-part-' || p_partkey AS comp, p_partkey AS k, unnest(['change', 'save-' || (p_size % 3)]) AS name FROM part),
ne AS (SELECT * FROM be WHERE k % 11 <> 0 AND NOT (name = 'change' AND k % 6 = 0)),
li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS cnt FROM lineitem),
bq AS (SELECT l_orderkey AS k, pos, cnt, 'p' || pos AS name, CASE l_returnflag WHEN 'A' THEN 'string' WHEN 'N' THEN 'number' ELSE 'boolean' END AS type, l_linestatus = 'O' AND pos % 2 = 0 AS opt,
    pos = cnt AND l_orderkey % 10 = 0 AS rest, l_quantity % 5 = 0 AS fives, l_suppkey, l_partkey FROM li WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
nq AS (SELECT k, pos, cnt, name, CASE WHEN l_suppkey % 6 = 0 THEN 'Date' ELSE type END AS type, opt <> (l_partkey % 8 = 0) AS opt, pos = cnt AND k % 15 = 0 AS rest, fives FROM bq WHERE k % 4 <> 0 OR pos < cnt
  UNION ALL SELECT o_orderkey, coalesce(n, 0) + 1, NULL, 'extra', 'string', o_orderkey % 8 = 1, false, false FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 4 = 1),
bd AS (SELECT *, CASE WHEN NOT opt AND fives THEN '1' END AS def FROM bq),
nd AS (SELECT *, CASE WHEN NOT opt AND fives THEN '1' END AS def FROM nq),
bt AS (SELECT k, string_agg(CASE WHEN rest THEN '...' ELSE '' END || name || CASE WHEN opt THEN '?' ELSE '' END || ': ' || type || coalesce(' = ' || def, ''), ', ' ORDER BY pos) AS txt FROM bd GROUP BY k),
nt AS (SELECT k, string_agg(CASE WHEN rest THEN '...' ELSE '' END || name || CASE WHEN opt THEN '?' ELSE '' END || ': ' || type || coalesce(' = ' || def, ''), ', ' ORDER BY pos) AS txt FROM nd GROUP BY k),
bm0 AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS asy, CASE WHEN o_orderkey % 3 = 0 THEN 'Promise<void>' END AS ret FROM orders),
nm0 AS (SELECT o_orderkey AS k, (o_orderkey % 2 = 0) <> (o_orderkey % 9 = 0) AS asy, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN 'Promise<void>' END AS ret FROM orders WHERE o_orderkey % 19 <> 0),
bm AS (SELECT k, asy, ret, CASE WHEN asy THEN 'async ' ELSE '' END || 'load(' || coalesce(txt, '') || ')' || coalesce(': ' || ret, '') AS sig FROM bm0 LEFT JOIN bt USING (k)),
nm AS (SELECT k, asy, ret, CASE WHEN asy THEN 'async ' ELSE '' END || 'load(' || coalesce(txt, '') || ')' || coalesce(': ' || ret, '') AS sig FROM nm0 LEFT JOIN nt USING (k)),
mm AS (SELECT 'vue.sw-order-' || k || '.method.load' AS fqn, k, b.asy AS ba, n.asy AS na, b.ret AS br, n.ret AS nr, n.sig AS ns, b.sig AS bs FROM bm b JOIN nm n USING (k)),
bs AS (SELECT 'vue.' || comp AS fqn, '' AS txt, 0 AS r FROM (SELECT comp FROM bp UNION SELECT comp FROM be UNION SELECT 'sw-order-' || k FROM bm)
  UNION ALL SELECT 'vue.' || comp || '.prop.' || name, name, k % 50 FROM bp UNION ALL SELECT 'vue.' || comp || '.emit.' || name, name, k % 50 FROM be UNION ALL SELECT 'vue.sw-order-' || k || '.method.load', sig, k % 50 FROM bm),
ns AS (SELECT 'vue.' || comp AS fqn FROM (SELECT comp FROM np UNION SELECT comp FROM ne UNION SELECT 'sw-order-' || k FROM nm)
  UNION ALL SELECT 'vue.' || comp || '.prop.' || name FROM np UNION ALL SELECT 'vue.' || comp || '.emit.' || name FROM ne UNION ALL SELECT 'vue.sw-order-' || k || '.method.load' FROM nm),
pp AS (SELECT 'vue.' || comp || '.prop.' || name AS fqn, name, b.type AS bt, n.type AS nt, b.req AS bq, n.req AS nq, b.k AS k FROM bp b JOIN np n USING (comp, name)),
qq AS (SELECT fqn, b.k AS k, b.name AS bname, n.name AS nname, b.type AS btype, n.type AS ntype, b.opt AS bopt, n.opt AS nopt, n.def AS ndef, b.rest AS brest, n.rest AS nrest, b.pos AS bpos, n.pos AS npos, ns
  FROM mm JOIN bd b ON b.k = mm.k AND br IS NOT DISTINCT FROM nr FULL JOIN (SELECT nd.*, fqn AS f2 FROM nd JOIN mm ON mm.k = nd.k AND br IS NOT DISTINCT FROM nr) n ON n.k = b.k AND n.pos = b.pos),
added_q AS (SELECT 'vue.sw-order-' || n.k || '.method.load' AS fqn, n.* FROM nd n JOIN mm ON mm.k = n.k AND br IS NOT DISTINCT FROM nr WHERE NOT EXISTS (SELECT 1 FROM bd b WHERE b.k = n.k AND b.pos = n.pos)),
changed AS (
  SELECT 'TsMethodAsyncChanged' AS kind, fqn, CASE WHEN ba THEN 'async' END AS old, CASE WHEN na THEN 'async' ELSE ns END AS new, k % 50 AS r, CASE WHEN na THEN 0 ELSE k % 50 END AS nr, bs AS sig FROM mm WHERE ba <> na
  UNION ALL SELECT 'TsMethodReturnTypeChanged', fqn, br, coalesce(nr, ns), k % 50, CASE WHEN nr IS NULL THEN k % 50 ELSE 0 END, bs FROM mm WHERE br IS DISTINCT FROM nr
  UNION ALL SELECT 'TsMethodParamBecameRequired', fqn, CASE WHEN bopt THEN '?' END, CASE WHEN nopt THEN '?' ELSE nname END, 0, 0, NULL FROM qq WHERE bpos IS NOT NULL AND npos IS NOT NULL AND bopt <> nopt AND ndef IS NULL
  UNION ALL SELECT 'TsMethodParamTypeChanged', fqn, btype, ntype, 0, 0, NULL FROM qq WHERE bpos IS NOT NULL AND npos IS NOT NULL AND btype <> ntype
  UNION ALL SELECT 'TsMethodParamRestChanged', fqn, CASE WHEN brest THEN '...' END, CASE WHEN nrest THEN '...' ELSE nname END, 0, 0, NULL FROM qq WHERE bpos IS NOT NULL AND npos IS NOT NULL AND brest <> nrest
  UNION ALL SELECT 'TsMethodRequiredParamAdded', fqn, NULL, name, 0, 0, NULL FROM added_q WHERE NOT opt AND def IS NULL
  UNION ALL SELECT 'TsMethodParamRemoved', fqn, bname, ns, 0, k % 50, NULL FROM qq WHERE bpos IS NOT NULL AND npos IS NULL
  UNION ALL SELECT 'VuePropTypeChanged', fqn, bt, nt, k % 50, k % 50, NULL FROM pp WHERE bt <> nt
  UNION ALL SELECT 'VuePropBecameRequired', fqn, NULL, 'true', k % 50, k % 50, NULL FROM pp WHERE bt = nt AND NOT bq AND nq
  UNION ALL SELECT 'VueRequiredPropAdded', 'vue.' || comp || '.prop.' || name, NULL, 'true', k % 50, k % 50, NULL FROM np WHERE req AND comp IN (SELECT comp FROM bp) AND 'vue.' || comp || '.prop.' || name NOT IN (SELECT 'vue.' || comp || '.prop.' || name FROM bp)),
report AS (SELECT 'removed' AS section, fqn, NULL AS kind, NULL AS old, NULL AS new, r AS nr FROM bs WHERE fqn NOT IN (SELECT fqn FROM ns)
  UNION ALL SELECT 'breaking_changes', fqn, kind, old, new, nr FROM changed)
"""

PATHS = """
WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'src/Resources/app/administration/src/c' || p_partkey WHEN 1 THEN 'tests/Resources/app/administration/x' || p_partkey
    WHEN 2 THEN 'Resources/Resources/app/administration/y' || p_partkey WHEN 3 THEN 'src/test/z' || p_partkey ELSE 'a/Resources/app/administration' END
  || CASE p_partkey % 7 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' WHEN 2 THEN '.spec.ts' WHEN 3 THEN '.d.ts' WHEN 4 THEN '.php' WHEN 5 THEN '.vue' ELSE '' END AS path FROM part),
f AS (SELECT k, path, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS name, list_position(string_split(path, '/'), 'Resources') AS res FROM p),
g AS (SELECT *, contains(name, '.') AND string_split(name, '.')[-1] IN ('php', 'js', 'ts', 'twig') AS src, coalesce(res > 0 AND parts[res + 1] = 'app' AND parts[res + 2] = 'administration', false) AS admin FROM f)
"""
TEXT = "SELECT doc_id, {} AS value FROM documents"
CHANGE = WITH + "SELECT fqn, old, new FROM changed WHERE kind = '{}'"


def _token(text: str, row: str) -> str:
    """SQL: the JSON of a made-up token; null for a null text."""
    return (
        f"CASE WHEN ({text}) IS NULL THEN 'null' ELSE '{{\"text_normalized\":\"' || ({text}) || '\",\"source_range\":{{\"start_byte\":' || (({row}) * 100) || ',\"end_byte\":' || (({row}) * 100 + strlen({text})) || "
        f"',\"start_point\":{{\"row\":' || ({row}) || ',\"column\":4}},\"end_point\":{{\"row\":' || ({row}) || ',\"column\":' || (4 + strlen({text})) || '}}}}}}' END"
    )


def _surface(fqn: str, text: str, row: str, signature: str) -> str:
    return f"'{{\"file_path\":\"src/Resources/app/administration/src/' || string_split({fqn}, '.')[2] || '/index.ts\",\"source_token\":' || {_token(text, row)} || ',\"fqn\":\"' || {fqn} || '\",\"signature\":' || {signature} || '}}'"


def _prop(type_: str, required: str, row: str) -> str:
    return f"""'{{"VueProp":{{"type_annotation":' || {_token(type_, row)} || ',"required":' || {_token(f"CASE WHEN {required} THEN 'true' END", row)} || '}}}}'"""


_PARAM = f"""'{{"name":' || {_token("name", "0")} || ',"type_annotation":' || {_token("type", "0")} || ',"default_value":' || {_token("def", "0")} || ',"optional":' || {_token("CASE WHEN opt THEN '?' END", "0")} || ',"rest":' || {_token("CASE WHEN rest THEN '...' END", "0")} || '}}'"""
JSON = (
    WITH.rstrip()
    + f""",
pj AS (SELECT k, string_agg({_PARAM}, ',' ORDER BY pos) AS ps FROM bd GROUP BY k),
mj AS (SELECT 'vue.sw-order-' || k || '.method.load' AS fqn, sig, k % 50 AS r, '{{"TsMethod":{{"async":' || {_token("CASE WHEN asy THEN 'async' END", "0")} || ',"parameters":[' || coalesce(ps, '') || '],"return_type":' || {_token("ret", "0")} || '}}}}' AS js FROM bm LEFT JOIN pj USING (k)),
prj AS (SELECT 'vue.' || comp || '.prop.' || name AS fqn, name, k % 50 AS r, {_prop("type", "req", "k % 50")} AS js FROM bp),
npj AS (SELECT 'vue.' || comp || '.prop.' || name AS fqn, name, k % 50 AS r, {_prop("type", "req", "k % 50")} AS js FROM np),
sj AS (SELECT fqn, {_surface("fqn", "sig", "r", "js")} AS js FROM mj UNION ALL SELECT fqn, {_surface("fqn", "name", "r", "js")} FROM prj
  UNION ALL SELECT fqn, {_surface("fqn", "txt", "r", "'" + chr(34) + "None" + chr(34) + "'")} FROM bs WHERE NOT contains(fqn, '.prop.') AND NOT contains(fqn, '.method.')),
nj AS (SELECT fqn, {_surface("fqn", "name", "r", "js")} AS js FROM npj)
SELECT section, CASE WHEN kind IS NULL THEN sj.js ELSE '{{"surface":' || coalesce(sj.js, nj.js) || ',"kind":"' || kind || '","old":' || {_token("old", "CASE WHEN kind LIKE 'Vue%' THEN nr ELSE 0 END")} || ',"new":' || {_token("new", "nr")} || '}}' END AS entry
FROM report LEFT JOIN sj ON sj.fqn = report.fqn LEFT JOIN nj ON nj.fqn = report.fqn AND kind = 'VueRequiredPropAdded'"""
)

SQL = {
    "normalize_ws": TEXT.format(r"trim(regexp_replace(text, '[ \t\n\f\r]+', ' ', 'g'), ' ')"),
    "private_marker": TEXT.format("contains(text, '@private') OR contains(text, '@experimental') OR contains(text, '@internal')"),
    "escape_data": r"SELECT page_id, replace(replace(replace(html, '%', '%25'), chr(13), '%0D'), chr(10), '%0A') AS value FROM pages",
    "escape_property": r"SELECT page_id, replace(replace(replace(replace(replace(url, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), ':', '%3A'), ',', '%2C') AS value FROM pages",
    "file_filter": PATHS + "SELECT k, src AS value FROM g",
    "spec_filter": PATHS + r"SELECT k, regexp_matches(name, '\.spec\.[^.]*$') AS value FROM g",
    "test_dir_prune": PATHS + "SELECT k, list_has_any(parts[:-2], ['test', 'tests']) AS value FROM g",
    "admin_path": PATHS + "SELECT k, admin AS value FROM g",
    "dispatch": PATHS + "SELECT k, CASE WHEN admin AND contains(name, '.') AND string_split(name, '.')[-1] IN ('js', 'ts') THEN 'vue' ELSE 'none' END AS value FROM g",
    "component_from_template": "SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'sw-a' || p_partkey WHEN 1 THEN 'sw-b' || p_partkey END AS value FROM part",
    "component_from_path": PATHS + "SELECT k, CASE WHEN len(parts) > 1 THEN parts[-2] END AS value FROM g",
    "split_component_fqn": "SELECT p_partkey AS k, 'vue.sw-' || p_partkey AS value FROM part",
    "extract_emits": WITH + "SELECT 'vue.' || comp || '.emit.' || name AS fqn FROM be",
    "extract_props_object": WITH + "SELECT 'vue.' || comp || '.prop.' || name AS fqn, type FROM bp",
    "extract_prop_required": WITH + "SELECT 'vue.' || comp || '.prop.' || name AS fqn, 'true' AS required FROM bp WHERE req",
    "extract_props_array": "SELECT 'vue.sw-supplier-' || s_suppkey || '.prop.' || n AS fqn, q || n || q AS sig FROM (SELECT s_suppkey, unnest([{'q': chr(39), 'n': 'name'}, {'q': chr(34), 'n': 'nation' || (s_nationkey % 3)}], recursive := true) FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 9 <> 0)",
    "extract_computed": "SELECT 'vue.sw-supplier-' || s_suppkey || '.computed.' || n AS fqn, sig, ret FROM supplier, (VALUES ('total', 'total(): number', 'number'), ('half', 'get half()', NULL)) t(n, sig, ret) WHERE s_suppkey % 7 <> 0 AND s_suppkey % 9 <> 0",
    "extract_methods": WITH + "SELECT 'vue.sw-order-' || k || '.method.load' AS fqn, sig FROM bm",
    "extract_params": WITH + "SELECT 'vue.sw-order-' || k || '.method.load' AS fqn, pos - 1 AS pos, name, type AS type_annotation, def AS default_value, CASE WHEN opt THEN '?' END AS optional, CASE WHEN rest THEN '...' END AS rest FROM bd",
    "extract_async": WITH + "SELECT 'vue.sw-order-' || k || '.method.load' AS fqn FROM bm WHERE asy",
    "extract_return_type": WITH + "SELECT 'vue.sw-order-' || k || '.method.load' AS fqn, ret FROM bm",
    "component_rows": "SELECT 'vue.sw-supplier-' || s_suppkey AS fqn, 'src/Resources/app/administration/src/sw-supplier-' || s_suppkey || '/index.ts' AS file_path FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 9 <> 0",
    "private_skipped": "SELECT 'src/Resources/app/administration/src/sw-supplier-' || s_suppkey || '/index.ts' AS repo_path FROM supplier WHERE s_suppkey % 7 = 0",
    "no_component_skipped": "SELECT 'src/Resources/app/administration/src/sw-supplier-' || s_suppkey || '/index.ts' AS repo_path FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 9 = 0",
    "broken_files": "SELECT 'vue.sw-broken-' || s_suppkey || n AS fqn, txt AS text FROM supplier, (VALUES ('', ''), ('.emit.one', 'one'), ('.emit.two', 'two'), ('.emit.a', 'a'), ('.emit.c', 'c'), ('.method.before', 'before(a: string): void'), ('.method.after', 'after(b?: number)')) t(n, txt)",
    "extract_ranges": WITH + "SELECT 'vue.sw-order-' || k || '.method.load' AS fqn, lead_ AS start_byte, lead_ + strlen(sig) + 1 AS end_byte, 5::BIGINT AS start_row, 4::BIGINT AS start_column, 5::BIGINT AS end_row, (4 + strlen(sig) + 1)::BIGINT AS end_column FROM (SELECT k, sig, strlen('import template from ''./sw-order-' || k || '.html.twig'';' || chr(10) || '// é: public' || chr(10) || 'export default {' || chr(10) || '  template,' || chr(10) || '  methods: {' || chr(10) || '    ') AS lead_ FROM bm)",
    "prop_definitions": "SELECT 'vue.sw-props-' || s_suppkey || '.prop.' || coalesce(n, 'own' || s_suppkey) AS fqn, CASE WHEN n IS NULL THEN 'Own' || (s_suppkey % 4) ELSE t END AS type, r AS required FROM supplier, (VALUES ('plain', 'String', NULL), ('either', '[Number, String]', NULL), ('full', 'Object', 'true'), ('loose', '[Array, Object]', NULL), ('must', NULL, 'true'), (NULL, NULL, NULL), ('''quoted-name''', 'Boolean', NULL)) v(n, t, r)",
    "file_surface_count": "SELECT 'src/Resources/app/administration/src/sw-supplier-' || s_suppkey || '/index.ts' AS file_path, 5::BIGINT AS n FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 9 <> 0",
    "surface_dedup": "SELECT 'vue.sw-nation-' || c_nationkey AS fqn, max('f' || c_custkey) AS file_path FROM customer GROUP BY 1",
    "duplicate_fqns": "SELECT 'vue.sw-nation-' || c_nationkey AS fqn, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1",
    "surface_count": "SELECT count(DISTINCT c_nationkey) AS n FROM customer",
    "removed": WITH + "SELECT fqn, txt AS text FROM bs WHERE fqn NOT IN (SELECT fqn FROM ns)",
    "added": WITH + "SELECT fqn FROM ns WHERE fqn NOT IN (SELECT fqn FROM bs)",
    "matched": WITH + "SELECT fqn FROM ns WHERE fqn IN (SELECT fqn FROM bs)",
    "kind_mismatches": WITH + "SELECT 'vue.' || comp || '.prop.' || name AS fqn FROM bp WHERE k % 3 = 0 UNION ALL SELECT 'vue.sw-order-' || k || '.method.load' FROM bm WHERE k % 5 = 0",
    "chg_async": CHANGE.format("TsMethodAsyncChanged"),
    "chg_return": CHANGE.format("TsMethodReturnTypeChanged"),
    "chg_param_required": CHANGE.format("TsMethodParamBecameRequired"),
    "chg_param_type": CHANGE.format("TsMethodParamTypeChanged"),
    "chg_param_rest": CHANGE.format("TsMethodParamRestChanged"),
    "chg_param_added": CHANGE.format("TsMethodRequiredParamAdded"),
    "chg_param_removed": CHANGE.format("TsMethodParamRemoved"),
    "chg_prop_type": CHANGE.format("VuePropTypeChanged"),
    "chg_prop_required": CHANGE.format("VuePropBecameRequired"),
    "chg_prop_added": CHANGE.format("VueRequiredPropAdded"),
    "report_full": WITH + "SELECT section, fqn, kind, old, new FROM report",
    "report_counts_by_code": WITH + "SELECT CASE WHEN kind IS NULL THEN 'api:removed' ELSE lower(regexp_replace(regexp_replace(kind, '([a-z])([A-Z])', '\\1:\\2', 'g'), '([a-z])([A-Z])', '\\1:\\2', 'g')) END AS code, count(*) AS n FROM report GROUP BY 1",
    "has_breaks": WITH + "SELECT count(*) > 0 AS breaks FROM report",
    "full_pipeline": WITH + "SELECT section, fqn, kind, old, new FROM report",
    "github_lines": WITH
    + """SELECT r.fqn, '::error file=src/Resources/app/administration/src/' || string_split(r.fqn, '.')[2] || '/index.ts,line=' || (nr + 1) || ',col=5,endLine=' || (nr + 1) || ',endColumn=' || (5 + length(coalesce(r.new, b.txt)))
    || ',title=' || replace(CASE WHEN kind IS NULL THEN 'api:removed' ELSE lower(regexp_replace(kind, '([a-z])([A-Z])', '\\1:\\2', 'g')) END, ':', '%3A') || '::' || CASE WHEN kind IS NULL THEN 'Removed public API surface ''' || r.fqn || '''. Old signature was: ''' || b.txt || ''''
    ELSE 'Potential breaking change on public API surface ''' || r.fqn || ''': ' || CASE kind WHEN 'TsMethodAsyncChanged' THEN 'async changed' WHEN 'TsMethodReturnTypeChanged' THEN 'return type changed from ''' || coalesce(old, '') || ''' to ''' || new || ''''
      WHEN 'TsMethodParamBecameRequired' THEN 'parameter became required' WHEN 'TsMethodParamTypeChanged' THEN 'parameter type changed from ''' || old || ''' to ''' || new || '''' WHEN 'TsMethodParamRestChanged' THEN 'parameter ...rest changed'
      WHEN 'TsMethodRequiredParamAdded' THEN 'required parameter was added' WHEN 'TsMethodParamRemoved' THEN 'parameter ''' || old || ''' was removed'
      WHEN 'VuePropTypeChanged' THEN 'prop ''' || string_split(r.fqn, '.')[-1] || ''' type changed from ''' || old || ''' to ''' || new || '''' WHEN 'VuePropBecameRequired' THEN 'prop ''' || string_split(r.fqn, '.')[-1] || ''' became required'
      ELSE 'required prop ''' || string_split(r.fqn, '.')[-1] || ''' was added to existing component' END || CASE WHEN kind LIKE 'Ts%' THEN ' Old signature was: ''' || b.txt || '''' ELSE '' END END AS line
    FROM report r LEFT JOIN bs b ON b.fqn = r.fqn""",
    "json_report": JSON,
    "human_report": WITH
    + """SELECT CASE WHEN kind IS NULL THEN 'api:removed' ELSE lower(regexp_replace(kind, '([a-z])([A-Z])', '\\1:\\2', 'g')) END AS code, CASE WHEN kind IS NULL THEN 'Removed public API surface' ELSE 'Potential breaking change on public API surface' END AS headline, r.fqn,
    CASE WHEN kind IS NULL THEN 'was previously defined in this file' ELSE CASE kind WHEN 'TsMethodAsyncChanged' THEN 'async changed' WHEN 'TsMethodReturnTypeChanged' THEN 'return type changed from ''' || coalesce(old, '') || ''' to ''' || new || ''''
      WHEN 'TsMethodParamBecameRequired' THEN 'parameter became required' WHEN 'TsMethodParamTypeChanged' THEN 'parameter type changed from ''' || old || ''' to ''' || new || '''' WHEN 'TsMethodParamRestChanged' THEN 'parameter ...rest changed'
      WHEN 'TsMethodRequiredParamAdded' THEN 'required parameter added' WHEN 'TsMethodParamRemoved' THEN 'parameter removed'
      WHEN 'VuePropTypeChanged' THEN 'prop ''' || string_split(r.fqn, '.')[-1] || ''' type changed from ''' || old || ''' to ''' || new || '''' WHEN 'VuePropBecameRequired' THEN 'prop ''' || string_split(r.fqn, '.')[-1] || ''' became required'
      ELSE 'required prop ''' || string_split(r.fqn, '.')[-1] || ''' was added to existing component' END END AS label,
    CASE WHEN kind IS NULL OR kind LIKE 'Ts%' THEN 'old signature was: ' || b.txt END AS help, 'before: ' || old AS before, 'src/Resources/app/administration/src/' || string_split(r.fqn, '.')[2] || '/index.ts' AS file,
    nr + 1 AS line, 5::BIGINT AS "column", nr + 1 AS end_line, (5 + CASE WHEN kind IS NULL THEN 0 ELSE length(r.new) END)::BIGINT AS end_column FROM report r LEFT JOIN bs b ON b.fqn = r.fqn""",
    "index_roundtrip": WITH
    + """SELECT bs.fqn, 'src/Resources/app/administration/src/' || string_split(bs.fqn, '.')[2] || '/index.ts' AS file_path, CASE WHEN contains(bs.fqn, '.prop.') THEN 'VueProp' WHEN contains(bs.fqn, '.method.') THEN 'TsMethod' ELSE 'None' END AS kind,
    CASE WHEN contains(bs.fqn, '.method.') THEN coalesce(n, 0) END AS n_params, txt AS text FROM bs LEFT JOIN (SELECT 'vue.sw-order-' || k || '.method.load' AS fqn, count(*) AS n FROM bd GROUP BY k) c ON c.fqn = bs.fqn""",
}
SQL |= {
    "index_object": SQL["index_roundtrip"],
    "matched_saved": SQL["matched"],
    "removed_saved": WITH + "SELECT fqn FROM bs WHERE fqn NOT IN (SELECT fqn FROM ns)",
    "added_saved": SQL["added"],
    "github_file": f"SELECT line AS entry FROM ({SQL['github_lines']})",
    "human_file": f"""SELECT '[' || code || '] Error: ' || headline || chr(10) || '   --> ' || file || ':' || line || ':' || "column" || chr(10) || ' ' || repeat(' ', length(end_line::VARCHAR)) || ' | ' || label || chr(10)
    || CASE WHEN length(help) > 0 THEN '    = help: ' || help || chr(10) ELSE '' END || '    = note: API surface: ' || fqn || CASE WHEN length("before") > 0 THEN chr(10) || '    = note: ' || "before" ELSE '' END AS entry FROM ({SQL['human_report']})""",
    "tree_files": """SELECT 'src/Resources/app/administration/src/sw-supplier-' || s_suppkey || '/index.ts' AS repo_path, CASE WHEN s_suppkey % 7 = 0 THEN '/* @private */' || chr(10) ELSE '' END || CASE WHEN s_suppkey % 9 = 0 THEN 'export const a = { methods: { b() {} } };' || chr(10)
    ELSE 'export default Shop.wrapComponentConfig({' || chr(10) || '  props: [''name'', "nation' || (s_nationkey % 3) || '"],' || chr(10) || '  computed: {' || chr(10) || '    total(): number { return 1; },' || chr(10) || '    get half() { return 0.5; },' || chr(10) || '  },' || chr(10) || '});' || chr(10) END AS content FROM supplier""",
    "odd_components": """SELECT 'vue.' || CASE WHEN s_suppkey % 4 = 2 THEN 'card-' ELSE 'sw-own-' END || s_suppkey || n AS fqn, 'src/Resources/app/administration/src/' || CASE WHEN s_suppkey % 4 = 2 THEN 'card-' ELSE 'sw-own-' END || s_suppkey || '/index.ts' AS file_path
    FROM supplier, (VALUES (''), ('.emit.')) t(e), LATERAL (SELECT CASE WHEN e = '' THEN '' WHEN s_suppkey % 4 = 2 THEN '.emit.a' ELSE '.emit.b' END AS n) WHERE s_suppkey % 4 >= 2""",
}
