"""Two snapshots of a component library, derived from the star schema's columns, as surfaces and as source text.

Parts are components with props, emits and a computed value; orders are components with a method whose parameters are
the order's lines. The new snapshot differs by rules on keys. Suppliers are small files of other shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrow import map_arrow
from ..schema import METHOD, PARAM, PROP
from ..sources.sink import opened

FOLDER = "src/Resources/app/administration/src/"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token(text: Column, row: Column | int = 0) -> Column:
    """A token of that text at a made-up place; null for a null text."""
    row = (F.lit(row) if isinstance(row, int) else row).cast("long")
    n = F.octet_length(text).cast("long")
    point = lambda c: F.struct(row.alias("row"), c.cast("long").alias("column"))
    at = F.struct((row * 100).alias("start_byte"), (row * 100 + n).alias("end_byte"), point(F.lit(4)).alias("start_point"), point(F.lit(4) + n).alias("end_point"))
    return F.when(text.isNotNull(), F.struct(text.alias("text_normalized"), at.alias("source_range")))


def flag(condition: Column, text: str) -> Column:
    return F.when(condition, F.lit(text))


def props(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """(comp, k, name, type, req) of the props of a snapshot."""
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("sw-part-"), F.col("p_partkey")).alias("comp"), F.col("p_partkey").alias("k"), "p_size")
    k = F.col("k")
    title = F.when(k % 2 == 0, "String").otherwise("Number")
    if not new:
        each = [("title", title, k % 3 == 0, None), ("size", F.lit("Number"), F.col("p_size") % 4 == 0, None)]
    else:
        each = [
            ("title", F.when(k % 7 == 0, "Boolean").otherwise(title), (k % 3 == 0) | (k % 5 == 0), None),
            ("size", F.lit("Number"), F.col("p_size") % 4 == 0, k % 13 != 0),
            ("extra", F.lit("Object"), k % 2 == 0, None),
        ]
    old = p.where(k % 11 != 0) if new else p
    rows = F.array(*[F.when(F.lit(True) if keep is None else keep, F.struct(F.lit(n).alias("name"), t.alias("type"), r.alias("req"))) for n, t, r, keep in each])
    out = old.select("comp", "k", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("p")).select("comp", "k", "p.*")
    if new:
        fresh = p.where(k % 17 == 0).select(F.concat(F.lit("sw-new-"), k).alias("comp"), "k", F.lit("title").alias("name"), F.lit("String").alias("type"), F.lit(True).alias("req"))
        out = out.unionByName(fresh)
    return out


def emits(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """(comp, k, name) of the emitted events of a snapshot."""
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("sw-part-"), F.col("p_partkey")).alias("comp"), F.col("p_partkey").alias("k"), F.concat(F.lit("save-"), F.col("p_size") % 3).alias("save"))
    k = F.col("k")
    names = F.array(F.lit("change"), F.col("save")) if not new else F.filter(F.array(F.when(k % 6 != 0, "change"), F.col("save")), lambda x: x.isNotNull())
    return (p.where(k % 11 != 0) if new else p).select("comp", "k", F.explode(names).alias("name"))


def _orders(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return o.where(F.col("k") % 19 != 0) if new else o


def _method_name(k: Column) -> Column:
    return F.concat(F.lit("vue.sw-order-"), k, F.lit(".method.load"))


def methods(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """(fqn, comp, k, asy, ret, params: array of (name, type, def, opt, rest), sig) of the methods of a snapshot, dealt by fqn."""
    # dealt by the name of their order's method: what is built of the lines then lies where snapshots are joined
    line = read(spark, sf_dir, "lineitem")
    rest = [c for c in line.columns if c not in ("l_orderkey", "l_linenumber")]
    line = line.repartition(_method_name(F.col("l_orderkey"))).withColumn("fqn", _method_name(F.col("l_orderkey")))
    w = Window.partitionBy("fqn").orderBy("l_linenumber", *rest)
    fact = F.struct(F.col("l_returnflag").alias("flag"), (F.col("l_linestatus") == "O").alias("open"), (F.col("l_quantity") % 5 == 0).alias("fives"), (F.col("l_suppkey") % 6 == 0).alias("date"), (F.col("l_partkey") % 8 == 0).alias("turned"))
    # one sort: the window that numbers the lines also gathers them, in order; the first line keeps the list
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lists = line.select("fqn", F.col("l_orderkey").alias("k"), F.row_number().over(w).alias("pos"), F.collect_list(fact).over(whole).alias("lines")).where("pos = 1").select("fqn", "k", "lines")
    k, n = F.col("k"), F.size("lines")

    def param(x: Column, i: Column) -> Column:
        pos = i + 1
        kind = F.when(x["flag"] == "A", "string").when(x["flag"] == "N", "number").otherwise("boolean")
        opt = x["open"] & (pos % 2 == 0)
        if new:
            kind, opt = F.when(x["date"], "Date").otherwise(kind), opt != x["turned"]
        default = F.when(~opt & x["fives"], "1")
        return F.struct(pos.cast("int").alias("pos"), F.concat(F.lit("p"), pos).alias("name"), kind.alias("type"), default.alias("def"), opt.alias("opt"), ((pos == n) & (k % (15 if new else 10) == 0)).alias("rest"))

    params = F.transform("lines", param)
    if new:
        params = F.when(k % 4 == 0, F.slice(params, F.lit(1), n - 1)).otherwise(params)
    # one row each, and said so: where only names are asked for, Spark leaves out the join
    lists = lists.groupBy("fqn").agg(F.first("k").alias("k"), F.first("lines").alias("lines")).select("fqn", params.alias("params"))
    o = _orders(spark, sf_dir, new).repartition(_method_name(k)).withColumn("fqn", _method_name(k))
    out = o.join(lists, "fqn", "left").withColumn("params", F.coalesce("params", F.array().cast("array<struct<pos:int,name:string,type:string,def:string,opt:boolean,rest:boolean>>")))
    asy, ret = k % 2 == 0, F.when(k % 3 == 0, "Promise<void>")
    if new:
        asy, ret = asy != (k % 9 == 0), F.when((k % 3 == 0) & (k % 5 != 0), "Promise<void>")
        extra = F.struct(F.lit(0).alias("pos"), F.lit("extra").alias("name"), F.lit("string").alias("type"), F.lit(None).cast("string").alias("def"), (k % 8 == 1).alias("opt"), F.lit(False).alias("rest"))
        out = out.withColumn("params", F.when(k % 4 == 1, F.concat("params", F.array(extra))).otherwise(F.col("params")))
    text = F.array_join(F.transform("params", lambda p: F.concat(F.when(p["rest"], "...").otherwise(""), p["name"], F.when(p["opt"], "?").otherwise(""), F.lit(": "), p["type"], F.coalesce(F.concat(F.lit(" = "), p["def"]), F.lit("")))), ", ")
    out = out.withColumn("asy", asy).withColumn("ret", ret)
    sig = F.concat(F.when(F.col("asy"), "async ").otherwise(""), F.lit("load("), text, F.lit(")"), F.coalesce(F.concat(F.lit(": "), F.col("ret")), F.lit("")))
    return out.select("fqn", F.concat(F.lit("sw-order-"), k).alias("comp"), "k", "asy", "ret", "params", sig.alias("sig"))


def _surfaces(rows: DataFrame, text: Column, row: Column, kind: str, method: Column | None = None, prop: Column | None = None) -> DataFrame:
    signature = F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast(METHOD) if method is None else method).alias("ts_method"), (F.lit(None).cast(PROP) if prop is None else prop).alias("vue_prop"))
    return rows.select(path(F.col("comp")).alias("file_path"), token(text, row).alias("source_token"), "fqn", signature.alias("signature"))


def path(comp: Column) -> Column:
    return F.concat(F.lit(FOLDER), comp, F.lit("/index.ts"))


def surfaces(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """The snapshot as surfaces, without any source text."""
    p, e, m = props(spark, sf_dir, new), emits(spark, sf_dir, new), methods(spark, sf_dir, new)
    fqn = lambda kind, name: F.concat(F.lit("vue."), F.col("comp"), F.lit(f".{kind}."), name)
    row = F.col("k") % 50
    each = lambda x: (x["name"], x["type"], x["def"], flag(x["opt"], "?"), flag(x["rest"], "..."))
    param = lambda x: F.struct(*[token(t).alias(n) for t, n in zip(each(x), PARAM.names, strict=True)])
    method = F.struct(token(flag(F.col("asy"), "async")).alias("async"), F.transform("params", param).alias("parameters"), token(F.col("ret")).alias("return_type"))
    prop = F.struct(token(F.col("type"), row).alias("type_annotation"), token(flag(F.col("req"), "true"), row).alias("required"))
    orders = _orders(spark, sf_dir, new).select(F.concat(F.lit("sw-order-"), "k").alias("comp"))
    comps = p.select("comp").unionByName(orders).unionByName(e.select("comp"))
    # each dealt by name while it is small, so that the union is, and snapshots are joined as they lie
    dealt = lambda rows, name: rows.withColumn("fqn", name).repartition("fqn")
    comps = dealt(comps, F.concat(F.lit("vue."), F.col("comp"))).dropDuplicates(["fqn", "comp"])
    p, e = dealt(p, fqn("prop", F.col("name"))), dealt(e, fqn("emit", F.col("name")))
    out = _surfaces(comps, F.lit(""), F.lit(0), "None")
    out = out.unionByName(_surfaces(p, F.col("name"), row, "VueProp", prop=prop))
    out = out.unionByName(_surfaces(e, F.col("name"), row, "None"))
    return out.unionByName(_surfaces(m, F.col("sig"), row, "TsMethod", method=method))


def sources(spark: SparkSession, sf_dir: str, new: bool = False) -> DataFrame:
    """The snapshot as files (repo_path, content)."""
    p, e, m = props(spark, sf_dir, new), emits(spark, sf_dir, new), methods(spark, sf_dir, new)
    one = F.concat(F.lit("    "), F.col("name"), F.lit(": { type: "), F.col("type"), F.lit(", required: "), F.col("req").cast("string"), F.lit(" },"))
    prop = p.groupBy("comp").agg(F.array_join(F.array_sort(F.collect_list(one)), "\n").alias("props"))
    emit = e.groupBy("comp").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("'"), F.col("name"), F.lit("'")))), ", ").alias("emits"))
    head = lambda: F.concat(F.lit("import template from './"), F.col("comp"), F.lit(".html.twig';\n// é: public\nexport default {\n  template,\n"))
    parts = prop.join(emit, "comp", "left").select("comp", F.concat(head(), F.lit("  emits: ["), F.coalesce("emits", F.lit("")), F.lit("],\n  props: {\n"), F.col("props"), F.lit("\n  },\n  data() { return { a: 1 }; },\n};\n")).alias("content"))
    orders = m.select("comp", F.concat(head(), F.lit("  methods: {\n    "), F.col("sig"), F.lit(" {\n      return [1, 2].map((x) => { return x; });\n    },\n    other: () => 1,\n  },\n};\n")).alias("content"))
    files = parts.unionByName(orders).select(path(F.col("comp")).alias("repo_path"), "content")
    # few bytes but much work: dealt to all cores, which the sizes of shuffled partitions alone would not do
    return files.repartition(4 * spark.sparkContext.defaultParallelism, "repo_path")


def small_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each supplier: wrapped, with props as an array and a computed value; some private, some without component."""
    k = F.col("s_suppkey")
    comp = F.concat(F.lit("sw-supplier-"), k)
    mark = F.when(k % 7 == 0, "/* @private */\n").otherwise("")
    body = F.concat(F.lit("export default Shop.wrapComponentConfig({\n  props: ['name', \"nation"), F.col("s_nationkey") % 3, F.lit("\"],\n  computed: {\n    total(): number { return 1; },\n    get half() { return 0.5; },\n  },\n});\n"))
    content = F.concat(mark, F.when(k % 9 == 0, "export const a = { methods: { b() {} } };\n").otherwise(body))
    return read(spark, sf_dir, "supplier").select(path(comp).alias("repo_path"), content.alias("content"))


def broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each supplier with something in the middle that can't be read, or that isn't plain script; what stands around it is as usual."""
    k = F.col("s_suppkey")
    comp = F.concat(F.lit("sw-broken-"), k)
    broken = [
        "    bad() {\n      if (a)) { return 1; }\n    },\n",  # a stray bracket
        "    view() {\n      return <div title=\"a\">don't {x ? <b>it's</b> : '}'}</div>;\n    },\n",
        "    bad() {\n      if (a) {\n        return 1;\n    },\n",  # a bracket without its end
        "    bad() {\n      return 'open;\n    },\n",
        "    bad() {\n      }\n    },\n",
        "    bad(a: Map<string, b) { return 1; },\n",
        "    bad() { return a # \\ `open; },\n",
    ]
    middle = F.element_at(F.array(*map(F.lit, broken)), (k % len(broken) + 1).cast("int"))
    head = "export default {\n  emits: ['one', `two`, `a${b}c`],\n  methods: {\n    before(a: string): void { return; },\n"
    content = F.concat(F.lit(head), middle, F.lit("    after(b?: number) { return 2; },\n  },\n};\n"))
    return read(spark, sf_dir, "supplier").select(path(comp).alias("repo_path"), content.alias("content"))


def odd_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each supplier that has no name, nothing to show, a name of another kind, or props that aren't listed."""
    k = F.col("s_suppkey")
    content = F.element_at(F.array(*map(F.lit, ("export default { emits: ['a'] };\n", "export default { data() { return { a: 1 }; } };\n", "export default { emits: ['a'] };\n", "export default { props: listed, emits: ['b'] };\n"))), (k % 4 + 1).cast("int"))
    where = F.when(k % 4 == 0, F.concat(F.lit("c"), k, F.lit(".ts"))).otherwise(path(F.concat(F.when(k % 4 == 2, "card-").otherwise("sw-own-"), k)))
    return read(spark, sf_dir, "supplier").select(where.alias("repo_path"), content.alias("content"))


def _written(root: str):
    def run(batches):
        store, top = opened(root)
        for b in batches:
            for name, text in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                at = f"{top}/{name}"
                store.create_dir(at.rpartition("/")[0])
                with store.open_output_stream(at) as f:
                    f.write(text.encode())
            yield b.select(["path"])

    return run


def write_tree(spark: SparkSession, sf_dir: str, root: str) -> None:
    """small_files as a tree of files, each among others that a scan leaves out; written by the tasks."""
    files = small_files(spark, sf_dir)
    twin = lambda a, b: F.regexp_replace("repo_path", a, b)
    each = [F.col("repo_path"), twin("index.ts$", "index.spec.ts"), twin("index.ts$", "test/x.ts"), twin("index.ts$", ".hidden/x.ts"), twin("index.ts$", "built/x.ts"), twin("index.ts$", "index.twig"), twin("^src/Resources", "src/Other")]
    rules = F.array(F.struct(F.lit(".gitignore").alias("path"), F.lit("# made\nbuilt/\n*.md\n").alias("content")))
    rows = files.select(F.explode(F.array(*[F.struct(c.alias("path"), F.col("content")) for c in each])).alias("f")).select("f.*")
    rows = rows.unionByName(spark.range(1).select(F.explode(rules).alias("f")).select("f.*"))
    map_arrow(rows, _written(root), "path string").count()


def prop_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each supplier with a definition of props of every kind."""
    k = F.col("s_suppkey")
    head = "export default {\n  props: {\n    plain: String,\n    either: [Number,  String],\n    full: { type: Object, required: true, default: () => ({}) },\n    loose: { type: [Array, Object], required: false },\n"
    more = "    must: { required: true },\n    none: null,\n    cast: Object as PropType<X>,\n    own"
    content = F.concat(F.lit(head + more), k, F.lit(": Own"), k % 4, F.lit(",\n    'quoted-name': { type: Boolean },\n  },\n};\n"))
    return read(spark, sf_dir, "supplier").select(path(F.concat(F.lit("sw-props-"), k)).alias("repo_path"), content.alias("content"))


def some_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, path, imported, fqn): paths, imports and names of many shapes, by part."""
    k = F.col("p_partkey")
    stem = F.element_at(F.array(*[F.concat(F.lit(s), k) for s in ("src/Resources/app/administration/src/c", "tests/Resources/app/administration/x", "Resources/Resources/app/administration/y", "src/test/z")], F.lit("a/Resources/app/administration")), (k % 5 + 1).cast("int"))
    end = F.element_at(F.array(*map(F.lit, (".ts", ".js", ".spec.ts", ".d.ts", ".php", ".vue", ""))), (k % 7 + 1).cast("int"))
    imported = F.element_at(F.array(*[F.concat(F.lit(a), k, F.lit(b)) for a, b in (("./sw-a", ".html.twig"), ("../sw-b", ".x.html.twig"), ("./sub/sw-c", ".html.twig"), ("sw-d", ".html.twig"), ("./sw-e", ".scss"))]), (k % 5 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(k.alias("k"), F.concat(stem, end).alias("path"), imported.alias("imported"), F.concat(F.lit("vue.sw-"), k, F.lit(".prop.a.prop.b")).alias("fqn"))
