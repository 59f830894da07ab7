from pyspark.sql import functions as F

from tessel.functions import paths, text

PATHS = {
    # path: source, spec, in tests, admin, dispatch
    "Resources/app/administration/start.js": (True, False, False, True, "vue"),
    "lib/x/Resources/app/administration/y/z.js": (True, False, False, True, "vue"),
    "app/administration/start.ts": (True, False, False, False, "none"),
    "a/Resources/app/shopfront/start.js": (True, False, False, False, "none"),
    "Resources/Resources/app/administration/x.js": (True, False, False, False, "none"),
    "Resources/app/administration/a.spec.ts": (True, True, False, True, "vue"),
    "tests/x.js": (True, False, True, False, "none"),
    "a/test/x.js": (True, False, True, False, "none"),
    "a/test": (False, False, False, False, "none"),
    "a/_x.d.ts": (True, False, False, False, "none"),
    "Resources/app/administration/x.TSX": (False, False, False, True, "none"),
    "Resources/app/administration/x.twig": (True, False, False, True, "none"),
    "Resources": (False, False, False, False, "none"),
    "noext": (False, False, False, False, "none"),
    "": (False, False, False, False, "none"),
}


def test_path_rules(spark):
    c = F.col("p")
    rows = spark.createDataFrame([(p,) for p in PATHS], "p string").select("p", paths.is_source(c), paths.is_spec(c), paths.in_tests(c), paths.is_admin(c), paths.dispatch(c)).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == PATHS


def test_component_names(spark):
    templates = {
        "./sw-lamp.html.twig": "sw-lamp", "./up/../sw-b.html.twig": None, "../foo.html.twig": "foo", "foo.html.twig": None,
        "./a.b.html.twig": "a", "./a.scss": None, "./.html.twig": "",
    }
    got = spark.createDataFrame([(t,) for t in templates], "t string").select("t", paths.component_from_template(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == templates
    folders = {"x/y/sw-lamp/z.ts": "sw-lamp", "index.js": None, "/index.js": None, "a/index.js": "a"}
    got = spark.createDataFrame([(t,) for t in folders], "t string").select("t", paths.component_from_path(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == folders


def test_white_space_and_escapes(spark):
    values = ["a%b", "x\r\ny", "x:y,z", "%0A", " a \t\n\f b ", "a\x0bb", "a  b", "", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.normalize_ws(F.col("v")), text.escape_data(F.col("v")), text.escape_property(F.col("v"))).collect()
    assert [tuple(r) for r in rows] == [
        ("a%b", "a%b", "a%25b", "a%25b"),
        ("x\r\ny", "x y", "x%0D%0Ay", "x%0D%0Ay"),
        ("x:y,z", "x:y,z", "x:y,z", "x%3Ay%2Cz"),
        ("%0A", "%0A", "%250A", "%250A"),
        (" a \t\n\f b ", "a b", " a \t%0A\f b ", " a \t%0A\f b "),
        ("a\x0bb", "a\x0bb", "a\x0bb", "a\x0bb"),
        ("a  b", "a  b", "a  b", "a  b"),
        ("", "", "", ""),
        (None, None, None, None),
    ]


def test_owner_slices_and_positions(spark):
    row = spark.range(1).select(text.owner(F.lit("vue.c.prop.a.prop.b")), text.byte_slice(F.lit("é=x"), F.lit(2), F.lit(4)), text.one_based(F.lit(0)), text.is_private(F.lit("@internal"))).first()
    assert tuple(row) == ("vue.c", "=x", 1, True)
