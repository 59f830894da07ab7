import pytest

from tessel.operators.extract import extract, surfaces_of

PATH = "src/Resources/app/administration/src/sw-x/index.ts"
FIXTURE = """import template from './sw-card.html.twig';

// shown in lists; é
export default {
    template,
    emits: ['close', "open\\tit"],
    props: {
        title: { type: String, required: true },
        'my-size': [Number,   String],
        mode: Array,
        bad: null,
        cast: String as PropType<X>,
        late: { required: false, default() { return {}; } },
    },
    computed: {
        total(): number { return 1; },
        arrow: () => 2,
        ...mapState(['a']),
    },
    methods: {
        async load(id: string, opts?: Map<string, number>, n = 1, { a, b }: { a: string }, ...rest): Promise<void> {
            return rest;
        },
        plain() {},
    },
};
"""


def texts(source, path=PATH):
    return {x["fqn"]: x["source_token"]["text_normalized"] for x in surfaces_of(path, source.encode())}


def names(source, path=PATH):
    return sorted(x.removeprefix("vue.") for x in texts(source, path))


def test_fixture_surfaces():
    assert texts(FIXTURE) == {
        "vue.sw-card": "",
        "vue.sw-card.emit.close": "close",
        "vue.sw-card.emit.open": "open",
        "vue.sw-card.emit.it": "it",
        "vue.sw-card.prop.title": "title",
        "vue.sw-card.prop.'my-size'": "'my-size'",
        "vue.sw-card.prop.mode": "mode",
        "vue.sw-card.prop.late": "late",
        "vue.sw-card.computed.total": "total(): number",
        "vue.sw-card.method.load": "async load(id: string, opts?: Map<string, number>, n = 1, { a, b }: { a: string }, ...rest): Promise<void>",
        "vue.sw-card.method.plain": "plain()",
    }


def test_offsets_are_bytes():
    raw = FIXTURE.encode()
    found = 0
    for x in surfaces_of(PATH, raw):
        tokens = [x["source_token"]]
        s = x["signature"]
        if s["vue_prop"]:
            tokens += s["vue_prop"].values()
        if s["ts_method"]:
            tokens += [s["ts_method"]["async"], s["ts_method"]["return_type"], *[t for p in s["ts_method"]["parameters"] for t in p.values()]]
        for t in filter(None, tokens):
            r = t["source_range"]
            assert b" ".join(raw[r["start_byte"] : r["end_byte"]].split()).decode() == t["text_normalized"]
            for side in ("start", "end"):
                lead = raw[: r[f"{side}_byte"]]
                assert r[f"{side}_point"] == {"row": lead.count(b"\n"), "column": len(lead) - lead.rfind(b"\n") - 1}
            found += 1
    assert found > 25


def test_parameters_and_props():
    by = {x["fqn"]: x["signature"] for x in surfaces_of(PATH, FIXTURE.encode())}
    text = lambda t: t and t["text_normalized"]
    m = by["vue.sw-card.method.load"]
    assert (m["kind"], text(m["ts_method"]["async"]), text(m["ts_method"]["return_type"])) == ("TsMethod", "async", "Promise<void>")
    assert [tuple(text(p[f]) for f in ("name", "type_annotation", "default_value", "optional", "rest")) for p in m["ts_method"]["parameters"]] == [
        ("id", "string", None, None, None),
        ("opts", "Map<string, number>", None, "?", None),
        ("n", None, "1", None, None),
        ("{ a, b }", "{ a: string }", None, None, None),
        ("rest", None, None, None, "..."),
    ]
    prop = lambda n: tuple(map(text, by[f"vue.sw-card.prop.{n}"]["vue_prop"].values()))
    assert [prop(n) for n in ("title", "'my-size'", "mode", "late")] == [("String", "true"), ("[Number, String]", None), ("Array", None), (None, None)]


METHOD = "methods: { m() {} }"


@pytest.mark.parametrize(
    "source, expected",
    [
        (f"export default {{ {METHOD} }};\n/* @internal */", []),
        (f"// @experimental\nexport default {{ {METHOD} }}", []),
        ("export default { methods: { m() { /* @private */ } } }", ["sw-x", "sw-x.method.m"]),
        (f"import a from './sw-a.html.twig';\nimport b from './sw-b.html.twig';\nexport default {{ {METHOD} }}", ["sw-b", "sw-b.method.m"]),
        (f"import a from '../foo.html.twig';\nexport default {{ {METHOD} }}", ["foo", "foo.method.m"]),
        (f"import a from './a/foo.html.twig';\nimport './x.scss';\nexport default {{ {METHOD} }}", ["sw-x", "sw-x.method.m"]),
        (f"export default Shop.Component.wrapComponentConfig({{ {METHOD} }});", ["sw-x", "sw-x.method.m"]),
        (f"export default Shop.other({{ {METHOD} }});", []),
        (f"const a = {{ {METHOD} }};", []),
        ("export default {}", []),
        ("export default { props: ident }", []),
        ("export default { 'emits': ['a'] }", []),
        ("export default { props: { p: null, q: () => 1, r: a.b } }", []),
        ("export default { methods: { a: () => 1, ...b, c() {}, d } }", ["sw-x", "sw-x.method.c"]),
        ("export default { data() { return { methods: { z() {} } } } }", ["sw-x", "sw-x.method.z"]),
        ("export default { props: { props: { type: String } } }", ["sw-x", "sw-x.prop.props", "sw-x.prop.type"]),
        ("export default { props: { methods: { type: Array, default() {} } } }", ["sw-x", "sw-x.method.default", "sw-x.prop.methods"]),
        ("export default { props: ['a', \"b\", c, `d`] }", ["sw-x", "sw-x.prop.a", "sw-x.prop.b"]),
        ("export default { emits: { a: null } }", []),
        ("export default { emits: ['a', `b`, `c${ {x: `}`} }d\\ne`, [`f`], `` ] }", ["sw-x", "sw-x.emit.a", "sw-x.emit.b", "sw-x.emit.c", "sw-x.emit.d", "sw-x.emit.e"]),
        ("export default {\n  methods: {\n    a() {\n      if (x {\n    },\n    b() {}\n  }\n}", ["sw-x", "sw-x.method.a", "sw-x.method.b"]),
        ("export default { methods: { a() { ) }, b() {} } }", ["sw-x", "sw-x.method.a", "sw-x.method.b"]),
        ("export default { methods: { a() { return <p a='}'>don't {b ? <i/> : <>it's</>}</p>; }, b() {} } }", ["sw-x", "sw-x.method.a", "sw-x.method.b"]),
        ("export default { methods: { a() { return 'x\n }, b(): A<B {}, c() {} } }", ["sw-x", "sw-x.method.a", "sw-x.method.c"]),
        ("export default { methods: { a() { f = <T>(x) => <U>y; return a < b; }, b() {} } }", ["sw-x", "sw-x.method.a", "sw-x.method.b"]),
        ("export default { emits: ['a'], methods: { a() {} } }\n`open \x01 #", ["sw-x", "sw-x.emit.a", "sw-x.method.a"]),
        ("export default { computed: { get a() { return 1; }, set a(v) {} } }", ["sw-x", "sw-x.computed.a"]),
        ("export default { methods: { async *g() {}, [k]() {}, 'q'() {}, async() {} } }", ["sw-x", "sw-x.method.'q'", "sw-x.method.[k]", "sw-x.method.async", "sw-x.method.g"]),
        ("export default { a: /[{]/, b: `x${ {} }`, c: 1 / 2 / 3, methods: { m() { const r = /}/g; return a ? { methods: { deep() {} } } : 1; } } }", ["sw-x", "sw-x.method.deep", "sw-x.method.m"]),
        ("export default { methods: { m({ methods = 1 }: { methods: { no(): void } }) {} } }", ["sw-x", "sw-x.method.m"]),
        ("export default { methods: { m() {", []),
        ("export default { emits: ['a', 'a'] }", ["sw-x", "sw-x.emit.a"]),
    ],
)
def test_rules(source, expected):
    assert names(source) == sorted(expected)


def test_broken_sources_never_fail():
    """Every character of a file taken out, and brackets and quotes put in: nothing raises, and most surfaces stay."""
    raw = FIXTURE.encode()
    whole = {x["fqn"] for x in surfaces_of(PATH, raw)}
    left = []
    for i in range(0, len(raw), 3):
        for b in (raw[:i] + raw[i + 1 :], *(raw[:i] + c + raw[i:] for c in (b"}", b"(", b'"', b"`", b"<", b"\xff"))):
            left.append(len(whole & {x["fqn"] for x in surfaces_of(PATH, b)}))
    assert sum(left) > 0.8 * len(whole) * len(left)


def test_required_is_never_reset():
    s = surfaces_of(PATH, b"export default { props: { p: { type: X, type: Y, required: true, required: false } } }")[0]["signature"]["vue_prop"]
    assert (s["type_annotation"]["text_normalized"], s["required"]["text_normalized"]) == ("Y", "true")


def test_white_space_of_tokens():
    assert texts("export default { methods: { m(\n\ta,\f\r\n b) {} } }")["vue.sw-x.method.m"] == "m( a, b)"
    assert texts("export default { methods: { m(a = 'x \x0b y') {} } }")["vue.sw-x.method.m"] == "m(a = 'x \x0b y')"


def test_no_name_at_the_root():
    assert surfaces_of("index.js", b"export default { emits: ['a'] }") == []


def test_extract_frame(spark):
    files = spark.createDataFrame([(PATH, FIXTURE), ("a/b.js", None), ("a/sw-c/b.js", "export default { emits: ['e'] }")], "repo_path string, content string")
    rows = extract(files).orderBy("file_path", "seq").collect()
    assert len(rows) == 13
    assert [r["fqn"] for r in rows[:2]] == ["vue.sw-c.emit.e", "vue.sw-c"]
    assert extract(files.where("false")).count() == 0
