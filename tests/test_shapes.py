"""Files read by their shape give the rows that parsing each of them gives."""

import random
import re

import pyarrow as pa
import pytest

from tessel.operators import extract as e
from tessel.operators.shapes import Plan, Shapes

COMPONENT = """import template from './sw-{0}-{1}.html.twig';
// é: shown to all
export default {{
  template,
  emits: ['change', `save-{1}`, "a\\u0041b{1}", `x${{ {0} }}y`],
  props: {{ {0}: String, either: [Number,  {0}], full: {{ type: Object, required: true, default: () => ({{}}) }}, none{1}: {{ type: {0}, required: {0} }} }},
  computed: {{ total(): number {{ return {1} / 2; }}, get half() {{ return /[a-z/]+{0}/gi.test(a) ? 1.5 : {1}; }} }},
  methods: {{
    async {0}(p1: string, ...p2?: Map<string, {0}> = {1}, {{ a, b }}: {0}): Promise<{0}> {{
      if ({0}) {{ return typeof {0} === 'x'; }}
      return [1, {1}].map((x) => {{ return x; }});
    }},
    'quoted-{0}'(a = {0} ? {{ b: 1 }} : {{}}) {{ }},
    view() {{ return <div title="{0}">{{x ? 1 : '}}'}}</div>; }},
  }},
}};
"""
OTHERS = (
    "export default Shop.wrapComponentConfig({{ props: ['name', \"{0}\"], computed: {{ total(): number {{ return {1}; }} }} }});\n",
    "export default Shop.{0}({{ emits: ['a'] }});\n",
    "// @{0}\nexport default {{ emits: ['a'] }};\n",
    "/* @private */\nexport default {{ emits: ['{0}'] }};\n",
    "export default {{ emits: ['a'], props: {0} }};\n",
    "export default {{ methods: {{ bad() {{ if (a)) {{ return {1}; }} }},\n    {0}(b?: number) {{ return 2; }} }} }};\n",
    "import {{ {0} }} from '{0}/{1}.html.twig'; import '../{0}.html.twig';\n{0} default {{ emits: ['a'] }};\n",
    "export default {{ {0}: ['a'], methods: {{ {0} run() {{}}, b() {{ return a /{0}/ 2; }} }} }};\n",
)
WORDS = ("apple", "b", "type", "async", "get", "emits", "props", "methods", "private", "privately", "wrapComponentConfig", "export", "return", "typeof", "as", "true", "required", "const", "x_1", "$el", "naïve", "of", "readonly", "gi", "u0041", "this", "in", "is")


def _batch(files):
    return pa.RecordBatch.from_pydict({"repo_path": [p for p, _ in files], "content": [c for _, c in files]})


def _read(files):
    rows = [r for b in e._run([_batch(files)]) for r in b.to_pylist()]
    return sorted(rows, key=lambda r: (r["file_path"], r["seq"]))


def _each(files):
    return sorted((r for p, c in files for r in e.surfaces_of(p, c)), key=lambda r: (r["file_path"], r["seq"]))


@pytest.fixture
def shapes(monkeypatch):
    fresh = Shapes()
    monkeypatch.setattr(e, "SHAPES", fresh)
    return fresh


def test_all_words_of_all_shapes(shapes):
    rnd = random.Random(3)
    files = []
    for text in (COMPONENT, *OTHERS):
        for word in WORDS * 3:
            files.append(text.format(word, rnd.choice(("1", "22", "077", "9"))))
    broken = [x[:i] + x[i + 1 :] for x in rnd.sample(files, 60) for i in rnd.sample(range(len(x)), 6)]
    swapped = [re.sub(r"[A-Za-z]\w*", lambda m: rnd.choice(WORDS) if rnd.random() < 0.02 else m[0], x) for x in files + broken]
    files = [(f"src/sw-f{i}/index.ts", x.encode()) for i, x in enumerate([*files, *broken, *swapped, *files, *broken])]
    assert _read(files) == _each(files)
    assert sum(p is not None for p in shapes.plans.values()) > 50


def test_white_space_and_texts_that_are_not_ascii(shapes):
    text = "export default {{ methods: {{ async\n  load(a:\t{0},\n  é: Größe,  b?) {{ return 1; }} }} }};"
    files = [(f"a/sw-f{i}/x.ts", text.format(w).encode()) for i, w in enumerate(("string", "number", "Map", "verylongname"))]
    assert _read(files) == _each(files)
    assert len(shapes.plans) == 1


def test_files_of_one_shape_are_parsed_twice_at_most(shapes, monkeypatch):
    parsed = []
    init = e.File.__init__
    monkeypatch.setattr(e.File, "__init__", lambda self, path, raw: (parsed.append(path), init(self, path, raw))[1])
    files = [(f"a/sw-order-{i}/index.ts", f"export default {{ methods: {{ load{i}(p1: T{i} = {i}) {{ return {i}; }} }} }};".encode()) for i in range(500)]
    rows = _read(files)
    assert len(rows) == 1000 and len(parsed) == 2
    assert {r["fqn"] for r in rows} == {x for i in range(500) for x in (f"vue.sw-order-{i}", f"vue.sw-order-{i}.method.load{i}")}


def test_shapes_are_dropped_when_they_get_too_many(shapes, monkeypatch):
    monkeypatch.setattr("tessel.operators.shapes.KEPT", 10_000)
    files = [(f"a/sw-f{i}/x.ts", f"export default {{ emits: [{', '.join(['a'] and repr('a') for _ in range(i % 40))}] }};".encode()) for i in range(400)]
    assert _read(files) == _each(files)
    assert shapes.kept <= 13_000 and Plan
