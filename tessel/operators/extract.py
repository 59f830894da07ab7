"""Extraction of public surfaces from component sources.

``surfaces_of`` reads one file; ``extract`` applies it to a DataFrame (repo_path, content) in Arrow batches. Files that
are private or define no component give no rows; of a file with broken parts, the others are read.
"""

from __future__ import annotations

import logging
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.arrow import map_arrow
from ..schema import EXTRACTED
from .shapes import Shapes, Unshared, rows
from .syntax import ESCAPE, PAIRS, Member, Source, SyntaxProblem

log = logging.getLogger(__name__)
# Markers, the wrapper's name, the template's ending, the names' prefix
PRIVATE = ("@private", "@experimental", "@internal")
WRAPPER = re.compile("wrapComponentConfig")
TEMPLATE = ".html.twig"
PREFIX = "sw-"
SPLICE = re.compile(r"\$\{|" + ESCAPE.pattern, re.S)
WHITE = re.compile(rb"[ \t\n\f\r]+")


class File:
    """What one file holds."""

    def __init__(self, path: str, raw: bytes):
        self.path = path
        self.src = Source(raw)

    # tokens as rows

    def token(self, start: int, end: int) -> dict:
        """Normalised text and range of a byte range."""
        text = self.normal(self.src.raw[start:end]).decode("utf-8", "replace")
        (r0, c0), (r1, c1) = self.src.point(start), self.src.point(end)
        return {"text_normalized": text, "source_range": {"start_byte": start, "end_byte": end, "start_point": {"row": r0, "column": c0}, "end_point": {"row": r1, "column": c1}}}

    @staticmethod
    def normal(raw: bytes) -> bytes:
        return b" ".join(x for x in WHITE.split(raw) if x) if WHITE.search(raw) else raw

    def problem(self, message: str, *args) -> None:
        log.error(message, *args)

    def of(self, a: int, b: int | None = None) -> dict:
        """Token a, or tokens a up to b."""
        t = self.src.tokens
        return self.token(t[a].start, t[(a + 1 if b is None else b) - 1].end)

    def text(self, a: int, b: int) -> str:
        return self.src.raw[self.src.tokens[a].start : self.src.tokens[b - 1].end].decode("utf-8", "replace")

    # the file's top level

    def statements(self):
        """First tokens of the statements outside of all brackets."""
        s, start = self.src, True
        for i, t in enumerate(s.tokens):
            if s.parent[i] >= 0:
                continue
            if start or s.new_line(i) and not s.is_(i, ".", ",", "=", "(", "[", "?", ":") and not s.is_(i - 1, "=", ",", "(", "=>", "default", "export", "from", "import"):
                yield i
            start = t.kind == "mark" and t.text in (";", "}")

    def is_private(self) -> bool:
        """A comment of the program itself, not of a statement, has a marker."""
        s = self.src
        for c, after in s.comments:
            if not any(m in c.text for m in PRIVATE):
                continue
            outside = after == 0 or (s.parent[after] < 0 if after < len(s.tokens) else True) and not s.is_(after, ")", "]", "}")
            if outside and not (after and (s.is_(after - 1, "=", "=>", ",", "default", "export", "import", "from", "(", "[", "{", ".", "?", ":", "as") or s.tokens[after - 1].text in PAIRS)):
                return True
        return False

    def imports(self) -> list[tuple[int, int]]:
        """Byte ranges of what is imported, as text between escapes."""
        s, found = self.src, []
        for i in self.statements():
            if not s.is_(i, "import") or s.is_(i + 1, "(", "."):
                continue
            j = i + 1
            while j < len(s.tokens) and s.tokens[j].kind != "string" and not s.is_(j, ";"):
                j = s.match[j] + 1 if s.tokens[j].kind == "mark" and s.tokens[j].text in PAIRS else j + 1
            if j < len(s.tokens) and s.tokens[j].kind == "string":
                found += self.fragments(j)
        return found

    def fragments(self, i: int) -> list[tuple[int, int]]:
        """Byte ranges of a string's or template's text between its escapes and substitutions."""
        t = self.src.tokens[i]
        out, at, end = [], t.start + 1, t.end - 1
        template, next_ = t.kind == "template", at
        while next_ < end:
            m = (SPLICE if template else ESCAPE).search(self.src.text, next_, end)
            if m is None:
                break
            out.append((at, m.start()))
            at = next_ = self.src.braces(m.start() + 1) if m[0] == "${" else m.end()
        return [x for x in [*out, (at, end)] if x[0] < x[1]]

    def roots(self) -> list[int]:
        """Braces of the component's object: the default export, or the objects that the wrapper is called with."""
        s, out = self.src, []
        for i in self.statements():
            if not (s.is_(i, "export") and s.is_(i + 1, "default")):
                continue
            a = i + 2
            if s.is_(a, "{"):
                end = s.match[a] + 1
                if end >= len(s.tokens) or s.is_(end, ";") or s.new_line(end) and not s.is_(end, ".", "as", "satisfies", "["):
                    out = [a]
                continue
            b = a
            while b < len(s.tokens) and not s.is_(b, ";") and not (b > a and s.new_line(b) and not s.is_(b, ".", "(") and not s.is_(b - 1, ".", "(")):
                b = s.match[b] + 1 if s.tokens[b].kind == "mark" and s.tokens[b].text in PAIRS else b + 1
            if b > a and s.is_(b - 1, ")"):
                args = s.match[b - 1]
                if args > a and WRAPPER.search(self.text(a, args)):
                    objects = [x for x, y in s.elements(args) if s.group((x, y)) == "object"]
                    out = objects[-1:] or out
        return out

    # surfaces

    def surfaces(self) -> list[dict]:
        if self.is_private():
            return []
        roots = self.roots()
        if not roots:
            return []
        raw = self.src.raw
        name = component_name(self.path, [raw[a:b].decode("utf-8", "replace") for a, b in self.imports()])
        if not name:
            return []
        found = self.members(roots)
        if not found:
            return []
        warn_of(name, self.path)
        out = [surface(self.path, token, f"vue.{name}.{kind}.{raw[a:b].decode('utf-8', 'replace')}", method, prop) for kind, (a, b), token, method, prop in found]
        out.append(surface(self.path, self.token(0, 0), f"vue.{name}"))
        return [x | {"seq": k} for k, x in enumerate(out)]

    def members(self, roots: list[int]) -> list[tuple]:
        """What the objects define: (kind, byte range of its name, token, method, prop), in order."""
        s, out = self.src, []
        for root in roots:
            for i in range(root, s.match[root]):
                if s.is_(i, "{") and s.is_object(i):
                    for m in s.members(i):
                        if m.kind == "pair" and m.key == m.first and s.tokens[m.key].kind == "name":
                            try:
                                self.option(s.tokens[m.key].text, m, out)
                            except SyntaxProblem as problem:
                                self.problem("a part of %s isn't read: %s", self.path, problem)
        return out

    def option(self, key: str, m: Member, out: list[tuple]) -> None:
        """What one member of an options object defines."""
        s, (a, b) = self.src, m.value
        kind = s.group((a, b))
        if key == "emits" and kind == "array":
            for x, y in s.elements(a):
                if y - x == 1 and s.tokens[x].kind in ("string", "template"):
                    for start, end in self.fragments(x):
                        out.append(("emit", (start, end), self.token(start, end), None, None))
        elif key == "props" and kind == "array":
            for x, y in s.elements(a):
                if s.group((x, y)) == "string":
                    t = s.tokens[x]
                    out.append(("prop", (t.start + 1, t.end - 1), self.of(x), None, (None, None)))
        elif key == "props" and kind == "object":
            for p in s.members(a):
                if p.kind == "pair":
                    found = self.prop(p.value)
                    if found is None:
                        self.problem("prop of unknown kind in %s: %s", self.path, self.text(p.first, p.last + 1))
                    else:
                        end = s.key_end(p.key)
                        out.append(("prop", (s.tokens[p.key].start, s.tokens[end].end), self.of(p.key, end + 1), None, found))
        elif key == "props":
            self.problem("props of unknown kind in %s: %s", self.path, self.text(a, b))
        elif key in ("computed", "methods") and kind == "object":
            for d in s.members(a):
                if d.kind == "method":
                    span = s.tokens[d.key].start, s.tokens[s.key_end(d.key)].end
                    try:
                        out.append(("method" if key == "methods" else key, span, self.token(s.tokens[d.first].start, s.tokens[d.body].start), self.method(d), None))
                    except SyntaxProblem as problem:
                        self.problem("%s %s of %s isn't read: %s", key, self.text(d.key, s.key_end(d.key) + 1), self.path, problem)

    def prop(self, span: tuple[int, int]) -> tuple | None:
        """(type, required) of a prop's definition; None for kinds that aren't read."""
        s, kind = self.src, self.src.group(span)
        if kind in ("identifier", "array"):
            return self.of(*span), None
        if kind != "object":
            return None
        type_ = required = None
        for m in s.members(span[0]):
            if m.kind == "pair":
                key = self.text(m.key, s.key_end(m.key) + 1)
                if key == "type":
                    type_ = self.of(*m.value)
                elif key == "required" and self.text(*m.value) == "true":
                    required = self.of(*m.value)
        return type_, required

    def method(self, m: Member) -> dict:
        s = self.src
        is_async = s.is_(m.first, "async") and m.key != m.first
        return {"async": self.of(m.first) if is_async else None, "parameters": self.parameters(m.opening), "return_type": self.of(*m.returns) if m.returns else None}

    def parameters(self, opening: int) -> list[dict]:
        s, out, i, close = self.src, [], opening + 1, self.src.match[opening]
        while i < close:
            if s.is_(i, ","):
                i += 1
                continue
            while s.tokens[i].kind == "name" and s.tokens[i].text in ("public", "private", "protected", "readonly", "override") and s.tokens[i + 1].kind == "name":
                i += 1
            p = dict.fromkeys(("name", "type_annotation", "default_value", "optional", "rest"))
            if s.is_(i, "..."):
                p["rest"] = self.of(i)
                i += 1
            end = s.match[i] + 1 if s.is_(i, "{", "[") else i + 1
            p["name"], i = self.of(i, end), end
            if s.is_(i, "?"):
                p["optional"] = self.of(i)
                i += 1
            if s.is_(i, ":"):
                end = s.type_end(i + 1)
                p["type_annotation"], i = self.of(i + 1, end), end
            if s.is_(i, "="):
                end = s.value_end(i + 1, close)
                p["default_value"], i = self.of(i + 1, end), end
            if i < close and not s.is_(i, ","):
                raise SyntaxProblem("a parameter can't be read")
            out.append(p)
        return out


class Planned(File):
    """A file whose tokens are byte ranges, for the plan of its shape."""

    def token(self, start: int, end: int) -> tuple[int, int]:
        return start, end

    def problem(self, message: str, *args) -> None:
        raise Unshared  # each file of the shape is told of

    def plan(self) -> tuple[list, list]:
        """Byte ranges of imports, and what the file defines; nothing of private files and those without component."""
        if self.is_private():
            return [], []
        roots = self.roots()
        if not roots:
            return [], []
        found = self.members(roots)
        if not found:
            raise Unshared  # only those without a name are told of
        return self.imports(), found


def component_name(path: str, imports: list[str]) -> str | None:
    """The component's name by its template import (the last that tells), else by its directory."""
    found = None
    for named in map(template_name, imports):
        found = found if named is None else named
    found = found if found is not None else directory_name(path)
    if not found:
        log.warning("no component name for %s", path)
    return found


def warn_of(name: str, path: str) -> None:
    if not name.startswith(PREFIX):
        log.error("component %s of %s doesn't start with %s", name, path, PREFIX)


def surface(path: str, token: dict, fqn: str, method: dict | None = None, prop: tuple | None = None) -> dict:
    kind = "TsMethod" if method else "VueProp" if prop else "None"
    return {"file_path": path, "source_token": token, "fqn": fqn, "signature": {"kind": kind, "ts_method": method, "vue_prop": prop and {"type_annotation": prop[0], "required": prop[1]}}}


def template_name(imported: str) -> str | None:
    """The component that a template import names."""
    if not imported.endswith(TEMPLATE):
        return None
    _, slash, rest = imported.partition("/")
    return rest.partition(".")[0] if slash and "/" not in rest else None


def directory_name(path: str) -> str | None:
    parts = path.rsplit("/", 2)
    return parts[-2] or None if len(parts) > 1 else None


def surfaces_of(path: str, raw: bytes) -> list[dict]:
    """The surfaces of one file, the component's own last, in order of seq."""
    return File(path, raw).surfaces()


SHAPES = Shapes()


def _named(path: str, imports: list[str]) -> str | None:
    name = component_name(path, imports)
    if name:
        warn_of(name, path)
    return name


def _run(batches):
    schema = to_arrow_schema(EXTRACTED)
    for b in batches:
        shared, alone = [], []
        for path, raw in zip(b.column("repo_path").to_pylist(), b.column("content").to_pylist(), strict=True):
            text = raw.decode("latin-1")
            plan, pieces = SHAPES.plan(text, lambda path=path, raw=raw: Planned(path, raw))
            if plan is None:
                alone += surfaces_of(path, raw)
            else:
                shared.append((path, text, plan, pieces))
        found = rows(shared, _named, File.normal)
        if found is not None:
            yield found
        if alone:
            yield pa.RecordBatch.from_pylist(alone, schema)


def extract(files: DataFrame) -> DataFrame:
    """Surfaces (with seq) of files (repo_path, content); null contents are skipped. Path rules are the caller's."""
    rows = files.where("content is not null").selectExpr("repo_path", "cast(content as binary) as content")
    return map_arrow(rows, _run, EXTRACTED)
