"""Tokens and object members of a JavaScript / TypeScript subset.

Sources are taken as bytes decoded one to one (latin-1), so indexes are byte offsets. Members of object literals,
parameters and type annotations are found by walking tokens from bracket to bracket.

What can't be read costs as little as possible: a character that starts no token, a quote or a template without its end,
an opening bracket that is closed by another's, and a closing one that nothing opened become tokens of kind ``error``,
which are part of no bracket; an element of JSX is one token; a member that can't be read is left out, up to the next comma.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

LEX = re.compile(
    r"""(?P<blank>[ \t\r\n\f\v]+|\xef\xbb\xbf|\xc2\xa0)
    |(?P<comment>//[^\n\r]*|/\*.*?\*/)
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<number>\.?\d[\w.]*)
    |(?P<name>[#@]?[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)
    |(?P<mark>=>|\.\.\.|\?\?=?|\?\.(?!\d)|&&=?|\|\|=?|===?|!==?|\*\*=?|\+\+|--|<<=?|<=|[-+*/%&|^]=|[{}()\[\];,<>=+\-*/%&|^!~?:.])""",
    re.S | re.X,
)
QUOTED = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"", re.S)
JSX_OPEN = re.compile(r"<([A-Za-z_$][\w$.:-]*)?(?=[\s/>])")
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
ESCAPE = re.compile(r"\\(?:u\{[^}]*\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[0-7]{1,3}|\r\n|.)", re.S)
# Words of the language
OPERATORS = frozenset("return typeof case in of new delete void throw instanceof yield await default else do".split())
CONTROL = frozenset("if for while switch catch with".split())
MODIFIERS = frozenset("async get set static public private protected readonly override accessor declare abstract".split())
TYPE_WORDS = frozenset("keyof typeof readonly infer unique asserts new abstract".split())
LITERALS = frozenset("null true false this super undefined".split())
PAIRS = {"(": ")", "[": "]", "{": "}"}
ENDS = frozenset(PAIRS.values())


class SyntaxProblem(ValueError):
    """A part of the file can't be read."""


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass(slots=True)
class Member:
    """A member of an object literal: pair, method, spread or shorthand; first and last are its tokens."""

    kind: str
    key: int
    first: int
    last: int
    value: tuple[int, int] | None = None
    opening: int = -1
    returns: tuple[int, int] | None = None
    body: int = -1


class Source:
    """A file's tokens without comments, their matching brackets, and the comments with the token that follows each."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.text = raw.decode("latin-1")
        self.lines = [0, *[i + 1 for i, c in enumerate(raw) if c == 10]]
        self.tokens: list[Token] = []
        self.comments: list[tuple[Token, int]] = []
        self._lex()
        self.match: dict[int, int] = {}
        self._pair()
        self.parent: list[int] = []
        open_: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "mark" and t.text in ENDS:
                open_.pop()
            self.parent.append(open_[-1] if open_ else -1)
            if t.kind == "mark" and t.text in PAIRS:
                open_.append(i)
        self._objects: dict[int, bool] = {}

    def _pair(self, by_indent: bool = False) -> None:
        """Match brackets; those without a partner become errors.

        If any lack one, which they are shows in the lines' indentation: a closing bracket that begins a line belongs to
        one that was opened on a line indented alike.
        """
        open_: list[int] = []
        errors: list[int] = []
        match: dict[int, int] = {}
        for i, t in enumerate(self.tokens):
            if t.kind != "mark":
                continue
            if t.text in PAIRS:
                open_.append(i)
            elif t.text in ENDS:
                alike = (k for k in reversed(open_) if PAIRS[self.tokens[k].text] == t.text)
                if by_indent and self.new_line(i):
                    wide = self._indent(t)
                    o = next((k for k in alike if self._indent(self.tokens[k]) <= wide), None)
                    o = o if o is not None and self._indent(self.tokens[o]) == wide else None
                else:
                    o = next(alike, None)
                if o is None:
                    errors.append(i)
                    continue
                while open_[-1] != o:
                    errors.append(open_.pop())
                match[open_.pop()], match[i] = i, o
        errors += open_
        if errors and not by_indent:
            self._pair(True)
            return
        self.match = match
        for i in errors:
            self.tokens[i].kind = "error"

    def _indent(self, t: Token) -> int:
        """How far the line on which the token begins is indented."""
        at = self.lines[bisect_right(self.lines, t.start) - 1]
        return next(i for i, c in enumerate(self.text[at : t.start + 1]) if c not in " \t")

    def _lex(self) -> None:
        s, at, tokens = self.text, 0, self.tokens
        while at < len(s):
            c = s[at]
            if c == "`":
                end = self._template(at)
                tokens.append(Token("template", s[at:end], at, end) if end else Token("error", c, at, at + 1))
                at = end or at + 1
                continue
            if c == "<" and self._value_may_start():
                end = self._jsx(at)
                if end:
                    tokens.append(Token("jsx", s[at:end], at, end))
                    at = end
                    continue
            if c == "/" and s[at + 1 : at + 2] not in ("/", "*") and self._value_may_start():
                m = REGEX.match(s, at)
                if m:
                    tokens.append(Token("regex", m[0], at, m.end()))
                    at = m.end()
                    continue
            m = LEX.match(s, at)
            if m is None:
                tokens.append(Token("error", c, at, at + 1))
                at += 1
                continue
            kind = m.lastgroup
            if kind == "comment":
                self.comments.append((Token(kind, m[0], at, m.end()), len(tokens)))
            elif kind != "blank":
                tokens.append(Token(kind, m[0], at, m.end()))
            at = m.end()

    def _value_may_start(self) -> bool:
        if not self.tokens:
            return True
        t = self.tokens[-1]
        return t.text in OPERATORS if t.kind == "name" else t.kind == "mark" and t.text not in (")", "]", "}", "++", "--")

    def _template(self, at: int) -> int:
        """The end of the template at that byte; 0 if it has none."""
        s, i = self.text, at + 1
        while i < len(s):
            if s[i] == "\\":
                i += 2
            elif s[i] == "`":
                return i + 1
            elif s.startswith("${", i):
                i = self.braces(i + 1)
                if not i:
                    return 0
            else:
                i += 1
        return 0

    def braces(self, at: int) -> int:
        """The end of the expression in braces at that byte; 0 if it has none."""
        s, i, depth = self.text, at + 1, 1
        while i < len(s) and depth:
            if s[i] == "`":
                i = self._template(i)
                if not i:
                    return 0
                continue
            m = QUOTED.match(s, i)
            if m:
                i = m.end()
                continue
            depth += {"{": 1, "}": -1}.get(s[i], 0)
            i += 1
        return 0 if depth else i

    def _jsx(self, at: int) -> int:
        """The end of the element at that byte; 0 if none begins there or it has no end."""
        s, i, open_ = self.text, at, []
        while i < len(s):
            if s[i] == "{":
                i = self.braces(i)
                if not i:
                    return 0
            elif s.startswith("</", i):
                end = s.find(">", i)
                if end < 0 or not open_ or s[i + 2 : end].strip() != open_.pop():
                    return 0
                i = end + 1
            elif s[i] == "<":
                m = JSX_OPEN.match(s, i)
                if m is None:
                    return 0
                i = m.end()
                while i < len(s) and s[i] != ">" and not s.startswith("/>", i):
                    q = QUOTED.match(s, i)
                    i = q.end() if q else self.braces(i) if s[i] == "{" else i + 1
                    if not i or s[i : i + 1] == "<":
                        return 0
                if s.startswith("/>", i):
                    i += 2
                else:
                    open_.append(m[1] or "")
                    i += 1
            else:
                i += 1
                continue
            if not open_:
                return i
        return 0

    def point(self, at: int) -> tuple[int, int]:
        row = bisect_right(self.lines, at) - 1
        return row, at - self.lines[row]

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind in ("mark", "name") and self.tokens[i].text in texts

    def new_line(self, i: int) -> bool:
        """Whether a line ends between token i - 1 and token i."""
        return i <= 0 or i >= len(self.tokens) or "\n" in self.text[self.tokens[i - 1].end : self.tokens[i].start]

    # types

    def angle(self, i: int) -> int:
        """The token after the <...> that starts at i."""
        depth = 0
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.kind == "mark":
                if t.text in PAIRS:
                    i = self.match[i]
                elif t.text == "<":
                    depth += 1
                elif t.text == ">":
                    depth -= 1
                    if not depth:
                        return i + 1
                elif t.text in (")", "]", "}", ";"):
                    break
            i += 1
        raise SyntaxProblem("type arguments don't end")

    def _angle(self, i: int) -> int:
        """The token after the <...> that starts at i; the last one if it doesn't end."""
        try:
            return self.angle(i)
        except SyntaxProblem:
            return len(self.tokens)

    def type_end(self, i: int) -> int:
        """The token after the type that starts at i."""
        operand, asked = True, 0
        while i < len(self.tokens):
            t = self.tokens[i]
            if operand:
                if t.text in ("|", "&", "-", "...") or t.kind == "name" and t.text in TYPE_WORDS and not self.is_(i + 1, ",", ")", "=", ";", "{", "|", "&", ">", "[", "."):
                    i += 1
                elif t.kind == "mark" and t.text == "<":
                    i = self._angle(i)
                elif t.kind == "mark" and t.text in PAIRS:
                    i, operand = self.match[i] + 1, False
                elif t.kind == "mark":
                    return i
                else:
                    i, operand = i + 1, False
            elif t.kind == "mark" and t.text == "[" and not self.new_line(i):
                i = self.match[i] + 1
            elif t.kind == "mark" and t.text == "<":
                if self._angle(i) == len(self.tokens):
                    return i
                i = self._angle(i)
            elif t.kind == "mark" and t.text in (".", "|", "&", "=>"):
                i, operand = i + 1, True
            elif t.kind == "name" and t.text in ("is", "extends"):
                i, operand = i + 1, True
            elif t.kind == "mark" and t.text == "?":
                i, operand, asked = i + 1, True, asked + 1
            elif t.kind == "mark" and t.text == ":" and asked:
                i, operand, asked = i + 1, True, asked - 1
            else:
                return i
        return i

    # values

    def value_end(self, i: int, close: int) -> int:
        """The token after the expression that starts at i: a comma outside of brackets, or close."""
        while i < close:
            t = self.tokens[i]
            if t.kind == "mark":
                if t.text == ",":
                    return i
                if t.text in PAIRS:
                    after = self.match[i]
                    # an arrow function's return type may hold commas
                    if t.text == "(" and self.is_(after + 1, ":") and not self._ternary(after + 1, i):
                        end = self.type_end(after + 2)
                        after = end - 1 if self.is_(end, "=>") or self.is_(end - 1, "=>") else after
                    i = after
                elif t.text == "<" and i and self.tokens[i - 1].kind == "name" or t.text == "<" and not self._before_value(i):
                    try:
                        end = self.angle(i)
                        if self.is_(end, "(") and end < close:
                            i = end - 1
                    except SyntaxProblem:
                        pass
            elif t.kind == "name" and t.text in ("as", "satisfies") and not self.is_(i + 1, ",", ":", "(", "=", "."):
                i = max(i, self.type_end(i + 1) - 1)
            i += 1
        return close

    def _before_value(self, i: int) -> bool:
        return i > 0 and (self.tokens[i - 1].kind != "mark" or self.tokens[i - 1].text in (")", "]"))

    def _ternary(self, colon: int, first: int) -> bool:
        """Whether an open question mark stands before the colon, in the same brackets and expression."""
        asked, i, parent = 0, colon - 1, self.parent[colon]
        while i > parent:
            t = self.tokens[i]
            if t.kind == "mark":
                if t.text in (")", "]", "}"):
                    i = self.match[i]
                elif t.text in (",", ";", "=>"):
                    return False
                elif t.text == ":":
                    asked -= 1
                elif t.text == "?":
                    if self.is_(i + 1, ":", ",", ")"):
                        return False
                    asked += 1
                    if asked > 0:
                        return True
            i -= 1
        return False

    def is_parameters(self, i: int) -> bool:
        """Whether the parenthesis at i opens a parameter list."""
        after = self.match[i] + 1
        if self.is_(after, "=>"):
            return True
        if self.is_(i - 1, *CONTROL) and not self.is_(i - 2, "."):
            return False
        if self.is_(after, "{"):
            return not self.new_line(after) and i > 0 and (self.tokens[i - 1].kind in ("name", "string", "number") or self.is_(i - 1, "]", ">", "*"))
        if self.is_(after, ":") and not self._ternary(after, i):
            end = self.type_end(after + 1)
            return self.is_(end, "=>", "{") or self.is_(end - 1, "=>")
        return False

    def is_object(self, i: int) -> bool:
        """Whether the brace at i opens an object literal, not a block, pattern, class or type."""
        if i not in self._objects:
            self._objects[i] = False
            self._objects[i] = self._is_object(i)
        return self._objects[i]

    def _is_object(self, i: int) -> bool:
        if i == 0:
            return False
        t, parent = self.tokens[i - 1], self.parent[i]
        inside = parent >= 0 and self.tokens[parent].text == "{" and self.is_object(parent)
        if t.kind == "name":
            return t.text in OPERATORS - {"else", "do"} and not (inside and self.is_(i - 2, ".")) and not self.is_(i - 2, ".")
        if t.kind != "mark":
            return False
        if t.text == ":":
            if self.is_(i - 2, ")") and not self._ternary(i - 1, i):
                return False
            if inside:
                return True
            return self._ternary(i - 1, i)
        if t.text in ("(", ","):
            if parent >= 0 and self.tokens[parent].text == "(":
                return not self.is_parameters(parent)
            if parent >= 0 and self.tokens[parent].text == "[":
                return not self._is_pattern(parent)
            return False
        if t.text == "[":
            return not self._is_pattern(i - 1)
        if t.text == "=":
            return not self.is_(i - 3, "type")
        return t.text in ("?", "&&", "||", "??", "!", "...", "+", "===", "==", "!==", "!=", "??=", "||=", "&&=", "*", "-")

    def _is_pattern(self, i: int) -> bool:
        """Whether the bracket at i opens an array pattern of a declaration or parameter."""
        parent = self.parent[i]
        return self.is_(i - 1, "const", "let", "var") or parent >= 0 and self.tokens[parent].text == "(" and self.is_(i - 1, "(", ",") and self.is_parameters(parent)

    def members(self, i: int) -> list[Member]:
        """The members of the object literal whose brace is at i; those that can't be read are left out."""
        out, close, i = [], self.match[i], i + 1
        while i < close:
            if self.is_(i, ",", ";"):
                i += 1
                continue
            try:
                member = self._member(i, close)
                out.append(member)
                i = max(member.last, i) + 1
            except SyntaxProblem:
                i = self._comma(i, close)
        return out

    def _comma(self, i: int, close: int) -> int:
        """The next comma outside of brackets, or close."""
        while i < close and not self.is_(i, ","):
            i = self.match[i] + 1 if self.is_(i, *PAIRS) else i + 1
        return i

    def _member(self, first: int, close: int) -> Member:
        i = first
        if self.is_(i, "..."):
            return Member("spread", first, first, self.value_end(i + 1, close) - 1)
        while self.tokens[i].kind == "name" and self.tokens[i].text in MODIFIERS and not self.is_(i + 1, "(", ",", ":", "}", "=", "<", "?"):
            i += 1
        if self.is_(i, "*"):
            i += 1
        key = i
        if self.tokens[key].kind == "error" or i >= close:
            raise SyntaxProblem("a member has no name")
        i = self.match[i] + 1 if self.is_(i, "[") else i + 1
        if self.is_(i, "?"):
            i += 1
        if self.is_(i, "(", "<"):
            opening = self.angle(i) if self.is_(i, "<") else i
            if not self.is_(opening, "("):
                raise SyntaxProblem("a method has no parameters")
            body, returns = self.match[opening] + 1, None
            if self.is_(body, ":"):
                end = self.type_end(body + 1)
                returns, body = (body + 1, end), end
            if not self.is_(body, "{"):
                raise SyntaxProblem("a method has no body")
            return Member("method", key, first, self.match[body], None, opening, returns, body)
        if self.is_(i, ":"):
            end = self.value_end(i + 1, close)
            return Member("pair", key, first, end - 1, (i + 1, end))
        return Member("shorthand", key, first, max(key, self.value_end(i, close) - 1))

    def key_end(self, key: int) -> int:
        return self.match[key] if self.is_(key, "[") else key

    def elements(self, i: int) -> list[tuple[int, int]]:
        """Token ranges of what the bracket at i holds between commas."""
        out, close, i = [], self.match[i], i + 1
        while i < close:
            end = self.value_end(i, close)
            if end > i:
                out.append((i, end))
            i = end + 1
        return out

    def group(self, span: tuple[int, int]) -> str:
        """The kind of an expression: array, object, identifier, string or other."""
        a, b = span
        if b - a == 1:
            t = self.tokens[a]
            if t.kind == "name" and t.text not in LITERALS:
                return "identifier"
            return "string" if t.kind == "string" else "other"
        if b > a and self.tokens[a].kind == "mark" and self.match.get(a) == b - 1:
            return {"[": "array", "{": "object"}.get(self.tokens[a].text, "other")
        return "other"
