"""Rules of ignore files: which entries of a source tree are left out."""

from __future__ import annotations

import re

#: Names of ignore files, the last one has the last word in its folder.
NAMES = (".gitignore", ".ignore")


class Rule:
    """One line of an ignore file in a folder: which paths below it the line names."""

    def __init__(self, folder: str, line: str):
        self.folder, self.line = folder, line
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        self.negated = line.startswith("!")
        line = line.removeprefix("!")
        self.folders_only = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        self.lead = f"{folder}/" if folder else ""
        self.pattern = re.compile(("" if anchored else "(?:.*/)?") + _regex(line.removeprefix("/")) + r"\Z", re.S)

    def __reduce__(self):
        return Rule, (self.folder, self.line)

    def names(self, path: str, is_dir: bool) -> bool:
        if self.folders_only and not is_dir or not path.startswith(self.lead):
            return False
        return self.pattern.match(path, len(self.lead)) is not None


def _regex(glob: str) -> str:
    """A glob in which one star and the question mark stay within a folder, and two stars between slashes are any folders."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i:] == "**" and i and glob[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inside = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^/" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        else:
            i += c == "\\" and i + 1 < len(glob)
            out, i = out + re.escape(glob[i]), i + 1
    return out


def rules_of(folder: str, text: str) -> tuple[Rule, ...]:
    """The rules of an ignore file's text."""
    return tuple(Rule(folder, x) for x in text.splitlines() if x.strip("/! \t") and not x.startswith("#"))


def ignored(rules: tuple[Rule, ...], path: str, is_dir: bool) -> bool:
    """Whether the last rule that names the path isn't a negation."""
    return next((not r.negated for r in reversed(rules) if r.names(path, is_dir)), False)
