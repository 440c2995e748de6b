"""Facts out of Swift source text, by a tokenizer and a scope stack (there is no grammar library).

``extract_files`` maps (file_id, content) to rows of PARSED with ``mapInArrow``: files are independent, so the work
spreads over the cluster; everything after it is joins.

What is taken from a file:
  defines           named types; inside another type as Outer.Inner with the nearest one only; extensions define nothing
  references        names in type position (annotations, inheritance, generics, casts, return types), sorted, once
  view_embeddings   inside ``body`` properties: upper-case names in type position and upper-case callees, repeated
  imports           module names
  a11y_setters      x.accessibilityIdentifier(arg) and x.accessibilityIdentifier = value
  a11y_queries      x.buttons[...] style accessors called with an argument; outside of UI tests also calls of plain
                    functions whose first argument is a dotted path with an accessor suffix
  test_methods      in UI test files: functions named test..., with their own queries and upper-case callees
  constants         cases of String enums under their full dotted path
  typealiases       alias -> dotted target
An identifier is a literal (one line, not empty, no interpolation) or a dotted path without its accessor suffix.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from rippletrace.plans import schema as S

TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*)|(?P<block>/\*)|(?P<text>\#*\"\"\"|\#*\")|(?P<name>`[^`\n]+`|[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<arrow>->)|(?P<mark>.)""",
    re.S | re.X,
)
TYPES = ("class", "struct", "enum", "protocol", "actor", "extension")
NOT_CALLED = frozenset("if guard while for switch return catch where in is as let var func init case throw try await else".split())


class Token:
    __slots__ = ("kind", "text", "value")

    def __init__(self, kind: str, text: str, value: str | None = None):
        self.kind, self.text, self.value = kind, text, value


def _string(source: str, at: int, quote: str) -> tuple[int, str | None, list[str]]:
    """The place after a string that begins with ``quote`` at ``at``; its text (None: several lines, empty or interpolated) and the interpolated code."""
    hashes = quote.count("#")
    end = quote[hashes:] + "#" * hashes
    escape = "\\" + "#" * hashes
    i, inner, plain = at + len(quote), [], '"""' not in quote
    begin = i
    while i < len(source):
        if source.startswith(escape, i):
            if source.startswith("(", i + len(escape)):
                depth, j = 1, i + len(escape) + 1
                first = j
                while j < len(source) and depth:
                    c = source[j]
                    if c == '"':
                        j = _string(source, j, '"""' if source.startswith('"""', j) else '"')[0]
                        continue
                    depth += (c == "(") - (c == ")")
                    j += 1
                inner.append(source[first : j - 1])
                plain, i = False, j
                continue
            i += len(escape) + 1
        elif source.startswith(end, i):
            text = source[begin:i]
            return i + len(end), text if plain and text and "\n" not in text else None, inner
        elif '"""' not in quote and source[i] == "\n":
            return i, None, inner
        else:
            i += 1
    return len(source), None, inner


def tokens(source: str) -> list[Token]:
    """Names, strings (with their literal value), numbers and marks; comments (also nested) are gone, interpolated code follows its string in parentheses."""
    out, at = [], 0
    while at < len(source):
        m = TOKEN.match(source, at)
        kind = m.lastgroup
        if kind == "block":
            depth, at = 1, m.end()
            while at < len(source) and depth:
                two = source[at : at + 2]
                depth += (two == "/*") - (two == "*/")
                at += 2 if two in ("/*", "*/") else 1
            continue
        if kind == "text":
            at, value, inner = _string(source, at, m.group())
            out.append(Token("string", "", value))
            for code in inner:
                out += [Token("mark", "("), *tokens(code), Token("mark", ")")]
            continue
        at = m.end()
        if kind == "space":
            if "\n" in m.group():
                out.append(Token("line", "\n"))
        elif kind != "comment":
            out.append(Token(kind, m.group().strip("`") if kind == "name" else m.group()))
    return out


def _builtin(name: str) -> bool:
    return len(name.encode()) <= 1 or name in S.BUILTIN_NAMES


def _strip(path: str) -> str:
    return next((path[: -len(x)] for x in S.ACCESSOR_SUFFIXES if path.endswith(x)), path)


class Parser:
    """One pass over the tokens of a file. ``scopes`` holds, for each open brace, the type path, the nearest type's
    name, whether it is a String enum, whether it is inside ``body``, and the test method that it belongs to."""

    def __init__(self, source: str | list[Token], role: str):
        self.all = tokens(source) if isinstance(source, str) else source
        self.t = [x for x in self.all if x.kind != "line"]
        self.texts, self.kinds = [x.text for x in self.t] + [""], [x.kind for x in self.t] + [""]
        self.new_line = set()  # tokens that begin a line
        n = 0
        for x in self.all:
            if x.kind == "line":
                self.new_line.add(n)
            else:
                n += 1
        self.role = role
        self.defines, self.references, self.embedded, self.imports = [], [], [], []
        self.setters, self.queries, self.methods = [], [], []
        self.constants, self.aliases = {}, {}

    def text(self, k: int) -> str:
        return self.texts[k] if -1 <= k < len(self.texts) else ""

    def kind(self, k: int) -> str:
        return self.kinds[k] if -1 <= k < len(self.kinds) else ""

    def close(self, k: int) -> int:
        """The place of the bracket that closes the one at k."""
        pairs, depth = {"(": ")", "[": "]", "{": "}", "<": ">"}, 0
        a = self.text(k)
        b = pairs[a]
        while k < len(self.t):
            if self.kind(k) == "mark":
                depth += (self.text(k) == a) - (self.text(k) == b)
                if not depth:
                    return k
            k += 1
        return len(self.t) - 1

    def dotted(self, k: int) -> tuple[list[str], int]:
        """A dotted name at k and the place after it."""
        parts = []
        while self.kind(k) == "name":
            parts.append(self.text(k))
            k += 1
            if self.text(k) == "." and self.kind(k + 1) == "name":
                k += 1
            else:
                break
        return parts, k

    def identifier(self, k: int, end: int) -> tuple[str, str] | None:
        """(id_kind, key) of the expression from k up to end."""
        if self.kind(k) == "string" and k + 1 == end:
            return ("Literal", self.t[k].value) if self.t[k].value else None
        parts, after = self.dotted(k)
        if self.text(k) == "." and self.kind(k + 1) == "name":  # an implicit member
            parts, after = self.dotted(k + 1)
            if after == end:
                path = _strip(".".join(parts))
                return ("Symbolic", path) if path and not _builtin(path) else None
        if not parts or after != end:
            return None
        path = _strip(".".join(parts)) if len(parts) > 1 else parts[0]
        return ("Symbolic", path) if path and not _builtin(path) else None

    def first_argument(self, k: int) -> tuple[int, int] | None:
        """First and last (exclusive) token of the first argument of the call or subscript at k, without its label."""
        close = self.close(k)
        if close == k + 1:
            return None
        begin = k + 1
        if self.kind(begin) == "name" and self.text(begin + 1) == ":":
            begin += 2
        end, depth = begin, 0
        while end < close:
            x = self.text(end) if self.kind(end) == "mark" else ""
            if x == "," and not depth:
                break
            depth += (x in "([{" and x != "") - (x in ")]}" and x != "")
            end += 1
        return begin, end

    def type_names(self, k: int, body: bool) -> int:
        """Takes the names of a type that begins at k; the place after it."""
        while k < len(self.t):
            x, kind = self.text(k), self.kind(k)
            if kind == "name" and x in ("some", "any", "inout", "throws", "rethrows", "async", "escaping", "autoclosure"):
                k += 1
            elif kind == "name":
                self.type_name(x, body)
                k += 1
            elif x in ("(", "["):
                end = self.close(k)
                inner = k + 1
                while inner < end:
                    if self.kind(inner) == "name" and self.text(inner + 1) == ":" and x == "(":
                        inner += 2
                        continue
                    inner = max(inner + 1, self.type_names(inner, body))
                k = end + 1
            elif x == "<":
                end = self.close(k)
                inner = k + 1
                while inner < end:
                    inner = max(inner + 1, self.type_names(inner, body))
                k = end + 1
            elif x in ("?", "!", "@"):
                k += 1
                continue
            else:
                return k
            if self.text(k) in ("?", "!"):
                k += 1
            if self.text(k) in (".", "&", "->") or (self.kind(k) == "arrow"):
                k += 1
                continue
            if self.text(k) == "<" or self.text(k - 1) in ("some", "any", "inout"):
                continue
            return k
        return k

    def type_name(self, name: str, body: bool) -> None:
        if not _builtin(name):
            self.references.append(name)
            if body and name[0].isupper():
                self.embedded.append(name)

    def run(self) -> Parser:
        scopes = [{"path": None, "name": None, "strings": False, "body": False, "method": None, "type": True}]
        opening: dict[int, dict] = {}  # braces of declarations: what their scope is
        k = 0
        while k < len(self.t):
            x, kind, now = self.text(k), self.kind(k), scopes[-1]
            before = self.text(k - 1)
            if k in opening or x == "{":
                scopes.append(now | {"type": False} | opening.pop(k, {}))
                k += 1
            elif x == "}" and kind == "mark":
                if len(scopes) > 1:
                    scopes.pop()
                k += 1
            elif kind != "name":
                k = self.operator(k, now)
            elif x == "import" and self.kind(k + 1) == "name" and before != ".":
                parts, k = self.dotted(k + (2 if self.text(k + 1) in (*TYPES, "func", "var", "let", "typealias") and self.kind(k + 2) == "name" else 1))
                self.imports.append(".".join(parts))
            elif x in TYPES and before != "." and self.kind(k + 1) == "name" and self.text(k + 1) not in ("func", "var", "let", "subscript", "init"):
                k = self.declaration(k, now, opening)
            elif x == "typealias" and self.kind(k + 1) == "name":
                k = self.alias(k, now)
            elif x == "func":
                k = self.function(k, now, opening)
            elif x in ("var", "let") and before != ".":
                k = self.variable(k, now, opening)
            elif x == "case" and now["type"] and now["strings"] and now["path"]:
                k = self.cases(k, now)
            else:
                k = self.expression(k, now)
        return self

    def operator(self, k: int, now: dict) -> int:
        """Type positions that a mark introduces: return types, and annotations of parameters."""
        if self.kind(k) == "arrow":
            return self.type_names(k + 1, now["body"])
        if self.text(k) == "=" and self.text(k - 1) == "accessibilityIdentifier" and self.text(k - 2) == "." and self.text(k + 1) != "=":
            end = k + 1
            while end < len(self.t) and end not in self.new_line and self.text(end) not in (";", "}"):
                end += 1
            found = self.identifier(k + 1, end)
            if found:
                self.setters.append(found)
        return k + 1

    def declaration(self, k: int, now: dict, opening: dict[int, dict]) -> int:
        extension = self.text(k) == "extension"
        parts, after = self.dotted(k + 1)
        if extension:
            for p in parts:
                self.type_name(p, now["body"])
        else:
            name = parts[0]
            self.defines.append(f"{now['name']}.{name}" if now["name"] else name)
            self.type_name(name, now["body"])
        path = ".".join([*([now["path"]] if now["path"] else []), *parts])
        if self.text(after) == "<":
            end = self.close(after)
            inner = after + 1
            while inner < end:
                inner = max(inner + 1, self.type_names(inner, now["body"]))
            after = end + 1
        strings = False
        while after < len(self.t) and self.text(after) != "{":
            if self.kind(after) == "name" and self.text(after) != "where":
                strings |= self.text(after) == "String"
                after = self.type_names(after, now["body"])
            else:
                after += 1
        # An extension of a type has no name of its own for nested definitions.
        opening[after] = {"path": path, "name": now["name"] if extension else parts[0], "strings": strings, "type": True}
        return after

    def alias(self, k: int, now: dict) -> int:
        name, after = self.text(k + 1), k + 2
        if self.text(after) == "<":
            after = self.close(after) + 1
        if self.text(after) != "=":
            return after
        self.type_name(name, now["body"])
        parts, _ = self.dotted(after + 1)
        if parts:
            self.aliases[name] = ".".join(parts)
        return self.type_names(after + 1, now["body"])

    def function(self, k: int, now: dict, opening: dict[int, dict]) -> int:
        name, after = self.text(k + 1), k + 2
        while after < len(self.t) and self.text(after) not in ("(", "<", "{"):
            after += 1
        if self.text(after) == "<":
            end, inner = self.close(after), after + 1
            while inner < end:
                inner = max(inner + 1, self.type_names(inner, now["body"]))
            after = end + 1
        if self.text(after) == "(":
            end = self.close(after)
            self.parameters(after + 1, end, now)
            after = end + 1
        while self.text(after) in ("async", "throws", "rethrows"):
            after += 1
        if self.kind(after) == "arrow":
            after = self.type_names(after + 1, now["body"])
        if self.text(after) == "where":
            while after < len(self.t) and self.text(after) != "{" and after not in self.new_line:
                after += 1
        if self.text(after) == "{":
            method = None
            if self.role == "UITest" and name.startswith("test") and now["method"] is None:
                method = {"name": name, "queries": [], "types": set()}
                self.methods.append(method)
            opening[after] = {"method": method or now["method"]}
        return after

    def parameters(self, k: int, end: int, now: dict) -> None:
        while k < end:
            if self.text(k) == ":" and self.kind(k) == "mark":
                k = max(k + 1, self.type_names(k + 1, now["body"]))
            elif self.text(k) == "=":
                k += 1
                while k < end and self.text(k) != ",":
                    k = max(k + 1, self.expression(k, now))
            else:
                k += 1

    def variable(self, k: int, now: dict, opening: dict[int, dict]) -> int:
        body = self.text(k + 1) == "body"
        after = k + 2
        if self.text(after) == ":":
            after = self.type_names(after + 1, now["body"] or body)
        if body and self.text(after) == "{":
            opening[after] = {"body": True}
        return after

    def cases(self, k: int, now: dict) -> int:
        k += 1
        while self.kind(k) == "name":
            name, raw = self.text(k), self.text(k)
            k += 1
            if self.text(k) == "(":
                k = self.close(k) + 1
            if self.text(k) == "=" and self.kind(k + 1) == "string":
                raw = self.t[k + 1].value or name
                k += 2
            self.constants[f"{now['path']}.{name}"] = raw
            if self.text(k) != ",":
                break
            k += 1
        return k

    def expression(self, k: int, now: dict) -> int:
        """A name in an expression: calls, accessors, casts."""
        x, before, after = self.text(k), self.text(k - 1), self.text(k + 1)
        if x in ("as", "is"):
            k += 1
            if self.text(k) in ("?", "!"):
                k += 1
            return self.type_names(k, now["body"])
        called = after == "(" and k + 1 not in self.new_line
        if before == ".":
            if (called or (after == "[" and k + 1 not in self.new_line)) and x in ("accessibilityIdentifier", *S.QUERY_ACCESSORS):
                part = self.first_argument(k + 1)
                found = self.identifier(*part) if part else None
                if found and x == "accessibilityIdentifier" and called:
                    if now["method"] is None:
                        self.setters.append(found)
                elif found and x != "accessibilityIdentifier":
                    (self.queries if now["method"] is None else now["method"]["queries"]).append(found)
            return k + 1
        if called or (after == "{" and x[:1].isupper() and now["body"]):
            if x[:1].isupper():
                if now["method"] is not None:
                    now["method"]["types"].add(x)
                if now["body"] and not _builtin(x):
                    self.embedded.append(x)
            if called and self.role != "UITest" and x not in NOT_CALLED:
                part = self.first_argument(k + 1)
                if part:
                    parts, end = self.dotted(part[0])
                    path = ".".join(parts)
                    short = _strip(path)
                    if end == part[1] and len(parts) > 1 and short != path and short and not _builtin(short):
                        self.queries.append(("Symbolic", short))
        return k + 1


def role_of(file_id: str, imports: list[str]) -> str:
    """The role of a file (the columns of functions.paths, for one value)."""
    if any(i in S.SNAPSHOT_IMPORTS for i in imports):
        return "SnapshotTest"
    p = file_id.lower()
    name = p.rsplit("/", 1)[-1]
    name = name.rsplit(".", 1)[0] if "." in name[1:] else name
    if any(x in p for x in ("uitest", "ui_test", "e2etest")):
        return "UITest"
    if not any(x in p for x in ("tests/", "/test/")) and not name.endswith(("test", "tests")):
        return "Source"
    return "SnapshotTest" if "snapshot" in p else "UnitTest"


def parse(file_id: str, source: str) -> dict:
    """A row of PARSED."""
    read, guess = tokens(source), role_of(file_id, [])
    p = Parser(read, guess).run()
    imports = p.imports
    role = role_of(file_id, imports)
    if (role == "UITest") != (guess == "UITest"):  # what else a role is makes no difference to the parser
        p = Parser(read, role).run()
    ident = lambda xs: [{"id_kind": a, "key": b} for a, b in xs]
    return {
        "file_id": file_id,
        "defines": sorted(set(p.defines)),
        "references": sorted(set(p.references)),
        "view_embeddings": p.embedded,
        "imports": imports,
        "role": role,
        "a11y_setters": ident(p.setters),
        "a11y_queries": ident(p.queries),
        "test_methods": [{"name": m["name"], "a11y_queries": ident(m["queries"]), "referenced_types": sorted(m["types"])} for m in p.methods],
        "constants": p.constants,
        "typealiases": p.aliases,
    }


def extract_files(files: DataFrame) -> DataFrame:
    """PARSED rows of files (file_id, content); null content is an empty file. A file that can't be parsed is logged and left out."""

    shape = to_arrow_schema(S.PARSED)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for i, c in zip(part.column("file_id").to_pylist(), part.column("content").to_pylist()):
                try:
                    row = parse(i, c or "")
                    rows.append(row | {m: list(row[m].items()) for m in ("constants", "typealiases")})
                except Exception as e:  # whatever it is, the other files count
                    logging.getLogger("rippletrace").warning("%s is left out: %r", i, e)
            yield from pa.Table.from_pylist(rows, shape).to_batches()

    return files.select("file_id", "content").mapInArrow(run, S.PARSED)
