"""Names of JavaScript and TypeScript files with the scopes that they stand in.

A file is masked as a Column expression (``functions/syntax.py``); a task walks the tokens of the mask once, and
gives a row for each name: where it is, whether it declares, reads or writes, and the scopes around it from the
inside out.  What a name means is not decided here but by joins (``operators/scopes.py``).

Brackets are matched first.  Functions, classes, loops with declarations and blocks are spans of tokens; ``var`` belongs to
the nearest function, all else to the nearest span; a function's parameters belong to its body.  Names in types
count as reads.  Not followed: markup in files with elements, assignment to patterns, and labels.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import syntax
from quarry.functions import text as T

#: kind: definition, import, read or write; how: the word that declares, else empty; chain: scopes from the inside out.
NAMES = "file_path string, at int, name string, line int, column int, kind string, how string, exported boolean, chain array<int>"

#: Names after which a task hands on what it has.
BATCH = 20_000

_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|=>|\.\.\.|\?\.|[=!]==?|<=|(?:\*\*|&&|\|\||\?\?|[-+*/%&|^])=|\+\+|--|&&|\|\||\?\?|[^\s\w]")
_NAME = re.compile(r"[A-Za-z_$]")
_WRITES = {"=", "**=", "&&=", "||=", "??=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="}
# Reserved words, types that are words, and words that are names elsewhere.
_RESERVED = set(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof "
    "let new null return super switch this throw true try typeof var void while with yield await undefined "
    "any unknown never string number boolean object symbol bigint interface implements".split()
)
_SOFT = set("as async from get set static of type keyof infer is readonly declare abstract satisfies public private protected override namespace module".split())
_MODIFIERS = {"get", "set", "static", "async", "public", "private", "protected", "override", "readonly", "abstract", "declare", "*", "#"}
_BEFORE_VALUES = set("( , [ = : ? return && || ?? ... in of default throw yield typeof await".split())
_CLOSE = {"(": ")", "[": "]", "{": "}"}


class _Walk:
    """One file: its tokens, the spans of its scopes, and what its names do."""

    def __init__(self, mask: str):
        starts = [0, *(m.end() for m in re.finditer("\n", mask))]
        found = list(_TOKEN.finditer(mask))
        self.t = [m.group() for m in found]
        self.line = [bisect_right(starts, m.start()) for m in found]
        self.column = [m.start() - starts[n - 1] + 1 for m, n in zip(found, self.line, strict=True)]
        self.n = len(self.t)
        self.pair: dict[int, int] = {}
        self.around = [-1] * self.n  # the bracket that a token stands in
        stack: list[int] = []
        for i, x in enumerate(self.t):
            if x in (")", "]", "}") and stack:
                self.pair[i], self.pair[stack[-1]] = stack[-1], i
                stack.pop()
            self.around[i] = stack[-1] if stack else -1
            if x in _CLOSE:
                stack.append(i)
        self.pair.update({i: self.n for i in stack})
        self.body: dict[int, str] = {}  # braces: function, class, clause, object, block
        self.spans: list[tuple[int, int, str]] = [(-1, self.n, "function")]
        self.declared: dict[int, tuple[str, int]] = {}  # token: (how, token whose scope it belongs to)
        self.dead: set[int] = set()
        self.exported: set[str] = set()
        self.public: set[int] = set()  # declared names of an exported statement
        self.colons: set[int] = set()  # of cases

    def at(self, i: int) -> str:
        return self.t[i] if 0 <= i < self.n else ""

    def is_name(self, i: int) -> bool:
        return bool(_NAME.match(self.at(i))) and self.t[i] not in _RESERVED

    def after(self, i: int) -> int:
        """The token after one, past the brackets that it opens."""
        return min(self.pair[i] + 1, self.n) if self.at(i) in _CLOSE else i + 1

    def fresh(self, i: int) -> bool:
        """Whether a statement may begin here."""
        p = self.at(i - 1)
        return p in ("", ";", "{", "}", ")", "export", "default", "async", "declare", "abstract") or (self.line[i] > self.line[i - 1] and (bool(re.match(r"[\w$\]]", p))))

    def angled(self, i: int) -> tuple[list[int], int]:
        """Type parameters that begin at a token, and the token after them."""
        names, deep, j = [], 0, i
        while self.at(j) and self.at(i) == "<":
            deep += (self.t[j] == "<") - (self.t[j] == ">")
            if deep == 1 and self.t[j] in "<," and self.is_name(j + 1):
                names.append(j + 1)
            j += 1
            if not deep:
                return names, j
        return [], i

    def past_type(self, i: int) -> int:
        """The token after a type that a colon begins."""
        deep, j = 0, i + 1
        while j < self.n and not (deep <= 0 and j > i + 1 and self.t[j] in ("{", "=", ",", ";", ")", "=>")):
            deep += (self.t[j] == "<") - (self.t[j] == ">")
            j = self.after(j)
        return j

    def targets(self, lo: int, hi: int, keys: bool = False) -> Iterator[int]:
        """Names that the pattern in lo..hi binds; with keys it is that of an object."""
        todo = [(lo, hi, keys)]
        while todo:
            i, hi, keys = todo.pop()
            while i < hi:
                if self.t[i] in ("...", ",") or (self.t[i] in _MODIFIERS and self.is_name(i + 1)):
                    i += 1
                    continue
                if keys and self.at(self.after(i)) == ":":
                    self.dead.add(i)
                    i = self.after(i) + 1
                if self.at(i) in ("{", "["):
                    self.body[i] = "clause"
                    todo.append((i + 1, min(self.pair[i], hi), self.t[i] == "{"))
                elif self.is_name(i):
                    yield i
                deep = 0
                while i < hi and not (self.t[i] == "," and deep <= 0):
                    deep += (self.t[i] == "<") - (self.t[i] == ">")
                    i = self.after(i)

    def declare(self, names, how: str, where: int, word: int | None = None) -> None:
        """Names that belong to the scope of a token; ``word`` is what declares them, and may be exported."""
        names = list(names)
        self.declared.update({i: (how, where) for i in names})
        while word is not None and self.at(word - 1) in ("default", "async", "abstract", "declare"):
            word -= 1
        if word is not None and self.at(word - 1) == "export":
            self.public.update(names)

    def function(self, i: int, opening: int, types=()) -> None:
        """A function whose parameters open at a token; without a body it is a signature."""
        close = self.pair[opening]
        j = self.past_type(close + 1) if self.at(close + 1) == ":" else close + 1
        end = close
        if self.at(j) == "{":
            self.body[j], end = "function", self.pair[j]
        self.spans.append((opening, end, "function"))
        self.declare([*types, *self.targets(opening + 1, close)], "param", opening)

    def arrow(self, i: int) -> None:
        j = i - 1
        while self.at(j) not in ("", ")", "(", "{", "}", ";", ",", "=") and self.line[j] == self.line[i]:
            j -= 1
        opening = self.pair.get(j) if self.at(j) == ")" and (j == i - 1 or self.at(j + 1) == ":") else None
        names = [i - 1] if opening is None else list(self.targets(opening + 1, j))
        begin, end = i - 1 if opening is None else opening, i + 1
        if self.at(end) == "{":
            self.body[end], end = "function", self.pair[end]
        else:
            while self.at(end) and self.t[end] not in (",", ";", ")", "]", "}") and not (self.line[end] > self.line[i] and self.fresh(end)):
                end = self.after(end)
            end -= 1
        self.spans.append((begin, end, "function"))
        self.declare([k for k in names if self.is_name(k)], "param", begin)

    def variables(self, i: int) -> None:
        j = i + 1
        while self.is_name(j) or self.at(j) in ("{", "["):
            stop = self.after(j)
            if self.at(stop) == "!":
                stop += 1
            if self.at(stop) not in ("=", ",", ";", ":", "of", "in", "") and self.line[min(stop, self.n - 1)] == self.line[stop - 1] and self.at(stop) not in (")", "}"):
                return
            self.declare(self.targets(j, self.after(j)), self.t[i], j, i)
            if self.at(stop) == ":":
                stop = self.past_type(stop)
            while self.at(stop) not in ("", ",", ";", ")", "}", "]", "of", "in") and not (self.line[stop] > self.line[stop - 1] and self.fresh(stop)):
                stop = self.after(stop)
            if self.at(stop) != ",":
                return
            j = stop + 1

    def clause(self, i: int) -> None:
        """import and export clauses."""
        j, word = i + 1, self.t[i]
        if word == "import" and (self.at(j) in ("(", ".") or self.line[min(j, self.n - 1)] > self.line[i]):
            return
        if word == "export" and self.at(j) not in ("{", "*"):
            return
        names = []
        while j < self.n and self.t[j] != ";" and not (self.line[j] > self.line[j - 1] and self.around[j] == self.around[i] and self.t[j - 1] not in (",", "{")):
            if self.t[j] == "{":
                self.body[j] = "clause"
            if self.t[j] == "from" and self.around[j] == self.around[i]:
                break
            plain = self.is_name(j) and not (self.t[j] in ("as", "type") and self.is_name(j + 1))
            names += [j] if plain else []
            j += 1
        outer = self.at(j) == "from"
        for k in names:
            if word == "import" and self.at(k + 1) != "as":
                self.declare([k], "import", i)
            elif word == "import" or outer or self.at(k - 1) == "as":
                self.dead.add(k)
            else:
                self.exported.add(self.t[k])
        self.dead.update(k for k in range(i, min(j + 1, self.n)) if self.t[k] in ("as", "from", "type") and k not in self.declared)

    def braces(self) -> None:
        for i, x in enumerate(self.t):
            if x == "{" and i not in self.body:
                self.body[i] = "object" if self.at(i - 1) in _BEFORE_VALUES and i - 1 not in self.colons else "block"

    def walk(self) -> None:
        for i, x in enumerate(self.t):
            if self.at(i - 1) in (".", "?."):
                continue
            nxt = self.at(i + 1)
            if x == "function":
                j = i + 1 + (nxt == "*")
                named = self.is_name(j)
                types, opening = self.angled(j + named)
                if self.at(opening) == "(":
                    self.function(i, opening, types)
                    self.declare([j] if named else [], "function", i if self.fresh(i) else opening, i)
            elif x in ("class", "interface", "enum", "namespace") and (self.is_name(i + 1) or nxt == "{"):
                j = i + 1
                types, k = self.angled(j + (nxt != "{"))
                start = k
                while self.at(k) not in ("", "{", ";"):
                    k = self.after(k)
                if self.at(k) == "{":
                    self.body[k] = "own" if x == "namespace" else "class"
                    self.spans.append((start, self.pair[k], "block"))
                    self.declare(types, "type", k)
                    self.declare([j] if nxt != "{" else [], x, i if x != "class" or self.fresh(i) else k, i)
            elif x == "type" and self.is_name(i + 1) and self.at(i + 2) in ("=", "<"):
                types, k = self.angled(i + 2)
                end = k
                while self.at(end) not in ("", ";", "}") and not (end > k + 1 and self.line[end] > self.line[end - 1] and self.fresh(end)):
                    end = self.after(end)
                self.spans.append((i + 2, end - 1, "block"))
                self.dead.add(i)
                self.declare([i + 1], "type", i, i)
                self.declare(types, "type", i + 2)
            elif x in ("let", "const", "var"):
                self.variables(i)
            elif x in ("import", "export"):
                self.clause(i)
            elif x == "=>" and i:
                self.arrow(i)
            elif x in ("case", "default"):
                end = i + 1
                while self.at(end) not in ("", ":", ";", "}") and self.t[end] != "{":
                    end = self.after(end)
                self.colons.add(end)
            elif x in ("for", "catch") and nxt == "(":
                close = self.pair[i + 1]
                if self.at(close + 1) == "{":
                    self.spans.append((i + 1, self.pair[close + 1], "block"))
                    self.body[close + 1] = "own"
                elif x == "for":
                    end = close + 1
                    while self.at(end) not in ("", ";", "}"):
                        end = self.after(end)
                    self.spans.append((i + 1, end, "block"))
                if x == "catch":
                    self.declare(self.targets(i + 2, close), "catch", i + 1)
        self.braces()
        for i in range(self.n):  # members of classes and objects, which need to know what their braces are
            inside = self.body.get(self.around[i])
            before = self.at(i - 1)
            if inside not in ("class", "object") or not (self.is_name(i) or self.at(i) in _RESERVED):
                continue
            first = before in ("{", ",", ";", "}") or before in _MODIFIERS or (inside == "class" and self.line[i] > self.line[i - 1])
            if not first or (self.t[i] in _MODIFIERS and self.is_name(i + 1)):
                continue
            types, opening = self.angled(i + 1)
            if self.at(opening) == "(":
                self.dead.add(i)
                self.function(i, opening, types)
            elif inside == "class" or before not in ("{", ","):
                self.dead.add(i)

        self.spans += [(i, self.pair[i], "block") for i, kind in self.body.items() if kind == "block"]

    def rows(self, path: str) -> Iterator[tuple]:
        self.walk()
        spans = sorted(set(self.spans), key=lambda s: (s[0], -s[1]))
        chains, opened, k = [()] * self.n, [], 0
        for i in range(-1, self.n):
            while k < len(spans) and spans[k][0] <= i:
                opened.append(k)
                k += 1
            opened = [s for s in opened if spans[s][1] >= i]
            if i >= 0:
                chains[i] = tuple(reversed(opened))
        for i, x in enumerate(self.t):
            if not self.is_name(i) or i in self.dead or self.at(i - 1) in (".", "?.", "#"):
                continue
            nxt = self.at(i + 1)
            if i in self.declared:
                how, where = self.declared[i]
                chain = chains[where] if where < self.n else (0,)
                if how == "var":
                    chain = tuple(s for s in chain if spans[s][2] == "function")[:1] or (0,)
                out = i in self.public or (chain == (0,) and x in self.exported)
                yield path, i, x, self.line[i], self.column[i], "import" if how == "import" else "definition", how, out, list(chain)
                continue
            is_key = (nxt == ":" or (nxt == "?" and self.at(i + 2) == ":")) and self.at(i - 1) in ("(", ",", "{", "}", ";")
            if is_key or (x in _SOFT and (self.is_name(i + 1) or nxt in ("function", "{", "*", "class", "interface"))):
                continue
            write = nxt in _WRITES or nxt in ("++", "--") or self.at(i - 1) in ("++", "--") or (nxt in ("of", "in") and self.at(i - 1) == "(" and self.at(i - 2) == "for")
            yield path, i, x, self.line[i], self.column[i], "write" if write else "read", "", False, list(chains[i])


def _walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in NAMES.split(", ")]
    for frame in frames:
        rows: list[tuple] = []
        for path, mask in zip(frame["file_path"], frame["mask"], strict=True):
            rows.extend(_Walk(mask).rows(path))
            if len(rows) >= BATCH:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def names(files: DataFrame) -> DataFrame:
    """NAMES of the script files among (relative_path, content); other files, and null texts, have none."""
    extension = T.extension(F.col("relative_path"))
    scripts = files.where(extension.isin(*syntax.FAMILIES["script"]))
    return scripts.select(F.col("relative_path").alias("file_path"), syntax.mask(F.col("content"), extension).alias("mask")).mapInPandas(_walked, NAMES)
