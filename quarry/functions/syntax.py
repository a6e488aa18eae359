"""What is code in a source text, and the symbols and calls of languages with braces, as Column expressions.

Strings and comments of a language are one pattern, whose leftmost matches are told apart as a lexer would:
a quote in a comment opens no string, and a comment mark in a string no comment, over any number of lines.  In a
mask they are blank, and every other character stays at its line and column.

Symbols come from one pass over the tokens of a mask: definitions, calls, braces, parentheses and semicolons.
Its state is the depth, the definition whose body has not begun, and the stack of those that are open; what a
token ends or calls follows from the state before it.  All of it happens in the row of the file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.arrays import running

_ANY = r"(?s:.)"
_LINE = r"//[^\n]*+"
_BLOCK = rf"/\*{_ANY}*?(?:\*/|\z)"
_NESTED = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*+\*/)*+(?:\*/|\z)"
_DOUBLE = rf'"(?:[^"\\\n]|\\{_ANY})*+"'
_SINGLE = rf"'(?:[^'\\\n]|\\{_ANY})*+'"
_TRIPLE = rf'"""(?:[^"\\]|\\{_ANY}|"(?!""))*+(?:"""|\z)'
_TRIPLE_SINGLE = rf"'''(?:[^'\\]|\\{_ANY}|'(?!''))*+(?:'''|\z)"
_TEMPLATE = rf"`(?:[^`\\$]|\\{_ANY}|\$(?!\{{)|\$\{{(?:[^{{}}`]|\{{[^{{}}]*+\}}|`[^`]*+`)*+\}})*+`"
_CHAR = rf"b?'(?:\\(?:x[0-9a-fA-F]{{2}}|u\{{[^}}']*+\}}|[^xu\n])|[^'\\\n])'"
_RUST_RAW = rf'\bb?r(#*)"{_ANY}*?"\1'
_RUST_STRING = rf'"(?:[^"\\]|\\{_ANY})*+"'
_REGEX = r"(?<=(?:[=(,:;!&|?{}\[]|\breturn)\s{0,4})/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/"
_HASH = r"#[^\n]*+"

#: Patterns of what is no code, by family of languages.
BLANK = {
    "rust": "|".join((_LINE, _NESTED, _RUST_RAW, _RUST_STRING, _CHAR)),
    "script": "|".join((_LINE, _BLOCK, _DOUBLE, _SINGLE, _TEMPLATE, _REGEX)),
    "go": "|".join((_LINE, _BLOCK, _DOUBLE, r"`[^`]*+`", _SINGLE)),
    "kotlin": "|".join((_LINE, _NESTED, _TRIPLE, _DOUBLE, _SINGLE)),
    "java": "|".join((_LINE, _BLOCK, _TRIPLE, _DOUBLE, _SINGLE)),
    "c": "|".join((_LINE, _BLOCK, _DOUBLE, rf"(?<![0-9a-fA-F]){_SINGLE}")),
    "php": "|".join((_LINE, _BLOCK, _HASH, _DOUBLE, _SINGLE)),
    "python": "|".join((_HASH, rf"\b[rbufRBUF]{{0,2}}{_TRIPLE}", _TRIPLE, _TRIPLE_SINGLE, _DOUBLE, _SINGLE)),
    "hash": "|".join((_HASH, _DOUBLE, _SINGLE)),
    "other": "|".join((_DOUBLE, _SINGLE, rf"(?://|#)[^\n]*+")),
}
FAMILIES = {
    "rust": ("rs",), "script": ("js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts"), "go": ("go",), "kotlin": ("kt", "kts", "swift", "scala"),
    "java": ("java", "cs", "dart", "groovy"), "c": ("c", "h", "cc", "cpp", "cxx", "hpp", "hh"), "php": ("php",), "python": ("py", "pyi"),
    "hash": ("rb", "sh", "bash", "toml", "yaml", "yml", "r", "pl", "ex", "exs", "jl"),
}


def family(extension: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(extension.isin(*kv[1]), kv[0]), FAMILIES.items(), F).otherwise("other")


def _blank(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\n]", " ")


def _rebuilt(text: Column, pattern: str, of_found, of_between) -> Column:
    """A text with what a pattern finds, and what lies between, replaced piece by piece."""

    def pieces(x: Column) -> Column:
        both = F.transform(x["found"], lambda m, i: F.concat(of_between(F.get(x["between"], i)), of_found(m)))
        return F.concat(F.array_join(both, ""), of_between(F.element_at(x["between"], -1)))

    return T.let(F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.split(text, pattern, -1).alias("between")), pieces)


def _blank_string(x: Column) -> Column:
    """Blanks; in templates, what is inserted stays."""
    inserted = _rebuilt(x, r"\$\{[^{}`]*+\}", lambda m: F.concat(F.lit("  "), F.substring(m, 3, F.length(m) - 3), F.lit(" ")), _blank)
    return F.when(x.startswith("`") & F.contains(x, F.lit("${")), inserted).otherwise(_blank(x))


def mask(content: Column, extension: Column) -> Column:
    """A source text whose strings and comments are blank; all else, and all line breaks, stay in place."""

    def of_text(x: Column) -> Column:
        text, kind = x["text"], x["family"]
        done = [F.when(kind == f, _rebuilt(text, p, _blank_string if f == "script" else _blank, lambda b: b)) for f, p in BLANK.items()]
        return F.coalesce(*done)

    return T.let(F.struct(F.coalesce(content, F.lit("")).alias("text"), family(extension).alias("family")), of_text)


_NAME = r"[A-Za-z_$][\w$]*"
#: Definitions by family: (pattern, its kind); the last word before an end, a type parameter or a parenthesis is the name.
_DEFINITIONS = {
    "rust": (
        (rf"\bfn\s+{_NAME}", "function"), (rf"\b(?:struct|union)\s+{_NAME}", "class"), (rf"\benum\s+{_NAME}", "enum"), (rf"\btrait\s+{_NAME}", "interface"),
        (rf"\bmod\s+{_NAME}", "module"), (rf"\bmacro_rules!\s*{_NAME}", "function"), (rf"\btype\s+{_NAME}", "type_alias"),
        (rf"\b(?:const|static)\s+(?:mut\s+)?(?!fn\b){_NAME}(?=\s*:)", "variable"), (r"^\s*(?:unsafe\s+)?impl\b[^{;]*", "impl"),
    ),
    "script": (
        (rf"\bfunction\s*\*?\s*{_NAME}", "function"), (rf"\bclass\s+(?!extends\b){_NAME}", "class"), (rf"\binterface\s+{_NAME}", "interface"),
        (rf"\benum\s+{_NAME}", "enum"), (rf"\b(?:namespace|module)\s+{_NAME}(?=\s*\{{)", "module"), (rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+{_NAME}", "type_alias"),
        (rf"\b(?:const|let|var)\s+{_NAME}(?=\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|(?:\([^()]*\)|{_NAME})\s*(?::[^={{}}]+)?=>))", "function"),
        (rf"(?:^\s*|(?<=[{{}};]\s{{0,4}}))(?:(?:public|private|protected|static|async|override|abstract|readonly|get|set)\s+)*\*?\s*#?(?!(?:if|for|while|switch|catch|function|return|with|do|else|new|await|super|constructor\.)\b){_NAME}(?=\s*(?:<[^<>]*>)?\((?:[^()]|\([^()]*\))*+\)\s*(?::\s*[^{{;=]+)?\{{)", "method"),
    ),
    "go": (
        (rf"^func\s+\([^)]*\)\s*{_NAME}", "method"), (rf"^func\s+{_NAME}", "function"), (rf"^type\s+{_NAME}(?:\[[^\]]*\])?\s+struct\b", "class"),
        (rf"^type\s+{_NAME}(?:\[[^\]]*\])?\s+interface\b", "interface"), (rf"^type\s+{_NAME}", "type_alias"),
    ),
    "kotlin": (
        (rf"\bfun\s+(?:<[^<>]*>\s*)?(?:[\w.]+(?:<[^<>]*>)?\.)?{_NAME}", "function"), (rf"\bfunc\s+{_NAME}", "function"), (rf"\bdef\s+{_NAME}", "function"),
        (rf"\b(?:interface|protocol|trait)\s+{_NAME}", "interface"), (rf"\benum\s+(?:class\s+)?{_NAME}", "enum"), (rf"\b(?:class|object|struct|extension)\s+{_NAME}", "class"),
    ),
    "java": (
        (rf"\b(?:class|record)\s+{_NAME}", "class"), (rf"@?\binterface\s+{_NAME}", "interface"), (rf"\benum\s+{_NAME}", "enum"),
        (rf"(?:^\s*|(?<=[{{}};]\s{{0,4}}))(?:@\w+(?:\([^()]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|default|native|async|virtual|override|internal|sealed)\s+)*(?:<[^()]*>\s*)?(?!(?:return|new|throw|else|case|await|assert|yield)\b)[\w.]+(?:<[^()=;]*>)?(?:\[\])*\??\s+{_NAME}(?=\s*\()", "method"),
        (rf"^\s*(?:(?:public|private|protected)\s+)+{_NAME}(?=\s*\()", "method"),
    ),
    "c": (
        (rf"\b(?:class|struct|union)\s+{_NAME}(?=\s*(?:final\s*)?(?::[^:;(]|\{{|$))", "class"), (rf"\benum\s+(?:class\s+)?{_NAME}", "enum"), (rf"\bnamespace\s+{_NAME}", "module"),
        (rf"^\s*(?:(?:static|inline|extern|virtual|constexpr|explicit|const|unsigned)\s+)*(?!(?:return|else|new|delete|throw|case|goto)\b)[\w:]+(?:<[^()=;]*>)?[\s*&]+(?:{_NAME}::)*~?{_NAME}(?=\s*\([^;]*$)", "function"),
    ),
    "php": (
        (rf"\bfunction\s+&?{_NAME}", "function"), (rf"\b(?:class|trait)\s+{_NAME}", "class"), (rf"\binterface\s+{_NAME}", "interface"), (rf"\benum\s+{_NAME}", "enum"),
    ),
}
_OWNERS = ("class", "interface", "enum", "impl")
_WORDS = (
    "if", "for", "while", "switch", "return", "catch", "fn", "func", "fun", "function", "else", "in", "not", "await", "throw", "typeof", "sizeof",
    "synchronized", "super", "impl",
)
#: More of them by family.
_MORE_WORDS = {"rust": ("match", "loop", "move"), "kotlin": ("when", "guard", "match"), "php": ("match", "foreach", "isset", "array"), "java": ("foreach", "lock", "using")}
#: A call: a name, type arguments and an opening parenthesis; macros too.
_CALL = rf"{_NAME}(?:(?:::)?<[\w\s,.:&'\[\]?]*>)?!?\s*\("
_MARKS = r"[{}();]"

_TOKEN = "struct<kind:string,name:string,line:int>"
_OPEN = "struct<name:string,kind:string,path:string,line:int,depth:int,parens:int>"
_STATE = f"struct<depth:int,parens:int,pending:{_OPEN},stack:array<{_OPEN}>>"


def tokens(masked: Column, language: str) -> Column:
    """Tokens of a mask, in order: definitions, calls and marks, with their lines."""
    definitions = _DEFINITIONS[language]
    pattern = "|".join([p for p, _ in definitions] + [_CALL, _MARKS])

    def of_token(t: Column, line: Column) -> Column:
        bare = F.trim(F.regexp_replace(t, r"(?:(?:::)?<[^()]*>)?!?\s*\($", ""))
        of_definition = lambda acc, d: acc.when(t.rlike(f"^(?:{_loose(d[0])})$"), d[1])
        kind = reduce(of_definition, definitions, F.when(t.rlike(f"^{_MARKS}$"), t))
        kind = kind.when(bare.isin(*_WORDS, *_MORE_WORDS.get(language, ())), "(").otherwise("call")
        name = F.when(kind == "impl", _impl_owner(t)).when(kind == "call", bare).otherwise(F.regexp_extract(t, rf"^type\s+({_NAME})|({_NAME})$", 0))
        name = F.regexp_replace(name, r"^type\s+", "")
        return F.struct(kind.alias("kind"), name.alias("name"), (line + 1).cast("int").alias("line"))

    return F.flatten(F.transform(F.split(masked, "\n"), lambda row, i: F.transform(F.regexp_extract_all(row, F.lit(pattern), 0), lambda t: of_token(t, i))))


def _loose(pattern: str) -> str:
    """A definition's pattern without what must follow it, which the token no longer has."""
    depth, out, i = 0, "", 0
    while i < len(pattern):
        if pattern.startswith("(?=", i):
            depth, i = 1, i + 3
            while depth:
                if pattern[i] == "\\":
                    i += 1
                elif pattern[i] == "[":
                    i = pattern.index("]", i + 2 if pattern[i + 1] in "]^" else i + 1)
                elif pattern[i] in "()":
                    depth += 1 if pattern[i] == "(" else -1
                i += 1
            continue
        out += pattern[i]
        i += 1
    return out


def _impl_owner(t: Column) -> Column:
    """The type of an impl block, without paths, parameters and references."""
    head = F.regexp_replace(F.regexp_replace(t, r"\bwhere\b.*$", ""), r"^\s*(?:unsafe\s+)?impl\s*(?:<(?:[^<>]|<[^<>]*>)*>)?", "")
    own = F.trim(F.regexp_replace(head, r"^.*\bfor\s+", ""))
    return F.regexp_extract(F.regexp_replace(own, r"<.*$", ""), rf"({_NAME})\s*$", 1)


def _next(s: Column, t: Column) -> Column:
    """The state after a token."""
    kind = t["kind"]
    nothing = F.lit(None).cast(_OPEN)
    owner = F.element_at(s["stack"], -1)
    has = F.size(s["stack"]) > 0
    path = F.when(has, F.concat_ws("/", owner["path"], t["name"])).otherwise(t["name"])
    is_method = (kind == "function") & has & owner["kind"].isin(*_OWNERS)
    new = F.struct(t["name"].alias("name"), F.when(is_method, "method").otherwise(kind).alias("kind"), path.alias("path"), t["line"].alias("line"), F.lit(0).alias("depth"), s["parens"].alias("parens"))
    p = s["pending"]
    body = p.isNotNull() & (s["parens"] == p["parens"])
    opened = F.struct(p["name"].alias("name"), p["kind"].alias("kind"), p["path"].alias("path"), p["line"].alias("line"), (s["depth"] + 1).alias("depth"), s["parens"].alias("parens"))

    def state(depth: Column, parens: Column, pending: Column, stack: Column) -> Column:
        return F.struct(depth.alias("depth"), parens.alias("parens"), pending.cast(_OPEN).alias("pending"), stack.alias("stack")).cast(_STATE)

    ends = has & (owner["depth"] == s["depth"])
    closed = F.when(ends, F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1)).otherwise(s["stack"])
    return (
        F.when(kind == "{", state(s["depth"] + 1, s["parens"], F.when(body, nothing).otherwise(p), F.when(body, F.array_append(s["stack"], opened.cast(_OPEN))).otherwise(s["stack"])))
        .when(kind == "}", state(F.greatest(s["depth"] - 1, F.lit(0)), s["parens"], F.when(body, nothing).otherwise(p), closed))
        .when((kind == "(") | (kind == "call"), state(s["depth"], s["parens"] + 1, p, s["stack"]))
        .when(kind == ")", state(s["depth"], F.greatest(s["parens"] - 1, F.lit(0)), p, s["stack"]))
        .when(kind == ";", state(s["depth"], s["parens"], F.when(body, nothing).otherwise(p), s["stack"]))
        .otherwise(state(s["depth"], s["parens"], new, s["stack"]))
    )


_ROW = "struct<row:string,name:string,kind:string,name_path:string,line:int,end_line:int>"


def _rows(s: Column, t: Column, language: str) -> Column:
    """What a token says, given the state before it: symbols that end with it, and a call."""
    kind, p = t["kind"], s["pending"]
    owner = F.element_at(s["stack"], -1)

    def symbol(x: Column, end: Column) -> Column:
        return F.struct(F.lit("symbol").alias("row"), x["name"].alias("name"), x["kind"].alias("kind"), x["path"].alias("name_path"), x["line"].alias("line"), end.alias("end_line")).cast(_ROW)

    ends = (kind == "}") & (F.size(s["stack"]) > 0) & (owner["depth"] == s["depth"])
    body = p.isNotNull() & (s["parens"] == p["parens"])
    bare = body & (kind.isin(";", "}") | ~kind.isin("{", "(", ")", "call"))
    inside = F.filter(s["stack"], lambda x: x["kind"].isin("function", "method"))
    # a definition that has no body yet: what is called in its parameters and bounds is no call, after them its value
    head = p.isNotNull() & (p["line"] == t["line"])
    valued = head & (s["parens"] == p["parens"]) & p["kind"].isin("function", "method") & F.lit(language != "rust")
    caller = F.when(valued, p["path"]).when(F.size(inside) > 0, F.element_at(inside, -1)["path"]).otherwise("<module>")
    call = F.struct(F.lit("call").alias("row"), t["name"].alias("name"), F.lit("").alias("kind"), caller.alias("name_path"), t["line"].alias("line"), t["line"].alias("end_line")).cast(_ROW)
    calls = (kind == "call") & (~head | valued | p["kind"].isin("variable", "type_alias"))
    return F.filter(
        F.array(
            F.when(bare, symbol(p, F.when(kind == ";", t["line"]).otherwise(p["line"]))),
            F.when(ends, symbol(owner, t["line"])),
            F.when(calls, call),
        ),
        lambda x: x.isNotNull() & (x["kind"] != "impl"),
    )


def parsed(content: Column, extension: Column) -> Column:
    """Symbols and calls (row, name, kind, name_path, line, end_line) of a source text; none for other languages."""
    zero = F.struct(F.lit(0), F.lit(0), F.lit(None).cast(_OPEN), F.array().cast(f"array<{_OPEN}>")).cast(_STATE)
    end = F.struct(F.lit(";").alias("kind"), F.lit("").alias("name"), F.lit(0).alias("line")).cast(_TOKEN)

    def of_language(language: str):
        def of_tokens(ts: Column) -> Column:
            return T.let(running(ts, _STATE, zero, _next), lambda states: F.flatten(F.transform(ts, lambda t, i: _rows(F.get(states, i), t, language))))

        return of_tokens

    def of_text(x: Column) -> Column:
        found = [F.when(x["family"] == f, T.let(F.concat(tokens(x["mask"], f).cast(f"array<{_TOKEN}>"), F.array(end)), of_language(f))) for f in _DEFINITIONS]
        return F.coalesce(*found, F.array().cast(f"array<{_ROW}>"))

    return T.let(F.struct(mask(content, extension).alias("mask"), family(extension).alias("family")), of_text)
