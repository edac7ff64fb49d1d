"""What a source text imports and which package it is of, read statement by statement from its tokens, for languages whose imports stand in strings, in
trees or in preprocessor lines.  Strings and comments are tokens or nothing, so no name in them counts."""

from __future__ import annotations

import re
from collections.abc import Iterator

Token = tuple[str, str]  # kind (name, string, line, sign), text

_BLANK = r"[ \t\r\f\v]+|\\\r?\n"
_LONG = r"/\*.*?(?:\*/|\Z)"
_DOUBLE, _SINGLE, _TICKS = r'"(?:[^"\\\n]|\\.)*"?', r"'(?:[^'\\\n]|\\.)*'?", r"`[^`]*`?"
_LETTER = r"'(?:[^'\\\n]|\\[^\n']*)'"  # Rust's ' also begins a lifetime


def _lexer(skipped: list[str], strings: list[str]) -> re.Pattern:
    return re.compile(rf"(?P<skip>{'|'.join([_BLANK, *skipped])})|(?P<string>{'|'.join(strings)})|(?P<line>\n)|(?P<name>[^\W\d]\w*)|(?P<sign>::|.)", re.S)


_LEXERS = {
    "go": _lexer([r"//[^\n]*", _LONG], [_DOUBLE, _LETTER, _TICKS]),
    "rust": _lexer([r"//[^\n]*", _LONG], [_DOUBLE, _LETTER]),
    "ruby": _lexer([r"#[^\n]*", r"^=begin\b.*?^=end\b[^\n]*"], [_DOUBLE, _SINGLE]),
    "c": _lexer([r"//[^\n]*", _LONG], [_DOUBLE, _SINGLE]),
    "script": _lexer([r"//[^\n]*", _LONG], [_DOUBLE, _SINGLE, _TICKS]),
}
_LEXERS["ruby"] = re.compile(_LEXERS["ruby"].pattern, re.S | re.M)


def lexed(text: str, lexer: str, lines: bool = False) -> list[Token]:
    return [(m.lastgroup, m[0]) for m in _LEXERS[lexer].finditer(text) if m.lastgroup != "skip" and (lines or m.lastgroup != "line")]


def _at(tokens: list[Token], k: int) -> Token:
    return tokens[k] if 0 <= k < len(tokens) else ("", "")


def _bare(literal: str) -> str:
    return literal.strip(literal[0])


def _until(tokens: list[Token], k: int, *ends: str) -> int:
    while k < len(tokens) and tokens[k][1] not in ends:
        k += 1
    return k


# --- Go: a package clause first, then import declarations of one or several specs, each perhaps with a name


def go_package(text: str) -> str:
    tokens = lexed(text, "go")
    return _at(tokens, 1)[1] if _at(tokens, 0)[1] == "package" and _at(tokens, 1)[0] == "name" else ""


def go_imports(text: str) -> Iterator[str]:
    tokens, depth = lexed(text, "go"), 0
    for k, (kind, word) in enumerate(tokens):
        depth += (word in "{(" and kind == "sign") - (word in "})" and kind == "sign")
        if depth or (kind, word) != ("name", "import"):
            continue
        end = _until(tokens, k, ")") if _at(tokens, k + 1)[1] == "(" else k + 2 + (_at(tokens, k + 1)[0] != "string")
        yield from (_bare(x) for what, x in tokens[k + 1 : end] if what == "string")


# --- Rust: use trees, and crates that are named


def _tree(tokens: list[Token], before: str) -> Iterator[str]:
    """The paths of a use tree, which may branch in braces, end in a star, or be renamed."""
    path, k = before, 0
    while k < len(tokens):
        word = tokens[k][1]
        if word == "{":
            depth, start = 1, k + 1
            for j in range(k + 1, len(tokens) + 1):
                inner = _at(tokens, j)[1]
                depth += (inner == "{") - (inner in ("}", ""))
                if depth == 0 or (depth == 1 and inner == ","):
                    yield from _tree(tokens[start:j], path)
                    start = j + 1
                if depth == 0:
                    return
        if word == "as":
            break
        path += word if word != "self" or not before or path != before else ""
        k += 1
    if tokens:
        yield path.removesuffix("::") if path != "::" else path


def rust_imports(text: str) -> Iterator[str]:
    tokens = lexed(text, "rust")
    for k, (kind, word) in enumerate(tokens):
        if kind != "name":
            continue
        if word == "use" and _at(tokens, k - 1)[1] in ("", ";", "}", "{", "]", "pub", ")"):
            yield from _tree(tokens[k + 1 : _until(tokens, k, ";")], "")
        elif word == "crate" and _at(tokens, k - 1)[1] == "extern":
            yield _at(tokens, k + 1)[1]


# --- C and C++: included headers (or the macro that names one), imported modules; namespaces that open one another


def _header(tokens: list[Token], k: int) -> str:
    kind, word = _at(tokens, k)
    if kind == "string":
        return _bare(word)
    if word == "<":
        return "".join(x for _, x in tokens[k + 1 : _until(tokens, k, ">", "\n")])
    return word if kind == "name" else ""


def c_imports(text: str, modules: bool = False) -> Iterator[str]:
    tokens = lexed(text, "c", lines=True)
    for k, (kind, word) in enumerate(tokens):
        first = _at(tokens, k - 1)[0] in ("", "line")
        if word == "#" and first and _at(tokens, k + 1)[1] in ("include", "include_next"):
            yield _header(tokens, k + 2)
        elif modules and (kind, word) == ("name", "import") and (first or _at(tokens, k - 1)[1] in (";", "}", "export")):
            at = _at(tokens, k + 1)
            if at[0] == "string" or at[1] == "<":
                yield _header(tokens, k + 1)
            elif at[0] == "name" or at[1] == ":":
                yield "".join(x for _, x in tokens[k + 1 : _until(tokens, k, ";", "\n", "[")])


def cpp_package(text: str) -> str:
    """The namespaces that the first one opens, or the module where there is none."""
    tokens, module = lexed(text, "c"), ""
    for k, (kind, word) in enumerate(tokens):
        if kind != "name" or _at(tokens, k - 1)[1] in (".", "::", "using"):
            continue
        if word == "module" and not module and _at(tokens, k - 1)[1] in ("", ";", "export") and _at(tokens, k + 1)[0] == "name":
            module = "".join(x for _, x in tokens[k + 1 : _until(tokens, k, ";", ":")])
        if word == "namespace":
            parts = []
            while _at(tokens, k)[1] == "namespace":
                end = _until(tokens, k, "{", ";", "=")
                named = [x for what, x in tokens[k + 1 : end] if what == "name" and x not in ("inline", "deprecated", "nodiscard")]
                if _at(tokens, end)[1] != "{":
                    break
                parts += named
                k = end + 1 + (_at(tokens, end + 1)[1] == "inline")
            if parts:
                return "::".join(parts)
    return module


# --- Ruby: what is required, loaded, or loaded when a constant is first named


def ruby_imports(text: str) -> Iterator[str]:
    tokens = lexed(text, "ruby")
    for k, (kind, word) in enumerate(tokens):
        if kind != "name" or word not in ("require", "require_relative", "load", "autoload") or _at(tokens, k - 1)[1] in (".", "::", "def", ":", "@"):
            continue
        k += 1 + (_at(tokens, k + 1)[1] == "(")
        if word == "autoload":
            k = _until(tokens, k, ",") + 1
        if _at(tokens, k)[0] == "string":
            yield _bare(_at(tokens, k)[1])


# --- JavaScript and TypeScript: import and export declarations with a source, calls of import and require


def script_imports(text: str) -> Iterator[str]:
    tokens = lexed(text, "script")
    for k, (kind, word) in enumerate(tokens):
        if kind != "name" or word not in ("import", "export", "require") or _at(tokens, k - 1)[1] == ".":
            continue
        after = _at(tokens, k + 1)
        if after[1] == "(" and word != "export":
            if _at(tokens, k + 2)[0] == "string" and _at(tokens, k + 3)[1] in (")", ","):
                yield _bare(_at(tokens, k + 2)[1])
        elif word == "import" and after[0] == "string":
            yield _bare(after[1])
        elif word == "import" or word == "export" and after[1] in ("*", "{", "type"):
            at = _until(tokens, k, "from", ";", "=", "(")
            if _at(tokens, at)[1] == "from" and _at(tokens, at + 1)[0] == "string":
                yield _bare(_at(tokens, at + 1)[1])


def _none(text: str) -> str:
    return ""


READERS = {
    "go": (go_imports, go_package),
    "rust": (rust_imports, _none),
    "ruby": (ruby_imports, _none),
    "c": (c_imports, _none),
    "cpp": (lambda text: c_imports(text, True), cpp_package),
    "typescript": (script_imports, _none),
    "tsx": (script_imports, _none),
    "javascript": (script_imports, _none),
}
