"""Symbols, chunks and file rows from source texts: a scanner for Java, `ast` for Python, brace or indentation scanners for the rest.

Parsing is table-generating work that no built-in function does, so it runs on workers; a file that can't be parsed gives a file row and an error,
never an exception.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusframe.functions.text import CHARS_PER_TOKEN
from corpusframe.operators.languages import BY_NAME, BY_SUFFIX, LanguageProfile, imports_of, package_of
from corpusframe.operators.windows import MIN_TOKENS, line_windows
from corpusframe.schemas import CHUNKS, FILES, SYMBOLS
from corpusframe.sources.session import dealt

MAX_TOKENS = 500
BATCH_FILES = 100

# Type names that are no references.
JAVA_TYPES = frozenset(["String", "Object", "Class", "Integer", "Long", "Boolean", "Double", "Float", "Byte", "Short", "Character", "Void", "List", "Map", "Set", "Collection", "Optional", "Stream", "Override", "Deprecated", "SuppressWarnings"])
COMMON_TYPES = frozenset(["str", "int", "float", "bool", "none", "list", "dict", "set", "tuple", "type", "object", "string", "number", "boolean", "void", "any", "null", "undefined", "self", "cls"])


@dataclass
class Symbol:
    id: str
    name: str
    qualified_name: str
    signature: str
    kind: str
    visibility: str
    file_path: str
    package: str = ""
    module: str = ""
    parent_class: str = ""
    implements: str = ""
    extends_class: str = ""
    annotations: str = ""
    line_start: int = 0
    line_end: int = 0
    body_preview: str = ""
    imports: str = ""
    type_references: str = ""


@dataclass
class Chunk:
    id: str
    content: str
    file_path: str
    symbol_name: str
    kind: str
    module: str
    language: str
    enclosing_class: str
    enclosing_method: str
    line_start: int
    line_end: int
    token_count: int
    extension: str


@dataclass
class Parsed:
    symbols: list[Symbol] = field(default_factory=list)
    chunks: list[Chunk] = field(default_factory=list)
    package: str = ""
    imports: list[str] = field(default_factory=list)
    error: str = ""


def module_of(path: str) -> str:
    parts = path.split("/")
    if "src" in parts:
        return "/".join(parts[: parts.index("src")])
    return parts[0] if len(parts) > 1 else ""


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name else ""


def tokens(text: str) -> int:
    return len(text) // CHARS_PER_TOKEN


def split_chunk(base: str, prefix: str, body: str, first_line: int, path: str, language: str, least: int = 0, limit_prefix: bool = True, window_prefix: str | None = None, tail: str = "stop", **more: str) -> Iterator[Chunk]:
    """One chunk, or windows of lines where the text is too long."""

    def made(ident: str, content: str, a: int, b: int) -> Chunk:
        return Chunk(ident, content, path, more.get("symbol_name", ""), more["kind"], module_of(path), language, more.get("enclosing_class", ""), more.get("enclosing_method", ""), a, b, tokens(content), suffix_of(path)[1:])

    lines = body.split("\n")
    if tokens(prefix + body if limit_prefix else body) <= MAX_TOKENS and not least:
        yield made(base, prefix + body, first_line, first_line + len(lines) - 1)
        return
    part = 0
    for s, e in line_windows([len(x) for x in lines], tail=tail):
        content = (prefix if window_prefix is None else window_prefix) + "\n".join(lines[s:e])
        if tokens(content) >= least:
            yield made(f"{base}::part{part}", content, first_line + s, first_line + e - 1)
            part += 1


def masked(text: str, comment: str = "//", strings: str = "\"'`", hashes: bool = False) -> str:
    """The text with what stands in strings and comments as spaces, line ends kept, so that positions stay."""
    pattern = [r'"""(?:[^\\]|\\.)*?"""', r"/\*.*?(?:\*/|\Z)", r"//[^\n]*"] if comment == "//" else []
    if hashes:
        pattern += [r"#[^\n]*"]
    pattern += [rf"{q}(?:[^{q}\\\n]|\\.)*(?:{q}|(?=\n)|\Z)" for q in strings]
    return re.sub("|".join(pattern), lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def closing(text: str, at: int, pair: str = "{}") -> int:
    """Where the bracket that opens at a position is closed; the end of the text if it isn't."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.start()
    return len(text)


def commas(text: str) -> list[str]:
    """Parts between commas that stand in no brackets."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and depth == 0:
            out.append(text[at:k])
            at = k + 1
    return [p.strip() for p in [*out, text[at:]] if p.strip()]


def line_ends(text: str) -> list[int]:
    """Where each line ends."""
    return [m.start() for m in re.finditer("\n", text)]


_JAVA_TYPE = re.compile(r"(?<![@\w.])(class|interface|enum)\s+(\w+)")
_ANNOTATION = re.compile(r"@(?!interface\b)([\w.]+)")


class JavaScanner:
    """Walks over member declarations by matching braces in the masked text."""

    def __init__(self, path: str, text: str, nested_names: bool = False, tail: str = "stop"):
        self.path, self.text, self.flat = path, text, masked(text, strings="\"'")
        self.nested_names, self.tail = nested_names, tail
        self.out = Parsed(package=package_of(BY_NAME["java"], text, self.flat), imports=imports_of(BY_NAME["java"], text, self.flat))
        self.ends = line_ends(text)

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.ends, at) + 1

    def members(self, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(start, where the body opens or -1, end) of each declaration between two positions."""
        at = start
        k = start
        while k < end:
            c = self.flat[k]
            if c in "([":
                k = closing(self.flat, k, "()" if c == "(" else "[]")
            elif c == ";":
                yield at, -1, k + 1
                at = k + 1
            elif c == "{":
                close = min(closing(self.flat, k), end)
                if re.search(r"(?<![=!<>])=(?!=)", self._bare(at, k)):  # an initialiser goes on to its semicolon
                    k = close
                else:
                    yield at, k, min(close + 1, end)
                    at, k = close + 1, close
            elif c == "}":
                at = k + 1
            k += 1

    def _bare(self, start: int, end: int) -> str:
        """A header without annotations and their arguments."""
        head = self.flat[start:end]
        while m := _ANNOTATION.search(head):
            stop = m.end()
            if (p := re.match(r"\s*\(", head[stop:])) is not None:
                stop = closing(head, stop + p.end() - 1, "()") + 1
            head = head[: m.start()] + " " * (stop - m.start()) + head[stop:]
        return head

    def scan(self) -> Parsed:
        for start, body, end in self.members(0, len(self.flat)):
            self.type(start, body, end, "", "", True)
        return self.out

    def begin(self, start: int, end: int) -> int:
        m = re.compile(r"\S").search(self.flat, start, end)
        return m.start() if m else start

    def type(self, start: int, body: int, end: int, outer: str, outer_qualified: str, top: bool) -> bool:
        head = self._bare(start, body) if body >= 0 else ""
        m = _JAVA_TYPE.search(head)
        if not m or "(" in head[: m.start()]:
            return False
        kind, name = m[1], m[2]
        start = self.begin(start, end)
        holder = outer_qualified if self.nested_names and outer_qualified else self.out.package
        qualified = f"{holder}.{name}" if holder else name
        rest = re.sub(r"^\s*<", "<", head[m.end() :])
        if rest.startswith("<"):
            rest = rest[closing(rest, 0, "<>") + 1 :]
        ext = re.search(r"\bextends\s+(.*?)(?=\bimplements\b|\bpermits\b|$)", rest, re.S)
        imp = re.search(r"\bimplements\s+(.*?)(?=\bpermits\b|$)", rest, re.S)
        tidy = lambda s: " ".join(s.split())
        extends = commas(tidy(ext[1])) if ext else []
        implements = commas(tidy(imp[1])) if imp else []
        if kind == "interface":
            extends, implements = [], [*implements, *extends]
        declared = self.text[start:end]
        modifiers = head[: m.start()]
        names = set(re.findall(r"\b[A-Z]\w*", self.flat[start:end])) - JAVA_TYPES - {name}
        names = {n for n in names if not n.isupper() or len(n) == 1}
        symbol = Symbol(
            f"{self.path}::{kind}::{qualified}", name, qualified, f"{kind} {name}", kind, self.visible(modifiers), self.path, self.out.package, module_of(self.path), outer, ", ".join(implements), ", ".join(extends), ", ".join(self.annotations(start, body)),
            self.line(start), self.line(end - 1), declared[:200], ", ".join(self.out.imports) if top else "", ", ".join(sorted(names)),
        )
        self.out.symbols.append(symbol)
        signatures = []
        inner = body + 1
        if kind == "enum":  # constants end at the first semicolon that stands in no brackets
            for a, b, e in self.members(inner, end - 1):
                if b < 0:
                    inner = e
                    break
            else:
                inner = end - 1
        for a, b, e in self.members(inner, end - 1):
            if not self.type(a, b, e, name, qualified, False):
                signatures += self.member(a, b, e, name, qualified)
        summary = f"// {self.path} :: {qualified}\n{kind} {name}" + (f" extends {', '.join(extends)}" if extends else "") + (f" implements {', '.join(implements)}" if implements else "")
        summary += "".join(f"\n  {v} {s}" for v, s in signatures)
        self.out.chunks.append(Chunk(f"{self.path}::class_summary::{qualified}", summary, self.path, name, "class_summary", module_of(self.path), "java", outer, "", symbol.line_start, symbol.line_end, tokens(summary), "java"))
        return True

    def visible(self, modifiers: str) -> str:
        return next((v for v in ("public", "protected", "private") if re.search(rf"\b{v}\b", modifiers)), "package-private")

    def annotations(self, start: int, body: int) -> list[str]:
        bare_end = body if body >= 0 else start
        out, head = [], self.flat[start:bare_end]
        depth = 0
        for m in re.finditer(r"[()]|@(?!interface\b)([\w.]+)", head):
            if m[1]:
                if depth == 0:
                    out.append(m[1])
            else:
                depth += 1 if m[0] == "(" else -1
        return out

    def member(self, start: int, body: int, end: int, owner: str, qualified: str) -> list[tuple[str, str]]:
        head_end = body if body >= 0 else end - 1
        head = self._bare(start, head_end)
        start = self.begin(start, end)
        declared = self.text[start:end]
        common = {"file_path": self.path, "package": self.out.package, "module": module_of(self.path), "parent_class": owner, "line_start": self.line(start), "line_end": self.line(end - 1), "body_preview": declared[:200]}
        m = re.match(r"(?P<mods>[^()={]*?)(?P<name>\w+)\s*\(", head)
        if m and "=" not in head[: m.end()]:
            close = closing(head, m.end() - 1, "()")
            types = [self.parameter(p) for p in commas(head[m.end() : close])]
            signature = f"{m['name']}({', '.join(t for t in types if t)})"
            kind = "constructor" if m["name"] == owner else "method"
            visible = self.visible(m["mods"])
            notes = ", ".join(self.annotations(start, head_end))
            self.out.symbols.append(Symbol(f"{self.path}::method::{qualified}#{signature}", m["name"], f"{qualified}#{signature}", signature, kind, visible, annotations=notes, **common))
            prefix = f"// {self.path} :: {owner} :: {qualified}#{signature}\n"
            self.out.chunks += split_chunk(f"{self.path}::method_chunk::{qualified}#{signature}", prefix, declared, common["line_start"], self.path, "java", tail=self.tail, symbol_name=m["name"], kind="method", enclosing_class=owner, enclosing_method=f"{qualified}#{signature}")
            return [(visible, signature)]
        m = re.match(r"(?P<mods>.*?)(?P<type>[\w.]+(?:\s*<.*?>)?(?:\s*\[\s*\])*)\s+(?P<name>\w+)\s*(?:\[\s*\]\s*)*(?=[=,;]|$)", " ".join(head.split()))
        if m and body < 0 and m["name"] not in ("static", "final"):
            self.out.symbols.append(Symbol(f"{self.path}::field::{qualified}.{m['name']}", m["name"], f"{qualified}.{m['name']}", declared.rstrip(";")[:100], "field", self.visible(m["mods"] + " "), annotations=", ".join(self.annotations(start, head_end)), **common))
        return []

    def parameter(self, text: str) -> str:
        text = re.sub(r"\bfinal\b", " ", text).strip()
        m = re.match(r"(.*?)\s*(\.\.\.)?\s*(\w+)\s*((?:\[\s*\])*)$", text, re.S)
        kind = " ".join(m[1].split()) + (m[2] or "") + m[4].replace(" ", "") if m else text
        return "" if "." in re.sub(r"<.*>|\.\.\.", "", kind) else kind


def python_imports(tree: ast.Module) -> list[str]:
    """Imported modules in order; relative ones with their dots, and what `from .` imports after them."""
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(node.lineno, a.name) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            dots = "." * node.level
            out += [(node.lineno, dots + node.module)] if node.module else [(node.lineno, dots + a.name) for a in node.names]
    return list(dict.fromkeys(name for _, name in sorted(out, key=lambda x: x[0])))


def _first_line(text: str) -> str:
    line = text.split("\n", 1)[0].strip()
    return line if len(line) <= 120 else line[:120] + "..."


class GenericScanner:
    """Declarations of other languages; a function inside a class is a method, and functions are not looked into."""

    def __init__(self, path: str, text: str, profile: LanguageProfile, tail: str = "stop"):
        self.path, self.text, self.profile, self.tail = path, text, profile, tail
        self.out = Parsed()
        self.lines, self.ends = text.split("\n"), line_ends(text)

    def emit(self, kind: str, name: str, start: int, end: int, parent: str, bases: list[str], notes: list[str], visible: str, names: list[str]) -> None:
        """start and end are line numbers from 1, the end included."""
        body = "\n".join(self.lines[start - 1 : end])
        qualified = ".".join(x for x in (self.out.package, parent, name) if x)
        self.out.symbols.append(
            Symbol(f"{self.path}::{kind}::{qualified}", name, qualified, _first_line(body), kind, visible, self.path, self.out.package, module_of(self.path), parent, ", ".join(bases[1:]), bases[0] if bases else "", ", ".join(notes), start, end, body[:200], "", ", ".join(sorted(set(names))))
        )
        self.out.chunks += split_chunk(
            f"{self.path}::{kind}_chunk::{qualified}", f"// {self.path}\n", body, start, self.path, self.profile.name, limit_prefix=False, window_prefix=f"// {self.path} — {qualified}\n", tail=self.tail, symbol_name=name, kind=kind, enclosing_class=parent, enclosing_method=qualified if kind in ("method", "function") else ""
        )

    def scan(self) -> Parsed:
        flat = masked(self.text, "#" if self.profile.indented else "//", hashes=self.profile.indented)
        self.out.package, self.out.imports = package_of(self.profile, self.text, flat), imports_of(self.profile, self.text, flat)
        if self.profile.name == "python":
            tree = ast.parse(self.text)
            self.out.imports = python_imports(tree)
            self.python(tree.body, "")
        else:
            self.declared(flat, 0, len(flat), "")
        return self.out

    def python(self, body: list[ast.stmt], parent: str) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if parent else "function"
                bases = [ast.unparse(b) for b in node.bases] if kind == "class" else []
                notes = [ast.unparse(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]
                start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                names = [n.id for n in ast.walk(node) if isinstance(n, ast.Name) and n.id[:1].isupper() and n.id.lower() not in COMMON_TYPES and n.id != node.name]
                self.emit(kind, node.name, start, node.end_lineno, parent, bases, notes, self.python_visible(node.name), names)
                if kind == "class":
                    self.python(node.body, node.name)
            elif isinstance(node, ast.Assign | ast.AnnAssign) and not parent:
                target = node.targets[0] if isinstance(node, ast.Assign) else node.target
                if isinstance(target, ast.Name):
                    self.emit("field", target.id, node.lineno, node.end_lineno, parent, [], [], self.python_visible(target.id), [])
            elif hasattr(node, "body") and isinstance(node.body, list):  # if, try, with: transparent
                for part in ("body", "orelse", "finalbody"):
                    self.python([n for n in getattr(node, part, []) if isinstance(n, ast.stmt)], parent)

    @staticmethod
    def python_visible(name: str) -> str:
        return "private" if name.startswith("__") and not name.endswith("__") else "protected" if name.startswith("_") and not name.startswith("__") else "public"

    def declared(self, flat: str, start: int, end: int, parent: str) -> None:
        found = sorted(((m.start("name"), k, kind, m) for k, (kind, p) in enumerate(self.profile.declarations) for m in re.compile(p, re.M).finditer(flat, start, end)), key=lambda f: f[:2])
        at = start
        for _, _, kind, m in found:
            if m.start("name") < at:
                continue
            if self.profile.indented:
                first = bisect.bisect_left(self.ends, m.start("name"))
                indent = len(self.lines[first]) - len(self.lines[first].lstrip())
                last = next((k for k in range(first + 1, len(self.lines)) if self.lines[k].strip() and len(self.lines[k]) - len(self.lines[k].lstrip()) <= indent), len(self.lines) - 1)
                body, stop = m.end(), self.ends[last] + 1 if last < len(self.ends) else len(self.text) + 1
                first, last = first + 1, last + 1
            else:
                body = m.end()
                stop = min(closing(flat, body), end)
                first, last = bisect.bisect_left(self.ends, m.start("name")) + 1, bisect.bisect_left(self.ends, max(stop, body)) + 1
            kind = "method" if kind == "function" and parent else "function" if kind == "method" and not parent else kind
            bases = commas(re.sub(r"\b(?:extends|implements|with|public|private|virtual)\b", ",", m["bases"])) if "bases" in m.groupdict() and m["bases"] else []
            line = self.lines[first - 1]
            names = [n for n in re.findall(r"\b[A-Z]\w*", flat[body:stop]) if n.lower() not in COMMON_TYPES and n != m["name"]]
            self.emit(kind, m["name"], first, last, parent, bases, [], self.visible(m["name"], line), names)
            if kind in ("class", "interface"):
                self.declared(flat, body, stop, m["name"])
            at = stop

    def visible(self, name: str, line: str) -> str:
        if self.profile.name == "go":
            return "public" if name[:1].isupper() else "private"
        return next((v for v in ("public", "private", "protected", "internal") if re.search(rf"\b{v}\b", line)), "public")


def text_chunks(path: str, text: str) -> list[Chunk]:
    return list(split_chunk(f"{path}::block", f"// {path}\n", text, 1, path, suffix_of(path)[1:], least=MIN_TOKENS, kind="block"))


def parse(path: str, text: str, tail: str = "stop", nested_names: bool = False) -> Parsed:
    """By the suffix: the Java scanner, a profile's scanner, or plain text blocks.  What fails to parse is reported in `error`."""
    profile = BY_SUFFIX.get(suffix_of(path))
    try:
        if profile is None:
            return Parsed(chunks=text_chunks(path, text))
        return JavaScanner(path, text, nested_names, tail).scan() if profile.name == "java" else GenericScanner(path, text, profile, tail).scan()
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return Parsed(chunks=text_chunks(path, text), error=f"{type(e).__name__}: {e}")


def file_of(path: str, text: str, parsed: Parsed) -> dict[str, object]:
    classes = [s.name for s in parsed.symbols if s.kind in ("class", "interface", "enum") and not s.parent_class]
    prefixes = sorted({".".join(i.split(".")[:3]) for i in parsed.imports})
    name = path.rsplit("/", 1)[-1]
    return {"id": path, "path": path, "filename": name, "extension": suffix_of(path)[1:], "module": module_of(path), "package": parsed.package, "class_names": ", ".join(dict.fromkeys(classes)), "imports_summary": ", ".join(prefixes), "imports_full": ", ".join(parsed.imports), "loc": text.count("\n") + 1, "last_commit_sha": ""}


PARSED = T.StructType([T.StructField("path", T.StringType()), T.StructField("symbols", T.ArrayType(SYMBOLS)), T.StructField("chunks", T.ArrayType(CHUNKS)), T.StructField("file", FILES), T.StructField("error", T.StringType())])


def parsed(files: DataFrame, path: str = "path", content: str = "content", tail: str = "stop", nested_names: bool = False) -> DataFrame:
    """(path, symbols, chunks, file, error) of each source text; keep it (write or cache) before exploding it into the three tables.

    Parsing takes seconds for a megabyte of text, so texts are dealt out by path first, however few files or row groups they come from."""

    kinds = {f.name: to_arrow_type(f.dataType) for f in PARSED.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_FILES):
                part = batch.slice(at, BATCH_FILES)
                texts = [t or "" for t in part.column(1).to_pylist()]
                names = part.column(0).to_pylist()
                got = [parse(p, t, tail, nested_names) for p, t in zip(names, texts, strict=True)]
                columns = {
                    "path": names,
                    "symbols": [[vars(s) for s in g.symbols] for g in got],
                    "chunks": [[vars(c) for c in g.chunks] for g in got],
                    "file": [file_of(p, t, g) for p, t, g in zip(names, texts, got, strict=True)],
                    "error": [g.error for g in got],
                }
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds[c]) for c, v in columns.items()], names=list(columns))

    sources = files.select(F.coalesce(F.col(path), F.lit("")).alias("path"), F.col(content).cast("string").alias("content"))
    return dealt(sources, "path").mapInArrow(run, PARSED)


def symbols_of(parsed_: DataFrame) -> DataFrame:
    return parsed_.select(F.explode("symbols").alias("s")).select("s.*")


def chunks_of(parsed_: DataFrame) -> DataFrame:
    return parsed_.select(F.explode("chunks").alias("c")).select("c.*")


def files_of(parsed_: DataFrame) -> DataFrame:
    return parsed_.select("file.*")
