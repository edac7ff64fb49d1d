"""Arguments of the tools, checked."""

from __future__ import annotations

import re
from dataclasses import dataclass

MAX_QUERY = 500
MAX_LIMIT = 100
MAX_HISTORY = 50

# What the arguments may be.
KINDS = ("class", "interface", "enum", "method", "constructor", "field")
VISIBILITIES = ("public", "protected", "private", "package-private")
FORMATS = ("text", "json")
SCOPES = ("symbols", "files", "code")
MODES = ("full", "incremental")


def query(value: str, required: bool = True) -> str:
    value = (value or "").strip()
    if required and not value:
        raise ValueError("a query is needed")
    if len(value) > MAX_QUERY:
        raise ValueError(f"a query has at most {MAX_QUERY} characters")
    return value


def limit(value: int, most: int = MAX_LIMIT) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
        raise ValueError(f"a limit is 1 to {most}")
    return value


def one_of(value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{value!r} is not one of {', '.join(allowed)}")
    return value


def relative(path: str) -> str:
    """A path below the root: not empty, not absolute, without `..` and NUL."""
    if not path or not path.strip():
        raise ValueError("a path is needed")
    parts = path.replace("\\", "/").split("/")
    if path.startswith(("/", "\\", "~")) or re.match(r"[A-Za-z]:", path) or ".." in parts or "\x00" in path:
        raise ValueError(f"{path!r} leaves the repository")
    return path


def sha(value: str) -> str:
    if not re.fullmatch(r"[0-9a-fA-F]{4,40}", value or ""):
        raise ValueError("a commit is named by 4 to 40 hexadecimal digits")
    return value.lower()


@dataclass(frozen=True)
class SymbolSearch:
    query: str
    kinds: tuple[str, ...] = ()
    visibility: str | tuple[str, ...] | None = None
    module: str | None = None
    package_prefix: str | None = None
    file_pattern: str | None = None
    extends_or_implements: str | None = None
    has_annotation: str | None = None
    limit: int = 30

    def __post_init__(self) -> None:
        query(self.query)
        limit(self.limit)
        for k in self.kinds:
            one_of(k, KINDS)
        for name in self.visibilities:
            one_of(name, VISIBILITIES)

    @property
    def visibilities(self) -> tuple[str, ...]:
        return (self.visibility,) if isinstance(self.visibility, str) else tuple(self.visibility or ())


@dataclass(frozen=True)
class CodeSearch:
    query: str
    file_types: tuple[str, ...] = ()
    module: str | None = None
    enclosing_class: str | None = None
    exclude_tests: bool = True
    limit: int = 15

    def __post_init__(self) -> None:
        query(self.query)
        limit(self.limit)


@dataclass(frozen=True)
class FileSearch:
    query: str
    extension: str | None = None
    module: str | None = None
    limit: int = 20

    def __post_init__(self) -> None:
        query(self.query)
        limit(self.limit)


@dataclass(frozen=True)
class Context:
    file_path: str
    line_start: int
    line_end: int
    radius: int = 10

    def __post_init__(self) -> None:
        relative(self.file_path)
        if self.line_start < 1 or self.line_end < self.line_start or not 0 <= self.radius <= 100:
            raise ValueError("lines count from 1, the end is not before the start, and the radius is 0 to 100")


@dataclass(frozen=True)
class CommitSearch:
    query: str | None = None
    author: str | None = None
    since: str | None = None
    until: str | None = None
    file_path: str | None = None
    limit: int = 20

    def __post_init__(self) -> None:
        query(self.query or "", required=False)
        limit(self.limit)
        if self.file_path:
            relative(self.file_path)


@dataclass(frozen=True)
class DependencyGraph:
    file_path: str
    depth: int = 1

    def __post_init__(self) -> None:
        relative(self.file_path)
        if not 1 <= self.depth <= 3:
            raise ValueError("depth is 1 to 3")
