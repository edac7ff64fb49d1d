"""Path functions: names, suffixes, modules, what is indexed, what is a test."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that are indexed as they are, path parts and suffixes that are passed over.
SUFFIXES = [".java", ".gradle", ".xml", ".yml", ".yaml", ".json", ".md", ".properties", ".cfg", ".txt", ".proto", ".py", ".sh", ".bat"]
SKIPPED_PARTS = ["build", "generated", "generated-src", ".gradle", ".idea", "node_modules", "__pycache__", ".git"]
SKIPPED_SUFFIXES = [".class", ".jar", ".war", ".zip", ".tar", ".gz", ".png", ".jpg"]


def suffix(path: Column) -> Column:
    """The last dotted part of the file name with its dot, in lower case, or ''."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^./]+$", "")


def parts(path: Column) -> Column:
    return F.split(path, "/")


def module(path: Column) -> Column:
    """The path before its first `src` part, else the first part; '' for a file at the root."""
    p = parts(path)
    at = F.array_position(p, "src")
    return F.when(at > 1, F.array_join(F.slice(p, F.lit(1), (at - 1).cast("int")), "/")).when((F.size(p) > 1) & (at == 0), F.element_at(p, 1)).otherwise("")


def indexable(path: Column, suffixes: list[str] | None = None) -> Column:
    return suffix(path).isin(suffixes or SUFFIXES)


def skipped(path: Column) -> Column:
    return F.arrays_overlap(parts(path), F.array(*map(F.lit, SKIPPED_PARTS))) | suffix(path).isin(SKIPPED_SUFFIXES)


def is_test(path: Column) -> Column:
    """Some part of the path is `test` or `tests`."""
    return F.coalesce(F.arrays_overlap(parts(F.lower(path)), F.array(F.lit("test"), F.lit("tests"))), F.lit(False))


def contained(path: Column) -> Column:
    """Relative, and never above its root."""
    return ~path.startswith("/") & ~path.rlike(r"^[A-Za-z]:") & ~F.array_contains(F.split(F.regexp_replace(path, r"\\", "/"), "/"), "..")


def namespace(name: Column) -> Column:
    """A catalog name for a repository: lower case, other characters as underscores, none at the ends; `default` if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(base_name(name)), "[^a-z0-9]", "_"), "^_+|_+$", "")
    return F.when(out == "", "default").otherwise(out)


def matches(path: Column, pattern: str) -> Column:
    """A pattern with * (within a part), ** (across parts) or ? is a glob over the whole path; another is the path, its end, or a folder of it."""
    if not re.search(r"[*?]", pattern):
        inner = pattern.strip("/")
        return (path == pattern) | path.endswith("/" + inner) | path.startswith(inner + "/") | path.contains("/" + inner + "/")
    glob = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return path.rlike("^" + "".join(glob.get(p) or re.escape(p) for p in re.split(r"(\*\*/|\*\*|\*|\?)", pattern) if p) + "$")
