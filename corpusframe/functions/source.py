"""Functions over source texts: packages, imports, visibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"[\p{L}_$][\p{L}\p{N}_$]*"
JAVA_PACKAGE = rf"(?m)^[ \t]*package[ \t]+({_WORD}(?:\.{_WORD})*)[ \t]*;"
JAVA_IMPORT = rf"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?({_WORD}(?:\.{_WORD})*(?:\.\*)?)[ \t]*;"


def java_package(text: Column) -> Column:
    return F.regexp_extract(text, JAVA_PACKAGE, 1)


def java_imports(text: Column) -> Column:
    """Imported names in order, static members and wildcards as they stand."""
    return F.regexp_extract_all(text, F.lit(JAVA_IMPORT), F.lit(1))


def import_prefixes(imports: Column, depth: int = 3) -> Column:
    """The distinct first segments of the imports, sorted."""
    return F.array_sort(F.array_distinct(F.transform(imports, lambda i: F.array_join(F.slice(F.split(i, r"\."), 1, depth), "."))))


def java_visibility(modifiers: Column) -> Column:
    out = F
    for name in ("public", "protected", "private"):
        out = out.when(modifiers.contains(name), name)
    return out.otherwise("package-private")


def visibility(language: Column, name: Column, line: Column) -> Column:
    """From the first line's keywords; Python by underscores, Go by capitals; else public."""
    python = F.when(name.startswith("__") & ~name.endswith("__"), "private").when(name.startswith("_") & ~name.startswith("__"), "protected").otherwise("public")
    go = F.when(F.substring(name, 1, 1).rlike(r"\p{Lu}"), "public").otherwise("private")
    keyword = F
    for word in ("public", "private", "protected", "internal"):
        keyword = keyword.when(line.rlike(rf"\b{word}\b"), word)
    return F.when(language == "python", python).when(language == "go", go).otherwise(keyword.otherwise("public"))
