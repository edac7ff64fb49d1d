"""Results as text for people and tools: small, already cut results on the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row

from corpusframe.functions.text import RESPONSE_CHARS, terms_of
from corpusframe.operators.ranking import SNIPPET_CHARS, snippets_of


def truncated(text: str, limit: int = RESPONSE_CHARS) -> str:
    if len(text) <= limit:
        return text
    at = text.rfind("\n", 0, limit)
    at = at if at > limit * 0.8 else limit
    return f"{text[:at]}\n\n... ({len(text) - at} more characters not shown)"


def hit(row: Row, number: int, query: str = "") -> str:
    """A hit by the fields that it has: a symbol, a chunk, a file, or what else."""
    r = row.asDict()
    has = lambda *names: all(r.get(n) not in (None, "") for n in names)
    if has("qualified_name"):
        out = [f"[{number}] {r.get('kind', '')} {r['qualified_name']} — {r.get('signature') or r.get('name', '')}", f"    {r.get('file_path', '')}:{r.get('line_start', 0)}-{r.get('line_end', 0)}"]
        out += [f"    {label}: {str(r[name])[:100]}" for label, name in (("extends", "extends_class"), ("implements", "implements"), ("references", "type_references")) if has(name)]
    elif has("content"):
        terms = terms_of(query, highlight=True)
        shown = "\n    ".join(snippets_of(r["content"], terms)) if terms else r["content"][:SNIPPET_CHARS]
        out = [f"[{number}] {r.get('file_path', '')}:{r.get('line_start', 0)}-{r.get('line_end', 0)} ({r.get('kind', '')}: {r.get('symbol_name', '')})", f"    {shown}"]
    elif has("path"):
        out = [f"[{number}] {r['path']} ({r.get('loc', 0)} lines, module: {r.get('module', '')})"] + ([f"    classes: {r['class_names']}"] if has("class_names") else [])
    else:
        out = [f"[{number}] {json.dumps(r, default=str)[:SNIPPET_CHARS]}"]
    if "score" in r:
        out.append(f"    score: {r['score']:.3f}")
    return "\n".join(out)


def hits(df: DataFrame, query: str = "", total: int | None = None, as_json: bool = False) -> str:
    rows = df.collect()  # a page: at most the tool's limit
    if as_json:
        return json.dumps({"total_hits": len(rows) if total is None else total, "results": [r.asDict(True) for r in rows]}, default=str)
    head = f"Found {len(rows) if total is None else total} results:"
    return truncated("\n\n".join([head, *(hit(r, i, query) for i, r in enumerate(rows, 1))]))


def facets(df: DataFrame, most: int = 5) -> str:
    by: dict[str, list[Row]] = {}
    for r in df.collect():  # ten values a field at most
        by.setdefault(r.facet, []).append(r)
    return "\n".join(f"{name}: " + ", ".join(f"{r.value} ({r['count']})" for r in sorted(rows, key=lambda r: (-r["count"], r.value))[:most]) for name, rows in sorted(by.items()))


def context(df: DataFrame, path: str, start: int, end: int) -> str:
    rows = df.orderBy("line").collect()
    if not rows:
        return f"--- {path}: no such lines ---"
    return truncated("\n".join([f"--- {path} (lines {rows[0].line}-{rows[-1].line}, highlighted {start}-{end}) ---", *(r.shown for r in rows)]))


def commits(df: DataFrame) -> str:
    return truncated("\n".join(f"{r.sha[:10]} {str(r.date)[:10]} {r.author_name}: {r.subject}" for r in df.collect()) or "No commits found.")


def graph(path: str, classes: list[str], forward: DataFrame, backward: DataFrame, further: DataFrame | None = None) -> dict:
    """The dependency graph of one file as a JSON object."""
    on = [{"import": r["import"], "type": r["type"], **({"file": r.file} if r.file else {})} for r in forward.orderBy("import").collect()]
    by = [{"file": r.file, "references": r["class"], "via": r.via} for r in backward.orderBy("file").collect()]
    out = {"target": path, "classes_defined": classes, "depends_on": on, "depends_on_count": len(on), "depended_by": by, "depended_by_count": len(by), "completeness": "full"}
    if further is not None:
        out["transitive"] = [{"file": r.node, "level": r.level} for r in further.where("level > 1").orderBy("level", "node").collect()]
    return out
