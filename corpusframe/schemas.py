"""The three tables of an indexed repository, and the roles of their fields as metadata."""

from __future__ import annotations

from pyspark.sql import types as T


def _field(name: str, kind: T.DataType, *roles: str) -> T.StructField:
    return T.StructField(name, kind, True, {r: True for r in roles})


_S, _I = T.StringType(), T.IntegerType()
SYMBOLS = T.StructType(
    [
        _field("id", _S, "key"),
        _field("name", _S, "searchable", "suggestable"),
        _field("qualified_name", _S, "searchable", "suggestable"),
        _field("signature", _S, "searchable"),
        _field("kind", _S, "filterable", "facetable"),
        _field("visibility", _S, "filterable", "facetable"),
        _field("file_path", _S, "searchable", "filterable"),
        _field("package", _S, "searchable", "filterable", "facetable"),
        _field("module", _S, "filterable", "facetable"),
        _field("parent_class", _S, "filterable"),
        _field("implements", _S, "searchable"),
        _field("extends_class", _S, "searchable"),
        _field("annotations", _S, "searchable"),
        _field("line_start", _I),
        _field("line_end", _I),
        _field("body_preview", _S, "searchable"),
        _field("imports", _S, "searchable"),
        _field("type_references", _S, "searchable"),
    ]
)
CHUNKS = T.StructType(
    [
        _field("id", _S, "key"),
        _field("content", _S, "searchable"),
        _field("file_path", _S, "searchable", "filterable"),
        _field("symbol_name", _S, "searchable", "suggestable"),
        _field("kind", _S, "filterable", "facetable"),
        _field("module", _S, "filterable", "facetable"),
        _field("language", _S, "filterable", "facetable"),
        _field("enclosing_class", _S, "searchable", "filterable"),
        _field("enclosing_method", _S, "filterable"),
        _field("line_start", _I),
        _field("line_end", _I),
        _field("token_count", _I),
        _field("extension", _S, "filterable"),
    ]
)
FILES = T.StructType(
    [
        _field("id", _S, "key"),
        _field("path", _S, "searchable", "filterable"),
        _field("filename", _S, "searchable", "suggestable"),
        _field("extension", _S, "filterable", "facetable"),
        _field("module", _S, "searchable", "filterable", "facetable"),
        _field("package", _S, "searchable"),
        _field("class_names", _S, "searchable"),
        _field("imports_summary", _S, "searchable"),
        _field("imports_full", _S, "searchable"),
        _field("loc", _I),
        _field("last_commit_sha", _S),
    ]
)
#: With vectors, chunks have one more column.
VECTOR_DIMENSION = 384
CHUNKS_WITH_VECTORS = T.StructType([*CHUNKS.fields, T.StructField("embedding", T.ArrayType(T.FloatType()), True, {"dimension": VECTOR_DIMENSION})])
TABLES = {"symbols": SYMBOLS, "chunks": CHUNKS, "files": FILES}


def fields_with(schema: T.StructType, role: str) -> list[str]:
    return [f.name for f in schema.fields if f.metadata.get(role)]
