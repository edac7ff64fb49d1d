"""Code intelligence as joins over the symbols and files tables: implementations, references, imports, dependencies.

Answers are complete: predicates run over whole tables instead of the best text hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.functions.text import list_of
from corpusframe.operators import trigrams
from corpusframe.operators.collections import first_per


def _last(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def _named(names: Column, target: str) -> Column:
    t = target.strip().lower()
    return F.exists(names, lambda n: (F.lower(n) == t) | (F.lower(_last(n)) == t))


def find_implementations(symbols: DataFrame, target: str) -> DataFrame:
    """Symbols that implement or extend a type, by its name or the last part of a qualified one; implementing goes first."""
    how = F.when(_named(list_of(F.col("implements")), target), "implements").when(_named(list_of(F.col("extends_class")), target), "extends")
    return symbols.withColumn("relationship", how).where(F.col("relationship").isNotNull())


def reference_index(symbols: DataFrame, key: str = "id") -> DataFrame:
    """Trigrams of what symbols refer to and import, for `find_references`."""
    return trigrams.postings(symbols.select(key, F.concat_ws("\n", "type_references", "imports").alias("names")), key, "names")


def find_references(symbols: DataFrame, target: str, index: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Symbols that name a type among their type references, or else have it in an import; not the symbols of that name.  With an index only the rows
    that have the name's trigrams are looked at."""
    t = target.strip()
    if index is not None and (keys := trigrams.candidates(index, key, trigrams.needed_by_text(t))) is not None:
        symbols = symbols.join(keys, key, "left_semi")
    by_type = F.array_contains(list_of(F.col("type_references")), t)
    by_import = F.exists(list_of(F.col("imports")), lambda i: i.contains(t))
    how = F.when(by_type, "references").when(by_import, "imports")
    out = symbols.where(F.coalesce(F.col("name"), F.lit("")) != t).withColumn("relationship", how).where(F.col("relationship").isNotNull())
    return out.dropDuplicates(["file_path", "qualified_name"])


def classify_imports(imports: DataFrame, symbols: DataFrame, key: str = "import") -> DataFrame:
    """Each import of a file as EXTENDS, IMPLEMENTS or ANNOTATION, by the first of the file's symbols that uses its simple name so, or IMPORT."""
    simple = _last(F.col(key))

    def uses(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit("")).contains(simple)

    kind = F.when(uses("extends_class"), "EXTENDS").when(uses("implements"), "IMPLEMENTS").when(uses("annotations"), "ANNOTATION")
    own = symbols.select("file_path", "line_start", "extends_class", "implements", "annotations")
    both = imports.join(own, "file_path", "left").withColumn("kind", kind)
    return both.groupBy("file_path", key).agg(F.coalesce(F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("line_start"))), F.lit("IMPORT")).alias("type"))


def resolve_imports(imports: DataFrame, files: DataFrame, key: str = "import") -> DataFrame:
    """Adds `file`: that whose package and class the import names, or, for an inner class, names before its last part.

    Classes are hashed in parts: a table of all of them, broadcast as estimates of derived names are low, would be in every task's memory, and many files
    import the same class, whose rows a sort would hold in one task."""
    parts = F.split(F.col(key), r"\.")
    n = F.size(parts)

    def joined(upto: Column) -> Column:
        return F.array_join(F.slice(parts, F.lit(1), F.greatest(upto, F.lit(0))), ".")

    usable = (F.col(key) != "") & ~F.col(key).endswith("*") & (n >= 2)
    wanted = imports.withColumns({"__p1": F.when(usable, joined(n - 1)), "__c1": F.when(usable, F.get(parts, n - 1)), "__p2": F.when(usable & (n >= 3), joined(n - 2)), "__c2": F.when(usable & (n >= 3), F.get(parts, n - 2))})
    classes = files.select(F.col("package").alias("p"), F.explode(list_of(F.col("class_names"))).alias("c"), F.col("path").alias("f")).groupBy("p", "c").agg(F.min("f").alias("f")).hint("shuffle_hash")
    one, two = classes.alias("one"), classes.alias("two")
    out = wanted.join(one, (F.col("__p1") == F.col("one.p")) & (F.col("__c1") == F.col("one.c")), "left").join(two, (F.col("__p2") == F.col("two.p")) & (F.col("__c2") == F.col("two.c")), "left")
    return out.select(*imports.columns, F.coalesce("one.f", "two.f").alias("file"))


def find_file(files: DataFrame, path: str) -> DataFrame:
    """One file: that of the path, or one whose path ends with it, or holds it."""
    rank = F.when(F.col("path") == path, 0).when(F.col("path").endswith("/" + path), 1).when(F.col("path").contains(path), 2)
    return files.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "path").limit(1).drop("rank")


def reverse_dependencies(symbols: DataFrame, files: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, file, class, via): for files to look at (`path`), other files with symbols that reference one of their classes; one row for each
    pair of files."""
    classes = files.join(targets.select("path").distinct(), "path", "left_semi").select(F.col("path").alias("target"), F.explode(list_of(F.col("class_names"))).alias("class"))
    exact = symbols.select(F.col("file_path").alias("file"), F.col("name"), F.explode(list_of(F.col("type_references"))).alias("class"))
    by_type = classes.join(exact, "class").where(F.col("name") != F.col("class")).select("target", "file", "class", F.lit("references").alias("via"))
    # an import holds the class as one of its parts: an equality instead of a search in each import
    parts = symbols.select(F.col("file_path").alias("file"), "name", F.explode(list_of(F.col("imports"))).alias("i")).select("file", "name", F.explode(F.array_distinct(F.split("i", r"\."))).alias("class"))
    by_import = classes.join(parts, "class").where(F.col("name") != F.col("class")).select("target", "file", "class", F.lit("imports").alias("via"))
    both = by_type.union(by_import).where(F.col("target") != F.col("file")).distinct()
    return first_per(both, ["target", "file"], F.desc("via"), "class")


def transitive(edges: DataFrame, start: DataFrame, depth: int = 3, most: int | None = 10) -> DataFrame:
    """(node, level): what is reached over (source, target) edges in at most `depth` steps; `most` nodes a level are followed (None: all).

    Each level is one join of the frontier, of which the nodes already reached are taken away."""
    if not 1 <= depth <= 3:
        raise ValueError("depth is 1 to 3")
    frontier = start.select(F.col(start.columns[0]).alias("node")).distinct()
    reached = frontier.withColumn("level", F.lit(0))
    for level in range(1, depth + 1):
        step = edges.join(frontier, F.col("source") == F.col("node")).select(F.col("target").alias("node")).distinct()
        fresh = step.join(reached.select("node"), "node", "left_anti")
        reached = reached.union(fresh.withColumn("level", F.lit(level)))
        frontier = fresh.orderBy("node").limit(most) if most else fresh
    return reached


def dependency_graph(symbols: DataFrame, files: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """What a file depends on (import, type, file), and what depends on it (file, class, via)."""
    target = find_file(files, path)
    imports = target.select(F.col("path").alias("file_path"), F.explode(list_of(F.coalesce("imports_full", "imports_summary"))).alias("import")).distinct()
    kinds = classify_imports(imports, symbols)
    return resolve_imports(kinds.select("file_path", "import", "type"), files), reverse_dependencies(symbols, files, target).select("file", "class", "via")
