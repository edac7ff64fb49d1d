"""The tools over one repository's collections: each returns a DataFrame; `render` makes text of it."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.functions import paths
from corpusframe.functions.text import list_of, terms_of
from corpusframe.operators import codeintel, embeddings, extract, filters, history, incremental, postings, ranking, scoring, windows
from corpusframe.operators.filters import Term
from corpusframe.plans import validation as v
from corpusframe.schemas import TABLES, fields_with
from corpusframe.sources import files as source_files
from corpusframe.sources import git
from corpusframe.sources import state as index_state
from corpusframe.sources.catalog import Catalog


class Engine:
    """Search, code intelligence and history over the collections of a catalog."""

    def __init__(self, spark: SparkSession, catalog: Catalog, commits: DataFrame | None = None, changes: DataFrame | None = None, versions: DataFrame | None = None, folder: str | None = None, repo: str | None = None, parents: DataFrame | None = None):
        """`folder`, on the driver's machine, holds the index's state and the lock that keeps two runs apart; `repo` is the git repository whose
        commits the state names.  `versions` are texts by (sha, path) or by blob; `parents` are placed commits, without which history goes by date."""
        self.spark, self.catalog = spark, catalog
        self.commits, self.changes, self.versions = commits, changes, versions
        self.folder, self.repo = folder, repo
        self.placed = None if parents is None else parents.where("ordinal = 0").drop("ordinal") if "ordinal" in parents.columns else parents

    # --- indexing

    def reindex(self, sources: DataFrame, mode: str = "incremental", encoder=None) -> DataFrame:
        """Indexes (path, mtime, size, content) rows; incremental touches only files that differ from the last run.  Returns the changes.

        Where the state names a commit that the repository no longer has, or vectors are wanted that the index lacks, the run is a full one.
        While another run is on, `state.Locked` is raised."""
        return self._run(lambda mode, _: self._indexed(sources, mode, encoder), mode, encoder)

    def reindex_folder(self, root: str, mode: str = "incremental", encoder=None, tracked: DataFrame | None = None, suffixes: list[str] | None = None) -> DataFrame:
        """As `reindex`, from a folder: it is listed, and what the listing or the repository says may have changed is read, no other content."""
        return self._run(lambda mode, since: self._folder_indexed(root, mode, encoder, tracked, suffixes, since), mode, encoder)

    def _run(self, work, mode: str, encoder) -> DataFrame:
        v.one_of(mode, v.MODES)
        if self.folder is None:
            return work(mode, "")
        with index_state.lock(f"{self.folder}/index.lock"):
            known = index_state.IndexState.load(self.state_path)
            if (self.repo and known.last_commit and not git.exists(self.repo, known.last_commit)) or known.use_embeddings != (encoder is not None):
                mode = "full"
            commit, branch = (git.head(self.repo), git.branch(self.repo)) if self.repo else ("", "")  # as it was when the run began
            changes = work(mode, known.last_commit)
            counts = {name: self.catalog.open(name).count() for name in TABLES}
            failures = self.catalog.open("failures")
            failed = [r.path for r in failures.select("path").orderBy("path").limit(index_state.MOST_NAMED).collect()]
            moment = datetime.now(UTC).isoformat(timespec="seconds")
            index_state.IndexState(commit, branch, moment, encoder is not None, counts["symbols"], counts["chunks"], counts["files"], failures.count(), failed).save(self.state_path)
        return changes

    @property
    def state_path(self) -> str:
        return f"{self.folder}/state.json"

    def trigger(self, sources: DataFrame | str, mode: str = "incremental") -> DataFrame | None:
        """Reindexes rows or a folder unless another run is on; then nothing is done and None comes back."""
        try:
            return self.reindex_folder(sources, mode) if isinstance(sources, str) else self.reindex(sources, mode)
        except index_state.Locked:
            return None

    def _before(self, mode: str, schema) -> DataFrame:
        there = mode == "incremental" and not self.catalog.missing(["snapshot"])
        return self.catalog.open("snapshot") if there else self.spark.createDataFrame([], schema)

    def _indexed(self, sources: DataFrame, mode: str, encoder) -> DataFrame:
        after = source_files.snapshot(sources)
        self.catalog.write("changes", incremental.snapshot_diff(self._before(mode, after.schema), after, marks=("content_hash",)))
        changes = self.catalog.open("changes")
        self._replace(changes, sources.join(changes.where("status != 'D'").select("path"), "path", "left_semi"), mode, encoder)
        self.catalog.write("snapshot", after)
        return changes

    def _folder_indexed(self, root: str, mode: str, encoder, tracked: DataFrame | None, suffixes: list[str] | None, since: str) -> DataFrame:
        listed = source_files.listed(self.spark, root, tracked, suffixes)
        before = self._before(mode, "path string, mtime timestamp, size long, content_hash string")
        said = None
        if self.repo and since and mode == "incremental":
            git.register(self.spark)
            said = self.spark.read.format("gitlog").option("repo", root).option("table", "touched").option("since", since).load()
        self.catalog.write("candidates", incremental.candidates(before, listed, said))
        found = self.catalog.open("candidates")
        wanted = lambda changes: listed.join(changes.where("status != 'D'").select("path"), "path", "left_semi")
        self.catalog.write("marks", source_files.texts(self.spark, root, wanted(found)).drop("content"))
        read = self.catalog.open("marks")
        self.catalog.write("changes", incremental.settled(found, before, read))
        changes = self.catalog.open("changes")
        self._replace(changes, source_files.texts(self.spark, root, wanted(changes)).where("content IS NOT NULL").drop("content_hash"), mode, encoder)
        self.catalog.write("snapshot", incremental.carried_on(before, found, read))
        return changes

    def _replace(self, changes: DataFrame, sources: DataFrame, mode: str, encoder) -> None:
        """Takes the rows of changed files out of all tables and puts those of their new texts in."""
        fresh = extract.parsed(sources).persist()
        chunks = extract.chunks_of(fresh)
        if encoder is not None:
            chunks = chunks.withColumn("embedding", embeddings.embedded(F.col("content"), encoder))
        tables = {"symbols": ("file_path", extract.symbols_of(fresh)), "chunks": ("file_path", chunks), "files": ("path", extract.files_of(fresh)), "failures": ("path", fresh.where("error != ''").select("path", "error"))}
        for name, (column, rows) in tables.items():
            self._put(name, rows, changes, column, mode, [])
            if name in TABLES:
                rows = self.catalog.open(name).join(changes.select(F.col("path").alias(column)), column, "left_semi")
                searchable = fields_with(TABLES[name], "searchable")
                self._put(f"{name}_terms", postings.postings(rows, "id", searchable, [column]), changes, column, mode, ["term"])
                self._put(f"{name}_lengths", postings.lengths(rows, "id", searchable, [column]), changes, column, mode, [])
        fresh.unpersist()

    def _put(self, name: str, rows: DataFrame, changes: DataFrame, column: str, mode: str, sort: list[str]) -> None:
        if mode == "full":
            self.catalog.write_buckets(name, rows, column, sort)
        else:
            self.catalog.replace(name, rows, changes.select(F.col("path").alias(column)), column, sort)

    def _ranked(self, name: str, query: str, keep: Column) -> DataFrame:
        """The rows that pass a test and match a query, with their BM25 score: by the term index where there is one."""
        rows, searchable = self.catalog.open(name), fields_with(TABLES[name], "searchable")
        if self.catalog.missing([f"{name}_terms", f"{name}_lengths"]) or not terms_of(query):
            return scoring.bm25(rows, query, searchable, keep)
        return rows.where(keep).join(postings.bm25(self.catalog.open(f"{name}_terms"), self.catalog.open(f"{name}_lengths"), query, "id", searchable), "id")

    def index_status(self) -> DataFrame:
        return self.catalog.status()

    # --- search

    def search_symbols(self, query: str, strict: bool = False, **more) -> tuple[DataFrame, DataFrame]:
        """The best symbols, and facets over all matches.  Hints are added to the query; strict makes them predicates."""
        a = v.SymbolSearch(query, **more)
        keep = filters.conjunction([Term("kind", k) for k in a.kinds] + [Term("visibility", x) for x in a.visibilities] + ([Term("module", a.module)] if a.module else []))
        if a.file_pattern:
            keep = keep & paths.matches(F.col("file_path"), a.file_pattern)
        hints = [x for x in (a.package_prefix, a.extends_or_implements, a.has_annotation) if x]
        if strict:
            if a.package_prefix:
                keep = keep & F.col("package").startswith(a.package_prefix)
            if a.extends_or_implements:
                keep = keep & (F.array_contains(list_of(F.col("extends_class")), a.extends_or_implements) | F.array_contains(list_of(F.col("implements")), a.extends_or_implements))
            if a.has_annotation:
                keep = keep & F.array_contains(list_of(F.col("annotations")), a.has_annotation)
            hints = []
        matches = self._ranked("symbols", " ".join([query, *hints]), keep)
        best = ranking.rerank(scoring.top(matches, a.limit, "id"), query, "id", ["name", "qualified_name"], "file_path", "kind", "parent_class")
        return best, ranking.facets(matches, ["kind", "visibility", "package"])

    def search_code(self, query: str, vector: list[float] | None = None, pushdown: bool = False, as_of: str | None = None, **more) -> DataFrame:
        """The best chunks; with a vector, text and vector hits are joined.  Tests go after the cut to the limit; pushdown drops them before."""
        a = v.CodeSearch(query, **more)
        rows = self.catalog.open("chunks")
        keep = filters.conjunction([Term("module", a.module)] if a.module else [])
        if a.file_types:
            keep = keep & (F.col("language").isin(*a.file_types) | F.col("extension").isin(*a.file_types))
        if a.enclosing_class:
            keep = keep & (F.col("enclosing_class") == a.enclosing_class)
        if a.exclude_tests and pushdown:
            keep = keep & ~paths.is_test(F.col("file_path"))
        hits = scoring.top(self._ranked("chunks", query, keep), a.limit, "id")
        if vector is not None and "embedding" in rows.columns:
            near = scoring.knn(rows.where(keep), "embedding", vector, a.limit, "id")
            both = scoring.top(scoring.hybrid(hits.select("id", "score"), near.select("id", "score"), "id"), a.limit, "id")
            hits = rows.join(both.select("id", "score"), "id")
        return ranking.rerank(hits, query, "id", ["symbol_name"], "file_path", "kind", "enclosing_class", exclude_tests=a.exclude_tests)

    def search_files(self, query: str, **more) -> DataFrame:
        a = v.FileSearch(query, **more)
        keep = filters.conjunction(([Term("extension", a.extension.lstrip("."))] if a.extension else []) + ([Term("module", a.module)] if a.module else []))
        return scoring.top(self._ranked("files", query, keep), a.limit, "id")

    def get_context(self, sources: DataFrame, file_path: str, line_start: int, line_end: int, radius: int = 10) -> DataFrame:
        a = v.Context(file_path, line_start, line_end, radius)
        return windows.context(sources.where(F.col("path") == a.file_path), "path", "content", a.line_start, a.line_end, a.radius)

    def autocomplete(self, prefix: str, scope: str = "symbols", limit: int = 10, fuzzy: bool = False) -> DataFrame:
        table = {"symbols": "symbols", "files": "files", "code": "chunks"}[v.one_of(scope, v.SCOPES)]
        return ranking.complete(self.catalog.open(table), fields_with(TABLES[table], "suggestable"), v.query(prefix), v.limit(limit), fuzzy)

    # --- code intelligence

    def find_implementations(self, symbol_name: str) -> DataFrame:
        return codeintel.find_implementations(self.catalog.open("symbols"), v.query(symbol_name))

    def find_references(self, symbol_name: str) -> DataFrame:
        return codeintel.find_references(self.catalog.open("symbols"), v.query(symbol_name))

    def dependency_graph(self, file_path: str, depth: int = 1, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What the file depends on, what depends on it, and what depends on that, level by level; `most` bounds the files that are followed on a
        level, none by default."""
        a = v.DependencyGraph(file_path, depth)
        symbols, files = self.catalog.open("symbols"), self.catalog.open("files")
        forward, backward = codeintel.dependency_graph(symbols, files, a.file_path)
        edges = codeintel.reverse_dependencies(symbols, files, files).select(F.col("target").alias("source"), F.col("file").alias("target"))
        start = codeintel.find_file(files, a.file_path).select(F.col("path").alias("node"))
        return forward, backward, codeintel.transitive(edges, start, a.depth, most)

    # --- history

    def search_commits(self, as_of: datetime | None = None, **more) -> DataFrame:
        a = v.CommitSearch(**more)
        day = lambda s: history.moment(s, as_of or datetime.now()) if s else None
        return history.search_commits(self.commits, None if self.changes is None else history.own(self.changes), a.query, a.author, day(a.since), day(a.until), a.file_path, a.limit)

    def commit_diff(self, sha: str, context_lines: int = 3) -> DataFrame:
        return history.commit_diff(self.commits, self.changes, v.sha(sha), self.versions, context_lines, self.placed)

    def file_history(self, file_path: str, limit: int = 15, follow: bool = True, include_diff: bool = False, context_lines: int = 3) -> DataFrame:
        if include_diff and self.versions is None:
            raise ValueError("diffs need the table of versions")
        return history.file_history(self.commits, self.changes, v.relative(file_path), v.limit(limit, v.MAX_HISTORY), follow, self.versions if include_diff else None, context_lines, self.placed)

    @staticmethod
    def get_started() -> str:
        return (
            "Index a repository with reindex(), then: search_symbols for names, search_code for texts, search_files for paths, get_context for lines, "
            "autocomplete for beginnings, find_implementations, find_references and dependency_graph for structure, search_commits, commit_diff and file_history for changes."
        )
