"""Git history as a data source: spark.read.format("gitlog").option("repo", ...).option("table", a key of TABLES).

`parents` has a row for each parent of a commit (one with a null parent for a root) and the commit's chain and place (see `operators.lineage`).  `changes`
holds all commits, those of side branches too, each against its first parent; in a merge, `taken_from` names the parent that has the file as the merge has
it, and is null where the file differs from all parents.  `blobs` has each text once, `versions` by commit and path.
`touched` names what has changed in the folder since the commit of the option `since`.

The repository must lie under the same path on each machine that reads it (a shared folder, or one machine).  Output is read as it comes, whole;
a command that fails, or takes longer than the option `timeout` (seconds; none by default), fails the read.
"""

from __future__ import annotations

import subprocess
import tempfile
import threading
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TABLES = {
    "commits": "sha string, short_sha string, author_name string, author_email string, date timestamp, subject string, body string",
    "changes": "sha string, path string, old_path string, status string, parent string, taken_from string, before_blob string, after_blob string",
    "parents": "sha string, ordinal int, parent string, chain long, place long",
    "files": "path string",
    "touched": "path string",
    "versions": "sha string, path string, content string",
    "blobs": "blob string, content string",
}


class GitError(RuntimeError):
    """A git command failed or took too long."""


def records(repo: str, *arguments: str, end: bytes = b"\x00", timeout: float | None = None) -> Iterator[str]:
    """A command's output in parts that end with a byte, as it comes."""
    with tempfile.TemporaryFile() as errors:
        try:
            process = subprocess.Popen(["git", "-C", repo, *arguments], stdout=subprocess.PIPE, stderr=errors)
        except OSError as e:
            raise GitError(str(e)) from e
        late = threading.Event()
        timer = threading.Timer(timeout or 0, lambda: (late.set(), process.kill()))
        if timeout:
            timer.start()
        try:
            held = b""
            while block := process.stdout.read(1 << 16):
                *whole, held = (held + block).split(end)
                yield from (part.decode("utf-8", "replace") for part in whole)
            if held:
                yield held.decode("utf-8", "replace")
        finally:
            timer.cancel()
            process.stdout.close()
            if process.poll() is None and not process.wait():
                pass
        if process.returncode:
            errors.seek(0)
            said = errors.read().decode("utf-8", "replace").strip()
            raise GitError(f"git {arguments[0]}: {'took too long' if late.is_set() else said}")


def git(repo: str, *arguments: str, timeout: float | None = None) -> str:
    """A command's whole output."""
    return "\x00".join(records(repo, *arguments, timeout=timeout))


def head(repo: str) -> str:
    """The present commit; empty in a repository without commits."""
    try:
        return git(repo, "rev-parse", "--verify", "-q", "HEAD").strip()
    except GitError:
        return ""


def branch(repo: str) -> str:
    try:
        return git(repo, "rev-parse", "--abbrev-ref", "HEAD").strip()
    except GitError:
        return ""


def exists(repo: str, sha: str) -> bool:
    """Whether a commit is still there; a rewritten or pruned history may have lost it."""
    try:
        return git(repo, "cat-file", "-t", sha).strip() == "commit"
    except GitError:
        return False


def commits(repo: str, timeout: float | None = None) -> Iterator[tuple]:
    if not head(repo):
        return
    # fields end with NUL and records with a record separator, so no text in them can shift a column
    for record in records(repo, "log", "--format=%H%x00%h%x00%an%x00%ae%x00%aI%x00%s%x00%b%x1e", end=b"\x1e", timeout=timeout):
        part = record.lstrip("\n").split("\x00")
        if len(part) == 7:
            yield (*part[:4], datetime.fromisoformat(part[4].replace("Z", "+00:00")), part[5], part[6].strip())


def parents(repo: str, timeout: float | None = None) -> Iterator[tuple]:
    """Parent edges, from the tips down.  A chain goes on to the first parent; where several do, the oldest chain does, so the line of the present commit is one."""
    if not head(repo):
        return
    going_on: dict[str, int] = {}  # commits that a child has named and that haven't come yet: as many as there are branches side by side
    chains = 0
    for index, record in enumerate(records(repo, "log", "--topo-order", "--format=%H %P", end=b"\n", timeout=timeout)):
        sha, *up = record.split()
        chain = going_on.pop(sha, None)
        if chain is None:
            chain, chains = chains, chains + 1
        if up:
            going_on[up[0]] = min(going_on.get(up[0], chain), chain)
        for k, parent in enumerate(up or [None]):
            yield sha, k, parent, chain, -index


def _merges(repo: str, timeout: float | None) -> Iterator[tuple[str, set[str]]]:
    """Each merge with the files in which it differs from all its parents."""
    sha, own = "", set()
    for token in records(repo, "log", "--topo-order", "--min-parents=2", "-c", "--name-only", "-z", "--format=%x1e%H", timeout=timeout):
        if token.lstrip("\n").startswith("\x1e"):
            if sha:
                yield sha, own
            sha, own = token.lstrip("\n")[1:].strip(), set()
        elif token:
            own.add(token)
    if sha:
        yield sha, own


def _origin(repo: str, sha: str, up: list[str]):
    """For a merge, by path: the parent that has the file as the merge has it."""
    if len(up) == 2:
        return lambda path: up[1]
    differs = [(p, set(records(repo, "diff-tree", "-r", "-z", "--name-only", p, sha))) for p in up[1:]]
    return lambda path: next((p for p, names in differs if path not in names), up[1])


def changes(repo: str, timeout: float | None = None) -> Iterator[tuple]:
    """(sha, path, old_path, status, parent, taken_from, before_blob, after_blob), against the first parent."""
    if not head(repo):
        return
    merges = _merges(repo, timeout)
    sha, up, own, origin = "", [], None, None
    tokens = records(repo, "log", "--topo-order", "--diff-merges=first-parent", "--root", "-M50%", "--raw", "-z", "--no-abbrev", "--format=%x1e%H %P", timeout=timeout)
    for token in tokens:
        token = token.lstrip("\n")
        if token.startswith("\x1e"):
            sha, *up = token[1:].split()
            own, origin = (None, None) if len(up) < 2 else (next(merges)[1], _origin(repo, sha, up))
        elif token.startswith(":"):
            _, _, before, after, status = token.split(" ")
            old = next(tokens, "") if status[0] in "RC" else None
            path = next(tokens, "")
            taken = None if own is None or path in own else origin(path)
            yield sha, path, old, status[0], up[0] if up else None, taken, *(None if set(b) == {"0"} else b for b in (before, after))


def blobs(repo: str, wanted: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(blob, whole text) by one git process; what is no file, as a submodule's commit, is left out."""
    with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as process:
        for name in wanted:
            process.stdin.write(f"{name}\n".encode())
            process.stdin.flush()
            said = process.stdout.readline().decode().split()
            if len(said) == 3:
                data = process.stdout.read(int(said[2]))
                process.stdout.read(1)
                if said[1] == "blob":
                    yield name, data.decode("utf-8", "replace")
        process.stdin.close()


def contents(repo: str, wanted: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(sha, path, whole text) of the versions that are files, by one git process."""
    with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as process:
        for sha, path in wanted:
            if "\n" in path:  # a request is one line
                yield sha, path, git(repo, "show", f"{sha}:{path}")
                continue
            process.stdin.write(f"{sha}:{path}\n".encode("utf-8", "surrogateescape"))
            process.stdin.flush()
            said = process.stdout.readline().decode("utf-8", "replace").rsplit(" ", 2)
            if len(said) == 3 and said[2].strip().isdigit():
                data = process.stdout.read(int(said[2]))
                process.stdout.read(1)
                if said[1] == "blob":
                    yield sha, path, data.decode("utf-8", "replace")
            elif not said[-1].strip() == "missing":
                raise GitError(f"git cat-file: {' '.join(said).strip()}")
        process.stdin.close()


def files(repo: str, timeout: float | None = None) -> Iterator[str]:
    return (p for p in records(repo, "ls-files", "-z", timeout=timeout) if p)


def touched(repo: str, since: str, timeout: float | None = None) -> Iterator[str]:
    """What differs between a commit and the folder as it is: committed since, staged or not, and files that are not tracked yet."""
    yield from (p for p in records(repo, "diff", "--name-only", "--no-renames", "--relative", "-z", since, timeout=timeout) if p)
    yield from (p for p in records(repo, "ls-files", "-o", "--exclude-standard", "-z", timeout=timeout) if p)


class _Slice(InputPartition):
    def __init__(self, index: int, count: int):
        super().__init__(index)
        self.index, self.count = index, count


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repo, self.table, self.count = options["repo"], options.get("table", "commits"), int(options.get("partitions", "4"))
        self.timeout = float(options["timeout"]) if "timeout" in options else None
        self.since = options.get("since", "HEAD")

    def partitions(self) -> list[InputPartition]:
        return [_Slice(k, self.count) for k in range(self.count)] if self.table in ("versions", "blobs") else [_Slice(0, 1)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        if self.table == "commits":
            yield from commits(self.repo, self.timeout)
        elif self.table == "changes":
            yield from changes(self.repo, self.timeout)
        elif self.table == "parents":
            yield from parents(self.repo, self.timeout)
        elif self.table == "files":
            yield from ((p,) for p in files(self.repo, self.timeout))
        elif self.table == "touched":
            yield from ((p,) for p in touched(self.repo, self.since, self.timeout))
        elif self.table == "blobs":  # each partition walks the log, which is names only, and reads its share of the texts, each once
            yield from blobs(self.repo, self.share(partition))
        else:
            own = ((sha, path) for k, (sha, path, _, status, *_) in enumerate(changes(self.repo, self.timeout)) if k % partition.count == partition.index and status != "D")
            yield from contents(self.repo, own)

    def share(self, partition: _Slice) -> Iterator[str]:
        seen: set[str] = set()
        for *_, before, after in changes(self.repo, self.timeout):
            for name in (before, after):
                if name and int(name[:8], 16) % partition.count == partition.index and name not in seen:
                    seen.add(name)
                    yield name


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        table = self.options.get("table", "commits")
        if table not in TABLES:
            raise ValueError(f"table is one of {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema) -> DataSourceReader:
        return GitReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSource)
