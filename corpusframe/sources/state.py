"""Index state and the lock that keeps two index runs apart.  Both are small driver-side files."""

from __future__ import annotations

import json
import os
import tempfile
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


#: Of the files that could not be parsed the state names so many; the collection `failures` has them all, and total_failures counts them.
MOST_NAMED = 1000


@dataclass
class IndexState:
    last_commit: str = ""
    last_branch: str = ""
    last_indexed_at: str = ""
    use_embeddings: bool = False
    total_symbols: int = 0
    total_chunks: int = 0
    total_files: int = 0
    total_failures: int = 0
    parse_failures: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str | Path) -> IndexState:
        """Unknown keys are passed over; a missing or broken file is an empty state."""
        try:
            data = json.loads(Path(path).read_text("utf-8"))
            kinds = {f.name: type(getattr(cls(), f.name)) for f in fields(cls)}
            return cls(**{k: v for k, v in data.items() if k in kinds and isinstance(v, kinds[k])})
        except (OSError, ValueError, AttributeError):
            return cls()

    def save(self, path: str | Path) -> None:
        """Through a temporary file beside it, so that a reader never sees half of it."""
        target = Path(path)
        target.parent.mkdir(parents=True, exist_ok=True)
        handle, name = tempfile.mkstemp(dir=target.parent)
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f)
        os.replace(name, target)


class Locked(RuntimeError):
    """Another run holds the lock."""


@contextmanager
def lock(path: str | Path):
    """An exclusive lock by a file with the process's number; that of a process that has ended is taken over."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    for _ in range(2):
        try:
            handle = os.open(target, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            try:
                os.kill(int(target.read_text()), 0)
            except (ValueError, ProcessLookupError, FileNotFoundError):
                target.unlink(missing_ok=True)
                continue
            except PermissionError:
                pass
            raise Locked(str(target)) from None
    else:
        raise Locked(str(target))
    try:
        os.write(handle, str(os.getpid()).encode())
        os.close(handle)
        yield target
    finally:
        target.unlink(missing_ok=True)
