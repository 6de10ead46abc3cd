"""File systems of paths, for code that reads or writes files in tasks."""

from __future__ import annotations

import pyarrow.fs


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pyarrow.fs.LocalFileSystem(), path)
