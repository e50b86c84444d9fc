"""File systems for the Data Sources, whose Python tasks read and write files themselves."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that pyarrow knows, and the path on it."""
    where, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where, root.rstrip("/")
