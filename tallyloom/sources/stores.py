"""Seekable files in stores, opened inside tasks: only the ranges that are asked for are read."""

from __future__ import annotations

import io
from urllib.parse import unquote

from pyarrow import fs

# Schemes of Spark's connectors that go by another name in Arrow.
_ALIASES = {"s3a": "s3", "s3n": "s3"}


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it. A store that Arrow does not know is an error."""
    scheme, mark, rest = path.partition(":")
    if not mark or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + unquote(rest).lstrip("/")
    return fs.FileSystem.from_uri(f"{_ALIASES.get(scheme, scheme)}:{rest}")


def reachable(path: str) -> bool:
    """Whether tasks can open files of this store by range; others are read by Spark, and whole."""
    try:
        located(path)
    except Exception:  # an unknown scheme, or a store whose library is not installed
        return False
    return True


class Ranged(io.RawIOBase):
    """A read-only seekable file that counts the bytes it reads."""

    def __init__(self, path: str):
        store, inside = located(path)
        self.file, self.fetched = store.open_input_file(inside), 0
        self.length, self.at = self.file.size(), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.length}[whence]
        return self.at

    def read(self, size: int = -1) -> bytes:
        size = self.length - self.at if size is None or size < 0 else min(size, self.length - self.at)
        out = self.file.read_at(size, self.at) if size > 0 else b""
        self.at += len(out)
        self.fetched += len(out)
        return out

    def readinto(self, into) -> int:
        out = self.read(len(into))
        into[: len(out)] = out
        return len(out)

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()
