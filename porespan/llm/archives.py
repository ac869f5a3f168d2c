"""Files that tasks write and read in a shared folder, through whatever filesystem its URI names."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """(filesystem, path in it) of a URI or an absolute path."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def new_file(folder: str, ending: str) -> str:
    """A name that no other attempt of the task takes; what failed attempts leave is in no manifest."""
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}{ending}"


class Bytes:
    """Random reads of one file through a window, so that small neighbouring reads cost one request."""

    def __init__(self, uri: str, window: int = 4 << 20):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        self.window, self.at, self.held = window, 0, b""

    def get(self, start: int, n: int) -> bytes:
        """The n bytes from start, fewer at the end of the file."""
        n = min(n, self.size - start)
        if n <= 0:
            return b""
        if start < self.at or start + n > self.at + len(self.held):
            self._fill(start, n)
        return self.held[start - self.at : start - self.at + n]

    def _fill(self, start: int, n: int) -> None:
        self.file.seek(start)
        self.at, self.held = start, self.file.read(max(n, self.window))

    def find(self, what: bytes, start: int) -> int:
        """The first position of ``what`` from start on, or -1."""
        while start < self.size:
            if not self.at <= start < self.at + len(self.held):
                self._fill(start, len(what))
            if (i := self.held.find(what, start - self.at)) >= 0:
                return self.at + i
            end = self.at + len(self.held)
            if end >= self.size:
                return -1
            start = max(start, end - len(what) + 1)
            self._fill(start, len(what))
        return -1

    def close(self) -> None:
        self.file.close()
