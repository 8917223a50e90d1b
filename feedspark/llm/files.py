"""Binary files that tasks write to and read from the shared folder, by any file system that Arrow knows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark import TaskContext


@contextmanager
def written(uri: str) -> Iterator:
    """An output stream; the file appears under its name only when it is whole. A task that runs again, or twice
    at once, replaces the file by an equal one."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    context = TaskContext.get()
    draft = f"{path}.{context.taskAttemptId() if context else 0}"
    with system.open_output_stream(draft) as out:
        yield out
    system.move(draft, path)


class Ranges:
    """Byte ranges of files, with the last file kept open."""

    def __init__(self):
        self.uri, self.file, self.size = None, None, 0

    def read(self, uri: str, offset: int, length: int) -> bytes:
        """The bytes of a range; fewer where the file ends before, none where there is no file."""
        if uri != self.uri:
            self.close()
            system, path = fs.FileSystem.from_uri(uri)
            info = system.get_file_info(path)
            self.uri, self.size = uri, info.size if info.is_file else 0
            self.file = system.open_input_file(path) if info.is_file else None
        length = min(length, self.size - offset)
        return self.file.read_at(length, offset) if self.file and length > 0 else b""

    def close(self) -> None:
        if self.file:
            self.file.close()
