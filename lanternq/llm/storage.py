"""Files in the shared folder, written and read inside tasks."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system that tasks can use (local, HDFS, S3, ...) and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[6:].lstrip("/")
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


class AtomicFile:
    """Appears under its name only when complete.

    A task that is run again, or twice at once, writes a file of its own and
    moves it over the same name, so readers see one whole copy.
    """

    def __init__(self, uri: str):
        self.fs, self.path = opened(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        self.out.write(data)
        self.size += len(data)
        return len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def reader(uri: str):
    """A seekable binary file."""
    fs, path = opened(uri)
    return fs.open_input_file(path)
