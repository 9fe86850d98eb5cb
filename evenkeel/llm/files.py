"""Files in a shared folder, written and read from tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, S3 and others that pyarrow knows)."""
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


class Whole:
    """A file that appears under its name only once it is complete; a repeated task replaces it."""

    def __init__(self, uri: str):
        self.fs, self.path = place(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part, compression=None)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is not None:
            self.fs.delete_file(self.part)
            return
        if self.fs.type_name != "local" and self.fs.get_file_info(self.path).is_file:
            self.fs.delete_file(self.path)
        self.fs.move(self.part, self.path)
