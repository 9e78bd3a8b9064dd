"""Whole files in the shared folder, written and read by tasks.

Paths are URIs as Spark uses them (file:, hdfs:, s3:, gs:); pyarrow's file
systems open them.  A file appears under its name only when complete, so a
retried or doubled task leaves the same files.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path on it); Hadoop's short form ``file:/x`` is meant too."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class Writer:
    """``with Writer(path) as f: f.write(...)``: the file takes its name when
    the block ends without an error."""

    def __init__(self, path: str):
        self.fs, self.path = at(path)
        self.part = f"{self.path}.{uuid.uuid4().hex[:8]}.part"

    def __enter__(self):
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.file = self.fs.open_output_stream(self.part)
        return self.file

    def __exit__(self, kind, *_):
        self.file.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)


def open_file(path: str):
    """A file for random access."""
    system, p = at(path)
    return system.open_input_file(p)


def files(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder, by name."""
    system, p = at(path)
    found = system.get_file_info(fs.FileSelector(p, allow_not_found=True))
    return sorted((i.path, i.size) for i in found if i.is_file and i.path.endswith(suffix))


def delete(path: str) -> None:
    """A folder and all that is in it, if it is there."""
    system, p = at(path)
    if system.get_file_info(p).type != fs.FileType.NotFound:
        system.delete_dir(p)
