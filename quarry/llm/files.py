"""Files in the shared folder, from Python workers, by any URI that pyarrow opens (file, hdfs, s3, gs)."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri[5:].replace("///", "/").replace("//", "/")
    return pafs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def written(uri: str) -> Iterator:
    """A stream to a file that appears under its name only when it is whole; a task run twice leaves one file."""
    fs, path = _open(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        yield out
    fs.move(part, path)


@contextlib.contextmanager
def reading(uri: str) -> Iterator:
    fs, path = _open(uri)
    with fs.open_input_stream(path, compression=None) as f:
        yield f


@contextlib.contextmanager
def reading_at(uri: str) -> Iterator:
    """Like reading, for files read by place."""
    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        yield f
