"""Files in the shared folder, written and read by tasks through pyarrow's file systems."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        raise ValueError(f"{uri} names no file system; qualify it first")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def create(uri: str):
    """A stream to a new file, moved to its final name when complete: a task that dies leaves no half file there."""
    system, path = resolve(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with system.open_output_stream(part, compression=None) as out:
        yield out
    system.move(part, path)


def opened(uri: str):
    system, path = resolve(uri)
    return system.open_input_stream(path, compression=None)


def opened_at(uri: str):
    system, path = resolve(uri)
    return system.open_input_file(path)
