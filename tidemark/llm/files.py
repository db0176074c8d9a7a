"""Whole files in the shared folder, written by executors and found by every machine.

A URI of the scheme file (or none) is opened directly, since spark.checkpoint.dir is mounted everywhere; any other
scheme goes through pyarrow's file systems. A file is written under a name of its own attempt and renamed, so a lost
executor leaves no half file and a repeated task writes the same content under the same name.
"""

from __future__ import annotations

import os
import shutil
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


@contextmanager
def writing(uri: str):
    """A binary file to write; it appears under uri when the block ends well."""
    attempt = f"{uri}.{uuid.uuid4().hex}.part"
    if (path := _local(attempt)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            yield f
        os.replace(path, _local(uri))
    else:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(attempt)
        system.create_dir(os.path.dirname(path), recursive=True)
        with system.open_output_stream(path) as f:
            yield f
        system.move(path, path.removesuffix(attempt[len(uri):]))


def reading(uri: str):
    """A binary file to read."""
    if (path := _local(uri)) is not None:
        return open(path, "rb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path)


def remove_tree(uri: str) -> None:
    if (path := _local(uri)) is not None:
        shutil.rmtree(path, ignore_errors=True)
    else:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        system.delete_dir(path)
