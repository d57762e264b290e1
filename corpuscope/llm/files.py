"""Files written and read by tasks in the shared folder."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager


def open_store(uri: str):
    """(file system, path in it) of a folder: local path, ``file:``, ``hdfs:``, ``s3:`` and so on."""
    from pyarrow.fs import FileSystem

    if uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:").removeprefix("//")
    return FileSystem.from_uri(uri)


@contextmanager
def written(folder: str, name: str) -> Iterator:
    """A stream whose bytes appear as ``folder/name`` only when all are written.

    A task that is repeated, or runs twice, writes the same file again under a
    name of its own and moves it over the first.
    """
    from pyspark import TaskContext

    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    context = TaskContext.get()
    attempt = context.taskAttemptId() if context else os.getpid()
    own = f"{root}/.{name}.{attempt}"
    with store.open_output_stream(own) as out:
        yield out
    store.move(own, f"{root}/{name}")
