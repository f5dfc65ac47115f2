"""Files that tasks write themselves, in a folder of the shared store.

A file is written under a name of its own attempt and then renamed, so a task that is run again, or
twice at once, replaces its files by equal ones and never leaves half a file under a final name.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address, and the path there. Local paths, ``file:``, ``s3:``,
    ``gs:`` and, where its client is installed, ``hdfs:``."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))


def put(folder: str, name: str, data: bytes) -> None:
    system, path = store(folder)
    system.create_dir(f"{path}/_attempts", recursive=True)
    attempt = f"{path}/_attempts/{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(attempt) as out:
        out.write(data)
    system.move(attempt, f"{path}/{name}")
