"""Files that tasks write themselves, under temporary names until they are whole.

uri is anything that pyarrow.fs opens on the driver and on all executors: file:// on a shared folder, hdfs://, s3://, gs://.
"""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark import TaskContext


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path.rstrip("/")


def make_dir(uri: str) -> None:
    fs, path = opened(uri)
    fs.create_dir(path, recursive=True)


def commit(uri: str, name: str, content: bytes) -> None:
    """Whole under a temporary name, then renamed: a task that is lost or runs twice leaves no half file under name."""
    fs, path = opened(uri)
    attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
    temp = f"{path}/.{name}.{attempt}.tmp"
    with fs.open_output_stream(temp) as out:
        out.write(content)
    fs.move(temp, f"{path}/{name}")
