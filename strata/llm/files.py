"""Files in the shared folder, written whole or not at all."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (local, HDFS, S3 and the like) and the path in it."""
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def whole_file(uri: str):
    """A binary stream to a temporary name beside ``uri``; it gets its name only after all is written, so
    that a retried or doubled task leaves either nothing or the same file."""
    system, path = opened(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
    try:
        with system.open_output_stream(hidden, compression=None) as out:
            yield out
        try:
            system.move(hidden, path)
        except OSError:
            # a doubled task came first: it wrote the same bytes
            done = system.get_file_info(path)
            if done.type != pafs.FileType.File or done.size != system.get_file_info(hidden).size:
                raise
            system.delete_file(hidden)
    except BaseException:
        if system.get_file_info(hidden).type != pafs.FileType.NotFound:
            system.delete_file(hidden)
        raise
