"""Files in the shared folder, for formats that Spark has no writer for.

Paths are URIs of any file system that Arrow opens (file, hdfs, s3, gs ...). A path without a scheme is
refused: which file system it means is known to Spark alone, and ``storage.new_folder`` has asked it.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        raise ValueError(f"{uri} has no scheme")
    return (fs.LocalFileSystem(), uri[7:]) if uri.startswith("file://") else fs.FileSystem.from_uri(uri)


class Out:
    """A new file in ``folder``; its name is unique, so a repeated task never meets a broken one.

    Readers take names from the manifest that Spark commits, not from the folder.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        self.uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
        store, path = _at(folder)
        store.create_dir(path, recursive=True)
        store, path = _at(self.uri)
        self._out = store.open_output_stream(path, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self._out.close()


def open_input(uri: str):
    """A seekable file with ``size()``, ``seek`` and ``read``."""
    store, path = _at(uri)
    return store.open_input_file(path)


def read_all(uri: str) -> bytes:
    with open_input(uri) as f:
        return f.read()
