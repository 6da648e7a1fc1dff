"""Binary files in the shared folder, written and read inside tasks."""

from __future__ import annotations

import numpy as np
from pyarrow import fs


def open_store(uri: str):
    """(file system, path) of a file:, hdfs:, s3: ... address or a plain path."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    store, path = open_store(uri)
    store.create_dir(path, recursive=True)


def array_of(uri: str, dtype: str) -> np.ndarray:
    """A flat file as an array: memory-mapped where the file system allows it."""
    store, path = open_store(uri)
    if isinstance(store, fs.LocalFileSystem):
        if store.get_file_info(path).size == 0:
            return np.zeros(0, dtype=dtype)
        return np.memmap(path, dtype=dtype, mode="r")
    with store.open_input_file(path) as source:
        return np.frombuffer(source.read_buffer(), dtype=dtype)
