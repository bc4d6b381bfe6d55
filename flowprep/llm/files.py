"""Files that tasks write to and read from the session's shared folder."""

from __future__ import annotations

import io
import uuid
from urllib.parse import unquote, urlparse

import numpy as np


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path (a mounted shared folder), else None."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _store(uri: str):
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> str:
    store, path = _store(uri)
    store.create_dir(path, recursive=True)
    return uri


def write_bytes(uri: str, data) -> None:
    store, path = _store(uri)
    with store.open_output_stream(path, compression=None) as f:
        f.write(data)


def open_output(uri: str):
    store, path = _store(uri)
    return store.open_output_stream(path, compression=None)


def open_input(uri: str):
    """A seekable file: ``seek``, ``read``, ``read_at``."""
    store, path = _store(uri)
    return store.open_input_file(path)


def write_array(uri: str, array: np.ndarray) -> None:
    """Written under a name of its own, then moved to ``uri``: attempts of one task write equal arrays, and a reader
    sees a whole one."""
    buffer = io.BytesIO()
    np.save(buffer, array)
    own = f"{uri}.{uuid.uuid4().hex}"
    write_bytes(own, buffer.getbuffer())
    store, path = _store(uri)
    store.move(_store(own)[1], path)


def map_array(uri: str) -> np.ndarray:
    """A stored array: memory-mapped from a mounted folder, read whole from any other store."""
    path = local_path(uri)
    if path:
        return np.load(path, mmap_mode="r")
    with open_input(uri) as f:
        return np.load(io.BytesIO(f.read()))
