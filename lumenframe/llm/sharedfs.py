"""Arrays in the shared folder: executors write them whole, workers map them into memory."""

from __future__ import annotations

import io
import mmap
import os
import uuid
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def write_array(uri: str, array: np.ndarray) -> None:
    """Writes under another name and renames, so that a task that is run twice or dies leaves no half file."""
    array = np.ascontiguousarray(array)
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, array)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    out = io.BytesIO()
    np.save(out, array)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(out.getbuffer())
    store.move(part, path)


@lru_cache(maxsize=4096)
def _mapped(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")


@lru_cache(maxsize=64)
def _fetched(uri: str) -> np.ndarray:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    size = store.get_file_info(path).size
    pages, at = mmap.mmap(-1, size), 0
    with store.open_input_stream(path) as f:
        while block := f.read(1 << 22):
            pages[at : at + len(block)] = block
            at += len(block)
    pages.seek(0)
    header = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(pages) == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = header(pages)
    return np.frombuffer(pages, dtype=kind, offset=pages.tell()).reshape(shape, order="F" if fortran else "C")


def map_array(uri: str) -> np.ndarray:
    """The array, mapped into memory; one from another store than a mounted folder is read into nameless pages, of which few are kept."""
    path = _local(uri)
    return _fetched(uri) if path is None else _mapped(path)
