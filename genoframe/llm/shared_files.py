"""Files in the shared folder that executors write once and map into memory to search."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from collections import OrderedDict

import numpy as np
from pyarrow import fs


def put(uri: str, data: bytes) -> None:
    """Writes a file as a whole: a task that runs twice leaves the same file."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def exists(uri: str) -> bool:
    store, path = fs.FileSystem.from_uri(uri)
    return store.get_file_info(path).type == fs.FileType.File


def mapped(uri: str) -> np.ndarray:
    """The file's bytes, mapped into memory; from a remote store through an unnamed scratch copy."""
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        return _map(path) if os.path.getsize(path) else np.zeros(0, np.uint8)
    with store.open_input_stream(path) as stream, tempfile.TemporaryFile(dir=scratch_folder()) as out:
        while block := stream.read(8 << 20):
            out.write(block)
        out.flush()
        return np.memmap(out, np.uint8, "r") if out.tell() else np.zeros(0, np.uint8)


def _map(path: str) -> np.ndarray:
    """Maps a file without keeping it open, where Python can: thousands may be mapped."""
    with open(path, "rb") as f:
        try:
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), np.uint8)
        except TypeError:
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)


def scratch_folder() -> str | None:
    """Where this executor's own spills go: Spark's local folders, as for Spark's own."""
    top = (os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS") or "").split(",")[0]
    return top if top and os.path.isdir(top) else None


#: Files that a process keeps mapped; those used least lately are let go.
HELD_FILES = 4096
_HELD: OrderedDict[str, np.ndarray] = OrderedDict()
_ARRAYS: OrderedDict[str, dict] = OrderedDict()


def mapped_once(uri: str) -> np.ndarray:
    """mapped(), kept while it is among the HELD_FILES used last; names are never used twice."""
    if uri not in _HELD:
        while len(_HELD) >= HELD_FILES:
            _HELD.popitem(last=False)
        _HELD[uri] = mapped(uri)
    _HELD.move_to_end(uri)
    return _HELD[uri]


def put_arrays(uri: str, **arrays: np.ndarray) -> None:
    """Named arrays in one file, each from a multiple of 8 bytes."""
    head, at, parts = [], 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head.append(f"{name},{a.dtype.str},{len(a)},{at}")
        parts.append(raw + b"\0" * (-len(raw) % 8))
        at += len(parts[-1])
    text = ";".join(head).encode()
    text += b" " * (-len(text) % 8)
    put(uri, np.array([len(text)], np.uint64).tobytes() + text + b"".join(parts))


def arrays_of(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped; the dict is kept as mapped_once() keeps files."""
    if uri not in _ARRAYS:
        while len(_ARRAYS) >= HELD_FILES:
            _ARRAYS.popitem(last=False)
        data, out = mapped(uri), {}
        n = int(data[:8].view(np.uint64)[0])
        for entry in bytes(data[8 : 8 + n]).decode().strip().split(";"):
            name, kind, size, at = entry.split(",")
            first = 8 + n + int(at)
            out[name] = data[first : first + int(size) * np.dtype(kind).itemsize].view(np.dtype(kind))
        _ARRAYS[uri] = out
    _ARRAYS.move_to_end(uri)
    return _ARRAYS[uri]


def member(uri: str, keys: np.ndarray, buckets: int, bucket: np.ndarray) -> np.ndarray:
    """Which sorted keys are in the sorted key files uri-<bucket>."""
    out = np.zeros(len(keys), bool)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    for i, j in zip(cuts[:-1], cuts[1:]):
        if i == j:
            continue
        held = mapped_once(f"{uri}-{int(bucket[i])}").view(np.uint64)
        if len(held):
            at = np.searchsorted(held, keys[i:j])
            out[i:j] = held[np.minimum(at, len(held) - 1)] == keys[i:j]
    return out
