"""Sorted arrays of 64-bit keys in the shared folder: one file for each bucket, memory-mapped by workers."""

from __future__ import annotations

import uuid

import numpy as np
import zstandard
from pyarrow import fs as pafs


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys with counts: differences, cut into byte planes, compressed."""
    step = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = [x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in (step, counts)]
    return len(keys).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=16 * n), np.uint8).reshape(2, 8, n)
    step, counts = (np.ascontiguousarray(x.T).view("<u8").ravel() for x in flat)
    return np.cumsum(step, dtype=np.uint64), counts.astype(np.int64)


def add_up(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted different keys, and the sums of each of counts over equal keys."""
    if not len(keys):
        return (keys, *counts)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[begin], *(np.add.reduceat(c[order], begin) for c in counts))


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def save(uri: str, *arrays: np.ndarray) -> None:
    """Writes arrays one after another, behind their sizes. The file appears whole under its name, whichever attempt of a
    task comes last: attempts write the same."""
    fs, path = _open(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    head = np.array([len(arrays), *(x.nbytes for x in arrays)], "<i8").tobytes()
    with fs.open_output_stream(part) as out:
        out.write(head)
        for x in arrays:
            out.write(memoryview(np.ascontiguousarray(x)).cast("B") if x.nbytes else b"")
    fs.move(part, path)


_MAPS: dict[str, list[np.ndarray]] = {}
_READ: dict[str, int] = {}
#: Bytes of files from stores that aren't mounted which a worker keeps in memory.
READ_BYTES = 256 << 20


def load(uri: str, kinds: list[str]) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped. From a store that isn't a mounted file system the file is read into memory,
    where a bounded number of bytes stays; nothing is written beside the shared folder."""
    if uri not in _MAPS:
        if len(_MAPS) > 4096:
            _MAPS.clear()
            _READ.clear()
        fs, path = _open(uri)
        if isinstance(fs, pafs.LocalFileSystem):
            flat = np.memmap(path, np.uint8, "r")
        else:
            with fs.open_input_stream(path) as src:
                flat = np.frombuffer(src.read(), np.uint8)
            _READ[uri] = len(flat)
            while sum(_READ.values()) > READ_BYTES and len(_READ) > 1:
                old = next(iter(_READ))
                del _READ[old], _MAPS[old]
        sizes = flat[8 : 8 + 8 * int(flat[:8].view("<i8")[0])].view("<i8").tolist()
        at, got = 8 + 8 * len(sizes), []
        for size in sizes:
            got.append(flat[at : at + size])
            at += size
        _MAPS[uri] = got
    return [x.view(kind) for x, kind in zip(_MAPS[uri], kinds, strict=True)]


def forget(folder: str) -> None:
    """Closes the files of a folder, so that deleting them frees their space."""
    for uri in [u for u in _MAPS if u.startswith(f"{folder}/")]:
        del _MAPS[uri]
        _READ.pop(uri, None)


def positions(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key is, or -1."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == wanted, at, -1)


def top_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by ranges of the keys' leading bits, so that the files together are in order."""
    return ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def mix(keys: np.ndarray) -> np.ndarray:
    """Spreads keys evenly over 64 bits."""
    x = keys ^ (keys >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
