"""Questions about 64-bit keys that only all batches together can answer, with few bytes per key.

A task gathers the distinct keys of a batch of texts, with a summary per key, and sends one packed row per
hash range and batch. Each range sees its keys of all batches (a key once per batch, however often the
batch holds it), judges them and sends a flag per key back to the batch, where the batch's header turns
the flags into rows. The number of ranges follows the input size, so that a range stays within memory.
A batch's name is a digest of its content: a task that runs again sends the same rows.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from surveyframe.llm.words import free_memory

_SENT = "r long, batch binary, keys binary, extra binary, header binary"
_BACK = "batch binary, r long, flags binary, header binary"


def dump(**parts) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts))


def load(header: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(header))


def header_range(name: bytes, n_ranges: int) -> int:
    """Spreads the headers of all batches over all ranges."""
    return int.from_bytes(name[:8], "little") % n_ranges


def pack(keys: np.ndarray, extras: list[np.ndarray], header: bytes, n_ranges: int):
    """`keys` sorted and distinct; each extra is an array of 64-bit values aligned with them."""
    r = ((keys >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)
    present, at = np.unique(r, return_index=True)
    ends = np.append(at[1:], len(keys))
    name = hashlib.md5(header).digest()
    rows = [(header_range(name, n_ranges), name, None, None, header)]
    rows += [
        (int(k), name, keys[a:b].tobytes(), b"".join(x[a:b].tobytes() for x in extras), None) for k, a, b in zip(present, at, ends)
    ]
    for s in range(0, len(rows), 64):
        part = rows[s : s + 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[k] for row in part], kind) for k, kind in enumerate([pa.int64()] + [pa.binary()] * 4)],
            names=["r", "batch", "keys", "extra", "header"],
        )


def ask(
    docs: DataFrame,
    prepare: Callable[[Iterable[pa.RecordBatch]], Iterable[tuple[np.ndarray, list[np.ndarray], bytes]]],
    judge: Callable[..., np.ndarray],
    finish: Callable[[bytes, np.ndarray, int], pa.Table],
    n_ranges: int,
    n_extras: int,
    schema: str,
) -> DataFrame:
    """prepare: batches to (keys, extras, header); judge(keys, *extras) of a whole range: a byte per entry;
    finish(header, flags, copies): a table, for a header that stood `copies` times."""

    def send(batches):
        for keys, extras, header in prepare(batches):
            yield from pack(keys, extras, header, n_ranges)
            del keys, extras, header
            free_memory()

    def answer(key, table):
        out = []
        entries = [(b.as_py(), np.frombuffer(k.as_py(), np.uint64), e.as_py()) for b, k, e in zip(table["batch"], table["keys"], table["extra"]) if k.is_valid]
        if entries:
            keys = np.concatenate([k for _, k, _ in entries])
            extras = [np.concatenate([np.frombuffer(e, np.uint64).reshape(n_extras, -1)[x] for _, _, e in entries]) for x in range(n_extras)]
            flags = judge(keys, *extras).astype(np.uint8)
            at = 0
            for name, k, _ in entries:
                out.append((name, key[0].as_py(), flags[at : at + len(k)].tobytes(), None))
                at += len(k)
            del entries, keys, extras, flags
            free_memory()
        out += [(b.as_py(), -1, None, h.as_py()) for b, h in zip(table["batch"], table["header"]) if h.is_valid]
        return pa.table({n: pa.array([row[k] for row in out], pa.int64() if k == 1 else pa.binary()) for k, n in enumerate(["batch", "r", "flags", "header"])})

    def gather(key, table):
        headers = [h.as_py() for h in table["header"] if h.is_valid]
        parts = sorted((r.as_py(), f.as_py()) for r, f in zip(table["r"], table["flags"]) if f.is_valid)
        kept = [f for k, (r, f) in enumerate(parts) if not k or parts[k - 1][0] != r]  # a batch sent twice has the same answers twice
        flags = np.frombuffer(b"".join(kept), np.uint8)
        out = finish(headers[0], flags, len(headers))
        free_memory()
        return out

    back = docs.mapInArrow(send, _SENT).groupBy("r").applyInArrow(answer, _BACK)
    return back.groupBy("batch").applyInArrow(gather, schema)


def group_span(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every entry: entries with its key, smallest and largest value among them; and the sort order used."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = ranked[1:] != ranked[:-1]
    at = np.flatnonzero(first)
    of = np.cumsum(first) - 1
    back = np.empty(len(keys), dtype=np.int64)
    back[order] = of
    counts = np.diff(np.append(at, len(keys)))
    low, high = np.minimum.reduceat(values[order], at), np.maximum.reduceat(values[order], at)
    return counts[back], low[back], high[back], back
