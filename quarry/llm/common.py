"""Word splitting, word and shingle hashes and Arrow plumbing that several operators share.

A word is a run of bytes other than space and 0x09-0x0D. All arrays cover a bounded piece
of text at a time; a text longer than PIECE bytes is hashed piece by piece at white space.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POW = np.cumprod(np.concatenate([[_U(1)], np.full(4095, _MUL, np.uint64)]), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of data."""
    buf = np.frombuffer(data, np.uint8)
    word = ~_SPACE[buf]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    most = int(sizes.max())
    power = _POW if most <= len(_POW) else np.cumprod(np.concatenate([[_U(1)], np.full(most, _MUL, np.uint64)]), dtype=np.uint64)
    total = np.add.reduceat(_BYTE[buf[word]] * power[place], first)
    return mix(total + sizes.astype(np.uint64) * _MUL), starts


def _pieces(data: bytes) -> Iterator[bytes]:
    """data in pieces of about PIECE bytes that end at white space."""
    at = 0
    while len(data) - at > 2 * PIECE:
        cut = at + PIECE
        while cut < len(data) and data[cut] not in b" \t\n\x0b\x0c\r":
            cut += 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, and where each text's words begin (one more than texts)."""
    table = bytes(_LOWER) if lower else None
    if sum(map(len, texts)) > 2 * PIECE:
        parts, offs = [], [0]
        for t in texts:
            t = t.translate(table) if table else t
            own = [_hash_piece(p)[0] for p in _pieces(t)]
            parts += own
            offs.append(offs[-1] + sum(map(len, own)))
        return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.array(offs)
    data = b"\n".join(texts)
    h, starts = _hash_piece(data.translate(table) if table else data)
    firsts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]) if texts else np.zeros(1, int)
    return h, np.searchsorted(starts, firsts)


def shingle_hashes(h: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each distinct k-word shingle, ordered by text, then hash. A text of fewer words is one shingle."""
    count = np.diff(offs)
    vals, docs = [], []
    if len(h) >= k:
        a = np.full(len(h) - k + 1, _U(k), np.uint64)
        for j in range(k):
            a = mix(a * _MUL + h[j : len(h) - k + 1 + j])
        doc = np.repeat(np.arange(len(count)), count)
        same = doc[: len(a)] == doc[k - 1 :]
        vals.append(a[same])
        docs.append(doc[: len(a)][same])
    for n in range(1, k):
        at = np.flatnonzero(count == n)
        if len(at):
            a = np.full(len(at), _U(n), np.uint64)
            for j in range(n):
                a = mix(a * _MUL + h[offs[at] + j])
            vals.append(a)
            docs.append(at)
    if not vals:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    v, d = np.concatenate(vals), np.concatenate(docs)
    order = np.lexsort((v, d))
    v, d = v[order], d[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[new], d[new]


def by_size(texts: list[bytes], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of the named column."""
    for batch in batches:
        size = max(1, batch.column(column).nbytes)
        step = max(1, int(batch.num_rows * most / size)) if batch.num_rows else 1
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores until no column has it (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
