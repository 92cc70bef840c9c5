"""Token ids by the tokenizers library, with the ids of text pieces kept by each worker.

A text is normalized and split by the tokenizer's own pattern; each piece that the worker does not know yet is
tokenized by the library's model. That skips the library's offsets and masks, which cost more than the ids. Latin-1
texts of the two known patterns are lower-cased and split as arrays of bytes, many at a time, and each distinct piece
is looked up once. Other texts of characters below FOLD are split by Python's re and lower-cased in Python (they are all
NFC), the rest by the regex library, normalized by the tokenizer. A text that holds the content of an added token goes
through the library whole, and so do all texts of a tokenizer of another kind than byte-level BPE with one splitting pattern.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import regex  # noqa: E402

from quarry.llm.common import by_size  # noqa: E402

#: Pieces in a generation of those kept by a worker (two are held), and the longest that is kept.
KEEP, LONGEST = 200_000, 64
FOLD = 0x250
#: Bytes split together; longer texts are split by themselves, by the pattern.
BLOCK = 2 << 20
#: The splitting pattern of byte-level pre-tokenizers that name none, and one of words without white space.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
# Latin-1 characters: their classes, and in lower case.
_WHITE, _LETTER, _DIGIT, _OTHER, _BETWEEN = range(5)
_CLASS = np.array([next((k for k, c in ((_WHITE, r"\s"), (_LETTER, r"\p{L}"), (_DIGIT, r"\p{N}")) if regex.match(c, chr(i))), _OTHER) for i in range(256)], np.uint8)
_LOWER = bytes(ord(chr(i).lower()) for i in range(256))


def splitter(pattern: str):
    """A function from a text to its matches of the pattern, by Python's re where that gives the same."""
    wide, near = regex.compile(pattern).findall, re.compile(_narrow(pattern)).findall
    return lambda text: (near if _is_narrow(text) else wide)(text)


def _is_narrow(text: str) -> bool:
    return text.isascii() or int(np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").max()) < FOLD


def _narrow(pattern: str) -> str:
    """The pattern with its Unicode classes written out for characters below FOLD."""
    chars = [chr(i) for i in range(FOLD)]
    classes = {k: "".join(re.escape(c) for c in chars if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s", r"\S")}
    out, inside, i = [], False, 0
    while i < len(pattern):
        name = next((k for k in classes if pattern.startswith(k, i)), None)
        if name:
            out.append(classes[name] if inside else f"[{classes[name]}]")
            i += len(name)
        else:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return "".join(out)


def _cut(texts: list[bytes], words: bool) -> tuple[list[str], pa.Array, np.ndarray]:
    """Distinct pieces of Latin-1 texts, those of WORDS or of BYTE_LEVEL; the number of each piece among them; and where each
    text's pieces begin (one more than texts)."""
    buf = np.frombuffer(b"\0".join([b"", *texts, b"", b""]), np.uint8)  # so each place has a next one but one
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    kind = _CLASS[buf]
    kind[bounds] = kind[bounds[-1] :] = _BETWEEN
    start = np.ones(len(buf), bool)
    start[1:] = kind[1:] != kind[:-1]
    if words:
        start |= kind == _DIGIT
    else:
        # The last white space before a word stands apart from those before it, and a space belongs to the word.
        last = np.flatnonzero((kind[:-1] == _WHITE) & (kind[1:] != _WHITE) & (kind[1:] != _BETWEEN))
        start[last] = True
        start[last[buf[last] == 32] + 1] = False
    # 's and the like, where a piece begins with the apostrophe.
    for i in np.flatnonzero((buf == 39) & start).tolist():
        n = 2 if buf[i + 1] in b"stmd" else 3 if buf[i + 1 : i + 3].tobytes() in (b"re", b"ve", b"ll") else 0
        if n:
            start[i + 1] = False
            start[i + n] = True
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, len(buf)))
    kept = (kind != _BETWEEN) & (kind != _WHITE) if words else kind != _BETWEEN
    data, own = buf[kept], kept[at]
    at = at[own]
    ends = np.concatenate([[0], np.cumsum(size[own])]).astype(np.int32)
    pieces = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    _, ends, data = pieces.dictionary.buffers()
    ends, data = np.frombuffer(ends, np.int32, len(pieces.dictionary) + 1).tolist(), str(data or b"", "latin-1")
    return [data[a:z] for a, z in zip(ends, ends[1:], strict=False)], pieces.indices, np.searchsorted(at, bounds)


def _bytes_as_text() -> dict[int, str]:
    """Byte-level vocabularies write a byte as its Latin-1 character if that is visible, else as the next one from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _kind(config: dict) -> tuple[str, bool] | None:
    """Splitting pattern, and whether texts are made NFC and lower case; None for any other tokenizer."""
    pre, norm = config.get("pre_tokenizer") or {}, config.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
        return BYTE_LEVEL, False
    if pre.get("type") == "Sequence" and norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        split, *rest = pre["pretokenizers"]
        if split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"] and [x["type"] for x in rest] == ["ByteLevel"] and not rest[0].get("use_regex"):
            return split["pattern"]["Regex"], True
    return None


class Known(dict):
    """Ids of pieces, each made by `make` when first asked for. After `keep` pieces a new generation begins, and only pieces
    of the one before are still known; one that is asked for again passes on. So common pieces stay and rare ones go."""

    def __init__(self, make, keep: int):
        self.make, self.keep, self.before = make, keep, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.keep:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_KEPT: dict[tuple[str, bool], object] = {}


def encoder(path: str, plain: bool = False):
    """A function from texts to the ids of each, as little-endian unsigned 32-bit bytes. The content of a special token in
    a text becomes that token, as the library does by default; with `plain` it is ordinary text."""
    if (path, plain) not in _KEPT:
        _KEPT[path, plain] = _encoder(path, plain)
    return _KEPT[path, plain]


def _encoder(path: str, plain: bool):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = plain
    added = [x.content for x in t.get_added_tokens_decoder().values() if not (plain and x.special)]
    whole = lambda texts: [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    state = lambda part: json.loads(part.__getstate__()) if part is not None else None
    kind = _kind({"pre_tokenizer": state(t.pre_tokenizer), "normalizer": state(t.normalizer)})
    if kind is None or any(x.normalized for x in t.get_added_tokens_decoder().values()):
        return whole
    pattern, fold = kind
    arrays = pattern == (WORDS if fold else BYTE_LEVEL)
    wide, near, tokenize = regex.compile(pattern).findall, re.compile(_narrow(pattern)).findall, t.model.tokenize
    table = _bytes_as_text()

    def ids_of(piece: str) -> bytes:
        # Printable ASCII but the space is written as it is.
        plain = piece.isascii() and piece.isprintable()
        ids = array("I", [x.id for x in tokenize(piece.replace(" ", table[32]) if plain else piece.encode().decode("latin-1").translate(table))])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    known = Known(ids_of, KEEP).__getitem__

    def by_pattern(text: str) -> bytes:
        if _is_narrow(text):
            pieces = near(text.lower() if fold else text)
        else:
            pieces = wide(t.normalizer.normalize_str(text) if fold else text)
        return b"".join(map(known, pieces))

    def together(texts: list[bytes]) -> list[bytes]:
        pieces, code, first = _cut(texts, fold)
        each = list(map(known, pieces))
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))]).astype(np.int32)
        ids = pa.BinaryArray.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(each))]).take(code)
        _, ends, data = ids.buffers()
        bounds, data = np.frombuffer(ends, np.int32, len(ids) + 1)[first].tolist(), memoryview(data or b"")
        return [bytes(data[a:z]) for a, z in zip(bounds, bounds[1:], strict=False)]

    def run(texts: list[str]) -> list[bytes]:
        out, latin, places = [b""] * len(texts), [], []
        for i, text in enumerate(texts):
            if any(x in text for x in added):
                out[i] = whole([text])[0]
                continue
            if arrays and len(text) <= BLOCK:
                try:
                    one = text.encode("latin-1")
                except UnicodeEncodeError:
                    pass
                else:
                    latin.append(one.translate(_LOWER) if fold else one)
                    places.append(i)
                    continue
            out[i] = by_pattern(text)
        for a, z in by_size(latin, BLOCK):
            for i, ids in zip(places[a:z], together(latin[a:z]), strict=True):
                out[i] = ids
        return out

    return run
