"""Byte-level BPE by ranked merges.

Texts are split by the tokenizer's pattern in Arrow batches; each batch becomes one block row with its
distinct words as byte arrays. Spark higher-order functions then fold the ranked merges over each word,
with the rank map as a literal in the plan: the ranks of all mergeable pairs, laid out so that a pair's place is its
right id after its left id's shift. Words that a bounded sample shows to be common are folded once, ahead, and sent
along; a block folds only words that are not among them. No row is shuffled. Decoding joins the pieces' bytes by id, in
SQL functions as well.

A word of up to LONG bytes takes one merge a step. In a longer one a step makes all merges of the least rank, which gives
the same ids in a number of steps that grows with the distinct ranks, not with the length; where a piece could unite at a
rank not above its own, a step takes only the first.

Null and empty texts have no ids. Rows are never merged or dropped; columns other
than doc_id and text are ignored, also those with names of results.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import slices
from quarry.llm.tokens import splitter
from quarry.session import ship

#: Bytes of a word up to which a step takes one merge.
LONG = 64
#: The sample that picks common words: rows read at most, and words kept at most.
SAMPLE_ROWS, COMMON = 40_000, 500_000
#: Bits of an id, and of a place in a word up to LONG bytes.
BITS, PLACE = 20, 8
MASK, NONE = (1 << BITS) - 1, 1 << BITS


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _laid_out(rows: dict[int, dict[int, int]], size: int, window: int = 4096) -> tuple[list[int], int]:
    """A shift for each left id so that no two pairs share the place shift + right id, large rows first; and the last place."""
    taken = np.zeros(sum(map(len, rows.values())) * 8 + 4 * size + 4 * window, bool)
    shift, q, n, top = [0] * size, 0, 0, 0
    for left in sorted((x for x in rows if len(rows[x]) > 1), key=lambda x: -len(rows[x])):
        cols = np.sort(np.fromiter(rows[left], np.int64))
        rest = cols[1:] - cols[0]
        if not n or 4 * len(cols) < 3 * n:  # smaller rows look for gaps from the start again
            q, n = 0, len(cols)
        while True:
            free = np.flatnonzero(~taken[q : q + window])
            for c in rest:
                if not len(free):
                    break
                free = free[~taken[q + free + c]]
            if len(free):
                q += int(free[0])
                break
            q += window
        taken[q + np.concatenate([[0], rest])] = True
        shift[left], top = q - int(cols[0]), max(top, q + int(rest[-1]))
    one = [x for x in rows if len(rows[x]) == 1]
    for left, place in zip(one, np.flatnonzero(~taken[: top + len(one) + 1]).tolist(), strict=False):
        shift[left], top = place - next(iter(rows[left])), max(top, place)
    return shift, top


class Ranks:
    """The rank map as one foldable literal.

    t: at the place of a pair (shift of left + right) the rank of the union << BITS | left; d: the shifts; p: the same of two
    neighbouring bytes, 256 standing for the end; u: ids whose piece may unite at a rank not above its own; h: each piece's
    bytes in hexadecimal, for decoding. end: an id that unites with nothing.
    """

    def __init__(self, ranks: dict[bytes, int]):
        rows: dict[int, dict[int, int]] = {}
        early = set()
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
                if left is not None and right is not None:
                    rows.setdefault(left, {})[right] = rank
                    early |= {x for x, y in ((left, piece[:k]), (right, piece[k:])) if rank <= x and len(y) > 1}
        size = max(ranks.values()) + 2
        shift, top = _laid_out(rows, size)
        flat = np.full(top + size + 1, MASK, np.int64)
        for left, row in rows.items():
            for right, rank in row.items():
                flat[shift[left] + right] = rank << BITS | left
        byte = [ranks[bytes([i])] for i in range(256)]
        pairs = [rows.get(a, {}).get(b, NONE) << BITS | a for a in byte for b in [*byte, size - 1]]
        hexes = [""] * size
        for piece, rank in ranks.items():
            hexes[rank] = piece.hex()
        table = {"t": flat.tolist(), "d": shift, "p": pairs, "u": [int(i in early) for i in range(size)], "h": hexes}
        lit = lambda *names: F.from_json(F.lit(json.dumps({k: table[k] for k in names}, separators=(",", ":"))), ", ".join(f"{k} array<{'string' if k == 'h' else 'bigint' if k in 'tp' else 'int'}>" for k in names))
        self.merges, self.pieces, self.end = lit("t", "d", "p", "u"), lit("h"), size - 1


def _only(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK)).cast("int")


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _ranked(a: Column, b: Column, table: Column) -> Column:
    """The rank of the union of ids a and b, NONE without one, with a."""
    t = F.get(table["t"], F.get(table["d"], a) + b)
    return F.when(t.bitwiseAND(F.lit(MASK)) == a, t).otherwise(a + F.lit(NONE << BITS))


def _one_merge(s: Column, table: Column, end: int) -> Column:
    """s after its first merge of least rank. s holds of each piece the rank of its union with the next piece << BITS | its id;
    the union's id is the rank."""

    def merged(low: Column) -> Column:
        def at(i: Column) -> Column:
            new = F.shiftright(low, PLACE).cast("int")
            right = F.coalesce(_only(F.get(s, i + 2)), F.lit(end))
            here = lambda e, k: F.when(k > i, e).when(k == i, _ranked(new, right, table)).when(k == i - 1, _ranked(_only(F.get(s, k)), new, table)).otherwise(F.get(s, k))
            return F.transform(F.slice(s, F.lit(2), F.size(s)), here)

        return _let(low.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int"), at)

    least = F.array_min(F.transform(s, lambda e, i: F.shiftright(e, BITS) * (1 << PLACE) + i))
    return _let(least, lambda low: F.when(low < F.lit(NONE << PLACE), merged(low)).otherwise(s))


def _all_merges(s: Column, table: Column, end: int) -> Column:
    """s after all merges of the least rank, from left to right; only the first where the union could unite again at once."""

    def merged(rank: Column) -> Column:
        flags = F.array_join(F.transform(s, lambda e: F.when(F.shiftright(e, BITS) == rank, "1").otherwise("0")), "")
        first = lambda f: _let(F.instr(f, "1"), lambda i: F.concat(F.repeat(F.lit("0"), i - 1), F.lit("1"), F.repeat(F.lit("0"), F.size(s) - i)))
        # Of two merges that share a piece the left one counts.
        marks = _let(flags, lambda f: F.when(F.get(table["u"], rank.cast("int")) == 1, first(f)).otherwise(F.replace(f, F.lit("11"), F.lit("10"))))
        gone, made = F.lit(-1).cast("bigint"), F.lit(-2).cast("bigint")
        put = lambda m: F.transform(s, lambda e, k: F.when(F.get(m, k) == "1", made).when(F.get(m, k - 1) == "1", gone).otherwise(e))
        left = _let(F.split(marks, ""), lambda m: F.filter(put(m), lambda e: e != -1))
        name = lambda e: F.when(e == -2, rank.cast("int")).otherwise(_only(e))
        after = lambda c, k: F.coalesce(F.get(c, k + 1), F.lit(end).cast("bigint"))
        return _let(left, lambda c: F.transform(c, lambda e, k: F.when((e == -2) | (after(c, k) == -2), _ranked(name(e), name(after(c, k)), table)).otherwise(e)))

    least = F.shiftright(F.array_min(s), BITS)
    return _let(least, lambda rank: F.when(rank < NONE, merged(rank)).otherwise(s))


def folded(word: Column, table: Column, end: int) -> Column:
    """Ids of a word (array of byte values, int) by folding merges over it."""
    pairs = F.transform(word, lambda x, i: F.get(table["p"], x * F.lit(257) + F.coalesce(F.get(word, i + 1), F.lit(256))))
    steps, ids = F.slice(word, 2, F.size(word)), lambda s: F.transform(s, _only)
    short = F.aggregate(steps, pairs, lambda s, _: _one_merge(s, table, end), ids)

    # Steps after the last merge cost nothing: the state says that it is done.
    def step(z: Column, _: Column) -> Column:
        return F.when(z["done"], z).otherwise(_let(_all_merges(z["s"], table, end), lambda s: F.struct(s.alias("s"), (F.size(s) == F.size(z["s"])).alias("done"))))

    far = F.aggregate(steps, F.struct(pairs.alias("s"), F.lit(False).alias("done")), step, lambda z: ids(z["s"]))
    return F.when(F.size(word) <= LONG, short).otherwise(far)


def fold_all(words: Column, ranks: Ranks) -> Column:
    """Ids of each word of an array; the literal occurs once in the plan, as the variable of a lambda."""
    return _let(ranks.merges, lambda table: F.transform(words, lambda w: folded(w, table, ranks.end)))


def decoded(ids: Column, ranks: Ranks) -> Column:
    """The bytes of the pieces, joined."""
    return F.unhex(_let(ranks.pieces, lambda table: F.array_join(F.transform(ids, lambda x: F.get(table["h"], x)), "")))


def as_bytes(words: list[bytes]) -> pa.Array:
    """The byte values of each word."""
    offs = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(words), np.uint8).astype(np.int32)))


class Ids:
    """Ids of numbered words, as one array and offsets."""

    def __init__(self, flat: np.ndarray, offs: np.ndarray):
        self.flat, self.offs = flat, offs

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in a row, and how many each has."""
        sizes = self.offs[codes + 1] - self.offs[codes]
        first = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.offs[codes] - first, sizes) + np.arange(int(sizes.sum()))], sizes


def _lists(column: pa.ListArray) -> Ids:
    offs = np.asarray(column.offsets).astype(np.int64)
    return Ids(np.asarray(column.values)[offs[0] : offs[-1]].astype("<u4"), offs - offs[0]) if len(column) else Ids(np.empty(0, "<u4"), np.zeros(1, np.int64))


def common_words(spark: SparkSession, docs: DataFrame, pattern: str, ranks: Ranks, rows: int = SAMPLE_ROWS, keep: int = COMMON) -> tuple[list[bytes], Ids]:
    """The sample's most frequent words with their ids, folded once. Only speed depends on which they are."""
    total = docs.count()
    part = docs if total <= rows else docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * rows / total))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = splitter(pattern), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(find(t or ""))
        words = [w for w in (x.encode() for x in seen) if len(w) <= LONG and 0 not in w]
        for i in range(0, len(words), 20_000):
            own = words[i : i + 20_000]
            yield pa.record_batch({"word": pa.array(own, pa.binary()), "n": pa.array([seen[w.decode()] for w in own], pa.int64())})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"word": b.column(0), "bytes": as_bytes(b.column(0).to_pylist())})

    top = part.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(keep)
    wide = top.select("word").repartition(2 * spark.sparkContext.defaultParallelism).mapInArrow(spread, "word binary, bytes array<int>")
    found = wide.select("word", fold_all(F.array("bytes"), ranks)[0].alias("ids")).toArrow().combine_chunks()
    if not found.num_rows:
        return [], Ids(np.empty(0, "<u4"), np.zeros(1, np.int64))
    return found.column(0).to_pylist(), _lists(found.column(1).chunk(0))


BLOCK = "docs array<bigint>, counts array<int>, codes array<int>, words array<array<int>>"
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, ids array<int>"
#: What a worker keeps from task to task.
_KEPT: dict[str, dict[str, int]] = {}


def encode(spark: SparkSession, docs: DataFrame, path: str, pattern: str, with_ids: bool = True, block: int = 8 << 20) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of each text; the hashes are of the ids as little-endian
    unsigned 32-bit integers and of the bytes they decode to."""
    ship(spark)
    ranks = Ranks(load_ranks(path))
    words, common = common_words(spark, docs, pattern, ranks)
    run = uuid.uuid4().hex
    named, coded = spark.sparkContext.broadcast(b"\0".join(words)), spark.sparkContext.broadcast(common)

    def known_words() -> dict[str, int]:
        """The common words by number, made once in a worker for this run."""
        if run not in _KEPT:
            _KEPT.clear()
            _KEPT[run] = {w: i for i, w in enumerate(named.value.decode().split("\0"))} if named.value else {}
        return _KEPT[run]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, find = known_words(), splitter(pattern)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        for b in batches:
            for part in slices([b], "text", block):
                own: dict[str, int] = {}
                counts, codes = [], []
                for t in part.column("text").to_pylist():
                    words = find(t or "")
                    counts.append(len(words))
                    mine = np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))
                    for i in np.flatnonzero(mine < 0).tolist():
                        mine[i] = -1 - own.setdefault(words[i], len(own))
                    codes.append(mine)
                flat = np.concatenate(codes) if codes else np.empty(0, np.int32)
                yield pa.record_batch([one(part.column("doc_id")), one(pa.array(counts, pa.int32())), one(pa.array(flat)), one(as_bytes([w.encode() for w in own]))], names=["docs", "counts", "codes", "words"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = coded.value
        for b in batches:
            for row in range(b.num_rows):
                get = lambda name, row=row, b=b: b.column(name)[row].values
                own = _lists(get("ids"))
                full = Ids(np.concatenate([ids.flat, own.flat]), np.concatenate([ids.offs, ids.offs[-1] + own.offs[1:]]))
                codes = get("codes").to_numpy().astype(np.int64)
                codes = np.where(codes < 0, len(ids.offs) - 2 - codes, codes)
                docs_, ends = get("docs"), np.concatenate([[0], np.cumsum(get("counts").to_numpy())])
                for k in range(0, len(docs_), 256):
                    stop = min(k + 256, len(docs_))
                    flat, sizes = full.gather(codes[ends[k] : ends[stop]])
                    at = np.concatenate([[0], np.cumsum(sizes)])[ends[k : stop + 1] - ends[k]]
                    hashes = [hashlib.sha256(flat[at[i] : at[i + 1]]).hexdigest() for i in range(stop - k)]
                    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32)))
                    yield pa.record_batch({"doc_id": docs_[k:stop], "n_tokens": pa.array(np.diff(at), pa.int64()), "ids_sha256": pa.array(hashes, pa.string()), "ids": lists})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = rows.mapInArrow(blocks, BLOCK)
    made = made.withColumn("ids", fold_all(F.col("words"), ranks)).drop("words").mapInArrow(assemble, ENCODED)
    return made.select("doc_id", "n_tokens", "ids_sha256", F.sha2(decoded(F.col("ids"), ranks), 256).alias("decoded_sha256"), *(["ids"] if with_ids else []))
