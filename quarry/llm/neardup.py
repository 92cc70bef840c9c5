"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, components.

Texts with equal shingle sets are one class from the start, so copies cost nothing further. Of the classes, those that
share a band of their signatures are candidates; to find them each is tied to the least of its band, never to all
others. Tied classes form clusters, and within a cluster all links are found exactly: the sets are compared in blocks
of bounded size, through the rarest shingles of each set (two sets that are similar enough share one), and a block
passes on only a spanning forest of its links. Components of those links are the groups.

In a cluster of more than one block, each set is first compared with one other, the least of most of its bands, in as many
tasks as it takes. What that links needs no further comparing inside: the largest component is then compared with the
rest only, and the rest with itself. So the texts of a large group of near copies are sent about once, whatever its size.

A set's signature has enough bands that a pair at the threshold is missed with a probability under MISS. Sets are held as
64-bit hashes of their shingles.

Null and empty texts and texts without words have the empty set and are linked with nothing. Texts of fewer words than
a shingle are one shingle. Rows with null doc_id count as their own group, with null component_id, and are kept; equal
rows get equal results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import by_size, mix, shingle_hashes, slices, utf8, word_hashes
from quarry.llm.components import components
from quarry.session import materialize, ship

ROWS, MISS = 5, 1e-6
#: Shingles in a block of a cluster, about.
BLOCK = 200_000
#: Shingles whose permutations are held at a time.
CHUNK = 1 << 17
_U = np.uint64


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def signatures(vals: np.ndarray, doc: np.ndarray, n: int, size: int) -> np.ndarray:
    """SuperMinHash signatures (n x size) of sets given as (hash, set number) pairs ordered by set.

    Each element draws a permutation of the places, step by step; at step j it offers j + r, r uniform, to the j-th
    place of its permutation. A set stops when all its places are below the step. All sets of a batch step together.
    """
    if size > 1 << 16:
        raise ValueError("a signature has at most 65,536 places")
    h = np.full(n * size, ~_U(0), np.uint64)
    for at in range(0, len(vals), CHUNK):
        v, d = vals[at : at + CHUNK], doc[at : at + CHUNK]
        order = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(v), 1))
        here = np.arange(len(v))
        for j in range(size):
            if not len(here):
                break
            x = mix(v[here] + _U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            k = j + ((x >> _U(32)) * _U(size - j) >> _U(32)).astype(np.int64)
            slot = order[here, k]
            order[here, k] = order[here, j]
            np.minimum.at(h, d[here] * size + slot, _U(j) << _U(32) | (x & _U(0xFFFFFFFF)))
            low, high = int(d[0]), int(d[-1]) + 1
            open_ = h[low * size : high * size].reshape(high - low, size).max(axis=1) >= _U(j + 1) << _U(32)
            here = here[open_[d[here] - low]]
    return h.reshape(n, size)


def band_hashes(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = sig.shape[1] // rows
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(sig), 1))
    for k in range(rows):
        out = mix(out * _U(0x9E3779B97F4A7C15) + sig[:, k : bands * rows : rows])
    return out.astype(np.int64)


def marks(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set, bands) of each text; equal sets have the same 16-byte digest `set` and the same bands."""
    size = bands_for(percent) * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices([batch], "text", 1 << 20):
                texts = utf8(b.column("text"))
                counts, digests, bands = [], [], []
                for a, z in by_size(texts, 1 << 18):
                    h, offs = word_hashes(texts[a:z], lower=True)
                    v, d = shingle_hashes(h, offs, words)
                    at = np.searchsorted(d, np.arange(z - a + 1))
                    counts += np.diff(at).tolist()
                    digests += [hashlib.blake2b(v[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() for i in range(z - a)]
                    bands.append(band_hashes(signatures(v, d, z - a, size)))
                flat = np.concatenate(bands) if bands else np.empty((0, size // ROWS), np.int64)
                offs = pa.array((np.arange(len(flat) + 1) * flat.shape[1]).astype(np.int32))
                yield pa.record_batch({"doc_id": b.column("doc_id"), "n_shingles": pa.array(counts, pa.int64()), "set": pa.array(digests, pa.binary()), "bands": pa.ListArray.from_arrays(offs, pa.array(flat.ravel()))})

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set binary, bands array<long>")


def links(sets: list[np.ndarray], percent: int, side: list[int] | None = None, label: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets (sorted hashes) with 100 * intersection >= percent * union; with sides, of
    the pairs from different sides; sets of equal label count as linked. Every set is compared with all that share one of
    its rarest elements."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, code = np.unique(np.concatenate(sets), return_inverse=True)
    rank = np.empty(len(flat), np.int64)
    rank[np.argsort(np.bincount(code), kind="stable")] = np.arange(len(flat))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    ranked = rank[code]
    own = [np.sort(ranked[ends[i] : ends[i + 1]]) for i in range(n)]
    index: dict[int, list[int]] = defaultdict(list)
    group = np.unique(label, return_inverse=True)[1] if label else np.arange(n)
    held: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(group.tolist()):
        held[x].append(i)
    sides = np.array(side) if side else None
    mark = np.zeros(len(flat), bool)
    out: list[tuple[int, int]] = []
    for i in np.lexsort((np.arange(n), sizes)).tolist():
        s = own[i]
        near = s[: len(s) - -(-percent * len(s) // 100) + 1].tolist()
        found = np.unique(np.array([j for t in near for j in index[t]], np.int64))
        found = found[100 * sizes[found] >= percent * len(s)]
        if sides is not None:
            found = found[sides[found] != sides[i]]
        mark[s] = True
        while len(found := found[group[found] != group[i]]):
            # the least-edited of those left first; all at once, a bounded number of elements at a time
            part = found[:256]
            common = np.array([np.count_nonzero(mark[own[j]]) for j in part.tolist()])
            for j in part[100 * common >= percent * (len(s) + sizes[part] - common)].tolist():
                a, b = int(group[i]), int(group[j])
                if a != b:
                    out.append((i, j))
                    if len(held[a]) < len(held[b]):
                        a, b = b, a
                    group[held[b]] = a
                    held[a] += held.pop(b)
            found = found[256:]
        mark[s] = False
        for t in near:
            index[t].append(i)
    return out


def _sets(rows: list[tuple], words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, sorted shingle hashes) of the rows (..., rep, set, text) whose text has the set's digest: an id may occur again
    with another text."""
    texts = [(r[-1] or "").encode() for r in rows]
    for a, z in by_size(texts):
        h, offs = word_hashes(texts[a:z], lower=True)
        v, d = shingle_hashes(h, offs, words)
        at = np.searchsorted(d, np.arange(z - a + 1))
        for k in range(z - a):
            s = v[at[k] : at[k + 1]]
            if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == bytes(rows[a + k][-2]):
                yield a + k, s


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of each run of equal first `keys` columns, as they come."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, key=lambda r: r[:keys])


def _pair_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def hub_links(ties: DataFrame, members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between each member and the hub it is tied to most often; the members of a hub are dealt in parts of
    about BLOCK shingles, each with the hub's text first."""
    count = ties.join(members.select(F.col("rep").alias("a"), "n_shingles"), "a").groupBy("a", "b", "n_shingles").agg(F.count("*").alias("n"))
    spoke = count.groupBy("a", "n_shingles").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("hub"))
    size = spoke.groupBy("hub").agg(F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("parts"))
    spokes = spoke.join(size, "hub").select("hub", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("a").alias("rep"))
    hubs = size.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("hub").alias("rep"))
    rows = spokes.unionByName(hubs).join(members.select("rep", "set"), "rep").join(texts, "rep").select("hub", "part", "kind", "rep", "set", "text")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (hub, _), rows in _runs(batches, 2):
            base, held, size, found = None, [], 0, []

            def solve(held: list[tuple], base: np.ndarray, hub: int = hub) -> Iterator[tuple[int, int]]:
                for k, s in _sets(held, words):
                    common = len(np.intersect1d(base, s, assume_unique=True))
                    if 100 * common >= percent * (len(base) + len(s) - common):
                        yield hub, held[k][3]

            for r in rows:
                if r[2] == 0:
                    if base is None:
                        base = next((s for _, s in _sets([r], words)), None)
                    continue
                held.append(r)
                size += len(r[-1] or "")
                if size > 1 << 20:
                    found += solve(held, base)
                    held, size = [], 0
            yield _pair_batch(found + list(solve(held, base)))

    return rows.repartition(n, "hub", "part").sortWithinPartitions("hub", "part", "kind", "rep").mapInArrow(run, "a long, b long")


def verified(spark: SparkSession, members: DataFrame, ties: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) within clusters that connect what all links connect. members: (rep, set, cluster, n_shingles)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    total = members.groupBy("cluster").agg(F.sum("n_shingles").alias("total"))
    sized = members.join(total, "cluster")
    small = sized.where(F.col("total") <= BLOCK).select("cluster", "rep", "set", F.col("rep").alias("label"), F.lit(0).alias("block"), F.array(F.lit(0)).alias("with"))
    large = materialize(spark, sized.where(F.col("total") > BLOCK).drop("total"), "large")
    near = materialize(spark, hub_links(ties.join(large.select(F.col("rep").alias("a")), "a", "left_semi"), large, texts, words, percent), "hub-links")
    named = large.join(components(spark, near).select(F.col("id").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    parts = named.groupBy("cluster", "label").agg(F.sum("n_shingles").alias("n"))
    main = parts.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("k"), F.sum("n").alias("all"), F.max("n").alias("most")).where("k > 1")
    rest, whole = F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int"), F.ceil(F.col("most") / BLOCK).cast("int")
    split = named.join(main.select("cluster", "main", rest.alias("r"), whole.alias("m")), "cluster")
    # Blocks 0 to r - 1 hold the rest, those from r on the largest component.
    inside = F.col("label") == F.col("main")
    block = F.when(inside, F.col("r") + F.pmod(F.xxhash64("rep"), F.col("m"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("r"))).cast("int")
    other = F.when(inside, F.sequence(F.lit(0), F.col("r") - 1)).otherwise(F.sequence(F.lit(0), F.col("r") + F.col("m") - 1))
    placed = small.unionByName(split.select("cluster", "rep", "set", "label", block.alias("block"), other.alias("with")))
    pairs = texts.join(placed, "rep").withColumn("with", F.explode("with")).select(
        "cluster", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), (F.col("block") > F.col("with")).cast("int").alias("side"), "label", "rep", "set", "text"
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in _runs(batches, 3):
            held, sets, seen = [], [], set()
            rows = list(rows)
            for k, s in _sets(rows, words):
                if rows[k][5] not in seen:
                    seen.add(rows[k][5])
                    held.append(rows[k])
                    sets.append(s)
            if len(sets) > 1:
                found = links(sets, percent, None if i == j else [r[3] for r in held], [r[4] for r in held])
                yield _pair_batch([(held[x][5], held[y][5]) for x, y in found])

    return near.union(dealt.mapInArrow(run, "a long, b long"))


def groups(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row. component_id is the smallest doc_id that links reach."""
    seen = materialize(spark, marks(docs, words, percent), "marks")
    some = seen.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(spark, some.groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "classes")
    keyed = classes.select("rep", F.explode("bands").alias("band"))
    least = keyed.groupBy("band").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    ties = materialize(spark, keyed.join(least, "band").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")), "ties")
    clusters = components(spark, ties)
    members = classes.select("rep", "set", "n_shingles").join(clusters.select(F.col("id").alias("rep"), F.col("label").alias("cluster")), "rep")
    found = components(spark, verified(spark, members, ties, docs, words, percent))
    least = found.groupBy("label").agg(F.min("id").alias("component_id"))
    linked = found.join(least, "label").select(F.col("id").alias("rep"), "component_id")
    known = classes.select("set", "rep").join(linked, "rep", "left").select("set", F.coalesce("component_id", "rep").alias("c"))
    out = seen.select("doc_id", "n_shingles", "set").join(known, "set", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("c"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
