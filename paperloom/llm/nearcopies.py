"""Near copies by SimHash of five-word shingles, links confirmed by exact similarity.

A text is the set of the 64-bit hashes of its shingles, of ``SHINGLE`` words each. Two
texts are linked if their sets have a Jaccard similarity of ``LEAST`` or more. Candidates
are found by SimHash: a bit of a set's fingerprint is set where over half of its shingles'
hashes have it (of just half, where the least shingle's has it). A fingerprint has
``BLOCKS`` blocks of ``BITS`` bits, 2,080 bits in all, as 64 bits tell texts of similarity
0.8 (ten bits apart on average) from others too badly.
Distinct sets meet under each block's value, are compared by XOR and bit count over the
fingerprint's head, within a Hamming radius, and are joined to groups by connected
components.

Fingerprints that differ in fewer bits than there are blocks agree on a block, so they
meet for certain. Beyond that the number of blocks decides: at similarity 0.8 a bit
differs with probability 0.152 (0.162 in the worst of short texts, 0.188 for 8 words of
9), so a pair meets under no block with probability (1 - 0.848 ** 13) ** 160 = 2e-9
(4e-8, 1.5e-5), and closer pairs more rarely. The radii are six standard deviations or
more above those means.

A group's sets then meet in one task, where a walk compares each set with those that are
not reached yet: all links count, and every component of the exact similarity is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .shared import batch, free, lean, released, reused, stored, sweep, texts

SHINGLE = 5
LEAST = (4, 5)
SEED = 42
#: Bits of a block, which has 16 bits' room, and 64-bit words of a fingerprint, of four blocks each.
BITS, WORDS = 13, 40
BLOCKS = 4 * WORDS
#: (words, bits): fingerprints are near if so many of their first words differ in at most so many bits, of 52 a word.
RADII = ((3, 62), (5, 88))
#: Blocks whose rows are shuffled at once, fingerprints of one block that meet in a run of rows, and of one value that are compared in one go.
PASS, MEET, CROWD = 40, 1 << 17, 64
_AT_ONCE, _CELLS = 1 << 9, 1 << 16
_HEAD = RADII[-1][0]
_MET = np.dtype([("value", "<u2"), ("fp", "<i8"), ("head", "<u8", (_HEAD,))])
_rng = np.random.default_rng(SEED)
_ODD = _rng.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LIVE = np.uint64(0x0001000100010001 * ((1 << BITS) - 1))


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; of fewer words, the whole; of no words, none."""
    words = (text or b"").lower().split()  # as simhash.fingerprint has them
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, size: at + 1 + size))
    starts = [0, *(e + 1 for e in ends[:-1])]
    last, digest = ends[min(shingle, len(words)) - 1 :], xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(flat[s:e], SEED) for s, e in zip(starts, last, strict=False)]), ">u8").astype(np.uint64))


def print_of(some: np.ndarray) -> int:
    """A set's signed 64-bit hash."""
    return int(np.uint64(xxhash.xxh64_intdigest(some.tobytes(), SEED)).view(np.int64))


def hashes(some: np.ndarray) -> np.ndarray:
    """WORDS hashes of each shingle of a set, of 64 bits."""
    found = some[:, None] * _ODD + _ADD
    found ^= found >> np.uint64(32)
    found *= _MIX
    found ^= found >> np.uint64(29)
    return found


def fingerprint(some: np.ndarray) -> np.ndarray:
    """An ordered set's SimHash in WORDS words: the blocks' bits that over half of its shingles' hashes have; of just half, the first's decides."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(some), 255):  # so many fit a byte
        counts += np.unpackbits(hashes(some[at : at + 255]).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    first = np.unpackbits(hashes(some[:1]).view(np.uint8)) if len(some) else 0
    return np.packbits(2 * counts + first > len(some)).view(np.uint64) & _LIVE


def _apart(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The number of bits in which pairs of words differ, 52 a word at most."""
    x, y = next(pairs)
    found = np.bitwise_count(x ^ y)
    for k, (x, y) in enumerate(pairs, 2):
        found = (found if k < 5 else found.astype(np.uint16)) + np.bitwise_count(x ^ y)
    return found


def _near_to(head: np.ndarray, some: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) where the fingerprints at some[a] and others[b] are near."""
    (few, least), (words, most) = RADII
    own, rest = head[:few, some], head[:few].take(others, axis=1)
    a, b = np.nonzero(_apart((x[:, None], y) for x, y in zip(own, rest, strict=True)) <= least)
    near = _apart((x.take(some[a]), x.take(others[b])) for x in head[:words]) <= most
    return a[near], b[near]


def _walked(head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints (words, fingerprints): from each to the first that reaches it. Each is compared with those not reached yet."""
    left, ups, downs = np.arange(head.shape[1]), [np.zeros(0, int)], [np.zeros(0, int)]
    while len(left):
        starts = left[: max(1, _CELLS // len(left))]
        a, b = _near_to(head, starts, left)
        linked = a[a < b]
        if not len(linked):
            left = left[len(starts) :]
            continue
        waiting, left = left[linked.min() :][:1], left[linked.min() + 1 :]
        first = waiting[0]
        while len(waiting) and len(left):
            some = max(1, _CELLS // len(left))
            reached = np.unique(_near_to(head, waiting[:some], left)[1])
            ups.append(left[reached])
            downs.append(np.full(len(reached), first))
            waiting, left = np.concatenate([waiting[some:], left[reached]]), np.delete(left, reached)
    return np.concatenate(ups), np.concatenate(downs)


def _paired(value: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All near pairs of fingerprints (words, fingerprints) of the same value; values are in order."""
    at, ups, downs = np.arange(len(value)), [np.zeros(0, int)], [np.zeros(0, int)]
    for step in range(1, len(value)):
        at = at[: np.searchsorted(at, len(value) - step)]
        at = at.compress(value.take(at + step) == value.take(at))
        if not len(at):
            break
        near = at
        for words, most in RADII:
            near = near.compress(_apart((head[k].take(near), head[k].take(near + step)) for k in range(words)) <= most)
        ups.append(near + step)
        downs.append(near)
    return np.concatenate(ups), np.concatenate(downs)


def met_links(met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least) for rows of _MET of one block: those that near fingerprints of the same value join, as a star forest."""
    met = met[np.argsort(met["value"], kind="stable")]
    value, head = met["value"], np.ascontiguousarray(met["head"].T)
    cuts = np.flatnonzero(np.diff(value, prepend=-1, append=-1))
    found, usual = [], np.ones(len(value), bool)
    for s, e in zip(cuts, cuts[1:], strict=False):
        if e - s > CROWD:
            usual[s:e] = False
            found.append([s + x for x in _walked(head[:, s:e])])
    places = np.flatnonzero(usual)
    found.append([places[x] for x in _paired(value[places], head.take(places, axis=1))])
    return forest(*(met["fp"][np.concatenate(x)] for x in zip(*found, strict=True)))


def roots(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the place of the first one it is linked with, directly or through others."""
    sizes = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    cuts = np.cumsum([0, *sizes])
    order = np.argsort(flat, kind="stable")
    held = owner[order]  # the sets that have a value, value by value, as far as they are not reached
    firsts = np.searchsorted(flat[order], np.arange(len(values) + 1))
    root, left, kept = np.full(len(sets), -1), len(sets), len(sets)
    for start in range(len(sets)):
        if root[start] >= 0:
            continue
        root[start], waiting, left = start, [start], left - 1
        while waiting and left:
            k = waiting.pop()
            own = flat[cuts[k] : cuts[k + 1]]
            both = np.bincount(np.concatenate([held[firsts[v] : firsts[v + 1]] for v in own] or [held[:0]]), minlength=len(sets))
            near = np.flatnonzero((root < 0) & (LEAST[1] * both >= LEAST[0] * (sizes[k] + sizes - both)))
            root[near] = start
            waiting += near.tolist()
            left -= len(near)
            if 2 * left < kept:
                kept, free = left, root[held] < 0
                firsts = np.concatenate([[0], np.cumsum(free)])[firsts]
                held = held[free]
    return root


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices, as sets take more memory than their texts."""
    for b in batches:
        for at in range(0, b.num_rows, _AT_ONCE):
            yield b.slice(at, _AT_ONCE)


def _sized(docs: DataFrame) -> DataFrame:
    """(doc_id, told, fp, bits) for each row of docs (doc_id, told, text): fp is its set's own hash, bits the fingerprint."""
    schema = pa.schema([("doc_id", pa.int64()), ("told", pa.int64()), ("fp", pa.int64()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            sets = [shingles(x) for x in texts(b.column(2))]
            yield batch(schema, {"doc_id": b.column(0), "told": b.column(1), "fp": [print_of(s) for s in sets], "bits": [fingerprint(s).tobytes() for s in sets]})

    return docs.mapInArrow(released(run), "doc_id long, told long, fp long, bits binary")


def _near(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between the fp of nodes (fp, bits), distinct by fp, whose closure links all that are near and agree on a block."""
    parts = min(1 << BITS, max(8, -(-nodes.count() // MEET)))
    met = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("rows", pa.binary())])
    edges = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def dealt(blocks: range, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, words = np.empty(b.num_rows, _MET), np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(-1, WORDS)
            values, rows["fp"], rows["head"] = words.view(np.uint16), b.column(0).to_numpy(), words[:, :_HEAD]
            for block in blocks:
                rows["value"] = values[:, block]
                part = rows["value"] % parts
                order = np.argsort(part, kind="stable")
                own, cuts = rows[order], np.searchsorted(part[order], np.arange(parts + 1))
                some = np.flatnonzero(np.diff(cuts))
                yield batch(met, {"block": np.full(len(some), block), "part": some, "rows": [own[cuts[k] : cuts[k + 1]].tobytes() for k in some]})

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, some in groupby(rows, key=lambda row: row[:2]):
            yield batch(edges, dict(zip("ab", met_links(np.frombuffer(b"".join(row[2] for row in some), _MET)), strict=True)))

    found = None
    for at in range(0, BLOCKS, PASS):
        rows = nodes.mapInArrow(partial(dealt, range(at, min(BLOCKS, at + PASS))), "block int, part int, rows binary")
        rows = rows.repartition("block", "part").sortWithinPartitions("block", "part")
        links = stored(rows.mapInArrow(released(compared), "a long, b long").distinct(), "near")
        sweep(nodes.sparkSession)
        found = links if found is None else found.union(links)
    return found


def _linked(members: DataFrame) -> DataFrame:
    """(fp, root) for each distinct fp of members (component, fp, text)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("component", pa.int64()), ("fp", pa.int64()), ("own", pa.binary())])
        for b in _parts(batches):
            yield batch(schema, {"component": b.column(0), "fp": b.column(1), "own": [shingles(x).tobytes() for x in texts(b.column(2))]})

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("fp", pa.int64()), ("root", pa.int64())])
        for fps, own in _grouped(batches):
            yield batch(schema, {"fp": fps, "root": fps[roots(own)]})

    sets = members.mapInArrow(released(hashed), "component long, fp long, own binary")
    return sets.repartition("component").sortWithinPartitions("component", "fp").mapInArrow(released(walked), "fp long, root long")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(fps, sets), each fp once, of each run of rows with the same component."""
    at, held = None, {}
    for b in _parts(batches):
        for component, fp, own in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if component != at and held:
                yield np.array(list(held), np.int64), list(held.values())
                held = {}
            at = component
            held[fp] = np.frombuffer(own, np.uint64)
    if held:
        yield np.array(list(held), np.int64), list(held.values())


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that stand for their class: one row of each component of linked texts.

    It is the row of the smallest doc_id, and of rows that repeat it the least by a hash of
    the whole row. Rows without a doc_id have no say in a class and stay.
    """
    lean(docs.sparkSession)
    name = free(docs, "told")
    told = docs.withColumn(name, F.xxhash64(*docs.columns))
    rows = told.filter("doc_id IS NOT NULL")
    texts_by = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).alias("told"), "text")
    prints = _sized(texts_by)
    nodes = reused(prints.groupBy("fp").agg(F.min(F.struct("doc_id", "told")).alias("least"), F.first("bits").alias("bits")))
    near = reused(components(_near(nodes.select("fp", "bits"))))
    near = near.union(near.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("node", "fp")
    texts_of = nodes.select("fp", "least.*").join(near, "fp")
    members = texts_by.join(texts_of, ["doc_id", "told"]).select("component", "fp", "text")
    linked = nodes.select("fp", "least").join(_linked(members), "fp", "left")
    chosen = linked.groupBy(F.coalesce("root", "fp")).agg(F.min("least").alias("least")).select("least.*")
    chosen = chosen.toDF("__id", "__told").alias("c")
    kept = rows.alias("r").join(chosen, (F.col("r.doc_id") == F.col("c.__id")) & (F.col(f"r.{name}") == F.col("c.__told")), "left_semi").dropDuplicates(["doc_id", name])
    return kept.unionByName(told.filter("doc_id IS NULL")).drop(name)
