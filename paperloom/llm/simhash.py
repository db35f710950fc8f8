"""SimHash near-duplicates with pigeonhole blocks.

A text's fingerprint has a bit set where over half of its shingle hashes have it.
Two fingerprints that differ in at most ``bits`` places agree on at least
``blocks - bits`` of the blocks they are cut into, so they meet under at least one
key made of that many blocks. Texts with the same fingerprint are one node from the
start, keys are joined between distinct fingerprints only, and a key's members are
compared by XOR and bit count; each key yields a spanning forest of its links rather
than all pairs.

A key with more than ``CROWD`` fingerprints is cut once more by the same rule: its members
agree on the key's bits, so close pairs among them agree on enough of the blocks that the
other bits are cut into. Each such step leaves half of the bits open that the step before
left, so a key's members are bounded whatever the table holds: at most 2 ** 8 distinct
fingerprints after two steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import batch, free, lean, reused, texts

SHINGLE = 3
SEED = 42
BITS = 2
BLOCKS = 4
CROWD = 2048
HOT = 1000
_HASHED_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of UTF-8 text; 0 for none, or no words."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and splits at 20 and 09-0D
    if not words:
        return 0
    if len(words) <= shingle:
        hashes, n = [xxhash.xxh64_digest(b" ".join(words), seed)], 1
        return int(np.frombuffer(hashes[0], ">u8").astype("<u8").view("<i8")[0])
    flat = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, size: at + 1 + size))
    starts = [0, *(e + 1 for e in ends[:-1])]
    n, counts, digest = len(words) - shingle + 1, np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, n, _HASHED_AT_ONCE):
        spans = zip(starts[at : min(n, at + _HASHED_AT_ONCE)], ends[at + shingle - 1 :], strict=False)
        hashed = np.frombuffer(b"".join([digest(flat[s:e], seed) for s, e in spans]), np.uint8)
        counts += np.unpackbits(hashed.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">u8").astype("<u8").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; a null text has fingerprint 0."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, {"doc_id": b.column(0).cast(pa.int64()), "fp": [fingerprint(x) for x in texts(b.column(1))]})

    return rows.mapInArrow(run, "doc_id long, fp long")


def masks_of(bits: int, blocks: int, within: int = 0) -> list[int]:
    """Masks of the bits on which a close pair may agree that agrees on those of ``within``, one for each choice of blocks of the others."""
    rest = [1 << k for k in range(64) if not within >> k & 1]
    edges = [round(len(rest) * k / blocks) for k in range(blocks + 1)]
    parts = [sum(rest[lo:hi]) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [within | sum(chosen) for chosen in combinations(parts, blocks - bits)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _forest(fps: np.ndarray, reps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links from each member of a linked group to the group's first member."""
    n = len(fps)
    label = np.arange(n)
    fps = fps.view(np.uint64)
    step = max(1, (1 << 22) // n)
    near = [np.bitwise_count(fps[i : i + step, None] ^ fps[None, :]) <= bits for i in range(0, n, step)]
    while True:
        new = np.concatenate([np.where(x, label[None, :], n).min(axis=1) for x in near])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return list(zip(reps[moved].tolist(), reps[label[moved]].tolist(), strict=True))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fps, reps) of each run of rows with the same (mask, key)."""
    held: list[np.ndarray] = []
    for b in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
        rows = np.concatenate([*held, rows]) if held else rows
        if not len(rows):
            continue
        cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist(), len(rows)]
        for s, e in zip(bounds[:-2], bounds[1:-1], strict=True):
            yield rows[s:e, 2], rows[s:e, 3]
        held = [rows[bounds[-2] :]]
    if held:
        yield held[0][:, 2], held[0][:, 3]


def _compare(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    found: list[tuple[int, int]] = []
    for fps, reps in _grouped(batches):
        found += _forest(fps, reps, bits) if len(fps) > 1 else []
        if len(found) > 50_000:
            yield batch(schema, dict(zip("ab", zip(*found, strict=True), strict=True)))
            found = []
    if found:
        yield batch(schema, dict(zip("ab", zip(*found, strict=True), strict=True)))


def links(nodes: DataFrame, bits: int = BITS, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between the ``rep`` of nodes (fp, rep), distinct by fp, whose closure links all pairs within ``bits``."""
    spark, found = nodes.sparkSession, None
    masks = masks_of(bits, blocks)
    keyed = nodes.select("fp", "rep", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    while True:
        keyed = keyed.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "rep")
        sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
        met = reused(keyed.join(sizes, ["mask", "key"]))
        finest = max(64 - m.bit_count() for m in masks) <= 2 * blocks  # so few bits are open that no key is a crowd
        usual = met if finest else met.filter(F.col("n") <= crowd)
        usual = usual.select("mask", "key", "fp", "rep").repartition("mask", "key").sortWithinPartitions("mask", "key", "rep")
        edges = usual.mapInArrow(lambda batches: _compare(batches, bits), "a long, b long")
        found = edges if found is None else found.union(edges)
        crowded = met.filter(F.col("n") > crowd)
        if finest or crowded.isEmpty():
            return found
        finer = {m: masks_of(bits, blocks, m) for m in masks}
        table = spark.createDataFrame([(_signed(m), _signed(n)) for m, some in finer.items() for n in some], "mask long, finer long")
        masks = sorted({n for some in finer.values() for n in some})
        # one key may be reached from several; it is compared once
        keyed = crowded.join(F.broadcast(table), "mask").select("fp", "rep", F.col("finer").alias("mask")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    component_id is the smallest doc_id reachable through fingerprints that differ in
    at most two bits, itself included. Null, empty and blank texts have fingerprint 0
    and link like any other. Rows that repeat a doc_id are each returned; a null
    doc_id keeps its row, with the component of its fingerprint. Other columns of
    docs are ignored, and an empty table gives an empty result.
    """
    lean(docs.sparkSession)
    prints = reused(fingerprints(docs, doc_id, text))
    nodes = reused(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    merged = components(links(nodes.filter("rep IS NOT NULL"), crowd=crowd))
    classes = reused(nodes.join(merged, nodes.rep == merged.node, "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id")))
    # rows of a hot fingerprint stay where they are: fewer than HOT fingerprints have more than a HOTth of all rows, and those are broadcast
    share = (nodes.agg(F.sum("n")).first()[0] or 0) / HOT
    hot, cold = (classes.filter(test).drop("n") for test in (F.col("n") > share, F.col("n") <= share))
    found = prints.join(F.broadcast(hot), "fp").unionByName(prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(cold, "fp"))
    return found.select("doc_id", "fp", "component_id")


def hexed(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def first_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that stand for their class in classes: one row of each component.

    It is the row of the smallest doc_id. Rows that repeat that doc_id are copies if they have
    the same fingerprint: the least by a hash of the whole row stays, so that reruns agree. With
    other fingerprints each stays that is in a class of that smallest doc_id. Rows without a
    doc_id have no say in a class and stay.
    """
    lean(docs.sparkSession)
    told, fp = free(docs, "told"), free(docs, "fp")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([fingerprint(x) for x in texts(b.column(at))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, prints], names=[*b.schema.names, fp])

    rows = docs.filter("doc_id IS NOT NULL").mapInArrow(run, docs.withColumn(fp, F.lit(0).cast("long")).schema).withColumn(told, F.xxhash64(*docs.columns))
    ids = rows.select(F.col("doc_id").alias("id"), F.col(fp).alias("own"), F.col(told).alias("h"))
    chosen = classes.filter("doc_id = component_id").select(F.col("doc_id").alias("id"), F.col("fp").alias("own")).distinct()
    least = ids.join(chosen, ["id", "own"]).groupBy("id", "own").agg(F.min("h").alias("h")).toDF("__id", "__own", "__h")
    kept = rows.join(least, (F.col("doc_id") == F.col("__id")) & (F.col(fp) == F.col("__own")) & (F.col(told) == F.col("__h")), "left_semi")
    return kept.dropDuplicates(["doc_id", fp]).select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
