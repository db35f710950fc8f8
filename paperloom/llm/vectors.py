"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Vectors of the same label are compared where they share the signs of ``n_bits``
hyperplanes in at least one of ``n_tables`` tables. Both numbers follow from the size of
the largest label: as many bits as leave about ``PER_BUCKET`` of its vectors to a bucket,
and as many tables as miss a pair at the threshold with a chance of at most ``MISS``.

Equal vectors are one node with a count. A row carries its signs in all tables, so a pair
counts in the first table in which it meets and nowhere else: links are counted as they
are verified, and a bucket sends on a count for each vector and a spanning forest, never
its pairs. A bucket of more than ``CROWD`` vectors is cut into parts, and every two parts
are compared in a task of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import reused

THRESHOLD = 0.98
PER_BUCKET = 64
MISS = 1e-5
MOST_BITS = 28
CROWD = 4096
SEED = 7


def plan(largest: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(n_bits, n_tables) for a label of largest vectors."""
    bits = min(MOST_BITS, max(4, math.ceil(math.log2(max(1, largest) / PER_BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - meet))


def signs(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """For each vector, its signs in each table as an integer."""
    planes = np.random.RandomState(SEED).standard_normal((tables * bits, vectors.shape[1]))
    return ((vectors @ planes.T > 0).reshape(len(vectors), tables, bits) << np.arange(bits)).sum(axis=2).astype(np.int32)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows of (vec_id, label, embedding) that can link, as doubles."""
    doubles = F.col("embedding").cast("array<double>")
    fine = ~F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))) & F.exists(doubles, lambda x: x != 0)
    return vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "label", doubles.alias("v")).filter(fine)


def _compared(rows: dict[str, np.ndarray], threshold: float) -> pa.RecordBatch:
    """For the rows that meet in one bucket of one table: (rep, links, root) of each vector that has links."""
    table, v, meets, weight, side, rep = int(rows["table"][0]), rows["v"], rows["signs"], rows["n"], rows["side"], rows["rep"]
    v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    n = len(v)
    linked = np.zeros((n, n), bool)
    for s in range(0, n, _STRIPE):
        near = v[s : s + _STRIPE] @ v.T >= threshold
        # parts other than the two of a pair of parts, and pairs met in an earlier table, count elsewhere
        near &= (side[s : s + _STRIPE, None] != side[None, :]) | (side[s : s + _STRIPE, None] == 0)
        for t in range(table):
            near &= meets[s : s + _STRIPE, t, None] != meets[None, :, t]
        linked[s : s + _STRIPE] = near
    np.fill_diagonal(linked, False)
    links = linked @ weight
    label = np.arange(n)
    while True:
        least = [np.where(linked[s : s + _STRIPE], label[None, :], n).min(axis=1) for s in range(0, n, _STRIPE)]
        new = np.minimum(label, np.concatenate(least))
        new = new[new]
        if (new == label).all():
            break
        label = new
    has = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (rep[has], links[has], rep[label[has]])], schema=_LINKS)


_LINKS = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
_KEY = ("label", "table", "bucket", "pair")
#: Rows of a comparison at once.
_STRIPE = 256
#: Rows taken from Arrow at once.
_TAKEN = 1000


def _arrays(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns as arrays; lists, all of one length, as matrices."""
    flat = {k: b.column(k) for k in b.schema.names}
    return {k: np.array(c.flatten()).reshape(b.num_rows, -1) if pa.types.is_list(c.type) else np.array(c) for k, c in flat.items()}


def _links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a key's rows are compared when the next key begins."""
    held: dict[str, np.ndarray] = {}
    for b in batches:
        for at in range(0, b.num_rows, _TAKEN):
            more = _arrays(b.slice(at, _TAKEN))
            held = {k: np.concatenate([held[k], x]) for k, x in more.items()} if held else more
            keys = np.stack([held[k] for k in _KEY], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e - s > 1:
                    yield _compared({k: x[s:e] for k, x in held.items()}, threshold)
            held = {k: x[cuts[-1] :] for k, x in held.items()}
    if held and len(held["rep"]) > 1:
        yield _compared(held, threshold)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Only rows with equal, non-null labels are compared. A vector that is null, empty, all
    zero, or has a null or non-finite component has no links, and neither has one of
    another length than its label's others (they are compared by length). A null vec_id
    has no links, no component and kept is null. Rows that repeat a vec_id share one
    component, and each of them counts. An empty table gives an empty result.
    """
    good = reused(usable(vectors))
    nodes = reused(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    shapes = {r[0]: r[1] for r in nodes.groupBy("label", F.size("v").alias("d")).count().groupBy("d").agg(F.max("count")).collect()}
    edges = None
    for size, largest in sorted(shapes.items()):
        bits, tables = plan(largest, threshold)
        found = _found(nodes.filter(F.size("v") == size), bits, tables, threshold, crowd)
        edges = found if edges is None else edges.union(found)
    ids = vectors.select("vec_id")
    if edges is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    edges = reused(edges)
    merged = components(edges, "rep", "root").select(F.col("node").alias("rep"), "component")
    counts = edges.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = nodes.join(counts, "rep", "left").join(merged, "rep", "left")
    classes = classes.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    member = good.join(classes, ["label", "v"]).groupBy("vec_id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    joined = ids.join(member, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def _found(nodes: DataFrame, bits: int, tables: int, threshold: float, crowd: int) -> DataFrame:
    """(rep, links, root) of verified links between nodes (label, v, rep, n) of one length."""
    schema = pa.schema([("label", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("v", pa.list_(pa.float64())), ("signs", pa.list_(pa.int32()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column(3).flatten()).reshape(b.num_rows, -1)
            if len(v):
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(signs(v, bits, tables).tolist(), schema.field(4).type)], schema=schema)

    rows = nodes.select(F.col("label").cast("long").alias("label"), "rep", F.col("n").cast("long").alias("n"), "v")
    signed = reused(rows.mapInArrow(sign, "label long, rep long, n long, v array<double>, signs array<int>"))
    keyed = signed.select("label", "rep", F.posexplode("signs").alias("table", "bucket"))
    sizes = keyed.groupBy("label", "table", "bucket").agg(F.count("*").alias("met")).filter("met > 1")
    met = keyed.join(sizes, ["label", "table", "bucket"]).withColumn("n_parts", F.ceil(F.col("met") / crowd).cast("int"))
    # part p of k meets itself (pair p, p; side 0) and each other part (sides 1 and 2)
    part = F.pmod(F.xxhash64("rep"), F.col("n_parts")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("n_parts") - 1),
        lambda q: F.struct((F.least(q, F.col("part")) * F.col("n_parts") + F.greatest(q, F.col("part"))).alias("pair"), F.when(q == F.col("part"), 0).when(F.col("part") < q, 1).otherwise(2).alias("side")),
    )
    dealt = met.withColumn("part", part).select("label", "table", "bucket", "rep", F.explode(pairs).alias("p")).select("label", "table", "bucket", "p.pair", "p.side", "rep")
    full = dealt.join(signed.select("rep", "n", "v", "signs"), "rep").select(*_KEY, "side", "rep", "n", "v", "signs")
    sorted_ = full.repartition(*_KEY).sortWithinPartitions(*_KEY, "rep")
    return sorted_.mapInArrow(lambda batches: _links(batches, threshold), "rep long, links long, root long")
