"""Repeated byte strings by prefix-free parsing, with suffix orders to the depth of one string.

Every string of ``length`` bytes has a trigger: the ``TRIGGER``-byte window in it whose
rolling hash is least (the leftmost of equals). A phrase is a run of starts whose strings
have the same trigger, so phrases depend on content alone, and two equal strings have
equal triggers at equal places. The dictionary is the set of distinct phrases with the
bytes that their strings reach, addressed by 128-bit cryptographic digests of those bytes;
it has one entry for all copies of a passage.

A phrase that occurs twice is repeated as a whole, and one whose trigger occurs nowhere
else isn't repeated at all. The rest, phrases that share a trigger with other phrases, are
sorted into corpus order twice: by the bytes before the trigger, backwards (the
dictionary's order), and by those from it on (the parse's order, as deep as a string
reaches). Both are range sorts over all tasks with the bytes themselves as keys, so the
phrases of one hot trigger spread like any others. Neighbours' longest common prefixes in
the two orders give, for a string with d bytes before its trigger:

* it is repeated if some neighbour shares d bytes before and length - d from the trigger on;
* it is not if no neighbour of the first order shares d, or none of the second length - d.

The few strings that neither settles are told apart by digests of their bytes, among all
strings of their triggers that the second rule lets pass.

Only triggers' hashes and places are shuffled for whole texts, about one in 85 bytes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, lean, released, reused, stored, sweep, texts

LENGTH = 200
TRIGGER = 32
#: Starts parsed at once; a longer text is parsed in such parts, which at worst cuts a phrase in two.
PARSED_AT_ONCE = 1 << 18
#: Phrases that make a batch.
SENT_AT_ONCE = 20_000
_PLACE = (1 << 21) - 1
_U = np.uint64
_BASE, _MIX = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random odd number for each byte; powers of the base and of its inverse."""
    codes = np.random.RandomState(11).randint(0, 1 << 62, 256).astype(np.uint64) * _U(2) + _U(1)
    n = PARSED_AT_ONCE + 4 * LENGTH + 1
    inverse = _U(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return codes, np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _MIX
    return x ^ (x >> _U(29))


def parse(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(trigger, first, last, a) of each phrase: places in text, starts [first, last], and the trigger's hash."""
    runs = [_parse(np.frombuffer(text, np.uint8, min(len(text) - at, PARSED_AT_ONCE + length - 1), at), at, length) for at in range(0, len(text) - length + 1, PARSED_AT_ONCE)]
    return tuple(np.concatenate(x) for x in zip(*runs, strict=True)) if runs else tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64))


def _parse(data: np.ndarray, at: int, length: int) -> tuple[np.ndarray, ...]:
    codes, up, down = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * up[: len(data)], out=sums[1:])
    hashes = _mixed((sums[TRIGGER:] - sums[:-TRIGGER]) * down[: len(sums) - TRIGGER])
    least = hashes & ~_U(_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    wide, span = length - TRIGGER + 1, 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    place = (least & _U(_PLACE)).astype(np.int64)
    first = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(place[1:] != place[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, np.array([len(place) - 1])])
    x = place[first]
    return x + at, first + at, last + at, hashes[x]


def digest(some: bytes) -> bytes:
    return hashlib.blake2b(some, digest_size=16).digest()


def marked(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with __h, a hash of the text: doc_id and __h tell rows apart as far as their texts differ."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("__h", F.xxhash64("text"))


#: A phrase's place in its text: the trigger's, and the numbers of starts before it and of starts less one, packed.
def _packed(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return x << 16 | x - first << 8 | last - first


_X, _BEFORE, _AFTER = "shiftright(at, 16)", "cast(shiftright(at, 8) & 255 AS int)", "cast(at & 255 AS int)"
_PHRASES = pa.schema([(k, pa.int64()) for k in ("doc_id", "h", "a", "e1", "e2", "at")])


def phrases(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """A row for each phrase of marked docs: (doc_id, h, a, e1, e2, at).

    a is the hash of its trigger, e1 and e2 the digest of its bytes, at its packed place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[tuple[np.ndarray, ...]], ids: list, marks: list, digests: list[bytes]) -> pa.RecordBatch:
            x, first, last, a = (np.concatenate(c) for c in zip(*parts, strict=True))
            sizes = [len(p[0]) for p in parts]
            e = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            known = np.repeat([i is None for i in ids], sizes)
            columns = [pa.array(np.repeat([i or 0 for i in ids], sizes), pa.int64(), mask=known), pa.array(np.repeat(marks, sizes), pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(c) for c in (a.view(np.int64), e[:, 0], e[:, 1], _packed(x, first, last)))], schema=_PHRASES)

        parts, ids, marks, digests = [], [], [], []
        for b in batches:
            for doc_id, mark, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), texts(b.column(1)), strict=True):
                if text is None or len(text) < length:
                    continue
                parts.append(parse(text, length))
                ids.append(doc_id)
                marks.append(mark)
                digests += [digest(text[s : e + length]) for s, e in zip(parts[-1][1].tolist(), parts[-1][2].tolist(), strict=True)]
                if len(digests) >= SENT_AT_ONCE:
                    yield out(parts, ids, marks, digests)
                    parts, ids, marks, digests = [], [], [], []
        if parts:
            yield out(parts, ids, marks, digests)

    rows = docs.select("doc_id", "text", "__h").filter(F.octet_length("text") >= length)
    return rows.mapInArrow(released(run), "doc_id long, h long, a long, e1 long, e2 long, at long")


_ASKED = "a long, open boolean, doc_id long, h long, x long, before int, after int, back binary, ahead binary"
_ASKED_SCHEMA = pa.schema([("a", pa.int64()), ("open", pa.bool_()), ("doc_id", pa.int64()), ("h", pa.int64()), ("x", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("back", pa.binary()), ("ahead", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of asked phrases: before the trigger, the last first, and from the trigger on."""
    for b in batches:
        for doc_id, h, text, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), b.column(3), strict=True):
            flat = pa.RecordBatch.from_struct_array(asked.values)
            for at in range(0, flat.num_rows, SENT_AT_ONCE):
                part = flat.slice(at, SENT_AT_ONCE)
                x, before, after = (part.column(k).to_pylist() for k in ("x", "before", "after"))
                columns = [part.column("a"), part.column("open"), pa.array([doc_id] * len(x), pa.int64()), pa.array([h] * len(x), pa.int64()), part.column("x"), part.column("before"), part.column("after")]
                columns += [pa.array([text[p - q : p][::-1] for p, q in zip(x, before, strict=True)], pa.binary()), pa.array([text[p : p - q + r + length] for p, q, r in zip(x, before, after, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=_ASKED_SCHEMA)


def _matrix(some: list[bytes], wide: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in some), np.uint8).reshape(len(some), wide), np.array([len(x) for x in some], np.int64)


def shared_with_next(some: list[bytes], wide: int) -> np.ndarray:
    """The longest common prefix of each of some with the next one."""
    rows, sizes = _matrix(some, wide)
    differs = rows[1:] != rows[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), wide)
    return np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))


def _neighbours(batches: Iterator[pa.RecordBatch], kind: str, length: int) -> Iterator[pa.RecordBatch]:
    """Rows in an order (by ``back`` or by ``ahead``), each with what its two neighbours settle.

    Two neighbours of one trigger share some bytes before it and some from it on; strings
    with length - ahead <= d <= back are then repeated: low1 to high1 by the row before,
    low2 to high2 by the row after. most is the larger part shared in the order's own
    direction. A task's first and last row have a neighbour that it doesn't see: that one
    may share all, and settles nothing.
    """
    wide = {"back": length - TRIGGER, "ahead": length}
    unseen = (wide["back"], wide["ahead"], length + 1, -1)
    held, prior = None, unseen

    def told(rows: pa.Table, before: list[np.ndarray], after: list[np.ndarray]) -> pa.RecordBatch:
        own = 0 if kind == "back" else 1
        columns = {"most": np.maximum(before[own], after[own]), "low1": before[2], "high1": before[3], "low2": after[2], "high2": after[3]}
        for name, values in columns.items():
            rows = rows.append_column(f"{name}_{kind}", pa.array(values.astype(np.int32)))
        return rows.combine_chunks().to_batches()[0]

    for b in batches:
        for at in range(0, b.num_rows, SENT_AT_ONCE):
            part = pa.Table.from_batches([b.slice(at, SENT_AT_ONCE)])
            held = part if held is None else pa.concat_tables([held, part])
            n = len(held) - 1
            if not n:
                continue
            a = held.column("a").to_numpy()
            back, ahead = (np.where(a[1:] == a[:-1], shared_with_next(held.column(k).to_pylist(), wide[k]), 0) for k in ("back", "ahead"))
            after = [back, ahead, length - ahead, back]
            yield told(held.slice(0, n), [np.concatenate([[p], x[:-1]]) for p, x in zip(prior, after, strict=True)], after)
            held, prior = held.slice(n), tuple(int(x[-1]) for x in after)
    if held is not None:
        yield told(held, [np.array([x]) for x in prior], [np.array([x]) for x in unseen])


def _in_order(asked: DataFrame, kind: str, length: int) -> DataFrame:
    """asked, range-sorted over all tasks by trigger and bytes, with what neighbours settle; stored, and asked is discarded."""
    by = ["a", "back", "ahead"] if kind == "back" else ["a", "ahead", "back"]
    added = ", ".join(f"{n}_{kind} int" for n in ("most", "low1", "high1", "low2", "high2"))
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
    ordered = asked.repartitionByRange(*by).sortWithinPartitions(*by)
    found = stored(ordered.mapInArrow(lambda batches: _neighbours(batches, kind, length), f"{names}, {added}"), f"by-{kind}")
    discard(asked)
    return found


def settled(asked: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, first, last): runs of repeated starts of the open phrases of asked, a stored table that is discarded; and the stored one read."""
    both = _in_order(_in_order(asked, "back", length), "ahead", length)
    least, most = F.col("before") - F.col("after"), F.col("before")
    ranges = [(F.greatest(least, F.col(f"low{k}_{kind}")), F.least(most, F.col(f"high{k}_{kind}"))) for kind in ("back", "ahead") for k in (1, 2)]
    hits = F.filter(F.array(*[F.struct((F.col("x") - high).alias("first"), (F.col("x") - low).alias("last")) for low, high in ranges]), lambda r: r["first"] <= r["last"])
    known = both.filter("open").select("doc_id", "h", F.explode(hits).alias("r")).select("doc_id", "h", "r.*")

    # strings that may be repeated as far as the orders say
    low, high = F.greatest(least, F.lit(length) - F.col("most_ahead")), F.least(most, F.col("most_back"))
    none = F.array().cast("array<int>")
    maybe = F.when(low <= high, F.sequence(low, high)).otherwise(none)
    left = F.filter(maybe, lambda d: ~_any([(d >= lo) & (d <= hi) for lo, hi in ranges]))
    unsettled = both.filter(F.col("open") & (F.size(left) > 0)).select("a").distinct()
    windows = both.join(unsettled, "a", "left_semi").select("a", "open", "doc_id", "h", "x", "back", "ahead", F.explode(maybe).alias("d"))
    string = F.concat(F.substring("back", F.lit(1), F.col("d")), F.substring("ahead", F.lit(1), F.lit(length) - F.col("d")))
    windows = windows.select("a", "d", F.unhex(F.sha2(string, 256)).alias("w"), "open", "doc_id", "h", (F.col("x") - F.col("d")).alias("first"))
    again = windows.groupBy("a", "d", "w").agg(F.count("*").alias("n")).filter("n > 1").select("a", "d", "w")
    rest = windows.filter("open").join(again, ["a", "d", "w"]).select("doc_id", "h", "first", F.col("first").alias("last"))
    return known.union(rest), both


def _any(some: list) -> F.Column:
    out = F.lit(False)
    for x in some:
        out = out | x
    return out


def starts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, h, spans): for texts of marked docs that have any, arrays of [first, last] starts of repeated strings; stored."""
    spark, found = docs.sparkSession, phrases(docs, length)
    # stored: the join then reads two plain exchanges, and Spark splits the phrases of a hot trigger over tasks
    often = stored(found.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"), "triggers")
    met = reused(found.join(often, "a"))
    # any one occurrence stands for an entry: first() takes one row in all columns, and an entry that occurs once has no other
    entries = reused(met.groupBy("a", "e1", "e2").agg(F.count("*").alias("n"), *[F.first(k).alias(k) for k in ("doc_id", "h", "at")]))
    twice = stored(entries.filter("n > 1").select("a", "e1", "e2"), "twice")
    # triggers under which a phrase that occurs once meets another
    open_ = stored(entries.groupBy("a").agg(F.min("n").alias("least"), F.count("*").alias("crowd")).filter("least = 1 AND crowd > 1").select("a"), "open")
    asked = entries.join(open_, "a").selectExpr("a", "n = 1 AS open", "doc_id", "h", f"{_X} AS x", f"{_BEFORE} AS before", f"{_AFTER} AS after")
    lists = stored(asked.groupBy("doc_id", "h").agg(F.collect_list(F.struct("a", "open", "x", "before", "after")).alias("asked")), "lists")
    entries.unpersist()
    sweep(spark)
    asked_texts = docs.alias("d").join(lists.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d.__h") == F.col("l.h"))).select("l.doc_id", "l.h", "d.text", "l.asked")
    # a text that stands twice under one doc_id gives its rows twice; none of them is open, as its phrases occur twice
    once, read = settled(stored(asked_texts.mapInArrow(lambda batches: _cut(batches, length), _ASKED), "asked"), length)
    sweep(spark)
    first = F.expr(f"{_X} - {_BEFORE}")
    whole = met.join(twice, ["a", "e1", "e2"]).select("doc_id", "h", first.alias("first"), (first + F.expr(_AFTER)).alias("last"))
    spans = stored(whole.union(once).groupBy("doc_id", "h").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")
    met.unpersist()
    discard(often, open_, twice, lists, read)
    sweep(spark)
    return spans


def covered(spans: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Disjoint runs [s, e) of the bytes that strings at starts [first, last] cover."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(s, e) for s, e in out]


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, removed (array of [s, e) runs of bytes) and kept (the other bytes).

    A byte is removed if a string of length bytes that covers it also starts elsewhere in
    any text, its own included; strings never cross texts. Null texts are empty. Texts of
    fewer than length bytes are kept whole. Rows that repeat, or share a doc_id, are each
    returned, and copies of a text repeat all of its strings. Other columns are not read;
    an empty table gives an empty result. kept may start or end inside a character.
    """
    if length < 2 * TRIGGER:
        raise ValueError(f"strings of under {2 * TRIGGER} bytes have no room for triggers")
    lean(docs.sparkSession)
    rows = marked(docs)
    found = starts(rows, length)
    joined = rows.alias("d").join(found.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.__h") == F.col("s.h")), "left").select("d.doc_id", "d.text", "s.spans")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part, sizes, gone, kept = b.slice(at, 1000), [], [], []
                for text, spans in zip(texts(part.column(1)), part.column(2), strict=True):
                    text = text or b""
                    runs = []
                    if spans.is_valid:
                        flat = spans.values.flatten()
                        runs = covered(list(zip(flat[0].to_pylist(), flat[1].to_pylist(), strict=True)), length)
                    edges = [0, *(p for r in runs for p in r), len(text)]
                    sizes.append(len(text))
                    gone.append([list(r) for r in runs])
                    kept.append(b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(gone, schema.field(2).type), pa.array(kept, pa.binary())], schema=schema)

    return joined.mapInArrow(released(run), "doc_id long, n_bytes long, removed array<array<long>>, kept binary")


def brute_force(some: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """removed of each text, by counting all strings."""
    count = Counter(hashlib.sha256(t[k : k + length]).digest() for t in some for k in range(len(t) - length + 1))
    return [covered([(k, k) for k in range(len(t) - length + 1) if count[hashlib.sha256(t[k : k + length]).digest()] > 1], length) for t in some]
