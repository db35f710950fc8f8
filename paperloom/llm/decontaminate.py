"""Benchmark decontamination by Wu-Manber search over words.

A pattern is one window of an item's words. Patterns of one length share a table
of shifts, keyed by blocks of two words: the search looks at the block that ends at
the current position and jumps as far as no pattern allows an occurrence; where the
shift is 0, the bucket of patterns that end in this block is compared word by word.
Lengths under ``window`` come from items shorter than a window only.

A bucket is chosen by its patterns' last block and first word, and holds places in the
items' own words. Patterns are sent to the tasks as one broadcast of at most
``MOST_WORDS`` words, whose tables take about 0.5 kB a word and are built once a worker; a
larger benchmark comes through the driver pass by pass, so many words at a time, and the
spans of all passes are merged per document.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import batch, free, lean, reused, stored, texts

WINDOW = 13
#: Words of a pass: about 130 MB in a worker.
MOST_WORDS = 250_000
#: A-Z become lower case, other ASCII that isn't a digit or letter a blank; bytes over 7F stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class WuManber:
    """Patterns of words, all of one length, and the numbers of the items each belongs to."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.shift: dict[bytes | tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple, list[tuple[list[bytes], int, list[int]]]] = defaultdict(list)

    def _block(self, words: list[bytes], end: int) -> bytes | tuple[bytes, ...]:
        return (words[end - 2], words[end - 1]) if self.block > 1 else words[end - 1]

    def add(self, words: list[bytes], number: int) -> None:
        """Every run of ``length`` of an item's words."""
        size = self.length
        for at in range(len(words) - size + 1):
            for end in range(self.block, size + 1):
                self._least(self._block(words, at + end), size - end)
            there = self.bucket[self._block(words, at + size), words[at]]
            for other, start, numbers in there:
                if other[start : start + size] == words[at : at + size]:
                    if numbers[-1] != number:
                        numbers.append(number)
                    break
            else:
                there.append((words, at, [number]))

    def _least(self, key: bytes | tuple[bytes, ...], shift: int) -> None:
        if shift < self.shift.get(key, self.most):
            self.shift[key] = shift

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(first word, items) of every occurrence."""
        length, most, shift, end, n = self.length, self.most, self.shift.get, self.length, len(words)
        pairs = self.block > 1
        while end <= n:
            key = (words[end - 2], words[end - 1]) if pairs else words[end - 1]
            jump = shift(key, most)
            if jump:
                end += jump
                continue
            at = end - length
            for other, start, numbers in self.bucket.get((key, words[at]), ()):
                if other[start : start + length] == words[at:end]:
                    yield at, numbers
            end += 1


def searchers(items: Iterable[tuple[int, list[bytes]]], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, WuManber] = {}
    one: dict[bytes, bytes] = {}  # equal words are one object
    for number, words in items:
        if words:
            size = min(window, len(words))
            by_length.setdefault(size, WuManber(size)).add([one.setdefault(w, w) for w in words], number)
    return [engine for _, engine in sorted(by_length.items())]


#: The last tables that this worker built, by the broadcast's mark.
_built: dict[str, list[WuManber]] = {}


def _searchers_of(mark: str, words: list[list[bytes]], window: int) -> list[WuManber]:
    if mark not in _built:
        _built.clear()
        _built[mark] = searchers(enumerate(words), window)
    return _built[mark]


def hits(words: list[bytes], engines: list[WuManber]) -> tuple[list[tuple[int, int]], set[int]]:
    """Disjoint spans [first, last) of hit words in order, and the items that occur."""
    found, items = [], set()
    for engine in engines:
        for at, who in engine.search(words):
            found.append((at, at + engine.length))
            items.update(who)
    return merged(found), items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _passes(benchmark: DataFrame, most_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The benchmark's items in runs of at most most_words pattern words (or one item), each worked on alone."""
    held, size = [], 0
    for row in benchmark.toLocalIterator():
        words = words_of(None if row.text is None else row.text.encode())
        if held and size + len(words) > most_words:
            yield held
            held, size = [], 0
        held.append((row.item_id, words))
        size += len(words)
    yield held


def _single(benchmark: DataFrame, most_words: int) -> list | None:
    """The whole benchmark if one pass holds it."""
    passes = _passes(benchmark.select("item_id", "text"), most_words)
    first = next(passes)
    return first if next(passes, None) is None else None


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans (array of [first, last) word spans), item_ids (sorted as strings).

    Null and wordless texts have no words and no hits; items without words never
    occur; an item of fewer words than a window is one window. Items that repeat an
    item_id count once, and an item with a null item_id takes part in hits but is not
    named. Documents that repeat a doc_id are each returned. An empty benchmark hits
    nothing. Only the named columns are read.
    """
    spark = docs.sparkSession
    lean(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("item_ids", pa.list_(pa.string()))])
    kind = "doc_id long, n_words long, spans array<array<int>>, item_ids array<string>"

    def over(items: list, rows: DataFrame) -> DataFrame:
        names = [x[0] for x in items]
        mark, sent = uuid.uuid4().hex, spark.sparkContext.broadcast((names, [w for _, w in items]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, words = sent.value
            engines = _searchers_of(mark, words, window)
            for b in batches:
                out: dict[str, list] = {f.name: [] for f in schema}
                for text in texts(b.column(1)):
                    found = words_of(text)
                    spans, who = hits(found, engines)
                    out["n_words"].append(len(found))
                    out["spans"].append([list(x) for x in spans])
                    out["item_ids"].append(sorted({str(names[k]) for k in who if names[k] is not None}))
                yield batch(schema, out | {"doc_id": b.column(0).cast(pa.int64())})

        return rows.mapInArrow(run, kind)

    rows = docs.select("doc_id", "text")
    if (single := _single(benchmark, most_words)) is not None:
        return over(single, rows)
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    names = rows.select("row", F.col("doc_id").alias("known"))
    each = [stored(over(items, rows.select(F.col("row").alias("doc_id"), "text")), "hits") for items in _passes(benchmark.select("item_id", "text"), most_words)]
    every = each[0]
    for more in each[1:]:
        every = every.union(more)
    joined = F.udf(lambda x: [list(s) for s in merged(map(tuple, x))], "array<array<int>>")
    both = every.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), joined(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    return both.withColumnRenamed("doc_id", "row").join(names, "row").select(F.col("known").alias("doc_id"), "n_words", "spans", "item_ids")


def n_hit(spans: F.Column) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda sofar, x: sofar + (x[1] - x[0]).cast("long"))


def is_contaminated(hit: F.Column, words: F.Column) -> F.Column:
    return (hit > 0) & (20 * hit >= words)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """docs without the rows in which a window of the benchmark occurs, however long the rest of their text.

    Null and wordless texts have no words and stay; rows that repeat are each judged; all
    columns of docs pass through, and an empty benchmark drops nothing. One pass over docs,
    or one for each ``most_words`` words of the benchmark.
    """
    lean(docs.sparkSession)
    flag, at, rows = free(docs, "hit"), docs.columns.index("text"), docs
    schema = docs.withColumn(flag, F.lit(True)).schema
    for k, items in enumerate(_passes(benchmark.select("item_id", "text"), most_words)):
        if k:  # what the pass before kept
            rows = reused(rows)
        rows = _flagged(rows, [w for _, w in items], window, at, schema).filter(~F.col(flag)).drop(flag)
    return rows


def _flagged(docs: DataFrame, words: list[list[bytes]], window: int, at: int, schema: StructType) -> DataFrame:
    """docs with a last column that tells whether any of the items' windows occurs."""
    mark, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engines = _searchers_of(mark, sent.value, window)
        for b in batches:
            hit = [any(next(e.search(found), None) is not None for e in engines) for found in map(words_of, texts(b.column(at)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit, pa.bool_())], names=schema.names)

    return docs.mapInArrow(run, schema)
