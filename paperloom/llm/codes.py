"""Token ids as directly addressable codes.

A stream of ids is cut into levels of eight bits. Level 0 holds the low byte of every
id; a continuation bitmap has a 1 where an id goes on, and the next level holds one
byte for each of those, in order. The place in the next level is the number of ones
before, which a rank directory (ones before every 512 bits) gives with one lookup and
one popcount. So any id is read in as many steps as it has bytes, and no block is
decoded.

File format. A table of segments, one row each, in ascending order of ``part`` and
``segment``, written by Spark so that task retries and lost executors leave no debris:
part, segment, before (ids of the part's earlier segments), n_docs, n_tokens, doc_ids (int64 each, little endian, with a null
marker's bitmap ``null_ids``), offsets (int64, n_docs + 1 positions in the segment),
and ``codes``, a self-contained blob: magic, number of levels, number of ids, then for
each level its length, its bytes, its bitmap and its rank directory (the last level has
no bitmap). Every number is little endian.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from .shared import lean, released, texts

MAGIC = b"DAC1"
RANK_BITS = 512
END_ID = 2
SEGMENT_TOKENS = 1 << 18
#: Distinct words whose ids a Python worker remembers, about 0.15 kB each: 75 MB.
REMEMBERED = 500_000
#: Words of one call to the tokenizer.
ASKED_AT_ONCE = 4096
CODED_AT_ONCE = 1 << 20


def encode_codes(ids: np.ndarray) -> bytes:
    """The blob of an array of unsigned 32-bit ids."""
    rest, levels = np.ascontiguousarray(ids, np.uint32), []
    while True:
        more = rest >> 8 != 0
        levels.append(((rest & 255).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = [MAGIC, struct.pack("<IQ", len(levels), len(ids))]
    for k, (low, more) in enumerate(levels):
        out += [struct.pack("<Q", len(low)), low.tobytes()]
        if k < len(levels) - 1:
            bits = np.packbits(more, bitorder="little")
            padded = np.zeros(-(-len(bits) // (RANK_BITS // 8)) * (RANK_BITS // 8), np.uint8)
            padded[: len(bits)] = bits
            ones = np.bitwise_count(padded).reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.uint32)
            ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])[:-1]
            out += [padded.tobytes(), ranks.astype("<u4").tobytes()]
    return b"".join(out)


class Codes:
    """Random access to the ids of a blob."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a blob of directly addressable codes")
        n_levels, self.n = struct.unpack_from("<IQ", blob, 4)
        at, self.levels = 16, []
        for k in range(n_levels):
            (size,) = struct.unpack_from("<Q", blob, at)
            low = np.frombuffer(blob, np.uint8, size, at + 8)
            at += 8 + size
            bits = ranks = None
            if k < n_levels - 1:
                blocks = -(-size // RANK_BITS)
                bits = np.frombuffer(blob, np.uint8, blocks * RANK_BITS // 8, at)
                ranks = np.frombuffer(blob, "<u4", blocks, at + len(bits))
                at += len(bits) + 4 * blocks
            self.levels.append((low, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value, shift = 0, 0
        for low, bits, ranks in self.levels:
            value |= int(low[at]) << shift
            if bits is None or not bits[at >> 3] >> (at & 7) & 1:
                return value
            block = at // RANK_BITS
            first = block * RANK_BITS // 8
            ones = int(np.bitwise_count(bits[first : at >> 3]).sum()) + (int(bits[at >> 3]) & ((1 << (at & 7)) - 1)).bit_count()
            at, shift = int(ranks[block]) + ones, shift + 8
        return value

    def all(self) -> np.ndarray:
        """Every id; for scans of whole segments."""
        value: np.ndarray | None = None
        for low, bits, _ in reversed(self.levels):
            level = low.astype(np.uint32)
            if bits is not None and value is not None:
                more = np.unpackbits(bits, count=len(low), bitorder="little").astype(bool)
                level[more] |= value << np.uint32(8)
            value = level
        return value if value is not None else np.zeros(0, np.uint32)


#: Lower-case words of Latin-1 letters, in UTF-8: composed, and one piece to a tokenizer that splits letters from the rest.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_ENDED = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]+)").fullmatch
#: ASCII marks.
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Bytes as the byte-level alphabet writes them, where that isn't the Latin-1 character.
_BYTE_CHARS = {byte: 256 + 33 + k for k, byte in enumerate([*range(127, 161), 173])}
#: A word that stands between texts, and its code; no id has these bytes.
_BETWEEN, _BETWEEN_CODE = b"\0", b"\xff\xff\xff\xff"


class Tokens:
    """ids of texts by a tokenizers file, as little-endian uint32 bytes.

    Valid for tokenizers that drop white space before they split and treat A-Z like
    a-z: texts are cut at ASCII white space, and the ids of a piece are remembered. A
    text with ``<|`` in it may hold a special token, and goes to the library whole, and
    so does one with the character that stands between texts here.
    Words that normalising and splitting leave as they are go to the file's model alone,
    which is the same library without those steps.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.model = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0))
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends_word = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends_word[[k for piece, k in model["vocab"].items() if piece.endswith(model["end_of_word_suffix"])]] = True

    def _keep_joined(self, words: list[bytes]) -> None:
        """Plain words asked for as one text: a word's last piece, and no other, is one that ends words."""
        asked = b" ".join(words).decode("latin-1")
        if not asked.isascii():
            asked = asked.translate(_BYTE_CHARS)
        ids = np.array(self.model.encode_batch_fast([asked], add_special_tokens=False)[0].ids, "<u4")
        ends = [0, *(4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()]
        flat = ids.tobytes()
        self.known.update((word, flat[s:e]) for word, s, e in zip(words, ends[:-1], ends[1:], strict=True))

    def _keep(self, words: list[bytes]) -> None:
        for at in range(0, len(words), ASKED_AT_ONCE):
            some = words[at : at + ASKED_AT_ONCE]
            ids = [got.ids for got in self.tokenizer.encode_batch_fast(list(map(bytes.decode, some)), add_special_tokens=False)]
            ends = list(accumulate(map(len, ids), initial=0))
            flat = np.fromiter(chain.from_iterable(ids), "<u4", ends[-1]).tobytes()
            self.known.update((word, flat[4 * s : 4 * e]) for word, s, e in zip(some, ends, ends[1:], strict=False))

    def learn(self, new: set[bytes]) -> None:
        """Know words that are new. ASCII marks that end a plain word are a piece by themselves, so word and marks are asked for."""
        known, plain, other, ended = self.known, set(), set(), []
        for word in new:
            if word.isalpha() or _PLAIN(word):
                plain.add(word)
                continue
            base = word.rstrip(_MARKS)
            if base.isalpha() or _ENDED(word):
                ended.append((word, base, word[len(base) :]))
            else:
                other.add(word)
        plain.update(base for _, base, _ in ended if base not in known)
        other.update(marks for _, _, marks in ended if marks not in known)
        asked = list(plain)
        for at in range(0, len(asked), ASKED_AT_ONCE):
            self._keep_joined(asked[at : at + ASKED_AT_ONCE])
        self._keep(list(other))
        known.update((word, known[base] + known[marks]) for word, base, marks in ended)

    def encode_all(self, some: list[bytes | None]) -> list[bytes]:
        if len(self.known) > REMEMBERED:  # what came first is what is common: keep the older half
            self.known = dict(islice(self.known.items(), REMEMBERED // 2))
        self.known[_BETWEEN] = _BETWEEN_CODE
        whole = {k: self._whole(t) for k, t in enumerate(some) if t and (b"<|" in t or _BETWEEN in t)}
        words = b" \0 ".join([b"" if not t or k in whole else t for k, t in enumerate(some)]).lower().split()
        codes = list(map(self.known.get, words))
        if lacking := [at for at, code in enumerate(codes) if code is None]:
            self.learn({words[at] for at in lacking})
            for at in lacking:
                codes[at] = self.known[words[at]]
        found = b"".join(codes).split(_BETWEEN_CODE)
        for k, code in whole.items():
            found[k] = code
        return found if some else []

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: bytes | None) -> bytes:
        return self.encode_all([text])[0]


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One for each worker process and file."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def coded(some: Iterable[bytes | None], encode_all: Callable[[list[bytes | None]], list[bytes]]) -> Iterator[bytes]:
    """The codes of texts, asked for by about CODED_AT_ONCE bytes of them."""
    held, size = [], 0
    for text in some:
        held.append(text)
        size += len(text or b"")
        if size > CODED_AT_ONCE:
            yield from encode_all(held)
            held, size = [], 0
    yield from encode_all(held)


_SEGMENTS = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("null_ids", pa.binary()), ("offsets", pa.binary()), ("codes", pa.binary())])
SEGMENTS = "part int, segment int, before long, n_docs long, n_tokens long, doc_ids binary, null_ids binary, offsets binary, codes binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode every row of docs (doc_id, text), in ascending order of doc_id, and write the segments under path.

    Null and empty texts have the end id alone. Rows that repeat a doc_id are each
    written, in order of their texts; a null doc_id comes first. A segment ends after the
    document that fills it, so a very long text makes one long segment. Other columns
    are ignored; an empty table makes an empty one.
    """
    lean(docs.sparkSession)
    # texts of equal ids are put in order by their hash: comparing whole texts would carry them twice
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, before, held, ids, size = TaskContext.get().partitionId(), 0, 0, [], [], 0
        encode_all = tokens(tokenizer).encode_all

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in held], np.int64)
            offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
            values = {"part": part, "segment": segment, "before": before, "n_docs": len(held), "n_tokens": int(offsets[-1])}
            values |= {"doc_ids": np.array([x or 0 for x in ids], "<i8").tobytes(), "null_ids": np.packbits([x is None for x in ids]).tobytes(), "offsets": offsets.astype("<i8").tobytes(), "codes": encode_codes(np.frombuffer(b"".join(held), "<u4"))}
            return pa.RecordBatch.from_arrays([pa.array([values[f.name]], f.type) for f in _SEGMENTS], schema=_SEGMENTS)

        for b in batches:
            for doc_id, code in zip(b.column(0).to_pylist(), coded(texts(b.column(1)), encode_all), strict=True):
                code += end
                held.append(code)
                ids.append(doc_id)
                size += len(code) // 4
                if size >= segment_tokens:
                    yield flush()
                    segment, before, held, ids, size = segment + 1, before + size, [], [], 0
        if held:
            yield flush()

    rows.mapInArrow(released(run), SEGMENTS).write.parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with first: the number of ids of all segments before each.

    A segment holds the count within its part, so only the sums by part are put in order,
    in one task, and sent to all: a row for each task that wrote, whatever the segments hold.
    """
    table = spark.read.schema(SEGMENTS).parquet(path)
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
    return table.join(F.broadcast(parts), "part").withColumn("first", F.col("earlier") + F.col("before")).drop("earlier")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and first_id of each document, read from the segments under path.

    first_id comes by random access to its place; the others from a scan of the segment.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("first_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                doc_ids, null_ids, offsets, blob, first = (b.column(k)[row].as_py() for k in range(5))
                ends, codes = np.frombuffer(offsets, "<i8"), Codes(blob)
                ids, size = np.frombuffer(doc_ids, "<i8"), len(ends) - 1
                gone = np.unpackbits(np.frombuffer(null_ids, np.uint8), count=size).astype(bool)
                flat = memoryview(codes.all().astype("<u4").tobytes())
                crcs = [zlib.crc32(flat[4 * s : 4 * e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                firsts = [codes[at] for at in ends[:-1].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=gone, type=pa.int64()), pa.array(ends[:-1] + first), pa.array(np.diff(ends)), pa.array(crcs, pa.int64()), pa.array(firsts, pa.int64())], schema=schema)

    return segments(spark, path).select("doc_ids", "null_ids", "offsets", "codes", "first").mapInArrow(released(run), "doc_id long, start long, n_tokens long, ids_crc32 long, first_id long")
