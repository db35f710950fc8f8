"""Language identification by segmentation-marginalised unigrams.

For each language, every piece of a fixed public vocabulary has a probability; the
score of a word is the sum, over all ways to cut it into pieces, of the product of
their probabilities (the forward algorithm), and a text's log score is the sum over its
words. The probabilities are learned by expectation maximisation over the words of a
bounded sample of labelled documents, with the expected piece counts that the forward
and backward sums give.

Pieces never cross a word's edge, so a word's scores hold wherever it stands: tasks
remember them per distinct token, up to ``REMEMBERED``, and score new words in batches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, released, reused, texts

#: Bounds of the training sample for each language: labelled documents (those of the smallest hashes), and distinct words (the most frequent).
SAMPLE_DOCS = 1500
SAMPLE_WORDS = 12_000
ROUNDS = 3
#: Characters of a word that are scored as one; longer words are scored in such parts.
PART = 24
SCORED_AT_ONCE = 8192
FLOOR = 0.02  # of a piece's probability that comes from the languages' mean and an even share
REMEMBERED = 200_000
START = "▁"
UNDETERMINED = "und"
_LETTERS = regex.compile(r"\p{L}+")


def vocabulary(path: str) -> list[str]:
    """Pieces of letters (with or without the word-start mark) of a sentencepiece model; id 0 stands for any other character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
    return ["", *(p for p in pieces if p == START or _LETTERS.fullmatch(p.removeprefix(START)))]


def parts(token: str) -> list[str]:
    """The words of letters in a lower-case token, start marked, cut into parts of at most PART characters."""
    found = []
    for word in _LETTERS.findall(token):
        word = START + word
        found += [word[k : k + PART] for k in range(0, len(word), PART)]
    return found


class Trie:
    """The pieces as a trie of arrays: edges (node << 21 | code point) in order, their ends, and each node's piece or -1."""

    def __init__(self, pieces: list[str]):
        ends: dict[int, int] = {}
        piece_at = [-1]
        for k, piece in enumerate(pieces):
            node = 0
            for c in piece:
                edge = node << 21 | ord(c)
                if edge not in ends:
                    ends[edge] = len(piece_at)
                    piece_at.append(-1)
                node = ends[edge]
            if piece:
                piece_at[node] = k
        self.edges = np.array(sorted(ends), np.int64)
        self.ends = np.array([ends[e] for e in self.edges.tolist()], np.int64)
        self.piece_at = np.array(piece_at, np.int64)

    def step(self, node: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have an edge for their code point, and those edges' ends."""
        key = node << 21 | code
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        there = self.edges[at] == key
        return there, self.ends[at[there]]


class Lattices:
    """The pieces found in words, as arrays sorted by (first, last): word, piece, and steps, the bounds of each (first, last)."""

    def __init__(self, words: list[str], trie: Trie):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        word_at = np.repeat(np.arange(len(words)), self.lengths)
        starts = np.cumsum(self.lengths) - self.lengths
        first, end = np.arange(len(code)) - starts[word_at], (starts + self.lengths)[word_at]
        at, node, found = np.arange(len(code)), np.zeros(len(code), np.int64), []
        for size in range(1, PART + 1):
            inside = at + size <= end[at]
            at, node = at[inside], node[inside]
            if not len(at):
                break
            there, ends = trie.step(node, code[at + size - 1])
            if size == 1:  # one character always has a piece: 0 for one that the vocabulary lacks
                single = np.zeros(len(at), np.int64)
                single[there] = np.maximum(trie.piece_at[ends], 0)
                found.append((word_at, first << 8 | (first + 1), single))
            at, node = at[there], ends
            if size > 1:
                piece = trie.piece_at[node]
                has = piece >= 0
                found.append((word_at[at[has]], first[at[has]] << 8 | (first[at[has]] + size), piece[has]))
        word, span, piece = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(span, kind="stable")
        self.word, self.piece = word[order], piece[order]
        bounds, firsts = np.unique(span[order], return_index=True)
        self.steps = [(int(x) >> 8, int(x) & 255, slice(s, e)) for x, s, e in zip(bounds, firsts.tolist(), [*firsts.tolist()[1:], len(span)], strict=True)]


def forward(lattice: Lattices, table: np.ndarray) -> np.ndarray:
    """alpha[i]: for each word and language, the sum over all segmentations of the first i characters. table: pieces x languages."""
    alpha = np.zeros((PART + 1, len(lattice.lengths), table.shape[1]))
    alpha[0] = 1
    for first, last, at in lattice.steps:  # by first: alpha[first] is whole
        word = lattice.word[at]
        alpha[last, word] += alpha[first, word] * table[lattice.piece[at]]
    return alpha


def totals(lattice: Lattices, alpha: np.ndarray) -> np.ndarray:
    return alpha[lattice.lengths, np.arange(len(lattice.lengths))]


def expected(lattice: Lattices, table: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected counts of pieces, pieces x languages, over words that occur weights (words x languages) times."""
    alpha = forward(lattice, table)
    beta = np.zeros_like(alpha)
    beta[lattice.lengths, np.arange(len(lattice.lengths))] = 1
    share = weights / np.maximum(totals(lattice, alpha), 1e-300)
    counts = np.zeros_like(table)
    for first, last, at in reversed(lattice.steps):
        word, piece = lattice.word[at], lattice.piece[at]
        passed = table[piece] * beta[last, word]
        beta[first, word] += passed
        np.add.at(counts, piece, alpha[first, word] * passed * share[word])
    return counts


@dataclass
class Model:
    """langs in code-point order; table: probabilities, pieces x languages."""

    langs: list[str]
    pieces: list[str]
    table: np.ndarray

    def __post_init__(self) -> None:
        self.trie = Trie(self.pieces)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log scores, words x languages."""
        out = np.zeros((len(words), len(self.langs)))
        for at in range(0, len(words), SCORED_AT_ONCE):
            lattice = Lattices(words[at : at + SCORED_AT_ONCE], self.trie)
            out[at : at + SCORED_AT_ONCE] = np.log(np.maximum(totals(lattice, forward(lattice, self.table)), 1e-300))
        return out


def fit(counted: Iterable[tuple[str, str, int]], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """The model from (lang, token, count): expectation maximisation from even probabilities."""
    weight: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    langs = set()
    for lang, token, n in counted:
        langs.add(lang)
        for part in parts(token.lower()):
            weight[part][lang] += n
    names, words = sorted(langs), sorted(weight)
    model = Model(names, pieces, np.full((len(pieces), max(1, len(names))), 1 / len(pieces)))
    by_word = np.array([[weight[w].get(x, 0) for x in names] for w in words], float).reshape(len(words), len(names))
    runs = [slice(k, k + SCORED_AT_ONCE) for k in range(0, len(words), SCORED_AT_ONCE)]
    found = [Lattices(words[run], model.trie) for run in runs]
    for _ in range(rounds if names else 0):
        counts = sum((expected(lattice, model.table, by_word[run]) for run, lattice in zip(runs, found, strict=True)), np.zeros_like(model.table))
        share = counts / np.maximum(counts.sum(axis=0), 1e-300)
        model.table = (1 - FLOOR) * share + FLOOR * (0.9 * share.mean(axis=1, keepdims=True) + 0.1 / len(pieces))
    return model


def train(docs: DataFrame, vocabulary_path: str, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> Model:
    """A model from labelled documents (doc_id, text, lang), bounded by sample_docs and sample_words for each language.

    The sample is, for each language, the documents of the smallest hashes of doc_id, so
    that a rare language is learned beside a frequent one; only those rows' texts are
    read, and their words counted, once, on the executors. What reaches the driver is a
    row for each language, then sample_words rows for each. Rows without lang or text are
    no examples. No labelled rows at all give a model without languages.
    """
    lean(docs.sparkSession)
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64(F.lit("langid"), F.col("doc_id")).alias("h"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # a task sends sample_docs rows of a language at most
    last = {r[0]: r[1] for r in labelled.select("lang", "h").withColumn("nth", nth).filter(F.col("nth") <= sample_docs).groupBy("lang").agg(F.max("h")).collect()}
    if not last:
        return fit([], vocabulary(vocabulary_path))
    bounds = F.broadcast(docs.sparkSession.createDataFrame(sorted(last.items()), "lang string, last long"))
    sample = labelled.join(bounds, "lang").filter("h <= last")
    words = reused(sample.select("lang", F.explode(F.split("text", r"\s+")).alias("token")).groupBy("lang", "token").count())
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "token"))
    counted = [tuple(r) for r in words.withColumn("nth", nth).filter(F.col("nth") <= sample_words).orderBy("lang", "nth").select("lang", "token", "count").collect()]
    words.unpersist()
    return fit(counted, vocabulary(vocabulary_path))


class Scorer:
    """A task's scorer: remembers the scores of tokens it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.langs = len(model.langs)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.scores = np.zeros((1, self.langs))  # row 0: no letters

    def _learn(self, tokens: list[str]) -> None:
        """A token of one word shares the word's row; one of several has a row of its own."""
        cut = [parts(t) for t in tokens]
        new = sorted({p for c in cut for p in c}.difference(self.words))
        self.words.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
        several = [k for k, c in enumerate(cut) if len(c) > 1]
        self.scores = np.concatenate([self.scores, self.model.word_scores(new)])
        sums = [self.scores[[self.words[p] for p in cut[k]]].sum(axis=0) for k in several]
        row = len(self.scores)
        if sums:
            self.scores = np.concatenate([self.scores, np.array(sums)])
        for token, c in zip(tokens, cut, strict=True):
            if len(c) > 1:
                self.known[token], row = row, row + 1
            else:
                self.known[token] = self.words[c[0]] if c else 0

    def learn(self, split: list[list[str]]) -> None:
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = set().union(*split)
        self._learn(sorted(new))

    def score(self, tokens: list[str]) -> np.ndarray:
        return self.scores.take(np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens)), axis=0).sum(axis=0)


#: Characters whose tokens are learned together.
_LEARNED_AT_ONCE = 1 << 20


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (the posterior of lang_pred, even priors) for each row's text.

    A text that is null or has no letter (Unicode's category L) is ``und`` with score 0,
    and so is every text if no language was learned. Equal scores go to the first language
    by code point. Rows that repeat a doc_id are each returned; columns of docs pass
    through, but for any that are named lang_pred or score, which these two replace.
    """
    lean(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.pieces, model.table))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*sent.value))

        def judged(some: list[str | None]) -> Iterator[tuple[str, float]]:
            split = [(t or "").lower().split() for t in some]
            scorer.learn(split)
            for text, tokens in zip(some, split, strict=True):
                if not scorer.langs or not text or not _LETTERS.search(text):
                    yield UNDETERMINED, 0.0
                    continue
                logs = scorer.score(tokens)
                best = int(logs.argmax())
                yield scorer.model.langs[best], float(1 / np.exp(np.maximum(logs - logs[best], -700)).sum())

        for b in batches:
            found: list[tuple[str, float]] = []
            some: list[str | None] = []
            size = 0
            for value in texts(b.column(at)):
                some.append(None if value is None else value.decode())
                size += len(value or b"")
                if size > _LEARNED_AT_ONCE:
                    found += judged(some)
                    some, size = [], 0
            found += judged(some)
            more = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(released(run), docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def held_out() -> F.Column:
    """Documents that no model may learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
