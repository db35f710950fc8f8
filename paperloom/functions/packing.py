"""Packing of text into chunks: running decisions inside one page, so plain functions over one text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

_SENTENCE = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class ChunkRules:
    """Bounds of a chunk, in characters, paragraphs and words of overlap."""

    least: int = 200
    most: int = 1200
    slack: int = 200
    paragraphs: int = 6
    overlap: int = 30

    @property
    def hard(self) -> int:
        return self.most + self.slack


def filled(pieces: Iterable[str], limit: int, joint: int = 0) -> Iterator[list[str]]:
    """Runs of pieces whose lengths, with joint between two, sum to limit at most; a longer piece is a run of its own."""
    run: list[str] = []
    size = 0
    for piece in pieces:
        if run and size + joint + len(piece) > limit:
            yield run
            run, size = [], 0
        size += len(piece) + (joint if run else 0)
        run.append(piece)
    if run:
        yield run


def by_words(text: str, limit: int) -> list[str]:
    return [" ".join(run) for run in filled(text.split(), limit, 1)]


def hard_split(text: str, rules: ChunkRules) -> list[str]:
    """Sentences, long ones cut at words, packed to the hard limit (which their joining spaces may pass: cut again)."""
    whole = [s for s in map(str.strip, _SENTENCE.split(text)) if s]
    if not whole:
        return [text]
    pieces = (part for s in whole for part in (by_words(s, rules.most) if len(s) > rules.most else [s]))
    joined = (" ".join(run).strip() for run in filled(pieces, rules.hard))
    return [part for chunk in joined for part in (by_words(chunk, rules.hard) if len(chunk) > rules.hard else [chunk])]


def n_paragraphs(text: str) -> int:
    return sum(1 for p in text.split("\n\n") if p.strip())


def packed(text: str, rules: ChunkRules) -> list[str]:
    """Paragraphs packed greedily; each chunk but the first opens with the last words of the one before."""
    chunks: list[str] = []
    held: list[str] = []
    size = 0
    for paragraph in (p for p in map(str.strip, text.split("\n\n")) if p):
        if held and (size + len(paragraph) > rules.most or len(held) + 1 > rules.paragraphs):
            chunks.append("\n\n".join(held).strip())
            tail = " ".join(chunks[-1].split()[-rules.overlap :]) if rules.overlap else ""
            held = [tail] if tail else []
            size = len(tail)
        held.append(paragraph)
        size += len(paragraph)
    if held:
        chunks.append("\n\n".join(held).strip())
    return [part for c in chunks for part in (hard_split(c, rules) if len(c) > rules.most else [c])]


def merged(chunks: list[str], rules: ChunkRules) -> list[str]:
    """A short chunk joins its successor, and a short last one its predecessor, where the two fit together."""
    fits: Callable[[str], bool] = lambda t: len(t) <= rules.hard and n_paragraphs(t) <= rules.paragraphs
    out: list[str] = []
    k = 0
    while k < len(chunks):
        here = chunks[k]
        if len(here) < rules.least and k + 1 < len(chunks) and fits(both := f"{here}\n\n{chunks[k + 1]}".strip()):
            here, k = both, k + 1
        out.append(here)
        k += 1
    if len(out) > 1 and len(out[-1]) < rules.least and fits(both := f"{out[-2]}\n\n{out[-1]}".strip()):
        out[-2:] = [both]
    return out


def chunks(text: str | None, has_table: bool = False, rules: ChunkRules = ChunkRules()) -> list[str]:
    """The chunks of one page, in order; a page with a table is one chunk, if it isn't too long."""
    text = (text or "").strip()
    if not text:
        return []
    if has_table:
        return [text] if len(text) <= rules.hard else hard_split(text, rules)
    return [c for c in merged(packed(text, rules), rules) if len(c.strip()) >= rules.least]


def buffered(text: str | None, least: int = 120) -> list[str]:
    """Paragraphs joined until a chunk has at least least characters; the rest is the last chunk."""
    out: list[str] = []
    held = ""
    for paragraph in (p for p in map(str.strip, (text or "").split("\n\n")) if p):
        held = f"{held}\n\n{paragraph}".strip()
        if len(held) >= least:
            out.append(held)
            held = ""
    return [*out, held] if held else out
