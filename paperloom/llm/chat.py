"""Chat formatting with typed content parts.

A message's content is an ordered array of parts. A visitor, one expression for each
type of part, turns them into text: a text part is escaped, and an image, audio or
document part becomes a placeholder ``<|type:n|>`` whose n is its place among the
message's attachments, recorded with its reference and the tokens it will expand to.

The template is one segment for each message::

    ### role
    escaped content
    </turn>

Escaping is one to one: a backslash becomes ``\\b``, ``<`` becomes ``\\l`` and ``#``
becomes ``\\h``, so no text or role can hold ``###``, ``</turn>`` or a placeholder, and a
segment is read back without ambiguity. Segments are rows (a conversation may hold a
third of all rows): formatting needs no shuffle, and what reads whole conversations
streams them in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, BODY, END = "### ", "\n", "\n</turn>\n"
LOSS_ROLE = "assistant"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TILE, TOKENS_A_TILE, TOKENS_A_SECOND, TOKENS_A_PAGE = 336, 576, 25, 1024


def escape(text: Column) -> Column:
    for plain, marked in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def unescape(text: Column) -> Column:
    for plain, marked in (("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(marked), F.lit(plain))
    return text


def unescaped(text: str) -> str:
    return text.replace("\\h", "#").replace("\\l", "<").replace("\\b", "\\")


def text_parts(text: Column) -> Column:
    """The content of a message that is one text."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


class PartVisitor:
    """What each type of part turns into; a subclass may change or add types."""

    def visit_text(self, part: Column, place: Column) -> Column:
        return escape(F.coalesce(part["text"], F.lit("")))

    def placeholder(self, kind: str, place: Column) -> Column:
        return F.concat(F.lit(f"<|{kind}:"), place.cast("string"), F.lit("|>"))

    def tokens(self) -> dict[str, Callable[[Column], Column]]:
        """Expanded tokens by type of attachment; missing sizes count as one tile, second or page."""
        one = F.lit(1)
        tiles = lambda x: F.ceil(F.greatest(F.coalesce(x, one), one) / TILE)
        return {
            "image": lambda p: tiles(p["width"]) * tiles(p["height"]) * TOKENS_A_TILE,
            "audio": lambda p: F.ceil(F.greatest(F.coalesce(p["seconds"], one.cast("double")), F.lit(0.0)) * TOKENS_A_SECOND),
            "document": lambda p: F.greatest(F.coalesce(p["pages"], one), one) * TOKENS_A_PAGE,
        }

    def flatten(self, content: Column) -> tuple[Column, Column]:
        """(text, attachments) of content, an array of PART.

        Attachments are structs of place, type, ref and n_tokens, in order. Null parts,
        and parts of an unknown type, raise no error: they count as empty text.
        """
        known = self.tokens()
        attached = F.filter(content, lambda p: p["type"].isin(*known))
        seen = F.transform(attached, lambda p, k: F.struct(k.alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), self._count(p, known).alias("n_tokens")))

        def visit(part: Column, k: Column) -> Column:
            place = F.size(F.filter(F.slice(content, F.lit(1), k), lambda p: p["type"].isin(*known)))
            out = F.when(part["type"] == "text", self.visit_text(part, place))
            for kind in known:
                out = out.when(part["type"] == kind, self.placeholder(kind, place))
            return out.otherwise(F.lit(""))

        return F.array_join(F.transform(content, visit), ""), seen

    def _count(self, part: Column, known: dict[str, Callable[[Column], Column]]) -> Column:
        out = None
        for kind, tokens in known.items():
            out = (F.when if out is None else out.when)(part["type"] == kind, tokens(part).cast("long"))
        return out.otherwise(F.lit(0).cast("long"))


def format_messages(messages: DataFrame, content: Column | None = None, visitor: PartVisitor | None = None) -> DataFrame:
    """One segment per row of messages (conv_id, turn, role, and text or content).

    Columns: conv_id, turn, role, segment, loss_start and loss_length (the code points of
    the segment under the loss mask: an assistant's content; else 0 of them), attachments
    and n_expanded (tokens of all attachments). Null text is empty text, a null role an
    empty role. Other columns are not read; an empty table gives no segments.
    """
    content = F.coalesce(content, F.array().cast(f"array<{PART}>")) if content is not None else text_parts(F.col("text"))
    text, attachments = (visitor or PartVisitor()).flatten(content)
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("body"), attachments.alias("attachments"))
    head = F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(BODY))
    return rows.select(
        "conv_id",
        "turn",
        "role",
        F.concat(head, "body", F.lit(END)).alias("segment"),
        F.char_length(head).alias("loss_start"),
        F.when(F.col("role") == LOSS_ROLE, F.char_length("body")).otherwise(0).alias("loss_length"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]).alias("n_expanded"),
    )


def parsed(segments: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, loss_text and n_chars, read from the segments alone."""
    body = F.expr(f"substring(segment, {len(HEAD) + 1}, char_length(segment) - {len(HEAD) + len(END)})")
    cut = F.locate("\n", F.col("body"))
    rows = segments.select("*", body.alias("body")).withColumn("cut", cut)
    return rows.select(
        "conv_id",
        "turn",
        unescape(F.expr("substring(body, 1, cut - 1)")).alias("role"),
        unescape(F.expr("substring(body, cut + 1)")).alias("text"),
        unescape(F.expr("substring(segment, loss_start + 1, loss_length)")).alias("loss_text"),
        F.char_length("segment").cast("long").alias("n_chars"),
    )


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(segments: DataFrame) -> DataFrame:
    """A row for each conversation, from its segments in order of turn (nulls first; ties by role, then text).

    A conversation is streamed through one task, as a hash over its whole text asks for; of
    it, the task holds one batch of rows.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = parsed(segments).withColumn("role", F.coalesce("role", F.lit(""))).repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {f.name: [] for f in DIGESTS}
        state: list | None = None

        def close() -> None:
            for name, value in zip(DIGESTS.names, (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]), strict=True):
                found[name].append(value)

        for b in batches:
            for conv, _, role, text, loss, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += n
            if len(found["conv_id"]) > 10_000:
                yield pa.RecordBatch.from_pydict(found, schema=DIGESTS)
                found = {f.name: [] for f in DIGESTS}
        if state is not None:
            close()
        yield pa.RecordBatch.from_pydict(found, schema=DIGESTS)

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
