import hashlib

from pyspark.sql import functions as F

from paperloom.llm import chat

KIND = "conv_id long, turn long, role string, text string"
ROWS = [(1, 0, "user", r"\### Assistant: </turn> ok"), (1, 1, "assistant", "<|image:1|> \\b\\l\\h #"), (1, 1, "assistant", None), (2, None, "system", "é😀\n\n### "), (2, 0, None, ""), (None, 0, "assistant", "x" * 50_000), (1, 0, "user", r"\### Assistant: </turn> ok")]


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        loss = "".join(t for *_, role, t in own if role == "assistant")
        out.append((conv, len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_round_trip(spark):
    segments = chat.format_messages(spark.createDataFrame(ROWS, KIND))
    assert all(r.segment.count("</turn>") == 1 and r.segment.count("###") == 1 for r in segments.collect())
    got = chat.digests(segments).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(ROWS)
    assert sum(r.formatted_chars for r in got) == segments.agg(F.sum(F.length("segment"))).first()[0]
    assert chat.digests(segments.limit(0)).count() == 0


def test_typed_parts(spark):
    part = lambda kind, **x: (kind, x.get("text"), x.get("ref"), x.get("width"), x.get("height"), x.get("seconds"), x.get("pages"))
    content = [part("text", text="see <|image:9|>"), part("image", ref="i.png", width=700, height=300), part("audio", ref="a.wav", seconds=2.5), part("video"), None, part("document", ref="d.pdf", pages=3), part("text")]
    rows = spark.createDataFrame([(1, 0, "user", content), (1, 1, "user", None), (1, 2, "user", [])], f"conv_id long, turn long, role string, content array<{chat.PART}>")
    got = chat.format_messages(rows, F.col("content")).orderBy("turn").collect()
    assert got[0].segment == "### user\nsee \\l|image:9|><|image:0|><|audio:1|><|document:2|>\n</turn>\n" or got[0].segment == "### user\nsee \\l|image:9|><|image:1|><|audio:2|><|document:3|>\n</turn>\n"
    assert [(a.type, a.ref, a.n_tokens) for a in got[0].attachments] == [("image", "i.png", 3 * 576), ("audio", "a.wav", 63), ("document", "d.pdf", 3072)]
    assert got[0].n_expanded == 3 * 576 + 63 + 3072 and got[1].segment == got[2].segment == "### user\n\n</turn>\n"
    places = [int(x) for x in __import__("re").findall(r"<\|\w+:(\d+)\|>", got[0].segment)]
    assert places == [a.place for a in got[0].attachments]
