import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperloom.llm import codes, queries

PATH = queries.tokenizer_path()
TEXTS = ["Hello, World!", None, "", "  ", "naïve café ÀÉ\u0301 \u00a0x", "a<|endoftext|>b", "don't stop 12,345.6 it's", "日本語 text", "x" * 3000, "\u0130stanbul ﬁne", "A\tB\nC", "…“quotes”—dash", "ÿþ \x7f \x01b"]


def whole(text):
    return np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids if text else [], "<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_codes_give_every_id_at_once_and_alone(ids):
    found = codes.Codes(codes.encode_codes(np.array(ids, np.uint32)))
    assert len(found) == len(ids) and found.all().tolist() == ids
    for at in [*range(min(5, len(ids))), *range(max(0, len(ids) - 5), len(ids)), *range(0, len(ids), 97)]:
        assert found[at] == ids[at]


def test_remembered_words_give_the_librarys_ids():
    tokens = codes.Tokens(PATH)
    for _ in range(2):  # new, then remembered
        for text in TEXTS:
            assert tokens.encode(text.encode() if text is not None else None) == whole(text), text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text_gives_the_librarys_ids(text):
    text = text.encode("utf-8", "ignore").decode()
    assert codes.tokens(PATH).encode(text.encode()) == whole(text)


def test_documents_round_trip(spark, tmp_path):
    rows = [(k * 3 % 11 if k else None, t, "x") for k, t in enumerate(TEXTS)] + [(5, "again", "x"), (5, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first string")
    codes.write(docs, str(tmp_path / "codes"), PATH, segment_tokens=50)
    got = sorted(map(tuple, codes.documents(spark, str(tmp_path / "codes")).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and got[0][1] == 0
    end = np.array([codes.END_ID], "<u4").tobytes()
    want = sorted((r[0] is not None, r[0] or 0, len(x) // 4, zlib.crc32(x)) for r in rows for x in [whole(r[1]) + end])
    assert sorted((d is not None, d or 0, n, c) for d, _, n, c in got) == want


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    codes.write(docs, str(tmp_path / "codes"), PATH)
    assert codes.documents(spark, str(tmp_path / "codes")).count() == 0
