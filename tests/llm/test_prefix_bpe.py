"""Byte-level BPE by prefix tables against the reference library, the plain merging rule and exact round trips."""

from __future__ import annotations

import hashlib
import random
from array import array

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from taxaloom.llm import prefix_bpe
from taxaloom.llm.common import documents
from taxaloom.llm.queries import queries

SF = "/root/testdata/sf0.001"
VOCABULARY = prefix_bpe.Vocabulary.of(prefix_bpe.vocabulary_path(), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={}
)
HARD = [
    "",
    " ",
    "  \n\n \t x",
    "don't we'll I'LL 'tis ''s 're",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "=" * 300 + "\t" * 40 + "0123456789" * 30,
    "naïve Größe Ærø 東京 данные 🎉🎉👩‍👩‍👧   x",
    "<|endoftext|></s>",
    "x" * 5000 + " " + "ab" * 3000,
]


def ids(text: str) -> list[int]:
    return array("I", prefix_bpe.PieceIds(VOCABULARY).of(text)).tolist()


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert VOCABULARY.decode(ids(text)) == text.encode()
    assert prefix_bpe.PrefixTable(VOCABULARY, text).ids() == ids(text)


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


@given(st.binary(max_size=40))
@settings(max_examples=200, deadline=None)
def test_any_bytes_as_one_piece(data):
    last = array("i")
    VOCABULARY.fill(data, last)
    assert VOCABULARY.read(last) == VOCABULARY.merged(data)
    for n in range(1, len(data) + 1):  # every prefix has its encoding in the table
        assert VOCABULARY.read(last[:n]) == VOCABULARY.merged(data[:n])


ALPHABET = ["a", "b", "aa", " ", "  ", "\n", "'", "l", "ll", "'ll", "1", "23", "é", "日本", "the", " of", "!", "==", "🎉"]


@pytest.mark.parametrize("seed", range(60))
def test_edits_equal_encoding_anew(seed):
    draw = random.Random(seed)
    text = "".join(draw.choices(ALPHABET, k=draw.randrange(120)))
    table = prefix_bpe.PrefixTable(VOCABULARY, text)
    for _ in range(8):
        start = draw.randrange(len(text) + 1)
        stop = min(len(text), start + draw.choice([0, 0, 1, 2, 30]))
        new = "".join(draw.choices(ALPHABET, k=draw.choice([0, 1, 3, 20])))
        table.edit(start, stop, new)
        text = text[:start] + new + text[stop:]
        fresh = prefix_bpe.PrefixTable(VOCABULARY, text)
        assert table.text == text
        assert table.starts == fresh.starts
        assert table.tables == fresh.tables
        assert table.ids() == LIBRARY.encode_ordinary(text)


def test_append_grows_with_what_is_appended():
    table = prefix_bpe.PrefixTable(VOCABULARY, "some words " * 20_000)
    filled = []
    table.vocabulary = Counting(filled)
    for more in ("and", " more", "'l", "l", "\n"):
        table.append(more)
    assert table.ids() == LIBRARY.encode_ordinary(table.text)
    assert sum(filled) < 200


def test_edit_inside_a_long_piece_fills_little():
    table = prefix_bpe.PrefixTable(VOCABULARY, "abcdefgh" * 4000)
    filled = []
    table.vocabulary = Counting(filled)
    table.edit(16_000, 16_001, "zq")
    assert table.ids() == LIBRARY.encode_ordinary(table.text)
    assert sum(filled) < 20 * VOCABULARY.longest


class Counting(prefix_bpe.Vocabulary):
    """The vocabulary, counting the prefixes that are filled."""

    def __init__(self, filled):
        self.__dict__.update(VOCABULARY.__dict__)
        self.filled = filled

    def fill(self, data, last, until=None):
        before = len(last)
        super().fill(data, last, until)
        self.filled.append(len(last) - before)


def test_query_on_the_whole_table(spark):
    got = {r["doc_id"]: r for r in queries()["op13_bpe_codec"](spark, SF).collect()}
    rows = documents(spark, SF).select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        expected = array("I", LIBRARY.encode_ordinary(text or ""))
        row = got[doc_id]
        assert row["n_tokens"] == len(expected)
        assert row["ids_sha256"] == hashlib.sha256(expected.tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_rows_of_all_kinds(spark):
    rows = [(1, "same text", 1), (1, "same text", 2), (None, "no id", 3), (2, None, 4), (3, "", 5), (4, "w " * 60_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(prefix_bpe.encoded(docs).collect(), key=str)
    expected = sorted(((i, LIBRARY.encode_ordinary(t or "")) for i, t, _ in rows), key=str)
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=str) == expected
    back = sorted((str(r["text"]) for r in prefix_bpe.decoded(prefix_bpe.encoded(docs)).collect()))
    assert back == sorted(t or "" for _, t, _ in rows)
    assert prefix_bpe.digests(docs.limit(0)).collect() == []
    assert prefix_bpe.states(docs.limit(0)).collect() == []


def test_spark_edits(spark):
    docs = spark.createDataFrame(
        [(1, "a short text"), (2, "it's here"), (3, None), (4, "stays")], "doc_id long, text string"
    )
    edits = spark.createDataFrame(
        [(1, 2, 7, "long"), (2, None, None, "'ll do"), (3, 0, 0, "now")], "doc_id long, start int, stop int, text string"
    )
    got = {r["doc_id"]: (r["text"], r["ids"]) for r in prefix_bpe.edited(prefix_bpe.states(docs), edits).collect()}
    texts = {1: "a long text", 2: "it's here'll do", 3: "now", 4: "stays"}
    assert got == {i: (t, LIBRARY.encode_ordinary(t)) for i, t in texts.items()}
