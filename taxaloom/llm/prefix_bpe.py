"""Byte-level BPE by a table of prefixes: every byte prefix of a piece has one valid last token.

A text is split by the vocabulary's pattern and each piece is encoded by itself. Within a piece, the encoding of a
prefix ends with exactly one token: of the tokens that are a suffix of the prefix, the one that may stand behind the
last token of what comes before it. Two tokens may stand side by side if merging their joined bytes gives
just these two again; a row of tokens is the encoding of its bytes if that holds for every neighbouring pair. So a table
with the last token of each prefix is filled from left to right, an automaton of all tokens proposing the suffixes,
and the ids are read off from its end.

The table makes changes exact and cheap. An append fills the new prefixes only. An edit keeps the prefixes before it
and stops behind it as soon as as many prefixes as the longest token has bytes agree with the old table: from
there on every choice reads agreeing entries. ``PrefixTable`` holds a text's tables, ``states`` and ``edited`` are
its Spark forms.

Cases: a NULL or empty text has no ids; repeated rows return a row each; a NULL doc_id is kept; bytes that are
no UTF-8 count as U+FFFD; special tokens in a text are plain text; other columns are ignored; an empty table
gives no rows. A piece of any length is filled in time proportional to it.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaloom.llm.common import texts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECES_KEPT = 500_000  # encoded pieces a task remembers, about 200 bytes each
PAIRS_KEPT = 500_000  # pairs of tokens whose side-by-side standing a worker remembers, about 110 bytes each
LONG_PIECE = 256  # longer pieces are encoded anew each time
LONG_TEXT = 1 << 20  # characters beyond which pieces are found one by one


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Vocabulary:
    """Tokens with their ranks, which are their ids, and the pattern that cuts texts into pieces."""

    kept: dict[tuple[str, str], Vocabulary] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Vocabulary:
        """The vocabulary of a file, once per worker: its size depends on the file alone."""
        if (path, pattern) not in cls.kept:
            with open(path, "rb") as lines:
                rows = [line.split() for line in lines if line.strip()]
            cls.kept[path, pattern] = cls({base64.b64decode(token): int(rank) for token, rank in rows}, pattern)
        return cls.kept[path, pattern]

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for the bytes {missing}")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(self.sizes.values())
        self.pieces = regex.compile(pattern)
        self.suffixes = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.suffixes.add_word(token.decode("latin-1"), rank)
        self.suffixes.make_automaton()
        self._stands: dict[int, bool] = {}
        self._base = max(ranks.values()) + 1

    def merged(self, data: bytes) -> list[int]:
        """The definition: of all neighbouring parts, the leftmost with the lowest joint rank merge first."""
        ranks, never = self.ranks, 1 << 62
        parts = [data[i : i + 1] for i in range(len(data))]
        joint = [ranks.get(data[i : i + 2], never) for i in range(len(data) - 1)]
        while joint and (best := min(joint)) < never:
            at = joint.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joint[at]
            if at:
                joint[at - 1] = ranks.get(parts[at - 1] + parts[at], never)
            if at < len(joint):
                joint[at] = ranks.get(parts[at] + parts[at + 1], never)
        return [ranks[p] for p in parts]

    def _learn(self, left: int, right: int) -> bool:
        """Whether right may follow left; left is -1 at the start of a piece."""
        if len(self._stands) >= PAIRS_KEPT:
            self._stands.clear()
        pair = [right] if left < 0 else [left, right]
        found = self.merged(b"".join(self.tokens[t] for t in pair)) == pair
        self._stands[left * self._base + right] = found
        return found

    def fill(self, data: bytes, last: array | list, until: int | None = None) -> None:
        """Appends to last, which holds the last tokens of some prefixes, those of the prefixes up to until."""
        have = len(last)
        end_at = len(data) if until is None else until
        if have >= end_at:
            return
        before = max(0, have - self.longest + 1)  # a token may reach back this far
        sizes, known, base, learn, add = self.sizes, self._stands.get, self._base, self._learn, last.append
        have -= before
        shift = before + 1
        for end, token in self.suffixes.iter(data[before:end_at].decode("latin-1")):
            if end < have:
                continue
            start = end + shift - sizes[token]
            left = last[start - 1] if start else -1
            fits = known(left * base + token)
            if fits is None:
                fits = learn(left, token)
            if fits:
                add(token)
                have += 1

    def refill(self, data: bytes, old: bytes, table: array) -> array:
        """The table of data, taken from that of old where both have the same beginning or end."""
        shorter = min(len(data), len(old))
        same = next((i for i in range(shorter) if data[i] != old[i]), shorter)
        tail = next((i for i in range(shorter - same) if data[-1 - i] != old[-1 - i]), shorter - same)
        last = array("i", table[:same])
        shift, agreed = len(old) - len(data), 0
        while len(last) < len(data) and agreed < self.longest:
            at = len(last)
            until = min(len(data), max(at, len(data) - tail) + self.longest)
            self.fill(data, last, until)
            for i in range(at, until):
                agreed = agreed + 1 if i >= len(data) - tail and last[i] == table[i + shift] else 0
                if agreed == self.longest:
                    del last[i + 1 :]
                    break
        last.extend(table[len(last) + shift :] if len(last) < len(data) else ())
        return last

    def read(self, last: array | list) -> list[int]:
        """The ids of a whole piece, from the last tokens of its prefixes."""
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= self.sizes[ids[-1]]
        return ids[::-1]

    def encode_piece(self, piece: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        last: list[int] = []
        self.fill(piece.encode(), last)
        return array("I", self.read(last)).tobytes()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PieceIds(dict):
    """The ids of pieces, each encoded once per task while it is remembered."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = self.vocabulary.encode_piece(piece)
        if len(piece) <= LONG_PIECE:
            if len(self) >= PIECES_KEPT:
                self.clear()
            self[piece] = ids
        return ids

    def of(self, text: str) -> bytes:
        pattern = self.vocabulary.pieces
        pieces = pattern.findall(text) if len(text) < LONG_TEXT else (m.group() for m in pattern.finditer(text))
        return b"".join(map(self.__getitem__, pieces))


class PrefixTable:
    """A text, the starts of its pieces, and the last token of every byte prefix of each piece."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary = vocabulary
        self.text, self.starts, self.tables = "", [], []
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replaces the characters start..stop by new; returns the number of pieces that were cut anew."""
        if not 0 <= start <= stop <= len(self.text):
            raise ValueError(f"no characters {start}..{stop} in a text of {len(self.text)}")
        text = self.text[:start] + new + self.text[stop:]
        shift = len(text) - len(self.text)
        ends = [*self.starts[1:], len(self.text)] if self.starts else []
        # The pattern looks two characters beyond a piece at most, and never back.
        first = bisect_right(ends, start - 2)
        at = self.starts[first] if first < len(self.starts) else (ends[-1] if ends else 0)
        starts, tables = self.starts[:first], self.tables[:first]
        by_start = {s: i for i, s in enumerate(self.starts[first:], first) if s <= start}
        by_end = {e + shift: i for i, e in enumerate(ends[first:], first) if e >= stop}
        rest = len(self.starts)
        for m in self.vocabulary.pieces.finditer(text, at):
            old = m.start() - shift
            if old >= stop:
                i = bisect_right(self.starts, old) - 1
                if i >= first and self.starts[i] == old:
                    rest = i
                    break
            piece = m.group().encode()
            known = by_start.get(m.start(), by_end.get(m.end()))
            if known is None:
                last = array("i")
                self.vocabulary.fill(piece, last)
            else:
                before = self.text[self.starts[known] : ends[known]].encode()
                last = self.vocabulary.refill(piece, before, self.tables[known])
            starts.append(m.start())
            tables.append(last)
        redone = len(starts) - first
        self.starts = starts + [s + shift for s in self.starts[rest:]]
        self.tables = tables + self.tables[rest:]
        self.text = text
        return redone

    def ids(self) -> list[int]:
        return [t for table in self.tables for t in self.vocabulary.read(table)]

    def packed(self) -> tuple[bytes, bytes]:
        """The starts and the last tokens of all pieces, as 32-bit numbers."""
        last = array("i")
        for table in self.tables:
            last.extend(table)
        return array("I", self.starts).tobytes(), last.tobytes()

    @classmethod
    def unpacked(cls, vocabulary: Vocabulary, text: str, starts: bytes, last: bytes) -> PrefixTable:
        made = cls(vocabulary)
        made.text, made.starts = text, array("I", starts).tolist()
        every, at = array("i", last), 0
        for a, b in zip(made.starts, [*made.starts[1:], len(text)]):
            n = len(text[a:b].encode())
            made.tables.append(every[at : at + n])
            at += n
        return made


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t.decode("utf-8", "replace") for t in texts(batch[name])]


def _kept(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


IDS = pa.list_(pa.int32())


def _encoded_rows(docs: DataFrame, path: str | None, schema: dict[str, tuple[str, pa.DataType]], row) -> DataFrame:
    """One row per document: doc_id and what row(vocabulary, ids as bytes) gives, with the types of schema."""
    path, pattern = path or vocabulary_path(), piece_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(path, pattern)
        pieces = PieceIds(vocabulary)  # goes with the task
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = zip(*(row(vocabulary, pieces.of(text)) for text in _texts(batch, "text")))
            made = [pa.array(c, kind) for c, (_, kind) in zip(columns, schema.values())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *made], ["doc_id", *schema])

    return _kept(docs).mapInArrow(run, ", ".join(["doc_id long", *(f"{c} {kind}" for c, (kind, _) in schema.items())]))


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (an array of token ids) of each row."""
    # Ids stay below 2**31, so the numbers read the same signed.
    return _encoded_rows(docs, path, {"ids": ("array<int>", IDS)}, lambda v, ids: (array("i", ids).tolist(),))


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids. Ids that cut through a character decode to U+FFFD there."""
    path, pattern = path or vocabulary_path(), piece_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(path, pattern)
        for batch in batches:
            found = [vocabulary.decode(row or ()).decode("utf-8", "replace") for row in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.string())], ["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id long, text string"
    )


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit numbers), decoded_sha256 (the ids turned into bytes)."""

    def row(vocabulary: Vocabulary, ids: bytes) -> tuple[int, str, str]:
        back = vocabulary.decode(array("I", ids))
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

    text = ("string", pa.string())
    schema = {"n_tokens": ("long", pa.int64()), "ids_sha256": text, "decoded_sha256": text}
    return _encoded_rows(docs, path, schema, row)


STATE = "doc_id long, text string, starts binary, last binary, ids array<int>"


def _state_batch(doc_ids: pa.Array, tables: list[PrefixTable]) -> pa.RecordBatch:
    packed = [t.packed() for t in tables]
    columns = [
        doc_ids,
        pa.array([t.text for t in tables], pa.string()),
        pa.array([starts for starts, _ in packed], pa.binary()),
        pa.array([last for _, last in packed], pa.binary()),
        pa.array([t.ids() for t in tables], IDS),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in STATE.split(", ")])


def states(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text, starts, last, ids: what ``edited`` needs to encode a changed text from its table."""
    path, pattern = path or vocabulary_path(), piece_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                yield _state_batch(some["doc_id"], [PrefixTable(vocabulary, t) for t in _texts(some, "text")])

    return _kept(docs).mapInArrow(run, STATE)


def edited(known: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """The states after edits (doc_id, start, stop, text: characters start..stop become text).

    One edit per doc_id and call; start and stop NULL append. Documents without an edit stay as they are. Only prefixes
    near an edit are encoded anew.
    """
    path, pattern = path or vocabulary_path(), piece_pattern()
    change = edits.select("doc_id", F.struct("start", "stop", F.coalesce("text", F.lit("")).alias("new")).alias("change"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                tables = []
                columns = [_texts(some, "text"), *(some[c].to_pylist() for c in ("starts", "last", "change"))]
                for text, starts, last, change in zip(*columns):
                    table = PrefixTable.unpacked(vocabulary, text, starts, last)
                    end = len(text)
                    if change is not None:
                        start, stop = (end if change[k] is None else change[k] for k in ("start", "stop"))
                        table.edit(start, stop, change["new"])
                    tables.append(table)
                yield _state_batch(some["doc_id"], tables)

    return known.join(change, "doc_id", "left").mapInArrow(run, STATE)
