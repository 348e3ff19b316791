"""Language-model scores from a weighted backoff automaton.

The model is an interpolated absolute-discounting n-gram model of order 3. The unigram gives the discounted mass to
one unknown word; every n-gram of order 2 and 3 seen in training enters, those seen once too:

    p(w | h) = (c(h w) - D) / c(h)  [if c(h w) >= 1]  +  b(h) p(w | h'),   b(h) = 1 - sum over seen w of (c(h w) - D) / c(h)

with D = n1 / (n1 + 2 n2) per order, n1 and n2 being the numbers of all n-grams seen once and twice. As an automaton:
contexts are states, a seen n-gram is an arc with its log-probability, and a state's failure arc leads to the shorter
context and costs log b(h). A text is one left-to-right traversal that carries the state and sums up weights. A text
begins in the state of the text start; its end is a token.

The model grows with the corpus, so it is never in one place. Documents are written once in blocks of numbered
tokens (common.Blocks), a row each, which every later pass reads. Per order, each
block sends its distinct n-gram hashes, sorted and packed, with its own counts to hash buckets; a bucket adds up and
sends each block the totals of what that block asked for, in the order asked, so hashes travel one way only. A hash
is in a bucket once per block at most, however frequent the n-gram. A third kind of sum, by context, gives how many n-grams a
context has: the first block that asked for an n-gram reports it, so each counts once. Their mass is the context's own count, since a
token stands behind every occurrence. Then every block
builds the automaton of the n-grams it holds and runs its texts through. An n-gram is only asked for if its shorter parts
were seen in training, and if other blocks asked for both: what holds a part that stands in one block only is in that block
only, so its own counts are the totals.

What came back in a round is a table in the buckets of the blocks, a row per block, so later rounds join it without moving
it again. Buckets of n-grams are as many as the text needs, not as there are blocks.

Words and n-grams are known by 64-bit hashes. Their bucket and 48 of their bits travel: buckets grow in number with the text, so
a bucket holds about as many keys at any size, and few enough for 48 bits.

Cases: a NULL or empty text is the end token alone; NULL ids count as the empty text in the split and keep their row;
repeated rows count and score once each; other columns are ignored; an empty table gives no rows. With no training text
every probability is 1.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaloom.llm.common import Blocks, forget_shuffles, mix, stored

ORDER = 3
MIN_COUNT = 1  # every n-gram seen in training is an arc and counts for the discounts; the mass of a context rests on that
BLOCK_BYTES = 4 * 1024 * 1024  # of text; a block's automaton holds every n-gram, as arrays
BUCKET_BYTES = 8 * 1024 * 1024  # of text whose n-grams of one order are added up in one task
STRETCH = 256  # tokens of a text that are traversed in one go
FOLDS, HELD_OUT = 7, 2
BASE = np.uint64(0x9E3779B97F4A7C15)
START, END = (xxhash.xxh3_64_intdigest(x, seed=1) for x in (b"start of text", b"end of text"))
NONE = -1


def in_training(doc_id: int | None) -> bool:
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS != HELD_OUT


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, most of them small: a byte each, and eight more for those from 255 on."""
    large = numbers[numbers >= 255].astype(np.int64)
    return np.minimum(numbers, 255).astype(np.uint8).tobytes() + large.tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    head = np.frombuffer(data, np.uint8, n)
    out = head.astype(np.int64)
    out[head == 255] = np.frombuffer(data, np.int64, offset=n)
    return out


KEY_BYTES = 6


def short_keys(keys: np.ndarray) -> bytes:
    """The low bytes of keys, KEY_BYTES each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def long_keys(data: bytes) -> np.ndarray:
    """The numbers that short_keys wrote."""
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


class Sums:
    """Totals that came back for the keys a block asked for, by kind.

    ``answers`` are (kind, bucket, totals, first, alone).
    """

    def __init__(self, answers: Iterable[tuple[str, int, bytes, bytes, bytes]], buckets: int):
        self.buckets = buckets
        self.by_kind: dict[str, dict[int, tuple]] = defaultdict(dict)
        for kind, bucket, *bits in answers:
            self.by_kind[kind][bucket] = bits

    def of(self, kind: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Totals of keys, and whether this block was the first or the only one to ask, in the order in which they were asked for."""
        totals = np.zeros(len(keys), np.int64)
        first, alone = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for bucket, at in split(keys, self.buckets):
            t, f, a = self.by_kind[kind][bucket]
            totals[at] = unpacked(t, len(at))
            first[at] = np.unpackbits(np.frombuffer(f, np.uint8), count=len(at))
            alone[at] = np.unpackbits(np.frombuffer(a, np.uint8), count=len(at))
        return totals, first, alone


def split(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indices of the keys of each bucket, in order of keys."""
    bucket = ((keys >> np.uint64(33)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if len(keys) else np.zeros(1, int)
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(bucket[order[start]]), order[start:end]


def _encode(rows: pa.Table) -> pa.Table:
    """A block's documents as one row: ids, tokens per document, tokens numbered as they appear, the hashes of their words.

    Frequent words appear early, so most numbers are small and compress well.
    """
    text = pc.fill_null(rows["text"].combine_chunks().cast(pa.large_string()), "")
    words = pc.ascii_split_whitespace(pc.ascii_lower(text))
    told = pc.greater(pc.binary_length(words.flatten()), 0)  # blanks around a text leave empty words
    found = words.flatten().filter(told).dictionary_encode()
    bounds = np.append(0, np.cumsum(told.to_numpy(zero_copy_only=False)))[words.offsets.to_numpy()]
    # The end of a text has number 0, before all words.
    tokens = np.insert(found.indices.to_numpy() + np.int32(1), bounds[1:], 0)
    distinct = found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    hashes = np.append(np.uint64(END), np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct)))
    sizes = (np.diff(bounds) + 1).tolist()
    one = (rows["block"][0].as_py(), rows["doc_id"].to_pylist(), sizes, tokens.tobytes(), hashes.tobytes())
    return pa.table([pa.array([x], f.type) for x, f in zip(one, ENCODED)], schema=ENCODED)


ENCODED = pa.schema(
    [
        ("block", pa.int32()),
        ("ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())),
        ("tokens", pa.binary()),
        ("words", pa.binary()),
    ]
)


class Block:
    """The tokens of a block's documents as local numbers, documents one after another."""

    def __init__(self, row: pa.RecordBatch):
        self.ids, sizes, tokens, words = (row[n][0].as_py() for n in ENCODED.names[1:])
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.trained = np.array([in_training(i) for i in self.ids], bool)
        self.counted = np.flatnonzero(np.repeat(self.trained, self.sizes))  # positions of training texts
        found, place = np.frombuffer(words, np.uint64), np.frombuffer(tokens, np.int32).astype(np.int64)
        self.hash = found[place]
        # Per order: distinct keys as they appear, and the place of each position's n-gram there or NONE.
        self.order: dict[int, tuple] = {1: (found, place)}

    def before(self, values: np.ndarray, at_start) -> np.ndarray:
        """The value one position to the left; at_start at the first token of a text."""
        moved = np.empty_like(values)
        moved[1:] = values[:-1]
        moved[self.starts] = at_start
        return moved

    def unique(self, n: int, keys: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys among the positions of where, and for each position its place there or NONE.

        What holds an n-gram that the block has once is there once too, so it is not looked up among the others.
        """
        shorter, at = self.order[n - 1]
        once = np.append(np.bincount(at + 1, minlength=len(shorter) + 1)[1:] == 1, False)[at]
        once |= self.before(once, False)
        again, single = np.flatnonzero(where & ~once), np.flatnonzero(where & once)
        place = np.full(len(keys), NONE, np.int64)
        place[again], found = pd.factorize(keys[again])
        place[single] = np.arange(len(found), len(found) + len(single))
        found = np.concatenate([found, keys[single]])
        self.order[n] = (found, place)
        return found, place

    def local_counts(self, n: int) -> np.ndarray:
        found, place = self.order[n]
        return np.bincount(place[self.counted] + 1, minlength=len(found) + 1)[1:]


class Grams:
    """What a block knows of each order after the sums of the rounds so far."""

    def __init__(self, block: Block, sums: Sums, orders: int):
        self.block, self.total, self.first, self.alone = block, {}, {}, {}
        self.own = {1: np.zeros(len(block.order[1][0]), bool)}  # n-grams that stand in no other block, known before asking
        self.key = {1: block.hash}
        self.where = {1: np.ones(len(block.hash), bool)}  # positions whose n-gram can reach the threshold
        self.follows: dict[int, np.ndarray] = {}  # positions whose context can
        for n in range(1, orders + 1):
            if n > 1:
                self.extend(n)
            self.total[n], self.first[n], self.alone[n] = block.local_counts(n), self.own[n].copy(), self.own[n].copy()
            asked = ~self.own[n]
            self.total[n][asked], self.first[n][asked], self.alone[n][asked] = sums.of(f"n{n}", block.order[n][0][asked])

    def at(self, n: int, values: np.ndarray, missing) -> np.ndarray:
        """Values of an order's distinct n-grams at each position."""
        # NONE is the last place, which holds what is missing.
        return np.append(values, values.dtype.type(missing))[self.block.order[n][1]]

    def extend(self, n: int) -> None:
        """Keys of order n where both shorter parts are frequent enough."""
        block = self.block
        enough = self.at(n - 1, self.total[n - 1] >= MIN_COUNT, False)
        start = np.uint64(START) if n == 2 else np.uint64(0)
        self.key[n] = mix(block.before(self.key[n - 1], start) * BASE + block.hash)
        # The start of text is a context of length one, so order 2 begins at the first token.
        self.follows[n] = block.before(enough, n == 2)
        self.where[n] = enough & self.follows[n]
        found, place = block.unique(n, self.key[n], self.where[n])
        alone = self.at(n - 1, self.alone[n - 1], False)
        alone |= block.before(alone, False)
        self.own[n] = np.zeros(len(found), bool)
        self.own[n][place[alone & self.where[n]]] = True

    def context_request(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contexts of order-n positions, the place of each position's, the n-grams that this block reports of them, and which are its own."""
        block = self.block
        shorter, shorter_place = block.order[n - 1]
        found, place = block.order[n]
        where, follows = self.where[n], self.follows[n]
        # A context is an n-gram of the order below, or the start of text, which stands behind them all.
        behind = block.before(shorter_place, len(shorter) if n == 2 else NONE)
        every = np.append(shorter, np.uint64(START))
        behind[~follows] = len(every)  # behind all, where nothing is used
        used = np.zeros(len(every) + 1, bool)
        used[behind] = True
        used[-1] = False
        number = np.append(np.cumsum(used[:-1]) - 1, NONE)
        of, used = number[behind], used[:-1]
        context = np.zeros(len(found) + 1, np.int64)
        context[place] = of  # positions without an n-gram write behind the others
        context = context[:-1]
        keys = every[used]
        mine = self.first[n] & (self.total[n] >= MIN_COUNT)
        kinds = np.bincount(context[mine], minlength=len(keys))
        return keys, of, kinds, np.append(self.alone[n - 1], False)[used]


REQUEST = pa.schema(
    [
        ("block", pa.int32()),
        ("kind", pa.string()),
        ("bucket", pa.int32()),
        ("keys", pa.binary()),
        ("values", pa.binary()),
        ("own", pa.list_(pa.int64())),  # numbers on the n-grams that the block did not have to ask for
    ]
)
ANSWER = pa.schema(
    [
        ("block", pa.int32()),
        ("kind", pa.string()),
        ("bucket", pa.int32()),
        ("totals", pa.binary()),
        ("first", pa.binary()),
        ("alone", pa.binary()),
        ("sum", pa.int64()),
        ("distinct", pa.int64()),
        ("once", pa.int64()),
        ("twice", pa.int64()),
    ]
)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    names[pa.list_(pa.int64())] = "array<long>"
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _stats(counts: np.ndarray) -> list[int]:
    """Sum, n-grams seen, n-grams seen once, n-grams seen twice."""
    return [int(counts.sum()), int((counts > 0).sum()), int((counts == 1).sum()), int((counts == 2).sum())]


def _requests(
    number: int, kind: str, keys: np.ndarray, values: np.ndarray, buckets: int, own: list[int] | None = None
) -> Iterator[tuple]:
    """A row per bucket; the first one carries own, and stands alone where no key is asked for."""
    for bucket, at in split(keys, buckets):
        yield number, kind, bucket, short_keys(keys[at]), packed(values[at]), own
        own = None
    if own is not None:
        yield number, kind, number % buckets, b"", b"", own


def _add_up(rows: pa.Table) -> pa.Table:
    """Totals by key over all blocks of a bucket, back to each block in its own order."""
    rows = rows.sort_by("block")
    block, kind, bucket, keys, values, own = (rows[c].to_pylist() for c in REQUEST.names)
    keys = [long_keys(k) for k in keys]
    values = [unpacked(v, len(k)) for k, v in zip(keys, values)]
    inverse, found = pd.factorize(np.concatenate(keys))
    total = np.bincount(inverse, np.concatenate(values), len(found)).astype(np.int64)
    # Numbers rise where a key appears first.
    mark = np.diff(np.maximum.accumulate(inverse), prepend=-1) > 0 if len(inverse) else np.zeros(0, bool)
    alone = np.bincount(inverse, minlength=len(found))[inverse] == 1
    ends = np.cumsum([len(k) for k in keys])
    stats = np.sum([_stats(total), *(o for o in own if o is not None)], axis=0).tolist()
    out = []
    for i, end in enumerate(ends):
        at = slice(end - len(keys[i]), end)
        told = stats if i == 0 else [None] * 4  # numbers of the whole bucket, told once
        bits = (np.packbits(b[at]).tobytes() for b in (mark, alone))
        out.append((block[i], kind[i], bucket[i], packed(total[inverse[at]]), *bits, *told))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), ANSWER)], schema=ANSWER)


def _known(batch: pa.RecordBatch, i: int, rounds: int, buckets: int) -> tuple[pa.RecordBatch, Sums]:
    """A block's row, and the sums of the rounds before."""
    row = batch.slice(i, 1)
    answers = [a for n in range(1, rounds + 1) for a in row[f"round{n}"][0].as_py() or ()]
    return row, Sums([tuple(a[c] for c in ANSWER.names[1:6]) for a in answers], buckets)


def _round(n: int, buckets: int):
    """Requests of round n: counts of order n, and sums by context of order n - 1."""

    def of_block(row: pa.RecordBatch, sums: Sums) -> Iterator[tuple]:
        number, block = row["block"][0].as_py(), Block(row)
        grams = Grams(block, sums, n - 1)
        if 1 < n <= ORDER:
            grams.extend(n)
        if n <= ORDER:
            asked, counts = ~grams.own[n], block.local_counts(n)
            keys = block.order[n][0][asked]
            yield from _requests(number, f"n{n}", keys, counts[asked], buckets, _stats(counts[~asked]))
        if n == 1:
            # Texts begun in training, as a count of its own.
            start = np.array([START], np.uint64)
            yield from _requests(number, "start", start, np.array([block.trained.sum()]), buckets)
        if n > 2:
            keys, _, values, own = grams.context_request(n - 1)
            yield from _requests(number, f"c{n - 1}", keys[~own], values[~own], buckets)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = list(of_block(*_known(batch, i, n - 1, buckets)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), REQUEST)], schema=REQUEST)

    return ask


class Model:
    """Numbers of the whole corpus: tokens, words, discounts, training texts."""

    def __init__(self, stats: dict[str, tuple[int, int, int, int]]):
        self.tokens, self.words = stats.get("n1", (0, 0, 0, 0))[:2]
        self.texts = stats.get("start", (0, 0, 0, 0))[0]
        self.discount = {}
        for n in range(1, ORDER + 1):
            _, _, once, twice = stats.get(f"n{n}", (0, 0, 0, 0))
            self.discount[n] = once / (once + 2 * twice) if once and twice else 0.5


class Automaton:
    """States, arcs and failure arcs of the n-grams of one block.

    A state is a context: 0 is the empty one, others are numbered as they appear. Tokens are places among the block's
    distinct words. Arcs are numbered: ``weight`` and ``target`` hold their log-probabilities and next states. The empty
    state has an arc for every token, with the token's number; the others follow in order of state * words + token, which
    ``keys`` holds. ``fail`` and ``back`` are each state's failure arc and its cost.
    """

    def __init__(self, grams: Grams, sums: Sums, model: Model):
        block = grams.block
        place = block.order[1][1]
        self.words = max(1, len(block.order[1][0]))
        counts = grams.total[1]
        d = model.discount[1]
        if model.tokens:
            p1 = np.where(counts > 0, (counts - d) / model.tokens, d * model.words / model.tokens)
        else:
            p1 = np.ones(len(counts))
        self.token = place
        p = p1[place]  # probability of each position's token in the context of the order so far
        fails, backs = [np.zeros(1, np.int64)], [np.zeros(1)]
        contexts: dict[int, np.ndarray] = {}  # per order: at each position, the state of its context or 0
        lower = np.zeros(len(place), np.int64)
        self.start, size = 0, 1
        held = []
        for n in range(2, ORDER + 1):
            keys, of, kinds, own = grams.context_request(n)
            kinds[~own] = sums.of(f"c{n}", keys[~own])[0]
            total = block.before(grams.at(n - 1, grams.total[n - 1], 0), model.texts if n == 2 else 0)
            known = np.flatnonzero(kinds > 0)
            numbers = np.zeros(len(keys), np.int64)
            numbers[known] = size + np.arange(len(known))
            here = np.append(numbers, 0)[of]
            # A position with a known context: any such position tells the context's count and shorter context.
            inside = here > 0
            seen = np.flatnonzero(inside)
            one, state = np.zeros(len(known), np.int64), here[seen] - size
            one[state] = seen
            # A token stands behind each occurrence of a context, so the counts of its n-grams add up to its own.
            mass = total[one]
            spare = 1 - (mass - model.discount[n] * kinds[known]) / np.maximum(1, mass)
            spare = np.maximum(spare, 1e-12)
            fails.append(lower[one])
            backs.append(np.log10(spare))
            counts_here = grams.at(n, grams.total[n], 0)
            p = p.copy()
            p[seen] *= spare[state]
            arc = np.flatnonzero((counts_here >= MIN_COUNT) & inside)
            p[arc] += (counts_here[arc] - model.discount[n]) / total[arc]
            held.append((here, arc, p))
            contexts[n] = lower = here
            size += len(known)
            if n == 2 and len(block.starts):
                self.start = int(here[block.starts].max())
        self.fail, self.back = np.concatenate(fails), np.concatenate(backs)

        # After a token comes the longest context that is a state: what the next position calls its context.
        def following(n: int) -> np.ndarray:
            after = np.zeros(len(place), np.int64)
            after[:-1] = contexts[n][1:]
            after[block.starts[1:] - 1] = 0
            return after

        def of_each(targets: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
            """The next state of each of n arcs, from places that have one: a text's last token has no follower."""
            some = targets > 0
            state = np.zeros(n, np.int64)
            state[number[some]] = targets[some]
            return state

        target = following(2)
        weights, targets = [np.log10(p1)], [of_each(target, place, self.words)]
        keys = []
        for n, (here, arc, prob) in enumerate(held, 2):
            found, gram = block.order[n]
            # One place of each n-gram tells its context, token and probability.
            one = np.full(len(found), NONE, np.int64)
            one[gram[arc]] = arc
            numbers = np.flatnonzero(one >= 0)
            one = one[numbers]
            # An arc of order n leads to a state of order n + 1 if the n-gram is a context, else to the next shorter.
            if n < ORDER:
                after = following(n + 1)
                target = np.where(after > 0, after, target)
            keys.append(here[one] * self.words + place[one])
            weights.append(np.log10(prob[one]))
            targets.append(of_each(target[arc], gram[arc], len(found))[numbers])
        every = np.concatenate(keys)
        order = np.argsort(every)
        self.keys = every[order]
        # Where each state's arcs begin, and their tokens: most states have one arc, which needs no search.
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(self.keys // self.words, minlength=size))])
        self.expected = self.keys % self.words
        self.weight = np.concatenate([weights[0], np.concatenate(weights[1:])[order]])
        self.target = np.concatenate([targets[0], np.concatenate(targets[1:])[order]])

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log-probability of a token in each state, failure arcs and all, and the state after it."""
        gain, arc = np.zeros(len(token)), token.copy()
        open_ = np.flatnonzero(state)
        at = state[open_]
        while len(open_) and len(self.keys):
            wanted, place = token[open_], np.minimum(self.begin[at], len(self.keys) - 1)
            several = np.flatnonzero((self.begin[at + 1] - self.begin[at] > 1) & (self.expected[place] != wanted))
            key = at[several] * self.words + wanted[several]
            place[several] = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.expected[place] == wanted) & (self.begin[at] <= place) & (place < self.begin[at + 1])
            arc[open_[hit]] = self.words + place[hit]
            open_, at = open_[~hit], at[~hit]
            gain[open_] += self.back[at]
            at = self.fail[at]
            open_, at = open_[at > 0], at[at > 0]
        return gain + self.weight[arc], self.target[arc]

    def scores(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The log10 probabilities of texts, each traversed from left to right.

        All texts go at once, a token a step. A long one goes in stretches: a state is a context of at most ORDER - 1 tokens, so a
        stretch that first reads as many tokens before it, uncounted, is in the state the traversal would bring.
        """
        parts = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = starts[text] + number * STRETCH
        end = np.minimum(first + STRETCH, starts[text] + sizes[text])
        begin = first - np.where(number > 0, ORDER - 1, 0)
        by_length = np.argsort(begin - end, kind="stable")
        first, end, begin = first[by_length], end[by_length], begin[by_length]
        state = np.where(number[by_length] > 0, 0, self.start)
        total = np.zeros(len(text))
        active = len(text)
        for step in range(int((end - begin).max(initial=0))):
            while begin[active - 1] + step >= end[active - 1]:
                active -= 1
            at = begin[:active] + step
            gain, state[:active] = self.step(state[:active], self.token[at])
            total[:active] += np.where(at >= first[:active], gain, 0.0)
        return np.bincount(text[by_length], total, len(sizes))


SCORED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("train_tokens", pa.int64()),
        ("base_score", pa.float64()),
        ("score", pa.float64()),
    ]
)
SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _scorer(model: Model, buckets: int):
    def of_block(row: pa.RecordBatch, sums: Sums) -> Iterator[tuple]:
        block = Block(row)
        grams = Grams(block, sums, ORDER)
        automaton = Automaton(grams, sums, model)
        counts = grams.at(1, grams.total[1], 0)
        base = np.log10((counts + 1) / (model.tokens + model.words + 1))
        scores = automaton.scores(block.starts, block.sizes).tolist()
        bases, known = (np.add.reduceat(x, block.starts).tolist() for x in (base, (counts > 0).astype(np.int64)))
        for doc_id, size, trained, *numbers in zip(block.ids, block.sizes.tolist(), block.trained.tolist(), known, bases, scores):
            yield doc_id, not trained, size, numbers[0], model.tokens, *numbers[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = list(of_block(*_known(batch, i, ORDER + 1, buckets)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SCORED)], schema=SCORED)

    return run


def _by_block(found: DataFrame, blocks: Blocks, n: int) -> DataFrame:
    """The answers of a round as a row per block, in the buckets of the blocks; and the numbers told by its buckets."""
    answer = F.struct(*ANSWER.names[1:6])
    told = F.when(F.col("sum").isNotNull(), F.struct("kind", "sum", "distinct", "once", "twice"))
    return blocks.beside(
        found.groupBy("block").agg(F.collect_list(answer).alias(f"round{n}"), F.collect_list(told).alias(f"told{n}")), f"sums{n}"
    )


def scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document with the columns of SCHEMA, as a stored table."""
    blocks = Blocks(docs, block_bytes, _encode, _ddl(ENCODED))
    buckets = max(1, blocks.count * block_bytes // bucket_bytes)
    known, stats = blocks.frame, {}
    for n in range(1, ORDER + 2):
        asked = known.mapInArrow(_round(n, buckets), _ddl(REQUEST))
        answers = _by_block(asked.groupBy("kind", "bucket").applyInArrow(_add_up, _ddl(ANSWER)), blocks, n)
        # Four numbers per kind.
        told = answers.select(F.explode(f"told{n}").alias("t")).groupBy("t.kind")
        sums = told.agg(*[F.sum(f"t.{c}") for c in ("sum", "distinct", "once", "twice")]).collect()
        stats |= {r[0]: tuple(r[1:]) for r in sums}
        known = known.join(answers.drop(f"told{n}"), "block", "left")
        del asked
        forget_shuffles(docs.sparkSession)
    scored = stored(known.mapInArrow(_scorer(Model(stats), buckets), SCHEMA), "scores")
    blocks.drop()
    return scored
