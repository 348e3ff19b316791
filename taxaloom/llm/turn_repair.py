"""Repair of conversations to ``system? (user assistant)+`` with the cheapest edits.

A row is a symbol: its role's initial (s, u, a or another) and whether it must go (blank, or role and text seen
earlier) or is truncated. A row is kept, given another role, or deleted, and rows without text may be inserted anywhere. The
pattern is an automaton of four states, so what a stretch of rows does is a min-plus matrix: for each pair of
states the least cost and, with it, the rope of the edits' initials (a tree of shared parts, spelled out only to settle a
tie). Matrices of neighbouring stretches multiply, in any grouping.

Sequences are compressed by Re-Pair: the most frequent neighbouring pairs of all conversations become symbols, round by
round. Each rule's matrix is the product of its two symbols' matrices, made once, bottom-up, and shared by all
conversations. Within a round pairs that share no symbol are taken, so their counts stay exact; a bound on
the rounds limits the compression, not the result.

A conversation is no group in a task. Its rows become symbols in ranges of turns, at most PIECE symbols in
a row of the table; matrices of pieces are multiplied in order, keeping only the part of the audit on which the four
states still differ. The repaired text is written, or digested, by one pass over rows sorted by Spark, a row at a time.

Rows of one conversation stand by turn (NULL first), then role, then digest of the text.

Cases: NULL roles and texts count as one space, a NULL conv_id is a conversation like any other; of repeated rows all
but the first are duplicates; tied turns keep the order above; other columns are ignored; a text of any
length is looked at whole; a conversation without rows has no edits; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaloom.llm.common import stored

SPACES = " \t\n\x0b\x0c\r"
STOPS = ".!?"
LEGAL = ("su", "ua", "au")

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5  # costs; to keep a row costs nothing
START, SYSTEM, USER, ASSISTANT = range(4)  # states, by the role that came last
ENDS = (START, ASSISTANT)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAMES = {"u": "user", "a": "assistant"}
GONE = "x"  # the symbol of a row that must go; truncated rows are upper case

FAR = 3 * INSERT + DELETE  # a state that costs more than this above another never wins

TURNS = 4096  # turns in a range
PIECE = 4096  # symbols in a piece
ROUNDS = 12  # of pair counting
PAIRS_LOOKED_AT = 64  # most frequent pairs a round chooses from
KEPT, REPEATED = 20_000, 32  # a task remembers the matrices of so many pieces of at most so many symbols

Rope = str | tuple
Entry = tuple[int, Rope]
Matrix = tuple[tuple[Entry | None, ...], ...]


# ---- matrices


def spelled(rope: Rope) -> str:
    """The letters of a rope, left to right."""
    out, todo = [], [rope]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            todo += (part[1], part[0])
    return "".join(out)


def better(a: Entry | None, b: Entry | None) -> Entry | None:
    """The cheaper of two entries; of equally cheap ones that whose letters come first.

    Equally cheap edits of the same rows are never one the beginning of the other, so this order is kept by whatever
    is put before or behind both.
    """
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if spelled(a[1]) <= spelled(b[1]) else b


def joined(a: Entry | None, b: Entry | None) -> Entry | None:
    if a is None or b is None:
        return None
    return a[0] + b[0], (a[1], b[1]) if a[1] and b[1] else a[1] or b[1]


def times(a: Matrix, b: Matrix) -> Matrix:
    rows = []
    for i in range(4):
        row = []
        for j in range(4):
            best = None
            for k in range(4):
                best = better(best, joined(a[i][k], b[k][j]))
            row.append(best)
        rows.append(tuple(row))
    return tuple(rows)


def _inserts() -> Matrix:
    """From each state to each by inserted rows alone."""
    rows = []
    for start in range(4):
        row: list[Entry | None] = [None] * 4
        reached, n = [start], 0
        while reached:
            for state in reached:
                row[state] = (n * INSERT, "I" * n)
            n += 1
            after = {STEPS[s, r] for s in reached for r in NAMES if (s, r) in STEPS}
            reached = [s for s in after if row[s] is None]
        rows.append(tuple(row))
    return tuple(rows)


INSERTS = _inserts()


def matrix_of(symbol: str) -> Matrix:
    """What one row does, with insertions before it."""
    cost = TRUNCATED if symbol.isupper() else 0
    rows = []
    for state in range(4):
        row: list[Entry | None] = [None] * 4
        row[state] = (DELETE, "D")
        if symbol != GONE:
            for role in NAMES:
                if (state, role) in STEPS:
                    to = STEPS[state, role]
                    row[to] = better(row[to], (REROLE + cost, "R"))
            to = STEPS.get((state, symbol.lower()))
            if to is not None:
                row[to] = better(row[to], (cost, "K"))
        rows.append(tuple(row))
    return times(INSERTS, tuple(rows))


class Grammar:
    """Re-Pair rules in order of making, and the matrix of every symbol."""

    FIRST = 0x100  # the character of the first rule

    def __init__(self, rules: Iterable[str] = ()):
        self.rules: list[tuple[str, str]] = []
        self.matrices: dict[str, Matrix] = {s: matrix_of(s) for s in (GONE, *"suaoSUAO")}
        self.add(rules)

    def add(self, pairs: Iterable[str]) -> None:
        for pair in pairs:
            symbol = chr(self.FIRST + len(self.rules))
            self.rules.append((pair, symbol))
            self.matrices[symbol] = times(self.matrices[pair[0]], self.matrices[pair[1]])

    def compressed(self, symbols: str) -> str:
        for pair, symbol in self.rules:
            if len(symbols) > 1:
                symbols = symbols.replace(pair, symbol)
        return symbols

    def matrix(self, symbols: str) -> Matrix:
        """The matrix of a sequence of at least one symbol: its compressed symbols' matrices, multiplied in order."""
        first, *rest = self.compressed(symbols)
        made = self.matrices[first]
        for symbol in rest:
            made = times(made, self.matrices[symbol])
        return made


def chosen_pairs(counts: Iterable[tuple[str, int]]) -> list[str]:
    """The most frequent pairs, none sharing a symbol with one before, each occurring twice at least."""
    pairs, used = [], set()
    for pair, n in sorted(counts, key=lambda x: (-x[1], x[0])):
        if n >= 2 and not used & set(pair):
            pairs.append(pair)
            used |= set(pair)
    return pairs


def learnt(sequences: DataFrame) -> Grammar:
    """The grammar of sequences (symbols, n: how often it occurs). A round brings PAIRS_LOOKED_AT counts to the driver."""
    grammar, here = Grammar(), sequences.filter(F.length("symbols") > 1)
    for _ in range(ROUNDS):
        pairs = F.transform(F.sequence(F.lit(1), F.length("symbols") - 1), lambda i: F.substring("symbols", i, F.lit(2)))
        counts = here.select("n", F.explode(pairs).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
        top = counts.orderBy(F.desc("n"), "pair").limit(PAIRS_LOOKED_AT).collect()
        before = len(grammar.rules)
        grammar.add(chosen_pairs((r["pair"], r["n"]) for r in top))
        if len(grammar.rules) == before:
            break
        symbols = F.col("symbols")
        for pair, symbol in grammar.rules[before:]:
            symbols = F.replace(symbols, F.lit(pair), F.lit(symbol))
        here = here.select(symbols.alias("symbols"), "n").filter(F.length("symbols") > 1)
        here = stored(here.groupBy("symbols").agg(F.sum("n").alias("n")), "sequences")
    return grammar


# ---- rows to symbols


def plain(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with one space for NULL roles and texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role, text)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after faults that the hash of conversation and turn picks."""
    key = F.concat(*(F.coalesce(x, F.lit(" ")) for x in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))))
    fault = F.crc32(key.cast("binary")) % 20
    given = plain(rows).withColumn("fault", fault).filter("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return given.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, key, blank, truncated, n (equal rows of one turn), first (whether none stands before)."""
    kept = F.rtrim(F.col("text"), F.lit(SPACES))
    each = rows.select(
        "conv_id",
        "turn",
        "role",
        _digest("text").alias("key"),
        (kept == "").alias("blank"),
        (~F.right(kept, F.lit(1)).isin(*STOPS)).alias("truncated"),
    )
    each = each.groupBy(*each.columns).agg(F.count("*").alias("n"))
    # What stands in several turns is short of the whole, and an aggregate never holds a group.
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = (
        each.groupBy("conv_id", "role", "key")
        .agg(F.count("*").alias("turns"), F.min(turn).alias("least"))
        .filter("turns > 1")
        .select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "key", "least")))
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("conv_id", "role", "key")]
    first = F.col("_key").isNull() | F.col("turn").eqNullSafe(F.col("_least.turn"))
    return each.join(again, same, "left").select(*each.columns, first.alias("first"))


PIECES = (
    "conv_id long, range long, part long, symbols string, first string, last string, illegal long, blank long, "
    "duplicate long, truncated long, turns long, low long, high long"
)
NUMBERS = ("illegal", "blank", "duplicate", "truncated", "turns")


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _schema(text: str) -> pa.Schema:
    types = {
        "long": pa.int64(),
        "int": pa.int32(),
        "string": pa.string(),
        "array<long>": pa.list_(pa.int64()),
        "array<string>": pa.list_(pa.string()),
    }
    return pa.schema([(name, types[kind]) for name, kind in (f.split() for f in text.split(", "))])


def _each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of conv_id, range, turn, role, blank, truncated, n, first, in order, to rows of PIECES."""
    at, part, held = None, 0, None

    def closed() -> tuple:
        return (*at, part, "".join(held["symbols"]), *(held[c] for c in ("first", "last", *NUMBERS, "low", "high")))

    turn_before: object = at
    for conv_id, span, turn, role, blank, truncated, n, first in rows:
        if (conv_id, span) != at:
            if held:
                yield closed()
            at, part, held, turn_before = (conv_id, span), 0, None, at
        initial = role[:1]
        fine = initial if initial in ("s", "u", "a") else "o"
        left, new = n, first
        while left:
            if held and held["size"] == PIECE:
                yield closed()
                part, held = part + 1, None
            if held is None:
                held = {"symbols": [], "size": 0, "first": initial, "last": None, "low": None, "high": None}
                held |= dict.fromkeys(NUMBERS, 0)
            taken = min(left, PIECE - held["size"])
            gone = taken if blank or not new else taken - 1
            held["blank" if blank else "duplicate"] += gone
            if taken > gone:
                held["truncated"] += truncated
                held["symbols"].append(fine.upper() if truncated else fine)
            held["symbols"].append(GONE * gone)
            pairs = taken - 1 + (held["last"] is not None)
            legal = held["last"] is not None and held["last"] + initial in LEGAL
            held["illegal"] += pairs - legal
            held["size"] += taken
            held["last"] = initial
            if turn is not None:
                held["turns"] += turn != turn_before
                held["low"] = turn if held["low"] is None else held["low"]
                held["high"] = turn
                turn_before = turn
            left, new = left - taken, False
    if held:
        yield closed()


def pieces(rows: DataFrame) -> DataFrame:
    """The symbols of all conversations in pieces, with what else is counted about them."""
    span = F.floor(F.col("turn") / TURNS).alias("range")
    each = _faults(rows).select("conv_id", span, "turn", "role", "blank", "truncated", "n", "first", "key")
    schema = _schema(PIECES)
    ordered = each.repartition("conv_id", "range").sortWithinPartitions("conv_id", "range", "turn", "role", "key")
    return ordered.drop("key").mapInArrow(lambda batches: _batches(_pieces(_each_row(batches)), schema), PIECES)


# ---- pieces to audits


def _with_matrices(found: DataFrame, grammar: Grammar) -> DataFrame:
    """Pieces with costs and audits: the matrix of each as two arrays of 16, NULL where no edits lead."""
    schema = f"{PIECES}, costs array<long>, audits array<string>"
    rules = [pair for pair, _ in grammar.rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kept = Grammar(rules), {}

        def written(symbols: str) -> tuple[list, list]:
            if symbols in kept:
                return kept[symbols]
            entries = [e for row in own.matrix(symbols) for e in row]
            made = [e and e[0] for e in entries], [e and spelled(e[1]) for e in entries]
            if len(symbols) <= REPEATED and len(kept) < KEPT:
                kept[symbols] = made
            return made

        yield from _batches(((*row, *written(row[3])) for row in _each_row(batches)), _schema(schema), 200)

    return found.mapInArrow(run, schema)


class Walk:
    """A conversation's edits so far: what is settled, and per state the cost and the audits not settled yet."""

    def __init__(self) -> None:
        self.settled: list[str] = []
        self.states: list[tuple[int, list[str]] | None] = [(0, []), None, None, None]

    def take(self, costs: list, audits: list) -> None:
        after: list[tuple[int, list[str]] | None] = [None] * 4
        for j in range(4):
            for i, state in enumerate(self.states):
                if state is None or costs[4 * i + j] is None:
                    continue
                cost, audit = state[0] + costs[4 * i + j], [*state[1], audits[4 * i + j]]
                best = after[j]
                if best is None or cost < best[0] or (cost == best[0] and "".join(audit) < "".join(best[1])):
                    after[j] = (cost, audit)
        # From any state an insertion or three, or a deletion, goes over to what another state's future does.
        least = min(s[0] for s in after if s is not None)
        after = [s and (s if s[0] <= least + FAR else None) for s in after]
        alive = [s[1] for s in after if s is not None]
        same = 0
        while all(len(a) > same for a in alive) and len({a[same] for a in alive}) == 1:
            same += 1
        self.settled += alive[0][:same]
        self.states = [s and (s[0], s[1][same:]) for s in after]

    def end(self) -> tuple[int, str]:
        """The least cost of the whole conversation, and its audit."""
        last = [INSERTS[i][j] if j in ENDS else None for i in range(4) for j in range(4)]
        self.take([e and e[0] for e in last], [e and spelled(e[1]) for e in last])
        cost, audit = min((s[0], "".join(s[1])) for s in self.states if s is not None)
        return cost, "".join(self.settled) + audit


AUDITS = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)


def _audits(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Pieces with matrices, in order, each conversation opened by a row without symbols, to rows of AUDITS."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    walk, sums, conv_id, last, low, high = None, {}, None, None, None, None

    def closed() -> tuple:
        gaps = 0 if low is None else high - low + 1 - sums["turns"]
        return (conv_id, gaps, *(sums[c] for c in ("blank", "duplicate", "truncated", "illegal")), *walk.end())

    for *row, costs, audits in rows:
        piece = dict(zip(names, row))
        if piece["symbols"] is None:
            if walk is not None:
                yield closed()
            walk, sums, conv_id = Walk(), dict.fromkeys(NUMBERS, 0), piece["conv_id"]
            last = low = high = None
            continue
        for name in NUMBERS:
            sums[name] += piece[name]
        if last is not None and last + piece["first"] not in LEGAL:
            sums["illegal"] += 1
        last = piece["last"]
        if piece["low"] is not None:
            low, high = piece["low"] if low is None else low, piece["high"]
        walk.take(costs, audits)
    if walk is not None:
        yield closed()


def audited(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """What is wrong with each conversation, the cost of its repair, and the edits; ``every`` may list more conv_ids."""
    found = stored(pieces(rows), "pieces")
    grammar = learnt(found.groupBy("symbols").agg(F.count("*").alias("n")))
    parts = _with_matrices(found, grammar)
    ids = (rows if every is None else every).select(F.col("conv_id").cast("long")).distinct()
    opening = ids.select(
        *(F.col(f.name) if f.name == "conv_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in parts.schema)
    )
    ordered = (
        parts.unionByName(opening)
        .withColumn("_inside", F.col("symbols").isNotNull())
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "_inside", "range", "part")
        .drop("_inside")
    )
    schema = _schema(AUDITS)
    return ordered.mapInArrow(lambda batches: _batches(_audits(_each_row(batches)), schema, 200), AUDITS)


# ---- audits to repaired conversations

REPAIRED = "conv_id long, position long, turn long, role string, text string, edit string"


def _repaired(rows: Iterator[tuple], audit_at: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """For each conversation its opening row and its repaired rows (turn, role, text, edit), to be used up in order.

    ``rows`` are opening rows (the columns of AUDITS) and rows of turns, told apart by the last field.
    """
    ahead = next(rows, None)

    def turns(audit: str) -> Iterator[tuple]:
        nonlocal ahead
        state, ahead = START, next(rows, None)
        for edit in audit:
            if edit == "I":
                role = "u" if (state, "u") in STEPS else "a"
                yield None, NAMES[role], "", edit
            else:
                turn, name, text = ahead[-4:-1]
                ahead = next(rows, None)
                if edit == "D":
                    continue
                role = name[:1] if edit == "K" else "u" if (state, "u") in STEPS else "a"
                yield turn, name if edit == "K" else NAMES[role], text, edit
            state = STEPS[state, role]

    while ahead is not None:
        opening = ahead
        yield opening, turns(opening[audit_at])


def _with_texts(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows, in order: the columns of AUDITS, turn, role, text, inside."""
    opening = audits.select(
        "*",
        F.lit(None).cast("long").alias("turn"),
        F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("binary").alias("_key"),
        F.lit(False).alias("_inside"),
    )
    own = rows.select("conv_id", "turn", "role", "text", _digest("text").alias("_key"), F.lit(True).alias("_inside"))
    every = opening.unionByName(own, allowMissingColumns=True)
    ordered = every.repartition("conv_id").sortWithinPartitions("conv_id", "_inside", "turn", "role", "_key")
    return ordered.select(*audits.columns, "turn", "role", "text", "_inside")


def repaired(rows: DataFrame) -> DataFrame:
    """The rows of repaired conversations: conv_id, position (from 0), turn, role, text, edit (K, R or I)."""
    given = plain(rows)
    found = audited(given)
    at, schema = found.columns.index("audit"), _schema(REPAIRED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (
            (opening[0], position, *turn)
            for opening, turns in _repaired(_each_row(batches), at)
            for position, turn in enumerate(turns)
        )
        yield from _batches(made, schema)

    return _with_texts(given, found).mapInArrow(run, REPAIRED)


def digests(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """The columns of ``audited`` and repaired_sha256, of the repaired rows as ``role:text`` lines."""
    given = plain(rows)
    found = audited(given, every)
    at, schema = found.columns.index("audit"), f"{AUDITS}, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for opening, turns in _repaired(_each_row(batches), at):
                digest, between = hashlib.sha256(), b""
                for _, role, text, _ in turns:
                    digest.update(b"%s%s:%s" % (between, role.encode(), text.encode()))
                    between = b"\n"
                yield *opening[: at + 1], digest.hexdigest()

        yield from _batches(each(), _schema(schema))

    return _with_texts(given, found).mapInArrow(run, schema)
