"""Repair of conversations against a search of all edits, and against a plain model of the whole query."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from taxaloom.llm import turn_repair
from taxaloom.llm.common import table
from taxaloom.llm.queries import queries

SF = "/root/testdata/sf0.001"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}  # by the role before


def cheapest(symbols):
    """Every state after every row with its least (cost, audit), plain strings all along."""

    def inserted(reached):
        found = dict(reached)
        for _ in range(3):
            for state, (cost, audit) in list(found.items()):
                for role in "ua":
                    if role in NEXT[state]:
                        new = (cost + 5, audit + "I")
                        to = NEXT[state][role]
                        found[to] = min(new, found.get(to, new))
        return found

    reached = {"": (0, "")}
    for symbol in symbols:
        after = {}
        extra = 5 if symbol.isupper() else 0
        for state, (cost, audit) in inserted(reached).items():
            options = [(state, cost + 2, audit + "D")]
            if symbol != "x":
                options += [(r, cost + 1 + extra, audit + "R") for r in "ua" if r in NEXT[state]]
                options += [(r, cost + extra, audit + "K") for r in "sua" if r == symbol.lower() and r in NEXT[state]]
            for to, *entry in options:
                after[to] = min(tuple(entry), after.get(to, tuple(entry)))
        reached = after
    return min(v for k, v in inserted(reached).items() if k in ("", "a"))


def by_grammar(symbols, grammar, cuts=()):
    walk = turn_repair.Walk()
    for a, b in zip([0, *cuts], [*cuts, len(symbols)]):
        if b > a:
            entries = [e for row in grammar.matrix(symbols[a:b]) for e in row]
            walk.take([e and e[0] for e in entries], [e and turn_repair.spelled(e[1]) for e in entries])
    return walk.end()


@pytest.mark.parametrize("seed", range(200))
def test_audits_are_the_cheapest_and_least(seed):
    draw = random.Random(seed)
    letters = draw.choice(["ua", "suaoSUAOx", "uaUAx", "sx", "oO", "aA"])
    symbols = "".join(draw.choices(letters, k=draw.randrange(24)))
    rules = []
    grammar = turn_repair.Grammar()
    for _ in range(draw.randrange(12)):  # any rules give the same result
        pair = "".join(draw.choices(list(grammar.matrices), k=2))
        rules.append(pair)
        grammar.add([pair])
    cuts = sorted(draw.sample(range(len(symbols) + 1), min(3, len(symbols))))
    assert by_grammar(symbols, grammar) == cheapest(symbols)
    assert by_grammar(symbols, turn_repair.Grammar(rules), cuts) == cheapest(symbols)


def test_equally_cheap_audits_are_never_beginnings_of_each_other():
    draw = random.Random(7)
    for _ in range(50):
        symbols = "".join(draw.choices("suaoSUAOx", k=12))
        for row in turn_repair.Grammar().matrix(symbols):
            for entry in row:
                assert entry is None or sum(c != "I" for c in turn_repair.spelled(entry[1])) == len(symbols)


def test_a_long_conversation_settles_its_audit():
    walk = turn_repair.Walk()
    entries = [e for row in turn_repair.Grammar(["ua"]).matrix("ua" * 50 + "x") for e in row]
    costs, audits = [e and e[0] for e in entries], [e and turn_repair.spelled(e[1]) for e in entries]
    for _ in range(3000):
        walk.take(costs, audits)
        assert max(len(s[1]) for s in walk.states if s) < 20
    cost, audit = walk.end()
    assert (cost, audit) == (6000, ("K" * 100 + "D") * 3000)


@pytest.mark.parametrize("seed", range(40))
def test_long_conversations_row_by_row(seed):
    draw = random.Random(seed)
    symbols = "".join(draw.choices("suaoSUAOx", [1, 9, 9, 1, 1, 1, 1, 1, 2], k=400))
    assert by_grammar(symbols, turn_repair.Grammar(), list(range(1, 400))) == cheapest(symbols)


def test_pairs_of_a_round_share_no_symbol():
    assert turn_repair.chosen_pairs([("ua", 9), ("au", 9), ("xs", 3), ("oo", 1)]) == ["au", "xs"]


def model(rows, damage=True):
    """The contract's columns for rows of (conv_id, turn, role, text), one conversation after another."""
    by_id = {}
    for conv_id, turn, role, text in rows:
        own = by_id.setdefault(conv_id, [])
        shown = " " if conv_id is None else conv_id, " " if turn is None else turn
        fault = zlib.crc32(b"%s:%s" % tuple(str(x).encode() for x in shown)) % 20 if damage else 99
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    found = {}
    for conv_id, own in by_id.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, symbols, counts = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for turn, role, text in own:
            kept = text.rstrip(" \t\n\x0b\x0c\r")
            first = role[:1] if role[:1] in ("s", "u", "a") else "o"
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else None
            fault = fault or ("truncated" if kept[-1] not in ".!?" else None)
            if fault:
                counts[fault] += 1
            symbols += first.upper() if fault == "truncated" else "x" if fault else first
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest(symbols)
        lines, rest, before = [], iter(own), ""
        for edit in audit:
            role = "u" if "u" in NEXT[before] else "a"
            if edit == "I":
                lines.append({"u": "user", "a": "assistant"}[role] + ":")
            else:
                _, name, text = next(rest)
                if edit == "D":
                    continue
                role = name[:1] if edit == "K" else role
                lines.append(f"{name if edit == 'K' else {'u': 'user', 'a': 'assistant'}[role]}:{text}")
            before = role
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        found[conv_id] = (gaps, *counts.values(), illegal, cost, audit, digest)
    return found


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def rows_of(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = rows_of(queries()["op12_conversation_repair"](spark, SF))
    assert got == model(rows)
    assert {c for r in got.values() for c in r[6]} >= set("KRD")


def test_rows_of_all_kinds(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(None, None, None, None), (None, 1, "user", "Hm."), (-5, -3, "user", "a."), (-5, 9, "assistant", "b")]
    for conv_id in range(150):
        for _ in range(draw.randrange(1, 14)):
            role = draw.choice(["user", "assistant", "system", "tool", "", None, "assistant", "user"])
            text = draw.choice(["Yes.", "Yes.", "no", "", "\t\n", None, "\x0bWhy?\r\n", "long " * 3000 + "!", "é.", "x "])
            rows.append((conv_id, draw.choice([None, *range(-3, 8)]), role, text))
    rows += [(900, 3, "user", "Same.")] * 700
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int")
    for piece, turns in ((4096, 4096), (3, 2)):
        monkeypatch.setattr(turn_repair, "PIECE", piece)
        monkeypatch.setattr(turn_repair, "TURNS", turns)
        assert rows_of(turn_repair.digests(frame)) == model(rows, damage=False)
    assert rows_of(turn_repair.digests(turn_repair.damaged(frame), every=frame)) == model(rows)
    assert turn_repair.digests(frame.limit(0)).collect() == []


def test_a_conversation_without_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(b"%d:0" % i) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert rows_of(turn_repair.digests(turn_repair.damaged(frame), every=frame)) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}


def test_repaired_rows(spark):
    rows = [(1, 0, "tool", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "Only.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in turn_repair.repaired(frame).collect())
    assert got == [(1, 0, 0, "user", "Hi.", "R"), (1, 1, 1, "assistant", "Yes.", "K")]
