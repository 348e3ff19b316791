"""Secrets in documents: strong ones by their form, weak parts of a credential only where they complement each other.

Base spans come from three patterns (``assign``, ``access``, ``hex``). Beyond them a credential is often
written in parts: an identifier, a secret and an endpoint, none of which says much alone. Those weak parts
are found as intervals of a text. A scope is the stretch between two blank lines, and within it a part reaches REACH
code points to both sides: parts belong together if one starts within the other's reach and no blank line separates them. The
interval join looks each part's reach up among the sorted parts of a document, so no pairs are formed. A weak
secret is a labelled value, or a bare string of high entropy. A labelled one is reported if an identifier or an endpoint
belongs to it, a bare one if an identifier or access key does; a weak identifier or endpoint if a secret belongs to it: a weak
one, or one that its form assigns. A weak secret on its own stays unreported. A string of hex digits alone completes
nothing: it may be a checksum. With a label before it, it is a weak secret as well.

Kinds, in the order used for ties: assign, access, hex, then ident, weak, endpoint.

Cases: a NULL or empty text has no spans; repeated rows each return a row; a NULL doc_id keeps its row;
other columns are ignored; an empty table gives no rows. Weak parts inside a base span are not repeated.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
MASK = "[REDACTED]"

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_MARK = re.compile(r"passw|secret|token|api_?key", re.I | re.A)

IDENT = re.compile(
    r"(?<![A-Za-z0-9_])(?:[A-Za-z0-9]++_)*(?:key_id|client_id|account_id|app_id"
    r"|user_?name|user|login)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@+-]{3,})",
    re.I | re.A,
)
WEAK = re.compile(
    r"(?<![A-Za-z0-9_])(?:[A-Za-z0-9]++_)*"
    r"(?:pass|passwd|password|passphrase|pwd|secret|token|auth|credential|api_?key|access_key|private_key|secret_key)"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=!@#$%^&*-]{4,})",
    re.I | re.A,
)
ENDPOINT = re.compile(
    r"(?<![A-Za-z0-9_])(?:[A-Za-z0-9]++_)*(?:endpoint|host|hostname|server|base_url|url)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9][A-Za-z0-9_.:/-]{3,})"
    r"|(?<![A-Za-z0-9_])(?:postgres|postgresql|mysql|mongodb|redis|amqp|ftp|sftp|ssh|jdbc:[a-z]+)://[A-Za-z0-9_.:@/-]+",
    re.I | re.A,
)
# A secret without a label: long, of all three kinds of characters, and no repetition.
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])", re.A)
BARE_KINDS = [re.compile(kind) for kind in ("[A-Z]", "[a-z]", "[0-9]")]
BARE_BITS = 3.5  # a character
REACH = 2_000  # code points on either side in which the parts of one credential stand
PART_MARK = re.compile(r"[:=]", re.A)
BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int, int]  # start, end, index of kind


def base_spans(text: str) -> list[Span]:
    """Spans of assign, access and hex, leftmost and non-overlapping within a kind."""
    found: list[Span] = []
    if ASSIGN_MARK.search(text):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return found


def linked_parts(text: str, base: list[Span]) -> list[Span]:
    """Weak identifiers, secrets and endpoints that complement each other within a scope."""
    if not PART_MARK.search(text) and not any(k == 1 for _, _, k in base):
        return []
    weak = [(m.start(), m.end()) for m in WEAK.finditer(text)]
    idents = [(m.start(), m.end()) for m in IDENT.finditer(text)]
    ends = [(m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    if not idents and not ends and not any(k == 1 for _, _, k in base):
        return []
    bare = _bare(text, weak + idents + ends) if idents or any(k == 1 for _, _, k in base) else []
    if not weak and not bare and not any(k == 0 for _, _, k in base):
        return []
    walls = [m.start() for m in BLANK_LINE.finditer(text)]
    taken = sorted((s, e) for s, e, _ in base)

    def inside(span: tuple[int, int]) -> bool:
        i = bisect_right(taken, (span[0], len(text) + 1)) - 1
        before = taken[i] if i >= 0 else (0, 0)
        after = taken[i + 1] if i + 1 < len(taken) else (len(text) + 1, 0)
        return before[1] > span[0] or after[0] < span[1]

    def near(span: tuple[int, int], sorted_parts: list[tuple[int, int]]) -> bool:
        """Whether a part starts in the span's scope and reach."""
        wall = bisect_left(walls, span[0])
        low = max(walls[wall - 1] if wall else 0, span[0] - REACH)
        high = min(walls[wall] if wall < len(walls) else len(text), span[1] + REACH)
        return bisect_left(sorted_parts, (low, 0)) < bisect_left(sorted_parts, (high, 0))

    names = sorted(idents + [(s, e) for s, e, k in base if k == 1])
    assigned = [(s, e) for s, e, k in base if k == 0]
    secrets = sorted(weak + bare + assigned)
    found = [(s, e, 3) for s, e in idents if near((s, e), secrets)]
    complements = sorted(names + ends)
    found += [(s, e, 4) for s, e in weak if near((s, e), complements)]
    found += [(s, e, 4) for s, e in bare if near((s, e), names)]
    confirmed = sorted([(s, e) for s, e, k in found if k == 4] + assigned)
    found += [(s, e, 5) for s, e in ends if near((s, e), confirmed)]
    return [x for x in found if not inside(x[:2])]


def _bare(text: str, labelled: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Strings of high entropy outside labelled parts."""
    parts, found = sorted(labelled), []
    reach = list(accumulate((e for _, e in parts), max))
    for m in BARE.finditer(text):
        before = bisect_left(parts, (m.end(), 0))
        if before and reach[before - 1] > m.start():
            continue
        n = m.end() - m.start()
        if all(kind.search(m[0]) for kind in BARE_KINDS) and -sum(c / n * log2(c / n) for c in Counter(m[0]).values()) >= BARE_BITS:
            found.append((m.start(), m.end()))
    return found


def secret_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by start, then kind, then end."""
    base = base_spans(text)
    order = lambda spans: sorted(spans, key=lambda x: (x[0], x[2], x[1]))
    return order(base), order(base + linked_parts(text, base))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def masked(text: str) -> str:
    """text with every reported span replaced; overlapping spans become one mask."""
    out, at = [], 0
    for start, end, _ in secret_spans(text)[1]:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the digest of its base spans, all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                base, every = secret_spans(text or "")
                counts = [sum(k == i for _, _, k in every) for i in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            columns = list(zip(*rows)) if rows else [[]] * (len(KINDS) + 2)
            longs = [pa.array(c, pa.int64()) for c in columns[: len(KINDS)]]
            words = [pa.array(c, pa.string()) for c in columns[len(KINDS) :]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *longs, *words], NAMES)

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = ", ".join(["doc_id long", *[f"n_{k} long" for k in KINDS], "base_sha256 string", "spans string"])
    return kept.mapInArrow(run, schema)


NAMES = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets masked in text; all other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            clean = [None if t is None else masked(t) for t in batch[at].to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
