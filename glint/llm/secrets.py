"""Secret scans: fixed patterns, and windows of high entropy in candidate strings.

A candidate is a run of token characters. Each of its longest pieces of one character
class (digits, hex, digits and letters of one case), and the run as a whole, is scanned
with the window and the bits of Shannon entropy of that class. The counts of a window move on by one character at a time, and with them the sum
of c * log2(c), so a candidate costs the same however wide the window is. Strings on
the allow list, such as UUIDs or words and numbers joined by signs, are passed over; a
mark of a sample, such as EXAMPLE, clears only the letters and digits it stands in.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, id_text, rows_of

#: Kinds in the order in which spans with an equal start are listed.
KINDS = ("assign", "access", "hex", "entropy")

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Character classes from narrow to wide: (full match, window, least bits in a window).
CLASSES = (
    (re.compile(r"[0-9]+"), 24, 2.9),
    (re.compile(r"[0-9a-f]+|[0-9A-F]+"), 24, 3.1),
    (re.compile(r"[0-9a-z]+|[0-9A-Z]+"), 20, 3.6),
    (re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.8),
)

#: Candidates that are no secrets.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    re.compile(r"[A-Za-z]+"),
    re.compile(r"([A-Za-z]+|[0-9]+)([+/_=-]+([A-Za-z]+|[0-9]+))+[+/_=-]*"),
)
#: Letters and digits with a mark of a sample.
SAMPLE = re.compile(r"[A-Za-z0-9]*?(?:EXAMPLE|example|xxxx|XXXX|0{8}|1234567)[A-Za-z0-9]*")
#: The least length of a candidate, and of a piece.
LEAST = 20

_LOG = [0.0] + [c * math.log2(c) for c in range(1, 257)]


def entropy_windows(text: str, window: int, least: float) -> list[tuple[int, int]]:
    """The maximal ranges covered by windows with at least `least` bits a character."""
    window = min(window, len(text))
    counts: dict[str, int] = {}
    total, found = 0.0, []
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += _LOG[n + 1] - _LOG[n]
        counts[c] = n + 1
        if i >= window:
            old = text[i - window]
            n = counts[old]
            total -= _LOG[n] - _LOG[n - 1]
            counts[old] = n - 1
        if i >= window - 1 and math.log2(window) - total / window >= least - 1e-9:
            start = i - window + 1
            if found and start <= found[-1][1]:
                found[-1][1] = i + 1
            else:
                found.append([start, i + 1])
    return [(a, b) for a, b in found]


def allowed(text: str) -> bool:
    return any(p.fullmatch(text) for p in ALLOW)


def pieces(run: str) -> list[tuple[int, int, int]]:
    """(start, end, class) of what is scanned: the run, and its longest pieces of each class.

    A piece that is part of one of a narrower class alone is left to that class.
    """
    found: list[tuple[int, int, int]] = []
    for k, (chars, _, _) in enumerate(CLASSES):
        for m in chars.finditer(run):
            if m.end() - m.start() >= LEAST and not any(a <= m.start() and m.end() <= b for a, b, _ in found):
                found.append((m.start(), m.end(), k))
    return found


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Spans of high entropy in the candidates of a text, in order and apart."""
    spans = []
    for m in CANDIDATE.finditer(text):
        at = m.start()
        # parts of the run without the samples
        for part in _parts(m[0]):
            for a, b, k in pieces(m[0][part[0] : part[1]]):
                piece = m[0][part[0] + a : part[0] + b]
                if not allowed(piece):
                    spans += [(at + part[0] + a + x, at + part[0] + a + y) for x, y in entropy_windows(piece, *CLASSES[k][1:])]
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _parts(run: str) -> list[tuple[int, int]]:
    cuts = [0, *(x for m in SAMPLE.finditer(run) for x in m.span()), len(run)]
    return [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True) if b - a >= LEAST]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, each leftmost and without overlap in its kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans; an entropy span within a base span adds nothing and is left out."""
    base = base_spans(text)
    starts = [s for s, _, _ in base]
    ends = list(accumulate((e for _, _, e in base), max, initial=-1))  # the farthest end of the first so many
    more = [(a, 3, b) for a, b in entropy_spans(text) if ends[bisect_right(starts, a)] < b]
    return base, sorted(base + more)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[tuple[int, int, int]], by: str = "[SECRET]") -> str:
    """The text with each maximal run of span characters replaced."""
    out, at, last = [], 0, -1
    for start, _, end in spans:
        if start > last:
            out += [text[at:start], by]
        at = last = max(last, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_entropy for every row.

    Offsets count code points, ends are exclusive. Null and empty texts have no spans and
    the hash of the empty string. Repeated rows and null ids are kept.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_assign", "n_access", "n_hex")), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_entropy", pa.int64())])

    def run(batches):
        def each():
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                base, spans = scan(text)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                yield doc_id, *n, hashlib.sha256(spell(base).encode()).hexdigest(), spell(spans), len(spans) - len(base)

        yield from batched(each(), schema)

    return id_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")


def redacted(docs: DataFrame, by: str = "[SECRET]") -> DataFrame:
    """docs with every secret in `text` replaced, and n_chars counted anew where it exists.

    All columns and rows stay; a null text stays null.
    """
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [None if t is None else redact(t, scan(t)[1], by) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
