"""Secrets in texts: key patterns, and entropy of sliding windows.

A candidate is a run of ``WINDOW`` or more characters of keys; its parts are what
lies between '=', '/' and '+'. The entropy of each window of ``WINDOW`` characters,
and its numbers of digits, letters and so on, are kept up to date with the character
that leaves and the one that enters. A window counts if it has the bits of its own
character class or, where it fits none, of its part's or its candidate's. Windows that
count are merged into spans. Spans are in code points, the end is exclusive.

The allow-list explains windows, not whole candidates. A pattern ``.*X.*`` explains
the windows that hold or touch an X; if its part has windows that count clear of it,
X is there by chance and explains nothing. Other patterns explain whole parts, or
what follows from a part's start to the next '=' or the candidate's end; a window that
reaches beyond counts only if it has a digit there. What a key pattern already covers
is cut off a span; the rest stays if it has a digit or ``WINDOW`` / 2 characters.

Defined cases: a null text counts as empty and has no spans. Each row is scanned
by itself, so ties and repeated rows give repeated results, an empty table gives
an empty one, and only the id and text columns are read. A text is scanned whole
whatever its length; batches are bounded in bytes by Spark.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wardline.llm.common import ship

# fixed values: the key patterns and the least lengths of what they find
ASSIGN = re.compile(
    r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: without one of these a text holds no assignment
HINTS = ("assw", "ecret", "oken", "key")

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
PART = re.compile(r"[^=/+]+")
#: what class a window has follows from its numbers of these
DIGIT, HEX_LOWER, LOWER, HEX_UPPER, UPPER, DASH, UNDERSCORE, CUT = range(8)
SORTS = {
    char: sort
    for sort, chars in enumerate(
        ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "-", "_", "=/+")
    )
    for char in chars
}
#: character class -> (what its candidates look like, bits per character)
CLASSES = {
    "hex": (re.compile(r"(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f-]+"), 3.0),
    "base64": (re.compile(r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+"), 3.7),
    "upper": (re.compile(r"(?=.*[0-9])(?=.*[A-Z])[A-Z0-9_-]+"), 3.6),
    "lower": (re.compile(r"(?=(?:.*[0-9]){3})(?=.*[a-z])[a-z0-9_-]+"), 3.6),
}
#: strings that look random but are no secrets
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r".*(?i:example|sample|dummy|placeholder|changeme|xxxx|0000|1234567|abcdef).*",
    r"[0-9_-]+",
    r"(sha(1|256|384|512)|md5)-.*",  # checksums of lock files
)

SPANS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_assign", pa.int64()),
        ("n_access", pa.int64()),
        ("n_hex", pa.int64()),
        ("n_entropy", pa.int64()),
        ("base_spans", pa.string()),
        ("spans", pa.string()),
    ]
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the key patterns, leftmost and not overlapping per kind."""
    found = []
    if any(hint in text for hint in HINTS) or any(hint in text.lower() for hint in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [
            (m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS
        ]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _log_terms(window: int) -> list[float]:
    return [0.0] + [count * math.log2(count) for count in range(1, window + 1)]


def _merged(starts: list[int], window: int) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for start in starts:
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], start + window)
        else:
            spans.append((start, start + window))
    return spans


def _totals(word: str, window: int) -> Iterator[float]:
    """Of each window, the sum of n log2 n over the counts of its characters."""
    term, counts, total = _log_terms(window), dict.fromkeys(word, 0), 0.0
    for at, char in enumerate(word):
        count = counts[char]
        if at >= window:
            old = word[at - window]
            if old == char:
                yield total
                continue
            gone = counts[old]
            total += term[gone - 1] - term[gone]
            counts[old] = gone - 1
        total += term[count + 1] - term[count]
        counts[char] = count + 1
        if at >= window - 1:
            yield total


def high_entropy(word: str, window: int, least: float) -> list[tuple[int, int]]:
    """Merged spans of the windows of ``word`` with at least ``least`` bits per character."""
    most = window * (math.log2(window) - least) + 1e-9
    return _merged([start for start, total in enumerate(_totals(word, window)) if total <= most], window)


def class_bits(word: str) -> float | None:
    """Bits per character that the class of ``word`` demands."""
    return next((bits for look, bits in CLASSES.values() if look.fullmatch(word)), None)


def _window_bits(n: list[int]) -> float | None:
    """``class_bits`` of a window with these numbers of characters of each sort."""
    lower, upper = n[HEX_LOWER] + n[LOWER], n[HEX_UPPER] + n[UPPER]
    if not n[DIGIT] or not lower + upper:
        return None
    if not n[LOWER] and not n[UPPER] and not n[UNDERSCORE] and not n[CUT]:
        return CLASSES["hex"][1]
    if lower and upper:
        return CLASSES["base64"][1]
    if n[CUT]:
        return None
    if upper:
        return CLASSES["upper"][1]
    return CLASSES["lower"][1] if n[DIGIT] >= 3 else None


def random_windows(word: str, parts: list[tuple[int, int]]) -> list[int]:
    """Where windows start that have the bits of their own class, or else their part's or ``word``'s."""
    limits: dict[float | None, float] = {None: -1.0}
    limits |= {bits: WINDOW * (math.log2(WINDOW) - bits) + 1e-9 for _, bits in CLASSES.values()}
    whole = class_bits(word)
    parts = [x for x in parts if x[1] - x[0] >= WINDOW]
    part_bits = [class_bits(word[a:b]) for a, b in parts]
    sorts = [SORTS[char] for char in word]
    numbers = [0] * 8
    for sort in sorts[: WINDOW - 1]:
        numbers[sort] += 1
    found, at = [], 0
    for start, total in enumerate(_totals(word, WINDOW)):
        end = start + WINDOW
        numbers[sorts[end - 1]] += 1
        bits = _window_bits(numbers)
        if bits is None:
            while at < len(parts) and parts[at][1] < end:
                at += 1
            bits = part_bits[at] if at < len(parts) and parts[at][0] <= start else None
        if total <= limits[whole if bits is None else bits]:
            found.append(start)
        numbers[sorts[start]] -= 1
    return found


class Allowed:
    """What an allow-list explains of a candidate."""

    def __init__(self, patterns: tuple[str, ...]):
        inner = [x[2:-2] for x in patterns if len(x) > 4 and x.startswith(".*") and x.endswith(".*")]
        whole = [x for x in patterns if not (len(x) > 4 and x.startswith(".*") and x.endswith(".*"))]
        self.words = re.compile("|".join(f"(?:{x})" for x in inner) or r"(?!)")
        self.whole = re.compile("|".join(f"(?:{x})" for x in whole) or r"(?!)")

    def explained(self, word: str, parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Disjoint ascending ranges of ``word`` that patterns match from a part's start."""
        found: list[tuple[int, int]] = []
        for start, end in [(0, 0), *parts]:
            if found and start < found[-1][1]:
                continue
            value = word.find("=", start)
            for stop in (len(word), len(word) if value < 0 else value, end):
                if stop > start and self.whole.fullmatch(word, start, stop):
                    found.append((start, stop))
                    break
        return found

    def left(self, word: str, parts: list[tuple[int, int]], starts: list[int]) -> list[int]:
        """``starts`` of windows without those that the list explains."""
        whole = self.explained(word, parts) if starts else []
        if whole:
            outside = [0]
            inside = [0]
            marks = iter(whole)
            low, high = next(marks)
            for at, char in enumerate(word):
                while at >= high:
                    low, high = next(marks, (len(word), len(word) + 1))
                within = low <= at
                inside.append(inside[-1] + within)
                outside.append(outside[-1] + (not within and SORTS[char] == DIGIT))
            starts = [
                k
                for k in starts
                if inside[k + WINDOW] == inside[k] or outside[k + WINDOW] > outside[k]
            ]
        words = [m.span() for m in self.words.finditer(word)] if starts else []
        if not words:
            return starts

        def clear(of: list[tuple[int, int]], starts: list[int]) -> list[int]:
            """Windows that neither hold nor touch a word."""
            ends, kept = [b for _, b in of], []
            for k in starts:
                # the first word that ends at the window's start or later
                at = bisect_right(ends, k - 1)
                if at == len(of) or of[at][0] > k + WINDOW:
                    kept.append(k)
            return kept

        free, firsts, kept = clear(words, starts), [a for a, _ in parts], []
        for low, high in words:
            at = bisect_right(firsts, low) - 1
            a, b = parts[at] if at >= 0 else (0, 0)
            k = bisect_right(free, a - 1)
            chance = high <= b and k < len(free) and free[k] + WINDOW <= b
            if not chance:
                kept.append((low, high))
        return clear(kept, starts)


def _uncovered(low: int, high: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a span; ``covered`` is ascending and disjoint."""
    found = []
    at = bisect_right(covered, (low,))
    if at and covered[at - 1][1] > low:
        at -= 1
    while low < high:
        a, b = covered[at] if at < len(covered) else (high, high)
        if min(a, high) > low:
            found.append((low, min(a, high)))
        low, at = max(low, b), at + 1
    return found


def entropy_spans(
    text: str, allowed: Allowed, covered: list[tuple[int, int, int]]
) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of random-looking strings that nothing explains."""
    found = []
    cover: list[tuple[int, int]] = []
    for a, _, b in sorted(covered):
        if cover and a <= cover[-1][1]:
            cover[-1] = (cover[-1][0], max(b, cover[-1][1]))
        else:
            cover.append((a, b))
    for match in CANDIDATE.finditer(text):
        word, start = match[0], match.start()
        parts = [m.span() for m in PART.finditer(word)]
        starts = allowed.left(word, parts, random_windows(word, parts))
        for low, high in _merged(starts, WINDOW):
            span = (start + low, start + high)
            for a, b in _uncovered(*span, cover):
                rest = text[a:b]
                if (a, b) == span or b - a >= WINDOW // 2 or any(x in "0123456789" for x in rest):
                    found.append((a, 3, b))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """One row per document: counts per kind, base spans, all spans. No shuffle."""
    ship(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = Allowed(allowed)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                extra = entropy_spans(text, explained, base)
                kinds = [kind for _, kind, _ in base]
                spans = _joined(sorted(base + extra)) if extra else _joined(base)
                rows.append(
                    (kinds.count(0), kinds.count(1), kinds.count(2), len(extra), _joined(base), spans)
                )
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)]
                + [
                    pa.array(values, SPANS.field(k + 1).type) for k, values in enumerate(columns)
                ],
                schema=SPANS,
            )

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_spans string, spans string"
    narrow = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text")
    return narrow.mapInArrow(scan, schema)


def text_hash(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
