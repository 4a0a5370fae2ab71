"""Secret spans and quality scores against plain versions of the whole operator."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from wardline.llm import quality as Q
from wardline.llm import secrets_scan as S

# --- secret spans -------------------------------------------------------------------


def bits(text):
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def plain_entropy(text, covered):
    """From the definition: every window counted anew, every range compared with every window."""
    inner = re.compile("|".join(f"(?:{p[2:-2]})" for p in S.ALLOWED if p.startswith(".*")))
    whole = re.compile("|".join(f"(?:{p})" for p in S.ALLOWED if not p.startswith(".*")))
    marked = [any(a <= k < b for a, _, b in covered) for k in range(len(text))]
    found = []
    for run in S.CANDIDATE.finditer(text):
        word, offset = run[0], run.start()
        parts = [m.span() for m in re.finditer(r"[^=/+]+", word)]

        def demanded(k):
            own = S.class_bits(word[k : k + S.WINDOW])
            if own is not None:
                return own
            for a, b in parts:
                if a <= k and k + S.WINDOW <= b:
                    part = S.class_bits(word[a:b])
                    return S.class_bits(word) if part is None else part
            return S.class_bits(word)

        starts = []
        for k in range(len(word) - S.WINDOW + 1):
            least = demanded(k)
            if least is not None and bits(word[k : k + S.WINDOW]) >= least - 1e-9:
                starts.append(k)
        # whole patterns explain from a part's start to the candidate's end, the next '=' or the part's end
        ranges = []
        for a, b in [(0, 0), *parts]:
            if ranges and a < ranges[-1][1]:
                continue
            value = word.find("=", a)
            for stop in (len(word), len(word) if value < 0 else value, b):
                if stop > a and whole.fullmatch(word, a, stop):
                    ranges.append((a, stop))
                    break
        explained = [any(a <= k < b for a, b in ranges) for k in range(len(word))]
        starts = [
            k
            for k in starts
            if not any(explained[k : k + S.WINDOW])
            or any(word[p].isdigit() and not explained[p] for p in range(k, k + S.WINDOW))
        ]
        # words explain the windows they lie in or touch, unless their part counts without them
        words = [m.span() for m in inner.finditer(word)]

        def touches(k, span):
            return span[0] <= k + S.WINDOW and span[1] >= k

        free = [k for k in starts if not any(touches(k, w) for w in words)]
        kept = []
        for low, high in words:
            part = next(((a, b) for a, b in reversed(parts) if a <= low), (0, 0))
            inside = [k for k in free if part[0] <= k and k + S.WINDOW <= part[1]]
            if not (high <= part[1] and inside):
                kept.append((low, high))
        starts = [k for k in starts if not any(touches(k, w) for w in kept)]
        spans = []
        for k in starts:
            if spans and k <= spans[-1][1]:
                spans[-1][1] = k + S.WINDOW
            else:
                spans.append([k, k + S.WINDOW])
        for low, high in spans:
            low, high = low + offset, high + offset
            at = low
            while at < high:
                end = at
                while end < high and marked[end] == marked[at]:
                    end += 1
                if not marked[at] and ((at, end) == (low, high) or end - at >= S.WINDOW // 2 or re.search("[0-9]", text[at:end])):
                    found.append((at, 3, end))
                at = end
    return found


def made_texts(seed, n):
    rng = random.Random(seed)
    alphabets = ["0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZ23456789", "abcdefghijklmnopqrstuvwxyz0123456789",
                 "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    fixed = ["password = ", "token:", "AKIA", "example", "sample", "0000", "xxxx", "sha256-", "123e4567-e89b-12d3-a456-426614174000",
             "=", "/", "+", "-", "_", " ", " a word ", "\n", "aaaaaaaaaaaaaaaaaaaaaaaaa", "2024-01-01", "é"]
    for _ in range(n):
        pieces = []
        for _ in range(rng.randrange(1, 9)):
            if rng.random() < 0.5:
                pieces.append("".join(rng.choices(rng.choice(alphabets), k=rng.randrange(3, 50))))
            else:
                pieces.append(rng.choice(fixed))
        yield "".join(pieces)


def test_spans_of_the_whole_operator(spark, docs):
    texts = [*made_texts(1, 1500), *(r.text for r in docs.collect() if len(r.text or "") < 3000)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in S.scan_secrets(table).collect():
        text = texts[row.doc_id] or ""
        base = S.base_spans(text)
        extra = plain_entropy(text, base)
        assert row.n_entropy == len(extra), text
        assert row.spans == S._joined(sorted(base + extra)), text


# --- quality ------------------------------------------------------------------------


def plain_scores(rows, labels):
    """All rows on the driver: sums of whole matrices, the best monotone fit by its min-max form."""
    stats = {doc_id: np.array(Q.statistics(text or "")) for doc_id, text in rows}
    known = [
        (stats[d], float(q), zlib.crc32(f"calibration:{d}".encode()) % 10)
        for d, q in labels
        if q is not None and d in stats and zlib.crc32(str(d).encode()) % 3 != 1
    ]
    x, y, part = (np.array([k[i] for k in known]) for i in range(3))
    model = Q.Model(x.mean(axis=0), x.std(axis=0))
    learn, keep = part >= Q.CALIBRATION_PARTS, part < Q.CALIBRATION_PARTS
    f = model.features(x[learn])
    square, product = f.T @ f, f.T @ y[learn]
    ridge = Q.RIDGE * max(1.0, square[-1, -1]) * np.eye(len(square))
    ridge[-1, -1] = 1e-9
    model.weights = np.linalg.solve(square + ridge, product)
    raw = model.raw_scores(x[keep])
    at = np.clip(((raw + 0.5) / 2 * Q.BINS).astype(int), 0, Q.BINS - 1)
    bins = [(raw[at == b].mean(), y[keep][at == b].sum(), (at == b).sum()) for b in np.unique(at)]
    centre, ones, count = (np.array(c, float) for c in zip(*bins, strict=True))
    fit = []
    for k in range(len(bins)):
        # the largest over starts of the least over ends of the mean in between
        fit.append(
            max(min(ones[a : b + 1].sum() / count[a : b + 1].sum() for b in range(k, len(bins))) for a in range(k + 1))
        )
    fit = np.array(fit)
    pools = [np.flatnonzero(np.isclose(fit, v)) for v in np.unique(fit.round(12))]
    at = np.array([(centre[p] * count[p]).sum() / count[p].sum() for p in pools])
    share = np.array([ones[p].sum() / count[p].sum() for p in pools])
    low, high = min(centre.min(), at[0]) - 1, max(centre.max(), at[-1]) + 1
    model.raw = np.concatenate([[low], at, [high]])
    model.share = np.concatenate([[share[0] * 0.5], share, [1 - (1 - share[-1]) * 0.5]])
    return {d: float(np.clip(model.scores(s[None]), 0, 1)[0]) for d, s in stats.items()}


def test_scores_of_the_whole_operator(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    want = plain_scores([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.quality) for r in labels.collect()])
    got = {r.doc_id: r for r in Q.quality_scores(docs.repartition(5), labels).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[d].score - want[d]) < 1e-6 for d in want)
    assert all(got[d].predicted == int(got[d].score >= 0.5) for d in want)
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in want)
