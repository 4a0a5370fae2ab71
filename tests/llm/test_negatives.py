"""Hard negatives against brute force, and the index's walk against its bounds."""

import math

import numpy as np
import pytest

from wardline.llm import hard_negatives as H

SHAPE = "vec_id bigint, label int, embedding array<float>, score string, no string, cell string"


def random_rows(n, dim, seed, clustered=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) * 2
    rows = []
    for k in range(n):
        v = rng.normal(size=dim) * 0.4 + (centres[k % 6] if clustered else 0)
        rows.append((k, int(rng.integers(0, 4)), [float(np.float32(x)) for x in v], "s", None, "c"))
    return rows


def brute(rows, chosen, scale=256, top=5):
    usable = {
        (i, lab, tuple(math.floor(scale * float(np.float32(x))) for x in v))
        for i, lab, v, *_ in rows
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    usable = sorted(usable)
    width = max((len(v) for _, _, v in usable), default=0)
    usable = [(i, lab, v + (0,) * (width - len(v))) for i, lab, v in usable]
    out = []
    for a in usable:
        if not chosen(a):
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in usable if b is not a
        )
        for p, pid, _ in [s for s in scored if s[2] == a[1]][:top]:
            window = [s for s in scored if s[2] != a[1] and 80 * -p <= 100 * -s[0] <= 100 * -p][:top]
            out += [(a[0], pid, k + 1, nid, -p, -n) for k, (n, nid, _) in enumerate(window)]
    return sorted(out)


def found(df, **options):
    rows = H.hard_negatives(df, "id % 10 = 0", **options).collect()
    return sorted(
        (r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in rows
    )


@pytest.mark.parametrize("dim,clustered", [(8, True), (7, False), (2, True)])
def test_against_brute_force(spark, dim, clustered):
    rows = random_rows(400, dim, dim, clustered)
    rows += [(400 + k, 1, rows[5][2], "s", None, "c") for k in range(60)]  # one common vector
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    want = brute(rows, lambda a: a[0] % 10 == 0)
    assert want and found(df, probe=40, cell_rows=10) == want
    assert found(df) == want


def test_slices_and_parts_of_a_cell(spark, monkeypatch):
    monkeypatch.setattr(H, "SLICE", 16)
    monkeypatch.setattr(H, "PART", 8)
    rows = random_rows(300, 6, 3)
    assert found(spark.createDataFrame(rows, SHAPE), probe=20) == brute(rows, lambda a: a[0] % 10 == 0)


def test_rows_that_take_no_part(spark):
    rows = random_rows(60, 4, 9)
    bad = [
        (100, None, [1.0] * 4, None, None, None),
        (110, 1, None, None, None, None),
        (120, 1, [1.0, None, 1.0, 1.0], None, None, None),
        (130, 1, [float("nan"), 0.0, 0.0, 0.0], None, None, None),
        (140, 1, [float("inf"), 0.0, 0.0, 0.0], None, None, None),
        (None, 1, [1.0] * 4, None, None, None),
        (150, 1, [], None, None, None),
        (160, 2, [2.0], None, None, None),
        rows[10],  # a repeated row
    ]
    df = spark.createDataFrame(rows + bad, SHAPE)
    assert found(df, probe=5) == brute(rows + bad, lambda a: a[0] % 10 == 0)


def test_empty_and_lonely(spark):
    assert found(spark.createDataFrame([], SHAPE)) == []
    assert found(spark.createDataFrame([(0, 1, [1.0, 2.0], None, None, None)], SHAPE)) == []
    assert found(spark.createDataFrame([(0, 1, [], None, None, None), (1, 1, [], None, None, None)], SHAPE)) == []


def test_large_components_are_exact(spark):
    rows = [(k, k % 2, [1000.0 + k, -3.0 * k, 0.5], None, None, None) for k in range(30)]
    assert found(spark.createDataFrame(rows, SHAPE)) == brute(rows, lambda a: a[0] % 10 == 0)


def test_walk_descends_covers_every_cell_and_bounds_its_rows(spark):
    rows = random_rows(500, 8, 21)
    df, dim = H.quantised(spark.createDataFrame(rows, SHAPE), "vec_id", "embedding", "label", 256)
    index, books = H.build_index(df, dim, cell_rows=10)
    held = index.toArrow()
    points, cells = H.matrix(held["vec"].combine_chunks(), dim), held["cell"].to_numpy()
    for anchor in points[:20]:
        steps = list(H.walk(books, anchor))
        bounds = [b for b, _ in steps]
        assert bounds == sorted(bounds, reverse=True)
        assert sorted(c for _, c in steps) == list(range(len(books.rows)))
        of = dict((c, b) for b, c in steps)
        assert all(of[c] >= s for c, s in zip(cells, points @ anchor, strict=True))


def test_clusters_let_the_walk_stop_early(spark):
    rows = random_rows(2000, 8, 4)
    df, dim = H.quantised(spark.createDataFrame(rows, SHAPE), "vec_id", "embedding", "label", 256)
    index, books = H.build_index(df, dim, cell_rows=20)
    points = H.matrix(index.toArrow()["vec"].combine_chunks(), dim)
    for anchor in points[:10]:
        floor = float(np.sort(points @ anchor)[-50])
        asked = H.asked_cells(books, anchor, 0, floor, True)
        assert books.rows[asked].sum() < 0.8 * books.rows.sum()
        assert books.rows[asked].sum() >= 50


def test_recall_is_whole_whatever_the_sample(spark):
    rows = random_rows(300, 6, 8)
    df, dim = H.quantised(spark.createDataFrame(rows, SHAPE), "vec_id", "embedding", "label", 256)
    index, books = H.build_index(df, dim, sample=10)
    assert index.count() == 300 == books.rows.sum()
