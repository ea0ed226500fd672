import hashlib
import math

import numpy as np
import pytest

from verdigris.llm.vector_codes import compress, nearest

SCHEMA = "vec_id long, embedding array<double>, label int, pos int, entry string, _row string"


def plain(rows, entries=256, rounds=4, parts=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    find = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(find(c[p], books[p])[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(held[k]) for x in zip(*held[k], strict=True)) if k in held else e for k, e in enumerate(books[p])]
    found = [[find(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), e, total[label], sha) for (i, _, label), f, e in zip(kept, found, error, strict=True))


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def result(spark, rows, **with_):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in compress(made(spark, rows), **with_).collect())


def test_equals_the_plain_form_with_copies_nulls_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)], i % 3 if i % 5 else None) for i in range(150)]
    rows += [(200 + i, rows[7][1], 1) for i in range(100)]  # a crowded vector
    rows += [(400, None, 1), (401, [None] + [0.0] * 7, 1), (402, [float("nan")] + [0.0] * 7, 1), (403, [float("inf")] + [0.0] * 7, None)]
    rows += [(3, rows[3][1], 2), (3, rows[3][1], 2), (3, rows[9][1], 2), (None, rows[11][1], None), (-1, [-0.0001] * 8, 0)]
    for entries in (256, 16):
        assert result(spark, rows, entries=entries) == plain(rows, entries)
    assert result(spark, rows[::-1], entries=16) == plain(rows, 16)


def test_numbers_beyond_exact_floats():
    big = [(1 << 40) + 1, -(1 << 41)]
    best, square = nearest(np.array([big]), np.array([[1 << 40, -(1 << 41)], big]))
    assert (best[0], square[0]) == (1, 0)
    best, square = nearest(np.array([[1 << 62, 0]]), np.array([[-(1 << 62), 0]]))
    assert square[0] == (1 << 63) ** 2


def test_huge_components_equal_the_plain_form(spark):
    rows = [(i, [float(i) * 1e9, 1.0, -1e10, 0.5], None) for i in range(6)]
    assert result(spark, rows, entries=3) == [(i, c, min(e, (1 << 63) - 1), min(t, (1 << 63) - 1), s) for i, c, e, t, s in plain(rows, 3)]


def test_empty_and_uneven_tables(spark):
    assert result(spark, []) == [] == result(spark, [(1, None, 1)])
    assert result(spark, [(1, [], 1)])[0][1:4] == ("00000000", 0, 0)
    for odd in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 6, 1)]):
        with pytest.raises(ValueError):
            result(spark, odd)
