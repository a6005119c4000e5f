import math

import numpy as np
import pytest
from trawl.llm.queries import op12_embedding_whitening
from trawl.llm.whitening import Slices, count_above, leading, whiten


def spectra(rng, d):
    yield rng.random(d) * 100
    yield np.ones(d) * 7
    yield np.exp(-np.arange(d) * 2.0)
    yield np.round(rng.random(d) * 3)
    yield 1 + 1e-9 * rng.random(d)
    yield np.r_[5.0, 5.0, np.zeros(d)][:d]


def matrices():
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 17, 64):
        for values in spectra(rng, d):
            axes, _ = np.linalg.qr(rng.normal(size=(d, d)))
            matrix = (axes * values) @ axes.T
            yield (matrix + matrix.T) / 2


def test_inertia_counts():
    rng = np.random.default_rng(6)
    for _ in range(200):
        d = int(rng.integers(1, 40))
        matrix = rng.normal(size=(d, d))
        matrix = matrix + matrix.T
        if rng.random() < 0.5:
            np.fill_diagonal(matrix, 0)
        shift = rng.normal()
        assert count_above(matrix, shift) == (np.linalg.eigvalsh(matrix) > shift).sum()
    assert count_above(np.zeros((4, 4)), 0.0) == 0 and count_above(np.zeros((4, 4)), -1.0) == 4


def test_leading_pairs():
    for matrix in matrices():
        values, axes = leading(matrix, 4)
        known = np.linalg.eigvalsh(matrix)[::-1]
        # As many as are not zero.
        assert len(values) == min(4, (known > 1e-12 * abs(known[0])).sum())
        assert np.abs(values - known[: len(values)]).max(initial=0) <= 1e-13 * known[0]
        assert np.abs(matrix @ axes - axes * values).max(initial=0) <= 1e-13 * known[0]
        assert np.abs(axes.T @ axes - np.eye(len(values))).max(initial=0) < 1e-13


def test_counts_refuse_another_number():
    slices = Slices(np.diag([5.0, 3.0, 2.0]))
    assert slices.certified(3.0, 2) and not slices.certified(3.0, 1) and not slices.certified(3.1, 2)


def by_hand(rows, k=4, scale=256):
    kept = []
    for vec_id, vector in rows:
        if vector and all(c is not None and math.isfinite(c) for c in vector):
            kept.append((vec_id, [math.floor(scale * float(c)) for c in vector]))
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(column) for column in zip(*fit)]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit, float) - mean
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    out = {}
    for vec_id, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        white = (np.array(x, float) - mean) @ axes / np.sqrt(values)
        for i in range(len(values)):
            out.setdefault((vec_id, i + 1), []).append((n, deviation, abs(white[i]), values[i] / np.trace(covariance)))
    return out, axes


def compared(df, rows):
    want, _ = by_hand(rows)
    got = {}
    for r in df.collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
        assert 0 <= r.identity_error < 1e-9
    assert got.keys() == want.keys()
    for key, found in got.items():
        assert len(found) == len(want[key])
        found.sort(key=lambda r: int(r.deviation))
        for r, (n, deviation, white, explained) in zip(found, sorted(want[key], key=lambda w: w[1])):
            assert r.n == n and int(r.deviation) == deviation
            assert abs(r.whitened) == pytest.approx(white, abs=1e-8) and r.explained == pytest.approx(explained, rel=1e-10)
    # One sign for all rows of a component.
    return got


def test_given_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = op12_embedding_whitening(spark, sf_dir)
    assert dict(found.dtypes) | {"n": "bigint", "deviation": "bigint", "component": "int", "whitened": "double"} == dict(found.dtypes)
    compared(found, rows)


SCHEMA = "vec_id long, embedding array<float>, x string, component string"


def test_odd_rows(spark):
    rng = np.random.default_rng(8)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=5) * [9, 5, 3, 2, 1]]) for i in range(40)]
    good += [(7, good[7][1]), (None, good[8][1]), (100, [-0.0, 0.0, -0.001, 0.5, -7.0])]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [math.nan] * 5), (204, [math.inf] + [0.0] * 4)]
    shorter, huge = [(205, [1.0, 2.0])], [(206, [1e38] + [0.0] * 4)]
    df = spark.createDataFrame([(*row, "a", None) for row in good + bad + shorter + huge], SCHEMA)
    got = compared(whiten(df), good)
    assert len(got[(7, 1)]) == 2 and len(got[(None, 4)]) == 1


def test_signs_are_the_same_for_all_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.normal(size=4) * [8, 4, 2, 1]]) for i in range(50)]
    df = spark.createDataFrame([(*row, "", "") for row in rows], SCHEMA.replace("float", "double")).repartition(5)
    _, axes = by_hand(rows)
    n = len(rows)
    x = np.floor(256 * np.array([vector for _, vector in rows]))
    for component in range(4):
        white = {r.vec_id: r.whitened for r in whiten(df).filter(f"component = {component + 1}").collect()}
        dots = (x - x.mean(axis=0)) @ axes[:, component]
        assert len({np.sign(dots[i] * white[i]) for i in range(n) if abs(dots[i]) > 1e-6}) == 1


def test_few_dimensions_and_no_rows(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None, "", "")], SCHEMA)).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0], "", "") for i in range(4)], SCHEMA)
    assert whiten(same).collect() == []
    line = spark.createDataFrame([(i, [float(i), 0.0, 2.0 * i], "", "") for i in range(4)], SCHEMA)
    rows = whiten(line).orderBy("vec_id").collect()
    assert [(r.vec_id, r.component) for r in rows] == [(i, 1) for i in range(4)] and rows[0].explained == pytest.approx(1)


def test_deviations_beyond_long(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [5e11, 2.0])]
    found = whiten(spark.createDataFrame([(*row, "", "") for row in rows], SCHEMA.replace("float", "double"))).collect()
    want, _ = by_hand(rows)
    assert {(r.vec_id, int(r.deviation)) for r in found} == {(key[0], int(w[0][1])) for key, w in want.items()}
    assert max(int(r.deviation) for r in found) > 2 ** 63
