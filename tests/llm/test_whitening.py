import numpy as np
import pytest

from passageworks.llm import queries, whitening

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, component string"


def plain(x, components):
    """Exact sums, the covariance as a whole, and a full decomposition."""
    fitted = np.unique(x, axis=0)
    n, sums = len(fitted), fitted.sum(axis=0)
    c = (n * fitted - sums) / n
    v = c.T @ c / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(values)[::-1][:components]
    values, vectors = values[order], vectors[:, order]
    return n, sums, values, vectors, np.trace(v), ((n * x - sums) ** 2).sum(axis=1), (n * x - sums) / n


def held(rows, x, ids, components=16, gap=True):
    n, sums, values, vectors, trace, deviation, centred = plain(x, components)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(got) == len(ids) * len(values)
    for j in range(len(values)):
        mine = np.array([got[i, j + 1]["whitened"] for i in ids])
        want = centred @ vectors[:, j] / np.sqrt(values[j])
        sign = 1 if mine @ want > 0 else -1
        if gap:
            assert np.abs(sign * mine - want).max() < 1e-7
        some = got[ids[0], j + 1]
        assert some["n"] == n and abs(some["explained"] - values[j] / trace) <= 1e-9
    assert [int(got[i, 1]["deviation"]) for i in ids] == deviation.tolist()
    assert max(r["identity_error"] for r in rows) < 1e-9 and len({r["identity_error"] for r in rows}) == 1


def test_query_against_a_full_decomposition(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.floor(64 * np.array([r["embedding"] for r in table], float)).astype(np.int64) + 1_000_000
    rows = queries.op12_whitening(spark, SF).collect()
    held(rows, x, [r["vec_id"] for r in table])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], KIND)


def test_copies_nulls_and_small_widths(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((40, 5)) * [5, 4, 3, 2, 1]).astype(np.float32).tolist()
    rows = list(enumerate(vectors)) + [(100 + i, vectors[0]) for i in range(30)]
    odd = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] * 5), (204, [float("-inf"), 0.0, 0.0, 0.0, 0.0])]
    x = np.array([np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for _, v in rows])
    held(whitening.whiten(frame(spark, rows + odd)).collect(), x, [i for i, _ in rows], 5)
    # equal rows are returned as often as they occur
    assert whitening.whiten(frame(spark, rows + rows[:3]), 2).count() == 2 * (len(rows) + 3)


def test_degenerate_tables(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    alone = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(alone) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["n"] == 1 for r in alone)
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(6)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line) and len(line) == 18
    null_id = whitening.whiten(frame(spark, [(None, [1.0, 2.0]), (2, [1.0, 3.0])]), 1).collect()
    assert {r["vec_id"] for r in null_id} == {None, 2}


def test_different_widths_are_an_error(spark):
    with pytest.raises(ValueError, match="widths differ"):
        whitening.whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_large_deviations_stay_exact(spark):
    rows = [(i, [float(2**38 * (i % 3)), float(i)]) for i in range(9)]
    x = [[64 * 2**38 * (i % 3) + 1_000_000, 64 * i + 1_000_000] for i in range(9)]
    sums = [sum(c) for c in zip(*x)]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(frame(spark, rows), 1).collect()}
    assert got == {i: sum((9 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}


def spectrum(values, seed=0):
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    return (turn * values) @ turn.T


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(85, 44, 64), np.concatenate([[400, 130], np.linspace(68, 58, 62)]), 0.9 ** np.arange(100), np.concatenate([np.full(20, 7.0), np.ones(60)]),
        np.concatenate([np.linspace(9, 8, 10), np.zeros(70)]), np.full(50, 3.0),
    ],
)
def test_filter_finds_leading_eigenvectors(values):
    v = spectrum(np.asarray(values, float))
    calls = []

    def apply(q):
        calls.append(q.shape[1])
        return v @ q

    found, vectors = whitening.leading(apply, len(v), 16)
    assert np.abs(found - np.sort(values)[::-1][:16]).max() < 1e-10 * max(values)
    assert np.abs(v @ vectors - vectors * found).max() < 1e-11 * max(values)
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-12
    print(len(calls), "passes")


def test_no_certificate_is_an_error():
    v = spectrum(np.linspace(85, 44, 64))
    with pytest.raises(RuntimeError, match="certified"):
        whitening.leading(lambda q: v @ q, 64, 16, degree=2, rounds=2)
