"""Quality: statistics, equations and calibration against plain computation; held-out accuracy; odd rows."""

import numpy as np
import pyarrow as pa

from palimpsest.llm import quality as Q
from palimpsest.llm import queries


def test_statistics_equal_a_plain_count():
    texts = ["One two two!! three$$ THE END.\nLast, line", "", None, "  \n ", "a"]
    got = Q.statistics(pa.array(texts))
    row = dict(zip(Q.STATISTICS, got[0]))
    n = len(texts[0])

    def share(x):
        return np.log1p(200 * x)
    assert np.isclose(row["bytes"], np.log1p(n)) and np.isclose(row["words"], np.log1p(8))
    assert np.isclose(row["repeats"], share(0)) and np.isclose(row["distinct"], 1)
    assert np.isclose(row["symbol_ends"], share(1 / 8)) and np.isclose(row["double_stops"], share(1 / 8))
    assert np.isclose(row["upper"], share(sum(c.isupper() for c in texts[0]) / n))
    assert np.isclose(row["stop_ends"], share(2 / 8)) and np.isclose(row["lines"], np.log1p(1))
    assert (got[1] == 0).all() and (got[2] == 0).all() and np.isfinite(got).all()
    assert np.array_equal(got[0], Q.statistics(pa.array(texts[:1]))[0])


def test_isotonic_is_the_least_squares_fit():
    random = np.random.Generator(np.random.Philox(4))
    for _ in range(30):
        total = random.integers(1, 5, 9).astype(float)
        good = np.array([random.integers(0, n + 1) for n in total], float)
        got = Q.isotonic(total, good)
        # min over b >= i of max over a <= i of the mean of a..b
        mean = [[good[a:b + 1].sum() / total[a:b + 1].sum() if a <= b else None for b in range(9)] for a in range(9)]
        want = [min(max(mean[a][b] for a in range(i + 1)) for b in range(i, 9)) for i in range(9)]
        assert np.allclose(got, want)


def test_equations_equal_the_sums_over_all_rows(spark):
    random = np.random.Generator(np.random.Philox(5))
    stats = random.normal(size=(200, len(Q.STATISTICS))).astype(np.float32)
    fold, label = random.integers(0, Q.FOLDS, 200), random.integers(0, 2, 200)
    rows = [(int(f), int(y), s.tobytes()) for f, y, s in zip(fold, label, stats)]
    kernel = Q.Kernel(np.zeros(stats.shape[1]), np.ones(stats.shape[1]))
    got = Q.normal_equations(spark.createDataFrame(rows, "fold int, label int, stats binary").repartition(5), kernel)
    z = kernel.features(stats.astype(float))
    for k in range(Q.FOLDS):
        own = z[fold == k]
        assert np.allclose(got[k, :, :-1], own.T @ own) and np.allclose(got[k, :, -1], own.T @ label[fold == k])


def test_features_approximate_a_gaussian_kernel():
    random = np.random.Generator(np.random.Philox(6))
    x = random.normal(size=(60, len(Q.STATISTICS))) * 0.3
    kernel = Q.Kernel(np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = kernel.features(x)[:, :-1]
    width = Q.WIDTH * np.sqrt(x.shape[1])
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * width ** 2))
    assert np.abs(z @ z.T - exact).mean() < 0.06


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op12_quality"](spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(got) == 10000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    bad = np.array([got[i].score for i, y in labels.items() if y == 0 and i in got and got[i].held_out])
    good = np.array([got[i].score for i, y in labels.items() if y == 1 and i in got and got[i].held_out])
    assert (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2 > 0.97
    assert (good >= 0.7).mean() > 0.97 and (bad < 0.7).mean() > 0.85


def test_odd_rows(spark, tmp_path):
    rows = [(i, "the quiet house stood near the river. " * (i % 7 + 1) if i % 3 else "BUY!! NOW!! BUY!! $$$ ### " * 9, 1)
            for i in range(120)] + [(900, None, 1), (901, "", 1), (None, "x", 1), (5, "twice", 1)]

    def scores(labels, where, given=rows):
        folder = f"{tmp_path}/{where}"
        spark.createDataFrame(given, "doc_id bigint, text string, stats int").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
        return queries.QUERIES["op12_quality"](spark, folder).collect()
    got = scores([(i, int(i % 3 > 0)) for i in range(120)] + [(1, 0), (900, None), (None, 1), (5, 7)], "both")
    assert len(got) == len(rows) and all(np.isfinite(r.score) and 0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 120]) > 0.95
    assert {r.score for r in scores([(i, 1) for i in range(120)], "ones")} == {1.0}
    assert {r.score for r in scores([], "none")} == {0.0}
    assert scores([(1, 1)], "empty", []) == []
