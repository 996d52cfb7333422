import re

import numpy as np
from pyspark.sql import functions as F

from envlake.llm.outliers import chi2_below, chi2_quantile, judged, text_counts
from envlake.llm.quality import fit, keep_good, learn, score_documents, statistics, with_statistics
from tests.llm.conftest import frame


def test_held_out_accuracy(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stats = with_statistics(documents)
    got = score_documents(stats, learn(stats, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got) > 0


def test_density_equals_the_plain_formula():
    rng = np.random.default_rng(3)
    x = {c: rng.normal(c, 1 + c, (500, 3)) for c in (0, 1)}
    m = fit({c: (float(len(v)), v.sum(0), v.T @ v) for c, v in x.items()}, pool=0, diagonal=0, floor=0)

    def log(p, v):
        d, s = p - v.mean(0), np.cov(v.T, bias=True)
        return -0.5 * d @ np.linalg.inv(s) @ d - 0.5 * np.log(np.linalg.det(s))
    p = np.array([0.3, 1.0, -0.2])
    assert np.isclose(m.score(p[None])[0], 1 / (1 + np.exp(log(p, x[0]) - log(p, x[1]))))


def test_odd_rows_have_scores(spark, odd, none, odd_rows):
    labels = spark.createDataFrame([(4, 1), (5, 1), (7, 0), (None, 1), (9, None)], "doc_id long, quality int")
    stats = with_statistics(odd)
    got = score_documents(stats, learn(stats, labels)).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    empty = learn(with_statistics(none), labels.limit(0))
    assert {r["score"] for r in score_documents(stats, empty).collect()} == {0.5}
    assert keep_good(odd, empty).columns == odd.columns and keep_good(none, empty).count() == 0
    assert np.isfinite(statistics([b"", b"x", b"a" * 10 ** 6])).all()


def test_counts_equal_brute_force(documents, odd):
    for docs in (documents, odd):
        texts = sorted((r["text"] or "") for r in docs.collect())
        got = sorted(tuple(r)[1:] for r in text_counts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
        want = []
        for t in texts:
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            at = {}
            for k in range(len(w) - 7):
                at.setdefault(tuple(w[k:k + 8]), []).append(k)
            covered = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(8)}
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            want.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)))
        assert got == sorted(want)


def test_outliers_go_and_clean_rows_stay(spark, documents, sf, odd, none, odd_rows):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = judged(documents).join(labels, "doc_id").where("NOT base_failed").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    assert sum(good) >= 0.99 * len(good)
    assert judged(odd).count() == len(odd_rows) and judged(none).count() == 0
    # junk among plain rows of a small group
    rows = [(i, " ".join(f"word{(i * 7 + k) % 500}" for k in range(60 + i % 9)), "en", "s") for i in range(300)]
    rows += [(1000, " ".join("###$$$%%%" + str(k) for k in range(80)), "en", "s"), (1001, rows[0][1], "xx", "rare")]
    kept = {r["doc_id"]: r["kept"] for r in judged(frame(spark, rows)).collect()}
    assert not kept[1000] and all(v for k, v in kept.items() if k != 1000)


def test_chi_square():
    assert abs(chi2_below(7.814728, 3) - 0.95) < 1e-6 and abs(chi2_quantile(0.95, 3) - 7.814728) < 1e-4


def test_verdicts_do_not_jump_with_the_size_of_a_group(spark):
    """A clean source of longer words, once with 199 rows and once with 200."""
    plain = [(i, " ".join(f"word{(i * 7 + k) % 500}" for k in range(60 + i % 9)), "en", "s") for i in range(1200)]
    other = [(10_000 + i, " ".join(f"longerwordsthere{(i * 11 + k) % 500:05d}" for k in range(60 + i % 7)), "en", "t") for i in range(200)]
    refused = []
    for n in (5, 199, 200):
        rows = judged(frame(spark, plain + other[:n])).where("NOT kept").select("doc_id").collect()
        refused.append({r["doc_id"] for r in rows})
    assert len(refused[1] ^ refused[2]) <= 3 and len(refused[2]) <= 3 and len(refused[0]) <= 8


def test_estimates_equal_brute_force(spark):
    """Of all subsets of the core's size the one whose covariance has the least determinant."""
    from itertools import combinations
    from math import ceil

    from envlake.llm.outliers import _V, CORE, VECTOR, estimates
    r = np.random.default_rng(4)
    floors = np.diag([VECTOR[v][1] ** 2 for v in _V])
    scale = CORE / chi2_below(chi2_quantile(CORE, 5), 7)
    for shift in (3.0, -5.0):
        x = r.normal(0, 1, (14, 5)) @ np.diag([1.0, 0.5, 0.8, 0.6, 0.7])
        x[:3] += shift * np.array([4, 2, 4, 3, 3])
        least = min((np.linalg.slogdet(np.cov(x[list(c)].T, bias=True) * scale + floors)[1], c) for c in combinations(range(14), ceil(14 * CORE)))
        m, s = x[list(least[1])].mean(axis=0), np.cov(x[list(least[1])].T, bias=True) * scale + floors
        d2 = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(s), x - m)
        usual = x[d2 <= chi2_quantile(0.975, 5)]
        df = spark.createDataFrame([("g", i % 32, *map(float, v)) for i, v in enumerate(x)], "key string, salt int, " + ", ".join(f"{v} double" for v in _V))
        got = estimates(df).first()
        assert abs(got["det"] - least[0]) < 1e-9 and got["n"] == 14
        assert np.allclose([got[f"m{i}"] for i in range(5)], usual.mean(axis=0))
        want = np.cov(usual.T, bias=True) + floors
        assert np.allclose([got[f"s{i}{j}"] for i in range(5) for j in range(i + 1)], [want[i, j] for i in range(5) for j in range(i + 1)])


def test_distances_equal_the_formula(spark, documents):
    from envlake.llm import outliers
    rows = documents.where("lang = 'en'").limit(40)
    got = {r["doc_id"]: r for r in judged(rows).collect()}
    v = text_counts(rows).withColumns({k: F.expr(e) for k, (e, _) in outliers.VECTOR.items()})
    base = {r["doc_id"] for r in got.values() if r["base_failed"]}
    keyed = [(r["doc_id"], s, np.array([r[k] for k in outliers._V])) for r, s in
             zip(sorted(v.collect(), key=lambda r: r["doc_id"]), [r["source"] for r in rows.orderBy("doc_id").collect()])]
    learn = [(k, 0, *map(float, x)) for i, s, x in keyed if i not in base for k in (f"g{s}", "l", "all")]
    fits = {r["key"]: r for r in outliers.estimates(spark.createDataFrame(learn, "key string, salt int, " + ", ".join(f"{k} double" for k in outliers._V))).collect()}

    def moments(r):
        s = np.zeros((5, 5))
        for i in range(5):
            for j in range(i + 1):
                s[i, j] = s[j, i] = r[f"s{i}{j}"]
        return np.array([r[f"m{i}"] for i in range(5)]), s

    def mixed(r, wide):
        (m, s), (wm, ws), w = moments(r), wide, r["n"] / (r["n"] + outliers.PRIOR)
        return w * m + (1 - w) * wm, w * s + (1 - w) * ws + w * (1 - w) * np.outer(m - wm, m - wm)
    language = mixed(fits["l"], moments(fits["all"]))
    for i, s, x in keyed:
        if i not in base:
            m, cov = mixed(fits[f"g{s}"], language)
            assert abs((x - m) @ np.linalg.solve(cov, x - m) - got[i]["distance"]) < 1e-6 * max(1, got[i]["distance"])
