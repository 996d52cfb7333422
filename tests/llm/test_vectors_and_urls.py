"""Hard negatives, centroids and urls against brute force, and their odd rows."""

import itertools
import math
import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from envlake.llm import centroids, hard_negatives, url_filter
from envlake.llm.embedding import products
from tests.llm.conftest import frame

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({c: F.lit(7) for c in ("row", "block", "shelf", "v", "lo", "hi", "rank", "score", "cluster", "c")}) if clash else df


def clumped(n, dim=64, seed=3, hot=0):
    """Vectors around a few centres; ``hot`` of them equal."""
    r = np.random.default_rng(seed)
    centres = r.normal(0, 0.3, (6, dim))
    x = (centres[r.integers(0, 6, n)] + r.normal(0, 0.02, (n, dim))).astype(np.float32)
    x[:hot] = x[0]
    return [(i, [float(v) for v in row], int(r.integers(0, 4))) for i, row in enumerate(x)]


def brute_negatives(rows, positives=5, negatives=10, low=30, high=90, scale=256, dim=64):
    kept = [(i, [math.floor(scale * x) for x in v], (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows
            if i is not None and l is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, l) in enumerate(kept):
        if i % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), j, m == l) for b, (j, w, m) in enumerate(kept) if b != a)
        for p, pid, _ in [s for s in scores if s[2]][:positives]:
            inside = [(-s, j) for s, j, same in scores if not same and low * -p <= 100 * -s <= high * -p][:negatives]
            out += [(i, pid, r, j, -p, s) for r, (s, j) in enumerate(inside, 1)]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(hard_negatives.embeddings_with_anchors(df), **kw).collect())


def test_hard_negatives_equal_brute_force_with_skipped_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "SHELF", 64)
    monkeypatch.setattr(hard_negatives, "CHUNK", 4)
    read = []
    real = hard_negatives.blocks_to_read
    monkeypatch.setattr(hard_negatives, "blocks_to_read", lambda *a: read.append(real(*a)) or read[-1])
    rows = clumped(1500, hot=400)
    assert mined(vectors(spark, rows)) == brute_negatives(rows)
    blocks = sum(r["n"] for f in read for r in f.select(F.size("blocks").alias("n")).collect())
    anchors = 15
    assert 0 < blocks < 0.8 * 2 * anchors * 1500 / 16  # some zone maps rule their block out


def test_hard_negatives_of_odd_rows(spark):
    rows = clumped(230)
    one = rows[5][1]
    rows += [(None, one, 1), (300, None, 1), (400, one[:63], 1), (500, [*one[:63], None], 1), (600, [*one[:63], NAN], 1), (700, [*one[:63], INF], 2),
             (800, one, None), (900, [], 3), (100, rows[100][1], rows[100][2]), (100, rows[100][1], rows[100][2]), (1000, [0.0] * 64, 2)]
    assert mined(vectors(spark, rows)) == brute_negatives(rows)
    assert mined(vectors(spark, [])) == []
    assert mined(vectors(spark, [(0, one, 1)])) == []


def test_a_component_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        mined(vectors(spark, [(0, [1e30] * 64, 1), (1, [1.0] * 64, 1)]))


def test_products_are_exact_beyond_doubles():
    big = np.array([[(1 << 27) - 1] * 64, [3] + [1 << 26] * 63])
    assert products(big, big).tolist() == [[sum(int(x) * int(y) for x, y in zip(a, b)) for b in big] for a in big]


def test_hilbert_curve_steps_to_neighbours():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    place = hard_negatives.hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted((sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, z)), j) for j, z in enumerate(c))
    for _ in range(rounds):
        got = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), g in zip(kept, got) if g == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, *nearest(v)) for i, v in kept]
    return sorted(((i or -1, j, d, sum(e for _, e, h in last if h == j), sum(e for _, e, _ in last),
                    sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in last))


def clusters(df):
    return sorted((r[0] or -1, *r[1:]) for r in centroids.clustered(df).collect())


def test_clusters_equal_brute_force(spark):
    rows = clumped(400, hot=130)
    one = rows[5][1]
    rows += [(None, one, 1), (500, None, 1), (501, one[:63], 1), (502, [*one[:63], None], 1), (503, [*one[:63], NAN], 1),
             (504, [*one[:63], -INF], 1), (505, one, None), (506, one + one, 1), (7, rows[7][1], 1), (7, rows[8][1], 1)]
    assert clusters(vectors(spark, rows)) == brute_clusters(rows)


def test_few_vectors_and_none(spark):
    rows = clumped(3)
    assert clusters(vectors(spark, rows)) == brute_clusters(rows)
    assert clusters(vectors(spark, rows[:1])) == brute_clusters(rows[:1])
    assert clusters(vectors(spark, [])) == []


def test_shallot_skips_and_stays_exact_while_centroids_move():
    r = np.random.default_rng(5)
    v = r.integers(-9, 9, (3000, 4))  # many ties
    at, before = r.integers(-9, 9, (12, 4)), None
    n = len(v)
    state = np.zeros(n, int), np.zeros(n, int), np.zeros(n), np.zeros(n)
    settled = 0
    for round_ in range(6):
        *state, d = centroids.shallot(v, centroids.Centres.of(at, before), *state, round_ == 0, False)
        every = ((v[:, None] - at[None]) ** 2).sum(axis=2)
        assert (state[0] == every.argmin(axis=1)).all()
        assert (d[d >= 0] == every.min(axis=1)[d >= 0]).all()
        others = np.sort(every, axis=1)[:, 1]
        assert (state[2] ** 2 >= every.min(axis=1) - 1e-6).all() and (state[3] ** 2 <= others + 1e-6).all()
        settled += int((d < 0).sum())
        before, at = at, at + r.integers(0, 2, at.shape) * (r.random(at.shape) < 0.2)
    assert settled > n


def brute_urls(pages, texts):
    words = {}
    for t in texts:
        for w in url_filter_runs((t or "").lower()):
            if w[0].isalpha() and len(w) <= 24:
                words[w] = words.get(w, 0) + 1
    total = sum(words.values())

    def split(run):
        def p(w):
            return math.log(words[w] / total) if w in words else math.log(10 / max(total, 1000)) - len(w) * math.log(10)
        best = {0: (0.0, [])}
        for e in range(1, len(run) + 1):
            best[e] = max(((best[s][0] + p(run[s:e]), best[s][1] + [run[s:e]]) for s in range(max(0, e - 24), e)), key=lambda x: x[0])
        return best[len(run)][1]
    out, learnt = [], {"block": {}, "allow": {}}
    n = {"block": 0, "allow": 0}
    for i, url in pages:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        tokens = ["h:" + w for r in url_filter_runs(host) for w in (split(r) if r[0].isalpha() else ["0"])]
        tokens += ["p:" + (r if r[0].isalpha() else "0") for r in url_filter_runs(path.lower())]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        out.append([i, host, path, rule, verdict, tokens])
        if verdict:
            n[verdict] += 1
            for t in tokens:
                learnt[verdict][t] = learnt[verdict].get(t, 0) + 1
    seen = {*learnt["block"], *learnt["allow"]}

    def weigh(t):
        b, a = ((learnt[c].get(t, 0) + 1) / (sum(learnt[c].values()) + len(seen)) for c in ("block", "allow"))
        return math.log(b / a)
    for row in out:
        score = None
        if row[4] is None:
            if n["block"] and n["allow"]:
                score = math.log(n["block"] / n["allow"]) + sum(weigh(t) for t in row[5] if t in seen)
            else:
                score = 1.0 if n["block"] else -1.0
            row[4] = "block" if score > 0 else "allow"
        row[5] = score
    return out


def url_filter_runs(text):
    return ["".join(g) for k, g in itertools.groupby(text, lambda c: c.isalpha() + 2 * c.isnumeric()) if k]


def judged(spark, pages, texts, clash=True):
    df = spark.createDataFrame(pages, "page_id long, url string")
    df = df.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "tokens", "shape", "words", "word", "n")}) if clash else df
    docs = frame(spark, [(k, t, "en", "s") for k, t in enumerate(texts)], clash=True)
    return url_filter.judge(df, docs)


def same(found, wanted):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    found = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["score"]) for r in found.collect()), key=key)
    wanted = sorted(map(tuple, wanted), key=key)
    assert [f[:5] for f in found] == [w[:5] for w in wanted]
    for f, w in zip(found, wanted):
        assert (f[5] is None) == (w[5] is None) and (f[5] is None or abs(f[5] - w[5]) < 1e-4)


def test_urls_equal_brute_force(spark, sf):
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same(judged(spark, pages, texts), brute_urls(pages, texts))


def test_odd_urls(spark):
    rnd = random.Random(1)
    long = "".join(rnd.choice("abcde") for _ in range(3000))
    pages = [(None, None), (1, None), (2, ""), (3, "no scheme/com/"), (4, "http://COM/"), (5, "http://com"), (6, "http://x.com?/a#b"), (7, "http://X.Example.COM/en/a?b"),
             (8, "http://www.example.com/en/"), (9, "http://notexample.com/en/"), (10, f"http://{long}.org/{long}/9"), (11, "http://a.net/es/1"), (11, "http://a.net/es/1"),
             (12, "http://a.net:80/es/1"), (13, "x://y://z.com/"), (14, "http://münchen.é.net/fr/ü"), (15, "http://cheapwords.org/en/12"), (16, "http://net/fr/"), (17, "://"), (18, "http://a.org/\nen/1")]
    same(judged(spark, pages, ["cheap words and cheap words", None, "", "München words"]), brute_urls(pages, ["cheap words and cheap words", None, "", "München words"]))
    same(judged(spark, pages, []), brute_urls(pages, []))
    only = [p for p in pages if p[0] in (4, 6, 8, 15)]
    same(judged(spark, only, ["a b"]), brute_urls(only, ["a b"]))
    same(judged(spark, [(1, "http://a.net/es/1"), (2, "q")], ["a b"]), brute_urls([(1, "http://a.net/es/1"), (2, "q")], ["a b"]))
    assert judged(spark, [], ["a"]).count() == 0


def test_hosts_split_into_known_words():
    counts = {"cheap": 50, "pills": 20, "online": 30, "on": 90, "line": 40, "a": 100}
    assert url_filter.split_run("cheappillsonline", counts, 1000) == ["cheap", "pills", "online"]
    assert url_filter.split_run("cheapzq", counts, 1000) == ["cheap", "zq"]
    assert url_filter.split_run("", counts, 1000) == [] and url_filter.split_run("zq", {}, 0) == ["zq"]
