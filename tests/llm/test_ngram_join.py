import random

import numpy as np
import pytest

from envlake.llm.ngram_join import bands, jaccard_components, jaccard_links, most_apart, sets_of, signatures
from tests.llm.conftest import frame


def components_by_hand(rows, words, part):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            c = len(sets[i] & sets[j])
            if c and 100 * c >= part * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("part", [85, 80])
def test_linked_sets_share_a_signature(part):
    """The guarantee itself, at the limit of each size: as many differences as a link may have."""
    rng = np.random.default_rng(2)
    for b in [*range(1, 80), 150, 333, 1000, 4000]:
        for a in {max(1, -(-part * b // 100)), (b + max(1, part * b // 100)) // 2, b}:
            h = most_apart(a, b, part)
            if h < 0 or a > b:
                continue
            common = (a + b - h) // 2
            pool = np.unique(rng.integers(0, 2 ** 62, 2 * (a + b) + 8))[:a + b].astype(np.uint64)
            rng.shuffle(pool)
            x = np.sort(pool[:a])
            y = np.sort(np.concatenate([pool[:common], pool[a:a + b - common]]))
            found = []
            for s in (x, y):
                offs = np.array([0, len(s)])
                found.append([set(signatures(s, offs, up, part)[0].tolist()) for up in (False, True)])
            if common == a == b:
                continue
            assert any(p & q for p in found[0] for q in found[1]), (a, b, h)


def test_bands_have_enough_segments():
    for low, h, m, k, e in bands(20_000):
        assert h <= 0 or m + k >= h + 1 + 2 * e and k <= m


@pytest.mark.parametrize("words,part", [(4, 85), (5, 80)])
def test_near_copies_of_every_length(spark, words, part):
    random.seed(words)
    rows, i = [], 0
    for size in (4, 7, 9, 12, 15, 20, 33, 60, 120, 400):
        text = [f"{size}w{k}" for k in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 5):
            t = list(text)
            for _ in range(edits):
                t[random.randrange(size)] = f"n{random.random()}"
            rows.append((i, " ".join(t), "en", "s"))
            i += 1
    # a crowd: many copies with edits of their own, some shared
    text = [f"c{k}" for k in range(150)]
    for n in range(120):
        t = list(text)
        for _ in range(n % 9):
            t[random.randrange(150)] = random.choice(["v1", "v2", f"n{random.random()}"])
        rows.append((i, " ".join(t), "en", "s"))
        i += 1
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(frame(spark, rows), words, part).collect()}
    assert got == components_by_hand(rows, words, part)


def test_odd_rows(odd, none, odd_rows):
    got = jaccard_components(odd).collect()
    assert len(got) == len(odd_rows)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (1, 4)
    assert by[6][1] == 5 and by[8] == (3, 7)
    assert jaccard_components(none).count() == 0


def test_every_link_of_a_crowd(spark, odd, none):
    random.seed(5)
    text, rows = [f"c{k}" for k in range(150)], []
    for i in range(60):
        t = list(text)
        for _ in range(i % 5):
            t[random.randrange(150)] = f"n{random.random()}"
        rows.append((i, " ".join(t), "en", "s"))
    sets = {i: {tuple(t.split()[k:k + 4]) for k in range(147)} for i, t, *_ in rows}
    want = {(i, j) for i in sets for j in sets if i != j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    links, each = (x.collect() for x in jaccard_links(frame(spark, rows)))
    first = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    between = {(first[i], first[j]) for i, j in want if first[i] != first[j]}
    assert {(r["doc_a"], r["doc_b"]) for r in links} | {(r["doc_b"], r["doc_a"]) for r in links} == between
    assert len(links) * 2 == len(between)
    assert {r["doc_id"]: r["n_links"] for r in each} == {i: sum(x == i for x, _ in want) for i in sets}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in each} == components_by_hand(rows, 4, 85)
    by = {r["doc_id"]: r["n_links"] for r in jaccard_links(odd)[1].collect()}
    assert by[1] == by[2] == by[9] == 0 and by[5] == by[6] == 1 and by[7] == by[8] == 2
    assert jaccard_links(none)[1].count() == 0


def test_sets_are_distinct():
    h, offs = sets_of([b"a b c d a b c d", b"", b"A B"], 4)
    assert np.diff(offs).tolist() == [4, 0, 1]
