import hashlib

import numpy as np

from envlake.llm.fingerprint import (containment, decode, distinct, edited_fingerprints, encode, fingerprints, merge,
                                     merge_fingerprints, resemblance, sketches)


def sets(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_estimates_follow_the_sets():
    rng = np.random.default_rng(1)
    w = [f"w{i}" for i in rng.integers(0, 10 ** 6, 4000)]
    a, b = " ".join(w[:3000]), " ".join(w[1000:])
    sa, sb = sketches([a.encode(), b.encode()])
    j = len(sets(a) & sets(b)) / len(sets(a) | sets(b))
    assert abs(resemblance(sa, sb) - j) < 0.1
    assert abs(containment(sa, sb) - len(sets(a) & sets(b)) / len(sets(a))) < 0.15
    assert abs(distinct(sa) / len(sets(a)) - 1) < 0.25
    both = sketches([(a + " . " + b).encode()])[0]
    assert abs(distinct(merge(sa, sb)) / distinct(both) - 1) < 0.1


def test_text_form_round_trips_and_empty():
    s = sketches([b"a b c d e f g", b"", b"x"])
    assert all((decode(encode(x)) == x).all() for x in s)
    assert encode(s[1]) == "" and resemblance(s[1], s[1]) == 1.0 and resemblance(s[1], s[2]) == 0.0


def test_merge_by_group_equals_the_union(spark, documents):
    one = fingerprints(documents)
    joined = one.join(documents.select("doc_id", "source"), "doc_id")
    got = {r["source"]: r["fingerprint"] for r in merge_fingerprints(joined, "source").collect()}
    want = {}
    for r in joined.collect():
        want[r["source"]] = merge(want.get(r["source"], decode("")), decode(r["fingerprint"]))
    assert got == {k: encode(v) for k, v in want.items()}


def test_edited_texts_for_any_number_of_ranges(spark, documents):
    rows = sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())
    want = {}
    for k, (i, t) in enumerate(rows):
        n, cut = rows[(k + 1) % len(rows)][1], len(t) // 4
        want[i] = hashlib.sha256((t[:len(t) - cut] + n[:cut]).encode()).hexdigest()
    for tasks in (1, 7, 300):
        got = edited_fingerprints(documents, tasks=tasks).collect()
        assert {r["doc_id"]: r["edited_sha256"] for r in got} == want and len(got) == len(rows)


def test_odd_rows(odd, none, odd_rows):
    got = edited_fingerprints(odd, tasks=3).collect()
    assert len(got) == len(odd_rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["n_chars"] == 0 and by[1]["fingerprint"] == "" and by[5]["fingerprint"] == by[6]["fingerprint"]
    assert edited_fingerprints(none).count() == 0 and fingerprints(none).count() == 0


def test_likeness_of_edited_and_next_texts(documents):
    """The query's likenesses, from each row's own fingerprints and the next row's."""
    got = {r["doc_id"]: r for r in edited_fingerprints(documents, tasks=5).collect()}
    order = sorted(got)
    for i, after in zip(order, [*order[1:], order[0]]):
        own = decode(got[i]["fingerprint"])
        assert abs(got[i]["near_edited"] - resemblance(own, decode(got[i]["edited_fingerprint"]))) < 1e-12
        assert abs(got[i]["near_next"] - resemblance(own, decode(got[after]["fingerprint"]))) < 1e-12
