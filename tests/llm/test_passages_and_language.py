import re

from envlake.llm.langid import declared, identify, learn_text, visible
from envlake.llm.suffixes import repeated_passages
from tests.llm.conftest import frame


def test_passages_equal_brute_force(documents):
    got = {r["doc_id"]: {x for s in r["spans"] for x in range(s["start"], s["end"])} for r in repeated_passages(documents).collect()}
    seen = {}
    for r in documents.collect():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", r["text"])]
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k:k + 50]), []).append((r["doc_id"], k))
    want = {}
    for places in seen.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                want.setdefault(i, set()).update(range(k, k + 50))
    assert got == want


def test_passages_of_odd_rows(odd, none):
    got = {r["doc_id"] for r in repeated_passages(odd).collect()}
    assert got == {5, 6}
    assert repeated_passages(none).count() == 0


def test_passage_left_of_a_common_line(spark):
    """Two documents share 25 words and the common line after them, which thousands go on from otherwise."""
    line, own = [f"line{k}" for k in range(30)], [f"own{k}" for k in range(25)]
    rows = [(i, " ".join([*[f"a{i}w{k}" for k in range(40)], *(own if i in (100, 300) else [f"b{i}w{k}" for k in range(25)]),
                          *line, *[f"z{i * 7919 % 401}w{k}" for k in range(60)]]), "en", "s") for i in range(400)]
    got = {r["doc_id"]: [tuple(x)[:2] for x in r["spans"]] for r in repeated_passages(frame(spark, rows)).collect()}
    assert got == {100: [(40, 95)], 300: [(40, 95)]}


def test_classes_reach_all_and_the_first_stays(spark):
    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(70)]
    rows = [(i, " ".join([f"x{i}w{k}" for k in range(50)] + a + [f"y{i}w{k}" for k in range(50)] + (b if i % 3 == 0 else [])), "en", "s")
            for i in range(40)]
    rows.append((99, " ".join(b[:55]), "en", "s"))
    got = {r["doc_id"]: r for r in repeated_passages(frame(spark, rows)).collect()}
    assert len(got) == 41
    of = {i: {s["start"]: s["class_id"] for s in r["spans"]} for i, r in got.items()}
    assert len({x[50] for i, x in of.items() if i < 99}) == 1
    assert {x[160] for i, x in of.items() if i % 3 == 0 and i < 99} == {of[99][0]} != {of[0][50]}
    assert got[0]["repeats"] == [] and [tuple(x) for x in got[1]["repeats"]] == [(50, 110)]
    assert [tuple(x) for x in got[39]["repeats"]] == [(50, 110), (160, 230)] and [tuple(x) for x in got[99]["repeats"]] == [(0, 55)]


def test_languages_by_held_out_declarations(spark, documents, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    langs, table = learn_text(documents)
    got = identify(pages, langs, table).collect()
    assert len(got) == pages.count()
    right = [r["lang"] == r["declared"] for r in got if r["declared"] in langs]
    assert sum(right) >= 0.9 * len(right)
    # text alone, with declaration, address and host taken away
    bare = identify(pages.selectExpr("page_id", "CAST(NULL AS STRING) AS url", "regexp_replace(html, 'lang=.[a-z]+.', '') AS html"), langs, table)
    by = {r["page_id"]: r["declared"] for r in got}
    right = [r["lang"] == by[r["page_id"]] for r in bare.collect() if by[r["page_id"]] in langs]
    assert sum(right) >= 0.9 * len(right)


def test_declarations_far_down_a_page(spark, documents):
    langs, table = learn_text(documents)
    pages = [(1, "", "<!-- " + "licence " * 1000 + '--><html lang="de"><p>und'), (2, "", "\n" * 5000 + "<html class=x lang=es>"),
             (3, "", "<!-- <html lang=fr> --><html lang=en>"), (4, "", "<!-- <html lang=fr> -->"), (5, "", "<p>" * 3000)]
    got = {r["page_id"]: r["declared"] for r in identify(spark.createDataFrame(pages, "page_id long, url string, html string"), langs, table).collect()}
    assert got == {1: "de", 2: "es", 3: "en", 4: None, 5: None}
    # in time linear in the page
    assert declared("<html " * 100_000) is None and declared("<!--" * 100_000) is None


def test_odd_pages(spark, documents, none):
    langs, table = learn_text(documents)
    kind = "page_id long, url string, html string, lang string"
    odd = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "", "", None), (2, "http://a@h.x.de:80/p?q", "<html lang=DE><p>und der", "x")], kind)
    got = identify(odd, langs, table).collect()
    assert len(got) == 4 and all(r["lang"] in langs and 0 < r["posterior"] <= 1 for r in got)
    assert [r["host"] for r in got if r["page_id"] == 2] == ["h.x.de"]
    assert identify(odd, *learn_text(none)).where("lang IS NULL").count() == 4
    assert identify(odd.limit(0), langs, table).count() == 0
    assert "var" not in visible("<script>var a</script>x&amp;y<!-- c -->") and "x&y" in visible("x&amp;y")
