"""Language of web pages by fusing evidence in Bayes' way.

Text: log likelihoods of hashed byte trigrams, learnt from all labelled ``documents`` by grouped
sums. Declared markup language (``lang`` of ``html``, searched in the whole page outside comments)
and address suffix: likelihoods of what a page declares or ends in, given its language, from
smoothed grouped counts of text posteriors.
Host: a prior smoothed towards its domain's, that towards its suffix's, that towards all pages',
again by grouped sums of text posteriors, less the page's own. The posterior is the normalised
product; the text's weight is bounded by :data:`NATS` nats a trigram and by its length, since
trigrams overlap and aren't independent.

Defined results: a page with null or empty html and url has the prior of all pages; null parts
form groups of their own and count as evidence like others; repeated pages are judged each. With
no labelled document there is no language, and each page has a null one. Of ``documents``,
``text`` and ``lang`` are read; of ``pages``, ``page_id``, ``url`` and ``html``.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envlake.llm.common import save, ship_package, slices

#: Hashed trigrams; the model is this many counts for each language.
BUCKETS = 1 << 15
NATS = 0.25
#: Pseudo-pages that an upper level lends to a lower one.
LENT = 4.0

_DROP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_START = re.compile(r"<!--|<html\b", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)


def visible(page: str) -> str:
    """The text of a page without markup, scripts, styles and comments."""
    return entities.unescape(_TAG.sub(" ", _DROP.sub(" ", page)))


def declared(page: str) -> str | None:
    """The language that the first ``html`` tag with one declares, wherever it stands; comments don't
    count. Each part of the page is read once."""
    at, closed = 0, True
    while m := _START.search(page, at):
        if m[0] == "<!--":
            end = page.find("-->", m.start() + 2) if closed else -1
            closed = end >= 0
            at = end + 3 if closed else m.end()
        else:
            end = page.find(">", m.end())
            at = end if end >= 0 else len(page)
            if found := _LANG.search(page, m.end(), at):
                return found[1].lower()
    return None


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram (letters folded, runs of other ASCII as one blank), and its text."""
    joined = b"".join(b" " + t + b" " for t in texts)
    offs = np.cumsum([0, *[len(t) + 2 for t in texts]])
    table = np.full(256, 32, dtype=np.uint32)
    table[128:] = np.arange(128, 256)
    table[97:123] = table[65:91] = np.arange(97, 123)
    x = table[np.frombuffer(joined, dtype=np.uint8)]
    doc = np.repeat(np.arange(len(texts)), np.diff(offs))
    stay = np.ones(len(x), dtype=bool)
    stay[1:] = (x[1:] != 32) | (x[:-1] != 32) | (doc[1:] != doc[:-1])
    x, doc = x[stay], doc[stay]
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64) & (BUCKETS - 1)
    same = doc[2:] == doc[:-2]
    return bucket[same], doc[2:][same]


def learn_text(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, and the log likelihood of each bucket under each (a table of fixed width)."""
    ship_package(docs.sparkSession)
    known = docs.where("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"),
                                                  F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in slices(batches):
            langs = b.column("lang").to_pylist()
            bucket, doc = _trigrams([t.encode() for t in b.column("text").to_pylist()])
            names = sorted(set(langs))
            which = np.array([names.index(x) for x in langs])[doc] if len(doc) else doc
            counts = np.bincount(which * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for name, c in zip(names, counts):
                total[name] = total[name] + c if name in total else c
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())],
                                  ["lang", "bucket", "n"])
    sums = known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = sums.collect()  # at most BUCKETS rows a language
    langs = sorted({r["lang"] for r in rows})
    counts = np.full((len(langs), BUCKETS), 0.1)
    for r in rows:
        counts[langs.index(r["lang"]), r["bucket"]] += r["n"]
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)) if langs else counts


def identify(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """``(page_id, lang, posterior, text_lang, declared, suffix, host)`` of every page."""
    spark = pages.sparkSession
    ship_package(spark)
    d = len(langs)
    chosen = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                          F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    if not d:
        nothing = F.lit(None).cast("string")
        return chosen.select("page_id", nothing.alias("lang"), F.lit(None).cast("double").alias("posterior"), nothing.alias("text_lang"),
                             nothing.alias("declared"), nothing.alias("suffix"), nothing.alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(table.astype(np.float32))  # BUCKETS numbers a language

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = shared.value
        for b in slices(batches, column="html"):
            raw = b.column("html").to_pylist()
            bucket, doc = _trigrams([visible(t).encode("utf-8", "replace") for t in raw])
            n = np.bincount(doc, minlength=len(raw))
            like = np.column_stack([np.bincount(doc, weights=row[bucket], minlength=len(raw)) for row in log])
            like = like / np.maximum(n, 1)[:, None] * np.minimum(n * NATS, 200)[:, None]
            flat = (like - like.max(axis=1, keepdims=True)).reshape(-1)
            hosts = [_host(u) for u in b.column("url").to_pylist()]
            yield pa.record_batch([
                b.column("page_id"), pa.array(hosts, pa.string()), pa.array([".".join(h.split(".")[-2:]) for h in hosts], pa.string()),
                pa.array([h.rpartition(".")[2] for h in hosts], pa.string()), pa.array([declared(t) for t in raw], pa.string()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * d, pa.int32()), pa.array(flat, pa.float64()))],
                ["page_id", "host", "domain", "suffix", "declared", "text"])
    seen = chosen.mapInArrow(read, f"page_id {kind}, host string, domain string, suffix string, declared string, text array<double>")
    norm = "transform(text, x -> exp(x) / aggregate(text, 0D, (s, y) -> s + exp(y)))"
    seen = save(seen.withColumn("p", F.expr(norm)).withColumn("declared", F.coalesce("declared", F.lit(""))), "lang-pages")

    sums = [F.sum(F.col("p")[i]).alias(f"n{i}") for i in range(d)]

    def counted(*by: str) -> DataFrame:
        return seen.groupBy(*by).agg(F.array(*sums).alias(by[-1] + "_n"))
    every = seen.agg(F.array(*[F.coalesce(s, F.lit(0.0)) for s in sums]).alias("all_n"))
    joined = seen.crossJoin(F.broadcast(every))  # one row
    for by in ("declared", "suffix", "domain", "host"):
        joined = joined.join(counted(by), by)

    def smooth(own: str, upper: str) -> str:
        """Shares of one level less the page itself, with pseudo-pages from the level above."""
        return (f"transform({own}, (n, i) -> (greatest(n - p[i], 0D) + {LENT} * {upper}[i]) "
                f"/ (aggregate({own}, 0D, (s, y) -> s + y) - 1 + {LENT}))")
    levels = joined.withColumn("prior", F.expr(smooth("all_n", f"array_repeat({1 / d!r}D, {d})")))
    for by in ("suffix", "domain", "host"):
        levels = levels.withColumn("prior", F.expr(smooth(f"{by}_n", "prior")))
    # P(value | language) = pages of the language with the value / its pages, a pseudo-page of either side lent
    fused = levels.withColumn("log", F.expr(
        "transform(text, (t, i) -> t + ln(greatest(prior[i], 1e-300D)) "
        "+ ln((greatest(declared_n[i] - p[i], 0D) + 0.5D) / (greatest(all_n[i] - p[i], 0D) + 1D)) "
        "+ ln((greatest(suffix_n[i] - p[i], 0D) + 0.5D) / (greatest(all_n[i] - p[i], 0D) + 1D)))"))
    names = "array(" + ", ".join("'" + x.replace("'", "\\'") + "'" for x in langs) + ")"
    best = fused.withColumn("top", F.expr("array_max(log)"))
    return best.select(
        "page_id", F.expr(f"{names}[CAST(array_position(log, top) AS INT) - 1]").alias("lang"),
        F.expr("1 / aggregate(log, 0D, (s, x) -> s + exp(x - top))").alias("posterior"),
        F.expr(f"{names}[CAST(array_position(text, array_max(text)) AS INT) - 1]").alias("text_lang"),
        F.expr("nullif(declared, '')").alias("declared"), F.expr("nullif(suffix, '')").alias("suffix"), F.expr("nullif(host, '')").alias("host"))


def _host(url: str) -> str:
    rest = url.partition("://")[2] or url
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower()
