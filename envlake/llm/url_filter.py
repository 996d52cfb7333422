"""URL filter: rules first, then naive Bayes over segmented hosts and path tokens.

Hosts are often words written together. Word counts over all texts make a unigram model; each run of
letters of a host is split into the words of highest total log probability (Viterbi; an unknown piece
of n letters has probability 10 / (N * 10**n), with N at least ``LEAST_WORDS``). The urls that a rule decides are the learning rows of a
multinomial naive Bayes classifier over host words and path tokens, which decides the others.

Shape: urls are reduced to distinct hosts and distinct lists of path tokens before anything is joined,
so that a host with a third of all urls is one row. The words that may occur in a host are found by
joining its pieces (at most ``LONGEST`` letters) with the word counts, so no vocabulary is broadcast or held.
Token weights are integers (billionths of a log ratio), so their sums don't depend on order. Joins are left to
Spark, which splits skewed sides; only counts of classes reach the driver.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and no tokens, and gets
the verdict of the priors. Tokens never seen in learning count for nothing. A score of zero or less is
``allow``; if all learning rows are of one class that is every verdict, without any it is ``allow``. Repeated rows
are judged each. Long urls are used whole. Empty tables give no rows (urls) or no known words (texts). Only the id
and the url, and the texts' ``text``, are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envlake.llm.common import save, ship_package

#: Letters of the longest piece that a run is split into.
LONGEST = 24
#: Words that the model counts as having seen at least, so that an unknown letter isn't likelier than a word.
LEAST_WORDS = 1000
#: (verdict, host, path): a rule fits its host and all its subdomains where the path starts with its own.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
_RUNS = r"\p{L}+|\p{N}+"
_UNIT = 1_000_000_000


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def tokens_of(text: Column) -> Column:
    """Runs of letters in lower case; each run of digits is ``0``."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(_RUNS), F.lit(0)),
                       lambda w: F.when(w.rlike(r"^\p{N}"), "0").otherwise(w))


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)``: runs of letters, in lower case, of all texts; those longer than a piece can't be one."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.where(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))


def split_run(run: str, counts: Mapping[str, int], total: int, longest: int = LONGEST) -> list[str]:
    """The words of highest total log probability; of equal ones the shorter last word."""
    best, cut = [0.0], [0]
    for end in range(1, len(run) + 1):
        top, at = -math.inf, end - 1
        for start in range(end - 1, max(0, end - longest) - 1, -1):
            n = counts.get(run[start:end])
            p = best[start] + (math.log(n / total) if n else math.log(10 / max(total, LEAST_WORDS)) - (end - start) * math.log(10))
            if p > top:
                top, at = p, start
        best.append(top)
        cut.append(at)
    out, end = [], len(run)
    while end:
        out.append(run[cut[end]:end])
        end = cut[end]
    return out[::-1]


def segment_hosts(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """``(host, words)`` of distinct hosts, by the word counts."""
    ship_package(hosts.sparkSession)
    keyed = save(hosts.select(F.md5(F.col("host").cast("binary")).alias("key"), "host", F.regexp_extract_all("host", F.lit(_RUNS), F.lit(0)).alias("runs")),
                 "url-hosts")
    total = counts.agg(F.sum("n")).first()[0] or 0

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(keys: list, words: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(keys, pa.string()), pa.array(words, pa.string())], ["key", "word"])
        for b in batches:
            keys, words = [], []
            for key, runs in zip(b.column("key").to_pylist(), b.column("runs").to_pylist()):
                for run in runs:
                    for start in range(len(run)):
                        for end in range(start + 1, min(len(run), start + LONGEST) + 1):
                            keys.append(key)
                            words.append(run[start:end])
                        if len(keys) >= 50_000:
                            yield told(keys, words)
                            keys, words = [], []
            yield told(keys, words)
    found = (keyed.select("key", "runs").mapInArrow(pieces, "key string, word string").distinct()
             .join(counts, "word").groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("known")))  # a host's own pieces

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for runs, known in zip(b.column("runs").to_pylist(), b.column("known").to_pylist()):
                have = {x["word"]: x["n"] for x in known or []}
                out.append([w for run in runs for w in (split_run(run, have, total) if run[:1].isalpha() else ["0"])])
            yield pa.record_batch([b.column("host"), pa.array(out, pa.list_(pa.string()))], ["host", "words"])
    return save(keyed.join(found, "key", "left").select("host", "runs", "known").mapInArrow(split, "host string, words array<string>"), "url-words")


def _each(counted: DataFrame, tokens: str, mark: str) -> DataFrame:
    """``(verdict, token, n)`` of counted rows with a list of tokens."""
    return counted.select("verdict", F.explode(tokens).alias("t"), "n").select("verdict", F.concat(F.lit(mark), "t").alias("token"), "n")


def learn_weights(urls: DataFrame, words: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, int]:
    """``(token, w)`` of all tokens of urls with a verdict, and the weight of the priors: billionths of
    ``log P(token | block) - log P(token | allow)``, with ``alpha`` added to every count."""
    known = urls.where("verdict IS NOT NULL")
    hosts = known.groupBy("host", "verdict").agg(F.count("*").alias("n")).join(words, "host")
    paths = known.groupBy("shape", "verdict").agg(F.count("*").alias("n"), F.first("tokens").alias("tokens"))
    block = F.col("verdict") == "block"
    counts = save(_each(hosts, "words", "host:").unionAll(_each(paths, "tokens", "path:")).groupBy("token").agg(
        F.sum(F.when(block, F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(block, 0).otherwise(F.col("n"))).alias("a")), "url-tokens")
    b, a, size = counts.agg(F.sum("b"), F.sum("a"), F.count("*")).first()
    rows = {r["verdict"]: r["n"] for r in known.groupBy("verdict").agg(F.count("*").alias("n")).collect()}  # two rows
    if not rows.get("block") or not rows.get("allow"):
        return counts.select("token", F.lit(0).cast("long").alias("w")).where("false"), _UNIT if rows.get("block") else -_UNIT
    ratio = (F.log((F.col("b") + alpha) / ((b or 0) + alpha * size)) - F.log((F.col("a") + alpha) / ((a or 0) + alpha * size)))
    return save(counts.select("token", F.round(ratio * _UNIT).cast("long").alias("w")), "url-weights"), round(math.log(rows["block"] / rows["allow"]) * _UNIT)


def _sums(lists: DataFrame, key: str, tokens: str, mark: str, weights: DataFrame, name: str) -> DataFrame:
    """``(key, score)``: the sum of the weights of each distinct list."""
    each = lists.select(key, F.explode(tokens).alias("t")).groupBy(key, "t").agg(F.count("*").alias("n")).withColumn("token", F.concat(F.lit(mark), "t"))
    return each.join(weights, "token").groupBy(key).agg(F.sum(F.col("n") * F.col("w")).alias(name))


def judge(pages: DataFrame, docs: DataFrame, rules=RULES, alpha: float = 1.0) -> DataFrame:
    """``(page_id, host, path, rule, verdict, host_words, score)`` of every row; ``score`` is the log ratio of block to
    allow of the classifier, for all urls that no rule decides."""
    url = F.col("url").cast("string")
    split = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    tokens = tokens_of(F.col("path"))
    urls = save(split.select("*", rule.alias("rule"), verdict.alias("verdict"), tokens.alias("tokens"),
                             F.md5(F.array_join(tokens, "/").cast("binary")).alias("shape")), "urls")
    words = segment_hosts(urls.select("host").distinct(), save(word_counts(docs), "url-vocabulary"))
    weights, prior = learn_weights(urls, words, alpha)
    open_ = urls.where("verdict IS NULL")
    hosts = save(_sums(open_.select("host").distinct().join(words, "host"), "host", "words", "host:", weights, "by_host"), "url-hosts")  # both are written, so that Spark can split a hot host or path in the joins below
    paths = save(_sums(open_.groupBy("shape").agg(F.first("tokens").alias("tokens")), "shape", "tokens", "path:", weights, "by_path"), "url-paths")
    total = F.lit(prior) + F.coalesce("by_host", F.lit(0)) + F.coalesce("by_path", F.lit(0))
    own = words.withColumnRenamed("words", "host_words")
    decided = (urls.join(own, "host", "left").join(hosts, "host", "left").join(paths, "shape", "left")
               .withColumn("score", F.when(F.col("verdict").isNull(), total / _UNIT)))
    return decided.select("page_id", "host", "path", "rule", F.coalesce(
        "verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "host_words", "score")
