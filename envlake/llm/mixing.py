"""Mixing sources to target weights by a temperature on their token shares.

A source with token share ``p`` gets the weight ``p**a / sum(p**a)``. The exponent is bisected
(over a grid of exponents per Spark job) to a target entropy of the weights, or so that no source
is read more than ``repeat`` times. Weights times the token budget are realised as block
permutations: each source's documents are hashed into blocks; an epoch reads all blocks in an
order of its own, and the last, partial epoch reads blocks in that order until the source's
budget is met, the block where it ends by rows in hashed order.

A row's block and place come from a digest of its id, text and source and, for a row that is there several
times, a number among its repeats, so rows without an id, or with one that others have, are dealt one
by one like any others. Repeats are numbered in parallel, by the parts of the table they lie in.

Defined results: a null source is a source of its own; a source without words is read once;
repeated rows are rows like others. An entropy that no exponent in [0, 1] gives is an error. Without a budget every source is read at least once, so no
document is lost. Words (``[^\\x20\\x09-\\x0D]+``) stand for tokens. Of the columns the plan reads
``doc_id``, ``text`` and ``source`` only. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envlake.llm.common import save

BLOCK = 500
_GRID = 32


def token_counts(docs: DataFrame) -> DataFrame:
    """``(doc_id, src, tokens, digest, nth)``: narrow rows, the last two telling each row from all others."""
    words = F.size(F.expr(r"array_remove(split(coalesce(CAST(text AS STRING), ''), '[\\x20\\x09-\\x0D]+', -1), '')"))
    return _numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _source(docs["source"]).alias("src"),
                                 words.cast("long").alias("tokens"), _digest(docs)))


def _digest(docs: DataFrame) -> F.Column:
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"), _source(docs["source"])).alias("digest")


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``nth``: 0, 1, ... among the rows of one digest (which are alike, so any order will do). Only repeats
    are moved; each part of the table numbers its own, after those of the parts before."""
    repeated = save(rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "mix-repeats")
    if repeated.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    once = rows.join(repeated, "digest", "left_anti").withColumn("nth", F.lit(0).cast("long"))
    more = save(rows.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(256))).join(repeated, "digest", "left_semi"), "mix-repeated")
    parts = more.groupBy("digest", "_part").agg(F.count("*").alias("n"))
    before = parts.withColumn("_before", F.sum("n").over(Window.partitionBy("digest").orderBy("_part")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("digest", "_part").orderBy(F.lit(0)))
    told = more.withColumn("_in", inside).join(before, ["digest", "_part"]).withColumn("nth", F.col("_before") + F.col("_in") - 1)
    return once.unionByName(told.select(*once.columns))


def _source(c: F.Column) -> F.Column:
    """A source as a text that differs for null."""
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string")))


def exponent(sources: DataFrame, repeat: float | None = 2.0, entropy: float | None = None, budget: float | None = None) -> float:
    """The exponent for shares in ``sources`` ``(src, t)``: the smallest in [0, 1] whose most repeated
    source stays within ``repeat``, or the one whose weights have ``entropy`` (nats)."""
    low, high = 0.0, 1.0
    shares = sources.where("t > 0").withColumn("p", F.col("t") / F.sum("t").over(Window.partitionBy()))
    for k in range(6):  # each round narrows the exponent 32 times
        grid = shares.select("p", "t", F.explode(F.array(*[F.lit(low + (high - low) * i / _GRID) for i in range(_GRID + 1)])).alias("a"))
        sums = grid.groupBy("a").agg(F.sum(F.expr("power(p, a)")).alias("z"), F.sum(F.expr("power(p, a) * ln(p)")).alias("l"),
                                     F.max(F.expr("power(p, a - 1)")).alias("most"), F.min(F.expr("power(p, a - 1)")).alias("least"),
                                     F.sum("t").alias("total"))
        rows = sums.orderBy("a").collect()  # one row for each of 33 exponents
        if not rows:
            return 1.0
        if entropy is not None and not k:  # at exponents 0 and 1
            most, least = (_log(r["z"]) - r["a"] * r["l"] / r["z"] for r in (rows[0], rows[-1]))
            if not least - 1e-9 <= entropy <= most + 1e-9:
                raise ValueError(f"weights of these sources can have an entropy from {least} to {most}, not {entropy}")
        if entropy is not None:
            enough = [r["a"] for r in rows if _log(r["z"]) - r["a"] * r["l"] / r["z"] >= entropy]  # falls as the exponent grows
            at = max(enough, default=low)
        else:
            scale = (lambda r: r["most"] / r["least"]) if budget is None else (lambda r: budget * r["most"] / r["z"] / r["total"])
            enough = [r["a"] for r in rows if scale(r) > repeat]
            at = max(enough, default=None)
            if at is None:
                return low
        low, high = at, min(high, at + (high - low) / _GRID)
    return high if entropy is None else low


def _log(x: float) -> float:
    import math
    return math.log(x)


def plan(counts: DataFrame, repeat: float | None = 2.0, entropy: float | None = None, budget: float | None = None,
         seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Per source ``(src, weight, epochs, rest, blocks)`` and per block ``(src, block, cut)``: rows
    of the partial epoch are those whose key is at most ``cut``."""
    sources = save(counts.groupBy("src").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")), "mix-sources")
    a = exponent(sources, repeat, entropy, budget)
    raw = sources.withColumn("raw", F.when(F.col("t") > 0, F.expr(f"power(t / sum(t) OVER (), {a!r}D)")).otherwise(0.0))
    weighed = raw.withColumn("weight", F.expr("CASE WHEN sum(raw) OVER () > 0 THEN raw / sum(raw) OVER () ELSE 0D END"))
    # without a budget: as much as the least repeated source needs for one whole epoch
    total = F.lit(float(budget)) if budget is not None else F.expr("min(CASE WHEN t > 0 THEN weight / t END) OVER ()") ** -1
    times = weighed.withColumn("times", F.when(F.col("t") > 0, F.round(F.col("weight") * total / F.col("t"), 9)).otherwise(1.0))
    sources = save(times.select("src", "t", "weight", "times", F.floor("times").alias("epochs"),
                                ((F.col("times") - F.floor("times")) * F.col("t")).alias("rest"),
                                F.ceil(F.col("n") / BLOCK).alias("blocks")), "mix-weights")
    rows = _keyed(counts, sources, seed)
    blocks = rows.groupBy("src", "block").agg(F.sum("tokens").alias("b"), F.first("rest").alias("rest"), F.first("epochs").alias("epochs"))
    order = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed), "epochs", "block"), "block")
    walked = blocks.withColumn("before", F.sum("b").over(order) - F.col("b"))
    status = save(walked.select("src", "block", (F.col("rest") - F.col("before")).alias("left"), "b"), "mix-blocks")
    ends = status.where("left > 0 AND left < b")
    inner = Window.partitionBy("src", "block").orderBy("key", "digest", "nth")
    last = (rows.join(ends.select("src", "block", "left"), ["src", "block"])
            .withColumn("before", F.sum("tokens").over(inner) - F.col("tokens")).where("before < left")
            .groupBy("src", "block").agg(F.max("key").alias("cut")))
    whole = status.where("left >= b").select("src", "block", F.lit(2 ** 63 - 1).alias("cut"))
    return sources, save(whole.unionByName(last), "mix-cuts")


def _keyed(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Adds the source's plan, the block and the key in the partial epoch."""
    return (rows.join(sources.select("src", "weight", "epochs", "rest", "blocks"), "src")
            .withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "digest", "nth"), F.col("blocks")))
            .withColumn("key", F.xxhash64(F.lit(seed + 1), "epochs", "digest", "nth")))


def realise(rows: DataFrame, planned: tuple[DataFrame, DataFrame], seed: int = 0) -> DataFrame:
    """``rows`` (with ``src``, ``digest`` and ``nth``) once for each epoch that reads them; adds ``weight``,
    ``epoch``, ``block``, ``block_order`` and ``order`` (sort by these to read an epoch)."""
    sources, cuts = planned
    dealt = _keyed(rows, sources, seed).join(cuts, ["src", "block"], "left")
    reads = F.col("epochs") + F.when(F.col("key") <= F.col("cut"), 1).otherwise(0)
    return (dealt.withColumn("_reads", reads).where("_reads > 0")
            .withColumn("epoch", F.explode(F.expr("sequence(0, CAST(_reads AS INT) - 1)")))
            .withColumn("block_order", F.xxhash64(F.lit(seed), F.col("epoch").cast("long"), "block"))
            .withColumn("order", F.xxhash64(F.lit(seed + 1), F.col("epoch").cast("long"), "digest", "nth"))
            .drop("epochs", "rest", "blocks", "key", "cut", "_reads"))


def mixed(docs: DataFrame, repeat: float | None = 2.0, entropy: float | None = None, budget: float | None = None,
          seed: int = 0) -> DataFrame:
    """``(doc_id, source, tokens, weight, epoch, block, block_order, order)``: one row per reading."""
    counts = save(token_counts(docs), "mix-counts")
    out = realise(counts, plan(counts, repeat, entropy, budget, seed), seed)
    return out.withColumn("source", F.expr("CASE WHEN src = '-' THEN NULL ELSE substring(src, 2) END")).select(
        "doc_id", "source", "tokens", "weight", "epoch", "block", "block_order", "order")


def mix_documents(docs: DataFrame, repeat: float | None = 2.0, entropy: float | None = None, budget: float | None = None,
                  seed: int = 0) -> DataFrame:
    """The documents themselves, each as often as the mixture reads it, with their own columns."""
    counts = save(token_counts(docs), "mix-counts")
    names = docs.columns
    rows = _numbered(docs.select(F.struct(*[docs[c] for c in names]).alias("row"), _source(docs["source"]).alias("src"), _digest(docs)))
    return realise(rows, plan(counts, repeat, entropy, budget, seed), seed).select("row.*")
