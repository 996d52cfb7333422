"""Quality rules: fixed counts, then robust multivariate outliers per language and source.

DataFrame and SQL functions only. Every text gives counts (see :func:`text_counts`) and a vector
of transformed statistics. For each (language, source), each language and all rows a
minimum-covariance-determinant estimate is found by concentration steps from two starts (medians with
interquartile ranges, medians with the covariance of spatial signs): take the share :data:`CORE` of rows with
the smallest Mahalanobis distance, estimate mean and covariance of those, and repeat until no determinant falls
any more; of the two the one of least determinant stays and is reweighted once.

A group of ``n`` rows is judged by its own estimate with the weight ``n / (n + PRIOR)`` and by its language's with
the rest, a language by its own and that of all rows likewise: the moments are those of the mixture, so a small
group that differs widens its own covariance, and verdicts don't jump at any size. A row is
rejected if its distance exceeds the chi-square quantile that :data:`TAIL` leaves beyond. The covariance of a
statistic can't fall below its floor, so groups of equal rows (copies) don't reject what differs a little.

Rows and estimates are joined by key and a salt that spreads a group's rows, whatever its size.

Defined results: a null or empty text has no words and fails the base rules; a null language or
source is a group of its own; repeated rows are judged each and count each. With no row that
passes the base rules there is no estimate and nothing more to reject. Of the columns only
``doc_id``, ``text``, ``lang`` and ``source`` are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envlake.llm.common import id_text, save

CORE = 0.75
#: Steps at most, and the fall of a log determinant that counts as one.
STEPS, FALL = 20, 0.01
#: Rows that a wider group's estimate counts as.
PRIOR = 200
SALTS = 32
TAIL = 1e-4

#: The transformed statistics, and the least standard deviation of each.
VECTOR = {
    "v1": ("ln((word_chars + 200.0D) / (n_words + 40.0D))", 0.12),
    "v2": ("sqrt(n_symbols / (word_chars + 200.0D))", 0.045),
    "v3": ("sqrt(n_upper / (word_chars + 200.0D))", 0.08),
    "v4": ("sqrt(n_marks / (word_chars + 200.0D))", 0.045),
    "v5": ("sqrt(n_repeat_words / (n_words + 200.0D))", 0.10),
}
_V = list(VECTOR)
_D = len(_V)


def chi2_below(x: float, d: int) -> float:
    """The chi-square distribution function (series of the incomplete gamma function)."""
    a, z = d / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= z / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, d) < p else (low, mid)
    return high


def text_counts(docs: DataFrame, *more: str) -> DataFrame:
    """``(doc_id, *more, n_words, word_chars, n_symbols, n_upper, n_marks, n_dup_lines, n_repeat_words)``.

    Words are ``[^\\x20\\x09-\\x0D]+``. All counts are taken within the row: no shuffle, and no
    rows for words. Windows of eight words are compared by 64-bit hashes.
    """
    rows = id_text(docs, *more).select(
        "*", F.expr(r"array_remove(split(text, '[\\x20\\x09-\\x0D]+', -1), '')").alias("_w"),
        F.expr(r"filter(split(text, '\n', -1), l -> l RLIKE '[^\\x20\\x09-\\x0D]')").alias("_l"))
    hashed = rows.select(
        "doc_id", *more, F.size("_w").alias("_n"), F.length(F.array_join("_w", "")).alias("_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("_symbols"),
        F.expr("length(text) - length(regexp_replace(text, '[A-Z]+', ''))").alias("_upper"),
        F.expr("length(text) - length(replace(text, '!', ''))").alias("_marks"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).alias("_lines"),
        F.expr("transform(_w, w -> xxhash64(w))").alias("_h"))
    eight = ", ".join(f"_h[i + {k}]" for k in range(8))
    windows = hashed.withColumn("_g", F.expr(
        f"CASE WHEN _n >= 8 THEN transform(sequence(0, _n - 8), i -> xxhash64({eight})) "
        "ELSE CAST(array() AS array<bigint>) END")).drop("_h")
    # only texts with a repeated window get their windows sorted
    pairs = windows.withColumn("_p", F.expr(
        "CASE WHEN size(array_distinct(_g)) < size(_g) THEN "
        "sort_array(transform(_g, (h, i) -> named_struct('h', h, 'i', i))) END"))
    places = pairs.withColumn("_q", F.expr(
        "sort_array(filter(_p, (x, k) -> get(_p, k - 1).h <=> x.h OR get(_p, k + 1).h <=> x.h).i)"))
    covered = F.expr("CASE WHEN _q IS NULL THEN 0 ELSE aggregate(_q, named_struct('end', 0, 'n', 0), "
                     "(a, p) -> named_struct('end', p + 8, 'n', a.n + p + 8 - greatest(p, a.end)), a -> a.n) END")
    out = {"n_words": F.col("_n"), "word_chars": F.col("_chars"), "n_symbols": F.col("_symbols"),
           "n_upper": F.col("_upper"), "n_marks": F.col("_marks"), "n_dup_lines": F.col("_lines"), "n_repeat_words": covered}
    return places.select("doc_id", *more, *[c.cast("long").alias(n) for n, c in out.items()])


def _distance(mean: str, low: str) -> F.Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor's columns."""
    y: list[F.Column] = []
    for i in range(_D):
        rest = F.col(_V[i]) - F.col(f"{mean}{i}")
        for j in range(i):
            rest = rest - F.col(f"{low}{i}{j}") * y[j]
        y.append(rest / F.col(f"{low}{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _with_cholesky(fits: DataFrame) -> DataFrame:
    """Adds the Cholesky factor ``l<i><j>`` of the covariance ``s<i><j>``, one column at a time."""
    for j in range(_D):
        diagonal = F.col(f"s{j}{j}")
        for k in range(j):
            diagonal = diagonal - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        fits = fits.withColumn(f"l{j}{j}", F.sqrt(F.greatest(diagonal, F.lit(1e-12))))
        below = {}
        for i in range(j + 1, _D):
            rest = F.col(f"s{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            below[f"l{i}{j}"] = rest / F.col(f"l{j}{j}")
        if below:
            fits = fits.withColumns(below)
    det = sum((F.log(f"l{j}{j}") for j in range(1, _D)), F.log("l00")) * 2
    return fits.withColumn("det", det)


_MEAN = [f"m{i}" for i in range(_D)]
_COV = [f"s{i}{j}" for i in range(_D) for j in range(i + 1)]


def _moments(rows: DataFrame, scale: float, *by: str) -> DataFrame:
    """Mean and scaled covariance by the columns named, with the floors added to the diagonal."""
    sums = rows.groupBy(*by).agg(
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(_V)],
        *[F.covar_pop(_V[i], _V[j]).alias(f"c{i}{j}") for i in range(_D) for j in range(i + 1)])
    floors = [VECTOR[v][1] ** 2 for v in _V]
    return sums.select(*by, *_MEAN, *[(F.col(f"c{i}{j}") * scale + (floors[i] if i == j else 0.0)).alias(f"s{i}{j}")
                                      for i in range(_D) for j in range(i + 1)])


def _beside(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Rows with what ``fits`` has for their key; both sides are spread by the salt."""
    return rows.join(fits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"])


def _starts(rows: DataFrame) -> DataFrame:
    """Two estimates for each key to start from."""
    quartiles = rows.groupBy("key").agg(*[F.percentile_approx(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q{i}")
                                          for i, v in enumerate(_V)])
    plain = save(quartiles.select("key", *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(_D)], *[
        (((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) ** 2 + VECTOR[v][1] ** 2).alias(f"d{i}") for i, v in enumerate(_V)]), "mcd-medians")
    z = [(F.col(v) - F.col(f"m{i}")) / F.sqrt(f"d{i}") for i, v in enumerate(_V)]
    unit = _beside(rows, plain).select("key", *[c.alias(f"z{i}") for i, c in enumerate(z)]).withColumn(
        "_n", F.greatest(sum((F.col(f"z{i}") ** 2 for i in range(1, _D)), F.col("z0") ** 2), F.lit(1e-12)))
    signs = unit.groupBy("key").agg(*[(F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.col("_n")) * _D).alias(f"u{i}{j}")
                                      for i in range(_D) for j in range(i + 1)])
    both = plain.join(signs, "key")
    first = both.select("key", F.lit(0).alias("start"), *_MEAN, *[(F.col(f"d{i}") if i == j else F.lit(0.0)).alias(f"s{i}{j}")
                                                                for i in range(_D) for j in range(i + 1)])
    floors = [VECTOR[v][1] ** 2 for v in _V]
    second = both.select("key", F.lit(1).alias("start"), *_MEAN, *[
        (F.col(f"u{i}{j}") * F.sqrt(F.col(f"d{i}") * F.col(f"d{j}")) + (floors[i] if i == j else 0.0)).alias(f"s{i}{j}")
        for i in range(_D) for j in range(i + 1)])
    return first.unionByName(second)


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """``(key, n, m.., s.., det)`` from ``(key, salt, v1..)``: robust moments and the least log determinant of the core.
    Each step's result (two rows a key) is written to the shared folder, so plans stay short and nothing is redone; one
    number a step reaches the driver."""
    fits = save(_with_cholesky(_starts(rows)), "mcd-start")
    core = chi2_quantile(CORE, _D)
    scale = CORE / chi2_below(core, _D + 2)
    for step in range(steps):
        placed = _beside(rows, fits).select("key", "start", "salt", *_V, _distance("m", "l").alias("d2"))
        at = save(placed.groupBy("key", "start").agg(F.percentile_approx("d2", CORE, 1000).alias("at")), f"mcd-at{step}")
        near = placed.join(at.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "start", "salt"]).where("d2 <= at")
        new = save(_with_cholesky(_moments(near, scale, "key", "start")), f"mcd-step{step}")
        fall = new.join(fits.select("key", "start", F.col("det").alias("before")), ["key", "start"]).agg(F.max(F.col("before") - F.col("det"))).first()[0]
        fits = new
        if step and (fall is None or fall < FALL):
            break
    least = fits.groupBy("key").agg(F.min_by(F.struct(*[c for c in fits.columns if c != "key"]), F.struct("det", "start")).alias("x")).select("key", "x.*")
    least = save(least, "mcd-least")
    # reweighting: all rows that the core's estimate doesn't find unusual
    usual = _beside(rows, least).where(_distance("m", "l") <= chi2_quantile(0.975, _D)).select("key", *_V)
    last = _moments(usual, 1.0, "key").join(least.select("key", "det"), "key")
    return save(last.join(rows.groupBy("key").agg(F.count("*").alias("n")), "key"), "mcd-last")


def _mixed(near: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """Moments of ``near`` (with a column ``key`` that names a row of ``wide``), of which ``PRIOR`` rows are ``wide``'s."""
    w = F.col("n") / (F.col("n") + PRIOR)
    far = wide.select(F.col("key").alias(key), *[F.col(c).alias(f"far_{c}") for c in (*_MEAN, *_COV)])
    gap = [F.col(m) - F.col(f"far_{m}") for m in _MEAN]
    means = [(w * F.col(m) + (1 - w) * F.col(f"far_{m}")).alias(m) for m in _MEAN]
    covs = [(w * F.col(f"s{i}{j}") + (1 - w) * F.col(f"far_s{i}{j}") + w * (1 - w) * gap[i] * gap[j]).alias(f"s{i}{j}")
            for i in range(_D) for j in range(i + 1)]
    return near.join(far, key).select("key", "n", *means, *covs)


def judged(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance)``."""
    group = F.struct(F.col("lang").cast("string").alias("l"), F.col("source").cast("string").alias("s"))
    counts = text_counts(docs.withColumns({"_group": group}).select("doc_id", "text", "_group"), "_group")
    base = counts.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    g, lang = "concat('g', to_json(_group))", "concat('l', coalesce(to_json(named_struct('l', _group.l)), ''))"
    rows = save(base.withColumns({v: F.expr(e) for v, (e, _) in VECTOR.items()}).withColumns({
        "key": F.expr(g), "lang_key": F.expr(lang), "salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")}).drop("_group"), "mcd-rows")
    passed = rows.where(~F.col("base_failed"))
    levels = passed.select(F.explode(F.array("key", "lang_key", F.lit("all"))).alias("key"), "salt", *_V)
    found = estimates(levels)
    every = found.where("key = 'all'")
    langs = save(_mixed(found.where("key LIKE 'l%'").withColumn("wide", F.lit("all")), every, "wide"), "mcd-languages")
    of = passed.select("key", F.col("lang_key").alias("wide")).distinct()
    fits = save(_with_cholesky(_mixed(found.where("key LIKE 'g%'").join(of, "key"), langs, "wide")).drop("n"), "mcd-groups")
    cutoff = chi2_quantile(1 - tail, _D)
    salted = fits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (rows.join(salted, ["key", "salt"], "left")
            .withColumn("distance", _distance("m", "l"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"), "distance"))
