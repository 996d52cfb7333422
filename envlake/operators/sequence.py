"""Per-station sequence operators that never put a whole station into one task.

The reference keeps its state per process: a reading counter, the previous reading and a
list of the last five CPU temperatures. On a fleet lake that state belongs to a
(station, boot) group, and one group may hold a large share of all rows. A plain
``Window.partitionBy(station, boot)`` would sort that group in a single task.

Instead each group is cut into time chunks (default one hour). Every window runs per
(group, chunk), which is bounded by the reading rate, and a small chunk-level table
(one row per chunk, ~720x smaller than the data at a 5 s cadence) carries what crosses
chunk edges: row offsets (prefix sums of chunk counts), the last timestamp of the
previous chunk and the last ``depth-1`` values of the previous chunks. That table is
joined back on (group, chunk); the big side is already partitioned on those keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envlake.session import materialise

DEFAULT_CHUNK_SECONDS = 3600
DEFAULT_BLOCK_CHUNKS = 1024
_UNB = Window.unboundedPreceding


def _last_k(arr: Column, k: int) -> Column:
    """The last ``k`` elements of an array (all of it when shorter)."""
    return F.slice(arr, F.greatest(F.size(arr) - (k - 1), F.lit(1)), k)


def _concat_lags(col: str, w: Window, k: int, empty: Column) -> Column:
    """Concatenation of ``lag(col, k) .. lag(col, 1)`` (oldest first), NULLs as empty."""
    return F.concat(*[F.coalesce(F.lag(col, j).over(w), empty) for j in range(k, 0, -1)])


def _carry_chunks(g: DataFrame, K: list[str], depth: int | None, block_chunks: int,
                  vtype: str | None) -> tuple[DataFrame, list[str]]:
    """Carry chunk summaries across chunk edges in two levels.

    Windows over chunks run per (group, block of ``block_chunks`` chunks); a block-level
    table (``block_chunks`` x smaller again) is windowed per group. So the largest
    single-task sort is a group's number of blocks, not its number of chunks or rows.

    Input columns: ``__sq_n``, ``__sq_first_ts``, ``__sq_last_ts`` and, with ``depth``,
    ``__sq_n_ok``, ``__sq_head`` (first kept value) and ``__sq_t1..t{depth-1}`` (last
    values, t1 newest). Output adds ``__sq_rn_off``, ``__sq_prev_last_ts``,
    ``__sq_grp_first_ts`` and, with ``depth``, ``__sq_prev_tail`` (last ``depth-1``
    kept values before the chunk, oldest first) and ``__sq_grp_first_val``.
    """
    if block_chunks < 1:
        raise ValueError("block_chunks must be >= 1")
    blk = F.floor(F.col("__sq_chunk") / F.lit(block_chunks)).cast("long")
    g = g.withColumn("__sq_blk", blk)
    WA = Window.partitionBy(*K, "__sq_blk").orderBy("__sq_chunk")
    g = (g.withColumn("__sq_a_off", F.coalesce(F.sum("__sq_n").over(WA.rowsBetween(_UNB, -1)), F.lit(0)))
          .withColumn("__sq_a_prev_last", F.lag("__sq_last_ts").over(WA)))
    baggs = [F.sum("__sq_n").alias("__sq_nb"), F.max("__sq_last_ts").alias("__sq_lb"),
             F.min("__sq_first_ts").alias("__sq_fb")]
    k = (depth or 1) - 1
    if depth is not None:
        empty = F.array().cast(f"array<{vtype}>")
        tail = F.filter(F.array(*[F.col(f"__sq_t{j}") for j in range(k, 0, -1)]), lambda x: x.isNotNull()) \
            if k else empty
        g = g.withColumn("__sq_has_ok", F.col("__sq_n_ok") > 0).withColumn("__sq_tail", tail)
        WA2 = Window.partitionBy(*K, "__sq_blk", "__sq_has_ok").orderBy("__sq_chunk")
        g = g.withColumn("__sq_prev_local", _last_k(_concat_lags("__sq_tail", WA2, k, empty), k) if k else empty)
        g = g.withColumn("__sq_cum_tail", _last_k(F.concat("__sq_prev_local", "__sq_tail"), k) if k else empty)
        baggs += [F.sum("__sq_n_ok").alias("__sq_nb_ok"),
                  F.max_by("__sq_cum_tail", F.when(F.col("__sq_has_ok"), F.col("__sq_chunk"))).alias("__sq_btail"),
                  F.min_by("__sq_head", F.when(F.col("__sq_head").isNotNull(), F.col("__sq_chunk")))
                   .alias("__sq_bhead")]
    b = g.groupBy(*K, "__sq_blk").agg(*baggs)
    WB = Window.partitionBy(*K).orderBy("__sq_blk")
    b = (b.withColumn("__sq_b_off", F.coalesce(F.sum("__sq_nb").over(WB.rowsBetween(_UNB, -1)), F.lit(0)))
          .withColumn("__sq_b_prev_last", F.lag("__sq_lb").over(WB))
          .withColumn("__sq_grp_first_ts", F.first("__sq_fb").over(WB.rowsBetween(_UNB, 0))))
    bcols = ["__sq_b_off", "__sq_b_prev_last", "__sq_grp_first_ts"]
    if depth is not None:
        WB2 = Window.partitionBy(*K, "__sq_b_has_ok").orderBy("__sq_blk")
        b = (b.withColumn("__sq_b_has_ok", F.col("__sq_nb_ok") > 0)
              .withColumn("__sq_b_prev_tail", _last_k(_concat_lags("__sq_btail", WB2, k, empty), k) if k else empty)
              .withColumn("__sq_grp_first_val", F.first("__sq_bhead", ignorenulls=True)
                          .over(WB.rowsBetween(_UNB, 0))))
        bcols += ["__sq_b_prev_tail", "__sq_grp_first_val"]
    g = g.join(b.select(*K, "__sq_blk", *bcols), on=[*K, "__sq_blk"], how="left")
    g = (g.withColumn("__sq_rn_off", F.col("__sq_b_off") + F.col("__sq_a_off"))
          .withColumn("__sq_prev_last_ts", F.coalesce("__sq_a_prev_last", "__sq_b_prev_last")))
    carry = ["__sq_rn_off", "__sq_prev_last_ts", "__sq_grp_first_ts"]
    if depth is not None:
        g = g.withColumn("__sq_prev_tail", _last_k(F.concat(F.coalesce("__sq_b_prev_tail", empty),
                                                             "__sq_prev_local"), k) if k else empty)
        carry += ["__sq_prev_tail", "__sq_grp_first_val"]
    return g, carry


def _chunk_col(ts: str, chunk_seconds: int) -> Column:
    if chunk_seconds < 1:
        raise ValueError("chunk_seconds must be >= 1")
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    # integer floor division (pmod keeps pre-1970 instants in the right chunk)
    n = F.lit(chunk_seconds * 1_000_000)
    # a chunk of their own for rows without a timestamp: chunk numbers are join keys
    return F.coalesce(((us - F.pmod(us, n)) / n).cast("long"), F.lit(-(1 << 40)))


def sequence_features(df: DataFrame, keys: Sequence[str] = ("station", "boot_id"),
                      ts: str = "timestamp", tiebreak: str = "event_id",
                      value_col: str | None = None, ok_col: str | None = None,
                      depth: int = 5, chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
                      block_chunks: int = DEFAULT_BLOCK_CHUNKS) -> DataFrame:
    """Add per-group sequence columns, ordered by (ts, tiebreak) within ``keys``.

    * ``seq_rn``       1-based position of the row in its group
    * ``seq_prev_ts``  timestamp of the previous row of the group (NULL for the first)
    * ``seq_first_ts`` timestamp of the group's first row
    * ``seq_roll_mean`` (when ``value_col`` is given) mean of the last ``depth`` values
      among the group's rows where ``ok_col`` is true, the window pre-filled with copies
      of the first such value; NULL on rows where ``ok_col`` is not true. Values are
      summed oldest first, as ``sum(list)`` does.

    Keys and timestamps may be NULL: NULL keys are a group like any other, rows without a
    timestamp come first in theirs. The windowed rows feed both the chunk summary and the
    output, so the input is scanned and shuffled twice; the chunk table itself is written
    once to the shared folder.
    """
    K = ["__sq_g"]
    df_types = dict(df.dtypes)
    df = df.withColumn("__sq_g", F.struct(*keys))
    # One shuffle on (group, chunk) serves both windows, the chunk aggregate and the
    # join back; without it Spark may hash on (group, chunk, ok) and shuffle again.
    d = df.withColumn("__sq_chunk", _chunk_col(ts, chunk_seconds)).repartition(*K, "__sq_chunk")
    wc = Window.partitionBy(*K, "__sq_chunk").orderBy(ts, tiebreak)
    d = (d.withColumn("__sq_rn_c", F.row_number().over(wc))
          .withColumn("__sq_lag_ts_c", F.lag(ts).over(wc)))
    aggs = [F.count(F.lit(1)).alias("__sq_n"), F.max(ts).alias("__sq_last_ts"),
            F.min(ts).alias("__sq_first_ts")]
    lags = list(range(1, depth))
    if value_col is not None:
        if depth < 1:
            raise ValueError("depth must be >= 1")
        ok = F.coalesce(F.col(ok_col), F.lit(False)) if ok_col else F.lit(True)
        d = d.withColumn("__sq_ok", ok)
        wok = Window.partitionBy(*K, "__sq_chunk", "__sq_ok").orderBy(ts, tiebreak)
        d = (d.withColumn("__sq_p", F.row_number().over(wok))
              .withColumn("__sq_n_same", F.count(F.lit(1)).over(
                  Window.partitionBy(*K, "__sq_chunk", "__sq_ok"))))
        for k in lags:
            d = d.withColumn(f"__sq_lag{k}", F.lag(value_col, k).over(wok))
        rev = F.col("__sq_n_same") - F.col("__sq_p") + 1
        aggs += [F.max(F.when(F.col("__sq_ok") & (F.col("__sq_p") == 1), F.col(value_col))).alias("__sq_head"),
                 F.sum(F.col("__sq_ok").cast("int")).alias("__sq_n_ok")]
        aggs += [F.max(F.when(F.col("__sq_ok") & (rev == j), F.col(value_col))).alias(f"__sq_t{j}")
                 for j in lags]

    # Chunk-level table: one row per (group, chunk), then carried across chunks. It has
    # several consumers (block table, two window levels, joins) and Spark does not share
    # sub-plans, so it is written once (it is ~chunk-size times smaller than the data).
    g = materialise(d.groupBy(*K, "__sq_chunk").agg(*aggs), "chunks")
    g, carry = _carry_chunks(g, K, depth if value_col is not None else None, block_chunks,
                             df_types.get(value_col) if value_col else None)

    out = d.join(g.select(*K, "__sq_chunk", *carry), on=[*K, "__sq_chunk"], how="left")
    out = (out.withColumn("seq_rn", (F.col("__sq_rn_off") + F.col("__sq_rn_c")).cast("long"))
              .withColumn("seq_prev_ts", F.when(F.col("__sq_rn_c") > 1, F.col("__sq_lag_ts_c"))
                          .otherwise(F.col("__sq_prev_last_ts")))
              .withColumn("seq_first_ts", F.col("__sq_grp_first_ts")))
    if value_col is not None:
        p = F.col("__sq_p")
        sz = F.size("__sq_prev_tail")
        acc = None
        for k in reversed(lags):  # oldest first
            j = F.lit(k) - p + 1
            vk = (F.when(p > k, F.col(f"__sq_lag{k}"))
                  .when(j <= sz, F.element_at("__sq_prev_tail", (sz - j + 1).cast("int")))
                  .otherwise(F.col("__sq_grp_first_val")))
            acc = vk if acc is None else acc + vk
        acc = F.col(value_col) if acc is None else acc + F.col(value_col)
        out = out.withColumn("seq_roll_mean", F.when(F.col("__sq_ok"), acc / F.lit(depth)))
    drop = [c for c in out.columns if c.startswith("__sq_")]
    return out.drop(*drop)


def gap_sessions(df: DataFrame, keys: Sequence[str] = ("station",), ts: str = "timestamp",
                 tiebreak: str = "event_id", gap_minutes: float = 90,
                 chunk_seconds: int = DEFAULT_CHUNK_SECONDS, out_col: str = "session_id",
                 block_chunks: int = DEFAULT_BLOCK_CHUNKS) -> DataFrame:
    """Gaps-and-islands: a new session starts at a group's first row and after any gap of
    more than ``gap_minutes`` between consecutive rows. ``session_id`` counts from 1 per
    group. Uses the same chunk / block prefix sums as :func:`sequence_features`.
    """
    if block_chunks < 1:
        raise ValueError("block_chunks must be >= 1")
    K = ["__sq_g"]
    df = df.withColumn("__sq_g", F.struct(*keys))
    gap_us = F.lit(int(gap_minutes * 60_000_000))
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    d = (df.withColumn("__sq_chunk", _chunk_col(ts, chunk_seconds)).withColumn("__sq_us", us)
         .repartition(*K, "__sq_chunk"))
    wc = Window.partitionBy(*K, "__sq_chunk").orderBy(ts, tiebreak)
    lag_us = F.lag("__sq_us").over(wc)
    d = d.withColumn("__sq_flag_in", F.when(lag_us.isNotNull() & ((F.col("__sq_us") - lag_us) > gap_us), 1)
                     .otherwise(0))
    d = d.withColumn("__sq_cum_in", F.sum("__sq_flag_in").over(wc.rowsBetween(_UNB, 0)))
    # the chunk table feeds two block passes and two joins: write it once (small)
    g = materialise(d.groupBy(*K, "__sq_chunk")
         .agg(F.min("__sq_us").alias("__sq_first_us"), F.max("__sq_us").alias("__sq_last_us"),
              F.sum("__sq_flag_in").alias("__sq_n_in"))
         .withColumn("__sq_blk", F.floor(F.col("__sq_chunk") / F.lit(block_chunks)).cast("long")), "chunks")
    WA = Window.partitionBy(*K, "__sq_blk").orderBy("__sq_chunk")
    WB = Window.partitionBy(*K).orderBy("__sq_blk")
    # previous chunk's last reading: within the block, else the previous block's last
    g = g.withColumn("__sq_a_prev", F.lag("__sq_last_us").over(WA))
    b1 = (g.groupBy(*K, "__sq_blk").agg(F.max("__sq_last_us").alias("__sq_lb"))
          .withColumn("__sq_b_prev", F.lag("__sq_lb").over(WB)))
    g = g.join(b1.select(*K, "__sq_blk", "__sq_b_prev"), on=[*K, "__sq_blk"], how="left")
    prev = F.coalesce("__sq_a_prev", "__sq_b_prev")
    g = g.withColumn("__sq_first_flag", F.when(prev.isNull() | ((F.col("__sq_first_us") - prev) > gap_us), 1)
                     .otherwise(0))
    g = g.withColumn("__sq_new", F.col("__sq_n_in") + F.col("__sq_first_flag"))
    g = g.withColumn("__sq_a_off", F.coalesce(F.sum("__sq_new").over(WA.rowsBetween(_UNB, -1)), F.lit(0)))
    b2 = (g.groupBy(*K, "__sq_blk").agg(F.sum("__sq_new").alias("__sq_tot"))
          .withColumn("__sq_b_off", F.coalesce(F.sum("__sq_tot").over(WB.rowsBetween(_UNB, -1)), F.lit(0))))
    g = g.join(b2.select(*K, "__sq_blk", "__sq_b_off"), on=[*K, "__sq_blk"], how="left")
    g = g.withColumn("__sq_off", F.col("__sq_b_off") + F.col("__sq_a_off"))
    out = d.join(g.select(*K, "__sq_chunk", "__sq_first_flag", "__sq_off"), on=[*K, "__sq_chunk"], how="left")
    out = out.withColumn(out_col, (F.col("__sq_off") + F.col("__sq_first_flag") + F.col("__sq_cum_in"))
                         .cast("long"))
    return out.drop(*[c for c in out.columns if c.startswith("__sq_")])
