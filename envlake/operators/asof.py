"""As-of join: each left row with the last right row at or before its time.

Neither side's group has to fit one task. Both sides are cut into time chunks per group; inside a chunk a
window carries the last right row forward, and a table of one row per (group, chunk) - the chunk's last
right row, if any - carries it across chunk edges. That table is windowed per group, so the largest
single-task sort is a group's number of chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envlake.operators.sequence import _chunk_col
from envlake.session import materialise

_DAY = 86_400


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str],
              strict: bool = False, tiebreak: Sequence[str] = (), chunk_seconds: int = _DAY, prefix: str = "") -> DataFrame:
    """All rows and columns of ``left`` with ``values`` of the right row that has the same ``by`` and the
    greatest ``right_ts`` not after ``left_ts`` (before it, if ``strict``); NULLs where there is none.

    Of right rows with one time the greatest ``tiebreak`` (then values) counts. NULL keys are a key like any
    other; right rows without a time never match, left rows without one match nothing. ``prefix`` is put
    before the new names.
    """
    lefts = left.select(F.struct(*by).alias("_g"), F.col(left_ts).cast("timestamp").alias("_t"), F.lit(0 if strict else 1).alias("_side"),
                        F.struct(*left.columns).alias("_row"))
    found = F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate((right_ts, *tiebreak, *values))])  # in the order that decides
    own = len(tiebreak) + 1
    rights = right.where(F.col(right_ts).isNotNull()).select(F.struct(*by).alias("_g"), F.col(right_ts).cast("timestamp").alias("_t"),
                                                            F.lit(0.5).alias("_side"), found.alias("_found"))
    both = (lefts.withColumn("_side", F.col("_side").cast("double")).unionByName(rights.withColumn("_side", F.col("_side").cast("double")), allowMissingColumns=True)
            .withColumn("_chunk", _chunk_col("_t", chunk_seconds)).repartition("_g", "_chunk"))
    inside = Window.partitionBy("_g", "_chunk").orderBy("_t", "_side", "_found").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_last", F.last("_found", ignorenulls=True).over(inside))
    # one row per (group, chunk); rights that are the chunk's last, then carried over empty chunks
    chunks = materialise(both.groupBy("_g", "_chunk").agg(F.max("_found").alias("_end")), "asof-chunks")
    before = Window.partitionBy("_g").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).select("_g", "_chunk", "_before")
    out = both.where(F.col("_row").isNotNull()).join(carried, ["_g", "_chunk"], "left")
    got = F.when(F.col("_t").isNotNull(), F.coalesce("_last", "_before"))
    return out.withColumn("_got", got).select("_row.*", *[F.col(f"_got._{own + k}").alias(prefix + c) for k, c in enumerate(values)])


def uptime_boots(health: DataFrame, by: Sequence[str] = ("station",), ts: str = "timestamp", uptime: str = "uptime_seconds",
                 tiebreak: str = "event_id") -> DataFrame:
    """``(*by, boot_start, boot_no)``: one row for each start of a device, from its health records. A record whose
    uptime is less than the one before it (or the first with an uptime) is the first of a boot, which began
    ``uptime`` seconds before the record. Records without a time or an uptime tell nothing."""
    known = health.where(F.col(ts).isNotNull() & F.col(uptime).isNotNull()).select(*by, ts, tiebreak, uptime)
    # the record before this one: strictly before by (time, tiebreak)
    order = known.withColumn("_at", F.timestamp_micros(F.unix_micros(ts)))
    seen = asof_join(order, order, by, "_at", "_at", [uptime], strict=True, tiebreak=(tiebreak,), prefix="before_")
    first = seen.where(F.col(f"before_{uptime}").isNull() | (F.col(uptime) < F.col(f"before_{uptime}")))
    start = F.timestamp_micros(F.unix_micros(ts) - F.round(F.col(uptime) * 1_000_000).cast("long"))
    boots = first.select(*by, start.alias("boot_start")).distinct()
    # numbered per device: as many rows as it had boots
    return boots.withColumn("boot_no", F.row_number().over(Window.partitionBy(F.struct(*by)).orderBy("boot_start")).cast("long"))


def sessions_from_uptime(readings: DataFrame, health: DataFrame, by: Sequence[str] = ("station",), ts: str = "timestamp",
                         uptime: str = "uptime_seconds") -> DataFrame:
    """Readings with ``boot_start`` and ``boot_no`` of the boot that they were taken in, where no boot id was
    recorded; NULL before the first known boot. Needs no gap between boots."""
    boots = materialise(uptime_boots(health, by, ts, uptime), "boots")
    return asof_join(readings, boots, by, ts, "boot_start", ["boot_start", "boot_no"])
