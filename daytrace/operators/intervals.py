"""Set operations on intervals: arbitration, unions, overlap sweeps, clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from daytrace.config import US, USER_DAY, Thresholds
from daytrace.operators.fold import fold_stream
from daytrace.operators.scan import chunked, scan


def arbitrate(sessions: DataFrame) -> DataFrame:
    """Where sessions of different browser families overlap, the later start wins and cuts the
    earlier one for good.  Families alternate in runs, so a session ends at the latest at the
    start of the next run.  Rows per user-day are bounded (see ``sessions``)."""
    w = Window.partitionBy(*USER_DAY).orderBy("start_us", "device_id")
    changed = F.lag("browser_family").over(w) != F.col("browser_family")
    df = sessions.withColumn("new", F.when(changed, 1).otherwise(0)).withColumn(
        "run", F.sum("new").over(w)
    )
    after = w.orderBy(F.col("start_us").desc(), F.col("device_id").desc())
    # start of the first session of the next run
    head = F.when(F.col("new") == 1, F.col("start_us"))
    next_start = F.last(head, True).over(after.rowsBetween(Window.unboundedPreceding, -1))
    return (
        df.withColumn("next_start", next_start)
        .withColumn("cut", F.coalesce(F.col("end_us") > F.col("next_start"), F.lit(False)))
        .withColumn("end_us", F.least("end_us", "next_start"))
        .withColumn("truncated", F.col("truncated") | F.col("cut"))
        .filter("end_us > start_us")
        .drop("new", "run", "next_start", "cut")
    )


def union_length(df: DataFrame, keys: list[str], th: Thresholds) -> DataFrame:
    """Length of the union of intervals per key."""
    df = df.groupBy(*keys, "start_us").agg(F.max("end_us").alias("end_us"))
    df = chunked(df, keys, "start_us", th.chunk_s * US)
    df = scan(df, keys, ["start_us"], reach=("max_before", F.col("end_us")))
    fresh = F.col("end_us") - F.greatest("start_us", F.coalesce("reach", "start_us"))
    return df.groupBy(*keys).agg(F.sum(F.greatest(fresh, F.lit(0))).alias("union_us"))


def overlap_sweep(spans: DataFrame, keys: list[str], th: Thresholds) -> DataFrame:
    """Time with at least one and with at least two active spans per key."""
    edges = F.explode(
        F.array(
            F.struct(F.col("start_us").alias("at"), F.lit(1).alias("d")),
            F.struct(F.col("end_us").alias("at"), F.lit(-1).alias("d")),
        )
    ).alias("e")
    df = (
        spans.filter("end_us > start_us")
        .select(*keys, edges)
        .groupBy(*keys, F.col("e.at").alias("at"))
        .agg(F.sum("e.d").alias("d"))
    )
    df = chunked(df, keys, "at", th.chunk_s * US)
    df = scan(df, keys, ["at"], active=("sum", F.col("d")), next_at=("lead", F.col("at")))
    span = F.coalesce(F.col("next_at") - F.col("at"), F.lit(0))
    return df.groupBy(*keys).agg(
        F.sum(F.when(F.col("active") >= 1, span).otherwise(0)).alias("observed_us"),
        F.sum(F.when(F.col("active") >= 2, span).otherwise(0)).alias("dual_us"),
    )


class _Frontier:
    """The clusters of one category that a later session can still join, in the order of their numbers.

    Whether a session fits needs two facts of a cluster: its latest end, and the latest end on any
    device but that one's.  A cluster whose latest end lies more than the gap back is closed for good.
    A session opens a cluster only if no open one has a fitting member on another device, so the open
    ones that would not take the next session are those of a single device.
    """

    def __init__(self) -> None:
        self.island = 0  # start of the first session since the frontier was last empty
        self.count = 0
        self.open: list[list] = []  # [number, latest end, its device, latest end elsewhere or None]

    def place(self, gap: int, device: int, start: int, end: int) -> tuple[int, int]:
        self.open = [c for c in self.open if c[1] >= start - gap]
        if not self.open:
            self.island, self.count = start, 0
        ends = ((c, c[1] if c[2] != device else c[3]) for c in self.open)
        home = next((c for c, e in ends if e is not None and e >= start - gap), None)
        if home is None:
            self.open.append([self.count, end, device, None])
            self.count += 1
            return self.island, self.count - 1
        _, latest, on, elsewhere = home
        if device == on:
            home[1] = max(latest, end)
        elif end > latest:
            home[1:] = [end, device, latest]
        else:
            home[3] = end if elsewhere is None else max(elsewhere, end)
        return self.island, home[0]


def cluster_cross_device(classified: DataFrame, th: Thresholds) -> DataFrame:
    """Add ``island`` and ``cluster`` to classified sessions: same category on different devices,
    overlapping or nearly touching.

    Sessions of a (user, day, category) are taken in order; each joins the first cluster with a member
    on another device that overlaps it or ended at most the gap before.  A session that starts more than
    the gap after everything before it begins an island, and numbers start anew.  A task keeps the open
    clusters only.
    """
    gap = th.cluster_gap_s * US
    return fold_stream(
        classified,
        [*USER_DAY, "category"],
        ["start_us", "device_id"],
        ["device_id", "start_us", "end_us"],
        _Frontier,
        lambda frontier, *row: frontier.place(gap, *row),
        "island long, cluster long",
    )


def activities(clustered: DataFrame) -> DataFrame:
    """One row per cluster: span, union length, weighted confidence, dominant member."""
    key = [*USER_DAY, "category", "island", "cluster"]
    length = F.col("end_us") - F.col("start_us")
    w = Window.partitionBy(*key).orderBy("start_us", "device_id")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = clustered.withColumn("len_us", length).withColumn(
        "fresh_us",
        F.greatest(F.col("end_us") - F.greatest("start_us", F.coalesce(reach, "start_us")), F.lit(0)),
    )
    member = F.struct("start_us", "device_id", "session_id")
    # longest member first; the earliest of equal ones
    rank = F.struct("len_us", -F.col("start_us"), -F.col("device_id"))
    total = F.sum("len_us")
    weighted = F.sum(F.rint(F.col("confidence") * F.col("len_us")).cast("long"))
    return (
        df.groupBy(*key)
        .agg(
            F.min("start_us").alias("start_us"),
            F.max("end_us").alias("end_us"),
            F.sum("fresh_us").alias("duration_us"),
            F.when(F.count(F.lit(1)) == 1, F.max("confidence"))
            .when(total > 0, weighted / total)
            .otherwise(F.lit(0.0))
            .alias("confidence"),
            F.count(F.lit(1)).alias("members"),
            F.count_distinct("device_id").alias("devices"),
            F.max_by(F.struct("source", "evidence", "session_id"), rank).alias("d"),
            F.transform(F.array_sort(F.collect_list(member)), lambda m: m["session_id"]).alias(
                "session_ids"
            ),
            F.min(F.when(F.col("platform") == "android", F.col("app_key"))).alias("app_key"),
        )
        .select(
            *USER_DAY,
            "category",
            "start_us",
            "end_us",
            "duration_us",
            "confidence",
            "members",
            "devices",
            (F.col("devices") > 1).alias("is_cross_device"),
            F.col("d.source").alias("source"),
            F.col("d.evidence").alias("evidence"),
            F.col("d.session_id").alias("dominant_id"),
            F.array_remove("session_ids", F.col("d.session_id")).alias("other_ids"),
            "session_ids",
            "app_key",
            F.concat_ws(":", "user_id", "category", "start_us", "d.session_id").alias(
                "activity_id"
            ),
        )
    )
