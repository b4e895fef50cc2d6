"""Browser focus attribution: signals to domain focus events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrace.config import US, Thresholds
from daytrace.operators.scan import CHUNK, chunked, scan

KEYS = ["user_id", "device_id"]


def signals(browser_events: DataFrame) -> DataFrame:
    """Signals of the sample: tab changes, window focus, idle state, heartbeats."""
    e, k = F.col("event_type"), F.col("k")
    return browser_events.select(
        *KEYS,
        "us",
        "seq",
        F.when(e == "view", "tab").when(e == "click", "focus").when(e == "signup", "idle")
        .otherwise("heartbeat").alias("kind"),
        F.when(e == "view", F.col("key")).alias("domain"),
        F.when(e == "click", k < 70).alias("focused"),
        F.when(e == "signup", k < 80).alias("active"),
    )


def attribute(sig: DataFrame, th: Thresholds, wake_bound_us: int | None = None) -> DataFrame:
    """DOMAIN_FOCUS_START / END whenever "a domain, focused window, active user" changes.

    With ``wake_bound_us`` a longer silence closes the open domain at the last signal before it
    and forgets the state.
    """
    df = chunked(sig, KEYS, "us", th.chunk_s * US)
    values = {
        "domain": F.when(F.col("kind") == "tab", F.coalesce("domain", F.lit(""))),
        "focused": F.when(F.col("kind") == "focus", F.col("focused")),
        "active": F.when(F.col("kind") == "idle", F.col("active")),
    }
    specs = {"prev_us": ("before", F.col("us")), "next_us": ("lead", F.col("us"))}
    for n, v in values.items():
        at = F.when(v.isNotNull(), F.struct("us", "seq", v.alias("v")))
        specs[f"now_{n}"] = ("last", at)
        specs[f"was_{n}"] = ("before", at)
    # an island is a stretch without a silence that forgets the state
    awake = (lambda p, r: F.lit(True)) if wake_bound_us is None else (
        lambda p, r: r["us"] - p["us"] <= wake_bound_us
    )
    df = scan(df, KEYS, ["us", "seq"], joins=awake, **specs).drop(CHUNK)
    fresh = (F.col("island.us") == F.col("us")) & (F.col("island.seq") == F.col("seq"))
    for n in values:
        now, was = F.col(f"now_{n}"), F.col(f"was_{n}")
        known = F.struct(now["us"], now["seq"]) >= F.struct("island.us", "island.seq")
        known_was = ~fresh & (F.struct(was["us"], was["seq"]) >= F.struct("island.us", "island.seq"))
        df = df.withColumns({f"now_{n}": F.when(known, now["v"]), f"was_{n}": F.when(known_was, was["v"])})
    slept = F.lit(False) if wake_bound_us is None else F.coalesce(
        F.col("next_us") - F.col("us") > wake_bound_us, F.lit(False)
    )

    def on(t: str):
        return (
            (F.coalesce(f"{t}_domain", F.lit("")) != "")
            & F.coalesce(f"{t}_focused", F.lit(False))
            & F.coalesce(f"{t}_active", F.lit(True))
        )

    moved = F.coalesce("was_domain", F.lit("")) != F.coalesce("now_domain", F.lit(""))
    end = F.when(
        on("was") & (~on("now") | moved),
        F.struct(F.lit("DOMAIN_FOCUS_END").alias("type"), F.col("was_domain").alias("domain")),
    )
    start = F.when(
        on("now") & (~on("was") | moved),
        F.struct(F.lit("DOMAIN_FOCUS_START").alias("type"), F.col("now_domain").alias("domain")),
    )
    # a long silence after the row ends what is on
    cut = F.when(
        slept & on("now"),
        F.struct(F.lit("DOMAIN_FOCUS_END").alias("type"), F.col("now_domain").alias("domain")),
    )
    return df.select(*KEYS, "us", F.explode(F.array_compact(F.array(end, start, cut))).alias("e")).select(
        *KEYS, "us", "e.type", "e.domain"
    )
