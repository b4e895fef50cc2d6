"""Classification of sessions, and what corrections do to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from daytrace.catalog import WORK_LIKE
from daytrace.config import DEVICE_DAY, US, Thresholds
from daytrace.operators.fold import fold_groups

UNKNOWN = "unknown"


def with_priors(
    sessions: DataFrame, seeds: DataFrame, rules: DataFrame | None, learned: DataFrame | None
) -> DataFrame:
    """Attach user rule, learned prior and seed prior.  Small sides are left to the optimiser;
    rules and learned priors grow with the users and are left to the optimiser."""
    df = sessions.join(seeds, "app_key", "left")
    if rules is not None:
        df = df.join(rules, ["user_id", "app_key"], "left")
    else:
        df = df.withColumn("rule_category", F.lit(None).cast("string"))
    if learned is not None:
        return df.join(learned, ["user_id", "app_key"], "left")
    return df.withColumns(
        {
            "learned_category": F.lit(None).cast("string"),
            "learned_conf": F.lit(None).cast("double"),
            "samples": F.lit(None).cast("int"),
        }
    )


def with_domain_priors(sessions: DataFrame, seeds: DataFrame) -> DataFrame:
    """Attach seed priors to sessions whose ``app_key`` is a host: that of the longest run of its last labels
    that ``seeds`` lists, so ``a.docs.google.com`` goes by ``docs.google.com`` before ``google.com``.

    Case, white space around and a last dot do not matter.  Hosts are made distinct first and looked
    up once each, by one equality join; a host under none of the entries, an empty or null one has no prior.
    """
    clean = lambda c: F.rtrim(F.lower(F.trim(c)), F.lit("."))
    hosts = sessions.select(F.col("app_key").alias("_host")).where("_host is not null").distinct()
    labels = F.split(clean(F.col("_host")), r"\.")
    n = F.size(labels)
    ways = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(labels, n - i + 1, i), ".").alias("name"))
    )
    walked = hosts.select("_host", F.explode(ways).alias("_way")).select("_host", "_way.depth", "_way.name")
    listed = seeds.groupBy(clean(F.col("app_key")).alias("name")).agg(
        F.max(F.struct("seed_conf", "seed_category")).alias("_seed")
    )
    met = walked.join(listed.where("name <> ''"), "name")
    best = met.groupBy("_host").agg(F.max_by("_seed", "depth").alias("_seed")).select(
        "_host", F.col("_seed.seed_category").alias("seed_category"), F.col("_seed.seed_conf").alias("seed_conf")
    )
    df = sessions.join(best, F.col("app_key") == F.col("_host"), "left").drop("_host")
    return df.withColumns(
        {
            "rule_category": F.lit(None).cast("string"),
            "learned_category": F.lit(None).cast("string"),
            "learned_conf": F.lit(None).cast("double"),
            "samples": F.lit(None).cast("int"),
        }
    )


def classify(df: DataFrame, th: Thresholds, followed: Column | None = None) -> DataFrame:
    """First confident layer wins: rule, learned prior, seed prior (media followed by work
    counts as learning), else unknown.  ``followed`` flags sessions followed by work."""
    followed = F.lit(False) if followed is None else F.coalesce(followed, F.lit(False))
    by_rule = F.col("rule_category").isNotNull()
    by_learned = ~by_rule & (F.coalesce("samples", F.lit(0)) >= th.learned_min_samples)
    no_seed = F.col("seed_category").isNull()
    lifted = followed & (F.col("seed_category") == "entertainment")
    seed_conf = F.when(lifted, th.followed_confidence).otherwise(F.col("seed_conf"))
    low = seed_conf < th.confidence_floor

    def layer(rule, learned, none, below, context, seed):
        return (
            F.when(by_rule, rule)
            .when(by_learned, learned)
            .when(no_seed, none)
            .when(low, below)
            .when(lifted, context)
            .otherwise(seed)
        )

    # Evidence and source labels.
    ev = lambda *names: F.array(*[F.lit(n) for n in names])
    below = F.when(
        lifted, ev("l2_seed_catalogue", "l3_followed_by_development", "l4_below_floor")
    ).otherwise(ev("l2_seed_catalogue", "l4_below_floor"))
    return df.withColumns(
        {
            "category": layer(
                F.col("rule_category"), F.col("learned_category"), F.lit(UNKNOWN),
                F.lit(UNKNOWN), F.lit("learning"), F.col("seed_category"),
            ),
            "confidence": layer(
                F.lit(1.0), F.col("learned_conf"), F.lit(0.0), seed_conf, seed_conf, seed_conf
            ),
            "source": layer(
                F.lit("user"), F.lit("learned"), F.lit("unknown"), F.lit("unknown"),
                F.lit("context"), F.lit("seed"),
            ),
            "evidence": layer(
                ev("l0_user_rule"), ev("l1_learned_prior"), ev("l4_no_seed_entry"), below,
                ev("l2_seed_catalogue", "l3_followed_by_development"), ev("l2_seed_catalogue"),
            ),
        }
    ).drop(
        "rule_category", "learned_category", "learned_conf", "samples", "seed_category", "seed_conf"
    )


def _work_follows(rows, th: Thresholds) -> list[bool]:
    apps, media = rows["app_key"], rows["is_media"]
    work = [c in WORK_LIKE for c in rows["key_category"]]
    start, end = rows["start_us"], rows["end_us"]
    flags = []
    for i, is_media in enumerate(media):
        if not is_media:
            flags.append(False)
            continue
        near = {apps[j] for j in range(i + 1, min(i + 1 + th.followed_next, len(apps))) if work[j]}
        deadline, total, j = end[i] + th.followed_window_s * US, 0, i + 1
        while j < len(apps) and start[j] < deadline and apps[j] not in near:
            j += 1
        if j < len(apps) and start[j] < deadline:
            while j < len(apps) and apps[j] in near and total < th.followed_min_s * US:
                total += end[j] - start[j]
                j += 1
        flags.append(total >= th.followed_min_s * US)
    return flags


def followed_by_work(sessions: DataFrame, th: Thresholds) -> DataFrame:
    """Add ``followed``: media whose next work run starts soon and is long enough.  The run's apps are
    the work apps among the next ``followed_next`` sessions.

    Needs ``key_category`` (category from rule, learned prior or seed) and ``is_media``.  Only
    device-days with both media and work reach the ordered pass; a device-day holds at most
    day / min_session sessions, and a pass ends once enough work is found.
    """
    day = Window.partitionBy(*DEVICE_DAY)
    df = sessions.withColumn(
        "candidate",
        (F.max("is_media").over(day))
        & (F.max(F.col("key_category").isin(WORK_LIKE)).over(day)),
    )
    rest = df.filter(~F.col("candidate")).withColumn("followed", F.lit(False))
    done = fold_groups(
        df.filter("candidate"),
        DEVICE_DAY,
        ["start_us"],
        ["app_key", "key_category", "is_media", "start_us", "end_us"],
        lambda rows: {"followed": _work_follows(rows, th)},
        "followed boolean",
    )
    return rest.unionByName(done).drop("candidate")


def learned_prior_fold(corrections: DataFrame, th: Thresholds) -> DataFrame:
    """Learned prior per (user, app) after all corrections in time order.

    A contradicting correction starts anew, so only the newest run of one category counts.
    Inside it each step decays the samples by age and adds one; steps round half-even and
    cannot be reordered, so the run is streamed in order (constant state, nothing collected).
    """
    keys = ["user_id", "app_key"]
    newest = corrections.groupBy(*keys).agg(
        F.max_by("category", F.struct("us", "seq")).alias("last_category")
    )
    tagged = corrections.join(newest, keys)
    # newest correction that contradicts the final category; later rows form the last run
    cut = tagged.groupBy(*keys).agg(
        F.max(F.when(F.col("category") != F.col("last_category"), F.struct("us", "seq"))).alias(
            "cut"
        )
    )
    run = (
        tagged.join(cut, keys)
        .filter("cut is null or struct(us, seq) > cut")
        .select(*keys, "category", "us", "seq")
    )
    return _stream_prior(run, keys, th)


def _stream_prior(run: DataFrame, keys: list[str], th: Thresholds) -> DataFrame:
    half_life_us = th.half_life_days * 86400 * US
    floor, ceiling, step = th.learned_floor, th.learned_ceiling, th.learned_step

    def walk(batches):
        import pandas as pd

        key, state, done = None, None, []
        for batch in batches:
            for u, a, c, us in zip(
                batch["user_id"], batch["app_key"], batch["category"], batch["us"]
            ):
                if (u, a) != key:
                    if state:
                        done.append((*key, *state))
                    key, state = (u, a), (c, floor, 1, us)
                    continue
                _, _, n, at = state
                grown = n * 0.5 ** (max(us - at, 0) / half_life_us) + 1
                conf = min(ceiling, floor + step * (grown - 1))
                state = (c, conf, max(1, round(grown)), us)
            if done:
                yield pd.DataFrame(done, columns=cols)
                done = []
        if state:
            yield pd.DataFrame([(*key, *state)], columns=cols)

    cols = [*keys, "category", "confidence", "samples", "updated_us"]
    schema = "user_id long, app_key string, category string, confidence double, samples long, updated_us long"
    return run.repartition(*keys).sortWithinPartitions(*keys, "us", "seq").mapInPandas(walk, schema)


def supersede(activities: DataFrame, corrections: DataFrame) -> DataFrame:
    """Apply activity corrections: the corrected copy is added with full confidence and the old
    row is marked; the current view is the rows that nothing supersedes."""
    hit = activities.join(corrections, "activity_id")
    new = hit.select(
        *[c for c in activities.columns if c not in ("category", "confidence", "source", "activity_id")],
        F.col("corrected_category").alias("category"),
        F.lit(1.0).alias("confidence"),
        F.lit("user").alias("source"),
        F.concat(F.col("activity_id"), F.lit("+")).alias("activity_id"),
        F.lit(None).cast("string").alias("superseded_by"),
    )
    old = activities.join(
        corrections.select("activity_id", F.lit(True).alias("corrected")), "activity_id", "left"
    ).withColumn(
        "superseded_by",
        F.when(F.col("corrected"), F.concat(F.col("activity_id"), F.lit("+"))),
    ).drop("corrected")
    return old.unionByName(new)


def corrected(activities: DataFrame, log: DataFrame) -> DataFrame:
    """The current view of activities under a correction log (activity_id, corrected_category, us, seq).

    The log is kept as it came; of several corrections of an activity the latest counts.  Corrected rows
    take the category, full confidence, source ``user`` and the id that ``supersede`` gives the new
    copy.  The log is applied when activities are read, so days computed anew are corrected again.
    """
    latest = log.groupBy(F.col("activity_id").alias("_id")).agg(
        F.max_by("corrected_category", F.struct("us", "seq")).alias("_to")
    )
    df = activities.join(latest, F.col("activity_id") == F.col("_id"), "left")
    hit = F.col("_to").isNotNull()
    return df.withColumns(
        {
            "category": F.coalesce("_to", "category"),
            "confidence": F.when(hit, 1.0).otherwise(F.col("confidence")),
            "source": F.when(hit, "user").otherwise(F.col("source")),
            "activity_id": F.when(hit, F.concat("activity_id", F.lit("+"))).otherwise(F.col("activity_id")),
        }
    ).drop("_id", "_to")


def retroactive_days(sessions: DataFrame, corrections: DataFrame) -> DataFrame:
    """Other days on which a corrected app was used: the days a retroactive change rewrites."""
    days = sessions.select("user_id", "app_key", "local_date").distinct()
    fixed = corrections.select(
        "user_id", "app_key", F.col("local_date").alias("corrected_date")
    ).distinct()
    # every session day qualifies if any correction of the app lies on another day: compare
    # with the first and last corrected day instead of pairing all of them
    span = fixed.groupBy("user_id", "app_key").agg(
        F.min("corrected_date").alias("first"), F.max("corrected_date").alias("last")
    )
    return (
        days.join(span, ["user_id", "app_key"])
        .filter("local_date <> first or local_date <> last")
        .select("user_id", "app_key", "local_date")
    )
