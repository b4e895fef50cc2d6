"""The day pipeline: raw telemetry to sessions, coverage, activities, focus, patterns and
daily metrics, for all user-days at once."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import cached_property, partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace.config import DEVICE_DAY, USER_DAY, Thresholds
from daytrace.operators import classify as cl
from daytrace.operators import coverage as cov
from daytrace.operators import focus as fo
from daytrace.operators import intervals as iv
from daytrace.operators import metrics as me
from daytrace.operators import patterns as pa
from daytrace.operators import sessions as se
from daytrace.sources.store import SLACK
from daytrace.sources.tables import stage


#: Events of a user-day up to which whole days stay in one time chunk, and the width of such chunks.
WHOLE_ROWS, WHOLE_S = 20_000, 7 * 86400


def together(spark: SparkSession, *steps: Callable[[], object]) -> list:
    """Results of steps that do not wait for each other; their jobs run at the same time."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(s)) for s in steps]]


class DayPlan:
    """Lazily built steps of the pipeline.  Steps that several later ones read are staged
    (materialised once on shared storage); everything else stays a plain DataFrame."""

    def __init__(
        self,
        events: DataFrame,
        seeds: DataFrame,
        thresholds: Thresholds,
        domain_seeds: DataFrame | None = None,
        rules: DataFrame | None = None,
        learned: DataFrame | None = None,
        enrolled: DataFrame | None = None,
        days: tuple[dt.date, dt.date] | None = None,
        corrections: Callable[[DayPlan], DataFrame] | None = None,
        host_keys: bool = False,
        whole_rows: int | None = None,
    ) -> None:
        """``whole_rows``: see ``th``.  ``host_keys``: browser events carry whole hosts, which are looked up by their last labels.  ``days`` keeps the local days from the first to the last, both included; the filter reaches the
        partitions of a stored event table (``sources.store``).  ``enrolled`` (phones: user_id, device_id, tz, day_start_hour, first_date, last_date) adds the
        device-days without events, which are unobserved from end to end.  ``corrections`` gives the log
        of activity corrections that ``current`` is read under."""
        if days is not None:
            inside = F.col("local_date").between(F.lit(days[0]), F.lit(days[1]))
            events = events.filter(inside)
            if "day" in events.columns:
                events = events.filter(F.col("day").between(F.lit(days[0] - SLACK), F.lit(days[1] + SLACK)))
            if enrolled is not None:
                enrolled = enrolled.withColumns({
                    "first_date": F.greatest("first_date", F.lit(days[0])), "last_date": F.least("last_date", F.lit(days[1])),
                })
        self.events = events
        self.seeds = seeds
        self.domain_seeds = domain_seeds if domain_seeds is not None else seeds
        self.rules = rules
        self.learned = learned
        self.enrolled = enrolled
        self.corrections = corrections
        self.host_keys = host_keys
        self.thresholds, self.whole_rows = thresholds, whole_rows

    @cached_property
    def th(self) -> Thresholds:
        """The thresholds.  Time chunks (``operators.scan``) are for large user-days; where none has more than
        ``whole_rows`` events, chunks are wide, so that few carry rows are made.  No row depends on the width."""
        if self.whole_rows is None:
            return self.thresholds
        counts = self.events.groupBy(*USER_DAY).agg(F.count(F.lit(1)).alias("n"))
        largest = counts.agg(F.max("n")).first()[0] or 0  # one number
        if largest > self.whole_rows:
            return self.thresholds
        return replace(self.thresholds, chunk_s=max(self.thresholds.chunk_s, WHOLE_S))

    def at_once(self, *names: str) -> None:
        """Make staged steps at the same time; none of them may read another."""
        self.th  # noqa: B018
        missing = [n for n in names if n not in self.__dict__]
        if missing:
            together(self.events.sparkSession, *[partial(getattr, self, n) for n in missing])

    @cached_property
    def phone_events(self) -> DataFrame:
        return self.events.filter("platform = 'android'")

    @cached_property
    def browser_events(self) -> DataFrame:
        return self.events.filter("platform = 'browser'")

    # sessions -----------------------------------------------------------------------
    @cached_property
    def app_sessions(self) -> DataFrame:
        return stage(se.app_sessions(self.phone_events, self.th))

    @cached_property
    def browser_sessions(self) -> DataFrame:
        return se.browser_sessions(self.browser_events, self.th)

    @cached_property
    def arbitrated(self) -> DataFrame:
        return stage(iv.arbitrate(self.browser_sessions))

    @cached_property
    def _app_keyed(self) -> DataFrame:
        df = cl.with_priors(self.app_sessions, self.seeds, self.rules, self.learned)
        key_only = cl.classify(
            df.select(
                *df.columns,
                F.col("rule_category").alias("_r"),
                F.col("learned_category").alias("_l"),
                F.col("learned_conf").alias("_lc"),
                F.col("samples").alias("_n"),
                F.col("seed_category").alias("_s"),
                F.col("seed_conf").alias("_sc"),
            ),
            self.th,
        )
        return key_only.withColumnsRenamed(
            {
                "category": "key_category",
                "_r": "rule_category",
                "_l": "learned_category",
                "_lc": "learned_conf",
                "_n": "samples",
                "_s": "seed_category",
                "_sc": "seed_conf",
            }
        ).drop("confidence", "source", "evidence").withColumn(
            "is_media",
            F.col("rule_category").isNull()
            & (F.coalesce("samples", F.lit(0)) < self.th.learned_min_samples)
            & F.coalesce(F.col("seed_category") == "entertainment", F.lit(False)),
        )

    @cached_property
    def followed(self) -> DataFrame:
        return cl.followed_by_work(self._app_keyed, self.th)

    @cached_property
    def classified_apps(self) -> DataFrame:
        df = cl.classify(self.followed, self.th, F.col("followed"))
        return df.drop("key_category", "is_media", "followed")

    @cached_property
    def classified_domains(self) -> DataFrame:
        if self.host_keys:
            df = cl.with_domain_priors(self.arbitrated, self.domain_seeds)
        else:
            df = cl.with_priors(self.arbitrated, self.domain_seeds, None, None)
        return cl.classify(df, self.th)

    @cached_property
    def classified(self) -> DataFrame:
        """All classified sessions of all devices."""
        self.at_once("app_sessions", "arbitrated")
        cols = [
            *DEVICE_DAY, "app_key", "start_us", "end_us", "category", "confidence", "source",
            "evidence",
        ]
        apps = self.classified_apps.select(*cols, F.lit("android").alias("platform"))
        domains = self.classified_domains.select(*cols, F.lit("browser").alias("platform"))
        return stage(
            apps.unionByName(domains).withColumn(
                "session_id", F.concat_ws(":", "user_id", "device_id", "start_us")
            )
        )

    # coverage -----------------------------------------------------------------------
    @cached_property
    def states(self) -> DataFrame:
        return stage(cov.signal_states(self.phone_events, self.th))

    @cached_property
    def coverage(self) -> DataFrame:
        found = cov.coverage_intervals(self.states, self.th)
        if self.silent is not None:
            found = found.unionByName(cov.silent_intervals(self.silent))
        return stage(found)

    @cached_property
    def silent(self) -> DataFrame | None:
        """Enrolled device-days without events."""
        return None if self.enrolled is None else cov.silent_days(self.enrolled, self.phone_events)

    @cached_property
    def virtual_coverage(self) -> DataFrame:
        """Arbitrated browser time as observed coverage of one virtual device."""
        return self.arbitrated.select(
            *USER_DAY, "start_us", "end_us", F.lit(cov.TRACKED).alias("state")
        )

    @cached_property
    def unified(self) -> DataFrame:
        """Observed and dual-device time over phones and the virtual browser device."""
        seen = self.coverage.filter(F.col("state").isin(cov.TRACKED, cov.IDLE))
        spans = seen.select(*USER_DAY, "start_us", "end_us").unionByName(
            self.virtual_coverage.drop("state")
        )
        return iv.overlap_sweep(spans, USER_DAY, self.th)

    # activities, focus, patterns ----------------------------------------------------
    @cached_property
    def activities(self) -> DataFrame:
        return stage(iv.activities(iv.cluster_cross_device(self.classified, self.th)))

    @cached_property
    def current(self) -> DataFrame:
        """Activities as corrected by their users."""
        return self.activities if self.corrections is None else cl.corrected(self.activities, self.corrections(self))

    @cached_property
    def focus(self) -> DataFrame:
        return stage(fo.focus_sessions(self.classified, self.th))

    @cached_property
    def bursts(self) -> DataFrame:
        return stage(pa.distraction_bursts(self.classified, self.th))

    @cached_property
    def occurrences(self) -> DataFrame:
        return (
            self.bursts.unionByName(pa.habitual_checking(self.classified, self.th))
            .unionByName(pa.switch_storms(self.classified, self.th))
            .unionByName(pa.post_task_avoidance(self.classified, self.th))
        )

    @cached_property
    def patterns(self) -> DataFrame:
        return pa.promote(self.occurrences, self.th)

    # metrics ------------------------------------------------------------------------
    @cached_property
    def metrics(self) -> DataFrame:
        self.at_once("classified", "coverage")
        self.at_once("focus", "bursts")
        return me.daily_metrics(self)
