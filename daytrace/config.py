"""Thresholds of every operator.  Durations are seconds; all are overridable."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

US = 1_000_000  # microseconds per second: instants and sums are BIGINT micros


# Defaults of the published rules.
@dataclass(frozen=True)
class Thresholds:
    # sessions
    max_session_s: int = 4 * 3600
    min_session_s: int = 3
    merge_gap_s: int = 30
    # coverage
    poll_s: int = 15 * 60
    idle_s: int = 5 * 60
    # cross-device clustering
    cluster_gap_s: int = 5 * 60
    # classification
    confidence_floor: float = 0.55
    learned_min_samples: int = 5
    followed_window_s: int = 15 * 60
    followed_min_s: int = 30 * 60
    followed_next: int = 5
    followed_confidence: float = 0.68
    half_life_days: float = 60.0
    learned_floor: float = 0.75
    learned_ceiling: float = 0.95
    learned_step: float = 0.04
    # focus
    tolerance_s: int = 90
    interruption_max_s: int = 120
    interruption_cluster_s: int = 5 * 60
    focus_min_s: int = 15 * 60
    deep_min_s: int = 45 * 60
    per_interruption_s: int = 15 * 60
    focus_min_ratio: float = 0.80
    deep_min_ratio: float = 0.90
    deep_max_switch_rate: float = 2.0
    # patterns
    burst_window_s: int = 15 * 60
    burst_min_sessions: int = 3
    burst_min_total_s: int = 5 * 60
    habit_window_s: int = 30 * 60
    habit_min_opens: int = 5
    habit_max_median_s: int = 90
    storm_window_s: int = 20 * 60
    storm_min_switches: int = 20
    avoid_work_min_s: int = 20 * 60
    avoid_gap_s: int = 3 * 60
    avoid_min_s: int = 10 * 60
    avoid_resume_s: int = 30 * 60
    confirm_occurrences: int = 3
    confirm_days: int = 3
    start_avoid_min_s: int = 10 * 60
    start_avoid_days: int = 4
    drift_min_s: int = 30 * 60
    drift_nights: int = 3
    slot_s: int = 30 * 60
    # coverage gates
    coverage_gate: float = 0.6
    baseline_gate: float = 0.7
    # browser wake reconciliation and clock checks
    wake_bound_s: int = 3 * 60
    clock_drift_s: int = 120
    late_s: int = 7 * 86400
    stale_s: int = 6 * 3600
    # width of the time chunks of every ordered scan: a task of a scan holds the events of one
    # device in one chunk
    chunk_s: int = 3600

    def scaled(self, factor: int) -> "Thresholds":
        """The same rules on a clock ``factor`` times slower (used for sparse streams)."""
        keep = {"clock_drift_s", "late_s", "stale_s", "slot_s"}
        return replace(
            self,
            **{
                f.name: getattr(self, f.name) * factor
                for f in fields(self)
                if f.name.endswith("_s") and f.name not in keep
            },
        )


# Days that the server keeps raw events, and sessions and audit rows.
RAW_DAYS, SESSION_DAYS = 180, 730

DEVICE_DAY = ["user_id", "device_id", "local_date"]
USER_DAY = ["user_id", "local_date"]
