"""Catalogues and fixed vocabularies.  All entries are fixed values of the published rules."""

from __future__ import annotations

# Event registry.
EVENT_TYPES = [
    "APP_FOREGROUND", "APP_BACKGROUND", "SCREEN_ON", "SCREEN_OFF", "DEVICE_LOCK",
    "DEVICE_UNLOCK", "DEVICE_STARTUP", "DEVICE_SHUTDOWN", "USER_INTERACTION",
    "COLLECTOR_START", "COLLECTOR_STOP", "HEALTH", "DOMAIN_FOCUS_START", "DOMAIN_FOCUS_END",
]

# Envelope fields (closed schema) and their bounds.
ENVELOPE_FIELDS = [
    "event_id", "device_id", "seq", "ts_utc", "tz_offset_min", "tz_id", "clock_flags",
    "uptime_ms", "type", "source", "payload", "schema_v",
]
ENVELOPE_REQUIRED = [
    "event_id", "device_id", "seq", "ts_utc", "tz_offset_min", "tz_id", "uptime_ms", "type",
    "source", "schema_v",
]
TZ_OFFSET_RANGE = (-720, 840)
MAX_BATCH = 1000

# Usage codes of the device operating system -> registry type.
USAGE_CODES = {
    "ACTIVITY_RESUMED": "APP_FOREGROUND",
    "ACTIVITY_PAUSED": "APP_BACKGROUND",
    "ACTIVITY_STOPPED": "APP_BACKGROUND",
    "SCREEN_INTERACTIVE": "SCREEN_ON",
    "SCREEN_NON_INTERACTIVE": "SCREEN_OFF",
    "KEYGUARD_SHOWN": "DEVICE_LOCK",
    "KEYGUARD_HIDDEN": "DEVICE_UNLOCK",
    "DEVICE_SHUTDOWN": "DEVICE_SHUTDOWN",
    "DEVICE_STARTUP": "DEVICE_STARTUP",
    "USER_INTERACTION": "USER_INTERACTION",
}

# Taxonomy, group -> (label, is_system, leaf -> label).
TAXONOMY = {
    "work": ("Work", False, {
        "deep_work": "Deep Work", "focused_work": "Focused Work", "development": "Development",
        "research": "Research", "writing": "Writing", "meetings": "Meetings", "admin": "Admin"}),
    "growth": ("Growth", False, {
        "learning": "Learning", "reading": "Reading", "practice": "Practice"}),
    "connection": ("Connection", False, {
        "communication": "Communication", "social": "Social"}),
    "life": ("Life", False, {
        "personal": "Personal", "exercise": "Exercise", "health": "Health",
        "errands": "Errands"}),
    "consumption": ("Consumption", False, {
        "entertainment": "Entertainment", "browsing": "Browsing"}),
    "system": ("System", True, {
        "idle": "Idle", "unobserved": "Unobserved", "offline": "Offline", "unknown": "Unknown"}),
}
WORK = list(TAXONOMY["work"][2])
# Categories that count as resumed work after media.
WORK_LIKE = ["deep_work", "focused_work", "development", "research", "writing"]

# Seed priors for app packages.
APP_PRIORS = {
    "com.android.chrome": ("browsing", 0.60),
    "com.brave.browser": ("browsing", 0.60),
    "org.mozilla.firefox": ("browsing", 0.60),
    "com.chrome.beta": ("browsing", 0.60),
    "com.opera.browser": ("browsing", 0.60),
    "com.whatsapp": ("communication", 0.75),
    "com.whatsapp.w4b": ("communication", 0.75),
    "com.facebook.orca": ("communication", 0.72),
    "com.google.android.gm": ("communication", 0.72),
    "com.google.android.apps.messaging": ("communication", 0.72),
    "com.slack": ("communication", 0.68),
    "com.microsoft.teams": ("meetings", 0.65),
    "us.zoom.videomeetings": ("meetings", 0.70),
    "com.discord": ("communication", 0.60),
    "com.facebook.katana": ("social", 0.65),
    "com.instagram.android": ("social", 0.65),
    "com.twitter.android": ("social", 0.65),
    "com.zhiliaoapp.musically": ("social", 0.65),
    "com.linkedin.android": ("social", 0.55),
    "com.google.android.youtube": ("entertainment", 0.62),
    "com.netflix.mediaclient": ("entertainment", 0.75),
    "com.spotify.music": ("entertainment", 0.60),
    "com.mxtech.videoplayer.ad": ("entertainment", 0.65),
    "com.google.android.apps.tachyon": ("communication", 0.60),
    "com.github.android": ("development", 0.70),
    "com.google.android.apps.docs": ("writing", 0.62),
    "com.microsoft.office.word": ("writing", 0.65),
    "com.google.android.keep": ("writing", 0.55),
    "com.evernote": ("writing", 0.55),
    "com.google.android.apps.classroom": ("learning", 0.65),
    "com.duolingo": ("learning", 0.70),
    "com.audible.application": ("learning", 0.60),
    "com.amazon.kindle": ("reading", 0.65),
    "com.strava": ("exercise", 0.70),
    "com.google.android.apps.fitness": ("exercise", 0.65),
    "com.sec.android.app.shealth": ("health", 0.60),
    "com.android.settings": ("admin", 0.65),
    "com.android.vending": ("admin", 0.55),
    "com.google.android.googlequicksearchbox": ("browsing", 0.55),
    "com.google.android.apps.nbu.paisa.user": ("admin", 0.60),
}

# Seed priors for browser domains.
DOMAIN_PRIORS = {
    "github.com": ("development", 0.75),
    "gitlab.com": ("development", 0.75),
    "stackoverflow.com": ("development", 0.70),
    "developer.mozilla.org": ("research", 0.68),
    "readthedocs.io": ("research", 0.65),
    "npmjs.com": ("development", 0.65),
    "pypi.org": ("development", 0.65),
    "vercel.com": ("development", 0.60),
    "herokuapp.com": ("development", 0.55),
    "localhost": ("development", 0.55),
    "docs.google.com": ("writing", 0.60),
    "notion.so": ("writing", 0.60),
    "overleaf.com": ("writing", 0.65),
    "mail.google.com": ("communication", 0.72),
    "outlook.com": ("communication", 0.70),
    "slack.com": ("communication", 0.68),
    "discord.com": ("communication", 0.58),
    "zoom.us": ("meetings", 0.70),
    "meet.google.com": ("meetings", 0.70),
    "teams.microsoft.com": ("meetings", 0.65),
    "facebook.com": ("social", 0.65),
    "instagram.com": ("social", 0.65),
    "twitter.com": ("social", 0.60),
    "x.com": ("social", 0.60),
    "reddit.com": ("social", 0.55),
    "linkedin.com": ("social", 0.55),
    "youtube.com": ("entertainment", 0.60),
    "netflix.com": ("entertainment", 0.75),
    "twitch.tv": ("entertainment", 0.70),
    "spotify.com": ("entertainment", 0.55),
    "wikipedia.org": ("research", 0.60),
    "google.com": ("browsing", 0.55),
    "amazon.com": ("errands", 0.55),
}

# Seed priors for the apps and domains of the sample telemetry view.
SAMPLE_PRIORS = {
    "app_0": ("development", 0.75),
    "app_1": ("communication", 0.72),
    "app_2": ("entertainment", 0.60),
    "app_3": ("social", 0.65),
    "app_4": ("browsing", 0.55),
    "app_5": ("writing", 0.50),
    "app_7": ("learning", 0.70),
}

# Content-scan patterns.
MAX_FREE_TEXT = 500
URL_SCHEME = r"[a-zA-Z][a-zA-Z0-9+.\-]*://"
DOMAIN = r"\b[a-zA-Z0-9-]+\.(?:com|org|net|io|dev|co|app|gov|edu)\b"
LONG_DIGITS = r"\d{7,}"
PATH_SEPARATOR = r"[/\\]"
TOKEN = r"[A-Za-z0-9+/_=\-]{32,}"
MAX_ENTROPY = 3.5
NUMBER = r"-?\d+(?:\.\d+)?%?"

# Terms that reject a text.
REJECTED_TERMS = [
    "disorder", "addiction", "addicted", "adhd", "depression", "depressed", "anxiety",
    "diagnosis", "diagnose", "diagnostic", "clinical", "pathological", "pathology", "syndrome",
    "psychiatric", "mental illness", "burnout",
]

# Evidence paths that hold derived (not measured) values.
DERIVED_PREFIXES = [
    "goals", "patterns", "baselines", "focus.avg_quality", "focus.fragmentation_index",
]

# Every key name the summary document may hold.
SUMMARY_KEYS = [
    "context_version", "scope", "date", "weekday",
    "data_quality", "coverage_ratio", "unknown_ratio", "devices_reporting",
    "unobserved_minutes", "offline_minutes", "caveats",
    "totals", "day_minutes", "observed_minutes", "screen_minutes", "active_minutes",
    "categories", "category", "minutes", "share", "sessions", "avg_confidence",
    "focus", "deep_sessions", "longest_minutes", "average_minutes", "total_focus_minutes",
    "avg_quality", "fragmentation_index", "context_switches", "switches_per_hour",
    "interruptions",
    "time_of_day", "slot", "focus_minutes", "distraction_minutes",
    "top_attention", "rank", "bucket",
    "goals", "name", "priority", "target_weekly_minutes", "aligned_minutes_today",
    "uncertainty", "week_attainment",
    "patterns", "type", "occurrences", "strength", "status",
    "baselines", "window_days", "valid_days", "screen_minutes_mean",
    "deep_work_minutes_mean", "fragmentation_mean", "today_vs_mean",
    "deep_work_minutes", "fragmentation",
]
