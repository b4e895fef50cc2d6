"""Content scan, key allowlist and the privacy gate."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrace import catalog


def entropy(token: Column) -> Column:
    """Shannon entropy of a string in bits per character."""
    n = F.length(token)
    letters = F.array_sort(F.array_distinct(F.split(token, "")))
    weights = F.transform(
        letters,
        lambda x: (n - F.length(F.replace(token, x, F.lit("")))).cast("double"),
    )
    total = F.aggregate(weights, F.lit(0.0), lambda a, c: a + c * F.log2(c))
    return F.log2(n.cast("double")) - total / n


def violations(text: Column) -> Column:
    """Classes of leaks a string shows, in fixed order; empty when clean."""
    # Violation classes.
    # Every pattern is searched behind a cheap necessary condition, and tokens only at the
    # start of a run, so that long texts are read about once.
    unicode = "(?U)"
    run = catalog.TOKEN.removesuffix("{32,}")
    tokens = F.regexp_extract_all(text, F.lit(f"((?<!{run}){catalog.TOKEN})"), F.lit(1))
    dotted = text.rlike(f"{unicode}(?i){catalog.DOMAIN[catalog.DOMAIN.index('+') + 1:]}")
    noisy = F.exists(tokens, lambda t: F.round(entropy(t), 9) > catalog.MAX_ENTROPY)
    checks = [
        ("too_long", F.length(text) > catalog.MAX_FREE_TEXT),
        (
            "url",
            (F.contains(text, F.lit("://")) & text.rlike(catalog.URL_SCHEME))
            | (dotted & text.rlike(f"{unicode}(?i){catalog.DOMAIN}")),
        ),
        ("email_shaped", F.contains(text, F.lit("@"))),
        ("long_digit_run", text.rlike(f"{unicode}{catalog.LONG_DIGITS}")),
        ("path_separator", text.rlike(catalog.PATH_SEPARATOR)),
        ("high_entropy_token", noisy),
    ]
    return F.array_compact(F.array(*[F.when(c, name) for name, c in checks]))


def scan_report(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """Texts, clean texts and texts per violation class for each key."""
    one = lambda name: F.count_if(F.array_contains("violations", name)).alias(name)
    names = ["too_long", "url", "email_shaped", "long_digit_run", "path_separator", "high_entropy_token"]
    clean = F.count_if(F.size("violations") == 0)
    n = F.count(F.lit(1))
    return scanned.groupBy(*keys).agg(
        n.alias("texts"), clean.alias("clean"), (clean / n).alias("clean_share"), *map(one, names)
    )


def flat_disallowed(payload: Column, allowed: list[str]) -> Column:
    """Top-level keys outside the allowlist, sorted."""
    return F.array_sort(F.array_except(F.json_object_keys(payload), F.lit(allowed)))


#: Bytes of payload that are walked before their rows are handed on.
BLOCK_BYTES = 4 << 20


def blocks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together, or of one row."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if sizes:
        yield start, len(sizes)


def walk_payloads(df: DataFrame, payload: str, allowed: list[str]) -> DataFrame:
    """Add what a gate needs to know of a nested JSON payload: ``disallowed`` key paths,
    string ``leaves`` with their paths, ``key_count`` and ``canonical`` JSON text.

    Payloads have no common schema, so each is walked on its own.  What is made of them stays in Arrow
    and is handed on every ``BLOCK_BYTES``, however many rows a batch has.  A payload that
    is null, not JSON or nested too deeply has a null ``key_count`` and its text as ``canonical``.
    """
    allow = frozenset(allowed)

    def walk(node, path, bad, leaves) -> int:
        if isinstance(node, dict):
            count = len(node)
            for key, value in node.items():
                here = f"{path}.{key}" if path else key
                if key not in allow:
                    bad.append(here)
                count += walk(value, here, bad, leaves)
            return count
        if isinstance(node, list):
            return sum(walk(v, f"{path}[{i}]", bad, leaves) for i, v in enumerate(node))
        if isinstance(node, str):
            leaves.append({"path": path, "value": node})
        return 0

    leaf = pa.struct([("path", pa.string()), ("value", pa.string())])
    added = {"disallowed": pa.list_(pa.string()), "leaves": pa.list_(leaf), "key_count": pa.int64(), "canonical": pa.string()}

    def walked(block: pa.RecordBatch) -> pa.RecordBatch:
        out = {name: [] for name in added}
        for text in block.column(payload).to_pylist():
            bad, leaves = [], []
            try:
                node = json.loads(text)
                count = walk(node, "", bad, leaves)
                canonical = json.dumps(node, sort_keys=True, separators=(",", ":"))
            except (TypeError, ValueError, RecursionError):
                count, canonical, bad, leaves = None, text, [], []
            out["key_count"].append(count)
            out["disallowed"].append(sorted(bad))
            out["leaves"].append(leaves)
            out["canonical"].append(canonical)
        arrays = [pa.array(out[name], kind) for name, kind in added.items()]
        return pa.RecordBatch.from_arrays([*block.columns, *arrays], names=[*block.schema.names, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(payload)), 0).to_pylist()
            for start, stop in blocks(sizes, BLOCK_BYTES):
                yield walked(batch.slice(start, stop - start))

    extra = "disallowed array<string>, leaves array<struct<path:string,value:string>>, key_count long, canonical string"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, {extra}")


def gate(walked: DataFrame) -> DataFrame:
    """Outcome, rejected paths and digest of every payload: one audit row each.  Payloads that could
    not be read are ``bad_json``."""
    leaking = F.transform(
        F.filter("leaves", lambda x: F.size(violations(x["value"])) > 0), lambda x: x["path"]
    )
    rejected = F.array_sort(F.array_distinct(F.concat("disallowed", leaking)))
    return walked.withColumn("rejected_fields", rejected).select(
        *[c for c in walked.columns if c not in ("disallowed", "leaves", "canonical")],
        "rejected_fields",
        F.when(F.col("key_count").isNull(), "bad_json")
        .when(F.size("rejected_fields") > 0, "rejected")
        .otherwise("allowed")
        .alias("outcome"),
        F.sha2("canonical", 256).alias("payload_sha256"),
    )


def suffix_rules(suffixes: DataFrame) -> DataFrame:
    """A suffix list (column ``suffix``) as paths of a trie over labels read from the right: ``path``,
    ``depth`` (its labels) and how many labels a host through it gives to its suffix.

    ``a.b`` is a suffix itself, ``*.b`` makes one of every label before ``b``, and ``!c.b`` takes ``c.b``
    out of that again.  Blank entries are left out; case and repeated entries do not matter.
    """
    rule = F.lower(F.trim("suffix"))
    bare = F.regexp_replace(rule, r"^(!|\*\.)", "")
    labels = F.split(bare, r"\.")
    kind = F.when(F.startswith(rule, F.lit("!")), "exception").when(F.startswith(rule, F.lit("*.")), "wildcard")
    kind = F.coalesce(kind, F.lit("plain"))
    n = F.size(labels)
    return suffixes.where(F.length(bare) > 0).select(
        F.array_join(F.reverse(labels), ".").alias("path"),
        n.alias("depth"),
        kind.alias("kind"),
        F.when(kind == "exception", n - 1).when(kind == "wildcard", n + 1).otherwise(n).alias("takes"),
    ).distinct()


def registrable_domain(pages: DataFrame, url: str, suffixes: DataFrame) -> DataFrame:
    """Add ``domain``: the registrable part of a URL's host, null for addresses without one.

    Hosts are made distinct first, so that a host holding many pages is looked up once.  Every
    prefix of a host's labels from the right is a path of the rules' trie or not: one equality join finds
    all rules on the way.  An exception wins, else the rule that takes most labels; the top label
    alone is a suffix where no rule applies.  ``suffixes``: see ``suffix_rules``.
    """
    host = F.rtrim(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lit("."))
    df = pages.withColumn("host", host)
    hosts = df.select("host").distinct().filter(
        F.col("host").isNotNull()
        & ~F.col("host").rlike(r"^[0-9.]+$|^\[")
        & F.contains("host", F.lit("."))
    )
    labels = F.split("host", r"\.")
    n = F.size(labels)
    back = F.reverse(labels)
    ways = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(back, F.lit(1), i), "."))
    walked = hosts.select("host", n.alias("n"), F.explode(ways).alias("path"))
    met = walked.join(suffix_rules(suffixes), "path").where(F.col("takes") <= F.col("n"))
    best = met.groupBy("host").agg(
        F.max(F.when(F.col("kind") == "exception", F.col("takes"))).alias("out"), F.max("takes").alias("most")
    )
    found = hosts.join(best, "host", "left").select(
        "host", labels.alias("labels"), F.coalesce("out", "most", F.lit(1)).alias("takes")
    )
    domain = F.when(
        F.size("labels") > F.col("takes"),
        F.array_join(F.slice("labels", F.size("labels") - F.col("takes"), F.col("takes") + 1), "."),
    )
    return df.join(found.select("host", domain.alias("domain")), "host", "left")
