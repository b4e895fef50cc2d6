"""Small documents with every awkward case: nulls, empty and long texts, ties, repeated rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, size string, row string"


def texts(seed=3, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    long = " ".join(rng.choice(vocab) for _ in range(30_000))
    near = out[7].split()
    near = [" ".join([*near[:-1], f"x{k}"]) for k in range(3)]
    return [None, "", " ", "\n\n", "Été 日本 <|endoftext|> it's  two", long, *out, *out[:20], *near]


def documents(spark, seed=3, n=120):
    rows = []
    for i, t in enumerate(texts(seed, n)):
        source = None if i % 11 == 0 else f"s{i % 5}" if i % 3 else "hot"
        rows.append((i, t, "en" if i % 2 else None, source, len(t or ""), 5, "x", "y", "z"))
    rows += [rows[9], rows[9], (None, "lost id a b c d e f", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
