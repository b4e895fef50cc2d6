import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from daytrace.llm import codes, phrases, whitening
from daytrace.llm.common import Scratch, read
from tokenizers import Tokenizer

from .helpers import documents, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, x string, n string, component string, k0 int"


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


# 11: whitening ------------------------------------------------------------------------------------


def symmetric(kind, m, rng):
    q, _ = np.linalg.qr(rng.normal(size=(m, m)))
    if kind == "random":
        return q @ np.diag(rng.normal(size=m)) @ q.T
    if kind == "graded":
        return q @ np.diag(10.0 ** -rng.uniform(0, 14, m)) @ q.T
    if kind == "two values":
        return q @ np.diag(np.repeat([5.0, 1.0], [m // 2, m - m // 2])) @ q.T
    if kind == "low rank":
        b = rng.normal(size=(m, 2))
        return b @ b.T
    if kind == "equal diagonal":
        a = np.zeros((m, m))
        if m > 2:
            a[0, 1] = a[1, 0] = 1
        return a
    return {"diagonal": np.diag(rng.normal(size=m)), "identity": 3 * np.eye(m), "zero": np.zeros((m, m))}[kind]


@pytest.mark.parametrize("kind", ["random", "graded", "two values", "low rank", "equal diagonal", "diagonal", "identity", "zero"])
def test_components_are_eigenvectors(kind):
    rng = np.random.default_rng(4)
    for m in [1, 2, 3, 5, 17, 64]:
        a = symmetric(kind, m, rng)
        a = (a + a.T) / 2
        values, vectors = whitening.components(a)
        true = np.linalg.eigvalsh(a)[::-1]
        scale = max(np.abs(true).max(), 1e-300)
        assert np.abs(values - true).max() <= 1e-12 * scale
        assert np.abs(vectors.T @ vectors - np.eye(m)).max() < 1e-11
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-11 * scale
        some, _ = whitening.components(a, 2)
        assert np.abs(some - true[:2]).max() <= 1e-12 * scale


def test_polar_factor_is_the_matrix_sign():
    rng = np.random.default_rng(5)
    a = symmetric("random", 20, rng)
    values, vectors = np.linalg.eigh(a)
    sign = vectors @ np.diag(np.sign(values)) @ vectors.T
    assert np.abs(whitening.polar(a) - sign).max() < 1e-12


def brute_whitening(rows, k=4, scale=256):
    """Plain numpy over all rows at once: {row: (deviation, whitened up to sign)}."""
    x = {}
    for i, (key, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(np.float32(c)) for c in v):
            x[i] = tuple(int(np.floor(float(np.float32(c)) * scale)) for c in v)
    lengths = Counter(len(v) for v in x.values())
    d = max(lengths, key=lambda n: (lengths[n], n))
    x = {i: v for i, v in x.items() if len(v) == d}
    fit = sorted(set(x.values()))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    m = np.array(fit, float) - np.array(s) / n
    cov = m.T @ m / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, v in x.items():
        white = (np.array(v, float) - np.array(s) / n) @ vectors / np.sqrt(np.maximum(values, 1e-300))
        out[i] = n, sum((n * c - t) ** 2 for c, t in zip(v, s)), white
    return out, values / np.trace(cov)


def test_whitening_against_brute_force(spark, scratch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.2])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a hot vector
    rows += [(None, rows[1][1]), (None, rows[1][1]), (7, rows[2][1]), (2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    rows += [(2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, []), (2005, [1.0, 2.0]), (2006, [0.0] * 6), (2007, [-0.0] * 6)]
    frame = spark.createDataFrame([(*r, 1, "a", "b", "c", 3) for r in rows], VECTORS).repartition(4)
    got = whitening.whiten(frame, scratch, keep=("vec_id", "label", "n", "x", "k0")).collect()
    want, shares = brute_whitening(rows)
    assert len(got) == 4 * len(want)
    by = defaultdict(list)
    for r in got:
        by[r.vec_id, r.component].append(r)
    signs = {}
    for i, (n, deviation, white) in want.items():
        for c in range(4):
            r = by[rows[i][0], c + 1]
            near = [q for q in r if int(q.deviation) == deviation and q.n == n and abs(abs(q.whitened) - abs(white[c])) < 1e-9]
            assert near
            assert all(abs(q.explained - shares[c]) < 1e-9 and q.identity_error < 1e-9 and q.x == "a" for q in near)
            if abs(white[c]) > 1e-3 and len(r) == 1:
                signs.setdefault(c, set()).add(np.sign(near[0].whitened * white[c]))
    assert all(len(v) == 1 for v in signs.values()) and len(signs) == 4


def test_exact_deviations_beyond_64_bits():
    x = np.array([[1 << 30, -5], [7, 1 << 22]])
    n, s = 10**12, [123456789012345, -10**15]
    want = [sum((n * int(v) - t) ** 2 for v, t in zip(row, s)) for row in x.tolist()]
    assert whitening._deviations(x, n, s) == want
    small = x % 1000
    s = [123456789012, -(10**11)]
    assert whitening._deviations(small, n, s) == [sum((n * int(v) - t) ** 2 for v, t in zip(row, s)) for row in small.tolist()]


def test_whitening_without_variance_or_rows(spark, scratch):
    frame = spark.createDataFrame([(i, [1.0, 2.0], 1, "a", "b", "c", 3) for i in range(5)], VECTORS)
    out = whitening.whiten(frame, scratch).collect()
    assert len(out) == 10 and all(r.whitened is None and r.explained is None and r.identity_error is None for r in out)
    line = spark.createDataFrame([(i, [float(i), 2.0], 1, "a", "b", "c", 3) for i in range(5)], VECTORS)
    out = whitening.whiten(line, scratch).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in out) and len(out) == 10
    nothing = whitening.whiten(frame.where("false"), scratch)
    assert not nothing.take(1) and nothing.columns[0] == "vec_id"
    long = spark.createDataFrame([(i, [float(i * j % 7) for j in range(1, 301)], 1, "a", "b", "c", 3) for i in range(40)], VECTORS)
    assert all(r.identity_error < 1e-6 for r in whitening.whiten(long, scratch).collect())


def test_whitening_of_the_sample(spark, scratch):
    frame = read(spark, SF, "embeddings")
    got = whitening.whiten(frame, scratch).collect()
    rows = [(r.vec_id, list(r.embedding)) for r in frame.collect()]
    want, shares = brute_whitening(rows)
    by = {(r.vec_id, r.component): r for r in got}
    for i, (n, deviation, white) in want.items():
        for c in range(4):
            r = by[rows[i][0], c + 1]
            assert (r.n, int(r.deviation)) == (n, deviation) and abs(abs(r.whitened) - abs(white[c])) < 1e-8
            assert abs(r.explained / shares[c] - 1) < 1e-9


# 12: collocations ---------------------------------------------------------------------------------


def brute_collocations(rows, longest=4, least=30, cover=80, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        g = "und" if lang is None else lang
        raw = (text or "").encode().lower().decode()
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", raw):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[g] += len(w)
            for k in range(1, longest + 1):
                counts[g].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for g, f in counts.items():
        keep = {p: a for p, a in f.items() if a >= least}
        rows = []
        for p, a in keep.items():
            w = p.split(" ")
            if len(w) < 2:
                continue
            outer = [b for q, b in keep.items() if len(q.split(" ")) > len(w) and f" {p} " in f" {q} "]
            if any(100 * b >= cover * a for b in outer):
                continue
            cuts = []
            for j in range(1, len(w)):
                l, r = keep[" ".join(w[:j])], keep[" ".join(w[j:])]
                cuts.append((2000000 * a // (l + r), j, l, r))
            s, _, l, r = min(cuts)
            rows.append((-s, -a, p.encode(), p, a, l, r, total[g], s))
        out += [(g, i + 1, *r[3:]) for i, r in enumerate(sorted(rows)[:top])]
    return sorted(out, key=repr)


def some_texts():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(12)] + ["É", "the", "The", "a-b"]
    out = []
    for i in range(150):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        out.append(("".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for w in words), rng.choice(["en", "fr", None])))
    out += [("new york city is big. " * 9, "en")] * 4 + [("a a a a a a a", "fr")] * 6
    out += [(None, "en"), ("", "en"), (" \t .,;\r\x0b\x0c", None), ("end", "de"), ("und too many", "und"), ("x" * 100_000, "en")]
    out += [(" ".join(rng.choice(vocab) for _ in range(20_000)), "long")]
    return out


def as_rows(frame):
    return sorted(map(tuple, frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()), key=repr)


def phrase_frame(spark, rows):
    return spark.createDataFrame([(t, g, "x", 1, "y") for t, g in rows], "text string, lang string, phrase string, block int, word string").repartition(3)


@pytest.mark.parametrize("least,longest,top,block", [(30, 4, 2000, 1 << 20), (3, 4, 7, 500), (5, 2, None, 2000), (2, 5, None, 3000)])
def test_collocations_against_brute_force(spark, scratch, monkeypatch, least, longest, top, block):
    monkeypatch.setattr(phrases, "BLOCK_WORDS", block)
    monkeypatch.setattr(phrases, "SLICE", 64)
    rows = some_texts()
    if least < 5:
        rows = rows[:80] + rows[150:-1]
    got = phrases.collocations(phrase_frame(spark, rows), scratch, least=least, longest=longest, top=top)
    want = brute_collocations(rows, longest, least, top=top if top is not None else 10**9)
    assert want and as_rows(got) == want


def test_collocations_of_little(spark, scratch):
    assert not phrases.collocations(empty(spark), scratch).take(1)
    assert not phrases.collocations(phrase_frame(spark, [("one two", "en"), (None, None)]), scratch).take(1)
    docs = documents(spark)
    got = as_rows(phrases.collocations(docs, scratch, least=4, group="lang"))
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert got == brute_collocations(rows, least=4)


# 13: token codes ----------------------------------------------------------------------------------


@pytest.mark.parametrize("top", [1, 255, 256, 50_257, 70_000, (1 << 32) - 1])
def test_codes_round_trip_and_random_access(top):
    rng = np.random.default_rng(top)
    for n in [0, 1, 7, 8, 511, 512, 513, 1024, 5000]:
        ids = rng.integers(0, top, n, dtype=np.uint32, endpoint=True)
        ids[::3] %= 300
        image = codes.Codes.encode(ids)
        view = codes.Codes.open(image)
        assert len(view) == n and (view.slice(0, n) == ids).all()
        for i in {0, n - 1, n // 2, *rng.integers(0, max(n, 1), 50).tolist()}:
            if 0 <= i < n:
                assert view[i] == ids[i]
        for _ in range(30):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (view.slice(a, b) == ids[a:b]).all()
        with pytest.raises(IndexError):
            view[n]


def test_damaged_images_are_noticed():
    image = codes.Codes.encode(np.arange(1000))
    for bad in (b"XXXX" + image[4:], image[:-1], image + b"\0"):
        with pytest.raises(ValueError):
            codes.Codes.open(bad)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def raw(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("segment", [1, 500, 1 << 18])
def test_written_ids_are_those_of_the_library(spark, scratch, tokenizer, segment):
    docs = documents(spark)
    path = f"{scratch.folder}/codes-{segment}"
    codes.write_codes(docs, path, PATH, segment_ids=segment)
    got = codes.read_documents(spark, path, ids=True).orderBy("start").collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter((r.doc_id, r.ids) for r in got) == Counter((k, raw(ids_of(tokenizer, t))) for k, t in rows)
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens


def test_hot_keys_are_cut_between_parts(spark, scratch, tokenizer):
    rows = [(None, "same text")] * 600 + [(5, "other")] * 600 + [(i, f"t {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = f"{scratch.folder}/hot"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    codes.write_codes(docs, path, PATH)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.parquet(path).selectExpr("part", "size(keys) as n").groupBy("part").sum("n").collect()
    assert len(parts) > 2 and max(r[1] for r in parts) < 900
    got = codes.read_documents(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()


def test_single_ids(spark, scratch, tokenizer):
    docs = documents(spark).dropDuplicates(["doc_id"]).where("doc_id is not null")
    path = f"{scratch.folder}/single"
    codes.write_codes(docs, path, PATH, segment_ids=300)
    rng = random.Random(9)
    truth = {r.doc_id: ids_of(tokenizer, r.text) for r in docs.collect()}
    asked = [(k, rng.randrange(len(v))) for k, v in truth.items() for _ in range(3)]
    asked += [(k, len(v)) for k, v in list(truth.items())[:5]] + [(1, -1), (10**9, 0), (None, 0), (2, None)]
    wanted = spark.createDataFrame(asked, "doc_id long, at int")
    got = Counter(map(tuple, codes.tokens_at(spark, path, wanted).collect()))
    want = Counter()
    for k, at in asked:
        ok = k in truth and at is not None and 0 <= at < len(truth[k])
        want[k, at, truth[k][at] if ok else None] += 1
    assert got == want


def test_no_documents(spark, scratch):
    out = codes.token_files(empty(spark), PATH, scratch)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and not out.take(1)
