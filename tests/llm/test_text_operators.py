import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from daytrace.llm import langid, lines, minhash, mixing, packing, sharding, tokens
from daytrace.llm.common import Scratch
from tokenizers import Tokenizer

from .helpers import documents, empty, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


# 1: sharding ------------------------------------------------------------------------------


def test_shards_have_equal_bytes_gapless_slots_and_whole_groups(spark, scratch):
    rng = random.Random(1)
    rows = [(i, "hot text " * 40) for i in range(400)] + [(400 + i, None) for i in range(300)]
    rows += [(1000 + i, "t" * rng.randint(0, 300) + str(i // 3)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = sharding.assign_shards(docs, scratch, shards=8, ranges=64, samples=2000).toPandas()
    assert sorted(out["doc_id"]) == sorted(r[0] for r in rows)
    by = dict(rows)
    for r in out.itertuples():
        raw = (by[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() < 0.05 * sizes.mean()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    small = out[out["doc_id"] >= 1000].copy()
    small["text"] = [by[i] for i in small["doc_id"]]
    shards = small[small["text"].str.len() > 0].groupby("text")["shard"].nunique()
    assert (shards == 1).all()


def test_shards_of_awkward_rows(spark, scratch):
    docs = documents(spark)
    out = sharding.assign_shards(docs, scratch, keep=tuple(docs.columns)).toPandas()
    assert len(out) == docs.count() and set(out["law"]) == {"bytes"}
    assert not sharding.assign_shards(empty(spark), scratch).take(1)


def test_shards_of_one_text_without_ids(spark, scratch):
    rows = [(None, "same" * 10)] * 4000 + [(i, f"own {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.assign_shards(docs, scratch).toPandas()
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 8 and by.max() - by.min() <= 0.02 * by.mean() + 41
    assert all(sorted(part) == list(range(len(part))) for _, part in got.groupby("shard")["slot"])


def test_written_shards(spark, scratch):
    docs = documents(spark).drop("shard", "slot")
    sharding.write_shards(docs, f"{scratch.folder}/shards", scratch, shards=3)
    back = spark.read.parquet(f"{scratch.folder}/shards")
    assert Counter(r.text for r in back.collect()) == Counter(r.text for r in docs.collect())


# 10: token counts ------------------------------------------------------------------------------


def test_every_prefix(tokenizer):
    counter = tokens.PrefixCounts(PATH)
    rng = random.Random(2)
    parts = ["a", "the", "ing", "'re", "'s", "'ve", " ", "  ", "\n", "\t", "é", "日本", "!", "...", "12", "😀"]
    parts += ["<|endoftext|>", " ", "'", "Ab", "\r\n", "ß", "<|end", "\x85", " "]
    for _ in range(300):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        table = counter.text(s)
        want = [len(ids_of(tokenizer, s[:i])) for i in range(len(s) + 1)]
        assert tokens.tokens_at(table).tolist() == want, s
        assert counter.encode(s).tolist() == ids_of(tokenizer, s)
        for budget in (0, 1, 3):
            assert tokens.longest_prefix(table, budget) == max(i for i, n in enumerate(want) if n <= budget)


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 20_000, "ab1! \n" * 3000, "é" * 5000, "x" * 300 + " " * 300])
def test_long_stretches(tokenizer, text):
    counter = tokens.PrefixCounts(PATH)
    assert tokens.total(counter.text(text)) == len(ids_of(tokenizer, text)) == len(counter.encode(text))


def test_very_long_white_space_is_encoded(tokenizer):
    text = "x" + " " * 1_000_000 + "<|endoftext|>y"
    assert tokens.PrefixCounts(PATH).encode(text).tolist() == ids_of(tokenizer, text)


def test_forgetting_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER_SPANS", 3)
    monkeypatch.setattr(tokens, "REMEMBER_STARTS", 2)
    monkeypatch.setattr(tokens, "REMEMBER_PAIRS", 2)
    counter = tokens.PrefixCounts(PATH)
    for t in texts()[6:40]:
        assert tokens.total(counter.text(t)) == len(ids_of(tokenizer, t))


def test_token_counts_of_documents(spark, tokenizer):
    docs = documents(spark)
    out = tokens.count_tokens(docs, PATH, keep=("doc_id", "text"), budgets=(5,), limit=20).collect()
    assert len(out) == docs.count()
    for r in out:
        n = len(ids_of(tokenizer, r.text))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 20)
        assert tokens.tokens_at(r.steps)[r.cut_5] <= 5
    assert not tokens.count_tokens(empty(spark), PATH).take(1)


def test_other_tokenizer_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        tokens.encoder(public_tokenizers.path("word_bpe_49k.json"))


# 5: packing ---------------------------------------------------------------------------------


def test_packing_keeps_every_id_and_fills_sequences(spark, scratch, tokenizer):
    docs = documents(spark).select("doc_id", "text", "shard").where("doc_id is not null").dropDuplicates(["doc_id"])
    by = {r.doc_id: r.text for r in docs.collect()}
    out = packing.pack(docs, PATH, scratch, ids=True)
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in out.collect():
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    total = 0
    for doc, text in by.items():
        want = [*ids_of(tokenizer, text), 2]
        total += len(want)
        got = sorted(pieces[doc], key=lambda r: r.piece)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in got]).tolist() == want
        assert [r.piece for r in got] == list(range(len(got)))
        assert [r.start for r in got] == [sum(x.length for x in got[:k]) for k in range(len(got))]
        assert all(r.length == 1024 for r in got[1:])
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(bins) <= -(-total // 1024) + 1
    joined = {r.sequence_id: r.ids for r in packing.sequences(out).collect()}
    assert all(len(joined[s]) == 4 * sum(r.length for r in rows) for s, rows in bins.items())


@pytest.mark.parametrize("select", ["norm", "dot"])
def test_plans_respect_every_capacity(select):
    rng = np.random.default_rng(5)
    lengths = np.unique(rng.integers(1, 1025, 300))
    counts = rng.integers(1, 400, len(lengths))
    for caps in ((1024, 1024, 1024**2), (1024, 4, 1024**2), (1024, 1024, 1024**2), (1100, 6, 1_060_000)):
        plan = packing.plan_bins(lengths, counts, caps, select, (1.0, 0.3, 0.3))
        used, placed = defaultdict(lambda: np.zeros(3)), Counter()
        for n, first, count, start, per, offset in plan.tolist():
            assert first == placed[n]
            placed[n] += count
            for k in range(-(-count // per)):
                assert used[start + k][0] == offset
                here = min(per, count - k * per)
                used[start + k] += np.array([n, 1, n * n]) * here
        assert placed == Counter(dict(zip(lengths.tolist(), counts.tolist())))
        assert all((u <= caps).all() for u in used.values())
        if caps[1] == 1024:
            assert len(used) <= 1.05 * (lengths * counts).sum() / 1024 + 1


def test_packing_awkward_rows(spark, scratch):
    docs = documents(spark)
    out = packing.pack(docs, PATH, scratch, keep=tuple(docs.columns)).toPandas()
    assert len(out[out["piece"] == 0]) == docs.count()
    assert not packing.pack(empty(spark), PATH, scratch).take(1)


# 6: language ------------------------------------------------------------------------------------


def test_languages_are_told_apart_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = langid.learn_dictionaries(docs.where(~langid.held_out()))
    assert all(0 < len(d) <= 262_144 for d in known.values())
    out = langid.identify(docs, known, keep=("doc_id", "lang", langid.held_out().alias("held_out"))).toPandas()
    assert len(out) == docs.count()
    test = out[out["held_out"]]
    assert (test["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in test["doc_id"]]).all()
    assert (test["lang"] == test["lang_pred"]).mean() > 0.95
    assert out["score"].between(0, 1).all()


def test_language_of_awkward_rows(spark):
    docs = documents(spark)
    known = {"aa": b"w1 w2 w3 w4" * 50, "bb": "déjà vu été".encode() * 50}
    out = {r.doc_id: r for r in langid.identify(docs, known, margin=0.9).collect()}
    assert out[0].lang_pred == out[1].lang_pred == out[2].lang_pred == "und" and out[0].rejected
    assert out[5].lang_pred in known and out[5].rejected
    nothing = langid.identify(docs, langid.learn_dictionaries(docs.where("lang = 'zz'")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert not langid.identify(empty(spark), known).take(1)


def test_whole_texts_count(spark):
    known = {"aa": b"alpha beta gamma delta " * 40, "bb": b"uno dos tres cuatro cinco " * 40}
    rows = [(1, "uno dos tres cuatro cinco " * 3 + "alpha beta gamma delta " * 400, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    assert langid.identify(docs, known, block=64).first().lang_pred == "aa"


def test_labels_of_rows_without_or_with_one_id_are_learned(spark):
    rows = [(None, f"alpha {i}", "aa") for i in range(3000)] + [(5, f"uno {i}", "bb") for i in range(3000)]
    rows += [(None, "tres", "cc")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = langid.learn_dictionaries(docs, dictionary_bytes=1024, snippet=64)
    # of 3000 rows a label about 64 are drawn one by one; equal rows all or none
    assert {"aa", "bb"} <= set(known)
    assert all(20 < known[k].count(b"\n") < 129 for k in ("aa", "bb"))


def test_no_label_is_left_out(spark):
    rows = [(i, f"word{i % 300} of {i}", f"l{i % 300:03}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = langid.learn_dictionaries(docs, all_bytes=300 * 64, snippet=16)
    assert set(known) == {f"l{i:03}" for i in range(300)} and all(len(d) <= 64 for d in known.values())
    with pytest.raises(ValueError, match="300 labels in lang"):
        langid.learn_dictionaries(docs, all_bytes=299 * 16, snippet=16)


def test_labels_and_scores_are_those_of_plain_zstandard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = langid.learn_dictionaries(docs.where(~langid.held_out()))
    got = {r.doc_id: r for r in langid.identify(docs, known).collect()}
    level, block = 6, 4096
    for r in docs.collect():
        if r.text is None or not any(ch.isalpha() for ch in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        raw = r.text.lower().encode()
        sizes = {}
        for name in sorted(known):
            held = zstandard.ZstdCompressionDict(known[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            press = zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_dict_id=False)
            sizes[name] = sum(len(press.compress(raw[i : i + block])) for i in range(0, len(raw), block))
        best = min(sizes, key=lambda k: (sizes[k], k))
        other = min(v for k, v in sizes.items() if k != best)
        assert got[r.doc_id].lang_pred == best
        assert got[r.doc_id].score == pytest.approx(1 - sizes[best] / other, abs=1e-12)


# 7: mixing --------------------------------------------------------------------------------------


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        w = sum(weight[s] for s in order if s not in stopped)
        more = {s for s in order if s not in stopped and 3 * sizes[s] * w < weight[s] * rest}
        if not more:
            return {s: 3.0 * sizes[s] if s in stopped else weight[s] * rest / w for s in order}
        stopped |= more


@pytest.mark.parametrize("block", [7, 1024])
def test_mixture_meets_targets(spark, scratch, block):
    docs = documents(spark)
    mixture, result = mixing.mix(docs, scratch, block=block)
    rows = result.collect()
    assert len(rows) == docs.count()
    source = {}
    sizes = Counter()
    for r in docs.collect():
        n = len((r.text or "").encode().split())
        source[r.doc_id] = r.source
        sizes[r.source] += n
    want = expected_targets(sizes)
    taken = Counter()
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in want)
    slots = mixture.collect()
    assert sum(r.to_word - r.from_word for r in slots) == sum(taken.values())
    blocks = {(r.slot, r["source"], r["pass"], r.block) for r in slots}
    assert sorted(b[0] for b in blocks) == list(range(len(blocks)))
    for r in rows:
        own = [s for s in slots if s.row == r.row]
        assert (r.n_slots, r.first_slot) == (len(own), min((s.slot for s in own), default=None))
    again = mixing.mix(docs, scratch, block=block)[1]
    assert sorted(map(str, again.drop("row").collect())) == sorted(map(str, result.drop("row").collect()))


def points_on(stretches, golden):
    """Sources of slots 0 .. n - 1 by the plain rule; ``stretches`` are (source, blocks due) in order."""
    n, left = sum(d for _, d in stretches), dict(stretches)
    slots = [None] * n
    for i in range(n):
        x = i * golden % 10**18 * n // 10**18
        for name, due in stretches:
            if x < due:
                break
            x -= due
        if left[name]:
            slots[i], left[name] = name, left[name] - 1
    rest = [name for name, _ in stretches for _ in range(left[name])]
    return [s or rest.pop(0) for s in slots]


def test_schedule_is_even(spark, scratch, monkeypatch):
    rows = [(i, " ".join(["w"] * 50), f"s{i % 4}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = expected_targets({f"s{i}": 5000 for i in range(4)})
    # passes of 500 blocks, then the blocks that the rest of the target needs
    due = [(s, int(t) // 5000 * 500 + -(-(int(t) % 5000) // 10)) for s, t in sorted(targets.items())]

    def of_slots():
        mixture, _ = mixing.mix(docs, scratch, block=10)
        return [s for _, s in sorted((r.slot, r["source"]) for r in mixture.select("slot", "source").distinct().collect())]

    def unevenness(order):
        return max(abs(order[:500].count(s) / 500 - w / 7) for s, w in zip(("s0", "s1", "s2", "s3"), (1, 2, 3, 1)))

    order = of_slots()
    assert order == points_on(due, int(mixing.GOLDEN)) and unevenness(order) < 0.02
    # with all points on one place the sources follow each other
    monkeypatch.setattr(mixing, "GOLDEN", "1")
    constant = of_slots()
    assert constant == points_on(due, 1) and unevenness(constant) > 0.4


def test_copies_carry_their_slot(spark, scratch):
    docs = documents(spark)
    mixture, _ = mixing.mix(docs, scratch, block=7)
    out = mixing.mixed_documents(docs, scratch, slot="slot", block=7)
    assert sorted(out.columns) == sorted(docs.columns)  # the clashing column gives way
    slots = {r.slot for r in mixture.select("slot").collect()}
    copies = out.groupBy("doc_id", "text").count().where("doc_id is not null").collect()
    assert copies and {r.slot for r in out.collect()} <= slots
    one = out.where("doc_id = 5").select("slot").collect()
    assert len({r.slot for r in one}) == len(one)


def test_mixing_nothing(spark, scratch):
    mixture, result = mixing.mix(empty(spark), scratch)
    assert not mixture.take(1) and not result.take(1)
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert {(r.size, r.taken, r.target) for r in mixing.mix(blank, scratch)[1].collect()} == {(0, 0, 0.0)}
    assert not mixing.mixed_documents(blank, scratch).take(1)


def test_rows_without_or_with_one_id_are_mixed_one_by_one(spark, scratch):
    rng = random.Random(4)
    rows = [(None, " ".join(["w"] * rng.randint(1, 9)) + f" a{i}", "a") for i in range(30)]
    rows += [(None, " ".join(["w"] * rng.randint(1, 9)) + f" b{i}", "b") for i in range(600)]
    rows += [(7, " ".join(["w"] * rng.randint(1, 9)) + f" c{i}", "c") for i in range(300)] + [(None, "same", "b")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sizes, got = Counter(), Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    times = Counter((r.doc_id, r.text, r.source) for r in mixing.mixed_documents(docs, scratch).collect())
    for (_, text, source), n in times.items():
        got[source] += n * len(text.split())
    want = expected_targets(sizes)
    assert all(abs(got[s] - want[s]) <= 10 for s in want)
    # of the large source a part goes, and it is not that of the short texts
    long = [t for _, t, s in rows if s == "b" and len(t.split()) > 5]
    assert 0 < sum((None, t, "b") in times for t in long) < len(long)


# 8: lines ---------------------------------------------------------------------------------------


def expected_lines(rows, min_sites):
    sites, copies = defaultdict(set), defaultdict(list)
    for n, (doc, text, site) in enumerate(rows):
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.strip():
                sites[line].add(site)
                copies[line].append((doc is not None, doc or 0, n, pos))
    common = {line for line in sites if len(sites[line] - {None}) >= min_sites}
    first = {line: min(copies[line])[2:] for line in common}
    out = []
    for n, (doc, text, _) in enumerate(rows):
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        cut = text.split("\n")
        keep = [line for pos, line in enumerate(cut) if line not in common or first[line] == (n, pos)]
        out.append((doc, "\n".join(keep), len(cut), len(cut) - len(keep)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_sites", [2, 5, 40])
def test_lines_of_many_sites_go(spark, scratch, min_sites):
    rng = random.Random(6)
    rows = [(0, None, "a"), (1, "", "b"), (2, "\n \n", "c"), (3, "same\nsame\nonly", "a"), (3, "same\nsame\nonly", "a")]
    for i in range(4, 200):
        own = [f"own {i}", *(f"shared {k}" for k in range(60) if rng.random() < k / 300), "", "everywhere"]
        rng.shuffle(own)
        rows.append((None if i == 9 else i, "\n".join(own), None if i % 17 == 0 else f"site{i % 50}"))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, lines string, pos int")
    got = lines.dedup_lines(docs, scratch, min_sites=min_sites)
    assert got.columns == ["doc_id", "text", "source", "pos", "lines", "removed"]
    have = sorted(((r.doc_id, r.text, r.lines, r.removed) for r in got.collect()), key=repr)
    assert have == expected_lines(rows, min_sites)


def test_lines_of_rows_without_or_with_one_id(spark, scratch):
    """Every row is a document: one copy of the line stays in all, whatever the keys."""
    rows = [(None, f"top\nown {i}\ntop", f"s{i}", 1, 2, "x") for i in range(12)]
    rows += [(7, f"own {i}\ntop\nmiddle", f"s{i}", 1, 2, "x") for i in range(12)]
    rows += [(None, "top\nown 3\ntop", "s3", 1, 2, "x")] * 40
    schema = "doc_id long, text string, source string, pos int, _of int, site string"
    docs = spark.createDataFrame(rows, schema).repartition(4)
    out = lines.dedup_lines(docs, scratch).collect()
    assert len(out) == len(rows)
    left = Counter(line for r in out for line in r.text.split("\n"))
    assert left["top"] == 1 and left["middle"] == 1 and left["own 3"] == 42 and left["own 5"] == 2
    assert sum(r.removed for r in out) == 12 * 2 + 12 * 2 + 80 - 2
    assert next(r for r in out if "top" in r.text).doc_id is None
    assert all(r.lines == 3 and r["_of"] == 2 and r.site == "x" for r in out)


def test_lines_of_nothing(spark, scratch):
    assert not lines.dedup_lines(empty(spark), scratch).take(1)


# 9: near copies ------------------------------------------------------------------------------


def expected_groups(rows, size, percent=80):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + size]) for i in range(max(len(w) - size, 0) + 1)} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("size, short, block", [(4, 64, 512), (5, 2, 8), (5, 1, 512)])
def test_near_copies_are_those_of_brute_force(spark, scratch, size, short, block):
    rng = random.Random(size)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(rng.randint(1, 120))] for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts(9, 40))]
    passage = [f"p{i}" for i in range(60)]
    for b in base:
        for _ in range(rng.randint(0, 8)):
            w = list(b)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"z{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.2 else "  ".join(w)))
        rows.append((len(rows), " ".join([*b, *passage])))
    rows += [(None, rows[30][1]), rows[31], rows[31]]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, key string").repartition(3)
    got = minhash.link_texts(docs, scratch, shingle=size, short=short, block=block).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == expected_groups(rows, size)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_a_large_group_of_variants_is_one_component(spark, scratch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for k in rng.sample(range(150), 2):
            w[k] = f"v{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in minhash.link_texts(docs, scratch, shingle=4).collect()} == {0}


@pytest.mark.parametrize("short", [8, 1000])
def test_variants_of_all_distances(spark, scratch, short):
    """Copies edited so much that most are no longer linked, with or without their original."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(250):
        w = list(base)
        for k in rng.sample(range(100), rng.randint(1, 25)):
            w[k] = f"v{i}x{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.link_texts(docs, scratch, shingle=4, short=short, block=32).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == expected_groups(rows, 4)


def test_near_copies_of_nothing(spark, scratch):
    assert not minhash.link_texts(empty(spark), scratch).take(1)
    alone = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.link_texts(alone, scratch).orderBy("doc_id").collect()] == [
        (i, 0, i, True) for i in (1, 2, 3)
    ]


def test_matches_threshold_is_documented_chance():
    """A pair at 0.8 has fewer than `matches` equal values with a chance of about one in a million."""
    from math import comb

    assert sum(comb(32, k) * 0.8**k * 0.2 ** (32 - k) for k in range(14)) < 2e-6


