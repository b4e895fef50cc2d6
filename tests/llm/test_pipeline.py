"""Every stage of the pipeline against a plain version of its rule, on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline as cp
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from .test_text_operators import expected_groups, expected_lines, expected_targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return {k: [r.asDict() for r in v.collect()] for k, v in out.items()}


def test_stages_are_those_of_the_plan():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]


def test_columns(stages):
    for name in ("language_id", "line_dedup", "near_dedup", "mixing"):
        assert list(stages[name][0]) == cp.COLUMNS


def test_language_id_keeps_clear_documents(stages):
    before = {r["doc_id"]: r for r in stages["documents"]}
    after = {r["doc_id"]: r for r in stages["language_id"]}
    assert set(after) <= set(before) and len(after) >= 0.97 * len(before)
    assert all(after[i]["text"] == before[i]["text"] for i in after)
    assert sum(after[i]["lang"] == before[i]["lang"] for i in after) > 0.95 * len(after)


def test_line_dedup(stages):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in stages["language_id"]]
    want = [(d, t) for d, t, _, gone in expected_lines(rows, 10) if not gone or t.strip()]
    got = [(r["doc_id"], r["text"]) for r in stages["line_dedup"]]
    assert sorted(got) == sorted(want)
    assert all(r["n_chars"] == len(r["text"]) for r in stages["line_dedup"])


def test_near_dedup_keeps_one_of_each_group(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["line_dedup"]]
    want = sorted(d for d, _, root in expected_groups(rows, 5) if d == root)
    assert sorted(r["doc_id"] for r in stages["near_dedup"]) == want


def test_mixing_repeats_whole_documents(stages):
    before = {r["doc_id"]: r for r in stages["near_dedup"]}
    sizes, words = Counter(), Counter()
    for r in before.values():
        sizes[r["source"]] += len(r["text"].split())
    times = Counter(r["doc_id"] for r in stages["mixing"])
    assert set(times) <= set(before) and max(times.values()) <= 3
    for i, n in times.items():
        words[before[i]["source"]] += n * len(before[i]["text"].split())
    want = expected_targets(sizes)
    largest = defaultdict(int)
    for r in before.values():
        largest[r["source"]] = max(largest[r["source"]], len(r["text"].split()))
    # only the documents at the end of a source's stretch are rounded to whole ones
    assert all(abs(words[s] - want[s]) <= largest[s] + 1 for s in want)


def test_packing_keeps_every_token(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in stages["mixing"])
    assert sum(r["length"] for r in stages["packing"]) == want
    bins = Counter()
    for r in stages["packing"]:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 1024 and len(bins) <= -(-want // 1024) + 1


def test_run_gives_the_last_stage(spark, stages):
    got = Counter(tuple(sorted(r.asDict().items())) for r in cp.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect())
    keys = ("doc_id", "piece", "length", "ids_crc32")
    assert got == Counter(tuple(sorted((k, r[k]) for k in keys)) for r in stages["packing"])


def test_near_dedup_of_rows_without_or_with_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, "alone a b c d e f"), (None, "alone a b c d e f"), (3, text), (4, text + " x"), (3, text), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in cp.near_dedup(spark, docs, SF).collect()), key=repr)
    assert got == sorted([(None, "alone a b c d e f"), (3, text), (5, None), (6, "")], key=repr)


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_of_nothing(spark, name, stage):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert not stage(spark, docs, SF).take(1)
