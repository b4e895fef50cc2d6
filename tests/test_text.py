from pyspark.sql import functions as F
import pytest

from daytrace.operators import claims as cm
from daytrace.operators import privacy as pv


@pytest.mark.parametrize(
    "text, want",
    [
        ("two hours of writing", []),
        ("see https://x.y", ["url", "path_separator"]),
        ("visit Example.COM today", ["url"]),
        ("me@home", ["email_shaped"]),
        ("call 5551234", ["long_digit_run"]),
        ("a\\b", ["path_separator"]),
        ("k9Zq3xT7bN1mW5vR8cL2pD6sF4gH0jYe", ["high_entropy_token"]),
        ("a" * 40, []),
        ("word " * 101, ["too_long"]),
    ],
)
def test_scan(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(pv.violations(F.col("t")).alias("v"))
    assert df.first().v == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("no numbers", True), ("120 minutes", True), ("121 minutes", True), ("130 minutes", False),
        ("42% of the day", True), ("0.42", True), ("43.5%", False), ("-3 change", False),
    ],
)
def test_grounded(spark, text, want):
    ctx = F.array(F.lit(120.0), F.lit(0.42))
    df = spark.createDataFrame([(text,)], "t string").select(cm.numbers_grounded(F.col("t"), ctx).alias("g"))
    assert df.first().g is want


@pytest.mark.parametrize(
    "path, want",
    [("a", True), ("a.b", True), ("a.c", True), ("a.d", False), ("l[1].x", True), ("l[2]", False), ("", False), ("a.b.c", False)],
)
def test_paths(spark, path, want):
    doc = '{"a":{"b":1,"c":null},"l":[0,{"x":2}]}'
    df = spark.createDataFrame([(doc, path)], "d string, p string")
    assert df.select(cm.path_resolves(F.col("d"), F.col("p")).alias("r")).first().r is want


def test_rejected_terms(spark):
    df = spark.createDataFrame([("Burnout risk",), ("disorderly",)], "t string")
    assert [r.x for r in df.select(cm.has_rejected_term(F.col("t")).alias("x")).collect()] == [True, False]


def test_gate(spark):
    df = spark.createDataFrame([('{"minutes":3,"goals":[{"name":"a@b","secret":1}]}',)], "payload string")
    r = pv.gate(pv.walk_payloads(df, "payload", ["minutes", "goals", "name"])).first()
    assert (r.outcome, r.rejected_fields, r.key_count) == ("rejected", ["goals[0].name", "goals[0].secret"], 4)


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://a.b.example.com/x", "example.com"), ("http://shop.co.uk:80/", "shop.co.uk"), ("http://co.uk/", None),
        ("http://127.0.0.1/x", None), ("http://localhost/", None), ("https://X.Example.org/", "x.example.org"),
    ],
)
def test_domain(spark, url, want):
    suffixes = spark.createDataFrame([("com",), ("org",), ("uk",), ("co.uk",), ("example.org",)], "suffix string")
    df = spark.createDataFrame([(1, url)], "id int, url string")
    assert pv.registrable_domain(df, "url", suffixes).first().domain == want


def test_suffix_rules_of_every_kind(spark):
    rules = ["com", "com.au", "jp", "co.jp", "*.kobe.jp", "!city.kobe.jp", "*.ck", "!www.ck", "CO.UK ", "", "com"]
    cases = {
        "https://a.com.au/x": "a.com.au", "https://deep.a.com.au": "a.com.au", "https://b.co.jp": "b.co.jp", "https://com.au": None,
        "https://x.y.kobe.jp": "x.y.kobe.jp", "https://y.kobe.jp": None, "https://city.kobe.jp": "city.kobe.jp",
        "https://w.city.kobe.jp": "city.kobe.jp", "https://kobe.jp": "kobe.jp", "https://www.ck": "www.ck", "https://a.www.ck": "www.ck",
        "https://shop.ck": None, "https://b.shop.ck": "b.shop.ck", "https://q.unlisted": "q.unlisted", "https://A.Co.Uk.": "a.co.uk",
        "https://10.0.0.1/": None, "https://localhost": None, "no url": None, None: None,
    }
    pages = spark.createDataFrame([(u,) for u in cases] + [("https://a.com.au/x",)], "url string")
    got = pv.registrable_domain(pages, "url", spark.createDataFrame([(r,) for r in rules], "suffix string"))
    rows = [(r.url, r.domain) for r in got.collect()]
    assert len(rows) == len(cases) + 1 and dict(rows) == cases


def test_numbers_of_whole_documents(spark):
    deep = "[" * 30 + "-4.5" + "]" * 30
    cases = {
        '{"a":1,"b":{"c":[true,null,-3,"7"],"d":1e3}}': [1.0, -3.0, 1000.0],
        '{"k9":"x\\\\","n":2.5,"q":"a \\"8\\" b"}': [2.5],
        '["' + "9 " * 20_000 + '", 6]': [6.0],
        '{"line":"1\\n2","m":0.02}': [0.02],
        deep: [-4.5], "3": [3.0], '"3"': [], "{}": [], "{broken 5": [], "": [], None: [],
    }
    df = spark.createDataFrame([(d,) for d in cases], "doc string")
    got = {r.doc: r.n for r in df.select("doc", cm.document_numbers(F.col("doc")).alias("n")).collect()}
    assert got == cases


def test_digits_of_any_script_are_numbers(spark):
    df = spark.createDataFrame([("\u0663\u0660 minutes",), ("\uff13\uff11 minutes",), ("30 minutes",), ("none",), ("\U0001d7db\U0001d7d8",)], "t string")
    got = [r[0] for r in df.select(cm.numbers_grounded(F.col("t"), F.array(F.lit(30.0)))).collect()]
    assert got == [True, False, True, True, True]


def test_payloads_are_handed_on_in_blocks_of_bytes(spark, monkeypatch):
    assert list(pv.blocks([3, 3, 9, 1, 1], 6)) == [(0, 2), (2, 3), (3, 5)]
    assert list(pv.blocks([], 6)) == []
    monkeypatch.setattr(pv, "BLOCK_BYTES", 30)
    texts = ['{"name": "a", "x": [{"name": "b"}]}', None, "{broken", '{"n": 1}', ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, payload string").coalesce(1)
    got = [tuple(r) for r in pv.walk_payloads(df, "payload", ["name"]).drop("payload").orderBy("i").collect()]
    assert [(g[0], g[1], g[3], g[4]) for g in got] == [
        (0, ["x"], 3, '{"name":"a","x":[{"name":"b"}]}'), (1, [], None, None), (2, [], None, "{broken"),
        (3, ["n"], 1, '{"n":1}'), (4, [], None, ""),
    ]
    assert [tuple(x) for x in got[0][2]] == [("name", "a"), ("x[0].name", "b")]
