import base64
import hashlib

import numpy as np
import pytest
from daytrace.llm import lattice, topk, warc
from daytrace.llm.common import Scratch
from daytrace.llm.components import components


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


VECTORS = "vec_id long, embedding array<float>, label int, id string, qb int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "s") for r in rows], VECTORS).repartition(3)


# 2: archive --------------------------------------------------------------------------------------


def test_archive_round_trip(spark, scratch):
    rows = [(1, "http://a", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u\r\nx: y", ""), (4, "u", None), (5, "u", "x" * 200_000)]
    rows += [(6, "u", "<p>é</p>"), (5, "u", "x" * 200_000), (None, "u", "alone"), (None, "u", "<p>é</p>")]
    pages = spark.createDataFrame([(*r, "q", b"z") for r in rows], "page_id long, url string, html string, address string, payload binary")
    path = f"{scratch.folder}/warc"
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in rows})
    out = warc.read_archive(spark, path, payloads=True).collect()
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    assert len(out) == len(rows) and all(r.verified for r in out)
    for r in out:
        html = r.payload.decode()
        assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
        assert r.payload_bytes == len(r.payload)
        revisit = html in first and r.page_id != first[html]
        assert (r.record_type, r.refers_to) == (("revisit", first[html]) if revisit else ("response", None))
    assert sorted((str(r.page_id), r.payload.decode()) for r in out) == sorted((str(i), h or "") for i, _, h in rows)
    records = {r.page_id: r.record for r in warc.record_bytes(warc.read_archive(spark, path, payloads=True)).collect()}
    head, body = records[5].split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and body == b"x" * 200_000 + b"\r\n\r\n"
    assert b"Content-Length: 200000" in head
    assert b"WARC-Refers-To: <urn:record:1>" in records[2] and records[2].endswith(b"\r\n\r\n\r\n\r\n")


def test_small_payloads_are_never_revisits(spark, scratch):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    warc.write_archive(pages, f"{scratch.folder}/warc", smallest=4)
    got = {r.page_id: r.record_type for r in warc.read_archive(spark, f"{scratch.folder}/warc").collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_damaged_payload_is_noticed(spark, scratch):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abcdef")], "page_id long, url string, html string")
    path = f"{scratch.folder}/warc"
    warc.write_archive(pages, path)
    store = spark.read.parquet(f"{path}/payloads").selectExpr("address", "first", "bytes", "if(first = 1, cast('abd' as binary), payload) as payload")
    store.write.parquet(f"{path}2/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}2/headers")
    assert {r.page_id: r.verified for r in warc.read_archive(spark, f"{path}2").collect()} == {1: False, 2: True}


def test_empty_archive(spark, scratch):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(pages, f"{scratch.folder}/warc")
    assert not warc.read_archive(spark, f"{scratch.folder}/warc").take(1)


# 3: top k ------------------------------------------------------------------------------------------


def expected_top(rows, k):
    good = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault(i, []).append([int(np.floor(1024 * float(np.float32(x)))) for x in v])
    out = []
    for q, qs in good.items():
        if q % 100:
            continue
        best = {c: max(sum(a * b for a, b in zip(u, w)) for u in qs for w in ws) for c, ws in good.items() if c != q}
        top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, n + 1, c, s) for n, (c, s) in enumerate(top)]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 1024])
def test_top_k_is_exact(spark, scratch, block):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.choice([0.0, 0.0, 0.5, -0.25, 0.1], 6)], 1) for i in range(250)]
    rows += [rows[7], rows[7], (100, rows[100][1], 2), (300, None, 1), (400, [], 1), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1)]
    rows += [(600, [float("nan")] * 6, 1), (700, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (251, [0.5, 0.5], None)]
    got = topk.top_k(frame(spark, rows), scratch, block=block).collect()
    assert sorted(map(tuple, got)) == expected_top(rows, 10)


def test_top_k_of_few_and_none(spark, scratch):
    few = [(0, [1.0, 2.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, -1.0], 1)]
    got = topk.top_k(frame(spark, few), scratch).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 1024 * 1024), (0, 2, 2, -2048 * 1024)]
    assert not topk.top_k(spark.createDataFrame([], VECTORS), scratch).take(1)


# 4: lattice ---------------------------------------------------------------------------------------


def test_nearest_lattice_point():
    rng = np.random.default_rng(2)
    y = rng.integers(-200, 200, (300, 8))
    near = lattice.nearest(y)
    even = near % 2 == 0
    assert (even.all(1) | (~even).all(1)).all() and (near.sum(1) % 4 == 0).all()
    around = near[:, None, :] + lattice.ROOTS[None]
    d = y[:, None, :] - around * (lattice.GRID // 2)
    assert (lattice.distance(y, near)[:, None] <= (d * d).sum(2)).all()
    assert len(lattice.ROOTS) == 240 and ((lattice.ROOTS**2).sum(1) == 8).all()


def expected_links(rows):
    links = [set() for _ in rows]
    for i, (_, v, lab) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows):
            if i == j or lab is None or lab != other or not v or not w or None in v or None in w or len(v) != len(w):
                continue
            x, y = np.float32(v).astype(float), np.float32(w).astype(float)
            n = np.sqrt((x @ x) * (y @ y))
            if np.isfinite(n) and n > 0 and x @ y / n >= 0.93:
                links[i].add(j)
    out = []
    for i, (vid, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            more = links[todo.pop()] - seen
            seen |= more
            todo += more
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((vid, len(links[i]), least, vid is not None and vid == least))
    return sorted(out, key=repr)


def clustered(rng, groups, spread, d=16):
    rows = []
    for g in range(groups):
        centre = rng.normal(size=d)
        centre /= np.linalg.norm(centre)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), [float(x) for x in centre * 3 + rng.normal(size=d) * rng.uniform(0, spread)], int(g % 2)))
    return rows


@pytest.mark.parametrize("chunk", [4, 512])
def test_links_are_those_of_brute_force(spark, scratch, chunk):
    rng = np.random.default_rng(3)
    rows = clustered(rng, 40, 0.12)
    d = len(rows[0][1])
    rows += [rows[5], rows[5], (900, rows[5][1], None), (901, None, 1), (902, [0.0] * d, 1), (903, [float("nan")] * d, 1)]
    rows += [(904, [1.0, None], 1), (905, [], 0), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (None, rows[6][1], rows[6][2])]
    got = lattice.link_vectors(frame(spark, rows), scratch, chunk=chunk, tables=8).collect()
    assert sorted(map(tuple, got), key=repr) == expected_links(rows)


def test_recall_near_the_threshold(spark, scratch):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(300):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        z = rng.normal(size=64)
        z -= (z @ a) * a
        z /= np.linalg.norm(z)
        cos = rng.uniform(0.931, 0.97)
        rows += [(len(rows), a.tolist(), 1), (len(rows) + 1, (cos * a + np.sqrt(1 - cos * cos) * z).tolist(), 1)]
    got = lattice.link_vectors(frame(spark, rows), scratch).collect()
    want = sum(r[1] for r in expected_links(rows))
    found = sum(r.n_links for r in got)
    assert want >= 600 and 0.99 * want <= found <= want


def test_no_vectors(spark, scratch):
    assert not lattice.link_vectors(spark.createDataFrame([], VECTORS), scratch).take(1)


# components ---------------------------------------------------------------------------------------


def test_components_of_chains_stars_and_loops(spark, scratch):
    key = lambda i: hashlib.md5(str(i).encode()).digest()
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5, 5), (2000, 2001), (2001, 2000)]
    rows = [(bytearray(key(a)), bytearray(key(b))) for a, b in links] + [(None, bytearray(key(3)))]
    got = components(spark.createDataFrame(rows, "a binary, b binary"), scratch).collect()
    root = {bytes(r.node): bytes(r.root) for r in got}
    assert len(root) == 201 + 100 + 2
    assert len({root[key(i)] for i in range(201)}) == len({root[key(1000 + i)] for i in range(100)}) == 1
    assert len(set(root.values())) == 3
