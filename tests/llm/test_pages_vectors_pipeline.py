"""WARC round trips, URL rules, near-duplicate vectors, components and the pipeline."""

import base64
import gzip
import hashlib
import io

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from riverbend.llm import e8, graph, mixing, neardup, packing, toxicity, urlfilter, warc

PAGES = "page_id long, url string, html string"
BIG = "<p>" + "x" * 200 + "</p>"
ODD = [(1, "http://a.net/x", BIG), (2, None, BIG), (3, "https://B.Example.com/de/é?q", BIG), (4, "nothing", "short"), (5, "http://x.org/fr/", "short"), (6, "http://h.net", None), (7, "http://h.net/\r\nX: y", ""), (None, "http://q", "null id" + BIG), (8, "http://q", "é" * 60), (8, "http://q", "é" * 60)]


# ---------------------------------------------------------------- WARC


def test_archives_hold_gzip_members_and_give_pages_back(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = warc.write(pages, f"file://{tmp_path}/w", archive_bytes=20_000)
    assert manifest.count() > 1
    html = {r.page_id: r.html for r in pages.collect()}
    url = {r.page_id: r.url for r in pages.collect()}
    seen = set()
    for m in manifest.collect():
        path = m.archive.removeprefix("file://")
        with open(path, "rb") as f:
            records = list(warc.read_stream(f, path, payloads=True))
        assert len(records) == m.records and gzip.open(path).read().count(b"WARC/1.1\r\n") == m.records
        for r in records:
            seen.add(r["page_id"])
            assert r["url"] == url[r["page_id"]] and r["payload_digest"] == hashlib.sha256(html[r["page_id"]].encode()).hexdigest()
            assert r["record_type"] == "revisit" or r["payload"].decode() == html[r["page_id"]]
    assert seen == set(html)


def test_warc_odd_rows(spark):
    pages = spark.createDataFrame(ODD, PAGES).selectExpr("*", "1 AS digest", "2 AS refers_to")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    n = len(BIG)
    want = [(1, n, "response", None), (2, n, "revisit", 1), (3, n, "revisit", 1), (4, 5, "response", None), (5, 5, "response", None), (6, 0, "response", None), (7, 0, "response", None), (None, n + 7, "response", None), (8, 120, "response", None), (8, 120, "response", None)]
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


@given(st.lists(st.binary(max_size=300).map(lambda b: b * 40), max_size=5), st.integers(1, 700))
@settings(max_examples=40, deadline=None)
def test_members_in_small_steps(payloads, step):
    data = b"".join(warc.member(p) for p in payloads)
    assert [b"".join(s) for _, s in warc.Members(io.BytesIO(data), step)] == payloads


def test_urls_of_several_megabytes(spark):
    url = "http://a.net/" + "".join(map(str, np.random.default_rng(0).integers(0, 10, 3_000_000)))
    pages = spark.createDataFrame([(1, url, BIG), (2, "http://a.net/", BIG)], PAGES)
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert got == [(1, len(BIG), "response", None), (2, len(BIG), "revisit", 1)]
    data = warc.member(warc.record(1, url, b"p", None, hashlib.sha256(b"p").hexdigest()))
    assert list(warc.read_stream(io.BytesIO(data)))[0]["url"] == url


def test_damage_is_found():
    good = warc.record(1, "u", b"payload", None, hashlib.sha256(b"payload").hexdigest())
    assert list(warc.read_stream(io.BytesIO(warc.member(good))))[0]["payload_bytes"] == 7
    for bad in (good.replace(b"payload\r\n", b"pAyload\r\n"), good + b"x", good[:-6], good.replace(b"WARC/1.1", b"NONE/1.1")):
        with pytest.raises(ValueError):
            list(warc.read_stream(io.BytesIO(warc.member(bad))))
    with pytest.raises(ValueError):
        list(warc.read_stream(io.BytesIO(warc.member(good)[:-10])))


def foreign(kind, block=b"", **head):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{k.replace('_', '-')}: {v}" for k, v in head.items()), f"Content-Length: {len(block)}"]
    return warc.member(("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n")


def test_archives_of_other_writers():
    page = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>text</p>"
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(b"<p>text</p>").digest()).decode()
    records = [
        foreign("revisit", WARC_Payload_Digest=sha1),
        foreign("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
        foreign("response", page, WARC_Payload_Digest=sha1, WARC_Target_URI="http://a.net/"),
        foreign("revisit", b"", Content_Type="application/http", WARC_Payload_Digest=sha1),
        foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", Content_Type="application/http; msgtype=request"),
        foreign("metadata", b"a: b", Content_Type="application/warc-fields"),
        foreign("response", page.replace(b"X: y", b"Content-Length: 99\r\nTransfer-Encoding: chunked")),
    ]
    got = list(warc.read_stream(io.BytesIO(b"".join(records)), payloads=True))
    assert [r["record_type"] for r in got] == ["revisit", "warcinfo", "response", "revisit", "request", "metadata", "response"]
    assert [r["payload_bytes"] for r in got] == [None, 13, 11, None, 0, 4, 11]
    assert got[2]["payload"] == b"<p>text</p>" and got[2]["url"] == "http://a.net/" and got[3]["payload_digest"] == sha1
    for bad in (foreign("response", page, WARC_Payload_Digest=sha1.replace("A", "B").replace("C", "D")), foreign("response", page, WARC_Block_Digest="md5:00"), warc.member(b"WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.read_stream(io.BytesIO(bad)))


def test_a_head_without_end_is_not_held(monkeypatch):
    monkeypatch.setattr(warc, "HEAD", 1 << 20)
    monkeypatch.setattr(warc, "HTTP_HEAD", 1 << 20)
    for bad in (warc.member(b"WARC/1.0\r\n" + b"x" * (8 << 20)), foreign("response", b"HTTP/1.1 200 OK\r\n" + b"x" * (8 << 20)), warc.member(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 0\r\n\r\n" + b"x" * (8 << 20))):
        with pytest.raises(ValueError):
            list(warc.read_stream(io.BytesIO(bad)))


# ---------------------------------------------------------------- URL rules


def plain_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut].translate(brute.LOWER), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(h + p) for _, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    verdict = {h + p: v for v, h, p in urlfilter.RULES}
    for r in urlfilter.annotate(pages, columns=("page_id", "url")).collect():
        assert (r.host, r.path, r.rule) == plain_rule(r.url, urlfilter.RULES)
        assert r.verdict == verdict.get(r.rule, "allow")


def test_url_odd_rows(spark):
    urls = [None, "", "a.net/x", "http://net/", "http://NET/x", "ftp://x.net", "http://xnet/", "http://a.example.net/en/", "http://a.example.net/en", "http://u@h:80/?q", "a://b://c.net/", "http://ex.org/fr/\nx", "http://.net/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] * 2, PAGES)
    for r in urlfilter.annotate(pages, columns=("page_id", "url")).collect():
        assert (r.host, r.path, r.rule) == plain_rule(r.url, urlfilter.RULES), r
    assert urlfilter.annotate(pages.limit(0)).count() == 0
    assert {r.verdict for r in urlfilter.annotate(pages, []).collect()} == {"allow"}


def test_url_columns_with_the_names_of_results(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "mine", "p", "r", "v", "_")], "page_id long, url string, host string, path string, rule string, Verdict string, _host string")
    got = urlfilter.annotate(pages, columns=pages.columns)
    assert got.columns == ["page_id", "url", "_host", "host", "path", "rule", "verdict"]
    assert got.first().asDict() == {"page_id": 1, "url": "http://a.net/x", "_host": "_", "host": "a.net", "path": "/x", "rule": "net/", "verdict": "block"}


def test_hosts_of_very_many_labels(spark):
    hosts = ["a." * 200_000 + "net", "." * 200_000, "x" * 200_000 + ".example.com"]
    pages = spark.createDataFrame([(i, f"http://{h}/de/x") for i, h in enumerate(hosts)], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in urlfilter.annotate(pages).orderBy("page_id").collect()] == [("net/", "block"), (None, "allow"), ("example.com/de/", "block")]


def test_colliding_digests_are_confirmed(tmp_path):
    same = lambda b: 7
    urlfilter.DigestArray.build(urlfilter.RULES, str(tmp_path), "r", same)
    array = urlfilter.DigestArray(str(tmp_path), "r")
    rules, verdicts = urlfilter.judge(array, ["a.net", "example.net", "b.com"], ["/", "/en/x", "/"], digest=same)
    assert rules == ["net/", "example.net/en/", None] and verdicts == ["block", "allow", "allow"]


# ---------------------------------------------------------------- vectors


def test_nearest_lattice_point_is_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * 2
    p = e8.nearest(x) / 2
    own = ((x - p) ** 2).sum(1)
    for v in e8.MINIMAL / 2:
        assert (((x - p - v) ** 2).sum(1) >= own - 1e-9).all()
    assert len(e8.MINIMAL) == 240 and own.max() <= 1 + 1e-9
    next_ = e8.around(x, e8.nearest(x), 3) / 2
    d = ((x[:, None] - next_) ** 2).sum(2)
    every = np.sort([((x - p - v) ** 2).sum(1) for v in e8.MINIMAL / 2], axis=0)[:3].T
    assert d == pytest.approx(every)


def at_angle(rng, u, cos):
    z = rng.normal(size=u.shape)
    z -= (z * u).sum(1, keepdims=True) * u
    return cos * u + np.sqrt(1 - cos**2) * z / np.linalg.norm(z, axis=1, keepdims=True)


def vectors(n=300, seed=6):
    rng = np.random.default_rng(seed)
    u = rng.normal(size=(n, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    crowd = at_angle(rng, np.repeat(u[:1], 150, axis=0), 0.985)  # one crowded group, most pairs above 0.95
    return np.vstack([u, at_angle(rng, u, 0.951), at_angle(rng, u, 0.99) * 7, at_angle(rng, u, 0.94), crowd])


def plain_near(x, threshold=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("block", [16, 256])
def test_near_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    x = vectors()
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[i].tolist()) for i in range(20)], "vec_id long, embedding array<double>").repartition(3)
    both = np.vstack([x, x[:20]])
    ids = [*range(len(x)), *range(5000, 5020)]
    near = plain_near(both)
    got = {r.vec_id: r for r in neardup.near_vectors(table).collect()}
    n = np.array([got[i].n_links for i in ids])
    assert (n <= near.sum(1)).all() and n.sum() >= 0.97 * near.sum()
    comp = brute.components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    assert np.mean([got[i].component_id == comp[i] for i in ids]) > 0.95
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)


def test_recall_at_the_threshold_in_64_dimensions_with_crowded_cells(spark):
    """Pairs at 0.95 to 0.96, and a cell of many vectors around one direction."""
    rng = np.random.default_rng(4)
    u = rng.normal(size=(700, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    x = np.vstack([u, *(at_angle(rng, u, c) for c in (0.9501, 0.953, 0.956, 0.96)), at_angle(rng, np.repeat(u[:1], 900, axis=0), 0.97), at_angle(rng, u, 0.949)])
    near = plain_near(x)
    got = {r.vec_id: r.n_links for r in neardup.near_vectors(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(4)).collect()}
    n = np.array([got[i] for i in range(len(x))])
    assert (n <= near.sum(1)).all() and n.sum() >= 0.97 * near.sum()
    single = np.arange(700, 3500)  # those made from one other vector
    assert n[single].sum() >= 0.97 * near.sum(1)[single].sum()


def test_cells_of_several_blocks_keep_the_recall(spark, monkeypatch):
    """The layout of very many vectors, on few."""
    monkeypatch.setattr(neardup, "MEET", 1e-6)
    tables, blocks, width = neardup.layout(2000)
    assert blocks > 1 and tables <= 150 and width > 1
    x = vectors()
    near = plain_near(x)
    got = {r.vec_id: r.n_links for r in neardup.near_vectors(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")).collect()}
    n = np.array([got[i] for i in range(len(x))])
    assert (n <= near.sum(1)).all() and n.sum() >= 0.97 * near.sum()


@pytest.mark.parametrize("n", [1, 500, 50_000, 10**6, 10**8, 10**10])
def test_layout_grows_slowly(n):
    tables, blocks, width = neardup.layout(n)
    met = neardup.meeting(width, blocks)
    assert 1 - (1 - met) ** tables >= neardup.RECALL and tables <= 10 * (max(n, 10_000) / 10_000) ** 0.2 + 10


def test_vector_odd_rows(spark):
    v = [1.0, 0.0, 2.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [float("nan"), 1.0, 0.0]), (6, [float("inf"), 1.0, 0.0]), (7, v), (8, [10.0, 0.0, 20.0]), (9, v), (9, v), (10, [1.0, 0.0]), (None, v), (11, [1e200, 0.0, 2e200]), (12, [-1.0, 0.0, -2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS label", "2 AS node")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in neardup.near_vectors(table).collect()), key=str)
    want = [(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 10, 12)] + [(i, 5, 7) for i in (7, 8, 9, 9, 11, None)]
    assert got == sorted(want, key=str)
    assert neardup.near_vectors(table.limit(0)).count() == 0


# ---------------------------------------------------------------- components


@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
@settings(max_examples=6, deadline=None)
def test_components(spark, edges):
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    got = {r.node: r.root for r in graph.components(df).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    want = brute.components(linked, [e for e in edges if e[0] != e[1]])
    assert set(got) == linked
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in linked for b in linked)


def test_a_long_path_is_one_component(spark):
    df = spark.range(400).selectExpr("id AS a", "id + 1 AS b")
    assert graph.components(df).select("root").distinct().count() == 1


# ---------------------------------------------------------------- pipeline


def test_pipeline_against_plain_stages(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.3").collect()}
    left = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in bad]
    keep = {k for k, _ in brute.exact(left).values()}
    left = [x for x in left if x[0] in keep]
    near = {i: c for i, (_, c) in brute_near(left).items()}
    left = {i for i, _ in left if near[i] == i}
    mixed = mixing.plan(docs.where(docs.doc_id.isin(*left)))
    taken = {r.doc_id: r.copies for r in mixed.collect()}
    got = corpus_pipeline.run(spark, d)
    assert {r.doc_id: r["count"] for r in got.where("start = 0").groupBy("doc_id").count().collect()} == {i: n for i, n in taken.items() if n}
    pieces = got.toPandas()
    for _, g in pieces.groupby("sequence_id"):
        n = int(g.length.sum())
        assert n <= packing.CAPACITY and n & (n - 1) == 0
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near copies", "mixing", "packing"]


def brute_near(rows):
    """As brute.near with five words and 0.8, comparing only sets that share a shingle."""
    sets = {i: brute.shingles(t, 5) for i, t in rows}
    owners = {}
    pairs = set()
    for i, s in sorted(sets.items()):
        for g in s:
            for j in owners.setdefault(g, []):
                pairs.add((j, i))
            owners[g].append(i)
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = brute.components(sets, links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


