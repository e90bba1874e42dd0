"""Operators on documents against plain re-statements, and their defined results in odd cases."""

import contextlib
import functools
import os
import random
import re
import threading
import time
import zlib

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riverbend.llm import bytewords, dedup, jaccard, mixing, packing, quality, tokencount, toxicity
from riverbend.llm.queries import QUERIES
from riverbend.llm.sql import ORACLE

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n", "en", "b", 3),
    (4, "One two three four FIVE six", "en", "a", 27),
    (5, "one  two three\nfour five six", "en", None, 28),
    (6, "one two three", "en", "a", 13),
    (7, "x" * 70_000 + " é " + "word " * 3000, "fr", "b", None),
    (4, "One two three four FIVE six", "en", "a", 27),
    (8, "naïve ☃ café 日本語 <|endoftext|> end", None, "é", 1),
    (None, "no id at all here", "en", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(1) for c in ("size", "target", "copies", "digest", "score", "_row", "_id", "_key", "node", "block")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def near_copies(n=260, seed=2):
    """Texts with groups of copies that differ in a few words, a common passage, and chains of neighbours."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocab) for _ in range(60)]
    base = [rng.choice(vocab) for _ in range(120)]
    out = []
    for i in range(n):
        kind = i % 5
        if kind in (0, 1):  # one large group around a base
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
        elif kind == 2:
            t = passage + [rng.choice(vocab) for _ in range(rng.randrange(1, 40))]
        elif kind == 3:
            t = [rng.choice(vocab) for _ in range(rng.randrange(0, 9))]
        else:  # each a little further along
            t = base[: 60 + i // 5] + passage[: 50 - i // 6]
        out.append((i, " ".join(t)))
    return out


# ---------------------------------------------------------------- words


@given(st.lists(st.text(alphabet=st.sampled_from("ab AB\t\né.☃"), max_size=30), max_size=8))
@settings(max_examples=80, deadline=None)
def test_spans_are_the_words(texts):
    got = bytewords.Spans(pa.array(texts, pa.string()), (2,), (2,))
    words = [got.data[a:b].tobytes().decode() for a, b in zip(got.start, got.end, strict=True)]
    assert words == [w for t in texts for w in brute.words(t)]
    assert list(got.doc) == [i for i, t in enumerate(texts) for _ in brute.words(t)]
    same = {}
    for w, h in zip(words, got.hash.tolist(), strict=True):
        assert same.setdefault(w.translate(brute.LOWER), h) == h
    assert len(set(same.values())) == len(same)


def test_spans_across_slices():
    texts = ["ab " * 200_000, "z" * 600_000 + " ab"]
    got = bytewords.Spans(pa.array(texts))
    assert len(got.hash) == 200_002 and len(set(got.hash[:200_000].tolist())) == 1 and got.hash[-1] == got.hash[0]


# ---------------------------------------------------------------- mixing


def test_mixing_targets_and_shares(spark, docs):
    got = mixing.plan(docs).toPandas()
    sizes = got.groupby("source", dropna=False)["size"].sum().to_dict()
    want = brute.targets(sizes)
    for s, g in got.groupby("source", dropna=False):
        assert g.target.iloc[0] == pytest.approx(want[s])
        assert abs(g.taken.sum() - want[s]) <= g["size"].max() + 1
        assert (g.taken <= 3 * g["size"]).all() and (g.source_size == g["size"].sum()).all()
    again = mixing.plan(docs.repartition(7)).toPandas()
    assert sorted(zip(got.doc_id, got.taken, strict=True)) == sorted(zip(again.doc_id, again.taken, strict=True))


@given(st.lists(st.integers(0, 50), min_size=1, max_size=6))
@settings(max_examples=25, deadline=None)
def test_targets_share_everything(sizes):
    want = brute.targets({f"s{i}": n for i, n in enumerate(sizes)})
    assert sum(want.values()) == pytest.approx(sum(sizes))


def test_targets_where_one_source_is_small(spark):
    src = spark.createDataFrame([("0a", 10), ("0b", 1000), ("0c", 500), ("1", 0)], "_src string, source_size long")
    got = {r._src: r.target for r in mixing.targets(src).collect()}
    want = brute.targets({"0a": 10, "0b": 1000, "0c": 500, "1": 0})
    assert got == pytest.approx(want)


def test_mixing_odd_rows(spark, odd):
    got = mixing.plan(odd).toPandas()
    assert len(got) == len(ODD) and got[got.doc_id == 1]["size"].iloc[0] == 0 and got[got.doc_id == 4]["size"].tolist() == [6, 6]
    out = mixing.sample(odd)
    assert out.columns == odd.columns and out.count() == got.copies.sum()
    assert mixing.plan(empty(spark)).count() == 0 and mixing.sample(empty(spark)).count() == 0


@pytest.mark.parametrize("per_group", [2, 60, 20_000])
def test_mixing_gives_what_its_sql_gives(spark, monkeypatch, per_group):
    """Classes of many sizes, as on sf0.1, and groups parted at every level."""
    monkeypatch.setattr(mixing, "PER_GROUP", per_group)
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.1/documents.parquet')")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, size, source_size, taken FROM ({ORACLE['op1_mixing']})").fetchall()}
    got = {r.doc_id: (r["size"], r.source_size, r.taken) for r in QUERIES["op1_mixing"](spark, "/root/testdata/sf0.1").collect()}
    assert got == want


# ---------------------------------------------------------------- packing


def check_packing(pieces, docs, capacity=1024):
    encoder = packing.Encoder(packing.default_tokenizer()[0])
    ids = {i: np.append(np.array(encoder.main.encode(t or "", add_special_tokens=False).ids, "<u4"), np.uint32(0)).astype("<u4") for i, t in docs}
    for i, g in pieces.groupby("doc_id"):
        g = g.sort_values("start")
        assert g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() == len(ids[i]) == g.doc_tokens.iloc[0]
        for p in g.itertuples():
            assert zlib.crc32(ids[i][p.start : p.start + p.length].tobytes()) == p.ids_crc32
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        total = int(g.length.sum())
        assert total <= capacity and total & (total - 1) == 0
    assert set(pieces.doc_id) == set(ids)


def test_packing_is_exact_and_full(docs, rows):
    check_packing(packing.pack(docs).toPandas(), rows)


def test_packing_odd_rows(spark, odd):
    kept = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_packing(packing.pack(kept).toPandas(), [(r.doc_id, r.text) for r in kept.collect()])
    assert packing.pack(odd).where("start = 0").count() == len(ODD)
    assert packing.pack(empty(spark)).count() == 0


def test_long_texts_are_cut_safely(monkeypatch):
    encoder = packing.Encoder(*packing.default_tokenizer())
    text = "It's a  test,\n\n of   cuts ☃ and <|endoftext|> more. " * 200
    whole = encoder.ids(text)
    monkeypatch.setattr(packing, "SLICE", 97)
    assert (encoder.ids(text) == whole).all()
    assert (whole == encoder.main.encode(text, add_special_tokens=False).ids).all()


@given(st.integers(1, 5000))
def test_cuts(n):
    pieces = packing.cuts(n)
    assert sum(x for _, x in pieces) == n and all(x & (x - 1) == 0 and x <= 1024 for _, x in pieces)


# ---------------------------------------------------------------- token counts


def test_token_counts_against_offsets(docs, rows):
    got = tokencount.count(docs).toPandas()
    main = packing.Encoder(packing.default_tokenizer()[0]).main
    for i, text in rows[:60]:
        e = main.encode(text, add_special_tokens=False)
        g = got[got.doc_id == i].sort_values("section")
        assert g.tokens.sum() == len(e.ids) == g.doc_tokens.iloc[0] and g.end.iloc[-1] == len(text)
        assert [text[a:b] for a, b in zip(g.start, g.end, strict=True)] == [x for x in text.splitlines(keepends=True)] or "\r" in text or "\x0b" in text
        if text.isascii():
            starts = np.searchsorted(g.start.to_numpy(), [a for a, _ in e.offsets], side="right") - 1
            assert g.tokens.tolist() == np.bincount(starts, minlength=len(g)).tolist()


TOKENS = ["first", "last", "most"]


def plain_allocation(text, offsets, sections, rule):
    """Tokens of each interval, one token and one interval after the other; offsets of tokens in bytes."""
    chars = [len(text[:i].encode()) for i in range(len(text) + 1)]
    spans = [(chars[min(a, len(text))], chars[min(max(a, b), len(text))]) for a, b in sections]
    out = [0] * len(sections)
    for a, b in offsets:
        first = max(c for c in chars if c <= a)
        if rule == "most":
            share = [(min(b, t) - max(first, s), -s, -k) for k, (s, t) in enumerate(spans)]
            best = max((x for x in share if x[0] > 0), default=None)
            if best:
                out[-best[2]] += 1
        else:
            for k, (s, t) in enumerate(spans):
                out[k] += s <= (first if rule == "first" else b - 1) < t
    return out


@given(st.lists(st.sampled_from(["naïve café", "日本語 テキスト", "☃☃", "plain words, and more", " \t\n", "né", "🙂🙃 x"]), min_size=1, max_size=5), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=6), st.sampled_from(TOKENS))
@settings(max_examples=120, deadline=None)
def test_sections_with_gaps_and_overlaps_in_any_script(parts, sections, rule):
    text = " ".join(parts)
    data, lengths = np.frombuffer(text.encode(), np.uint8), SIZES()[np.array(ENCODER().encode(text, add_special_tokens=False).ids)]
    end = np.cumsum(lengths)
    starts, stops = tokencount.sections_of(data, [{"start": a, "end": b} for a, b in sections])
    assert tokencount.allocate(data, lengths, starts, stops, rule).tolist() == plain_allocation(text, list(zip(end - lengths, end, strict=True)), sections, rule)
    assert list(zip(tokencount.chars_before(data, starts), tokencount.chars_before(data, stops), strict=True)) == [(min(a, len(text)), min(max(a, b), len(text))) for a, b in sections]


@functools.cache
def SIZES():
    return tokencount.token_bytes(packing.default_tokenizer()[0])


@functools.cache
def ENCODER():
    return packing.Encoder(packing.default_tokenizer()[0]).main


def test_token_counts_of_lines_in_any_script(spark):
    texts = ["日本語\nテキスト ☃\n\nnaïve café\n", "🙂\n🙃🙃", "é" * 50 + "\n" + "☃ " * 30, "\n\n", "a\rb\x0bc\n d"]
    got = tokencount.count(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    sizes = tokencount.token_bytes(packing.default_tokenizer()[0])
    for i, t in enumerate(texts):
        g = got[got.doc_id == i].sort_values("section")
        want = re.findall(r"[^\n]*\n|[^\n]+", t)
        assert [t[a:b] for a, b in zip(g.start, g.end, strict=True)] == want
        lengths = sizes[np.array(ENCODER().encode(t, add_special_tokens=False).ids)]
        end = np.cumsum(lengths)
        spans = np.cumsum([0, *map(len, want)]).tolist()
        assert g.tokens.tolist() == plain_allocation(t, list(zip(end - lengths, end, strict=True)), list(zip(spans, spans[1:], strict=False)), "first")


def test_token_counts_of_fields(spark):
    docs = spark.createDataFrame([(1, "Título", None, "el cuerpo"), (2, "", "b", "c ☃")], "doc_id long, title string, note string, body string")
    whole = tokencount.with_fields(docs, ["title", "note", "body"], " | ")
    texts = {r.doc_id: r.text for r in whole.collect()}
    got = tokencount.count(whole, sections="sections").collect()
    assert texts[1] == "Título |  | el cuerpo" and [texts[1][r.start : r.end] for r in got if r.doc_id == 1] == ["Título", "", "el cuerpo"]
    assert all(sum(r.tokens for r in got if r.doc_id == i) < next(r.doc_tokens for r in got if r.doc_id == i) for i in (1, 2))
    odd = spark.createDataFrame([(1, "one two", None), (2, "one two", []), (3, "one two", [(None, 3), (5, 2), (-4, 99)]), (4, None, [(0, 5)])], "doc_id long, text string, s array<struct<start:long,end:long>>")
    assert [(r.doc_id, r.start, r.end, r.tokens) for r in tokencount.count(odd, sections="s").orderBy("doc_id", "section").collect()] == [(3, 0, 0, 0), (3, 5, 5, 0), (3, 0, 7, 2), (4, 0, 0, 0)]


def test_boundary_rules():
    lengths, starts = np.array([2, 4, 1]), np.array([0, 3, 5])
    assert tokencount.attribute(lengths, starts, "first").tolist() == [2, 0, 1]
    assert tokencount.attribute(lengths, starts, "last").tolist() == [1, 0, 2]
    assert tokencount.attribute(lengths, starts, "most").tolist() == [1, 1, 1]
    with pytest.raises(ValueError):
        tokencount.attribute(lengths, starts, "none")


def test_token_counts_odd_rows(spark, odd):
    got = tokencount.count(odd).toPandas()
    assert got[got.doc_id.isin([1, 2])].tokens.tolist() == [0, 0] and len(got[got.section == 0]) == len(ODD)
    assert tokencount.count(empty(spark)).count() == 0


# ---------------------------------------------------------------- exact dedup


def test_exact_dedup(docs, rows):
    want = brute.exact(rows)
    for r in dedup.groups(docs).collect():
        assert (r.keep_id, r.group_size) == want[r.doc_id] and r.kept == (r.keep_id == r.doc_id)
    kept = dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k for k, _ in want.values()})


def test_exact_dedup_odd_rows(spark, odd):
    got = {(r.doc_id, r.keep_id, r.group_size) for r in dedup.groups(odd).collect()}
    assert {(1, 3, 3), (2, 3, 3), (3, 3, 3), (4, 4, 2), (None, None, 1)} <= got
    kept = dedup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 8]
    assert dedup.groups(empty(spark)).count() == 0 and dedup.keep_one(empty(spark)).count() == 0


def test_cuckoo_index_with_insertions_and_deletions():
    rng = random.Random(4)
    index, model = dedup.CuckooIndex(2), {}
    keys = [rng.randbytes(32) for _ in range(3000)]
    for step in range(20_000):
        k = rng.choice(keys)
        if rng.random() < 0.3:
            assert index.delete(k) == (model.pop(k, None) is not None)
        else:
            index.put(k, step)
            model[k] = step
        if step % 4000 == 0:
            assert dict(index.items()) == model
    assert dict(index.items()) == model and len(index) == len(model)
    assert index.mask + 1 > 2  # overflow made it larger
    assert all(index.get(k) == model.get(k) and (k in index) == (k in model) for k in keys)


def test_withdrawn_texts_leave_the_index(spark, monkeypatch):
    monkeypatch.setattr(dedup, "FLUSH", 3)
    docs = spark.createDataFrame([(i, f"text {i % 7}" + " " * (i % 3)) for i in range(40)], "doc_id long, text string").repartition(5)
    gone = spark.createDataFrame([("text3",), ("text 5 ",), ("no such text",)], "text string")
    every = {r.doc_id: r for r in dedup.groups(docs).collect()}
    for r in dedup.groups(docs, gone).collect():
        if r.doc_id % 7 in (3, 5):
            assert (r.keep_id, r.group_size, r.kept) == (None, None, False)
        else:
            assert r == every[r.doc_id]


def test_of_several_texts_under_one_id_the_longest_stays(spark):
    docs = spark.createDataFrame([(4, "ab"), (4, "a b"), (5, "a  b"), (3, "ab"), (5, "ab")], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in dedup.keep_one(docs).collect()] == [(5, "a  b")]
    assert [(r.doc_id, r.text) for r in dedup.keep_one(docs.where("doc_id = 4")).collect()] == [(4, "a b")]


def test_many_keys_with_equal_leading_bytes_end():
    index = dedup.CuckooIndex(2)
    keys = [b"\7" * 10 + bytes([i]) * 22 for i in range(60)]
    for i, k in enumerate(keys):
        index.put(k, i)
    assert [index.get(k) for k in keys] == list(range(60)) and index.delete(keys[9]) and keys[9] not in index and len(index) == 59


def test_equal_fingerprints_are_told_apart():
    index = dedup.CuckooIndex(2)
    a, b = b"\0" * 32, b"\0" * 31 + b"\1"  # same buckets, same fingerprint
    index.put(a, 1)
    assert b not in index and not index.delete(b)
    index.put(b, 2)
    assert (index.get(a), index.get(b)) == (1, 2)


# ---------------------------------------------------------------- n-gram Jaccard join


def test_jaccard_on_documents(docs, rows):
    want = brute.near(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_groups(docs).collect()} == want


@pytest.mark.parametrize("block", [8, 96])
def test_jaccard_with_large_groups(spark, monkeypatch, block):
    """Small blocks send every group through leaders and block against block."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LEADERS", 2)
    made = near_copies()
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    want = brute.near(made)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_groups(df).collect()} == want


def test_a_chain_of_passages_grows_in_proportion(spark, monkeypatch):
    """Neighbours share a passage and nothing links: one candidate group of which only neighbours meet."""
    sent = []
    join = jaccard._join_blocks
    monkeypatch.setattr(jaccard, "_join_blocks", lambda rows, *a: sent.append(rows.count()) or join(rows, *a))
    took = []
    for n in (1000, 4000):
        sent.clear()
        passage = lambda i: " ".join(f"p{i}w{j}" for j in range(30))
        chain = spark.createDataFrame([(i, passage(i) + " " + passage(i + 1)) for i in range(n)], "doc_id long, text string")
        assert {r.component_id for r in jaccard.near_groups(chain).collect()} == set(range(n))
        took.append(sent[-1])
    assert len(sent) == 2 and took[1] <= 4.5 * took[0]


def test_block_skips_and_derives_but_loses_nothing():
    rng = np.random.default_rng(0)
    base = rng.choice(10_000, 100, replace=False)
    rows = []
    for i in range(120):
        s = set(base.tolist())
        for _ in range(int(rng.integers(0, 12))):
            s.discard(int(rng.choice(base)))
            s.add(int(rng.integers(10_000, 20_000)))
        rows.append((i, len(s), np.array(sorted(s, reverse=True), np.uint64), 0, i))
    block = jaccard.Block(rows, 85, 100)
    got = brute.components(range(120), list(block.links()))
    sets = {r[0]: set(r[2].tolist()) for r in rows}
    want = brute.components(range(120), [(a, b) for a in range(120) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    assert got == want
    assert block.compared < 120 * 119 / 2 / 2


def test_jaccard_odd_rows(spark, odd):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 3, 4), (5, 3, 4), (6, 1, 6), (None, 2, None)} <= got
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 6, 7, 8]
    assert jaccard.near_groups(empty(spark)).count() == 0


def test_one_document_of_a_group_stays_with_repeated_or_no_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base, "more"])
    other = " ".join(f"v{i}" for i in range(40))
    texts = [(1, other), (5, " ".join(base)), (1, near), (None, "n " + other), (None, other + " z"), (None, "alone here it is"), (None, "alone here it is not"), (7, other + " x"), (None, " ")]
    kept = jaccard.keep_one(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts], DOCS)).collect()
    assert sorted(((r.doc_id or 0, r.text) for r in kept)) == sorted([(1, other), (1, near), (0, "alone here it is"), (0, "alone here it is not"), (0, " ")])
    copies = spark.createDataFrame([(None, " ".join(base), "en", "a", 1), (None, near, "en", "a", 1), (2, other, "en", "a", 1), (3, "z " + other, "en", "a", 1), (3, "quite another text altogether", "en", "a", 1)], DOCS)
    assert sorted(r.doc_id or 0 for r in jaccard.keep_one(copies).collect()) == [0, 2, 3]


# ---------------------------------------------------------------- quality


def test_quality_model_is_a_distribution(spark, docs, tmp_path):
    folder = quality.train(docs, f"file://{tmp_path}/m")
    p = np.exp(quality.load(folder).astype(np.float64)).reshape(-1, 64)
    seen = np.unique(quality.grams(pa.array([r.text for r in docs.limit(20).collect()]))[0] >> 6)
    assert p[seen].sum(axis=1) == pytest.approx(np.ones(len(seen)), abs=1e-3)


def test_quality_parts_good_from_bad(spark):
    got = QUERIES["op3_quality"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    assert both[both.quality == 1].kept.mean() > 0.98 and both[both.quality == 0].kept.mean() < 0.4


def plain_kneser_ney(trained, spelling):
    """A function of (u, v, w) and the spelling of w to the probability of w; trained: lists of words, spelling: the best of each."""
    counts = [None, {}, {}, {}]
    for t in trained:
        t = ["", "", *t]
        for i in range(2, len(t)):
            g = tuple(t[i - 2 : i + 1])
            counts[3][g] = counts[3].get(g, 0) + 1
    for k in (2, 1):
        for g, c in counts[k + 1].items():  # words before, or at the beginning of texts, where there are none, occurrences
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + (c if k == 2 and g[1] == "" else 1)
    off = [None]
    for c in counts[1:]:
        n = [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.0
        d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else (k + 1) / 2 for k in range(3)]
        off.append([min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)])

    def p(g, base):
        k = len(g)
        if k == 0:
            return base
        lower = p(g[1:], spelling.get(g[-1:], base) if k == 1 else base)
        own = {x: c for x, c in counts[k].items() if x[:-1] == g[:-1]}
        if not own:
            return lower
        cut = lambda c: off[k][min(c, 3) - 1]
        all_, c = sum(own.values()), own.get(g, 0)
        if k == 1 and not c:  # an unknown word is rated by its spelling alone
            return base
        return (max(c - cut(c), 0) if c else 0) / all_ + sum(map(cut, own.values())) / all_ * lower

    return p


def test_quality_sums_weights_of_word_ngrams(spark, tmp_path):
    rng = random.Random(5)
    vocab = [f"{a}{b}" for a in "привет" for b in "aeiou"]
    make = lambda n: " ".join(rng.choice(vocab[:12]) for _ in range(n))
    trusted = [make(rng.randrange(1, 40)) for _ in range(12)]
    asked = [make(20), trusted[3], "new " + make(5) + " words"]
    docs = spark.createDataFrame([(i, t, "ru") for i, t in enumerate(trusted)], "doc_id long, text string, lang string").repartition(3)
    folder = quality.train(docs, f"file://{tmp_path}/m")
    weights = quality.train_words(quality._rows(docs), folder)
    frame = spark.createDataFrame([(i, t, "ru") for i, t in enumerate(asked)] + [(0, asked[0], "ru")], docs.schema)
    got = {r.doc_id: r.nats for r in quality.score(frame, folder, weights).collect()}
    table, spelling = quality.load(folder), {}
    for t in trusted:
        for w, x in zip(t.split(), quality._words(pa.array([t]), table)["spell"], strict=True):
            spelling[(w,)] = max(np.exp(x), spelling.get((w,), 0))
    p = plain_kneser_ney([t.split() for t in trusted], spelling)
    for i, t in enumerate(asked):
        words, spell = ["", "", *t.split()], quality._words(pa.array([t]), table)["spell"]
        want = -sum(np.log(p(tuple(words[j : j + 3]), np.exp(spell[j]))) for j in range(len(spell))) / len(t.encode())
        assert got[i] == pytest.approx(want, rel=1e-6)


def test_quality_tells_words_in_order_from_words_in_disorder(spark):
    rng = random.Random(3)
    phrases = [" ".join("".join(rng.choice("абвгдежзик") for _ in range(4)) for _ in range(6)) for _ in range(20)]
    text = lambda: " ".join(rng.choice(phrases) for _ in range(8))
    good = [text() for _ in range(60)]
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in good[40:]]
    docs = spark.createDataFrame([(i, t, "ru") for i, t in enumerate(good + mixed)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.classify(docs, labels).collect()}
    assert np.mean([kept[i] for i in range(40, 60)]) > 0.7 and not any(kept[i] for i in range(60, 80))


def test_quality_takes_little_disk(spark, tmp_path):
    texts = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 0")
    labels = texts.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("quality"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    folders = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), str(tmp_path)]
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")

    def used():
        total = 0
        for at in (*folders, shared):
            for root, _, files in os.walk(at):
                for name in files:
                    with contextlib.suppress(OSError):
                        total += os.stat(os.path.join(root, name)).st_size
        return total

    spark._jvm.System.gc()
    time.sleep(2)
    before, most, done = used(), 0, threading.Event()

    def watch():
        nonlocal most
        while not done.wait(0.1):
            most = max(most, used() - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    rows = quality.classify(texts, labels, folder=f"file://{tmp_path}/m").count()
    done.set()
    watcher.join()
    assert rows == texts.count() and most < 1.25 * size


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (8, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.perplexity is None, r.kept) for r in quality.classify(odd, labels).collect()}
    assert got[1] == got[2] == (True, False) and got[4] == (False, True) and len(got) == len(ODD) - 1
    assert not any(r.kept for r in quality.classify(odd, labels.limit(0)).collect())
    assert quality.classify(empty(spark), labels).count() == 0


# ---------------------------------------------------------------- toxicity


def plain_marginals(emission, moves):
    """Forward-backward over all paths of a short sequence."""
    import itertools

    m = moves.reshape(2, 2)
    weight = np.zeros(2 ** len(emission))
    total = np.zeros(len(emission))
    for i, path in enumerate(itertools.product((0, 1), repeat=len(emission))):
        w = sum(e * s for e, s in zip(emission, path, strict=True)) + sum(m[a, b] for a, b in zip(path, path[1:], strict=False))
        weight[i] = np.exp(w)
        total += weight[i] * np.array(path)
    return total / weight.sum()


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(2)
    moves = rng.normal(size=4)
    lengths = np.array([3, 1, 6, 2])
    emission = rng.normal(size=lengths.sum()) * 2
    got = toxicity.marginals(emission, lengths, moves)
    at = 0
    for n in lengths:
        assert got[at : at + n] == pytest.approx(plain_marginals(emission[at : at + n], moves))
        at += n


def test_long_chains_are_swept_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    emission, lengths, moves = rng.normal(0, 4, 5000), np.array([3000, 1, 1500, 499]), np.array([0.3, -2.0, -1.0, 1.5])
    whole = toxicity.marginals(emission, lengths, moves)
    monkeypatch.setattr(toxicity, "LONG", 400)
    assert toxicity.marginals(emission, lengths, moves) == pytest.approx(whole, abs=1e-9)


def test_a_text_in_pieces_scores_as_a_whole(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    bad = [r.text for r in toxicity.score(docs, model).where("size(spans) > 1").join(docs, "doc_id").select("text").limit(5).collect()]
    text = "ÉTÉ ☃ ".join(bad) * 3
    score, spans = toxicity.judge(model, pa.array([text, "clean", None]))
    assert len(spans[0]) >= 6 and spans[1] == spans[2] == []
    known = {w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower() for t in bad for w in t.split()}
    assert all(set(x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower() for x in text[s["start"] : s["end"]].split()) <= known | {"été", "☃"} for s in spans[0])
    monkeypatch.setattr(toxicity, "STEP", 300)
    cut, cut_spans = toxicity.judge(model, pa.array([text]))
    assert cut[0] == pytest.approx(score[0], abs=1e-9)
    assert [(s["start"], s["end"]) for s in cut_spans[0]] == [(s["start"], s["end"]) for s in spans[0]]


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = QUERIES["op8_toxicity"](spark, d).toPandas()
    both = got.merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    test = both[both.held_out]
    assert (test.held_out == test.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all() and len(got) == 10_000
    assert test[test.toxic == 1].predicted.mean() > 0.8 and test[test.toxic == 0].predicted.mean() < 0.03
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()


def test_spans_name_the_words(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [" ".join([word() for _ in range(30)] + (["Vilest!"] * (i % 2)) + [word() for _ in range(9)]) for i in range(200)]
    model = toxicity.train(texts, [i % 2 for i in range(200)])
    score, spans = toxicity.judge(model, pa.array(["é ÉÉ so vilest, you", "so fine", "", None]))
    text = "é ÉÉ so vilest, you"
    assert [text[s["start"] : s["end"]] for s in spans[0]] == ["vilest,"] and score[0] > 0.5 > score[1] and not spans[2] and score[2] == score[3] < 0.5


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 1), (6, 1, 0), (4, 1, 0), (99, 1, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.rate(odd, labels)
    assert got.count() == len(ODD) and got.where("score IS NULL OR held_out IS NULL").count() == 0
    assert toxicity.rate(odd, labels.limit(0)).where("predicted <> 0").count() == 0
    kept = toxicity.reject(odd, labels)
    assert kept.columns == odd.columns
    assert toxicity.rate(empty(spark), labels).count() == 0 and toxicity.reject(empty(spark), labels).count() == 0
