"""Operators that compare texts or vectors: Jaccard join, passages, substrings, near vectors, components; and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
from cases import got, prose, table, texts

import corpus_pipeline
from furrow.llm import exchange, graph, jaccard, neardup, passages, substrings
from furrow.llm.common import Scratch
from furrow.llm.suffixes import common_prefixes, suffix_array


def linked(docs, same):
    """n_links, component and kept by comparing all pairs."""
    n = len(docs)
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if same(docs[i][1], docs[j][1]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    out = {}
    for i in range(n):
        ids = [docs[j][0] for j in range(n) if find(j) == find(i) and docs[j][0] is not None]
        out.setdefault(docs[i][0], []).append((links[i], min(ids, default=None)))
    return out


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_family():
    out = list(texts())
    base = prose(50, 200).split()
    for k in range(12):
        w = list(base)
        for q in range(k):
            w[(q * 37 + k) % 200] = f"z{k}{q}"
        out.append((100 + k, " ".join(w)))
    return [(i, t, "en", "s", 0, "", "", 0.0, 0) for i, t in out]


@pytest.mark.parametrize("block", [1024, 4])
def test_jaccard_join(spark, block):
    rows = near_family()
    out = got(jaccard.join(spark, table(spark, rows), jaccard.Settings(block=block)))
    want = linked([(r[0], shingles(r[1])) for r in rows], lambda a, b: a and b and 5 * len(a & b) >= 4 * len(a | b))
    for i, w in want.items():
        assert sorted((r["n_links"], str(r["component_id"])) for r in out[i]) == sorted((a, str(b)) for a, b in w), i
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out[i])


def test_jaccard_join_of_nothing(spark):
    assert jaccard.join(spark, table(spark, [])).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    least = jaccard.least_matches(jaccard.Settings())
    assert all(a < b for (_, a), (_, b) in zip(least, least[1:], strict=False)) and least[-1][1] < 0.75 * 128


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(300) if i % 50] + [(r.randrange(400, 500), r.randrange(400, 500)) for _ in range(60)] + [(1000, k) for k in range(1001, 1100)]
    out = graph.components(spark, Scratch(spark), spark.createDataFrame(links, "a long, b long")).collect()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert {r["node"]: r["root"] for r in out} == {x: find(x) for x in list(parent)}


def removed_words(docs, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen: dict = {}
    for w in words:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            seen[k] = seen.get(k, 0) + 1
    out: dict = {}
    for (d, _), w in zip(docs, words, strict=True):
        gone = {i + k for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for k in range(width)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.setdefault(d, []).append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("chunk", [1 << 20, 500])
def test_repeated_words(spark, chunk):
    rows = near_family()
    out = got(passages.repeated_words(spark, table(spark, rows), chunk=chunk))
    for i, w in removed_words([r[:2] for r in rows], 35).items():
        assert sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out[i]) == sorted(w)
    assert passages.repeated_words(spark, table(spark, [])).count() == 0


def removed_bytes(docs, width):
    raw = [(t or "").encode() for _, t in docs]
    seen: dict = {}
    for b in raw:
        for i in range(len(b) - width + 1):
            seen[b[i : i + width]] = seen.get(b[i : i + width], 0) + 1
    out: dict = {}
    for (d, _), b in zip(docs, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(c for c, g in zip(b, gone[:-1], strict=True) if not g)
        out.setdefault(d, []).append((len(b), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("chunk", [1 << 20, 500])
def test_repeated_bytes(spark, chunk):
    rows = near_family()
    passage = prose(60, 75)  # its ends meet other texts at any byte
    rows += [(200 + k, prose(70 + k, 30)[k:] + passage[k % 7 : len(passage) - k % 5] + prose(90 + k, 30), "en", "s", 0, "", "", 0.0, 0) for k in range(9)]
    rows += [(300, "abcabd" * 300, "en", "s", 0, "", "", 0.0, 0), (301, "a" * 399, "en", "s", 0, "", "", 0.0, 0), (302, "b" * 401, "en", "s", 0, "", "", 0.0, 0)]
    out = got(substrings.repeated_bytes(spark, table(spark, rows), chunk=chunk))
    for i, w in removed_bytes([r[:2] for r in rows], 400).items():
        assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out[i]) == sorted(w), i
    assert substrings.repeated_bytes(spark, table(spark, [])).count() == 0


def test_repeated_bytes_full_of_repeats(spark):
    """Nearly every string is compared, in texts far longer than a chunk: hashes of too few bits made strings at the ends of repeats agree by chance."""
    r = random.Random(0)

    def said(n):
        return "".join(r.choices("etaoinshrdlu ", k=n))

    pool = [said(1200) for _ in range(160)] * 2
    r.shuffle(pool)
    rows = [(d, "".join(said(100) + p for p in pool[8 * d : 8 * d + 8])) for d in range(40)]
    out = got(substrings.repeated_bytes(spark, spark.createDataFrame(rows, "doc_id long, text string"), chunk=500))
    for i, w in removed_bytes(rows, 400).items():
        assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out[i]] == w, i


def test_suffix_array():
    r = random.Random(1)
    for _ in range(400):
        s = [r.randint(1, r.choice([1, 2, 5])) for _ in range(r.randint(0, 30))] * r.randint(1, 3) + [0]
        sa = suffix_array(s)
        assert sa == sorted(range(len(s)), key=lambda i, s=s: s[i:])
        for k, n in enumerate(common_prefixes(s, sa)):
            if k:
                a, b = s[sa[k - 1] :], s[sa[k] :]
                assert n == next((q for q, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("symbols", [200_000, 20])
@pytest.mark.parametrize("letters", [2, 4, 40])
def test_common_runs_are_those_of_all_places(monkeypatch, symbols, letters):
    """The suffix arrays' common prefixes against a comparison of all places, with points split that have many neighbourhoods."""
    monkeypatch.setattr(substrings, "SYMBOLS", symbols)
    r = np.random.default_rng(letters)
    alphabet, none, stretch = r.integers(1, 1 << 63, letters, dtype=np.uint64), np.zeros(0, np.uint64), 6
    chunks = [[alphabet[r.integers(0, letters, r.integers(0, 40))] for _ in range(6)] for _ in range(3)]
    chunks[2] += chunks[0][:2]
    made = []
    for c in chunks:
        parsed = [substrings.Parsed(none, np.zeros(0, np.int64), p, none, np.arange(max(0, len(p) - stretch + 1)) + stretch, 0) for p in c]
        made.append(substrings.Meetings([(x, np.ones(len(x.phrases), bool)) for x in parsed]))
    bits = 2
    replies = [[] for _ in made]
    for b in range(1 << bits):
        have = [(k, dict(m.lists(bits)).get(b)) for k, m in enumerate(made)]
        have = [h for h in have if h[1]]
        for (k, _), reply in zip(have, substrings.meet([h[1] for h in have]) if have else [], strict=True):
            replies[k].append((b, reply))
    runs = {}
    for c, (chunk, m) in enumerate(zip(chunks, made, strict=True)):
        far, sends = m.common(bits, replies[c])
        for t, p in enumerate(chunk):
            for i in range(len(p) - 2):
                at = m.starts[t] + i
                runs[c, t, i] = (tuple(p[i : i + stretch].tolist()), int(far[at]), bool(sends[at]))
    leads = {}
    for (c, t, i), (own, far, sends) in runs.items():
        best = 0
        for k, (other, _, _) in runs.items():
            if k != (c, t, i):
                n = next((q for q, (x, y) in enumerate(zip(own, other, strict=False)) if x != y), min(len(own), len(other)))
                best = max(best, n)
        assert far == (best if best >= 3 else 0), (c, t, i)
        leads.setdefault(own, []).append(sends)
    assert all(sum(v) == 1 for v in leads.values())


def test_removed_bytes_come_from_the_suffix_array(spark, monkeypatch):
    rows = [(k, prose(60, 120), "en", "s", 0, "", "", 0.0, 0) for k in range(2)]
    raw = [r[1].encode() for r in rows]
    parsed = [substrings.parse(b, 400) for b in raw]
    flags = [np.ones(len(p.phrases), bool) for p in parsed]
    a, b = (substrings.Meetings([x]) for x in zip(parsed, flags, strict=True))
    monkeypatch.setattr(substrings, "suffix_array", lambda s: pytest.fail("asked"))
    c = substrings.Meetings([(parsed[0], flags[0]), (substrings.parse(raw[0][:700] + raw[0][900:], 400), np.ones(len(substrings.parse(raw[0][:700] + raw[0][900:], 400).phrases), bool))])
    with pytest.raises(pytest.fail.Exception):
        substrings.meet([x[1] for m in (a, b, c) for x in m.lists(0)])


def test_exchange_finds_what_occurs_twice():
    r = np.random.default_rng(0)
    lists = [np.sort(r.integers(0, 300, 100, dtype=np.uint64) << np.uint64(50)) for _ in range(3)]
    made = [exchange.Keys(x) for x in lists]
    every, times = np.unique(np.concatenate(lists), return_counts=True)
    for bits in (0, 3):
        got_back = [[] for _ in made]
        for b in range(1 << bits):
            have = [(k, dict(m.lists(bits)).get(b)) for k, m in enumerate(made)]
            have = [h for h in have if h[1]]
            for (k, _), reply in zip(have, exchange.compare([h[1] for h in have]) if have else [], strict=True):
                got_back[k].append((b, reply))
        for m, replies in zip(made, got_back, strict=True):
            assert (m.answers(bits, replies, 2)[0] == np.isin(m.keys, every[times > 1])).all()


def test_exchange_tells_equal_keys_by_their_checks():
    keys, checks = np.array([5, 9, 5, 5, 9], np.uint64), np.array([2, 1, 1, 2, 1], np.uint16)
    one, two = exchange.Keys(keys, checks), exchange.Keys(np.array([5, 9, 5], np.uint64), np.array([3, 4, 1], np.uint16))
    assert list(zip(one.keys.tolist(), one.check.tolist(), one.times.tolist(), strict=True)) == [(5, 1, 1), (5, 2, 2), (9, 1, 2)]
    assert one.inverse.tolist() == [1, 2, 0, 1, 2]
    replies = exchange.compare([x for k in (one, two) for _, x in k.lists(0)])
    assert [a.tolist() for a in one.answers(0, [(0, replies[0])], 2)] == [[True, True, True], [True, True, True]]
    assert [a.tolist() for a in two.answers(0, [(0, replies[1])], 2)] == [[True, False, False], [False, True, True]]


@pytest.mark.parametrize("checked", [False, True])
def test_exchange_in_two_levels(spark, checked):
    """Lists of groups of chunks, merged and cut again, give the answers that all lists together give."""
    r = np.random.default_rng(5)
    made = []
    for _ in range(9):
        k = r.integers(0, 400, 150, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        made.append(exchange.Keys(k, (k >> np.uint64(7)).astype(np.uint16) if checked else None))
    indexed = [r.random(len(m.keys)) < 0.3 for m in made]
    rows = [(c, b, bytearray(x)) for c, (m, i) in enumerate(zip(made, indexed, strict=True)) for b, x in m.lists(2, i)]
    df = spark.createDataFrame(rows, "_chunk long, _bucket int, _list binary")
    got_back = {}
    for x in exchange.answer(df, 6, 9, top=2, group=4).collect():
        got_back.setdefault(x["_chunk"], []).append((x["_bucket"], bytes(x["_reply"])))
    places: dict = {}
    for m, i in zip(made, indexed, strict=True):
        for k, n, yes in zip(m.keys.tolist(), m.times.tolist(), i.tolist(), strict=True):
            a, b = places.get(k, (0, False))
            places[k] = a + 1 + (n > 1), b or yes
    leads: dict = {}
    for c, m in enumerate(made):
        repeated, first = m.answers(2, got_back[c], 2)
        assert repeated.tolist() == [places[k][0] > 1 and places[k][1] for k in m.keys.tolist()]
        for k, f in zip(m.keys.tolist(), first.tolist(), strict=True):
            leads.setdefault(k, []).append(f)
    assert all(sum(v) == 1 for v in leads.values())


def vectors():
    r = np.random.default_rng(3)
    base = r.standard_normal((40, 16))
    out = [(k, v.tolist()) for k, v in enumerate(base)]
    out += [(100 + k, (base[k % 8] + 0.12 * r.standard_normal(16)).tolist()) for k in range(60)]
    out += [(200, base[0].tolist()), (200, base[0].tolist()), (201, (3 * base[1]).tolist()), (202, None), (203, [0.0] * 16), (204, [float("nan")] + [1.0] * 15), (205, [None] + [1.0] * 15), (206, []), (None, base[2].tolist()), (207, [1.0, 2.0]), (208, [2.0, 4.0]), (209, [0.0, 1.0]), (210, [7.0]), (211, [5.0])]
    return out


@pytest.mark.parametrize("leaf,block,large", [(256, 512, 4096), (8, 4, 4096), (8, 64, 16)])
def test_near_vectors(spark, leaf, block, large):
    data = [(i, v, 1, "clash") for i, v in vectors()]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, _node string")
    out = got(neardup.near(spark, df, neardup.Settings(leaf=leaf, block=block, large=large, sample=4096 if large > 16 else 32)), "vec_id")

    def good(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float32).astype(float)
        return x / np.linalg.norm(x)

    want = linked([(i, good(v)) for i, v in vectors()], lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9)
    total = sum(a for w in want.values() for a, _ in w)
    assert sum(r["n_links"] for rs in out.values() for r in rs) >= 0.97 * total
    if leaf == 256:
        for i, w in want.items():
            assert sorted((r["n_links"], str(r["component_id"])) for r in out[i]) == sorted((a, str(b)) for a, b in w), i
    assert all(r["n_links"] == 0 and r["kept"] for i in (202, 203, 204, 205, 206, 209) for r in out[i])
    assert neardup.near(spark, df.where("false")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (8, 1, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, near_family()).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.dtypes == docs.dtypes
        if name == "near copies":
            kept = {r["doc_id"] for r in out.collect()}
            assert {1, 3} & kept == {1} and {4, 5, 13, None} <= kept
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    assert now.count() == corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name


def test_near_copies_of_null_and_repeated_ids(spark):
    base = prose(50, 200)
    other, third = prose(51, 100), prose(52, 100)
    rows = [(None, base), (None, base + " more"), (None, other), (None, None), (7, base), (9, base), (9, third), (11, third), (None, ""), (9, "short")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted((str(r["doc_id"]), r["text"] or "-") for r in corpus_pipeline.without_near_copies(spark, docs, "").collect())
    assert out == sorted([("7", base), ("9", third), ("None", other), ("None", "-"), ("None", "-"), ("9", "short")])


def test_vectors_move_once_for_each_tree(spark, monkeypatch, tmp_path):
    """What is dealt to tasks grows with the trees, not with leaves or bands around cuts."""
    r = np.random.default_rng(5)
    x = r.standard_normal((3000, 16)).astype(np.float32)
    x[1500:] = x[:1500] + 0.1 * r.standard_normal((1500, 16)).astype(np.float32)
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/v")
    moved, save = [], Scratch.save

    def counted(self, df):
        plan = df._jdf.queryExecution().analyzed().toString()
        if "FlatMapGroups" in plan and "_part" in plan or "_leaf" in plan and "_mine" in plan:
            moved.append(df)
        return save(self, df)

    monkeypatch.setattr(Scratch, "save", counted)
    out = neardup.near(spark, spark.read.parquet(f"{tmp_path}/v"), neardup.Settings(leaf=64, large=512, block=256)).toPandas()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum() - 3000
    assert 0.95 * links <= out["n_links"].sum() <= links
    assert 1 < len(moved) == neardup.Settings().trees


def test_linked_vectors_of_a_part_are_those_of_all_pairs():
    r = np.random.default_rng(6)
    x = r.standard_normal((400, 16)).astype(np.float32)
    x[300:] = x[0] + 0.15 * r.standard_normal((100, 16)).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    none = np.zeros((400, 0), np.int32)
    for tile in (1024, 7):
        out = neardup.links_within(x, np.ones(400, np.int64), neardup.Settings(leaf=50, tile=tile), [1], none)
        assert 0.97 * near.sum() <= out.n.sum() and (out.n <= near.sum(axis=1)).all()
    side = np.arange(400) % 2
    out = neardup.links_within(x, np.ones(400, np.int64), neardup.Settings(), [1], none, side)
    assert out.n.tolist() == (near & (side[:, None] != side)).sum(axis=1).tolist()
    earlier = (np.arange(400) % 3)[:, None]
    out = neardup.links_within(x, np.ones(400, np.int64), neardup.Settings(), [1], earlier)
    assert out.n.tolist() == (near & (earlier != earlier.T)).sum(axis=1).tolist()
