"""Operators that compare texts with each other or with a benchmark, and the pipeline, against brute force."""

import collections
import hashlib
import itertools
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import byte_conv, decontaminate, labelled, line_chunks, order_minhash, quality_rules, toxicity
from tidemark.llm.blocks import flat
from tidemark.llm.queries import ORACLES, QUERIES

SMALL, SF_DIR = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Benchmark decontamination


def brute_hits(docs, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = WORD.findall(lower(text))
        for a in range(max(1, len(words) - 9)) if words else []:
            windows[tuple(words[a : a + 10])].add(item)
    out = []
    for i, text in docs:
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for n in {len(w) for w in windows}:
            for a in range(len(words) - n + 1):
                if tuple(words[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[tuple(words[a : a + n])]
        named = sorted(str(x) for x in found if x is not None)
        out.append((i, len(words), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def hits(df, items):
    return sorted((tuple(r) for r in decontaminate.decontaminate(df, items).collect()), key=repr)


def test_decontamination_equals_brute_force(spark, frame, edges, small):
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(rng.choice(list("abcd"), rng.integers(0, 60)))) for i in range(120)]
    items = [(100 + i, " ".join(rng.choice(list("abcd"), n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10, 11, 14, 30])]
    items += [(9, items[9][1]), (8, items[9][1]), (None, items[3][1]), (1, None), (2, ""), (3, "..."), (4, edges[4][1].upper()), (5, "don't, stop")]
    bench = spark.createDataFrame([(i, t, "own", "own") for i, t in items], "item_id bigint, text string, key string, n string")
    assert hits(frame(edges + texts), bench) == brute_hits(edges + texts, items)
    given = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert hits(small[0], given) == brute_hits([(r.doc_id, r.text) for r in small[1]], [(r.item_id, r.text) for r in given.collect()])
    assert hits(frame([]), bench) == [] and all(not r[-1] for r in hits(frame(edges), bench.limit(0)))


def test_winnowing_picks_the_same_fingerprint_of_every_shared_span():
    rng = np.random.default_rng(5)
    for n in range(1, 11):
        span = rng.integers(0, 2**63, n).astype(np.uint64)
        picked = []
        for _ in range(2):
            before, after = (rng.integers(0, 2**63, rng.integers(0, 12)).astype(np.uint64) for _ in range(2))
            h = np.concatenate([before, span, after])
            at, keys = decontaminate.winnow(h, np.zeros(len(h), np.int64), n)
            k, _ = decontaminate.shape(n)
            picked.append({(int(a) - len(before), int(x)) for a, x in zip(at, keys, strict=True) if len(before) <= a <= len(before) + n - k})
        assert picked[0] & picked[1]


def test_drop_contaminated(spark, frame, edges):
    bench = spark.createDataFrame([(1, edges[4][1])], "item_id bigint, text string")
    df = frame(edges)
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and kept.where("`row` <> 'own row'").isEmpty()
    want = [i for (i, *_, bad), _ in zip(brute_hits(edges, [(1, edges[4][1])]), edges, strict=True) if not bad]
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, want))


# Line chunks


def test_line_chunks_equal_sql_on_given_tables(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_DIR}/documents.parquet')")
    want = sorted(con.execute(ORACLES["op8_line_chunks"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op8_line_chunks"](spark, SF_DIR).collect()) == want
    assert sum(w[2] for w in want) > 0


def brute_lines(rows):
    """The same procedure on (id, text) pairs; rows that repeat both are one place."""
    def spans(text):
        lines = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:13], 16) for x in lines]
        long = [x.count(" ") + 1 >= line_chunks.LONG_LINE for x in lines]
        start = 0
        for i in range(len(lines)):
            if i + 1 == len(lines) or long[i] or long[i + 1] or ((h[i - 1] if i else 0) * 31 + h[i]) % line_chunks.DIVISOR == 0:
                yield lines[start : i + 1]
                start = i + 1

    places = collections.defaultdict(set)
    for i, text in rows:
        for idx, chunk in enumerate(spans(text) if text is not None else []):
            words = sum(x.count(" ") + 1 for x in chunk)
            if len(chunk) > 1 and words >= line_chunks.MIN_WORDS or words >= line_chunks.LONG_LINE:
                places["\n".join(chunk)].add((i, text, idx))
    return places, spans


def test_line_chunks_on_edges(frame, edges):
    passage = "\n".join(f"line {i} of a passage that is shared by many" for i in range(12))
    alone = " ".join(f"w{i}" for i in range(60))
    texts = edges + [(20, passage), (21, "first\n" + passage + "\nlast"), (22, "other\nlines\n" + passage), (23, alone), (24, "before\n" + alone + "\nbehind"), (None, alone), (25, passage), (25, passage)]
    df = frame(texts)
    made = line_chunks.dedup_lines(df, n_lines_col="n_lines", n_removed_col="n_removed")
    assert made.columns == [*df.columns, "n_lines", "n_removed"] and made.where("t <> 'own t'").isEmpty()
    places, spans = brute_lines(texts)
    first = {c: min(at, key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2])) for c, at in places.items() if len(at) > 1}
    want = []
    for i, t in texts:
        chunks = ["\n".join(s) for s in spans(t)] if t is not None else []
        left = [c for idx, c in enumerate(chunks) if c not in first or first[c] == (i, t, idx)]
        gone = sum(c.count("\n") + 1 for c in chunks) - sum(c.count("\n") + 1 for c in left)
        want.append((i, None if t is None else "\n".join(left), 0 if t is None else t.count("\n") + 1, gone))
    assert len(first) > 2
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in made.select("doc_id", "text", "n_lines", "n_removed").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    by = {(i, n): t for i, t, n, _ in got}
    assert by[20, 12] == passage and by[23, 1] == alone and by[24, 3] == "before\nbehind"
    assert line_chunks.dedup_lines(frame([])).count() == 0


# Near duplicates


def brute_classes(rows):
    keys, kmers, index = {}, {}, collections.defaultdict(list)
    for n, (i, text) in enumerate(rows):
        if text is None:
            keys[n] = ("null", n)
            continue
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.lower().encode())
        keys[n] = tuple(words) or ("text", text)
        if keys[n] not in kmers:
            seen, own = collections.Counter(), []
            for a in range(len(words) - 4):
                g = tuple(words[a : a + 5])
                own.append((g, seen[g]))
                seen[g] += 1
            kmers[keys[n]] = own
            for x in own:
                index[x].append(keys[n])
    shared = collections.Counter(p for near in index.values() if len(near) > 1 for p in itertools.combinations(near, 2))
    parent = {k: k for k in keys.values()}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for (a, b), c in shared.items():
        x, y = kmers[a], kmers[b]
        if c / (len(x) + len(y) - c) >= 0.8 and in_order(x, y) >= 0.8:
            parent[top(a)] = top(b)
    out = collections.defaultdict(list)
    for n in keys:
        out[top(keys[n])].append(n)
    return sorted(out.values())


def in_order(a, b):
    """Longest common subsequence over union, by the textbook table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1] / (len(a) + len(b) - row[-1])


def test_aligned_equals_the_table():
    rng = np.random.default_rng(8)
    for _ in range(300):
        a = rng.permutation(rng.integers(1, 60))[: rng.integers(1, 60)].astype(np.uint32)
        b = a.copy()
        for _ in range(rng.integers(0, 5)):
            i, j = rng.integers(0, len(b), 2)
            b[[i, j]] = b[[j, i]]
        b = np.delete(b, rng.integers(0, len(b), rng.integers(0, 3)))
        want = in_order(a.tolist(), b.tolist()) if len(b) else 0.0
        got = order_minhash.aligned(a, b)
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def same_classes(df, rows):
    by = collections.defaultdict(list)
    got = order_minhash.classes(df, "doc_id", "text").collect()
    for r in got:
        by[r["class"]].append(r["id"])
    want = [sorted((rows[n][0] for n in c), key=repr) for c in brute_classes(rows)]
    assert sorted((sorted(x, key=repr) for x in by.values()), key=repr) == sorted(want, key=repr)
    for r in got:
        known = [i for i in by[r["class"]] if i is not None]
        assert r["class_id"] == min(known, default=None) and r["class_size"] == len(by[r["class"]])


def test_near_duplicates_equal_brute_force(frame, edges, small):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(400)]
    texts = list(edges)
    for base in range(12):
        text = list(rng.choice(words, int(rng.integers(4, 120))))
        for copy in range(8):
            own = list(text)
            for _ in range(int(rng.integers(0, 1 + len(text) // 40))):
                own[int(rng.integers(0, len(own)))] = rng.choice(words)
            texts.append((100 * base + copy, " ".join(own) + "." * copy))
    same_classes(frame(texts), texts)
    same_classes(small[0], [(r.doc_id, r.text) for r in small[1]])
    assert order_minhash.near_duplicates(frame([])).count() == 0
    assert order_minhash.near_duplicates(frame(edges)).columns[:2] == ["doc_id", "class_id"]


def test_order_matters():
    a = np.arange(100, dtype=np.uint32)
    assert order_minhash.aligned(a, np.roll(a, 50)) < 0.8 <= order_minhash.aligned(a, np.roll(a, 5))


@pytest.mark.parametrize("n", [5, 9, 10, 18, 27, 32, 36, 41, 45, 54, 63, 108, 450])
def test_few_pairs_miss_all_bands(n):
    """Pairs at the least similarity of 0.8 or more that n k-mers each allow, by their own signatures."""
    rng = np.random.default_rng(n)
    other = n - int(np.ceil(1.6 * n / 1.8 - 1e-9))  # k-mers of each that the other lacks
    pairs = []
    for _ in range(1000):
        words = [f"w{x}" for x in rng.integers(0, 10**9, n + 4)]
        at = 0 if rng.random() < 0.5 else n + 4 - other
        pairs.append((words, [*words[:at], *[f"v{x}" for x in rng.integers(0, 10**9, other)], *words[at + other :]]))
    sides = []
    for side in (0, 1):
        data, offsets = flat(pa.array([" ".join(p[side]) for p in pairs]))
        sides.append(order_minhash.signature_block(data, offsets)[4])
    missed = sum(not set(x.tolist()) & set(y.tolist()) for x, y in zip(*sides, strict=True))
    assert missed <= 5  # 0.995 are found


def test_large_buckets_are_exhausted(frame):
    rng = np.random.default_rng(21)
    texts = []
    for i in range(150):
        words = [f"w{x}" for x in rng.integers(0, 5000, 40)]
        texts += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "other"]))]
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    df = frame(texts)
    rows = order_minhash.signed_rows(df, "doc_id", "text").withColumn("bands", F.array(F.lit(1).cast("bigint")))
    _, comps = order_minhash.link_rows(df, "text", rows)
    ids = {r.row: r.id for r in rows.collect()}
    by = collections.defaultdict(list)
    for r in [] if comps is None else comps.collect():
        by[r.comp].append(ids[r.node])
    want = [sorted(texts[n][0] for n in c) for c in brute_classes(texts)]
    assert sorted(sorted(c) for c in by.values()) == sorted(want) and len(want) == 150


def test_templates_do_not_meet(frame, monkeypatch):
    """Two thousand unlike texts with a long part in common, in one bucket, and near copies among them."""
    rng = np.random.default_rng(31)
    shared = [f"t{x}" for x in range(100)]
    texts = [(i, " ".join([*shared, *(f"w{x}" for x in rng.integers(0, 10**9, 40))])) for i in range(2000)]
    texts += [(2000 + i, texts[7 * i][1] + " more") for i in range(60)] + [(3000 + i, texts[7 * i][1] + " other") for i in range(30)]
    order = rng.permutation(len(texts))
    df = frame([texts[i] for i in order])
    rows = order_minhash.signed_rows(df, "doc_id", "text").withColumn("bands", F.array(F.lit(1).cast("bigint")))
    searches = []
    monkeypatch.setattr(order_minhash, "_Search", lambda kmers, make=order_minhash._Search: searches.append(make(kmers)) or searches[-1])
    _, comps = order_minhash.link_rows(df, "text", rows)
    ids = {r.row: r.id for r in rows.collect()}
    by = collections.defaultdict(list)
    for r in comps.collect():
        by[r.comp].append(ids[r.node])
    assert sorted(sorted(c) for c in by.values()) == [[7 * i, 2000 + i, 3000 + i] if i < 30 else [7 * i, 2000 + i] for i in range(60)]
    assert searches[0].tested.count() <= len(texts) + 200  # one hub met all; all pairs would be two million


def test_open_members_are_stored_and_bounded(frame, monkeypatch, capsys):
    """Copies of one text, more or less alike, in one bucket: those a round leaves are stored, and no more than each text's prefix."""
    rng = np.random.default_rng(41)
    texts = []
    for i in range(60):
        words = [f"w{i}" for i in range(60)]
        for at in rng.integers(0, 60, int(rng.integers(1, 5))):
            words[at] = f"v{rng.integers(0, 10**9)}"
        texts.append((i, " ".join(words)))
    left, plain = [], order_minhash._Search.round

    def watched(self, now, turn):
        out = plain(self, now, turn)
        capsys.readouterr()
        out.explain()
        assert "Join" not in capsys.readouterr().out
        left.append(out.count())
        return out

    monkeypatch.setattr(order_minhash._Search, "round", watched)
    df = frame(texts)
    rows = order_minhash.signed_rows(df, "doc_id", "text").withColumn("bands", F.array(F.lit(1).cast("bigint")))
    _, comps = order_minhash.link_rows(df, "text", rows)
    ids = {r.row: r.id for r in rows.collect()}
    by = collections.defaultdict(list)
    for r in comps.collect():
        by[r.comp].append(ids[r.node])
    want = [sorted(texts[n][0] for n in c) for c in brute_classes(texts)]
    assert sorted(sorted(c) for c in by.values()) == sorted(c for c in want if len(c) > 1)
    assert len(left) > 2 and max(left) <= len(texts) * (56 - 45 + 1)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)], "a bigint, b bigint")
    got = {r.node: r.comp for r in order_minhash.components(links, links.count()).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def test_keep_one(frame, edges):
    df = frame(edges)
    kept = order_minhash.keep_one(df)
    assert kept.columns == df.columns and kept.where("`class` <> 'own class' OR h <> 'own h'").isEmpty()
    rows = [(i, t) for i, t in edges if t is not None]
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert sum(got.values()) == len(brute_classes(rows)) + sum(t is None for _, t in edges)
    assert got[4, edges[4][1]] == 1 and got[5, edges[6][1]] == 0 and got[None, edges[3][1]] == 0
    assert order_minhash.keep_one(frame([])).count() == 0


# Classifiers


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"))
    good = label == 1
    return (order[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


@pytest.mark.parametrize(("make", "label", "least", "fold"), [(toxicity.toxicity, "toxic", 0.93, (4, 2)), (byte_conv.quality, "quality", 0.97, (5, 0))])
def test_held_out_accuracy(spark, make, label, least, fold):
    import zlib

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in make(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % fold[0] == fold[1]) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [(got[r.doc_id].score, r[label]) for r in labels.collect() if got[r.doc_id].held_out]
    assert auc(*map(np.array, zip(*held, strict=True))) >= least


@pytest.mark.parametrize("make", [toxicity.toxicity, byte_conv.quality])
def test_classifiers_on_edges(spark, frame, edges, make):
    labels = spark.createDataFrame([(4, 1, 1), (4, 0, 0), (9, None, None), (None, 1, 1), (5, 1, 1), (8, 0, 0)], "doc_id bigint, quality int, toxic int")
    for some, df in ((labels, frame(edges)), (labels.limit(0), frame(edges)), (labels, frame([]))):
        rows = make(df, some).collect()
        assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    texts = collections.defaultdict(set)
    for r, (_, t) in zip(sorted(make(frame(edges), labels).collect(), key=lambda r: repr(r.doc_id)), sorted(edges, key=lambda e: repr(e[0])), strict=True):
        texts[t or ""].add(r.score)
    assert not make(frame(edges), labels).where("doc_id IS NULL AND held_out").count()


def test_pairs_of_terms_are_learned():
    """Neither term alone is toxic, both together are: no additive weight can say so."""
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        texts.append(np.unique(np.concatenate([rng.integers(100, 200, 3), [1] if a else [2], [3] if b else [4]])).astype(np.int32))
        labels.append(float(a == b))
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert not toxicity.associated(np.concatenate(texts), np.repeat(labels, np.diff(at)), np.array(labels))[:5].any()
    machine = toxicity.fit(np.concatenate(texts), at, np.array(labels))
    score = machine.score(np.concatenate(texts), at)
    assert auc(score, np.array(labels)) > 0.95


def test_pair_sums_equal_all_pairs():
    rng = np.random.default_rng(5)
    machine = toxicity.Machine(rng.normal(size=50), rng.normal(size=(50, 8)), 0.3)
    texts = [rng.permutation(50)[:n] for n in (0, 1, 2, 7, 30)]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got, _ = machine.margin(np.concatenate(texts).astype(int), at)
    want = [0.3 + sum(machine.w[i] for i in t) + sum(machine.v[i] @ machine.v[j] for i, j in itertools.combinations(t, 2)) for t in texts]
    assert np.allclose(got, want)


def test_convolution_equals_loops():
    rng = np.random.default_rng(6)
    net = byte_conv.Network(3)
    net.shift[:] = rng.normal(size=byte_conv.FILTERS)
    texts = [rng.integers(1, 256, n).astype(np.uint8) for n in (0, 3, 512, 700, 1500)]
    got = net.score(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    for text, score in zip(texts, got, strict=True):
        step, pooled = byte_conv.CHUNK - byte_conv.OVERLAP, []
        for begin in range(0, max(1, len(text) - byte_conv.OVERLAP), step):
            own = np.zeros(byte_conv.CHUNK, np.uint8)
            part = text[begin : begin + byte_conv.CHUNK]
            own[: len(part)] = part
            places = range(0, byte_conv.CHUNK - byte_conv.WIDTH + 1, byte_conv.STRIDE)
            pooled.append([max(0.0, max(float(net.vectors[own[p : p + byte_conv.WIDTH]].ravel() @ net.filters[:, f]) for p in places) + net.shift[f]) for f in range(byte_conv.FILTERS)])
        z = np.concatenate([np.mean(pooled, 0), np.max(pooled, 0)]) @ net.weights + net.bias[0]
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_whole_texts_are_learned_from():
    """Good and bad texts differ in one short passage of many kilobytes, at any place."""
    rng = np.random.default_rng(9)
    texts, labels = [], []
    for i in range(160):
        text = rng.choice(np.frombuffer(b"abcdefgh ", np.uint8), 12_000).copy()
        at = int(rng.integers(0, 11_900))
        text[at : at + 60] = np.frombuffer((b"#!" if i % 2 else b"xy") * 30, np.uint8)
        texts.append(text)
        labels.append(float(i % 2))
    net = byte_conv.fit(texts[:120], np.array(labels[:120]))
    score = net.score(np.concatenate(texts[120:]), np.arange(41) * 12_000)
    assert auc(score, np.array(labels[120:])) > 0.95


def test_sample_is_bound_by_bytes(spark, frame):
    df = frame([(i, "x" * (1000 + i)) for i in range(50)] + [(7, "short"), (60, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(50), 60]], "doc_id bigint, quality int")
    rows = labelled.training_rows(df, labels, "doc_id", "text", "quality", lambda c: F.col(c) < 0, 40, lambda t: t, 10_000)
    assert 8 <= len(rows) <= 11 and sum(len(r["x"] or "") for r in rows) <= 10_000
    assert len(labelled.training_rows(df, labels, "doc_id", "text", "quality", lambda c: F.col(c) < 0, 40, lambda t: t, 5)) in (1, 2)


def test_chunks_cover_whole_texts():
    rng = np.random.default_rng(2)
    sizes = np.array([0, 1, 511, 512, 513, 960, 961, 5000])
    data, at = rng.integers(1, 256, sizes.sum()).astype(np.uint8), np.concatenate([[0], np.cumsum(sizes)])
    n = byte_conv.n_chunks(sizes)
    begin = np.concatenate([[0], np.cumsum(n)])
    chunks = byte_conv.chunk_bytes(data, at, 0, int(begin[-1]), n, begin)
    step = byte_conv.CHUNK - byte_conv.OVERLAP
    for i, size in enumerate(sizes):
        own = chunks[begin[i] : begin[i + 1]]
        text = np.concatenate([own[0], *(c[byte_conv.OVERLAP :] for c in own[1:])])
        assert text[:size].tolist() == data[at[i] : at[i + 1]].tolist() and not text[size:].any() and (len(own) - 1) * step < max(size, 1)


# Pipeline


def test_pipeline_equals_its_parts(spark):
    stages = [n for n, _ in corpus_pipeline.STAGES]
    assert stages == ["quality rules", "line dedup", "near-dedup", "decontamination", "byte-level BPE"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in quality_rules.quality_rules(docs, labels).where("kept").collect()}
    first = corpus_pipeline.STAGES[0][1](spark, docs, SMALL)
    assert {r.doc_id for r in first.collect()} == kept and first.columns == docs.columns
    rows = sorted((r.doc_id, r.text) for r in first.collect())
    places, spans = brute_lines(rows)
    again = {c: min((i, idx) for i, _, idx in at) for c, at in places.items() if len(at) > 1}
    cut = [(i, "\n".join(c for idx, c in enumerate("\n".join(s) for s in spans(t)) if c not in again or again[c] == (i, idx))) for i, t in rows]
    alone = [cut[min(c)] for c in brute_classes(cut)]
    hit = {h[0] for h in brute_hits(alone, bench) if h[-1]}
    want = sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in alone if i not in hit)
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted((r.doc_id, r.decoded_sha256) for r in got.collect()) == want


def test_pipeline_on_edges(spark, frame, edges, tmp_path):
    frame(edges).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {i for i, _ in edges} and len(got) == 1


def test_functions_whose_results_are_filtered_run_once(spark, frame, monkeypatch, capsys):
    seen = []

    def note(df):
        df.explain()
        seen.append(capsys.readouterr().out.count("ArrowEvalPython ["))
        return df

    for module in (order_minhash, decontaminate):
        monkeypatch.setattr(module, "settle", lambda df, settle=module.settle: settle(note(df)))
    words = [f"word{i}" for i in range(60)]
    docs = frame([(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, " ".join(reversed(words)))])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    items = spark.createDataFrame([("a", " ".join(words[50:39:-1]))], "item_id string, text string")
    assert {r.doc_id for r in note(quality_rules.keep_good(docs, labels)).collect()} == {1, 2, 3}
    assert {r.doc_id for r in order_minhash.keep_one(docs).collect()} == {1, 3}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()} == {1, 2}
    # measures; signatures, k-mers, similarities; fingerprints of items and of texts
    assert [n for n in seen if n] == [1] * 6


@pytest.mark.parametrize("empty", ["documents", "benchmark"])
def test_pipeline_on_empty_tables(spark, tmp_path, empty):
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{SMALL}/{name}.parquet")
        (df.limit(0) if name == empty else df).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns[0] == "doc_id" and (got.count() == 0) == (empty == "documents")
