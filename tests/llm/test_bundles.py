"""Archives, manifests and conversation repair, against brute force."""

import base64
import collections
import hashlib
import heapq
import io
import re
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.functions.shared import new_path
from tidemark.llm import merkle, turn_repair, warc_bundles
from tidemark.llm.queries import ORACLES, QUERIES

SMALL, SF_DIR = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# Archives

PAGES = [(i, f"http://x/{i}\n y", f"<p>{i % 7}</p>" * (i % 5)) for i in range(120)] + [
    (None, None, None), (3, "u", "<p>3</p>" * 3), (3, "u", "<p>3</p>" * 3), (500, "u", "z" * 3_000_000), (None, "a", "q"), (None, "b", "q"), (501, "", "é\r\n\r\nWARC/1.1\r\n"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "own", "own", "own", "own") for r in rows], "page_id bigint, url string, html string, id string, `key` string, lead string, payload string")


def brute_pages(rows, least=0):
    by = collections.defaultdict(list)
    for i, _, html in rows:
        by[(html or "").encode()].append(i)
    out = []
    for payload, ids in by.items():
        lead = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            answer = len(payload) < least or (i == lead and first)
            first = first and i != lead
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            out.append((i, len(payload), digest, "response" if answer else "revisit", None if answer else lead))
    return sorted(out, key=repr)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("least", [0, 10])
def test_archives_equal_brute_force(spark, rows, least):
    folder = new_path(spark, "warc")
    index = warc_bundles.write_archives(pages(spark, PAGES), folder, least_bytes=least)
    assert rows(warc_bundles.read_archives(spark, folder, index), *COLUMNS) == brute_pages(PAGES, least)
    whole = {r.record_id: r for r in warc_bundles.read_archives(spark, folder, index).collect()}
    assert len(whole) == len(PAGES) and all(r.record_type == "revisit" or hashlib.sha1(r.payload).digest() == base64.b32decode(r.payload_digest) for r in whole.values())
    wanted = index.where("page_id IN (5, 500, 501, 77)")
    got = {r.record_id: r for r in warc_bundles.fetch(folder, wanted).collect()}
    assert {r.record_id for r in wanted.collect()} == set(got) and all(whole[k] == r for k, r in got.items())


def test_archives_of_given_and_empty_tables(spark, rows):
    given = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    assert rows(QUERIES["op11_warc_bundles"](spark, SF_DIR), *COLUMNS) == brute_pages([(r.page_id, r.url, r.html) for r in given.collect()])
    assert warc_bundles.through_archives(pages(spark, [])).count() == 0


def test_frames_are_read_alone_and_checked():
    out = io.BytesIO()
    bundle = warc_bundles.Bundle(out)
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, int(n)).astype(np.uint8).tobytes() for n in rng.integers(0, 400_000, 30)]
    records = [warc_bundles.page_record(i, "u", p, False, None, 0)[1] for i, p in enumerate(payloads)]
    places = [bundle.add(r) for r in records]
    bundle.close()
    frames = warc_bundles.Frames(out, out.tell())
    assert len(frames) > 4 and len({f for f, _ in places}) == len(frames)
    for (f, at), r, p in zip(places, records, payloads, strict=True):
        assert frames.frame(f)[at : at + len(r)] == r
        ((fields, block),) = warc_bundles.parse_records(r)
        assert warc_bundles.page_row(fields, block)[-1] == p
    # A plain decompressor passes over the seek table.
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert plain == b"".join(records)
    broken = bytearray(out.getvalue())
    broken[frames.starts[2] + 30] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        warc_bundles.Frames(io.BytesIO(broken), len(broken)).frame(2)
    with pytest.raises(ValueError):
        warc_bundles.page_row(fields | {"warc-payload-digest": "sha1:" + "A" * 32}, block)


# Manifests


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def brute_manifest(rows, arity):
    """Leaf, subroot, root and the siblings of every row (doc_id, source, lang, n_chars, text)."""

    def tree(hashes):
        paths, at = [[] for _ in hashes], list(range(len(hashes)))
        while len(hashes) > 1:
            for p, i in zip(paths, at, strict=True):
                low = i - i % arity
                p.append((hashes[low:i], hashes[i + 1 : low + arity]))
            hashes = [digest(*hashes[i : i + arity]) for i in range(0, len(hashes), arity)]
            at = [i // arity for i in at]
        return hashes[0], paths

    by = collections.defaultdict(list)
    for r in rows:
        own = digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
        by[r[2]].append((r[0] is not None, r[0] or 0, own, r))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(by[g], key=lambda x: x[:3]), *tree([x[2] for x in sorted(by[g], key=lambda x: x[:3])])) for g in groups}
    root, above = tree([trees[g][1] for g in groups])
    out = []
    for g, path in zip(groups, above, strict=True):
        leaves, subroot, paths = trees[g]
        for (_, _, own, r), p in zip(leaves, paths, strict=True):
            out.append((r[0], own, subroot, root, digest(*(x for a, b in p + path for x in a + b))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_equals_brute_force(spark, rows, arity):
    docs = [(i, "s", "en" if i % 3 else "de", i, f"text {i}é") for i in range(60)]
    docs += [(7, "s", "en", 7, "text 7é"), (7, "s", "en", 7, "other"), (None, None, None, None, None), (None, None, "en", 1, ""), (3, "", "", 0, "x" * 300_000), (4, "s", "é", -1, "one"), (5, "s", "zz", None, None)]
    df = spark.createDataFrame([(*d, "own", "own") for d in docs], "doc_id bigint, source string, lang string, n_chars bigint, text string, h string, idx string")
    made = merkle.manifest(df, arity=arity).withColumn("proof", merkle.proof_digest()).withColumn("folded", merkle.folded())
    assert rows(made, "id", "leaf", "subroot", "root", "proof") == brute_manifest(docs, arity)
    assert made.where("folded <> root").isEmpty()
    wrong = merkle.manifest(df, arity=arity, claimed={"text": F.lit("forged")})
    assert wrong.where(merkle.folded() == F.col("root")).isEmpty()
    assert merkle.manifest(df.limit(0), arity=arity).count() == 0
    (one,) = merkle.tampered_manifest(df.where("doc_id = 4 AND text = 'one'")).collect()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == digest()
    with pytest.raises(ValueError):
        merkle.manifest(df, arity=1)


def test_tampered_rows_are_found(spark):
    given = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("n_chars", F.when(F.col("doc_id") % 5 != 0, F.col("n_chars")))
    got = merkle.tampered_manifest(given).collect()
    for r, n in ((r, n) for r in got for n in [r.doc_id]):
        assert r.verified == (zlib.crc32(str(n).encode()) % 7 != 0 or n % 5 == 0)
    db = duckdb.connect()
    db.register("documents", given.toArrow())
    assert sorted(map(tuple, got)) == sorted(db.execute(ORACLES["op12_merkle_manifest"]).fetchall())


# Conversations


def faults_of(turns):
    seen, out = set(), []
    for _, role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "o")
        seen.add((role, text))
    return out


def brute_repair(turns):
    """Cheapest edits of one conversation, by search over (turn, grammar state)."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0))
    faults = faults_of(turns)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, state, out = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(turns) and state in ("", "a"):
            break
        for x, role in (("u", "user"), ("a", "assistant")):
            if (state, x) in step:
                heapq.heappush(heap, (cost + 2, audit + "I", at, step[state, x], (*out, role + ":")))
        if at < len(turns):
            _, role, text = turns[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, out))
            if faults[at] not in "bd":
                more = faults[at] == "t"
                for x, other in (("u", "user"), ("a", "assistant")):
                    if (state, x) in step:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, step[state, x], (*out, f"{other}:{text}")))
                kept = state if role == "" else step.get((state, role[0]))
                if kept is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, kept, (*out, f"{role}:{text}")))
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute_damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fault, turns = zlib.crc32(key.encode()) % 20, out[conv]
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        turns += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def brute_conversations(rows):
    return sorted(((c, *brute_repair(t)) for c, t in brute_damage(rows).items()), key=repr)


SHOWN = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
TURNS = "conv_id bigint, turn bigint, role string, text string, conv string, h1 string, audit string, place string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "own", "own", "own", "own") for r in rows], TURNS)


def test_repair_equals_brute_force(spark, rows):
    rng = np.random.default_rng(4)
    roles = ["user", "assistant", "system", "tool", None, ""]
    texts = ["Yes.", "no", "Why?", "", None, " \t", "long " * 3000 + "end!", "é!", "Yes."]
    turns = []
    for c in range(250):
        n = int(rng.integers(1, 14)) if c else 400
        turns += [(c, 2 * t if c % 5 else t, roles[rng.integers(0, 6 if c % 2 else 2)], texts[rng.integers(0, 9)] if c % 3 else f"text {t}.") for t in range(n)]
    turns += [(None, t, "user", f"t{t}!") for t in range(6)] + [(900, None, "user", "Null turn."), (900, 5, "assistant", "Five."), (901, None, None, None)]
    assert rows(turn_repair.repaired_conversations(table(spark, turns)), *SHOWN) == brute_conversations(turns)
    assert turn_repair.repaired_conversations(table(spark, [])).count() == 0
    gone = [(c, 0, "user", "Hm.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = turn_repair.repaired_conversations(table(spark, gone)).collect()
    assert len(got) == len(gone) > 0 and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", digest()) for r in got)


def test_given_conversations(spark, rows):
    given = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    assert rows(QUERIES["op13_turn_repair"](spark, SF_DIR), *SHOWN) == brute_conversations([tuple(r) for r in given.collect()])


def test_repaired_turns(spark):
    turns = [(1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 4, "system", "Be kind."), (1, 5, "assistant", "Well")]
    got = turn_repair.Repair(table(spark, turns)).turns().orderBy("place").collect()
    assert [(r.place, r.turn, r.role, r.text, r.edit) for r in got][0] == (0, 1, "user", "Hi.", "keep")
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in got))


def test_states_are_shared():
    """Sorted by their reversal, signatures add a state for each suffix that none before them has."""
    rng = np.random.default_rng(6)
    words = sorted({"".join(rng.choice(list("suaxedUA"), rng.integers(0, 9))) + "uaua" for _ in range(500)}, key=lambda w: w[::-1])
    automaton = turn_repair.SuffixAutomaton()
    made = [automaton.repair(w) for w in words]
    suffixes = {w[i:] for w in words for i in range(len(w))}
    assert automaton.made == len(suffixes) and len(automaton.table) < 200
    assert made == [turn_repair.SuffixAutomaton().repair(w) for w in words]
