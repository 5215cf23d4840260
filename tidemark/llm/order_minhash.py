"""Near duplicates by Order MinHash, with banded alignment of the candidates.

A text is its lower-cased words; its k-mers are runs of five words, each labelled with its occurrence number, so no
text has a k-mer twice. A sample takes the ``PICK`` k-mers with the least hashes and hashes them *in text order*: two
texts agree on it only if they share those k-mers in the same order, which follows edit similarity where plain MinHash
follows the set. Each sample is a band; texts that share a band are candidates.

Candidates are compared by aligning their k-mers: M is the longest run of matches in order, inside the band of
diagonals that a similar pair can use, and the similarity is M / (a + b - M), at least 0.8 for a link. As labelled
k-mers are unique the alignment is an increasing subsequence.

Classes are the connected components of the links. Equal word sequences are one node from the start. A pair in one
bucket is left out only if it is in one component already, too unlike in length, or can't be similar by its k-mers:

* In buckets of at most ``SMALL`` members all pairs meet. In larger ones all members meet one hub.
* Members of large buckets that are still in several components meet by the *prefix* of their k-mers. A link needs
  0.8 n common k-mers of a text's n, so with all k-mers in one order, rare ones first, two similar texts share one of
  their n - ceil(0.8 n) + 1 first. The order is by number of such members, then hash. Texts that are alike by boilerplate
  only have k-mers of their own at the front and never meet.
* Members that share such a k-mer are a bucket again. A member's *room* there is the number of its k-mers from that one on.
  At the first k-mer two texts share, all they have in common lies in the room of both, so both rooms must hold the
  4 (a + b) / 9 common k-mers a link needs, and the shorter text's room 8/9 of its own. Only members with that much room
  become hubs; a hub meets all open members it has room with and is retired: first the one with the largest
  share of room, then 32 times as many each round. A bucket ends when its open members are in one
  component or none is left to be a hub, and the rounds end when all buckets have.

At a similarity of exactly 0.8 a sample of six agrees with probability 0.21 to 0.26, so a pair shares none of the 24 bands with
probability 0.004 at most; at 0.85 with 0.0004. Texts of up to 40 k-mers also sample three, as six are too many of so few.

Defined results: a null text is a class of its own; texts without words are in one class if they are equal; texts
with fewer than five words only match an equal word sequence; the class id is the least id of its rows, null ids being
ignored unless there is no other; rows that are repeated get the same class. Other columns are never read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.shared import settle
from .blocks import ALNUM, blocks, counts, kgrams, mix, word_hashes, word_spans
from .tables import free_name, once

K = 5
SIMILARITY = 0.8
SAMPLES = 24
PICK, PICK_SHORT, SHORT = 6, 3, 32
SMALL = 8
GROWTH = 32
ROWS_PER_FILE = 50_000
#: Small sides of joins are broadcast up to so many narrow rows.
BROADCAST_ROWS = 100_000
#: Least room of the shorter text of a link, as a part of its k-mers.
HUB_ROOM = 2 * SIMILARITY / (1 + SIMILARITY)
MAP_BITS = 26

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * _STEP)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def labelled_kmers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mers in text order and their texts; word hashes and their texts."""
    starts, ends, doc = word_spans(data, offsets, ALNUM)
    h = word_hashes(data, starts, ends)
    grams, at = kgrams(h, doc, K)
    own = doc[at]
    key = mix(grams + own.astype(np.uint64) * _STEP)
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    seen = np.arange(len(key))
    occurrence = np.empty(len(key), np.uint64)
    occurrence[order] = seen - np.maximum.accumulate(np.where(fresh, seen, 0))
    return mix(grams + occurrence * _SPREAD), own, h, doc


def _sample(kmers: np.ndarray, own: np.ndarray, n: np.ndarray, texts: np.ndarray, pick: int, seed: np.uint64) -> np.ndarray:
    """One sample of each of ``texts`` (indices; each has at least ``pick`` k-mers)."""
    x = (kmers ^ seed) * _SPREAD
    x ^= x >> np.uint64(32)
    x *= _STEP
    limit = np.zeros(len(n), np.float64)
    limit[texts] = np.minimum(1.0, (pick + 20.0) / n[texts])
    while True:
        chosen = np.flatnonzero(x.astype(np.float64) <= (limit * 2.0**64)[own])
        got = counts(own[chosen], len(n))
        few = texts[got[texts] < pick]
        if not len(few):
            break
        limit[few] = 1.0
    by = np.argsort((own[chosen].astype(np.uint64) << np.uint64(40)) | (x[chosen] >> np.uint64(24)))
    chosen = chosen[by]
    begin = np.concatenate([[0], np.cumsum(got)])[own[chosen]]
    least = np.sort(chosen[np.arange(len(chosen)) - begin < pick]).reshape(-1, pick)  # by text, in text order
    out = np.zeros(len(least), np.uint64)
    for j in range(pick):
        out = mix(out * _STEP + kmers[least[:, j]])
    return out


def signature_block(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each text: two halves of the key of its word sequence, words, k-mers, and bands."""
    n_texts = len(offsets) - 1
    kmers, own, h, doc = labelled_kmers(data, offsets)
    n_words, n = counts(doc, n_texts), counts(own, n_texts)
    first = np.concatenate([[0], np.cumsum(n_words)])
    place = (np.arange(len(h)) - first[doc]).astype(np.uint64)
    halves = []
    for salt in (_STEP, _SPREAD):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(mix(place * salt + salt) ^ h), dtype=np.uint64)])
        halves.append(mix(total[first[1:]] - total[first[:-1]] + n_words.astype(np.uint64) * salt))
    bands: list[np.ndarray] = [np.zeros(0, np.uint64)] * n_texts
    for pick, texts in ((PICK_SHORT, np.flatnonzero((n >= PICK_SHORT) & (n <= SHORT / SIMILARITY))), (PICK, np.flatnonzero(n >= SHORT * SIMILARITY))):
        if not len(texts):
            continue
        mine = np.zeros(n_texts, bool)
        mine[texts] = True
        of = mine[own]
        made = np.stack([mix(_sample(kmers[of], own[of], n, texts, pick, s) + np.full(1, 2 * b + (pick == PICK), np.uint64) * _SPREAD) for b, s in enumerate(_SEEDS)], 1)
        for t, row in zip(texts.tolist(), made, strict=True):
            bands[t] = np.concatenate([bands[t], row]) if len(bands[t]) else row
    return halves[0], halves[1], n_words, n, bands


def signature_udf():
    """Arrow UDF: text to key (two longs), number of k-mers, bands."""

    @F.arrow_udf("struct<k1: bigint, k2: bigint, n: int, bands: array<bigint>>")
    def signature(texts: pa.Array) -> pa.Array:
        k1, k2, n, bands = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], []
        for lo, _, data, at in blocks(pc.utf8_lower(texts)):
            a, b, n_words, m, rows = signature_block(data, at)
            for i in np.flatnonzero(n_words == 0):  # no words: the text itself is the key
                whole = xxhash.xxh3_128_intdigest((texts[lo + int(i)].as_py() or "").encode())
                a[i], b[i] = whole & (2**64 - 1), whole >> 64
            k1.append(a.view(np.int64))
            k2.append(b.view(np.int64))
            n.append(m.astype(np.int32))
            bands += rows
        sizes = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
        values = np.concatenate([np.zeros(0, np.uint64), *bands]).view(np.int64)
        columns = [pa.array(np.concatenate(x)) for x in (k1, k2, n)]
        return pa.StructArray.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(sizes), pa.array(values))], names=["k1", "k2", "n", "bands"])

    return signature


def kmers_udf(bitmap):
    """Arrow UDF: text and its hash to its labelled k-mers, null for texts that are no candidates. See ``tables.once``."""

    @F.arrow_udf("array<bigint>")
    def kmers(texts: pa.Array, hashes: pa.Array) -> pa.Array:
        bits, slot = bitmap.value, hashes.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - MAP_BITS)
        wanted = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
        sizes, values = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint64)]
        at = np.flatnonzero(wanted)
        for lo, hi, data, offsets in blocks(pc.utf8_lower(texts.take(pa.array(at)))):
            found, own, _, _ = labelled_kmers(data, offsets)
            sizes[at[lo:hi]] = counts(own, hi - lo)
            values.append(found)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).view(np.int64)), mask=pa.array(~wanted))

    return once(kmers)


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two k-mer sequences, or 0 where it can't reach ``least``."""
    total = len(a) + len(b)
    needed = least * total / (1 + least)
    if min(len(a), len(b)) < needed - 1e-9:
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(ia) < needed - 1e-9:
        return 0.0
    band = total - 2 * needed  # a similar pair leaves at most so many k-mers unmatched
    near = np.abs(ia - ib) <= band + 1e-9
    other = ib[near][np.argsort(ia[near])]
    if len(other) > 1 and np.any(other[1:] < other[:-1]):
        tails: list[int] = []
        for x in other.tolist():
            j = bisect_left(tails, x)
            if j == len(tails):
                tails.append(x)
            else:
                tails[j] = x
        m = len(tails)
    else:
        m = len(other)
    return m / (total - m) if m else 0.0


def similarity_udf():
    """Arrow UDF: two k-mer sequences to their similarity."""

    @F.arrow_udf("double")
    def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
        (x, u), (y, v) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (a, b))
        return pa.array([aligned(x[u[i] : u[i + 1]], y[v[i] : v[i + 1]]) for i in range(len(a))], pa.float64())

    return similarity


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """Bits of the column ``h``; at most 2 ** MAP_BITS / 32768 rows of 4 KB come to the driver, however many hashes."""
    slot = f"shiftrightunsigned(h, {64 - MAP_BITS}) + 1"
    rows = hashes.groupBy(F.expr(f"bitmap_bucket_number({slot})").alias("b")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({slot}))").alias("bits")).collect()
    bits = np.zeros(2**MAP_BITS // 8, np.uint8)
    for r in rows:
        bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _near(df: DataFrame, rows: int) -> DataFrame:
    """A stored table for the small side of a join: broadcast where it has at most ``BROADCAST_ROWS`` narrow rows (a few
    megabytes), joined by shuffle where it has more."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _narrow(df: DataFrame, rows: int) -> DataFrame:
    """A table of narrow rows, stored in a number of files that follows ``rows`` and not the number of partitions."""
    return settle(df.repartition(max(8, rows // ROWS_PER_FILE)))


def components(links: DataFrame, n_links: int) -> DataFrame:
    """node and comp (the least node of its component) of all nodes of ``links`` (a, b).

    Each step takes the least label of a node's neighbours and then that label's own label; every step is stored.
    """
    edges = _narrow(links.select("a", "b").union(links.selectExpr("b AS a", "a AS b")).distinct(), 2 * n_links)
    labels = _narrow(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).selectExpr("node", "least(node, comp) AS comp"), n_links)
    rows = labels.count()
    while True:
        around = edges.join(_near(labels, rows), F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        step = around.join(_near(labels, rows), F.col("node") == F.col("a")).selectExpr("node", "comp AS old", "least(comp, near) AS comp")
        jump = _near(labels.selectExpr("node AS to", "comp AS further"), rows)
        new = _narrow(step.join(jump, F.col("comp") == F.col("to")).selectExpr("node", "old", "least(comp, further) AS comp"), rows)
        labels = new.select("node", "comp")
        if new.where("comp <> old").isEmpty():
            return labels


_CAN_BE_HUB = f"room >= {HUB_ROOM} * n - 1e-9"


def _hubs(open_members: DataFrame, turn: int) -> DataFrame:
    """band and hub: GROWTH ** turn members of each bucket, those with the largest share of room first; in the first turn
    only of buckets of more than ``SMALL``."""
    share = F.col("room") / F.col("n")
    member = F.struct("row", "n", "comp", "room")
    if turn == 0:
        able = F.when(F.expr(_CAN_BE_HUB), F.struct(-share, "row"))
        return open_members.groupBy("band").agg(F.count("*").alias("size"), F.min_by(member, able).alias("hub")).where(f"size > {SMALL} AND hub IS NOT NULL").select("band", "hub")
    place = F.row_number().over(Window.partitionBy("band").orderBy(F.desc(share), "row"))
    return open_members.where(_CAN_BE_HUB).select("band", member.alias("hub"), place.alias("place")).where(F.col("place") <= GROWTH**turn).select("band", "hub")


def _round_pairs(open_members: DataFrame, hubs: DataFrame, rows: int, turn: int) -> DataFrame:
    """Pairs of an open bucket: each member with the hubs; in small buckets all pairs. Never of one component."""
    fit = f"x.comp <> y.comp AND least(x.room, y.room) >= {HUB_ROOM / 2} * (x.n + y.n) - 1e-9"
    pairs = open_members.selectExpr("band", "struct(row, n, comp, room) AS x").join(_near(hubs.selectExpr("band", "hub AS y"), rows), "band").select("x", "y").where(fit)
    if turn == 0:
        few = open_members.join(_near(hubs.select("band"), rows), "band", "left_anti").groupBy("band").agg(F.count("*").alias("size"), F.collect_list(F.struct("row", "n", "comp", "room")).alias("all"))
        each = few.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y")).where("x.row < y.row")
        pairs = pairs.union(each.where(fit))
    return pairs.selectExpr("least(x.row, y.row) AS a", "greatest(x.row, y.row) AS b").distinct()


def _still_open(open_members: DataFrame, size: int, hubs: DataFrame, rows: int, turn: int, comps: DataFrame | None, nodes: int) -> DataFrame:
    """Stored: members that have not met all of their bucket, with their components: those of buckets with hubs that were none.

    After the first turn all buckets have hubs, as ``_several`` leaves only those with a member that can be one.
    """
    left = open_members if turn else open_members.join(_near(hubs.select("band").distinct(), rows), "band", "left_semi")
    left = left.join(_near(hubs.selectExpr("band", "hub.row AS row"), rows), ["band", "row"], "left_anti")
    if comps is not None:
        left = left.drop("comp").join(_near(comps, nodes), F.col("row") == F.col("node"), "left").selectExpr("band", "row", "n", "coalesce(comp, row) AS comp", "room")
    return _several(_narrow(left, size), size)


def _several(members: DataFrame, size: int) -> DataFrame:
    """Stored, as it is read more than once: members of buckets that hold several components and a member that can be a hub."""
    live = members.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.expr(f"bool_or({_CAN_BE_HUB})").alias("able"))
    return _narrow(members.join(live.where("lo <> hi AND able").select("band"), "band", "left_semi"), size)


def _prefix_members(open_members: DataFrame, kmers: DataFrame) -> DataFrame:
    """The open texts as members of new buckets, one for each k-mer of the prefixes of several texts."""
    own = _narrow(open_members.select("row", "n", "comp").distinct(), open_members.count())
    each = settle(kmers.join(_near(own, own.count()), "row").select("row", "n", "comp", F.explode("kmers").alias("band")))
    common = each.groupBy("band").agg(F.count("*").alias("seen")).where("seen > 1")
    mine = Window.partitionBy("row")
    place = F.row_number().over(mine.orderBy("seen", "band")) + F.col("n") - F.count("*").over(mine)  # those of no other text come first
    ranked = each.join(common, "band").withColumn("place", place)
    front = ranked.where(f"place <= n - ceil({SIMILARITY} * n - 1e-9) + 1")
    members = settle(front.selectExpr("band", "row", "n", "comp", "n - place + 1 AS room"))
    return _several(members, members.count())


def _second_hash(text_col: str):
    return F.xxhash64(F.lit(1), text_col)


def signed_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored: row, id, h, h2 (hashes of the text), k1, k2, n, bands of every row; k1 is null for a null text."""
    s = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), _second_hash(text_col).alias("h2"), F.col(text_col).isNull().alias("none"), signature_udf()(F.col(text_col)).alias("s"))
    return settle(s.selectExpr("id", "h", "h2", "if(none, NULL, s.k1) AS k1", "s.k2", "if(none, 0, s.n) AS n", "if(none, NULL, s.bands) AS bands", "monotonically_increasing_id() AS row"))


def link_rows(df: DataFrame, text_col: str, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Stored word sequences (k1, k2, row, least id, rows) and components of their rows (node, comp); no links: None."""
    first = F.min_by(F.struct("row", "n", "h", "h2", "bands"), "row").alias("x")
    nodes = settle(rows.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(first, F.min("id").alias("least_id"), F.count("*").alias("rows")).select("k1", "k2", "x.*", "least_id", "rows"))
    bands = nodes.select("row", "n", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1").select("band")
    members = settle(bands.join(shared, "band", "left_semi"))
    met = _narrow(members.select("row").distinct().join(nodes.select("row", "h", "h2"), "row"), members.count() // len(_SEEDS))
    if met.isEmpty():
        return nodes, None
    bitmap = df.sparkSession.sparkContext.broadcast(bitmap_of(met.select("h")))
    text = df.select(F.xxhash64(text_col).alias("h"), _second_hash(text_col).alias("h2"), F.col(text_col).alias("text"))
    texts = text.select("h", "h2", kmers_udf(bitmap)(F.coalesce("text", F.lit("")), F.col("h")).alias("kmers")).where("kmers IS NOT NULL")
    kmers = settle(texts.groupBy("h", "h2").agg(F.first("kmers").alias("kmers")).join(met, ["h", "h2"]).select("row", "kmers"))
    search = _Search(kmers)
    now = search.round(members.selectExpr("band", "row", "n", "row AS comp", "n AS room"), 0)
    if not now.isEmpty():
        search.bring_up_to_date()
        now, turn = _prefix_members(now, kmers), 0
        while True:
            now, turn = search.round(now, turn), turn + 1
            if now.isEmpty():
                break
    search.bring_up_to_date()
    return nodes, search.comps


class _Search:
    """The rounds of comparing candidates: components found so far, and pairs that need not be tested again."""

    def __init__(self, kmers: DataFrame):
        self.left, self.right = kmers.selectExpr("row AS a", "kmers AS ka"), kmers.selectExpr("row AS b", "kmers AS kb")
        self.comps: DataFrame | None = None
        self.nodes = 0
        self.tested: DataFrame | None = None
        self.n_tested = 0
        self.pending: DataFrame | None = None
        self.n_pending = 0
        self.size = 0

    def round(self, now: DataFrame, turn: int) -> DataFrame:
        """Test the pairs of a round; the members that have not met all of their bucket. ``now`` is stored, and so are they.

        Components only spare pairs, so a round that found links for few of its members leaves them for later.
        """
        self.size = now.count()
        hubs = _narrow(_hubs(now, turn), self.size)
        rows = hubs.count()
        fresh = _round_pairs(now, hubs, rows, turn)
        pairs = _narrow(fresh if self.tested is None else fresh.join(_near(self.tested, self.n_tested), ["a", "b"], "left_anti"), self.size)
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        n_pairs = pairs.count()
        self.n_tested += n_pairs
        if n_pairs <= BROADCAST_ROWS:  # only k-mers of these pairs move
            both = self.left.join(F.broadcast(pairs), "a").join(self.right.join(F.broadcast(pairs), "b"), ["a", "b"])
        else:
            both = pairs.join(self.left, "a").join(self.right, "b")
        scored = both.select("a", "b", similarity_udf()(F.col("ka"), F.col("kb")).alias("s"))
        links = _narrow(scored.where(f"s >= {SIMILARITY}").select("a", "b"), self.size)
        found = links.count()
        if found:
            self.pending, self.n_pending = links if self.pending is None else self.pending.union(links), self.n_pending + found
        if found * 1000 >= self.size:
            self.bring_up_to_date()
        return _still_open(now, self.size, hubs, rows, turn, self.comps, self.nodes)

    def bring_up_to_date(self) -> None:
        """Take the links found since the last time into the components."""
        if self.pending is None:
            return
        links, found = self.pending, self.n_pending
        self.pending, self.n_pending = None, 0
        if self.comps is None:
            self.comps = components(links, found)
        else:
            known = _near(self.comps, self.nodes)
            ends = links.join(known.selectExpr("node AS a", "comp AS ca"), "a", "left").join(known.selectExpr("node AS b", "comp AS cb"), "b", "left")
            lifted = components(ends.selectExpr("coalesce(ca, a) AS a", "coalesce(cb, b) AS b"), found).selectExpr("node AS comp", "comp AS top")
            old = self.comps.join(_near(lifted, lifted.count()), "comp", "left").selectExpr("node", "coalesce(top, comp) AS comp")
            fresh = lifted.join(known.select("node"), F.col("comp") == F.col("node"), "left_anti").selectExpr("comp AS node", "top AS comp")
            self.comps = _narrow(old.union(fresh), self.nodes + found)
        self.nodes = self.comps.count()


def classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, h, class (its least row), class_id, class_size and n_words-independent key of every row."""
    rows = signed_rows(df, id_col, text_col)
    nodes, comps = link_rows(df, text_col, rows)
    if comps is None:
        named = nodes.selectExpr("k1", "k2", "least_id", "rows", "row AS class")
    else:
        named = nodes.join(comps, F.col("row") == F.col("node"), "left").selectExpr("k1", "k2", "least_id", "rows", "coalesce(comp, row) AS class")
    totals = named.groupBy("class").agg(F.min("least_id").alias("class_id"), F.sum("rows").alias("class_size"))
    of = named.join(totals, "class").select("k1", "k2", "class", "class_id", "class_size")
    own = "k1 IS NULL"
    return rows.join(of, ["k1", "k2"], "left").selectExpr("row", "id", "h", f"if({own}, row, class) AS class", f"if({own}, id, class_id) AS class_id", f"if({own}, 1L, class_size) AS class_size")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id (least id of its class), class_size."""
    return classes(df, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "class_size")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that with the least id (null ids last), with all its columns; null texts all stay."""
    made = classes(df.where(F.col(text_col).isNotNull()), id_col, text_col)
    best = settle(made.groupBy("class").agg(F.min_by(F.struct("id", "h"), F.struct(F.col("id").isNull(), "id", "row")).alias("x")).select("x.id", "x.h"))
    h, key, key_h = (free_name(df, n) for n in ("h", "id_of_best", "h_of_best"))
    best = best.select(F.col("id").alias(key), F.col("h").alias(key_h)).distinct()
    hashed = df.where(F.col(text_col).isNotNull()).withColumn(h, F.xxhash64(text_col))
    kept = hashed.join(best, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(h) == F.col(key_h)), "left_semi").dropDuplicates([id_col, h]).drop(h)
    return kept.unionByName(df.where(F.col(text_col).isNull()))
