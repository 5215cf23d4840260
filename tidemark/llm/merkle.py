"""Merkle manifest of a table: every row gets a leaf, a path of siblings, and one root for all.

A row's leaf is the SHA-256 of its columns, each with its length before it. Leaves are ordered by id within their group,
and every ``arity`` consecutive nodes (the last run may be shorter, even a lone node) become the hash of their hex
digests, until one is left, the subroot. The subroots, ordered by group, become one root in the same way.

Each level is one round of self-joins: a node is joined with its siblings by their computed index, ``idx ^ 1`` for pairs
and ``idx - slot + (slot + s) % arity`` for wider runs, and then the rows of slot zero, which now hold the whole run,
emit the parents. Every level is stored, so the work is n + n/2 + n/4 ... narrow rows, and a lost executor brings back
one level. Paths go the other way: a child takes its parent's path, subroot and root and puts its own siblings in
front; that is a join with ``arity`` rows a key on the many side at most, so a group with most of the rows is no hot key.

Ids are numbered by range partitions with a running count over (group, partition), never by a window over a group.

Defined results: nulls in a hashed column count as ``-``; a null group is a group of its own, before all others; null ids
come first, and rows with equal ids are ordered by their leaf; rows that are repeated are leaves of their own; an
empty table gives no rows; columns that are not named are never read, whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.shared import settle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of paths that one job joins before they are stored.
STRIDE = 4


def leaf(columns: list[Column]) -> Column:
    """SHA-256 (lowercase hex) of values as decimal or text, each after its number of bytes and a colon; ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Stored: ``idx`` (from 0 by ``order`` within ``group``) and ``n`` (rows of the group) beside the columns of df."""
    dealt = settle(df.repartitionByRange(F.col(group), *order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy(group, "part").agg(F.count(F.lit(1)).alias("size"))
    mine = Window.partitionBy(group)
    before = sizes.select(group, "part", F.coalesce(F.sum("size").over(mine.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("size").over(mine).alias("n"))
    inside = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order))
    placed = dealt.withColumn("place", inside).join(before, [group, "part"])
    return settle(placed.withColumn("idx", (F.col("before") + F.col("place") - 1).cast("bigint")).drop("part", "place", "before"))


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (grp, idx, n, h, own) with the digests of their run before and after them, as bytes."""
    out = nodes
    for s in range(1, arity):
        sibling = "idx ^ 1" if arity == 2 else f"idx - idx % {arity} + (idx % {arity} + {s}) % {arity}"
        out = out.withColumn("at", F.expr(sibling)).join(nodes.selectExpr("grp", "idx AS at", f"h AS h{s}"), ["grp", "at"], "left").drop("at")
    run = [f"struct((idx % {arity} + {s}) % {arity} AS slot, h{s} AS h)" for s in range(1, arity)]
    out = out.withColumn("run", F.expr(f"array_sort(filter(array({', '.join(run)}), x -> x.h IS NOT NULL))"))
    before, after = (F.expr(f"unhex(array_join(transform(filter(run, x -> x.slot {side} idx % {arity}), x -> hex(x.h)), ''))") for side in "<>")
    return out.select("grp", "idx", "n", "h", "own", before.alias("before"), after.alias("after"))


def climb(nodes: DataFrame, deepest: int, arity: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """All levels with siblings, from the leaves up, and for each level (and one more) the nodes that are their group's last."""
    levels, tops = [], []
    for _ in range(deepest):
        tops.append(nodes.where("n = 1"))
        level = settle(with_siblings(nodes.where("n > 1"), arity))
        levels.append(level)
        parent = "unhex(sha2(concat(lower(hex(h)), lower(hex(after))), 256))"
        nodes = level.where(f"idx % {arity} = 0").selectExpr("grp", f"idx div {arity} AS idx", f"(n + {arity - 1}) div {arity} AS n", f"{parent} AS h", "CAST(NULL AS struct<id: bigint, claimed: string>) AS own")
    return levels, [*tops, nodes.where("n = 1")]


def descend(levels: list[DataFrame], tops: list[DataFrame], arity: int) -> DataFrame:
    """Leaves with what ``tops`` carry (path, subroot, root), their own siblings in front of the path."""
    now = tops[-1]
    for d in reversed(range(len(levels))):
        parents = now.selectExpr("grp", "idx AS at", "path AS further", "subroot", "root")
        down = levels[d].withColumn("at", F.expr(f"idx div {arity}")).join(parents, ["grp", "at"])
        down = down.selectExpr("grp", "idx", "h", "own", "concat(array(struct(before, after)), further) AS path", "subroot", "root")
        now = down.unionByName(tops[d])
        if d and d % STRIDE == 0:
            now = settle(now)
    return now


def _depth(n: int, arity: int) -> int:
    levels = 0
    while n > 1:
        n, levels = math.ceil(n / arity), levels + 1
    return levels


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = COLUMNS, arity: int = 2, claimed: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of df: id, leaf, subroot, root, path (array of before, after: the digests of the run's others, as
    bytes, from the leaf up), and claimed: the leaf of the row with the values of ``claimed`` in place of its own."""
    if arity < 2:
        raise ValueError("a run must hold two nodes at least")
    other = {c: (claimed or {}).get(c, F.col(f"`{c}`")) for c in columns}
    grp = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))  # null first, then by bytes
    rows = settle(df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), grp.alias("grp"), F.unhex(leaf([F.col(f"`{c}`") for c in columns])).alias("h"), leaf(list(other.values())).alias("claimed")))
    leaves = numbered(rows, "grp", [F.col("id").asc_nulls_first(), F.col("h"), F.col("claimed")])
    nodes = leaves.selectExpr("grp", "idx", "n", "h", "struct(id, claimed) AS own")
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, tops = climb(nodes, _depth(most, arity), arity)
    ends = tops[0]
    for t in tops[1:]:
        ends = ends.unionByName(t)
    ends = settle(ends.select("grp", "h"))
    above = numbered(ends.selectExpr("'' AS grp", "grp AS id", "h"), "grp", [F.col("id")]).withColumnRenamed("id", "name")
    names = above.selectExpr("idx", "name")
    upper = above.selectExpr("grp", "idx", "n", "h", "CAST(NULL AS struct<id: bigint, claimed: string>) AS own")
    high, last = climb(upper, _depth(above.count(), arity), arity)
    empty = "CAST(array() AS array<struct<before: binary, after: binary>>) AS path"
    seeds = [t.selectExpr("grp", "idx", "h", "own", empty, "lower(hex(h)) AS subroot", "lower(hex(h)) AS root") for t in last]
    by_group = settle(descend(high, seeds, arity).join(names, "idx").selectExpr("name AS grp", "path", "lower(hex(h)) AS subroot", "root"))
    begin = [t.join(by_group, "grp").select("grp", "idx", "h", "own", "path", "subroot", "root") for t in tops]
    found = descend(levels, begin, arity)
    return found.selectExpr("own.id AS id", "lower(hex(h)) AS leaf", "subroot", "root", "path", "own.claimed AS claimed")


def folded(leaf_col: str = "claimed", path_col: str = "path") -> Column:
    """The root that a leaf and a path of siblings lead to."""
    return F.expr(f"aggregate({path_col}, {leaf_col}, (h, s) -> sha2(concat(lower(hex(s.before)), h, lower(hex(s.after))), 256))")


def proof_digest(path_col: str = "path") -> Column:
    """SHA-256 of all siblings' digests as text, from the leaf up, each run from left to right."""
    return F.sha2(F.array_join(F.expr(f"transform({path_col}, s -> lower(hex(concat(s.before, s.after))))"), ""), 256)


def tampered_manifest(df: DataFrame) -> DataFrame:
    """The manifest of documents, checked against a copy in which n_chars is one more where 7 divides the id's crc32."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = manifest(df, claimed={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    digests = made.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), folded().alias("folded_root"))
    return digests.withColumn("verified", F.col("folded_root") == F.col("root"))


_VALUE = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_VALUE.format(c) for c in COLUMNS) + ")"
_CLAIMED = "sha256(" + " || ".join(_VALUE.format(c if c != "n_chars" else "(n_chars + hit)") for c in COLUMNS) + ")"
#: crc32 of a short text: the bytes from left to right, eight shifts each.
_SHIFTED = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
_CRC = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {_SHIFTED}), 4294967295)"


def _up(name: str, base: str) -> str:
    step = "SELECT grp, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2"
    return f"{name} AS ({base} UNION ALL {step} FROM {name} WHERE n > 1 GROUP BY grp, lvl, idx // 2, n)"


ORACLE = f"""
WITH RECURSIVE hits AS (
  SELECT *, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 7 = 0 THEN 1 ELSE 0 END AS hit FROM documents
), leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, {_LEAF} AS h, {_CLAIMED} AS claimed FROM hits
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h, claimed) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM leaves
), {_up("nodes", "SELECT grp, 0 AS lvl, idx, h, n FROM placed")},
subroots AS (SELECT grp, max_by(h, lvl) AS subroot, max(lvl) AS depth FROM nodes GROUP BY grp),
tops AS (SELECT '' AS grp, grp AS name, 0 AS lvl, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx, subroot AS h, count(*) OVER () AS n, depth FROM subroots),
{_up("above", "SELECT grp, lvl, idx, h, n FROM tops")},
paths AS (
  SELECT p.grp AS grp, p.idx AS leaf, s.lvl AS step, (p.idx >> s.lvl) & 1 AS slot, x.h AS sib
  FROM placed p JOIN subroots d ON d.grp = p.grp JOIN nodes s ON s.grp = p.grp AND s.lvl < d.depth AND s.idx = p.idx >> s.lvl
  LEFT JOIN nodes x ON x.grp = p.grp AND x.lvl = s.lvl AND x.idx = xor(p.idx >> s.lvl, 1)
  UNION ALL
  SELECT p.grp, p.idx, t.depth + s.lvl, (t.idx >> s.lvl) & 1, x.h
  FROM placed p JOIN tops t ON t.name = p.grp JOIN above s ON s.n > 1 AND s.idx = t.idx >> s.lvl
  LEFT JOIN above x ON x.lvl = s.lvl AND x.idx = xor(t.idx >> s.lvl, 1)
), proofs AS (
  SELECT grp, leaf, sha256(string_agg(coalesce(sib, ''), '' ORDER BY step)) AS proof, count(*) AS steps FROM paths GROUP BY grp, leaf
), folds AS (
  SELECT grp, idx AS leaf, 0 AS step, claimed AS h FROM placed
  UNION ALL
  SELECT f.grp, f.leaf, f.step + 1, CASE WHEN p.slot = 1 THEN sha256(p.sib || f.h) ELSE sha256(f.h || coalesce(p.sib, '')) END
  FROM folds f JOIN paths p ON p.grp = f.grp AND p.leaf = f.leaf AND p.step = f.step
), ends AS (SELECT grp, leaf, max_by(h, step) AS folded FROM folds GROUP BY grp, leaf),
top AS (SELECT max_by(h, lvl) AS root FROM above)
SELECT p.doc_id AS doc_id, p.h AS leaf, s.subroot AS subroot, top.root AS root, coalesce(x.proof, sha256('')) AS proof_sha256,
  e.folded AS folded_root, e.folded = top.root AS verified
FROM placed p JOIN subroots s ON s.grp = p.grp JOIN ends e ON e.grp = p.grp AND e.leaf = p.idx
LEFT JOIN proofs x ON x.grp = p.grp AND x.leaf = p.idx, top
"""
