"""Merkle manifest of a table by cogrouped subtree exchange.

Every row is a leaf: the digest H of its columns, each ``-`` if null, else UTF-8 byte count,
``:`` and value. H is the lowercase hex sha256 of its inputs in a row, digests as hex text.
The leaves of one key, in order, form a tree: FAN consecutive nodes (the last run: fewer, even
one) become their H until one is left, the key's subroot. Subroots in key order form the tree
above, whose last node is the root.

Leaves are numbered within their key by range partitions, so a hot key spans many tasks, and
cut into superblocks of FAN to the power of ``depth``. Each superblock is reduced to one node; the nodes of
superblocks are the leaves of a tree of their own, solved the same way. What that tree needs
for the path of a superblock, its outer nodes, is then cogrouped with the superblock's leaves,
and one ``applyInPandas`` finishes the local reduction, joins the proofs and folds them. No
task holds more than one superblock and its outer nodes; hashing of texts is the JVM's.

Defined results: null columns count as ``-``, so a null text differs from an empty one; rows of
equal id follow in the order of their leaves, the null id first; repeated rows are leaves of
their own; very long texts cost only their hash; other columns are not read; an empty table
has no rows and no root.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beliefmill.operators.ordering import number_rows
from beliefmill.session import pin

FAN, DEPTH = 8, 4
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = "key string, at long, node string"


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """H of the fields of a row."""
    written = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in (c.cast("string") for c in fields)]
    return F.sha2(F.concat(*written), 256)


def levels(nodes: list[str], depth: int | None) -> list[list[str]]:
    """The nodes of every level, up to ``depth`` levels above, or up to the single last one if
    these nodes are the whole tree (None)."""
    out = [nodes]
    while len(out[-1]) > 1 if depth is None else len(out) <= depth:
        out.append([digest(out[-1][i : i + FAN]) for i in range(0, len(out[-1]), FAN)])
    return out


def path(tree: list[list[str]], i: int) -> list[tuple[int, list[str]]]:
    """Place and run (itself and its siblings) of node i and each of its ancestors but the last."""
    out = []
    for level in tree[:-1]:
        lo = i - i % FAN
        out.append((i - lo, level[lo : lo + FAN]))
        i //= FAN
    return out


def fold(node: str, steps: list[tuple[int, list[str]]]) -> str:
    """The last node, if ``node`` stands at the bottom of the path."""
    for at, run in steps:
        node = digest([*run[:at], node, *run[at + 1 :]])
    return node


def packed(steps: list[tuple[int, list[str]]]) -> str:
    return ";".join(f"{at}:{','.join(run)}" for at, run in steps)


def unpacked(steps: str | None) -> list[tuple[int, list[str]]]:
    cut = (s.split(":") for s in (steps or "").split(";") if s)
    return [(int(at), run.split(",")) for at, run in cut]


def _block(depth: int) -> Column:
    return F.floor(F.col("at") / FAN**depth).cast("long")


def superblock_nodes(leaves: DataFrame, depth: int) -> DataFrame:
    """One node per superblock of (key, at, node); ``at`` counts superblocks."""

    def reduced(group: pd.DataFrame) -> pd.DataFrame:
        top = levels(group.sort_values("at")["node"].tolist(), depth)[-1][0]
        return pd.DataFrame({"key": group["key"].iloc[:1], "at": group["block"].iloc[:1], "node": [top]})

    return leaves.select("key", "at", "node", _block(depth).alias("block")).groupBy("key", "block").applyInPandas(reduced, NODE)


def pyramid(leaves: DataFrame, sizes: DataFrame, depth: int) -> list[tuple[DataFrame, DataFrame]]:
    """Leaves (key, at, node) and their number (key, n) per key; above them the nodes of the
    superblocks of the keys that have several, and so on until no key has."""
    out = [(leaves.select("key", "at", "node"), sizes)]
    while not (large := out[-1][1].where(F.col("n") > FAN**depth)).isEmpty():
        nodes = superblock_nodes(out[-1][0].join(large.select("key"), "key", "left_semi"), depth)
        out.append((pin(nodes), large.select("key", F.ceil(F.col("n") / FAN**depth).cast("long").alias("n"))))
    return out


def _last(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("at")
    return pd.DataFrame({"key": group["key"].iloc[:1], "node": [levels(group["node"].tolist(), None)[-1][0]]})


def subroots(tree: list[tuple[DataFrame, DataFrame]], depth: int) -> DataFrame:
    """(key, node): the last node of every key's tree, found where the key has one superblock."""
    single = [nodes.join(sizes.where(F.col("n") <= FAN**depth).select("key"), "key", "left_semi") for nodes, sizes in tree]
    return reduce(DataFrame.union, [own.groupBy("key").applyInPandas(_last, "key string, node string") for own in single])


def outer_paths(tree: list[tuple[DataFrame, DataFrame]], depth: int) -> DataFrame:
    """(key, block, whole, outer) for every superblock of the lowest leaves: whether it is the
    key's whole tree, else the path of its node to the subroot."""
    sizes = tree[0][1]
    alone = sizes.where(F.col("n") <= FAN**depth).select("key", F.lit(0).cast("long").alias("block"), F.lit(True).alias("whole"), F.lit("").alias("outer"))
    if len(tree) == 1:
        return alone
    above = paths_of(tree[1][0], outer_paths(tree[1:], depth), depth)
    return alone.union(above.select("key", F.col("at").alias("block"), F.lit(False), "steps"))


def paths_of(leaves: DataFrame, outer: DataFrame, depth: int) -> DataFrame:
    """(key, at, node, steps): the path of every node to its key's last node."""

    def joined(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("at")
        tree = levels(leaves["node"].tolist(), None if outer["whole"].iloc[0] else depth)
        above = outer["outer"].iloc[0]
        steps = [";".join(x for x in (packed(path(tree, i)), above) if x) for i in range(len(leaves))]
        return pd.DataFrame({"key": leaves["key"], "at": leaves["at"], "node": leaves["node"], "steps": steps})

    own = leaves.select("key", "at", "node", _block(depth).alias("block"))
    return own.groupBy("key", "block").cogroup(outer.groupBy("key", "block")).applyInPandas(joined, NODE + ", steps string")


MANIFEST = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def finished(leaves: DataFrame, outer: DataFrame, depth: int) -> DataFrame:
    """Cogroup every superblock with its outer nodes: its own levels, the proofs, the folds."""

    def finish(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("at")
        nodes = leaves["node"].tolist()
        tree = levels(nodes, None if outer["whole"].iloc[0] else depth)
        root, subroot, above = outer["root"].iloc[0], outer["subroot"].iloc[0], unpacked(outer["above"].iloc[0])
        proofs, folded = [], []
        for i, given in enumerate(leaves["given"].tolist()):
            steps = path(tree, i) + above
            proofs.append(digest(x for at, run in steps for x in (*run[:at], *run[at + 1 :])))
            folded.append(fold(given, steps))
        return pd.DataFrame({"doc_id": leaves["doc_id"].tolist(), "leaf": nodes, "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})

    blocks = leaves.select("*", _block(depth).alias("block")).groupBy("key", "block")
    return blocks.cogroup(outer.groupBy("key", "block")).applyInPandas(finish, MANIFEST)


def manifest(rows: DataFrame, key: str = "lang", order: str = "doc_id", fields: list[str] = LEAF_COLUMNS, tamper: tuple[str, Column] | None = None, depth: int = DEPTH) -> DataFrame:
    """The ``order`` column, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    ``proof_sha256`` is H of the siblings of the leaf and of its ancestors. ``tamper``: a column
    and the value found for it when the rows are checked; the fold starts from the leaf of
    that, and ``verified`` tells whether it still reaches the root."""
    col = {c: F.col(f"`{c}`") for c in {*fields, key, order}}
    own = leaf([col[c] for c in fields])
    given = leaf([tamper[1] if tamper and c == tamper[0] else col[c] for c in fields]) if tamper else own
    # the stand-in of a null key sorts before all others
    named = F.coalesce(F.concat(F.lit("k"), col[key].cast("string")), F.lit(""))
    leaves = rows.select(named.alias("key"), col[order].alias("doc_id"), own.alias("node"), given.alias("given"))
    leaves = number_rows(leaves, ["key"], [F.col("doc_id").asc_nulls_first(), F.col("node").asc(), F.col("given").asc()], "at")
    leaves = pin(leaves.select("key", (F.col("at") - 1).alias("at"), F.col("doc_id").cast("string").alias("doc_id"), "node", "given"))
    tree = pyramid(leaves, pin(leaves.groupBy("key").agg(F.count(F.lit(1)).alias("n"))), depth)

    tops = pin(number_rows(subroots(tree, depth).select(F.lit("").alias("all"), "key", "node"), ["all"], [F.col("key").asc()], "at"))
    upper = tops.select(F.col("all").alias("key"), (F.col("at") - 1).alias("at"), "node", F.col("key").alias("own"))
    top = pyramid(upper, upper.groupBy("key").agg(F.count(F.lit(1)).alias("n")), depth)
    steps = paths_of(top[0][0], outer_paths(top, depth), depth).select("at", "steps")
    root = subroots(top, depth).select(F.col("node").alias("root"))  # one row
    above = upper.join(steps, "at").join(F.broadcast(root)).select(F.col("own").alias("key"), F.col("node").alias("subroot"), "root", "steps")

    joined = F.concat_ws(";", F.expr("nullif(outer, '')"), F.expr("nullif(steps, '')"))
    outer = outer_paths(tree, depth).join(pin(above), "key").select("key", "block", "whole", joined.alias("above"), "subroot", "root")
    out = finished(leaves, outer, depth)
    return out.withColumn("doc_id", F.col("doc_id").cast(rows.schema[order].dataType)).withColumnRenamed("doc_id", order)


def tampered_manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The manifest of documents; every third of them, by crc32 of the id, comes back in lower case."""
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return manifest(docs, tamper=("text", F.when(touched, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))), depth=depth)


def manifest_sql() -> str:
    def h(c: str) -> str:
        return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR)))::VARCHAR || ':' || CAST({c} AS VARCHAR), '-')"

    def tree(name: str, key: str, source: str) -> str:
        return f"""{name}(k, lvl, i, h, c) AS (
          SELECT {key}, 0, i, h, count(*) OVER (PARTITION BY {key}) FROM {source}
          UNION ALL
          SELECT k, lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), count(*) OVER (PARTITION BY k) FROM {name} WHERE c > 1 GROUP BY k, lvl, i // 8)"""

    crc = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(length(s)), lambda j: ascii(s[j + 1])::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda j: 0::UBIGINT)), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    return f"""
    WITH RECURSIVE d AS (SELECT *, coalesce('k' || lang, '') AS key, CAST(doc_id AS VARCHAR) AS s FROM documents),
    m AS (SELECT *, coalesce(xor({crc}, 4294967295::UBIGINT) % 3 = 0, false) AS hit FROM d),
    v AS (SELECT key, doc_id, sha256({' || '.join(h(c) for c in LEAF_COLUMNS)}) AS h,
                 sha256({' || '.join(h(c) for c in LEAF_COLUMNS[:-1])} || {h(f'(CASE WHEN hit THEN {low} ELSE text END)')}) AS given FROM m),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h, given) - 1 AS i, row_number() OVER () AS r FROM v),
    {tree('t', 'key', 'leaves')},
    sub AS (SELECT k, h, lvl AS top, row_number() OVER (ORDER BY k) - 1 AS i FROM t WHERE c = 1),
    {tree('u', "''", 'sub')},
    steps AS (
      SELECT r, t.lvl AS step, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i < (l.i >> (3 * t.lvl))), '') AS a, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i > (l.i >> (3 * t.lvl))), '') AS b
      FROM leaves l JOIN t ON t.k = l.key AND t.c > 1 AND t.i // 8 = (l.i >> (3 * t.lvl + 3)) GROUP BY r, t.lvl
      UNION ALL
      SELECT r, 1000 + u.lvl, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i < (s.i >> (3 * u.lvl))), ''), coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i > (s.i >> (3 * u.lvl))), '')
      FROM leaves l JOIN sub s ON s.k = l.key JOIN u ON u.c > 1 AND u.i // 8 = (s.i >> (3 * u.lvl + 3)) GROUP BY r, u.lvl),
    n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY step) AS o FROM steps),
    f(r, o, h) AS (SELECT r, 0, given FROM leaves UNION ALL SELECT f.r, f.o + 1, sha256(n.a || f.h || n.b) FROM f JOIN n ON n.r = f.r AND n.o = f.o + 1),
    p AS (SELECT r, sha256(string_agg(a || b, '' ORDER BY o)) AS proof FROM n GROUP BY r),
    root AS (SELECT h AS root FROM u WHERE c = 1)
    SELECT l.doc_id, l.h AS leaf, sub.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, g.h AS folded_root, g.h = root AS verified
    FROM leaves l JOIN sub ON sub.k = l.key CROSS JOIN root LEFT JOIN p USING (r) JOIN (SELECT r, max_by(h, o) AS h FROM f GROUP BY r) g USING (r)"""
