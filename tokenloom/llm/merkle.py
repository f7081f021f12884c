"""A Merkle manifest of a table, with a proof for every row by pointer jumping.

Rows are leaves. The leaves of a group, in key order, form a tree of ``FAN`` children a node;
the roots of the groups, in group order, form one more tree above them. A level is one
grouping of the level below, and the same grouping tells every child the digests of its
siblings to the left and to the right: its segment of the way up.

Proofs are not walked level by level. Every node holds the way to an ancestor as a list of
segments, at first the one to its parent. A self-join on that ancestor appends the ancestor's
own segments, which doubles the distance; after as many rounds as the logarithm of the
height every node's list reaches the root. Leaves take the finished list of their parents
last, so the longest lists are never written once per row.

Digests are 32 bytes in the tables and lower-case hexadecimal text where they are hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import column, fits_broadcast, stored
from tokenloom.operators.ordering import global_index

FAN = 8
BROADCAST_BYTES = 2 * 1024 * 1024
# Upper-case and lower-case letters of ASCII.
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = ["tree", "level", "pos"]
SEGMENT = "struct<left:binary,right:binary>"


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields as text: ``-`` for a null, else byte count, colon and value."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _joined(members: Column) -> Column:
    """The digests of an array of nodes one after another, in binary."""
    return F.aggregate(members, F.lit(b""), lambda acc, m: F.concat(acc, m["digest"]))


def _grow(leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """All edges and the roots of the trees over leaves ``(tree, pos, nodes, digest)``, and the height.

    ``nodes`` is the number of nodes of the tree's level. An edge is a node ``(tree, level,
    pos)`` with its parent's number ``up`` and its segment ``left``, ``right``. A group holds at
    most ``FAN`` nodes, whatever the data.
    """
    level, height = leaves.withColumn("level", F.lit(0)), 0
    most = leaves.agg(F.max("nodes")).first()[0] or 0
    edges, roots = [], []
    while True:
        roots.append(level.where("nodes = 1").select(*NODE, "digest"))
        if most <= 1:
            break
        above = F.floor(F.col("pos") / FAN)
        members = F.array_sort(F.collect_list(F.struct("pos", "digest")))
        runs = level.where("nodes > 1").groupBy("tree", above.alias("up")).agg(members.alias("members"), F.first("nodes").alias("nodes"))
        runs = stored(runs, "merkle-level")
        inside = runs.select("tree", F.lit(height).alias("level"), "up", "members", F.posexplode("members").alias("at", "own"))
        edges.append(
            inside.select(
                "tree", "level", F.col("own.pos").alias("pos"), "up",
                _joined(F.slice("members", F.lit(1), F.col("at"))).alias("left"),
                _joined(F.slice("members", F.col("at") + 2, F.lit(FAN))).alias("right"),
            )
        )
        digest = F.unhex(F.sha2(hex_of(_joined(F.col("members"))), 256))
        height, most = height + 1, -(-most // FAN)
        level = runs.select(
            "tree", F.col("up").alias("pos"), F.ceil(F.col("nodes") / FAN).alias("nodes"), digest.alias("digest"), F.lit(height).alias("level")
        )
    return _united(edges, "tree int, level int, pos long, up long, left binary, right binary", leaves), _united(roots, "", leaves), height


def _united(parts: list[DataFrame], schema: str, like: DataFrame) -> DataFrame:
    if not parts:
        return like.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _key(tree: Column, level: Column, pos: Column) -> Column:
    return F.struct(tree.cast("int").alias("tree"), level.cast("int").alias("level"), pos.cast("long").alias("pos"))


def _ways(edges: DataFrame, height: int) -> DataFrame:
    """``(node, way)``: the segments from every node with a parent up to the root, by doubling.

    ``to`` is the ancestor that a way has reached. Few nodes are ancestors of many, and these
    are few themselves: they are broadcast where measured small. Where they are not, each is
    the ancestor of a bounded share of the nodes.
    """
    ways = stored(edges.select("node", "to", F.array(F.struct("left", "right")).alias("way")), "merkle-ways")
    reach = 1
    while reach < height:
        met = ways.select(F.col("to").alias("_met")).distinct()
        upper = ways.join(met, F.col("node") == F.col("_met"), "left_semi").select(F.col("node").alias("_at"), F.col("to").alias("_to"), F.col("way").alias("_way"))
        upper = stored(upper, "merkle-upper")
        bytes_ = upper.count() * (64 + reach * (FAN - 1) * 32)
        joined = ways.join(F.broadcast(upper) if bytes_ <= BROADCAST_BYTES else upper, F.col("to") == F.col("_at"), "left")
        ways = joined.select("node", F.coalesce("_to", "to").alias("to"), F.when(F.col("_at").isNull(), F.col("way")).otherwise(F.concat("way", "_way")).alias("way"))
        ways = stored(ways, "merkle-ways")
        reach *= 2
    return ways.select("node", "way")


def proofs(leaves: DataFrame, group: str, order: list[str], digest: str = "leaf") -> DataFrame:
    """Add ``subroot``, ``root`` and ``way`` to every row of ``leaves``.

    The row's digest is hexadecimal text in ``digest``. Rows of a ``group`` (null is one, the
    first) are leaves in ``order``, then by digest; the groups' roots are leaves of the upper
    tree in group order. ``way`` is ``array<struct<left binary, right binary>>`` from the leaf
    up: the digests of the siblings on both sides. Only keys and digests are sorted. Rows
    equal in all of these are interchangeable. An empty table gives an empty table.
    """
    spark = leaves.sparkSession
    numbered = stored(global_index(leaves, [F.asc_nulls_first(group), *(F.asc_nulls_first(o) for o in order), digest], "_at"), "merkle-leaves")
    groups = numbered.groupBy(group).agg(F.min("_at").alias("_first"), F.count("*").alias("_nodes"))
    groups = stored(global_index(groups, [F.asc_nulls_first(group)], "_tree"), "merkle-groups")
    same = numbered[group].eqNullSafe(groups[group])
    small = F.broadcast(groups) if fits_broadcast(groups) else groups
    placed = numbered.join(small, same).drop(groups[group]).select(
        *leaves.columns, F.col("_tree").cast("int").alias("_tree"), (F.col("_at") - F.col("_first")).alias("_pos"), "_nodes"
    )
    placed = stored(placed, "merkle-placed")
    lower = placed.select(F.col("_tree").alias("tree"), F.col("_pos").alias("pos"), F.col("_nodes").alias("nodes"), F.unhex(digest).alias("digest"))
    edges, roots, height = _grow(lower)
    roots = stored(roots, "merkle-roots")
    # The roots of the groups are the leaves of tree -1; an edge out of them starts at the group's root.
    upper = roots.select(F.lit(-1).alias("tree"), F.col("tree").cast("long").alias("pos"), F.lit(groups.count()).cast("long").alias("nodes"), "digest")
    top_edges, top, top_height = _grow(upper)
    root = top.select(F.lower(F.hex("digest"))).first()
    above = roots.select(F.col("tree").cast("long").alias("_pos"), _key(F.col("tree"), F.col("level"), F.col("pos")).alias("_node"))

    def linked(edges: DataFrame) -> DataFrame:
        return edges.select(
            _key(F.col("tree"), F.col("level"), F.col("pos")).alias("node"),
            _key(F.col("tree"), F.col("level") + 1, F.col("up")).alias("to"), "level", "pos", "left", "right",
        )

    tops = linked(top_edges).join(F.broadcast(above) if fits_broadcast(above.select("_pos")) else above, (F.col("level") == 0) & (F.col("pos") == F.col("_pos")), "left")
    tops = tops.withColumn("node", F.coalesce("_node", "node"))
    steps = linked(edges).unionByName(tops.select("node", "to", "level", "pos", "left", "right"))
    # A leaf has level 0 in a tree of its own; the root of a tree of one leaf is that leaf.
    is_leaf = (F.col("node.tree") >= 0) & (F.col("node.level") == 0)
    ways = _ways(steps.where(~is_leaf).select("node", "to", "left", "right"), height + top_height)
    own = steps.where(is_leaf).select(F.col("node.tree").alias("_tree"), F.col("node.pos").alias("_pos"), F.col("to").alias("_to"), "left", "right")
    subroots = roots.select(F.col("tree").alias("_tree"), hex_of(F.col("digest")).alias("subroot"))
    small = F.broadcast(subroots) if fits_broadcast(subroots) else subroots
    first = placed.join(own, ["_tree", "_pos"], "left").join(small, "_tree")
    none = F.array().cast(f"array<{SEGMENT}>")
    segment = F.when(F.col("_to").isNull(), none).otherwise(F.array(F.struct("left", "right")))
    full = first.join(ways, F.col("_to") == F.col("node"), "left")
    way = F.concat(segment, F.coalesce("way", none))
    return full.select(*leaves.columns, "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), way.alias("way"))


def proof_digest(way: Column) -> Column:
    """SHA-256 of all siblings of a way, level by level, left to right."""
    siblings = F.transform(way, lambda s: hex_of(F.concat(s["left"], s["right"])))
    return F.sha2(F.array_join(siblings, ""), 256)


def folded(leaf: Column, way: Column) -> Column:
    """The root that follows from a leaf's digest and its way."""
    return F.aggregate(way, leaf, lambda acc, s: F.sha2(F.concat(hex_of(s["left"]), acc, hex_of(s["right"])), 256))


def manifest(docs: DataFrame, key: str, group: str, fields: list[str], text: str) -> DataFrame:
    """``(key, leaf, tampered_leaf, subroot, root, way)`` for every row of ``docs``.

    A leaf is the digest of ``fields``. ``tampered_leaf`` is what the leaf would be with the
    capitals of ``text`` made small. A null is a value of its own, unlike an empty text; a
    null key stands first. Rows are read once and only digests and keys move after that;
    columns other than these are not read.
    """
    given = {f: column(docs, f) for f in fields}
    changed = given | {text: F.translate(column(docs, text), CAPITALS, SMALL)}
    digests = docs.select(
        column(docs, key).alias("key"), column(docs, group).alias("group"),
        field_digest(list(given.values())).alias("leaf"), field_digest(list(changed.values())).alias("tampered_leaf"),
    )
    return proofs(stored(digests, "merkle-digests"), "group", ["key"])
