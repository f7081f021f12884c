"""Near duplicates by circulant MinHash, banding and exact Jaccard.

One permutation scatters a document's shingles over a circle; a second one, shifted by one
place per coordinate, gives every coordinate of the signature. So two permutations serve
for any number of coordinates, and the values of one shingle for all coordinates are
neighbours in memory.

Documents with equal sets are one class from the start. Classes that share a band are
candidates. Within a bucket every class is compared with the bucket's first one, then with
its most central one, which connects nearly all of a group in as many comparisons as it has
members. Classes of one bucket that are still in different components after that are open.
Open classes are compared only where they share one of their rarest shingles: two sets over
the threshold have no room for so many shingles that the other one lacks. So no link that
could join two components is left out, and a group of copies does not become all of its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import SALTS, WORD, column, fits_broadcast, fresh, stored, without_keys

WORDS = 5
CIRCLE = 1 << 20  # places of the two permutations
# 25 bands of 5: a pair at 0.85 is missed once in two million, one at 0.3 is a candidate
# in 6 of 100 cases.
BANDS, ROWS = 25, 5
SALTED_ROWS = 256  # members of a bucket per salt
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_set(text: Column, words: int = WORDS) -> Column:
    """Distinct hashed shingles. With fewer words the whole sequence is one; without, none."""
    tokens = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), F.lit(WORD), F.lit(0))
    # A one-element array binds the words to a name, so that they are extracted once.
    each = F.transform(
        F.array(tokens),
        lambda w: F.when(
            F.size(w) >= words,
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0))),
                    lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(words))),
                )
            ),
        )
        .when(F.size(w) > 0, F.array(F.xxhash64(F.lit("short"), F.array_join(w, " "))))
        .otherwise(F.array().cast("array<bigint>")),
    )
    return F.element_at(each, 1)


class Circulant:
    """The signature of a set of 64-bit numbers."""

    def __init__(self, seed: int, size: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.first = rng.permutation(CIRCLE).astype(np.int32)
        second = rng.permutation(CIRCLE).astype(np.int32)
        ring = np.concatenate((second, second[:size]))
        self.shifted = np.lib.stride_tricks.sliding_window_view(ring, size)

    def signature(self, values: np.ndarray) -> np.ndarray:
        places = self.first[(values.view(np.uint64) >> np.uint64(64 - 20)).astype(np.int64)]
        least = None
        for at in range(0, len(places), 4096):
            part = self.shifted[places[at : at + 4096]].min(axis=0)
            least = part if least is None else np.minimum(least, part)
        return least


def sketch(docs: DataFrame, key: str, text: str, seed: int = 0, words: int = WORDS) -> DataFrame:
    """``(doc, text_hash, n, set_key, bands)``: set size, a digest of the whole set, and the band values.

    Sets are hashed by Spark; a task sees one batch of them. An empty set has no bands.
    """
    bands, rows = BANDS, ROWS

    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        circulant = Circulant(seed, bands * rows)
        mixer = np.random.Generator(np.random.PCG64([seed, 1])).integers(1, 2**63, (bands, rows), np.int64) | 1
        for sets in batches:
            keys, found = [], []
            for one in sets:
                values = one.values.to_numpy(zero_copy_only=False)
                if not len(values):
                    keys.append(None)
                    found.append([])
                    continue
                keys.append(hashlib.md5(np.sort(values).tobytes()).hexdigest())
                signature = circulant.signature(values).astype(np.int64).reshape(bands, rows)
                with np.errstate(over="ignore"):
                    mixed = (signature + 1) * mixer
                    found.append(np.bitwise_xor.reduce(mixed ^ (mixed >> 29), axis=1) * bands + np.arange(bands))
            yield pa.StructArray.from_arrays(
                [pa.array(keys, pa.string()), pa.array(found, pa.list_(pa.int64()))], ["set_key", "bands"]
            )

    signing = F.arrow_udf(signed, "set_key string, bands array<long>", F.ArrowUDFType.SCALAR_ITER)
    body = column(docs, text)
    sets = docs.select(column(docs, key).alias("doc"), F.xxhash64(body).alias("text_hash"), shingle_set(body, words).alias("shingles"))
    made = sets.select("doc", "text_hash", F.size("shingles").cast("long").alias("n"), signing("shingles").alias("made"))
    return made.select("doc", "text_hash", "n", "made.set_key", "made.bands")


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; the root is the least node reachable.

    Rounds of joining all neighbours of a node to the least of them (first the larger ones,
    then the smaller ones) until all edges lead to a root. A long chain halves in every round; a node
    with very many neighbours is met through partial minima. Each round is written to the
    shared folder, so lineage stays short.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def with_least(edges: DataFrame) -> DataFrame:
        """Partial minima first: a node may have very many neighbours."""
        return edges.join(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "a")

    while True:
        # Large star: neighbours above a node go to its least neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        # Small star: a node and its smaller neighbours go to the least of them.
        small = with_least(large)
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct(F.col("a").alias("a"), F.col("least").alias("b")))
        edges = stored(small.select(F.inline(pairs)).where("a <> b").distinct(), "stars")
        # Done when all edges are stars: a node has one neighbour below it, which has none itself.
        ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        if ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` of all links so far, after further ``links``.

    Only links between different components count, and only these are solved; the result is
    the old root's new root.
    """
    ends = links
    for end in ("a", "b"):
        at = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        ends = ends.join(at, end, "left").withColumn(end, F.coalesce(f"root_{end}", end)).drop(f"root_{end}")
    ends = stored(ends.where("a <> b").distinct(), "root-links")
    if ends.isEmpty():
        return roots
    above = stored(components(ends), "root-roots").select(F.col("node").alias("known"), F.col("root").alias("now"))
    moved = roots.join(above, F.col("root") == F.col("known"), "left").select("node", F.coalesce("now", "root").alias("root"))
    alone = above.join(roots.select(F.col("root").alias("known")).distinct(), "known", "left_anti")
    return stored(moved.unionByName(alone.select(F.col("known").alias("node"), F.col("now").alias("root"))), "roots")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of classes whose whole sets reach the threshold.

    One class may stand in very many pairs, as ``a``: its pairs are spread over salts and its
    set copied to each of them.
    """
    pairs = stored(pairs, "candidate-pairs")
    salts = pairs.groupBy("a").agg((F.floor(F.count("*") / SALTED_ROWS) + 1).cast("int").alias("salts"))
    left = sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("left_set")).join(salts, "a")
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    hot = salts.where("salts > 1")
    dealt = pairs.join(F.broadcast(hot) if fits_broadcast(hot) else hot, "a", "left")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    right = sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("right_set"))
    common = F.size(F.array_intersect("left_set", "right_set"))
    union = F.size("left_set") + F.size("right_set") - common
    return dealt.join(right, "b").join(left, ["a", "salt"]).where(common * 100 >= union * percent).select("a", "b")


def _reachable(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The bucket members that could still link, with ``reach``: their shingles that any other member has.

    Two sets have no more in common than the smaller reach, so a set most of whose shingles
    are its own is decided without a comparison.
    """
    own = sets.join(members.select("set_key").distinct(), "set_key").select("set_key", F.explode("shingles").alias("shingle"))
    lone = own.groupBy("shingle").agg(F.count("*").alias("uses"), F.min("set_key").alias("set_key")).where("uses = 1")
    lone = lone.groupBy("set_key").agg(F.count("*").alias("lone"))
    reach = F.col("n") - F.coalesce("lone", F.lit(0))
    return members.join(lone, "set_key", "left").select("bucket", "set_key", "n", "root", reach.alias("reach")).where(F.col("reach") * 100 >= F.col("n") * percent)


def _to_middle(members: DataFrame) -> DataFrame:
    """Each member with the member of its bucket that has the largest share in common with the others."""
    share = F.col("reach") / F.col("n")
    middle = members.groupBy("bucket").agg(F.max(F.struct(share.alias("share"), "set_key", "n", "root", "reach")).alias("m"))
    return members.join(middle, "bucket").select("set_key", "n", "root", "reach", F.col("m.set_key").alias("b"), F.col("m.n").alias("b_n"), F.col("m.root").alias("b_root"), F.col("m.reach").alias("b_reach"))


def _rarest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(shingle, place, set_key, n, root)``: the rarest shingles of every open class, in order of rarity.

    Two sets over the threshold share a shingle among as many of the rarest ones of each as it
    may lack of its partner's, and one more.
    """
    one_each = members.select("set_key", "n", "root").distinct()
    own = stored(sets.join(one_each, "set_key").select("set_key", "n", "root", F.explode("shingles").alias("shingle")), "open-shingles")
    uses = own.groupBy("shingle").agg(F.count("*").alias("uses")).where("uses > 1")
    # A shingle that no other open class has cannot be shared, but takes a place.
    ranked = own.join(uses, "shingle", "left").withColumn("uses", F.coalesce("uses", F.lit(1)))
    order = Window.partitionBy("set_key").orderBy("uses", "shingle")
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    placed = ranked.withColumn("place", F.row_number().over(order)).where((F.col("place") <= most) & (F.col("uses") > 1))
    return stored(placed.select("shingle", "place", "set_key", "n", "root"), "rarest")


def _across(rarest: DataFrame, percent: int) -> DataFrame:
    """Pairs of open classes of different components that can still reach the threshold.

    At the first shingle two sets share, they have no more in common than it and what follows it
    in either. Of two classes in different components one is outside the largest component
    that has the shingle, so only those outside meet all; the rows of a shingle that very many
    have are spread over salts, and the ones outside copied to each.
    """
    parts = rarest.groupBy("shingle", "root").agg(F.count("*").alias("part"))
    salts = F.least(F.lit(SALTS), F.floor(F.sum("part") / SALTED_ROWS) + 1).cast("int")
    largest = parts.groupBy("shingle").agg(F.max_by("root", F.struct("part", "root")).alias("main"), salts.alias("salts"), F.count("*").alias("roots"))
    largest = largest.where("roots > 1").drop("roots")
    members = rarest.join(largest, "shingle")
    outside = members.where("root <> main").select(
        "shingle", F.col("set_key").alias("b"), *(F.col(c).alias(f"b_{c}") for c in ("n", "root", "place")),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
    )
    members = members.withColumn("salt", F.pmod(F.xxhash64("set_key"), F.col("salts")).cast("int")).drop("salts", "main")
    common = F.least(F.col("n") - F.col("place"), F.col("b_n") - F.col("b_place")) + 1
    fits = (F.col("root") != F.col("b_root")) & (common * 100 >= (F.col("n") + F.col("b_n") - common) * percent)
    met = members.withColumnsRenamed({"shingle": "m_shingle", "salt": "m_salt"})
    return met.join(outside, (F.col("m_shingle") == F.col("shingle")) & (F.col("m_salt") == F.col("salt")) & fits).select("set_key", "b")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, words: int = WORDS, seed: int = 0
) -> DataFrame:
    """``(doc, n_shingles, component_id, kept)`` for every row of ``docs``.

    Two documents are linked if 100 times the common shingles reach ``percent`` times the
    union. ``component_id`` is the least key reachable over links, the own one included;
    ``kept`` is true where it is the own key. A null or blank text has no shingles and no
    links. Repeated rows get equal results; a null key never becomes a ``component_id``
    unless nothing else is reachable. Columns besides key and text are not read. An empty
    table gives an empty table.
    """
    out = _with_components(docs, key, text, percent, words, seed).select("doc", F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.col("doc").eqNullSafe(F.col("component_id")))


def _with_components(docs: DataFrame, key: str, text: str, percent: int, words: int, seed: int) -> DataFrame:
    sketches = stored(sketch(docs, key, text, seed, words), "sketches")
    filled = sketches.where("n > 0")
    # A class keeps the place of one of its documents, the least one with a key.
    place = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "text_hash")).alias("place")
    classes = filled.groupBy("set_key").agg(place, F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes.select("set_key", F.col("place.doc").alias("first_doc"), F.col("place.text_hash").alias("first_hash"), "n", "bands"), "classes")
    banded = classes.select("set_key", "n", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min(F.struct("set_key", "n")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    entries = banded.join(hubs, "bucket").select("bucket", "set_key", "n", F.col("hub.set_key").alias("hub"), F.col("hub.n").alias("hub_n"))
    entries = stored(entries, "buckets")
    sizes_fit = "set_key <> hub and least(n, hub_n) * 100 >= greatest(n, hub_n) * " + str(percent)
    stars = entries.where(sizes_fit).select(F.col("hub").alias("a"), F.col("set_key").alias("b")).distinct()
    # The whole sets of all classes that share a bucket with another, from one document each.
    wanted = entries.select("set_key").distinct().join(classes.select("set_key", "first_doc", "first_hash"), "set_key")
    places = wanted.select("set_key", F.col("first_doc").alias("at"), F.col("first_hash").alias("of"))
    texts = docs.select(column(docs, key).alias("doc"), column(docs, text).alias("words"))
    found = texts.join(places, texts["doc"].eqNullSafe(places["at"]) & (F.xxhash64("words") == places["of"]))
    sets = found.select("set_key", shingle_set(F.col("words"), words).alias("shingles")).dropDuplicates(["set_key"])
    sets = stored(sets, "sets")
    links = stored(_confirmed(stars, sets, percent), "star-links")
    roots = stored(components(links), "roots")
    for nearest_first in (True, False):
        # Buckets whose members are still in different components.
        placed = entries.join(roots, entries["set_key"] == roots["node"], "left")
        member = stored(placed.select("bucket", "set_key", "n", F.coalesce("root", "set_key").alias("root")), "members")
        mixed = member.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        open_ = member.join(mixed.select("bucket"), "bucket")
        if nearest_first:
            open_ = stored(_reachable(open_, sets, percent), "open-members")
            bound = "root <> b_root and least(reach, b_reach) * 100 >= (n + b_n - least(reach, b_reach)) * " + str(percent)
            pairs = _to_middle(open_).where(bound).select(F.col("b").alias("a"), F.col("set_key").alias("b")).distinct()
        else:
            pairs = _across(_rarest(open_, sets, percent), percent).select(F.greatest("set_key", "b").alias("a"), F.least("set_key", "b").alias("b")).distinct()
        roots = merged(roots, stored(_confirmed(pairs, sets, percent), "more-links"))
    least = (
        classes.join(roots, classes["set_key"] == roots["node"], "left")
        .select("set_key", "first_doc", F.coalesce("root", "set_key").alias("root"))
    )
    ids = least.groupBy("root").agg(F.min("first_doc").alias("component_id")).join(least, "root").select("set_key", "component_id")
    return sketches.join(ids, "set_key", "left").select("doc", "text_hash", "n", F.coalesce("component_id", "doc").alias("component_id"))


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """One row of each component of ``near_duplicates``, and every row without shingles.

    Rows keep their own columns. Of rows that repeat both key and text one stays.
    """
    found = stored(_with_components(docs, key, text, percent, WORDS, 0), "components")
    hashed, *_ = fresh(docs.columns, "text_hash")
    tagged = docs.withColumn(hashed, F.xxhash64(column(docs, text)))
    lost = found.where(~F.col("doc").eqNullSafe(F.col("component_id"))).select(F.col("doc").alias(key), F.col("text_hash").alias(hashed))
    left = without_keys(tagged, lost, [key, hashed])
    if not found.groupBy("doc", "text_hash").count().where("count > 1").isEmpty():
        left = left.dropDuplicates([key, hashed])
    return left.drop(hashed)
