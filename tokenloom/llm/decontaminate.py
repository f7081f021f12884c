"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from a passage by up to ``k`` edits. Cut into ``k + 1`` pieces, at
least one piece is unharmed in any such passage, at its own place give or take ``k``. So
the pieces are searched exactly, all at once, in every text; each hit says where the item
would have to be, and bit-parallel edit distance decides over that stretch of text.

Both sides are compared as lower-case runs of letters and digits with single spaces, and with
one space around the whole. So an item is not found inside a word: where a passage begins or
ends within a word, that is an edit. Items below a least length are left out, because a
word or number alone is no leak.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import column

# Edits allowed, as a share of an item's length.
ERROR_RATE = 0.1
# Letters, digits and spaces that an item has at least.
LEAST_SIZE = 20
# Item text that one pass over the documents searches; more items take more passes.
ITEM_BYTES = 8 * 1024 * 1024


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]++", " "))


def padded(text: Column) -> Column:
    """``plain`` between two spaces; empty stays empty."""
    body = plain(text)
    return F.when(body != "", F.concat(F.lit(" "), body, F.lit(" "))).otherwise(F.lit(""))


def cut(size: int, budget: int) -> list[list[tuple[int, int, int]]]:
    """The pieces of an item: for each the path ``(start, end, errors)`` from the piece up to the whole.

    A part that allows ``e`` errors is halved into parts that allow ``e1`` and ``e2`` with
    ``e1 + e2 + 1 = e``, so one of them keeps within its own; in the end one of ``budget + 1``
    pieces has none, and every part on its path keeps within its own errors.
    """

    def below(start: int, end: int, errors: int, above: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
        path = [(start, end, errors), *above]
        if errors == 0:
            yield path
            return
        left = errors // 2
        middle = start + (end - start) * (left + 1) // (errors + 1)
        yield from below(start, middle, left, path)
        yield from below(middle, end, errors - left - 1, path)

    return list(below(0, size, budget, []))


def beside(item: str, path: list[tuple[int, int, int]]) -> tuple[int, int, tuple[str, ...]]:
    """Where the other half of a piece lies, and parts of it of which one must be unharmed."""
    if len(path) == 1:
        return 0, 0, ()
    (start, end, _), (low, high, errors) = path[:2]
    low, high = (end, high) if start == low else (low, start)
    size = high - low
    cuts = [low + size * i // (errors + 1) for i in range(errors + 2)]
    return low - errors, high + errors, tuple(item[a:b] for a, b in zip(cuts, cuts[1:]))


class ItemMasks:
    """Myers' bit vectors of one item: bit i of ``masks[c]`` says that the item's i-th letter is c."""

    def __init__(self, item: str):
        self.size = len(item)
        self.all = (1 << self.size) - 1
        self.top = 1 << (self.size - 1)
        self.masks: dict[str, int] = {}
        for i, char in enumerate(item):
            self.masks[char] = self.masks.get(char, 0) | 1 << i

    def best_end(self, text: str) -> tuple[int, int]:
        """Least edit distance of the item to any stretch of ``text``, and where the first such stretch ends."""
        up, down, full, top = self.all, 0, self.all, self.top
        get = self.masks.get
        score = best = self.size
        end = 0
        for at, char in enumerate(text, 1):
            same = get(char, 0)
            diagonal = (((same & up) + up) ^ up) | same | down
            right_up = (down | ~(diagonal | up)) & full
            right_down = up & diagonal
            if right_up & top:
                score += 1
            elif right_down & top:
                score -= 1
            right_up = (right_up << 1) & full
            right_down = (right_down << 1) & full
            up = (right_down | ~(diagonal | right_up)) & full
            down = right_up & diagonal
            if score < best:
                best, end = score, at
        return best, end


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float, around: int = 0):
        """``around`` is how many letters of an item are padding and allow no errors."""
        import ahocorasick

        self.items = items
        self.budgets = [int((len(text) - around) * rate) for _, text in items]
        self.masks: dict[tuple[int, int, int], ItemMasks] = {}
        owners: dict[str, list[tuple[int, list[tuple[int, int, int]], tuple]]] = {}
        for number, ((_, text), budget) in enumerate(zip(items, self.budgets)):
            for path in cut(len(text), budget):
                start, end, _ = path[0]
                owners.setdefault(text[start:end], []).append((number, path, beside(text, path)))
        self.pieces = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.pieces.add_word(piece, (len(piece), own))
        self.pieces.make_automaton()

    def best_end(self, number: int, start: int, end: int, text: str) -> tuple[int, int]:
        masks = self.masks.get((number, start, end))
        if masks is None:
            masks = self.masks[number, start, end] = ItemMasks(self.items[number][1][start:end])
        return masks.best_end(text)

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """``item number -> (distance, end)`` of the best stretch for every item within its budget.

        A hit is followed up its path: each larger part must lie around it within its own
        errors. The last part is the whole item. Before the first of these distances the
        piece's other half is looked for by its own pieces, which is exact and cheap.
        """
        found: dict[int, tuple[int, int]] = {}
        searched: dict[int, list[tuple[int, int]]] = {}
        for last, (size, owners) in self.pieces.iter(text):
            first = last - size + 1
            for number, path, (low, high, parts) in owners:
                origin = first - path[0][0]
                if parts:
                    nearby = text[max(0, origin + low) : max(0, origin + high)]
                    if not any(part in nearby for part in parts):
                        continue
                for start, end, errors in path[1:-1]:
                    low = max(0, origin + start - errors)
                    if self.best_end(number, start, end, text[low : origin + end + errors])[0] > errors:
                        break
                else:
                    start, end, errors = path[-1]
                    low, high = max(0, origin - errors), origin + end + errors
                    whole = searched.setdefault(number, [])
                    if (low, high) in whole[-errors - 1 :]:
                        continue  # other pieces of the same passage
                    whole.append((low, high))
                    distance, at = self.best_end(number, start, end, text[low:high])
                    if distance <= errors and (number not in found or distance < found[number][0]):
                        found[number] = (distance, low + at)
        return found


def find_items(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    rate: float = ERROR_RATE,
    least: int = LEAST_SIZE,
) -> DataFrame:
    """``(doc, item, distance, budget, end, short_items)``: every item that a document holds within its budget.

    ``distance`` is the least edit distance of the item to any stretch of the document, both
    between spaces; ``budget`` is ``rate`` of the item's plain length. ``end`` is the code points
    of the plain text before the end of the first such stretch. Items shorter than ``least`` in
    plain form are not searched; ``short_items`` says how many these are.
    Items are a stated query set: they are broadcast in blocks of 8 MB at most, each searched in
    one pass over all documents, so what a task holds is bounded whatever their number.
    Documents do not move, and a passage that many documents share costs no more than its
    length. Null or blank documents hold nothing, and null or blank items are in nothing;
    rows that repeat a document repeat its findings, rows that repeat an item are one.
    """
    wanted = _wanted(items, item_key, item_text)
    short = wanted.where(F.length("body") < least + 2).count()
    body = docs.select(column(docs, key).alias("doc"), padded(column(docs, text)).alias("body"))
    kind, item_kind = dict(body.dtypes)["doc"], dict(wanted.dtypes)["item"]
    found = None
    for block in _blocks(wanted.where(F.length("body") >= least + 2)):
        part = body.where("body <> ''").withColumn("found", _search(docs.sparkSession, block, rate, item_kind)(F.col("body")))
        part = part.where(F.size("found") > 0).select("doc", F.length("body").alias("size"), F.explode("found").alias("f"))
        end = F.least(F.col("f.end") - 1, F.col("size") - 2).alias("end")
        part = part.select("doc", "f.item", "f.distance", "f.budget", end, F.lit(short).cast("long").alias("short_items"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], f"doc {kind}, item {item_kind}, distance int, budget int, end int, short_items long")
    return found


def _blocks(wanted: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded size."""
    block, size = [], 0
    for row in wanted.orderBy("item", "body").toLocalIterator():
        if block and size + len(row["body"]) > ITEM_BYTES:
            yield block
            block, size = [], 0
        block.append((row["item"], row["body"]))
        size += len(row["body"])
    if block:
        yield block


def _wanted(items: DataFrame, key: str, text: str) -> DataFrame:
    wanted = items.select(column(items, key).alias("item"), padded(column(items, text)).alias("body"))
    return wanted.where("body <> '' and item is not null").distinct()


def _search(spark: SparkSession, block: list[tuple[object, str]], rate: float, item_kind: str):
    """A column function: the findings of one block in a padded text.

    The block is broadcast, which leaves it on disk and out of the plan and the driver's memory.
    """
    infer = pa.infer_type([item for item, _ in block])
    shared = spark.sparkContext.broadcast(block)
    fields = f"struct<item:{item_kind},distance:int,budget:int,end:int>"

    def searched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(shared.value, rate, around=2)
        each = pa.list_(pa.struct([("item", infer), ("distance", pa.int32()), ("budget", pa.int32()), ("end", pa.int32())]))
        for texts in batches:
            rows = []
            for one in texts:
                got = matcher.find(one.as_py())
                rows.append(
                    [
                        {"item": matcher.items[n][0], "distance": d, "budget": matcher.budgets[n], "end": e}
                        for n, (d, e) in sorted(got.items())
                    ]
                )
            yield pa.array(rows, each)

    # Marked so that the planner evaluates it once, not again for a filter on its result.
    return F.arrow_udf(searched, f"array<{fields}>", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()


def without_items(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", rate: float = ERROR_RATE, least: int = LEAST_SIZE
) -> DataFrame:
    """The rows of ``docs`` that hold no item of at least ``least`` letters, with their own columns.

    Rows are judged in place. Shorter items are left out, since a common word or number would
    empty the corpus; ``find_items`` counts them.
    """
    wanted = _wanted(items, "item_id", "text").where(F.length("body") >= least + 2)
    kind = dict(wanted.dtypes)["item"]
    out = docs
    for block in _blocks(wanted):
        out = out.where(F.size(_search(docs.sparkSession, block, rate, kind)(padded(column(out, text)))) == 0)
    return out
