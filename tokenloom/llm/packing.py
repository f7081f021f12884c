"""Hierarchical packing of token sequences into windows of several lengths.

Context sizes form tiers, each twice the one below. A document is routed down the tiers: its
whole windows of the longest size stand alone, and what remains, its tail, belongs to the
tier just above its own length. Tiers are packed from the longest down. A tail opens a long
window, whose gap is filled by the best fitting tails of shorter tiers, uncut. Where the
stock cannot fill the gap, the tail is cut instead: its largest tier size becomes a full
window of that tier and the rest is routed to the tier below. So short windows are always
full, and only long ones are ever padded.

How many tails there are of each length is all that the packing depends on, at most one
number per length below the longest window. ``plan`` works on these numbers alone, and its
result says, per length and range of ranks, which window a tail goes to. Spark counts the
lengths, ranks the tails and applies the plan; no task holds more than one batch of texts or
the tails of one length and salt.

Windows are dealt to training steps of one number of tokens each. All windows of a step have
one length, every tier's windows are spread over its steps, and the steps of all tiers are
interleaved in proportion.
"""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import attach, column, stored
from tokenloom.llm.token_counts import SETTLED, WORDS, byte_letters

LONGEST = 2048
TIERS = (256, 512, 1024)  # the shorter windows
SLACK = 8  # tokens of padding a long window may have before its opener is cut instead
STEP_WINDOWS = 16  # a step holds the tokens of so many of the longest windows
END_ID = 1
WHOLE_BYTES = 1 << 20  # longer texts are encoded in parts
PART_CHARS = 1 << 16
KEPT_WORDS = 1_000_000  # words whose ids a task keeps; beyond that it starts anew
SAFE = regex.compile("[a-z] [a-z]")  # no word of the encoder spans the place before such a space


# Token ids ------------------------------------------------------------------------------------


class WordEncoder:
    """Ids as the tokenizers library gives them, with one encoding per distinct word of a task.

    Where ids follow the order of merges, an id is its merge's rank and a word is merged by
    tiktoken, several times faster and with the same result; otherwise by the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        merges, vocab = spec["model"]["merges"], dict(spec["model"]["vocab"])
        for special in spec["added_tokens"]:
            vocab.pop(special["content"], None)
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        self.piece = None
        if [vocab.get(m) for m in made] == list(range(256, 256 + len(made))) and len(vocab) == 256 + len(made):
            import tiktoken

            byte_of = {letter: byte for byte, letter in byte_letters().items()}
            ranks = {bytes(byte_of[c] for c in token): number for token, number in vocab.items()}
            self.piece = tiktoken.Encoding("words", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.pool, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int32)

    def _learn(self, words: list[str]) -> None:
        if self.piece is None:
            coded = [e.ids for e in self.library.encode_batch(words, add_special_tokens=False)]
        else:
            coded = [self.piece(w.encode("utf-8")) for w in words]
        sizes = np.fromiter(map(len, coded), np.int32, len(coded))
        self.places.update(zip(words, range(len(self.ends) - 1, len(self.ends) - 1 + len(words))))
        self.pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum()))))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int32)))

    def words(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all lists of words in one array, and how many each list has."""
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.places) > KEPT_WORDS:
            self._forget()
        self._learn([w for w in distinct if w not in self.places])
        place = np.fromiter(map(self.places.__getitem__, distinct), np.int32, len(distinct))
        each = place[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int32)
        sizes = self.ends[each + 1] - self.ends[each]
        upto = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        ids = self.pool[np.arange(upto[-1], dtype=np.int64) + np.repeat(self.ends[each] - upto[:-1], sizes)]
        borders = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
        return ids, upto[borders[1:]] - upto[borders[:-1]]

    def text(self, text: str) -> np.ndarray:
        """The ids of any text, a long one in parts."""
        parts = [np.array(self.library.encode(p, add_special_tokens=False).ids, np.uint32) for p in safe_parts(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def safe_parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Parts of at least ``size`` characters, cut where the encoder cuts in any case."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start() + 1]
        at = cut.start() + 1
    yield text[at:]


def encode(docs: DataFrame, tokenizer: str, key: str, text: str, longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """``(row, doc, n, ids, prior)``: token ids with ``end_id`` after them, four bytes each, little-endian.

    ``prior`` counts the whole windows of ``longest`` tokens of the rows before, in the same
    partition; ``row`` has the partition in its upper bits. Words are cut by the JVM and encoded once per distinct word. Texts with special strings,
    with characters whose class depends on the Unicode version, and very long ones go to the
    library as they are.
    """
    with open(tokenizer, encoding="utf-8") as file:
        specials = [t["content"] for t in json.load(file)["added_tokens"]]
    body = F.coalesce(column(docs, text), F.lit(""))
    odd = ~body.rlike(f"\\A[{SETTLED}]*+\\z") | (F.octet_length(body) > WHOLE_BYTES)
    for special in specials:
        odd = odd | F.contains(body, F.lit(special))
    def coded(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder = WordEncoder(tokenizer)
        end, prior = np.array([end_id], "<u4").tobytes(), 0
        for lists, texts in batches:
            ids, sizes = encoder.words(lists)
            at, out, priors = 0, [], []
            for size, raw in zip(sizes.tolist(), texts):
                own = encoder.text(raw.as_py()) if raw.is_valid else ids[at : at + size]
                out.append(own.astype("<u4").tobytes() + end)
                priors.append(prior)
                prior += (len(own) + 1) // longest
                at += size
            yield pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(priors, pa.int64())], ["ids", "prior"])

    # A column of its own: the test reads the whole text and is wanted by both arguments.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), column(docs, key).alias("doc"), body.alias("body"), odd.alias("odd"))
    words = F.when(~F.col("odd"), F.regexp_extract_all("body", F.lit(WORDS), F.lit(0)))
    made = F.arrow_udf(coded, "struct<ids:binary,prior:long>", F.ArrowUDFType.SCALAR_ITER)
    rows = rows.select("row", "doc", made(words, F.when(F.col("odd"), F.col("body"))).alias("made"))
    return rows.select("row", "doc", (F.octet_length("made.ids") / 4).cast("long").alias("n"), "made.ids", "made.prior")


# The plan -------------------------------------------------------------------------------------


class Placed(NamedTuple):
    """Where the tails of one length and a range of ranks go, or a part of each of them.

    The ``i``-th of them lies in window ``window + (first + i) // each`` of its tier, at
    ``offset + (first + i) % each * length``. ``before`` is how many ids of the tail precede it.
    """

    tail: int
    low: int
    high: int
    before: int
    length: int
    tier: int
    window: int
    offset: int
    first: int
    each: int


class Stock:
    """Tails that wait to be placed, by the length they still have."""

    def __init__(self, counts: dict[int, int], longest: int):
        self.counts = [0] * (longest + 1)
        self.runs: list[deque] = [deque() for _ in range(longest + 1)]
        for length, count in counts.items():
            self.put(length, length, 0, count)

    def put(self, length: int, tail: int, low: int, count: int) -> None:
        if count:
            self.counts[length] += count
            self.runs[length].append([tail, low, count])

    def take(self, length: int, count: int) -> list[tuple[int, int, int]]:
        """``count`` of a length, as ``(tail, low, high)``."""
        self.counts[length] -= count
        out = []
        while count:
            run = self.runs[length][0]
            used = min(count, run[2])
            out.append((run[0], run[1], run[1] + used))
            run[1] += used
            run[2] -= used
            count -= used
            if not run[2]:
                self.runs[length].popleft()
        return out

    def best(self, at_most: int) -> int:
        """The longest length in stock up to a bound, or 0."""
        while at_most and not self.counts[at_most]:
            at_most -= 1
        return at_most


def plan(counts: dict[int, int], longest: int = LONGEST, tiers: tuple[int, ...] = TIERS, slack: int = SLACK) -> tuple[list[Placed], dict[int, int]]:
    """Windows for so many tails of each length below ``longest``; also the windows per tier.

    Depends on the counts alone. Every step uses up a length or a group of windows, so there
    are few steps however many tails there are.
    """
    stock, placed, windows = Stock(counts, longest), [], dict.fromkeys((*tiers, longest), 0)

    def put(length: int, count: int, tier: int, window: int, offset: int, each: int) -> None:
        first = 0
        for tail, low, high in stock.take(length, count):
            placed.append(Placed(tail, low, high, tail - length, length, tier, window, offset, first, each))
            first += high - low

    def fill(window: int, count: int, used: int) -> None:
        """Fill ``count`` alike windows, from number ``window`` on, of which ``used`` tokens are taken."""
        groups = [(window, count, used)]
        while groups:
            window, count, used = groups.pop()
            length = stock.best(longest - used)
            if not length:
                continue
            each = min((longest - used) // length, max(1, stock.counts[length] // count))
            several = min(count, stock.counts[length] // each)
            if several < count:
                groups.append((window + several, count - several, used))
            put(length, several * each, longest, window, used, each)
            groups.append((window, several, used + each * length))

    def gap(length: int, each: int) -> int:
        """What greedy filling would leave of one window, with the stock as it is."""
        left, at, spent = longest - each * length, length, {length: each}
        while left:
            at = stock.best(min(left, at))
            while at and spent.get(at, 0) >= stock.counts[at]:
                at = stock.best(at - 1)
            if not at:
                break
            spent[at] = spent.get(at, 0) + 1
            left -= at
        return left

    length = longest - 1
    while length := stock.best(length):
        split = max((t for t in tiers if t <= length), default=0)
        each = min(longest // length, stock.counts[length])
        if split and (split == length or gap(length, each) > slack):
            # Cut a tier down: a full window of that tier, and the rest goes to its own tier.
            count = stock.counts[length]
            for tail, low, high in stock.take(length, count):
                placed.append(Placed(tail, low, high, tail - length, split, split, windows[split], 0, 0, 1))
                windows[split] += high - low
                if length > split:
                    stock.put(length - split, tail, low, high - low)
            continue
        count = stock.counts[length] // each
        # While the stock lasts: no more windows than its next filler serves alike.
        after = stock.best(min(longest - each * length, length - 1))
        if after and split:
            count = max(1, min(count, stock.counts[after]))
        window = windows[longest]
        windows[longest] += count
        put(length, count * each, longest, window, 0, each)
        fill(window, count, each * length)
    return placed, windows


# Spark ----------------------------------------------------------------------------------------


def _ranked(tails: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """Tails numbered within their length, and the number of each length.

    The numbering is over (length, salt), so a length that a third of all rows have is
    spread; the counts before a salt are added.
    """
    salted = tails.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    sizes = stored(salted.groupBy("tail", "salt").agg(F.count("*").alias("size")), "packing-sizes")
    earlier = Window.partitionBy("tail").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("tail", "salt", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("tail", "salt").orderBy("row")
    numbered = salted.withColumn("place", F.row_number().over(inside) - 1).join(starts, ["tail", "salt"])
    return numbered.withColumn("rank", F.col("start") + F.col("place")).drop("place", "start", "salt"), sizes


def _spread(number: Column, size: int) -> Column:
    """A permutation of 0 .. size - 1 that takes neighbours far apart."""
    step = max(1, int(size * 0.6180339887))
    while math.gcd(step, size) != 1:
        step += 1
    return ((number.cast("decimal(20,0)") * F.lit(step).cast("decimal(18,0)")) % F.lit(size).cast("decimal(20,0)")).cast("long")


def _steps(windows: dict[int, int], step_tokens: int) -> Column:
    """The step of a window from its ``tier`` and its ``number`` there.

    Steps of a tier lie evenly over the run; a step's place is the number of steps, of any
    tier, before it.
    """
    totals = {t: -(-n // (step_tokens // t)) for t, n in windows.items() if n}
    out = F.lit(None).cast("long")
    for t, total in totals.items():
        own = F.floor(_spread(F.col("number"), windows[t]) / (step_tokens // t))
        place = own
        for u, others in totals.items():
            if u != t:
                # Steps j of tier u with (2 j + 1) / others < (2 own + 1) / total, or equal and of a shorter tier.
                scaled = (2 * own + 1) * others
                upto = F.ceil((scaled - total) / (2 * total)) if u > t else F.floor((scaled - total) / (2 * total)) + 1
                place = place + F.least(F.greatest(upto, F.lit(0)), F.lit(others))
        out = F.when(F.col("tier") == t, place).otherwise(out)
    return out


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", longest: int = LONGEST,
    tiers: tuple[int, ...] = TIERS, slack: int = SLACK, end_id: int = END_ID,
) -> DataFrame:
    """``(doc, start, length, ids, doc_tokens, sequence_id, offset, tier, step)``, one row per piece.

    ``tiers`` are the shorter windows, each half the next one, the last half of ``longest``.
    ``tokenizer`` is the path of a byte-level vocabulary file that every executor has. ``ids``
    holds the piece's ids, four bytes each, little-endian. ``tier`` is the window's length; a
    window below the longest tier is full, a longest one may have padding after its pieces.
    ``step`` numbers the training steps, whose windows have one length and the same tokens.

    A null or empty text is one token, the end. Rows that repeat a key, or have a null one,
    are packed each by itself. Other columns are not read. An empty table gives an empty table.
    A long text is encoded in parts and costs its own size.
    """
    if [*tiers, longest] != [longest >> k for k in range(len(tiers), -1, -1)]:
        raise ValueError("each tier has to be half the next one")
    spark = docs.sparkSession
    coded = stored(encode(docs, tokenizer, key, text, longest, end_id), "packing-ids", compression="zstd")
    coded = coded.withColumn("whole", F.floor(F.col("n") / longest)).withColumn("tail", F.pmod("n", F.lit(longest)).cast("int"))
    rows = coded.agg(F.count("*").alias("rows"), F.coalesce(F.sum("whole"), F.lit(0)).alias("whole")).first()

    def cut(before: Column, length: Column) -> Column:
        return F.substring("ids", (before * 4 + 1).cast("int"), (length * 4).cast("int"))

    # Tails: ranked by length, then looked up in the plan.
    tails = coded.where("tail > 0").select("row", "doc", "n", "tail", cut(F.col("n") - F.col("tail"), F.col("tail")).alias("ids"))
    ranked, sizes = _ranked(tails, math.isqrt(rows["rows"]) + 1)
    counts = {r["tail"]: r["size"] for r in sizes.groupBy("tail").agg(F.sum("size").alias("size")).collect()}
    placed, windows = plan(counts, longest, tiers, slack)
    kind = "p_tail int, low long, high long, before int, length int, tier int, window long, first_offset int, first long, each int"
    moves = spark.createDataFrame(placed, kind)
    here = F.col("first") + F.col("rank") - F.col("low")
    met = ranked.join(F.broadcast(moves), (F.col("tail") == F.col("p_tail")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    pieces = met.select(
        "doc",
        (F.col("n") - F.col("tail") + F.col("before")).alias("start"),
        F.col("length").cast("long").alias("length"),
        cut(F.col("before"), F.col("length")).alias("ids"),
        F.col("n").alias("doc_tokens"),
        "tier",
        (F.col("window") + F.floor(here / F.col("each"))).alias("number"),
        (F.col("first_offset") + F.pmod(here, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
    # Whole windows stay where they are; they are numbered after the planned ones.
    long_rows = coded.where("whole > 0").withColumn("part", F.shiftright("row", 33))
    per_part = stored(long_rows.groupBy("part").agg(F.sum("whole").alias("windows")), "packing-parts")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    begins = per_part.select("part", (F.coalesce(F.sum("windows").over(earlier), F.lit(0)) + windows[longest]).alias("begin"))
    numbered = attach(long_rows, begins, ["part"], ["row"])
    full = numbered.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("k")).select(
        "doc",
        (F.col("k") * longest).alias("start"),
        F.lit(longest).cast("long").alias("length"),
        cut(F.col("k") * longest, F.lit(longest)).alias("ids"),
        F.col("n").alias("doc_tokens"),
        F.lit(longest).alias("tier"),
        (F.col("begin") + F.col("prior") + F.col("k")).alias("number"),
        F.lit(0).cast("long").alias("offset"),
    )
    windows = windows | {longest: windows[longest] + rows["whole"]}
    base, bases = 0, F.lit(0).cast("long")
    for t, n in windows.items():
        bases = F.when(F.col("tier") == t, F.lit(base).cast("long")).otherwise(bases)
        base += n
    step = _steps(windows, longest * STEP_WINDOWS)
    return pieces.unionByName(full).select(
        "doc", "start", "length", "ids", "doc_tokens", (bases + F.col("number")).alias("sequence_id"), "offset", "tier", step.alias("step")
    )


def sequences(pieces: DataFrame, longest: int = LONGEST, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, tier, step, tokens, ids, docs, starts)``: whole windows, as a trainer reads them.

    ``ids`` are four bytes each; a window that is not full is padded with ``pad_id`` to
    ``longest``. ``starts`` are the offsets at which the pieces of ``docs`` begin, so that
    attention can be kept inside a piece. A window holds at most ``longest`` pieces.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc", "length", "ids")))
    whole = pieces.groupBy("sequence_id", "tier", "step").agg(parts.alias("parts"), F.sum("length").alias("tokens"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    padding = F.when(F.col("tokens") < F.col("tier"), F.lit(longest) - F.col("tokens")).otherwise(F.lit(0)).cast("int")
    filler = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), padding))
    return whole.select(
        "sequence_id", "tier", "step", "tokens", F.concat(joined, filler).alias("ids"),
        F.transform("parts", lambda p: p["doc"]).alias("docs"), F.transform("parts", lambda p: p["offset"]).alias("starts"),
    )
