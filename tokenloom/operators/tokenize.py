"""Text to token ids, by joins on a vocabulary table or with a given encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.constants import UNK_ID
from tokenloom.functions.text import WORD_BREAK, words
from tokenloom.functions.trie import Trie
from tokenloom.operators.lookup import lookup
from tokenloom.session import materialize, scratch_path, spread

# Bytes of a vocabulary (tokens, plus 12 an entry) that is broadcast to every task; indexed it takes some times as much.
DICTIONARY_BYTES = 16 * 1024 * 1024
VALUES_AT_ONCE = 1 << 19  # words or characters that a task looks up at a time, or those of one text
# The same of pieces whose trie every task builds; it takes some tens of times as much.
PIECE_BYTES = 8 * 1024 * 1024


def spaced_specials(text: Column, specials: Iterable[str]) -> Column:
    """Put spaces around special tokens, so a glued end marker is a token of its own."""
    for token in specials:
        text = F.replace(text, F.lit(token), F.lit(f" {token} "))
    return text


def cut_words(text: Column, specials: Iterable[str] = (), limit: int | None = None) -> Column:
    """The words of a text that are tokens of their own, at most the first ``limit``."""
    found = words(spaced_specials(text, specials))
    return found if limit is None else F.slice(found, 1, limit)


def word_total(text: Column, specials: Iterable[str] = ()) -> Column:
    """How many tokens ``tokenize_words`` makes of a text; no vocabulary is needed for that."""
    return F.size(cut_words(text, specials))


def _dictionary(vocab: DataFrame, limit: int) -> pa.Table | None:
    """The vocabulary as an Arrow table, if its measured bytes stay within ``limit``."""
    size = vocab.agg(F.sum(F.octet_length("token") + F.lit(12)).alias("bytes")).first()["bytes"]
    return vocab.select("token", F.col("id").cast("int").alias("id")).toArrow() if (size or 0) <= limit else None


def _frequent(vocab: DataFrame, limit: int) -> tuple[pa.Table, bool]:
    """The tokens of the least ranks (column ``rank``, else ``id``) that ``limit`` has room for, and whether these are all."""
    rank = F.col("rank" if "rank" in vocab.columns else "id")
    size = F.sum(F.octet_length("token") + F.lit(12)).alias("bytes")
    known = vocab.agg(size, F.count("*").alias("rows"), F.min(rank).alias("first")).first()
    whole = (known["bytes"] or 0) <= limit
    if not whole:
        room = known["rows"] * limit // known["bytes"]
        # Codes below 0 stand for words that are not among these.
        vocab = vocab.filter((rank < known["first"] + room) & (F.col("id") >= 0)).limit(room)
    return vocab.select("token", F.col("id").cast("int").alias("id")).toArrow(), whole


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _portions(lists: pa.Array, sizes: np.ndarray) -> Iterator[pa.Array]:
    """Consecutive rows whose ``sizes`` add up to ``VALUES_AT_ONCE`` at most, or a single row."""
    total, at = np.cumsum(sizes), 0
    while at < len(lists):
        most = (total[at - 1] if at else 0) + VALUES_AT_ONCE
        stop = max(at + 1, int(np.searchsorted(total, most, side="right")))
        yield lists.slice(at, stop - at)
        at = stop


def _columns(dictionary: pa.Table) -> tuple[pa.Array, pa.Array]:
    known = dictionary.combine_chunks()
    if not known.num_rows:
        return pa.array([], pa.string()), pa.array([], pa.int32())
    return known["token"].combine_chunks(), known["id"].combine_chunks()


def _ids_in_place(spark: SparkSession, dictionary: pa.Table, unk_id: int) -> Callable[[Column], Column]:
    """A column function from words to ids: one hash look-up per batch, with the vocabulary broadcast."""
    shared = spark.sparkContext.broadcast(dictionary)

    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, ids = _columns(shared.value)

        def settle(held: list[pa.Array]) -> Iterator[pa.Array]:
            words = [lists.flatten() for lists in held]
            if not held:
                return
            found, at = ids.take(pc.index_in(pa.concat_arrays(words), value_set=tokens)).fill_null(unk_id), 0
            for lists, own in zip(held, words):
                offsets = pa.array(np.concatenate(([0], np.cumsum(_sizes(lists)))), pa.int32())
                yield pa.ListArray.from_arrays(offsets, found.slice(at, len(own)), mask=lists.is_null())
                at += len(own)

        # Every look-up indexes the vocabulary anew, so batches are gathered up to its size.
        held, total = [], 0
        for batch in batches:
            for lists in _portions(batch, _sizes(batch)):
                held.append(lists)
                total += int(_sizes(lists).sum())
                if total >= len(tokens):
                    yield from settle(held)
                    held, total = [], 0
        yield from settle(held)

    # Called so, it runs once for a row, also where a filter on its result could be pushed below it.
    return F.arrow_udf(look_up, "array<int>", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()


def _codes_in_place(spark: SparkSession, dictionary: pa.Table) -> Callable[[Column], Column]:
    """A column function from words to ``(codes, open)``: ids, or -1 - k for the word at k of ``open``."""
    shared = spark.sparkContext.broadcast(dictionary)

    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, ids = _columns(shared.value)
        for batch in batches:
            for lists in _portions(batch, _sizes(batch)):
                sizes, words = _sizes(lists), lists.flatten().dictionary_encode()
                kinds = max(1, len(words.dictionary))
                number = ids.take(pc.index_in(words.dictionary, value_set=tokens)).fill_null(-1).to_numpy(zero_copy_only=False)
                word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                codes = number[word].astype(np.int64)
                missed = np.flatnonzero(codes < 0)
                text = np.repeat(np.arange(len(lists)), sizes)[missed]
                # An open word is listed once for its text.
                listed, place = np.unique(text * kinds + word[missed], return_inverse=True)
                begins = np.searchsorted(listed // kinds, np.arange(len(lists) + 1))
                codes[missed] = -1 - (place - begins[text])
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                opened = words.dictionary.take(pa.array(listed % kinds, pa.int64()))
                yield pa.StructArray.from_arrays(
                    [
                        pa.ListArray.from_arrays(offsets, pa.array(codes, pa.int32())),
                        pa.ListArray.from_arrays(pa.array(begins, pa.int32()), opened),
                    ],
                    ["codes", "open"],
                    mask=lists.is_null(),
                )

    return F.arrow_udf(code, "struct<codes:array<int>,open:array<string>>", F.ArrowUDFType.SCALAR_ITER)


def tokenize_words(
    df: DataFrame,
    key: str,
    texts: dict[str, Column],
    vocab: DataFrame,
    specials: Iterable[str] = (),
    unk_id: int = UNK_ID,
    limit: int | None = None,
    carry: dict[str, Column] | None = None,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> DataFrame:
    """Whitespace tokens looked up in ``vocab(token, id)``: ``(key, <name>: array<int>.., <carry>..)``.

    Of each text the first ``limit`` tokens are looked up, others are cut off before. A
    vocabulary within ``dictionary_bytes`` is broadcast and texts are read where they are:
    no row moves, and ``df`` may be a stream. Of a larger one the tokens of the least ``rank``,
    or ``id`` where it has no such column, are broadcast. The words left open are joined to the
    whole vocabulary, each once for its text, and their ids brought to the codes of the row.
    Both ways give the same ids. ``carry`` names more columns to keep.
    """
    carry, spark = carry or {}, df.sparkSession
    kept = [value.alias(name) for name, value in carry.items()]
    dictionary, whole = _frequent(vocab, dictionary_bytes)
    if whole:
        ids = _ids_in_place(spark, dictionary, unk_id)
        return df.select(key, *[ids(cut_words(text, specials, limit)).alias(name) for name, text in texts.items()], *kept)
    if df.isStreaming:
        raise ValueError("the vocabulary is too large for a stream; prepare it batch by batch (prepare_stream)")
    code, path = _codes_in_place(spark, dictionary), scratch_path(spark, "codes")
    coded = [code(cut_words(text, specials, limit)).alias(name) for name, text in texts.items()]
    spread(df, key).select(F.monotonically_increasing_id().alias("_row"), key, *coded, *kept).write.parquet(path)
    stored = spark.read.parquet(path)
    lists = F.array(*[F.struct(F.lit(i).alias("part"), F.col(name)["open"].alias("open")) for i, name in enumerate(texts)])
    opened = stored.select("_row", F.explode(lists).alias("_p")).select("_row", "_p.part", F.posexplode("_p.open").alias("k", "token"))
    found = lookup(opened, vocab.select("token", "id"), "token", salt_by=["_row", "part"])

    def ids_of(part: int) -> Column:
        entry = F.struct("k", F.coalesce(F.col("id"), F.lit(unk_id)).cast("int").alias("id"))
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, entry))), lambda e: e["id"])

    known = found.groupBy("_row").agg(*[ids_of(i).alias(f"_open{i}") for i in range(len(texts))])
    joined = stored.join(known, "_row", "left")

    def filled(part: int, name: str) -> Column:
        return F.transform(F.col(name)["codes"], lambda c: F.when(c >= 0, c).otherwise(F.get(f"_open{part}", -1 - c)))

    return joined.select(key, *[filled(i, name).alias(name) for i, name in enumerate(texts)], *carry)


def longest_match_words(tokens: DataFrame, pieces: DataFrame, unk_id: int = UNK_ID) -> DataFrame:
    """Greedy longest-match segmentation of distinct words by a join: ``(token, pieces: array<int>, starts: array<int>)``.

    For vocabularies beyond the broadcast bound. Every substring no longer than the longest
    piece is looked up by an equi join, and only the longest match of each place is kept; a
    fold over the places then steps from match to match, or by one unknown character.
    """
    longest = pieces.agg(F.coalesce(F.max(F.length("token")), F.lit(1)).alias("n")).scalar()
    tokens = tokens.select("token")
    substrings = (
        tokens.withColumn("start", F.explode(F.sequence(F.lit(1), F.length("token"))))
        .withColumn("_rest", F.length("token") - F.col("start") + 1)
        .withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.col("_rest"), longest))))
        .select("token", "start", "size", F.expr("substring(token, start, size)").alias("piece"))
    )
    named = pieces.groupBy(F.col("token").alias("piece")).agg(F.min("id").cast("int").alias("id"))
    found = lookup(substrings, named, "piece", how="inner", salt_by=["token", "start"])
    best = found.groupBy("token", "start").agg(F.max(F.struct("size", "id")).alias("m"))
    best = best.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("start", "m"))).alias("_found"))
    start = F.struct(
        F.lit(1).alias("next"), F.array().cast("array<int>").alias("ids"), F.array().cast("array<int>").alias("starts")
    )

    def step(state: Column, at: Column) -> Column:
        top = F.try_element_at(F.col("_found"), at)
        taken = F.struct(
            (at + F.coalesce(top["size"], F.lit(1))).alias("next"),
            F.array_append(state["ids"], F.coalesce(top["id"], F.lit(unk_id))).alias("ids"),
            F.array_append(state["starts"], at - 1).alias("starts"),
        )
        return F.when(state["next"] == at, taken).otherwise(state)

    cut = F.aggregate(F.sequence(F.lit(1), F.length("token")), start, step, lambda s: F.struct(s["ids"], s["starts"]))
    return tokens.distinct().join(best, "token", "left").select("token", cut.alias("_cut")).select(
        "token", F.col("_cut.ids").alias("pieces"), F.col("_cut.starts").alias("starts")
    )


def _spaced_pieces(text: Column, specials: Iterable[str]) -> Column:
    """A lower-cased text cut at every single white-space character, empty parts included."""
    return F.split(F.lower(spaced_specials(text, specials)), WORD_BREAK.removesuffix("+"), -1)


def _cut_in_place(spark: SparkSession, dictionary: pa.Table, unk_id: int, limit: int | None) -> Callable[[Column], Column]:
    """A column function from the parts of texts to ids and offsets, with the trie of all pieces broadcast."""
    shared = spark.sparkContext.broadcast(dictionary)

    def ends(sizes: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(sizes)))

    def within(sizes: np.ndarray) -> np.ndarray:
        return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def chars(lists: pa.Array) -> np.ndarray:
        lengths = ends(pc.binary_length(lists.flatten()).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        return np.diff(lengths[ends(_sizes(lists))])

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = None
        for batch in batches:
            trie = trie or Trie(shared.value["token"].to_pylist(), shared.value["id"].to_pylist())
            for lists in _portions(batch, chars(batch)):
                yield cut_portion(trie, lists)

    def cut_portion(trie: Trie, lists: pa.Array) -> pa.Array:
        parts, sizes = lists.flatten(), _sizes(lists)
        # A part begins where the parts before it in its text end, one white space each in between.
        lengths = pc.utf8_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        before = ends(lengths + 1)
        places = before[:-1] - np.repeat(before[ends(sizes)[:-1]], sizes)
        coded = parts.dictionary_encode()
        ids, starts, counts = trie.longest_matches(coded.dictionary.to_pylist(), unk_id)
        word = coded.indices.to_numpy(zero_copy_only=False)
        each = counts[word] if len(word) else np.zeros(0, np.int64)
        taken = np.repeat(ends(counts)[:-1][word], each) + within(each) if len(word) else each
        ids, starts = ids[taken], starts[taken] + np.repeat(places, each)
        per_text = np.diff(ends(each)[ends(sizes)])
        if limit is not None:
            kept = within(per_text) < limit
            ids, starts, per_text = ids[kept], starts[kept], np.minimum(per_text, limit)
        offsets = pa.array(ends(per_text), pa.int32())
        fields = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (ids, starts)]
        return pa.StructArray.from_arrays(fields, ["ids", "starts"], mask=lists.is_null())

    return F.arrow_udf(cut, "struct<ids:array<int>,starts:array<int>>", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()


def tokenize_pieces(
    df: DataFrame,
    key: str,
    texts: dict[str, Column],
    pieces: DataFrame,
    specials: Iterable[str] = (),
    unk_id: int = UNK_ID,
    limit: int | None = None,
    carry: dict[str, Column] | None = None,
    dictionary_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Sub-words by greedy longest match: ``(key, <name>, <name>_starts .., <carry> ..)``.

    ``<name>`` holds the ids of at most the first ``limit`` pieces and ``<name>_starts`` where
    each begins, counted in characters of the lower-cased text with spaced specials. Pieces
    ``(token, id)`` within ``dictionary_bytes`` are broadcast as one trie, texts stay where
    they are and ``df`` may be a stream. Beyond that the distinct words are cut by a join and
    looked up per occurrence; ``key`` then has to be unique. Both ways give the same.
    """
    carry = carry or {}
    kept = [value.alias(name) for name, value in carry.items()]
    dictionary = _dictionary(pieces, dictionary_bytes)
    if dictionary is not None:
        cut = _cut_in_place(df.sparkSession, dictionary, unk_id, limit)
        coded = df.select(key, *[cut(_spaced_pieces(text, specials)).alias(f"_{name}") for name, text in texts.items()], *kept)
        fields = [F.col(f"_{n}.{f}").alias(n + end) for n in texts for f, end in (("ids", ""), ("starts", "_starts"))]
        return coded.select(key, *fields, *carry)
    rows = _part_rows(df, key, texts, specials)
    distinct = materialize(rows.filter(F.col("token") != "").select("token").distinct())
    segmented = materialize(longest_match_words(distinct, pieces, unk_id))
    coded = lookup(rows, segmented, "token", salt_by=[key, "pos"])
    cells = F.arrays_zip("pieces", F.transform("starts", lambda s: s + F.col("at")).alias("at"))
    entry = F.when(F.col("pieces").isNotNull(), F.struct("part", "pos", cells.alias("cells")))
    grouped = coded.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_all"))

    def of(part: int, field: str) -> Column:
        mine = F.flatten(F.transform(F.filter("_all", lambda e: e["part"] == part), lambda e: e["cells"]))
        values = F.transform(mine, lambda c: c[field].cast("int"))
        return values if limit is None else F.slice(values, 1, limit)

    wide = [of(i, f).alias(n + end) for i, n in enumerate(texts) for f, end in (("pieces", ""), ("at", "_starts"))]
    nested = grouped.select(key, *wide)
    return nested.join(df.select(key, *kept), key) if carry else nested


def _part_rows(df: DataFrame, key: str, texts: dict[str, Column], specials: Iterable[str]) -> DataFrame:
    """``(key, part, pos, token, at)``: one row per part of each text, with the character it begins at."""
    parts = F.array(
        *[F.struct(F.lit(i).alias("part"), _spaced_pieces(t, specials).alias("tokens")) for i, t in enumerate(texts.values())]
    )
    listed = spread(df, key).select(key, F.explode(parts).alias("_p")).select(key, F.col("_p.part").alias("part"), F.col("_p.tokens").alias("_t"))
    rows = listed.select(key, "part", F.posexplode_outer("_t").alias("pos", "token"))
    earlier = Window.partitionBy(key, "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("token") + 1).over(earlier), F.lit(0)).cast("int")
    return rows.withColumn("at", begin)


def tokenize_longest_match(
    df: DataFrame,
    key: str,
    texts: dict[str, Column],
    pieces: DataFrame,
    specials: Iterable[str] = (),
    unk_id: int = UNK_ID,
) -> DataFrame:
    """Sub-word ids alone: ``(key, <name>: array<int> ..)``."""
    return tokenize_pieces(df, key, texts, pieces, specials, unk_id).select(key, *texts)


def token_texts(ids: Column, vocab: DataFrame, unknown: str, dictionary_bytes: int = DICTIONARY_BYTES) -> Column:
    """The tokens of an array of ids, in place; ``vocab(token, id)`` has to stay within ``dictionary_bytes``."""
    dictionary = _dictionary(vocab, dictionary_bytes)
    if dictionary is None:
        raise ValueError("the vocabulary is too large to be broadcast; join it to the steps instead")
    shared = vocab.sparkSession.sparkContext.broadcast(dictionary.sort_by("id"))

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, numbers = _columns(shared.value)
        numbers = numbers.to_numpy()
        for batch in batches:
            for lists in _portions(batch, _sizes(batch)):
                given = lists.flatten().to_numpy(zero_copy_only=False)
                place = np.searchsorted(numbers, given)
                hit = place < len(numbers)
                hit[hit] = numbers[place[hit]] == given[hit]
                found = tokens.take(pa.array(place, pa.int64(), mask=~hit)).fill_null(unknown)
                offsets = pa.array(np.concatenate(([0], np.cumsum(_sizes(lists)))), pa.int32())
                yield pa.ListArray.from_arrays(offsets, found, mask=lists.is_null())

    return F.arrow_udf(read, "array<string>", F.ArrowUDFType.SCALAR_ITER)(ids)


def chars_before(text: Column, specials: Iterable[str] = ()) -> Column:
    """The length of a text in the characters that offsets are counted in."""
    return F.length(F.lower(spaced_specials(text, specials)))


Encoder = Callable[[list[str]], list[list[int]]]
SpanEncoder = Callable[[list[str]], list[tuple[list[int], list[int]]]]


def tokenize_with(
    df: DataFrame, key: str, texts: list[str], make_encoder: Callable[[], Encoder]
) -> DataFrame:
    """Ids from an outside tokenizer, batch by batch in Arrow.

    ``make_encoder`` is called once per task and returns a function from a list of texts
    to a list of id lists, e.g. the batch call of a tokenizer loaded from a shipped file.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for batch in batches:
            out = [batch.column(0)]
            for i in range(len(texts)):
                given = ["" if t is None else t for t in batch.column(i + 1).to_pylist()]
                out.append(pa.array(encoder(given), type=pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=[key, *texts])

    kind = df.schema[key].dataType.simpleString()
    fields = ", ".join(f"`{t}` array<int>" for t in texts)
    return df.select(key, *texts).mapInArrow(encode, f"`{key}` {kind}, {fields}")


def tokenize_spans(
    df: DataFrame, key: str, texts: dict[str, Column], make_encoder: Callable[[], SpanEncoder],
    limit: int | None = None, carry: dict[str, Column] | None = None,
) -> DataFrame:
    """``tokenize_with`` for encoders that also say at which character each token begins.

    Gives the columns of ``tokenize_pieces``; no row moves and ``df`` may be a stream.
    """

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = make_encoder()
        kind = pa.struct([("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32()))])
        for batch in batches:
            coded = encoder(["" if t is None else t for t in batch.to_pylist()])
            yield pa.array([{"ids": ids[:limit], "starts": starts[:limit]} for ids, starts in coded], kind)

    coder = F.arrow_udf(encode, "struct<ids:array<int>,starts:array<int>>", F.ArrowUDFType.SCALAR_ITER)
    carry = carry or {}
    coded = df.select(key, *[coder(text).alias(f"_{n}") for n, text in texts.items()], *[v.alias(n) for n, v in carry.items()])
    fields = [F.col(f"_{n}.{f}").alias(n + end) for n in texts for f, end in (("ids", ""), ("starts", "_starts"))]
    return coded.select(key, *fields, *carry)
