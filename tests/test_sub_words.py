"""Tries, nearest tokens, sub-words with offsets, and the prompt's border."""

import random

import pytest
from pyspark.sql import functions as F

from tokenloom.functions.trie import Bands, Trie
from tokenloom.operators import edit_map, tokenize
from tokenloom.plans import prepare


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(12))
def test_nearest_tokens_of_a_trie(seed):
    rng = random.Random(seed)
    letters, longest = rng.choice(["ab", "abc", "abcdé", "abcdef😀"]), rng.choice([3, 6, 11])
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, longest)))
    tokens = [word() for _ in range(rng.choice([1, 5, 80]))]
    ids = list(range(len(tokens)))
    rng.shuffle(ids)
    words = [*(word() for _ in range(40)), "z" * 20, "é" * 3, ""]
    found = list(zip(*(v.tolist() for v in Bands(tokens, ids).nearest(words))))
    assert found == [min((distance(w, t), i) for t, i in zip(tokens, ids)) for w in words]


def test_no_tokens_and_no_words():
    assert [v.tolist() for v in Bands([], []).nearest(["a", ""])] == [[-1, -1], [-1, -1]]
    assert [v.tolist() for v in Bands(["a"], [1]).nearest([])] == [[], []]
    assert [v.tolist() for v in Trie([], []).longest_matches(["ab"], 0)] == [[0, 0], [0, 1], [2]]


def greedy(word, pieces, unknown=0):
    out, at = [], 0
    while at < len(word):
        best = max((p for p in pieces if p and word.startswith(p, at)), key=len, default=None)
        out.append((pieces[best] if best else unknown, at))
        at += len(best) if best else 1
    return out


def test_longest_matches_of_a_trie():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abé") for _ in range(rng.randint(1, n)))
    pieces = {p: i + 1 for i, p in enumerate(sorted({word(4) for _ in range(15)}))}
    words = [word(12) for _ in range(60)] + ["", "xyz"]
    ids, starts, counts = Trie(list(pieces), list(pieces.values())).longest_matches(words, 0)
    got = iter(zip(ids.tolist(), starts.tolist()))
    assert [[next(got) for _ in range(n)] for n in counts] == [greedy(w, pieces) for w in words]


def vocabulary(spark, words, first=0):
    return spark.createDataFrame([(w, i + first) for i, w in enumerate(words)], "token string, id int")


def test_nearest_map_in_blocks_equals_broadcast(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
    tea, stu = [sorted({word() for _ in range(n)}) for n in (300, 200)]
    want = {i: min((distance(t, s), j) for j, s in enumerate(stu)) for i, t in enumerate(tea)}
    for size in (edit_map.TRIE_BYTES, 700):  # the last in blocks
        rows = edit_map.min_edit_map(vocabulary(spark, tea), vocabulary(spark, stu), size).collect()
        assert len(rows) == len(tea) and {r.src_id: (r.distance, r.dst_id) for r in rows} == want


def test_nearest_map_moves_no_words_beyond_one_deal(spark):
    plan = edit_map.min_edit_map(vocabulary(spark, ["ab", "c"]), vocabulary(spark, ["abc"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    none = edit_map.min_edit_map(vocabulary(spark, ["ab"]), vocabulary(spark, []))
    assert [tuple(r) for r in none.collect()] == [(0, None, None)]


PIECES = ["un", "unh", "happy", "h", "</s>", "a", "b", "ab", "é"]
TEXTS = ["unhappy  ab</s>h", "", None, " \t", "É ab\n\nabab", "unhappyx " * 30, "a</s></s>b "]


def expected_pieces(text):
    """Ids and offsets in the lower-cased text with spaces around the special token."""
    pieces = {p: i + 1 for i, p in enumerate(PIECES)}
    out, at = [], 0
    if text is None:
        return None
    for part in text.replace("</s>", " </s> ").lower().replace("\t", " ").replace("\n", " ").split(" "):
        out += [(i, at + s) for i, s in greedy(part, pieces)]
        at += len(part) + 1
    return out


@pytest.mark.parametrize("limit", [None, 3])
@pytest.mark.parametrize("size", [tokenize.PIECE_BYTES, -1])
def test_pieces_and_offsets(spark, limit, size):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "sample_id long, body string")
    body = F.col("body") if size > 0 else F.coalesce("body", F.lit(""))
    out = tokenize.tokenize_pieces(
        rows, "sample_id", {"t": body, "twice": F.concat(body, body)}, vocabulary(spark, PIECES, 1), ["</s>"],
        limit=limit, carry={"chars": tokenize.chars_before(body, ["</s>"])}, dictionary_bytes=size,
    )
    for r in out.collect():
        text = TEXTS[r.sample_id] if size > 0 else TEXTS[r.sample_id] or ""
        for name, given in (("t", text), ("twice", text and text * 2)):
            want = expected_pieces(given)
            assert (list(zip(r[name], r[f"{name}_starts"])) if r[name] is not None else None) == (want and want[:limit] if want is not None else None)
        assert r.chars == (None if text is None else len(text.replace("</s>", " </s> ")))


def test_pieces_need_no_exchange_and_run_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t], "sample_id long, text string")
    coded = tokenize.tokenize_longest_match(rows, "sample_id", {"ids": F.col("text")}, vocabulary(spark, PIECES, 1), ["</s>"])
    assert "Exchange" not in coded._jdf.queryExecution().executedPlan().toString()
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = tokenize.tokenize_longest_match(stream, "sample_id", {"ids": F.col("text")}, vocabulary(spark, PIECES, 1), ["</s>"])
    job = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    job.awaitTermination()
    again = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, again.collect())) == sorted(map(str, coded.collect())) and again.count() == rows.count()


def labels(spark, border, coder, prefix, text):
    rows = spark.createDataFrame([(1, prefix, text)], "sample_id long, prefix string, text string")
    row = prepare.prepare_student(rows, "sample_id", coder, "</s>", 16, border=border).first()
    return row.ids, row.labels


def test_border_by_count_and_by_offset(spark):
    """Where a word reaches across the border, the prompt's own number of tokens is not where the response begins."""
    coder = prepare.piece_coder(vocabulary(spark, ["unh", "un", "happy", "a", "ab", "</s>"], 1))
    ids, by_count = labels(spark, "count", coder, "unh", "appy ab")
    assert ids == [1, 4, 0, 0, 0, 5, 6] and by_count == [-100, 4, 0, 0, 0, 5, 6]
    ids, by_count = labels(spark, "count", coder, "ab un", "h ab")
    assert ids == [5, 1, 5, 6] and by_count == [-100, -100, 5, 6]
    ids, by_count = labels(spark, "count", coder, "x a", "b ab")
    assert ids == [0, 5, 5, 6] and by_count == [-100, -100, 5, 6]
    ids, by_count = labels(spark, "count", coder, "hap", "py ab")
    assert ids == [3, 5, 6] and by_count == [-100, -100, -100]  # alone, "hap" is three tokens
    assert labels(spark, "offset", coder, "hap", "py ab") == ([3, 5, 6], [-100, 5, 6])
    assert labels(spark, "offset", coder, "", "ab") == ([5, 6], [5, 6])
    with pytest.raises(ValueError):
        labels(spark, "nowhere", coder, "a", "b")


def test_outside_tokenizer_with_offsets(spark):
    def make():
        def encode(texts):
            return [([ord(c) for c in t[::2]], list(range(0, len(t), 2))) for t in texts]

        return encode

    coder = prepare.outside_coder(make)
    assert labels(spark, "offset", coder, "abc", "def") == ([97, 99, 101, 60, 115], [-100, -100, 101, 60, 115])
    teachers = prepare.prepare_teachers(
        spark.createDataFrame([(1, "abc", "def")], "sample_id long, prefix string, text string"),
        "sample_id", coder, "</s>", ["!"], 16, border="offset",
    ).collect()
    assert [(r.side, r.ids, r.labels) for r in teachers] == [("teacher0", [97, 99, 101, 33], [-100, -100, 101, 33])]
