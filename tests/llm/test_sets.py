"""Packing, manifest and hard negatives on small hand-made tables, against plain Python."""

import collections
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import hard_negatives, merkle, packing
from tokenloom.llm.queries import QUERIES
from tokenloom.llm.registry import ready

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
AWKWARD = [None, "", " ", "\n\t ", "one", "x" * 5000, "Ünïcode 😀 日本語 ԱԲ text", "the end<|endoftext|> of it", "lorem ipsum " * 6000, "a  b\n\n c"]


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    ready(spark)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in all columns, empty and long texts, repeated rows, columns with names the operators use."""
    rows = [(i, t, "s" if i % 2 else None, None if i == 4 else "en", i, i) for i, t in enumerate(AWKWARD)]
    rows += [(None, None, None, None, None, None), (2, "other text", "s", "de", 1, 1)] + [(3, "same row", "s", "en", 1, 1)] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, tail int").repartition(3)


# 11 packing ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def checked_plan(counts, longest=2048, tiers=(256, 512, 1024), slack=8):
    """The tokens of every window of a plan, after checking that nothing is lost or overlaps."""
    placed, windows = packing.plan(counts, longest, tiers, slack)
    tails, held = collections.defaultdict(list), collections.defaultdict(list)
    for p in placed:
        for i in range(p.high - p.low):
            at = p.first + i
            tails[p.tail, p.low + i].append((p.before, p.length))
            held[p.tier, p.window + at // p.each].append((p.offset + at % p.each * p.length, p.length))
    assert collections.Counter(t for t, _ in tails) == +collections.Counter(counts)
    for spans, size in [(s, t) for (t, _), s in tails.items()] + [(s, None) for s in held.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert size in (None, at)
    assert all(sorted(w for t, w in held if t == tier) == list(range(n)) for tier, n in windows.items())
    return {key: sum(length for _, length in spans) for key, spans in held.items()}


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_tail_once(seed):
    rng = random.Random(seed)
    most = rng.choice([40, 300, 2047])
    counts = collections.Counter(rng.randint(1, most) for _ in range(rng.choice([1, 7, 500, 5000])))
    if seed % 2:
        counts[rng.randint(1, most)] += 2000  # one length has a third of all
    filled = checked_plan(counts)
    assert all(n == tier if tier < 2048 else n <= tier for (tier, _), n in filled.items())
    total = sum(filled.values())
    if total > 100 * 2048:
        assert sum(tier for tier, _ in filled) - total <= 0.005 * total


def test_plan_cuts_only_what_cannot_be_filled():
    assert checked_plan({1500: 10, 548: 10}) == {(2048, i): 2048 for i in range(10)}
    assert checked_plan({300: 7})[2048, 0] == 7 * 44  # 256 of each stand alone
    assert checked_plan({}) == {} and checked_plan({512: 3}) == {(512, i): 512 for i in range(3)}


def test_plan_does_not_grow_with_the_rows():
    rng = random.Random(1)
    counts = collections.Counter(min(2047, int(rng.expovariate(1 / 300)) + 1) for _ in range(20_000))
    few, many = (len(packing.plan({k: v * m for k, v in counts.items()})[0]) for m in (1, 1_000_000))
    assert many < 3 * few


def test_long_texts_are_cut_where_the_encoder_cuts(tokenizer):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    text = "Some words, 12 numbers\n\n  and it's  spaced; " * 300 + "日本" * 50 + " done"
    parts = list(packing.safe_parts(text, 500))
    assert len(parts) > 10 and "".join(parts) == text
    assert sum((library.encode(p).ids for p in parts), []) == library.encode(text).ids
    assert list(packing.safe_parts("x" * 5000, 100)) == ["x" * 5000] and list(packing.safe_parts("")) == [""]


def check_pieces(rows, texts, tokenizer):
    """Pieces against the library: ids, cover, windows, steps."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    windows, steps = collections.defaultdict(list), collections.defaultdict(collections.Counter)
    whole = collections.defaultdict(list)
    for r in rows:
        windows[r["sequence_id"], r["tier"], r["step"]].append((r["offset"], r["length"]))
        whole[r["doc"], r["doc_tokens"]].append((r["start"], r["length"], np.frombuffer(r["ids"], "<u4").tolist()))
    want = collections.Counter()
    for key, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want[key, tuple(ids)] += 1
    got = collections.Counter()
    for (key, n), pieces in whole.items():
        copies = sum(c for (k, ids), c in want.items() if k == key and len(ids) == n)
        pieces.sort()
        assert sum(p[1] for p in pieces) == copies * n
        if copies == 1:
            at, ids = 0, []
            for start, length, part in pieces:
                assert start == at and length == len(part)
                at += length
                ids += part
            got[key, tuple(ids)] += 1
        else:
            got.update({k: c for k, c in want.items() if k[0] == key and len(k[1]) == n})
    assert got == want
    assert len({s for s, *_ in windows}) == len(windows)
    for (_, tier, step), parts in windows.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == tier or (tier == packing.LONGEST and at < tier)
        steps[step][tier] += 1
    assert all(len(tiers) == 1 and sum(t * n for t, n in tiers.items()) <= packing.LONGEST * packing.STEP_WINDOWS for tiers in steps.values())
    assert sorted(steps) == list(range(len(steps)))


def test_packing_of_awkward_rows(spark, awkward, tokenizer):
    out = packing.pack(awkward, tokenizer)
    rows = out.collect()
    check_pieces(rows, [(r["doc_id"], r["text"]) for r in awkward.collect()], tokenizer)
    assert out.columns == ["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step"]
    assert packing.pack(awkward.limit(0), tokenizer).collect() == []
    with pytest.raises(ValueError):
        packing.pack(awkward, tokenizer, tiers=(100, 1024))
    for w in packing.sequences(out).collect():
        assert len(w["ids"]) == 4 * w["tier"] and w["starts"] == sorted(w["starts"]) and len(w["docs"]) == len(w["starts"])


def test_packing_with_other_tiers(spark, tokenizer):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "word " * rng.randint(0, 90)) for i in range(300)], "doc_id long, text string")
    rows = packing.pack(docs, tokenizer, longest=64, tiers=(16, 32), slack=0).collect()
    held = collections.Counter()
    for r in rows:
        held[r["sequence_id"], r["tier"]] += r["length"]
    assert {t for _, t in held} <= {16, 32, 64} and sum(n != t for (_, t), n in held.items()) <= 2


def test_op11(spark, tokenizer):
    rows = QUERIES["op11_packing"](spark, SF_DIR).collect()
    texts = dict(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids, at = [*library.encode(texts[d] or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(part, "<u4").tobytes()))
            at += r["length"]
        assert at == len(ids)
    held = collections.Counter()
    for r in rows:
        held[r["sequence_id"]] += r["length"]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in held.values())
    assert max(held.values()) <= 2048 and padding <= 0.02 * sum(held.values())


# 12 manifest ---------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(digests):
    """The root, and per leaf the siblings of every level as (left, right)."""
    ways, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, place in enumerate(at):
            first = place // 8 * 8
            ways[i].append(("".join(level[first:place]), "".join(level[place + 1 : first + 8])))
        level = [sha("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
        at = [place // 8 for place in at]
    return (level[0] if level else None), ways


def brute_manifest(rows):
    """``{(key, group, leaf): (subroot, root, way)}``."""
    first = lambda v: (v is not None, v if not isinstance(v, str) else v.encode())
    groups = collections.defaultdict(list)
    for key, group, leaf in rows:
        groups[group].append((first(key), leaf, key))
    names = sorted(groups, key=first)
    trees = {g: brute_tree([leaf for _, leaf, _ in sorted(groups[g], key=lambda r: r[:2])]) for g in names}
    root, top = brute_tree([trees[g][0] for g in names])
    out = {}
    for g, above in zip(names, top):
        for (_, leaf, key), way in zip(sorted(groups[g], key=lambda r: r[:2]), trees[g][1]):
            out.setdefault((key, g, leaf), []).append((trees[g][0], root, [*way, *above]))
    return out


def check_manifest(made, fields):
    got = collections.defaultdict(list)
    for r in made.withColumn("proof", merkle.proof_digest(F.col("way"))).withColumn("folded", merkle.folded(F.col("leaf"), F.col("way"))).collect():
        way = [(bytes(s["left"]).hex(), bytes(s["right"]).hex()) for s in r["way"]]
        assert r["folded"] == r["root"] and r["proof"] == sha("".join(a + b for a, b in way))
        got[r["key"], r["group"], r["leaf"]].append((r["subroot"], r["root"], way))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in fields.items()}


@pytest.mark.parametrize("sizes", [(1,), (8,), (9,), (1, 1), (1, 64, 65, 3), (2, *[1] * 70), (600,)])
def test_manifest_shapes(spark, sizes):
    rows = [(i, f"g{g:03d}" if g else None, sha(f"{g}-{i}")) for g, n in enumerate(sizes) for i in range(n)]
    random.Random(0).shuffle(rows)
    leaves = spark.createDataFrame(rows, "key long, group string, leaf string").repartition(4)
    check_manifest(merkle.proofs(leaves, "group", ["key"]), brute_manifest(rows))


def test_ways_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", -1)
    rows = [(i, "a" if i % 3 else "b", sha(str(i))) for i in range(900)]
    leaves = spark.createDataFrame(rows, "key long, group string, leaf string")
    check_manifest(merkle.proofs(leaves, "group", ["key"]), brute_manifest(rows))


def test_manifest_of_awkward_rows(spark, awkward):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    made = merkle.manifest(awkward, "doc_id", "lang", fields, "text")
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    rows = awkward.collect()
    leaf = lambda r, text: sha("".join(part(text if f == "text" else r[f]) for f in fields))
    check_manifest(made, brute_manifest([(r["doc_id"], r["lang"], leaf(r, r["text"])) for r in rows]))
    small = str.maketrans(merkle.CAPITALS, merkle.SMALL)
    want = sorted(leaf(r, r["text"] and r["text"].translate(small)) for r in rows)
    assert sorted(r["tampered_leaf"] for r in made.collect()) == want
    assert merkle.manifest(awkward.limit(0), "doc_id", "lang", fields, "text").collect() == []


def test_op12_finds_exactly_the_tampered_texts(spark):
    texts = dict(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op12_manifest"](spark, SF_DIR).collect()
    changed = {d for d, t in texts.items() if zlib.crc32(str(d).encode()) % 3 == 0 and any(c in t for c in merkle.CAPITALS)}
    assert len(rows) == len(texts) and {r["doc_id"] for r in rows if not r["verified"]} == changed and len({r["root"] for r in rows}) == 1


# 13 hard negatives ---------------------------------------------------------------------------


def brute_negatives(rows, is_anchor, wanted=5):
    fine = [
        (i, lab, tuple(math.floor(v * 256) for v in x)) for i, x, lab in rows
        if i is not None and lab is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)
    ]
    fine = sorted(set(fine))
    out = []
    for i, lab, x in fine:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, other) for j, other, y in fine if j != i)
        for s, p, _ in [r for r in scored if r[2] == lab][:wanted]:
            fits = [(n, t) for t, n, other in scored if other != lab and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, p, k + 1, n, -s, -t) for k, (n, t) in enumerate(fits[:wanted])]
    return sorted(out)


def mined(spark, rows, **options):
    table = spark.createDataFrame([(i, x, lab, 1, "x") for i, x, lab in rows], "vec_id long, embedding array<float>, label int, block int, anchor string")
    return sorted(map(tuple, hard_negatives.mine(table.repartition(4), F.col("id") % 10 == 0, **options).collect()))


def vectors(seed, n, width, labels):
    rng = np.random.default_rng(seed)
    return [(i, [float(v) for v in rng.normal(0, 1 / 8, width).astype(np.float32)], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("seed,n,width,labels", [(1, 400, 64, 10), (2, 300, 3, 2), (3, 60, 64, 30), (4, 500, 20, 3)])
def test_negatives_match_all_pairs(spark, seed, n, width, labels):
    rows = vectors(seed, n, width, labels)
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert want and mined(spark, rows) == want


def test_negatives_in_small_blocks_and_many_rounds(spark, monkeypatch):
    for name, value in {"BLOCK_ROWS": 64, "BLOCK_ANCHORS": 8, "PART": 3, "EXPECTED": 0.2, "GROWTH": 3}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(5, 300, 32, 4)
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    common = [0.25] * 8
    rows = [(i, common, i % 2) for i in range(120)]  # ties everywhere
    rows += [(200, None, 1), (201, common, None), (None, common, 1), (202, [nan] * 8, 1), (203, [0.1, None] * 4, 1), (204, [inf] * 8, 0)]
    rows += [(210, [], 1), (211, [-0.5] * 8, 1), (212, [0.25] * 3, 0), (213, [0.0] * 8, 7), (220, [0.5] * 8, 9), (230, [-1.0] * 8, 7)]
    rows += [(300, common, 1)] * 4 + [(310, common, 0), (310, common, 1), (310, [0.5] * 8, 1)]
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    got = mined(spark, rows)
    assert want and got == want
    assert mined(spark, [(0, [], 1), (10, [], 1), (11, [], 2)]) == brute_negatives([(0, [], 1), (10, [], 1), (11, [], 2)], lambda i: i % 10 == 0)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(empty, F.col("id") % 10 == 0).collect() == []


def test_large_components_are_added_up_exactly(spark):
    rng = random.Random(7)
    rows = [(i, [float(rng.randint(-(2**18), 2**18)) for _ in range(4)], i % 3) for i in range(60)]
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_the_index_leaves_out_covered_dimensions_and_loses_nothing():
    rng = np.random.default_rng(0)
    x, a = (np.floor(rng.normal(0, 32, (n, 64)) * np.linspace(2, 0.1, 64)).astype(np.int64) for n in (500, 40))
    index = hard_negatives.Index(x, True)
    scores = a @ x.T
    least = np.quantile(scores, 0.99, axis=1).astype(np.int64)
    i, j, s = index.pairs(a, least)
    assert sorted(zip(i, j, s)) == [(p, q, scores[p, q]) for p, q in zip(*np.nonzero(scores >= least[:, None]))]
