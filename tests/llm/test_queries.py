"""Registered queries of ``tokenloom.llm`` and the pipeline on the smallest tables."""

import collections
import os
import sys
import zlib
from pathlib import Path

import pytest
from oracle import connect, difference

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from tokenloom.llm import decontaminate, mixture, spot_signatures  # noqa: E402
from tokenloom.llm.queries import ORACLES, QUERIES  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def documents(spark):
    return sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert difference(spark, connect(SF_DIR), QUERIES[name], ORACLES[name], SF_DIR) is None


def test_all_are_registered():
    own = __spark_entry__.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(own) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_op1(spark, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op1_shards"](spark, SF_DIR).collect()}
    for d, text, *_ in documents:
        raw = (text or "").encode()
        assert (rows[d]["size"], rows[d]["text_crc32"], rows[d]["law"]) == (len(raw) + 1, zlib.crc32(raw), "rows")
    slots = collections.defaultdict(list)
    for r in rows.values():
        slots[r["shard"]].append(r["slot"])
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op2(spark, documents):
    plain = lambda df: {r[0]: f" {r[1]} " for r in df.collect()}
    from pyspark.sql import functions as F

    items = plain(spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", decontaminate.plain(F.col("text"))))
    texts = plain(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", decontaminate.plain(F.col("text"))))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in QUERIES["op2_decontaminate"](spark, SF_DIR).collect()}
    for (d, i), distance in got.items():
        assert distance == brute.edit_distance_inside(items[i], texts[d]) <= int((len(items[i]) - 2) * decontaminate.ERROR_RATE)
    exact = {(d, i) for d, t in texts.items() for i, item in items.items() if item in t}
    assert exact and exact <= set(got)


def test_op3(spark, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op3_pii"](spark, SF_DIR).collect()}
    for d, text, *_ in documents:
        base = brute.pii(text)
        assert rows[d]["base_sha256"] == brute.sha(base)
        assert [rows[d][f"n_{k}"] for k in brute.BASE] == [base.count(f"{k}:") for k in brute.BASE]


def test_op4(spark, documents):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = {r["doc_id"]: r for r in QUERIES["op4_tokens"](spark, SF_DIR).collect()}
    for d, text, *_ in documents:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (rows[d]["n_tokens"], rows[d]["n_bytes"], rows[d]["over_limit"]) == (n, len((text or "").encode()), n > 1024)


def test_op5(spark):
    rows = QUERIES["op5_language"](spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/pages.parquet").count()
    assert sum(r["lang"] == r["declared"] for r in rows) >= 0.95 * len(rows)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text", "lang").collect()
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url", "html").collect()
    want = brute.languages(docs, pages)
    for r in rows:
        lang, confidence = want[r["page_id"]]
        assert r["lang"] == lang and r["confidence"] == pytest.approx(confidence, abs=2e-6)


def test_op9(spark, documents):
    want = brute.near([d[:2] for d in documents], 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op9_near_duplicates"](spark, SF_DIR).collect()}
    assert got == want


def test_op10(spark, documents):
    common = set(spot_signatures.COMMON)
    rows = {r["doc_id"]: r for r in QUERIES["op10_spot_signatures"](spark, SF_DIR).collect()}
    for i, (d, text, *_) in enumerate(documents):
        other = documents[(i + 1) % len(documents)][1]
        cut = len(text) // 4
        new = text[: len(text) - cut] + other[:cut]
        own, next_, changed = (brute.spot_signatures(t, common) for t in (text, other, new))
        row = rows[d]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), brute.sha(new))
        assert (len(row["fingerprint"]), len(row["edited_fingerprint"])) == (16 * len(own), 16 * len(changed))
        assert row["near_edited"] == pytest.approx(brute.jaccard(own, changed))
        assert row["near_next"] == pytest.approx(brute.jaccard(own, next_))
    by_text = collections.defaultdict(set)
    for d, text, *_ in documents:
        by_text[text].add(rows[d]["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())


def test_language_stage_keeps_a_corpus_without_labels(spark):
    """No language can be learnt, so none can be missed."""
    rows = [(i, "some english words", None if i % 2 else "??", "web", 18) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.language(spark, docs, SF_DIR).count() == 50
    assert corpus_pipeline.language(spark, docs.limit(0), SF_DIR).count() == 0


def test_pipeline(spark, documents):
    """Each stage against plain Python over what the stage before has kept."""
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, [d[:2] for d in documents]
    items = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = mixture.stored(stage(spark, docs, SF_DIR), name)
        after = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        if name != "sharding":
            assert docs.columns == columns
        if name == "language":
            assert after == before  # all are clean
        if name == "near_duplicates":
            assert [d for d, _ in after] == sorted(d for d, (_, c) in brute.near(before, 80).items() if c == d)
        if name == "decontamination":
            kept = {d for d, _ in after}
            held = {d for d, t in before if any(i in t for i in items)}
            assert held and not held & kept
            assert {d for d, _ in before} - kept == held  # no copy with edits is planted here
        if name == "mixing":
            copies = collections.Counter(after)
            assert set(copies) <= set(before) and max(copies.values()) <= 2
        if name == "sharding":
            assert after == before
            sizes = collections.Counter(r["shard"] for r in docs.collect())
            assert max(sizes.values()) - min(sizes.values()) <= 1
        before = after
