"""Operators of ``tokenloom.llm`` on small hand-made tables, against plain Python."""

import collections
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tokenloom.llm import chat_format, decontaminate, language, mixture, near_duplicates, pii, shards  # noqa: E402
from tokenloom.llm import spot_signatures, token_counts, url_filter  # noqa: E402
from tokenloom.llm.registry import ready  # noqa: E402

AWKWARD = [None, "", " ", "\n\t ", "one", "one two three", "x" * 5000, "Ünïcode 😀 日本語 text", "the " * 3000, "a@b.c " * 50]


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    ready(spark)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in all columns, empty and long texts, repeated rows, clashing extra columns."""
    rows = [(i, t, "s" if i % 2 else None, i) for i, t in enumerate(AWKWARD)] + [(None, None, None, None)] + [(3, "same row", "s", 1)] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard int").repartition(3)


# 1 shards ------------------------------------------------------------------------------------


def test_matrix_rows_sum_to_the_shard_sizes():
    import numpy as np

    counts = [5, 0, 17, 1, 40, 3, 2]
    sizes = shards.shard_sizes(sum(counts), 4)
    rows = [shards.matrix_row(7, np.cumsum(counts), p, sizes) for p in range(len(counts))]
    assert [sum(r) for r in rows] == counts
    assert [sum(c) for c in zip(*rows)] == sizes


def test_hypergeometric_mean_and_spread():
    import numpy as np

    rng = np.random.default_rng(1)
    small = [shards.draw_hypergeometric(rng, 30, 50, 20) for _ in range(5000)]
    assert abs(np.mean(small) - 7.5) < 0.1 and abs(np.var(small) - 3.56) < 0.3
    large = [shards.draw_hypergeometric(rng, 3 * 10**10, 5 * 10**10, 2 * 10**9) for _ in range(40)]
    assert abs(np.mean(large) - 7.5e8) < 20_000


def test_shards_are_exact_and_gapless(spark, awkward):
    out = shards.shuffle_into_shards(awkward, 4)
    assert out.columns == [*awkward.columns, "shard_", "slot"]
    rows = out.collect()
    assert sorted(map(str, ([r[c] for c in awkward.columns] for r in rows))) == sorted(map(str, map(list, awkward.collect())))
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard_"]].append(r["slot"])
    assert sorted(map(len, slots.values())) == [3, 3, 4, 4]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards.shuffle_into_shards(awkward.limit(0), 4).collect() == []
    many = spark.range(20_000).repartition(5)
    placed = shards.shuffle_into_shards(many, 3).toPandas()
    assert sorted(placed.groupby("shard").size()) == [6666, 6667, 6667]
    assert abs(placed["id"].corr(placed["slot"])) < 0.03 and abs(placed["id"].corr(placed["shard"])) < 0.03


# 2 decontamination -----------------------------------------------------------------------------


def test_pieces_and_distances_find_all_within_the_budget():
    rng = random.Random(2)
    for _ in range(800):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 24)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 40)))
        distance = brute.edit_distance_inside(item, text)
        assert decontaminate.ItemMasks(item).best_end(text)[0] == distance
        found = decontaminate.Matcher([(1, item)], 0.3).find(text)
        assert (0 in found) == (distance <= int(len(item) * 0.3))
        assert not found or found[0][0] == distance


def test_items_are_found_through_edits(spark, awkward):
    item = "the quick brown fox jumps over the lazy dog and runs far away from all of them"
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, " ,"), (4, "never seen anywhere at all")], "item_id long, text string")
    lead = "some words before it " * 40
    texts = [lead + item.upper() + " after", lead + item.replace("quick", "quikc").replace("lazy", "lasy"), lead + item[:30], lead]
    docs = awkward.select("doc_id", "text", "source", "shard").unionByName(
        spark.createDataFrame([(100 + i, t, None, None) for i, t in enumerate(texts)], awkward.schema)
    )
    found = {(r["doc"], r["item"]): r["distance"] for r in decontaminate.find_items(docs, items).collect()}
    assert found == {(100, 1): 0, (101, 1): 3}
    kept = decontaminate.without_items(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert decontaminate.find_items(docs, items.limit(0)).count() == 0
    assert decontaminate.find_items(docs.limit(0), items).count() == 0
    assert decontaminate.without_items(docs, items.limit(0)).count() == docs.count()


def test_items_are_not_found_inside_words_nor_when_short(spark):
    texts = ["her eyes saw 1421 of them", "yes and 42", "a cat sat on the mat today", "a bobcat sat on the matrix", "the cat sat on the mat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes"), (2, "42"), (3, "cat sat on the mat"), (4, "!")], "item_id long, text string")
    found = lambda least: sorted((r["doc"], r["item"], r["distance"], r["short_items"]) for r in decontaminate.find_items(docs, items, rate=0.0, least=least).collect())
    assert found(1) == [(1, 1, 0, 0), (1, 2, 0, 0), (2, 3, 0, 0), (4, 3, 0, 0)]
    assert found(10) == [(2, 3, 0, 2), (4, 3, 0, 2)] and found(30) == []
    kept = lambda least: sorted(r["doc_id"] for r in decontaminate.without_items(docs, items, rate=0.0, least=least).collect())
    assert (kept(1), kept(10), kept(30)) == ([0, 3], [0, 1, 3], [0, 1, 2, 3, 4])
    ends = {r["doc"]: r["end"] for r in decontaminate.find_items(docs, items, rate=0.0, least=10).collect()}
    assert all(texts[d][:end].rstrip().endswith("the mat") for d, end in ends.items())


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"item number {i} has a text of its own") for i in range(30)], "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before it "), "text").alias("text"))
    whole = sorted(map(tuple, decontaminate.find_items(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 200)
    assert sorted(map(tuple, decontaminate.find_items(docs, items).collect())) == whole and whole


# 3 personal data -------------------------------------------------------------------------------


def test_spans_equal_plain_patterns(spark):
    rng = random.Random(3)
    parts = ["a.b", "@", "x", "ab@c.de", ".", "..", "1", "23", "255", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1", " ", "(", "-"]
    parts += ["+49 30 123456", "é😀", "_", "%", "192.168.0.1", "0.0.0.300", "\n", "é@b.c", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "378282246310005"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + AWKWARD
    texts += ["a." * 3000, "a" * 100_000 + "@b." + "c." * 5000 + "d", "1" * 50_000, "1." * 20_000, "+1 " * 10_000, "x@y.zz " * 1000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    base = pii.span_list(F.col("spans"), tuple(brute.BASE))
    got = dict(pii.find_pii(docs).select("doc_id", base).collect())
    assert [i for i, t in enumerate(texts) if got[i] != brute.pii(t)] == []


def test_checksums_and_context_of_added_kinds(spark, awkward):
    text = "IBAN GB82 WEST 1234 5698 7654 32, DE89370400440532013000, GB82WEST12345698765433, my ssn 123-45-6789 and far away from it, " + "x" * 60 + " 123-45-6780"
    spans = pii.find_pii(spark.createDataFrame([(text,)], "text string")).first()["spans"]
    kinds = collections.Counter(s["kind"] for s in spans if s["kind"] in ("iban", "ssn"))
    assert kinds == {"iban": 2, "ssn": 1}
    assert all(text[s["start"] : s["end"]] == s["text"] for s in spans)
    assert next(s for s in spans if s["kind"] == "iban")["score"] > 0.9
    out = pii.find_pii(awkward.withColumn("spans", F.lit(1)).withColumn("t", F.lit(2)))
    assert out.columns == [*awkward.columns, "spans", "t", "spans_"] and out.count() == awkward.count()
    assert pii.find_pii(awkward.limit(0)).count() == 0


# 4 tokens --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_every_prefix_has_the_librarys_count(vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    counter = token_counts.PrefixCounter(vocabulary)
    count = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    rng = random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "é", "日本", "1", "23", "!", "...", "<|endoftext|>", "<|", "endof"]
    parts += [" ", "\x1c", "😀", "՘", "ß", "The", " a", "'v", "e", "l", "\r\n", "ing", "tion"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert counter.prefix_counts(text) == [count(text[:k]) for k in range(len(text) + 1)], text
        assert counter.count(text) == count(text)


def test_counts_budgets_and_awkward_texts(spark, awkward, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    docs = awkward.withColumn("n_tokens", F.lit("clash"))
    out = token_counts.count_tokens(docs, vocabulary, prefixes=True)
    assert out.columns == [*docs.columns, "prefix_tokens", "n_tokens_"]
    rows = out.withColumns(
        {"before": token_counts.tokens_before(F.col("prefix_tokens"), 7), "fits": token_counts.longest_within(F.col("prefix_tokens"), 3)}
    ).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        text = r["text"] or ""
        sizes = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(min(len(text), 40) + 1)]
        assert r["prefix_tokens"][: len(sizes)] == sizes and r["before"] == sizes[min(7, len(text))]
        assert r["n_tokens_"] == len(library.encode(text, add_special_tokens=False).ids)
        assert r["prefix_tokens"][r["fits"]] <= 3 and all(n > 3 for n in r["prefix_tokens"][r["fits"] + 1 :])
    assert token_counts.count_tokens(awkward.limit(0), vocabulary).count() == 0


# 5 language ------------------------------------------------------------------------------------

SAMPLES = {"en": "the cat and the dog were in the house with them", "fr": "le chat et le chien sont dans la maison avec nous", "de": "die katze und der hund sind in dem haus mit uns"}


def test_language_fuses_evidence(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        lang = rng.choice(list(SAMPLES))
        words = SAMPLES[lang].split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60))), lang.upper() + "-XX", f"{lang}.site.{lang}", lang))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string, truth string")
    model = language.learn_text_model(labelled.where("doc_id % 2 = 0"), "doc_id", "text", "lang")
    assert model.languages == ["de", "en", "fr"]
    args = (model, "doc_id", F.col("text"), F.col("lang"), F.col("host"))
    found = {r["doc"]: r for r in language.identify(labelled, *args).collect()}
    assert sum(found[r[0]]["lang"] == r[4] for r in rows) >= 297
    odd = [(900, None, None, None), (901, "", "fr", "fr.site.fr"), (902, "12 34", "fr", None), (903, "q", "fr", "fr.site.fr"), (903, "q", "fr", "fr.site.fr"), (None, "le chat", None, None)]
    mixed = labelled.drop("truth").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, host string"))
    by_id = collections.defaultdict(list)
    for r in language.identify(mixed, *args).collect():
        by_id[r["doc"]].append((r["lang"], round(r["confidence"], 6)))
    assert by_id[900] == by_id[901] == by_id[902] == [("und", 0.0)]
    assert by_id[903][0][0] == "fr" and by_id[903][0] == by_id[903][1]  # the text says nothing; host and markup do
    kept = language.with_known_language(mixed, language.identify(mixed, *args), "doc_id", F.col("text"))
    assert kept.columns == mixed.columns and kept.count() == mixed.count() - 3
    assert language.identify(mixed.limit(0), *args).count() == 0
    empty = language.learn_text_model(mixed.limit(0), "doc_id", "text", "lang")
    assert {r["lang"] for r in language.identify(mixed, empty, *args[1:]).collect()} == {"und"}


def test_languages_that_were_not_learnt_and_rare_ones(spark):
    """Strange scripts are ``und`` whichever language has the least text, and a rare language is learnt and found."""
    rng = random.Random(6)
    text = lambda words, n: " ".join(rng.choice(words.split()) for _ in range(n))
    rare = "kissa ja koira olivat talossa heidän kanssaan eilen illalla"
    rows = [(i, text(SAMPLES["en"], 40), "en") for i in range(400)] + [(1000 + i, text(SAMPLES["de"], 40), "de") for i in range(20)]
    rows += [(2000 + i, text(rare, 40), "fi") for i in range(3)] + [(3000, "whatever it is", "und")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn_text_model(labelled, "doc_id", "text", "lang", rows=30)
    assert model.languages == ["de", "en", "fi"]
    consonants = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(30))
    strange = ["кошка и собака были в доме вместе с ними вчера вечером", "猫和狗昨天晚上和他们一起在房子里", consonants]
    own = [text(rare, 25), text(SAMPLES["en"], 25), text(SAMPLES["de"], 25)]
    docs = spark.createDataFrame(list(enumerate(strange + own)), "doc_id long, text string")
    none = F.lit(None).cast("string")
    found = {r["doc"]: r["lang"] for r in language.identify(docs, model, "doc_id", F.col("text"), none, none).collect()}
    assert [found[i] for i in range(6)] == ["und", "und", "und", "fi", "en", "de"]


def test_markup_and_addresses(spark):
    page = '<!DOCTYPE html><HTML class="a" LANG=\'de-AT\'><script>var a="<p>";</script><!-- x > y --><p>Ja<br>nein</p></html>'
    row = spark.createDataFrame([(page, "https://User@Www.A.example.ORG/x?y#z")], "html string, url string").select(
        language.declared_in(F.col("html")), F.trim(language.visible(F.col("html"))), language.host_of(F.col("url")), language.suffix_of(F.lit("a.b.c")), language.domain_of(F.lit("a.b.c"))
    ).first()
    assert list(row) == ["de", "Ja nein", "user@www.a.example.org", "c", "b.c"]


# 6 chats ---------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(6)
    parts = ["<|im_end|>", "<|im_start|>", "<\\|", "<", "|", "\\", "\n", "é😀", "assistant", "ok", ""]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", None, "a\nb", "<|im_start|>", "\\n", "\\"])
            rows.append((conv, turn, role, None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))))
    rows += [(None, 0, "assistant", "x"), (77, 1, "user", "twice"), (77, 1, "user", "twice"), (78, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    formatted = chat_format.format_turns(turns.withColumn("piece", F.lit(1)))
    assert formatted.columns == ["conv_id", "turn", "role", "text", "piece", "piece_", "loss_start", "loss_chars"]
    for r in formatted.collect():
        assert r["piece_"].count("<|im_start|>") == 1 and r["piece_"].count("<|im_end|>") == 1
        learnt = r["piece_"][r["loss_start"] : r["loss_start"] + r["loss_chars"]]
        assert r["loss_chars"] == 0 or (r["role"] == "assistant" and learnt.replace("<\\", "<").count("|") == (r["text"] or "").count("|"))
    got = {r["conv_id"]: r for r in chat_format.digest_conversations(chat_format.format_turns(turns)).collect()}
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn if turn is not None else -1, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, own in groups.items():
        own = sorted(own)
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == brute.sha("".join(f"{r}\n{t}\n" for _, r, t in own))
        learnt = "".join(t for _, r, t in own if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(learnt), brute.sha(learnt))
    assert chat_format.digest_conversations(chat_format.format_turns(turns.limit(0))).count() == 0


# 7 mixing --------------------------------------------------------------------------------------


def test_targets_fill_up_to_the_most(spark):
    sizes = {"a": 10, "b": 1000, "c": 1000, None: 30, "z": 0}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in mixture.source_targets(spark.createDataFrame(rows, "source string, size long"), "source", "size").collect()}
    weights = dict(zip(["a", "b", "c", "z", None], [3, 1, 2, 3, 1]))
    want, capped = 1.5 * sum(sizes.values()), set()
    while True:
        level = (want - sum(2 * sizes[s] for s in capped)) / sum(w for s, w in weights.items() if s not in capped)
        more = {s for s in sizes if s not in capped and level * weights[s] > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in sizes:
        assert got[s] == pytest.approx(2 * sizes[s] if s in capped else level * weights[s])


def test_mix_repeats_whole_rows(spark, awkward):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "abc"[i % 3], i) for i in range(3000)], awkward.schema)
    planned = mixture.mix_plan(docs.withColumn("size", mixture.word_count("text"))).collect()
    taken, target = collections.Counter(), {}
    for r in planned:
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) < 0.05 * target[s] for s in target)
    mixed = mixture.mix(docs)
    assert mixed.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == {r["doc_id"]: r["copies"] for r in planned if r["copies"]}
    assert mixture.mix(awkward).columns == awkward.columns and mixture.mix(awkward.limit(0)).count() == 0


# 8 urls ----------------------------------------------------------------------------------------


def test_urls_are_judged_by_template(spark):
    rows = [(i, f"http://A.example.net/{'spam' if i % 2 else 'news'}/{i}/p?q=1") for i in range(400)]
    rows += [(1000, None), (1001, "no scheme"), (1002, "http://x.org"), (1003, "HTTP://Sub.B.com/De/1"), (1004, "http://b.com/de/1#x"), (1005, "://a.example.net/spam/deadbeef99/p"), (1006, "http://a.example.net/spam/77/p"), (1006, "http://a.example.net/spam/77/p")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("good", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(0, 200)], "page_id long, good boolean")
    got = collections.defaultdict(list)
    for r in url_filter.judge_urls(pages, labels, [("com", "/de/", "block"), ("b.com", "/de/1", "allow")]).collect():
        got[r["page_id"]].append(r)
    one = {k: v[0] for k, v in got.items()}
    assert one[1]["verdict"] == "block" and one[1]["template"] == "/spam/*/p" and one[2]["verdict"] == "allow"
    assert (one[1]["host"], one[1]["path"]) == ("a.example.net", "/spam/1/p")
    assert one[1006]["verdict"] == "block" and len(got[1006]) == 2
    assert (one[1000]["host"], one[1000]["path"], one[1000]["verdict"]) == ("", "", "allow") and one[1001]["host"] == ""
    assert one[1003]["rule"] is None and one[1004]["rule"] == "b.com/de/1" and one[1004]["verdict"] == "allow"
    assert url_filter.judge_urls(pages, labels.limit(0)).where("verdict <> 'allow'").count() == 0
    assert url_filter.judge_urls(pages.limit(0), labels).count() == 0


def test_urls_that_differ_only_deep_down(spark):
    """Branches below the fourth segment have their own verdicts, and a lone deep path keeps all its segments."""
    rows = [(i, f"http://deep.net/a/b/c/d/{'spam' if i % 2 else 'news'}/{i}/x/{'p/' * (i % 3)}") for i in range(200)]
    lone = "/z" + "/y" * 60
    pages = spark.createDataFrame([*rows, (900, f"http://lone.net/b{lone}"), (901, "http://lone.net/b")], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(100)], "page_id long, good boolean")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, labels).collect()}
    assert {got[i]["verdict"] for i in range(1, 200, 2)} == {"block"} and {got[i]["verdict"] for i in range(0, 200, 2)} == {"allow"}
    assert got[0]["template"] == "/a/b/c/d/news/{n}/x/*" and got[1]["template"].startswith("/a/b/c/d/spam/")
    assert got[900]["template"] == f"/b{lone}" and got[901]["template"] == "/b"


# 9 near duplicates -----------------------------------------------------------------------------


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


def test_few_labels_are_learnt_from_noise(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    rows = [(i, "some words here", f"x{'abcdefgh'[i]}") for i in range(8)] + [(10 + i, "other words there", "en") for i in range(5)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert language.learn_text_model(labelled, "doc_id", "text", "lang").languages == ["en", "xa"]


def test_components_equal_brute_force(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    texts = [edited(rng, base, rng.randint(0, 6)) for _ in range(120)]  # one large group, not all linked
    chain = [f"c{i}" for i in range(260)]
    texts += [" ".join(chain[i : i + 100]) for i in range(0, 150, 6)]  # a chain in which only neighbours are linked
    texts += [" ".join(f"r{rng.randrange(10**6)}" for _ in range(60)) + " " + " ".join(base[:60]) for _ in range(40)]  # a shared passage
    texts += ["same text here for all"] * 30 + AWKWARD + ["One TWO three", "one two THREE", "É one two three four", "é one two three four"]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for percent in (80, 85):
        want = brute.near(enumerate(texts), percent)
        got = {r["doc"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates.near_duplicates(docs, percent=percent).collect()}
        assert {d: (n, c, c == d) for d, (n, c) in want.items()} == got
    kept = near_duplicates.one_of_each_group(docs, percent=85)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if c == d)


def test_near_duplicates_of_awkward_rows(spark, awkward):
    got = near_duplicates.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    kept = near_duplicates.one_of_each_group(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r["text"]) for r in kept.collect()) == sorted([*map(str, AWKWARD), "None", "same row"])
    assert near_duplicates.near_duplicates(awkward.limit(0)).count() == 0


def open_classes(spark, sets, roots):
    rows = [(1, k, len(v), roots[k]) for k, v in sets.items()] + [(2, k, len(v), roots[k]) for k, v in sets.items()]
    members = spark.createDataFrame(rows, "bucket long, set_key string, n long, root string")
    return members, spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "set_key string, shingles array<long>")


@pytest.mark.parametrize("percent", [80, 85])
def test_open_classes_meet_wherever_they_may_link(spark, percent):
    rng = random.Random(percent)
    base = rng.sample(range(10**6), 30)
    sets = {}
    for i in range(150):
        own = set(base[: rng.randint(20, 30)]) - set(rng.sample(base, rng.randint(0, 6))) | {rng.randint(0, 60) for _ in range(rng.randint(0, 6))}
        sets[f"s{i:03}"] = own
    roots = {k: rng.choice([k, k, "s000", "s001"]) for k in sets}
    members, held = open_classes(spark, sets, roots)
    found = near_duplicates._across(near_duplicates._rarest(members, held, percent), percent).collect()
    got = {(min(r["set_key"], r["b"]), max(r["set_key"], r["b"])) for r in found}
    apart = {(a, b) for a in sets for b in sets if a < b and roots[a] != roots[b]}
    linked = {(a, b) for a, b in apart if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert linked and linked <= got <= apart


def test_a_group_of_copies_below_the_threshold_is_not_compared_in_pairs(spark):
    """Every copy lacks a sixth of the common shingles and has as many of its own: none links."""
    rng = random.Random(3)
    base = list(range(60))
    sets = {f"s{i:03}": set(rng.sample(base, 50)) | {1000 * i + k for k in range(1, 11)} for i in range(1, 400)}
    members, held = open_classes(spark, sets, {k: k for k in sets})
    assert near_duplicates._across(near_duplicates._rarest(members, held, 80), 80).count() < 400


def test_further_links_join_known_components(spark):
    rng = random.Random(4)
    links = [tuple(rng.sample([f"n{k:02}" for k in range(80)], 2)) for _ in range(60)]
    frame = lambda part: spark.createDataFrame(part, "a string, b string")
    roots = near_duplicates.components(frame(links[:25]))
    for part in (links[25:26], links[:5], links[26:]):
        roots = near_duplicates.merged(roots, frame(part))
    want = {r["node"]: r["root"] for r in near_duplicates.components(frame(links)).collect()}
    got = [(r["node"], r["root"]) for r in roots.collect()]
    assert len(got) == len(want) and dict(got) == want


def test_components_of_long_chains_and_stars(spark):
    edges = [(f"{i:05d}", f"{i + 1:05d}") for i in range(0, 700)] + [("x", f"y{i}") for i in range(500)]
    got = {r["node"]: r["root"] for r in near_duplicates.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert all(got[n] == ("x" if n[0] in "xy" else "00000") for n in got) and len(got) == 701 + 501


# 10 fingerprints -------------------------------------------------------------------------------


def test_signatures_and_neighbours_equal_brute_force(spark):
    rng = random.Random(10)
    words = ["the", "of", "and", "cat", "dog", "Fish,", "bird!", "é", "la", "x1"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(200)] + [t for t in AWKWARD]
    docs = spark.createDataFrame([(3 * i - 50, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r for r in spot_signatures.compare_with_next(docs).collect()}
    common = set(spot_signatures.COMMON)
    for i, text in enumerate(texts):
        row, text, other = got[3 * i - 50], text or "", texts[(i + 1) % len(texts)] or ""
        cut = len(text) // 4
        new = text[: len(text) - cut] + other[:cut]
        own, next_, changed = (brute.spot_signatures(t, common) for t in (text, other, new))
        assert (row["n_chars"], row["edited"]) == (len(text), new)
        assert (len(row["signatures"]), len(row["edited_signatures"])) == (len(own), len(changed))
        assert row["near_edited"] == pytest.approx(brute.jaccard(own, changed))
        assert row["near_next"] == pytest.approx(brute.jaccard(own, next_))


def test_neighbours_of_awkward_rows(spark, awkward):
    assert spot_signatures.compare_with_next(awkward).count() == awkward.count()
    assert spot_signatures.compare_with_next(awkward.limit(0)).count() == 0
    alone = spot_signatures.compare_with_next(spark.createDataFrame([(1, "the cat sat")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0 and alone["edited"] == "the cat sth"


def test_pairs_of_fingerprints_equal_all_pairs(spark):
    rng = random.Random(11)
    base = [rng.choice(["the", "of", "and"]) if i % 3 == 0 else f"w{i}" for i in range(120)]
    texts = [edited(rng, base, rng.randint(0, 4)) for _ in range(25)] + [edited(rng, base, 0)] * 3 + [" ".join(f"q{rng.randrange(99)}" for _ in range(30)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs, members = spot_signatures.near_pairs(docs, least=0.7)
    of = {r["doc_id"]: r["class"] for r in members.collect()}
    sets = {d: brute.spot_signatures(t, set(spot_signatures.COMMON)) for d, t in enumerate(texts)}
    want = {tuple(sorted((of[a], of[b]))) for a in of for b in of if of[a] != of[b] and brute.jaccard(sets[a], sets[b]) >= 0.7}
    assert {(r["left"], r["right"]) for r in pairs.collect()} == want and want
