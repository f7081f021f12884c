"""Language identification by Bayesian fusion of evidence.

Four pieces of evidence are multiplied for every row and language:

* the likelihood of the text under byte trigrams learnt from labelled rows;
* the probability that a text of this language declares the markup language it declares;
* the probability that it stands under its address suffix;
* the prior of its host, smoothed towards its domain, and that towards the whole corpus.

The last three are learnt from all rows by grouped counts of what the texts alone say. A
row's own text is taken out of its host's counts, so that it does not count twice.

Beside the learnt languages there is an open class, ``und``, under which all trigrams are
equally likely. It takes part in all four, so a text that no learnt language explains
becomes ``und`` whatever the languages are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import attach, column, fresh, stored, without_keys

# Labelled rows of each language that the text model is learnt from, about; those of the least hashes.
SAMPLE_ROWS = 4000
# Labels that are learnt at most, those with the most rows; more are no languages but noise.
MOST_LANGUAGES = 256
BUCKETS = 1 << 14
# The share of a language's trigrams that are like those of the open class: one floor for the
# unseen ones of all languages, however much text a language was learnt from.
FLOOR_SHARE = 0.1
# A text speaks with the weight of at most this many independent trigrams, however long it is.
EVIDENCE_GRAMS = 100.0
# Rows that a domain's or the corpus' distribution counts for in the one below it.
STRENGTH = 10.0
SMALL = 0.5  # added to every count of declared languages and suffixes
LEAST_CONFIDENCE = 0.5
UNDECIDED = "und"


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray  # languages x buckets


def letters(text: Column) -> Column:
    """Lower-case runs of letters between single spaces; empty without a letter."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]++", " "))


def visible(html: Column) -> Column:
    """The text of a page without scripts, styles, comments and tags."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", " ")


def declared_in(html: Column) -> Column:
    """The primary part of the language that the markup declares, in lower case; else null."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]+)", 1))
    return F.nullif(found, F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _grams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of `` text ``."""
    b = np.frombuffer(f" {text} ".encode(), np.uint8).astype(np.uint32)
    codes = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((codes * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def learn_text_model(labelled: DataFrame, key: str, text: str, label: str, rows: int = SAMPLE_ROWS) -> TextModel:
    """Trigram frequencies per label, from about ``rows`` labelled rows of each label.

    A label with more rows is thinned by hashes of key and text to ``rows`` expected ones;
    one with fewer, however rare, is read whole. Of more than ``MOST_LANGUAGES`` labels those
    with the most rows are learnt, of equal ones the first by name. Tasks count the trigrams of
    their sampled rows where they lie, the counts are summed by label and trigram, and
    what reaches the driver is one number for each of these. Labels are compared in lower case
    by their primary part; ``und`` is not a language. Without a labelled row there is no
    language, and ``identify`` decides nothing.
    """
    name = _primary(column(labelled, label))
    draw = F.xxhash64(column(labelled, key), column(labelled, text))
    known = labelled.select(draw.alias("hash"), name.alias("label"), column(labelled, text).alias("text"))
    known = known.where(F.col("label").isNotNull() & (F.col("label") != UNDECIDED) & F.col("text").isNotNull())
    bounds = known.groupBy("label").agg(F.count("*").alias("rows"), F.min("hash").alias("least"))
    bounds = stored(bounds.orderBy(F.desc("rows"), "label").limit(MOST_LANGUAGES), "labels")
    place = F.col("hash") / F.lit(2.0**64) + F.lit(0.5)  # in [0, 1]
    taken = (place * F.col("rows") <= rows) | (F.col("hash") == F.col("least"))
    sample = known.join(F.broadcast(bounds), "label").where(taken).select("label", letters(F.col("text")).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label_, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sums.setdefault(label_, np.zeros(BUCKETS, np.int64))
                own += np.bincount(_grams(text_), minlength=BUCKETS)
        for label_, own in sums.items():
            held = np.flatnonzero(own)
            columns = [pa.array([label_] * len(held)), pa.array(held, pa.int32()), pa.array(own[held], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "bucket", "n"])

    parts = sample.mapInArrow(counted, "label string, bucket int, n long")
    found = parts.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(r["label"] for r in bounds.select("label").collect())
    sums = np.zeros((len(languages), BUCKETS))
    if found.num_rows:
        at = {name: place for place, name in enumerate(languages)}
        rows_ = np.array([at[name] for name in found["label"].to_pylist()])
        sums[rows_, found["bucket"].to_numpy()] = found["n"].to_numpy()
    seen = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1.0)
    return TextModel(languages, np.log((1.0 - FLOOR_SHARE) * seen + FLOOR_SHARE / BUCKETS))


def _primary(label: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]+)", 1)), F.lit(""))


def _log_shares(base: DataFrame, kind: str, languages: list[str]) -> DataFrame:
    """For every value of ``kind``: the log probability that a text of each language has it."""
    counts = base.where(F.col(kind).isNotNull() & F.col("text_lang").isNotNull()).groupBy(kind).agg(*_by_language(languages))
    counts = stored(counts, f"{kind}-counts")
    sums = counts.agg(F.count("*").alias("values"), *(F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages)))).first()
    logs = [
        F.log((F.col(f"n{i}") + SMALL) / F.lit((sums[f"n{i}"] or 0) + SMALL * (sums["values"] + 1.0)))
        for i in range(len(languages))
    ]
    return counts.select(kind, F.array(*logs).alias(f"{kind}_logs"))


def _by_language(languages: list[str]) -> list[Column]:
    return [F.count_if(F.col("text_lang") == name).cast("double").alias(f"n{i}") for i, name in enumerate(languages)]


def identify(
    docs: DataFrame, model: TextModel, key: str, text: Column, declared: Column, host: Column, strength: float = STRENGTH
) -> DataFrame:
    """``(doc, text_hash, host, declared, suffix, text_lang, lang, confidence)`` for every row of ``docs``.

    ``lang`` is the language of the greatest posterior and ``confidence`` that posterior;
    ``und`` with 0 for a text without any letter, ``und`` where the open class has the
    greatest, and ``und`` where none reaches one half. Ties go to the first language by name. A null host, suffix or declared language
    is no evidence. Repeated rows get equal results, an empty table gives an empty table.
    Texts do not move: only small rows do, and a host with a third of all rows is counted by
    partial sums and joined by broadcast or over salted keys.
    """
    languages = [*model.languages, UNDECIDED] if model.languages else []
    size = len(languages)
    logs = np.vstack([model.logs, np.full((1, BUCKETS), -np.log(BUCKETS))])

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for one in texts:
                words = one.as_py()
                if not words or not size:
                    out.append(None)
                    continue
                grams = _grams(words)
                sums = logs[:, grams].sum(axis=1) if len(grams) < 4096 else logs @ np.bincount(grams, minlength=BUCKETS)
                sums *= min(1.0, EVIDENCE_GRAMS / len(grams))
                out.append((sums - sums.max()).tolist())
            yield pa.array(out, pa.list_(pa.float64()))

    score = F.arrow_udf(scored, "array<double>", F.ArrowUDFType.SCALAR_ITER)
    base = docs.select(column(docs, key).alias("doc"), F.xxhash64(text).alias("text_hash"), host.alias("host"), _primary(declared).alias("declared"), score(letters(text)).alias("text_logs"))
    names = F.array(*(F.lit(x) for x in languages)).cast("array<string>")
    best = F.array_position("text_logs", F.array_max("text_logs")).cast("int")
    base = base.withColumns({"suffix": suffix_of(F.col("host")), "domain": domain_of(F.col("host")), "text_lang": F.get(names, best - 1)})
    base = stored(base, "evidence")
    if not size:
        return base.select("doc", "text_hash", "host", "declared", "suffix", "text_lang", F.lit(UNDECIDED).alias("lang"), F.lit(0.0).alias("confidence"))
    # Priors: what texts say per host, per domain, and over all rows.
    hosts = stored(base.where(F.col("host").isNotNull()).groupBy("host", "domain").agg(*_by_language(languages)), "hosts")
    domains = hosts.groupBy("domain").agg(*(F.sum(f"n{i}").alias(f"d{i}") for i in range(size)))
    both = stored(
        hosts.join(domains, "domain").select(
            "host",
            F.array(*(F.col(f"n{i}") for i in range(size))).alias("host_counts"),
            F.array(*(F.col(f"d{i}") for i in range(size))).alias("domain_counts"),
        ),
        "priors",
    )
    total = base.agg(*_by_language(languages)).first()
    whole = sum(total) + SMALL * size
    corpus = F.array(*(F.lit((total[i] + SMALL) / whole) for i in range(size)))
    joined = attach(base, both, ["host"], ["doc"])
    for kind in ("declared", "suffix"):
        joined = attach(joined, _log_shares(base, kind, languages), [kind], ["doc"])
    own = F.transform(names, lambda x: (x == F.col("text_lang")).cast("double"))
    none = F.array_repeat(F.lit(0.0), size)
    others = lambda counts: F.when(F.col(counts).isNotNull(), F.zip_with(counts, own, lambda n, o: n - o)).otherwise(none)
    joined = joined.withColumns({"host_n": others("host_counts"), "domain_n": others("domain_counts")})
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    joined = joined.withColumns({"host_sum": add("host_n"), "domain_sum": add("domain_n")})
    domain_prior = F.zip_with("domain_n", corpus, lambda n, p: (n + strength * p) / (F.col("domain_sum") + strength))
    joined = joined.withColumn("domain_prior", domain_prior)
    prior = F.zip_with("host_n", "domain_prior", lambda n, p: F.log((n + strength * p) / (F.col("host_sum") + strength)))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs_all = plus(plus(F.col("text_logs"), prior), plus(F.coalesce("declared_logs", none), F.coalesce("suffix_logs", none)))
    joined = joined.withColumn("logs", logs_all).withColumn("top", F.array_max("logs"))
    joined = joined.withColumn("confidence", 1.0 / add(F.transform("logs", lambda x: F.exp(x - F.col("top")))))
    sure = F.col("confidence") >= LEAST_CONFIDENCE
    lang = F.when(sure, F.get(names, F.array_position("logs", F.col("top")).cast("int") - 1)).otherwise(UNDECIDED)
    return joined.select(
        "doc", "text_hash", "host", "declared", "suffix", "text_lang", F.coalesce(lang, F.lit(UNDECIDED)).alias("lang"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")
    )


def with_known_language(docs: DataFrame, found: DataFrame, key: str, text: Column) -> DataFrame:
    """The rows of ``docs`` whose language was decided, with their own columns.

    ``found`` comes from ``identify``. A model without languages decides nothing, and all rows
    would go: do not call it then.
    """
    (hashed,) = fresh(docs.columns, "text_hash")
    undecided = found.where(F.col("lang") == UNDECIDED).select(F.col("doc").alias(key), F.col("text_hash").alias(hashed))
    return without_keys(docs.withColumn(hashed, F.xxhash64(text)), undecided, [key, hashed]).drop(hashed)
