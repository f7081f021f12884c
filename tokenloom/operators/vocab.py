"""Vocabularies and id maps between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import words
from tokenloom.operators.lookup import lookup
from tokenloom.operators.ordering import global_index
from tokenloom.session import spread


def token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``(token, n)`` of lower-cased whitespace tokens; counted before the shuffle."""
    return (
        spread(df.select(text)).select(F.explode(words(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )


def ranked_vocab(counts: DataFrame, first_id: int = 1) -> DataFrame:
    """``vocab(token, id)`` with ids by falling count, then token."""
    ranked = global_index(counts, [F.desc("n"), F.asc("token")])
    return ranked.select("token", (F.col("idx") + first_id).cast("int").alias("id"))


def vocab_head(counts: DataFrame, size: int, first_id: int = 1) -> DataFrame:
    """The ``size`` most frequent tokens as a vocabulary of that size."""
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(size)
    listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "token"))).alias("all"))
    return listed.select(F.posexplode("all").alias("pos", "e")).select(
        F.col("e.token").alias("token"), (F.col("pos") + first_id).cast("int").alias("id")
    )


def added_tokens(vocab: DataFrame, tokens: list[str]) -> DataFrame:
    """Append tokens with the ids after the last one; tokens it has already keep theirs."""
    spark = vocab.sparkSession
    last = vocab.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).scalar()
    extra = spark.createDataFrame([(t, i + 1) for i, t in enumerate(tokens)], "token string, off int")
    known = vocab.join(F.broadcast(extra.select("token")), "token", "left_semi").select("token")
    fresh = extra.join(known, "token", "left_anti")
    return vocab.select("token", "id").unionByName(
        fresh.select("token", (last + F.col("off")).cast("int").alias("id"))
    )


def exact_map(teacher: DataFrame, student: DataFrame) -> DataFrame:
    """Equal tokens; of equal student tokens the least id. Others stay unmapped."""
    targets = student.groupBy("token").agg(F.min("id").alias("dst_id"))
    return teacher.join(targets, "token", "left").select(F.col("id").alias("src_id"), "dst_id")


def prefix_map(teacher: DataFrame, student: DataFrame, named: bool = False) -> DataFrame:
    """The longest student token that begins the teacher token.

    Prefixes of a token are looked up, so no pair of unrelated tokens is compared, and a
    prefix that very many tokens share is broadcast or salted. ``named`` adds both tokens
    (``src_token``, ``dst_token``) without another join: a match is a prefix.
    """
    longest = student.agg(F.max(F.length("token")).alias("n")).scalar()
    targets = student.groupBy(F.col("token").alias("prefix")).agg(F.min("id").alias("dst_id"))
    prefixes = teacher.select(
        F.col("id").alias("src_id"),
        F.col("token"),
        F.explode(F.sequence(F.lit(1), F.least(F.length("token"), longest))).alias("size"),
    ).select("src_id", "size", F.expr("left(token, size)").alias("prefix"), *(["token"] if named else []))
    found = lookup(prefixes, targets, "prefix", salt_by=["src_id", "size"])
    hit = F.when(F.col("dst_id").isNotNull(), F.col("size"))
    best = [F.max_by("dst_id", hit).alias("dst_id")]
    if named:
        best += [F.first("token").alias("src_token"), F.max_by("prefix", hit).alias("dst_token")]
    return found.groupBy("src_id").agg(*best)


def invert_last(mapping: DataFrame) -> DataFrame:
    """Student to teacher; of several teacher ids the last, which is the largest."""
    return (
        mapping.filter(F.col("dst_id").isNotNull())
        .groupBy(F.col("dst_id").alias("src_id"))
        .agg(F.max("src_id").alias("dst_id"))
        .select("src_id", "dst_id")
    )


def invert_first_k(mapping: DataFrame, k: int = 1) -> DataFrame:
    """Student to its first k teacher ids, short lists filled with their last id.

    Unmapped teacher ids share the key 0. Many ids may share a key, so the k least are
    kept by a ranked filter before anything is collected.
    """
    keyed = mapping.select(F.coalesce("dst_id", F.lit(0)).alias("stu_id"), F.col("src_id").alias("tea_id"))
    if k == 1:
        return keyed.groupBy("stu_id").agg(F.array(F.min("tea_id")).alias("tea_ids"))
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64("tea_id"), F.lit(64)))
    part = _least_k(salted, ["stu_id", "_salt"], k)
    first = F.slice(F.array_sort(F.flatten(F.collect_list("tea_ids"))), 1, k)
    gathered = part.groupBy("stu_id").agg(first.alias("tea_ids"))
    missing = F.lit(k) - F.size("tea_ids")
    return gathered.select(
        "stu_id",
        F.concat("tea_ids", F.array_repeat(F.element_at("tea_ids", -1), missing)).alias("tea_ids"),
    )


def _least_k(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("tea_id"))
    return (
        df.withColumn("_rank", rank)
        .filter(F.col("_rank") <= k)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("tea_id")).alias("tea_ids"))
    )


def densify(mapping: DataFrame, vocab_size: int | Column, first_id: int = 0) -> DataFrame:
    """One row per id of the vocabulary; 0 where nothing is mapped."""
    spark = mapping.sparkSession
    size = F.lit(vocab_size) if isinstance(vocab_size, int) else vocab_size
    if isinstance(vocab_size, int):
        ids = spark.range(first_id, first_id + vocab_size).select(F.col("id").cast("int").alias("src_id"))
    else:
        ids = spark.range(1).select(
            F.explode(F.sequence(F.lit(first_id), (size + first_id - 1).cast("int"))).alias("src_id")
        )
    return ids.join(mapping, "src_id", "left").select(
        "src_id", F.coalesce("dst_id", F.lit(0)).alias("dst_id")
    )


def map_coverage(mapping: DataFrame) -> DataFrame:
    return mapping.agg(
        F.count("*").alias("ids"),
        F.count("dst_id").alias("mapped"),
        F.avg(F.col("dst_id").isNotNull().cast("int")).alias("coverage"),
    )


def map_ids(df: DataFrame, mapping: DataFrame, column: str, name: str) -> DataFrame:
    """Look up every id of ``column`` in the map."""
    dim = mapping.select(F.col("src_id").alias(column), F.col("dst_id").alias(name))
    return lookup(df, dim, column)
