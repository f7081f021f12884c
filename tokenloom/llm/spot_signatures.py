"""Document fingerprints from spot signatures.

Common words are spread evenly over natural text and rare in menus and lists. Each of them
is an anchor: the anchor and the next content words after it, common words skipped, form a
signature. A document's fingerprint is the set of its signatures. Sets are compared by
Jaccard, and only where their sizes allow the threshold.

All of it is built-in column functions. The content words are one array, and an anchor that
is the k-th common word and the i-th word has i - k content words before it; so every chain
is a slice found by arithmetic, without a search.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import column, fresh, stored

# Common words of English, French, German and Spanish.
COMMON = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their "
    "there they this to was we were what when which who will with would you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour que qui "
    "sa se ses son sont sur un une vous "
    "als am auch auf aus bei das dem den der des die ein eine einem einen einer er es hat ich im ist mit nach nicht "
    "noch nur sich sie sind so und uns unter vom von war wie wir zu zum zur "
    "al como con cuando del donde el ella ellos era es esta este fue ha hay las lo los mas muy ni no nos o para pero "
    "por si sin sobre su sus todo y ya"
).split()
CHAIN = 3
MISSING = "-"
RANGES_PER_PARTITION = 4


def _tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]++", " "))
    return F.when(plain != "", F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def with_signatures(docs: DataFrame, text: Column, name: str, chain: int = CHAIN, common: tuple[str, ...] = tuple(COMMON)) -> DataFrame:
    """Add ``name``: the sorted distinct signatures of ``text`` as 64-bit numbers.

    A text without a common word takes every word as an anchor, and the last chains of a
    text are filled up with a mark, so only a text without any word has no signatures.
    """
    words, content, anchors = fresh(docs.columns, f"{name}_words", f"{name}_content", f"{name}_anchors")
    is_common = lambda w: w.isin(*common)
    step = docs.withColumn(words, _tokens(F.coalesce(text, F.lit(""))))
    step = step.withColumns(
        {
            content: F.filter(words, lambda w: ~is_common(w)),
            anchors: F.filter(F.transform(words, lambda w, i: F.when(is_common(w), i)), lambda i: i.isNotNull()),
        }
    )
    mark = F.lit(MISSING)
    after_common = F.transform(
        anchors,
        lambda i, k: F.xxhash64(F.get(words, i), *(F.coalesce(F.get(content, i - k + c), mark) for c in range(chain))),
    )
    after_all = F.transform(
        words, lambda w, i: F.xxhash64(w, *(F.coalesce(F.get(words, i + 1 + c), mark) for c in range(chain)))
    )
    chosen = F.when(F.size(anchors) > 0, after_common).otherwise(after_all)
    return step.withColumn(name, F.array_sort(F.array_distinct(chosen))).drop(words, content, anchors)


def likeness(left: Column, right: Column, least: float = 0.0) -> Column:
    """Jaccard of two signature sets; 0 without a comparison where the sizes rule out ``least``.

    Two empty sets are alike (1), an empty and a filled one are not (0).
    """
    small, large = F.least(F.size(left), F.size(right)), F.greatest(F.size(left), F.size(right))
    common = F.size(F.array_intersect(left, right))
    return (
        F.when(large == 0, F.lit(1.0))
        .when(small < large * F.lit(least), F.lit(0.0))
        .otherwise(common / (small + large - common))
    )


def fingerprint(signatures: Column) -> Column:
    """The set as text: 16 hexadecimal digits per signature, sorted."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.hex(s), 16, "0")), "")


def with_next(docs: DataFrame, key: str, take: dict[str, str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Add columns of the next row by ``key`` (after the last: the first) to every row.

    ``take`` maps columns to the names under which the next row's values are added;
    ``prepare`` may add columns once the rows are placed. Rows are placed in ranges of the
    key, whose borders are percentiles; within a range a window looks one row ahead, and the
    first row of each range is sent once more to the end of the range before it. So each row
    moves once, and the driver sees one key per range. ``key`` is a number; null comes
    first, and rows of one key follow each other by a hash of their contents.
    """
    spark = docs.sparkSession
    part, tie, far = fresh([*docs.columns, *take.values()], "range", "tie", "far")
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    borders = sorted(set(docs.agg(F.percentile_approx(key, steps).alias("b")).first()["b"] or []))
    place = F.size(F.filter(F.array(*(F.lit(b) for b in borders)), lambda b: b <= F.col(key))) if borders else F.lit(0)
    ranged = docs.withColumn(part, F.when(F.col(key).isNull(), 0).otherwise(place)).withColumn(tie, F.xxhash64(*docs.columns))
    firsts = ranged.groupBy(part).agg(F.min(F.struct(F.isnotnull(key).alias("filled"), F.col(key).alias("key"), F.col(tie).alias("tie"))).alias("first")).orderBy(part).collect()
    kind = dict(docs.dtypes)[key]
    numbers = [row[part] for row in firsts]
    before = dict(zip(numbers, [*numbers[-1:], *numbers[:-1]]))
    heads = spark.createDataFrame([(row["first"]["key"], row["first"]["tie"], before[row[part]]) for row in firsts], f"head_key {kind}, head_tie long, sent_to int")
    same = ranged[key].eqNullSafe(heads["head_key"]) & (ranged[tie] == heads["head_tie"])
    ends = ranged.join(F.broadcast(heads), same).withColumn(part, F.col("sent_to")).drop("head_key", "head_tie", "sent_to").dropDuplicates([part, tie])
    both = ranged.withColumn(far, F.lit(0)).unionByName(ends.withColumn(far, F.lit(1)))
    placed = prepare(both.repartition(part).sortWithinPartitions(part, far, key, tie))
    ahead = Window.partitionBy(part).orderBy(far, key, tie)
    return placed.withColumns({name: F.lead(c).over(ahead) for c, name in take.items()}).where(F.col(far) == 0).drop(part, tie, far)


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_chars, edited, signatures, edited_signatures, near_edited, near_next)``.

    ``edited`` is the text with its last quarter replaced by as much of the start of the
    next document. A null text counts as empty. Repeated rows follow each other, so each but
    the last is its own next document; a single row is its own next document too.
    """
    body = docs.select(column(docs, key).alias(key), F.coalesce(column(docs, text), F.lit("")).alias("body"))
    placed = with_next(body, key, {"body": "next_body", "signatures": "next_signatures"}, lambda df: with_signatures(df, F.col("body"), "signatures"))
    edited = placed.withColumn("n_chars", F.length("body").cast("long")).withColumn(
        "edited",
        F.expr("concat(left(body, int(n_chars - n_chars div 4)), left(next_body, int(n_chars div 4)))"),
    )
    both = with_signatures(edited, F.col("edited"), "edited_signatures")
    own = F.col("signatures")
    return both.select(
        key,
        "n_chars",
        "edited",
        "signatures",
        "edited_signatures",
        likeness(own, F.col("edited_signatures")).alias("near_edited"),
        likeness(own, F.col("next_signatures")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``: pairs of classes with a likeness of ``least`` or more, and their members.

    Documents with equal fingerprints are one class: ``members`` is ``(key, class)``. Classes
    are partitioned by set size in steps of ``1 / least``: a set can only match sets of its
    own step and the two next to it. Of each set only the rarest signatures are looked up,
    as many as a match must share one of; so common signatures join nothing. ``pairs`` is
    ``(left, right, near)`` with ``left < right``. Texts without words are in no pair.
    """
    body = docs.select(column(docs, key).alias(key), F.coalesce(column(docs, text), F.lit("")).alias("body"))
    signed = with_signatures(body, F.col("body"), "signatures").select(key, "signatures", F.sha2(fingerprint(F.col("signatures")), 256).alias("class"))
    signed = stored(signed.where(F.size("signatures") > 0), "signatures")
    classes = signed.dropDuplicates(["class"]).select("class", "signatures", F.size("signatures").alias("n"))
    each = classes.select("class", "n", F.explode("signatures").alias("signature"))
    counts = each.groupBy("signature").agg(F.count("*").alias("uses"))
    ordered = each.join(counts, "signature").groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("uses", "signature"))).alias("by_use"))
    keys = F.slice("by_use", 1, (F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)) + 1).cast("int"))
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.0 / least)))
    found = ordered.select("class", "n", step.alias("step"), F.explode(keys).alias("at")).select("class", "n", "step", "at.signature")
    right = found.select(F.col("class").alias("right"), F.col("n").alias("right_n"), "signature", F.explode(F.array(*(F.col("step") + d for d in (-1, 0, 1)))).alias("step"))
    fits = F.least("n", "right_n") >= F.greatest("n", "right_n") * F.lit(least) - F.lit(1e-9)
    pairs = found.join(right, ["signature", "step"]).where((F.col("class") < F.col("right")) & fits).select(F.col("class").alias("left"), "right").distinct()
    sets = classes.select("class", "signatures")
    near = likeness(F.col("left_set"), F.col("right_set"))
    checked = (
        pairs.join(sets.toDF("left", "left_set"), "left").join(sets.toDF("right", "right_set"), "right")
        .select("left", "right", near.alias("near")).where(F.col("near") >= least)
    )
    return checked, signed.select(key, "class")
