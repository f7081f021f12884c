"""Records of any shape to labelled token rows of both sides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.operators import labels as L
from tokenloom.operators import tokenize
from tokenloom.operators.templates import prompt_and_text, record_shape, teacher_text, teacher_text_append
from tokenloom.operators.tokenize import tokenize_words, word_total


@dataclass(frozen=True)
class Coder:
    """A sub-word tokenizer: ``code`` gives ids and starts, ``chars`` how long a text is in its characters."""

    code: Callable[[DataFrame, str, dict[str, Column], list[str], int, dict[str, Column]], DataFrame]
    chars: Callable[[Column, list[str]], Column]


def piece_coder(pieces: DataFrame) -> Coder:
    """Greedy longest match over the pieces ``(token, id)``."""
    return Coder(
        lambda df, key, texts, ends, limit, carry: tokenize.tokenize_pieces(df, key, texts, pieces, ends, limit=limit, carry=carry),
        tokenize.chars_before,
    )


def outside_coder(make_encoder: Callable[[], tokenize.SpanEncoder]) -> Coder:
    """An outside tokenizer with offsets; it knows its end markers itself."""
    return Coder(
        lambda df, key, texts, ends, limit, carry: tokenize.tokenize_spans(df, key, texts, make_encoder, limit, carry),
        lambda text, ends: F.length(text),
    )


def coded_sides(
    texts: DataFrame, key: str, wanted: dict[str, Column], prompt: Column, ends: list[str], block_size: int, coder: Coder, border: str
) -> DataFrame:
    """``(key, <name>, <name>_prompt ..)``: ids of each text and how many of them are masked.

    ``count``: as many as the prompt has tokens when it is tokenized alone. Where a token
    reaches across the border, or the prompt's last word is cut otherwise than within the text,
    this is not where the response begins. ``offset``: the tokens that begin before the end of
    the prompt; a token across the border begins in the prompt and is masked.
    """
    coded = both_borders(texts, key, wanted, prompt, ends, block_size, coder, (border,))
    return coded.select(key, *wanted, *[F.col(f"{name}_{border}").alias(f"{name}_prompt") for name in wanted])


def both_borders(
    texts: DataFrame, key: str, wanted: dict[str, Column], prompt: Column, ends: list[str], block_size: int, coder: Coder,
    borders: tuple[str, ...] = ("count", "offset"),
) -> DataFrame:
    """``(key, <name>, <name>_count, <name>_offset ..)``: the masked tokens by each border; a text is coded once for all."""
    for border in borders:
        if border not in ("count", "offset"):
            raise ValueError(f"unknown prompt border {border!r}")
    alone = {"_alone": prompt} if "count" in borders else {}
    coded = coder.code(texts, key, {**wanted, **alone}, ends, block_size, {"_chars": coder.chars(prompt, ends)})

    def masked(name: str, border: str) -> Column:
        return F.size("_alone") if border == "count" else F.size(F.filter(f"{name}_starts", lambda s: s < F.col("_chars")))

    return coded.select(key, *wanted, *[masked(name, b).alias(f"{name}_{b}") for name in wanted for b in borders])


def label_rows(tokens: DataFrame, key: str, side: str | Column, block_size: int, masked: bool, labelled: bool = True) -> DataFrame:
    """``(key, side, ids, mask, labels)`` from ``text`` ids and the length of the prompt, ``prompt_size``.

    Prompt and text are truncated independently; ``labels`` is NULL for a side that gets
    its labels later (a masked-LM student).
    """
    ids = L.truncate(F.col("text"), block_size)
    prompt = F.least(F.col("prompt_size"), F.lit(block_size)) if masked else F.lit(0)
    return tokens.select(
        key,
        (F.lit(side) if isinstance(side, str) else side).alias("side"),
        ids.alias("ids"),
        L.attention_mask(ids).alias("mask"),
        (L.mask_prompt_labels(ids, prompt) if labelled else F.lit(None).cast("array<int>")).alias("labels"),
    )


def prepare_student(
    records: DataFrame, key: str, vocab: DataFrame | Coder, eos: str, block_size: int, is_mlm: bool = False, border: str = "count"
) -> DataFrame:
    """The student side of a record table, whatever its shape.

    ``vocab`` is a vocabulary of whole words, or a sub-word tokenizer (``piece_coder``,
    ``outside_coder``). For the latter ``border`` says how the prompt's end is found
    (``coded_sides``); words never reach across it, so for them both ways are one.
    """
    shape = record_shape([c for c in records.columns if c != key])
    texts = prompt_and_text(records, key, eos, is_mlm)
    prompt = F.coalesce("prompt", F.lit(""))
    if isinstance(vocab, Coder):
        coded = coded_sides(texts, key, {"text": F.col("text")}, prompt, [eos], block_size, vocab, border)
        tokens = coded.withColumnRenamed("text_prompt", "prompt_size")
    else:
        size = {"prompt_size": word_total(prompt, [eos])}
        tokens = tokenize_words(texts, key, {"text": F.col("text")}, vocab, [eos], limit=block_size, carry=size)
    return label_rows(tokens, key, "student", block_size, shape != "plain", labelled=not is_mlm)


def prepare_teachers(
    records: DataFrame,
    key: str,
    vocab: DataFrame | Coder,
    student_eos: str,
    teacher_ends: list[str],
    block_size: int,
    method: str = "append",
    border: str = "count",
) -> DataFrame:
    """The teacher sides, in long form.

    ``append`` (one teacher): its end marker follows the raw text, for every shape, and
    only prefix records have their prompt masked. ``replace``: every student end marker in
    the student's text is replaced, teacher after teacher; only prefix records have teacher
    rows at all. ``vocab`` and ``border`` as for the student.
    """
    shape = record_shape([c for c in records.columns if c != key])
    texts = prompt_and_text(records, key, student_eos)
    if method == "append":
        sides = [teacher_text_append(F.col("body"), teacher_ends[0])]
    elif method == "replace":
        sides = teacher_text(F.col("text"), student_eos, teacher_ends)
        if shape != "prefix":
            texts = texts.filter(F.lit(False))
    else:
        raise ValueError(f"unknown teacher text method {method!r}")
    wanted = {f"text{i}": text for i, text in enumerate(sides)}
    specials = sorted({student_eos, *teacher_ends})
    prompt = F.coalesce("prompt", F.lit(""))
    if isinstance(vocab, Coder):
        tokens = coded_sides(texts, key, wanted, prompt, specials, block_size, vocab, border)
    else:
        sizes = {f"{name}_prompt": word_total(prompt, specials) for name in wanted}
        tokens = tokenize_words(texts, key, wanted, vocab, specials, limit=block_size, carry=sizes)
    listed = F.array(
        *[
            F.struct(F.lit(f"teacher{i}").alias("side"), F.col(name).alias("text"), F.col(f"{name}_prompt").alias("prompt_size"))
            for i, name in enumerate(wanted)
        ]
    )
    return label_rows(tokens.select(key, F.inline(listed)), key, F.col("side"), block_size, masked=shape == "prefix")
