"""Expressions over texts and tokens."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.constants import (
    DEFAULT_STUDENT_MARKER,
    DEFAULT_TEACHER_MARKER,
    SPECIAL_PAIRS,
    WORD_MARKERS,
)

WORD_BREAK = r"[ \t\n\r\f\x0B]+"


def words(text: Column, lower: bool = True) -> Column:
    """Whitespace tokens of a text; empty pieces dropped."""
    pieces = F.split(F.lower(text) if lower else text, WORD_BREAK)
    return F.filter(pieces, lambda w: w != "")


def word_marker(family: str | None, teacher: bool) -> str:
    """The word marker of a tokenizer family; unknown families have one default per side."""
    return WORD_MARKERS.get(family or "", DEFAULT_TEACHER_MARKER if teacher else DEFAULT_STUDENT_MARKER)


def normalize_token(token: Column, marker: str, strip: str = "both") -> Column:
    """Strip the word marker and/or spaces: ``both``, ``spaces`` or ``marker``."""
    if strip not in ("both", "spaces", "marker"):
        raise ValueError(f"unknown strip mode {strip!r}")
    if strip != "spaces":
        token = F.replace(token, F.lit(marker), F.lit(""))
    if strip != "marker":
        token = F.replace(token, F.lit(" "), F.lit(""))
    return token


def special_equivalent(a: Column, b: Column, pairs: Mapping[str, str] = SPECIAL_PAIRS) -> Column:
    """One side is any key and the other any value of the pair map."""
    keys, values = list(pairs.keys()), sorted(set(pairs.values()))
    return (a.isin(keys) & b.isin(values)) | (b.isin(keys) & a.isin(values))


def edit_cost(
    a: Column,
    b: Column,
    marker_a: str = DEFAULT_TEACHER_MARKER,
    marker_b: str = DEFAULT_STUDENT_MARKER,
    strip: str = "both",
    pairs: Mapping[str, str] = SPECIAL_PAIRS,
) -> Column:
    """Levenshtein distance of normalised tokens, 0 for equivalent special tokens."""
    distance = F.levenshtein(normalize_token(a, marker_a, strip), normalize_token(b, marker_b, strip))
    return F.when(special_equivalent(a, b, pairs), F.lit(0)).otherwise(distance)


def edit_distance_norm(
    a: Column,
    b: Column,
    marker_a: str = DEFAULT_TEACHER_MARKER,
    marker_b: str = DEFAULT_STUDENT_MARKER,
    strip: str = "both",
    pairs: Mapping[str, str] = SPECIAL_PAIRS,
) -> Column:
    """Edit distance over the summed lengths; two empty tokens are at distance 0."""
    na, nb = normalize_token(a, marker_a, strip), normalize_token(b, marker_b, strip)
    ratio = F.try_divide(F.levenshtein(na, nb).cast("double"), (F.length(na) + F.length(nb)).cast("double"))
    return F.when(special_equivalent(a, b, pairs), F.lit(0.0)).otherwise(F.coalesce(ratio, F.lit(0.0)))


def unit_hash(*parts: Column) -> Column:
    """A reproducible number in [0, 1) from the md5 of the joined parts."""
    digest = F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
