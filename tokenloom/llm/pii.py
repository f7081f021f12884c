"""Personal data: patterns propose spans, checksums confirm them, nearby words score them.

All of it is built-in column functions. A pattern gives its matches and, as a separator, the
gaps between them; the running sum of both lengths is the place of every match, in code
points. The text around a match is the end of one gap and the beginning of the next.

The patterns are written so that no text makes them slow: runs are taken whole
(possessive), and a match starts where a run starts or where the last match ended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import fresh

NEAR = 40  # code points before and after a match that are searched for context words
BLOCK = 64  # matches whose places are summed together


@dataclass(frozen=True)
class Kind:
    """``valid``, ``score`` and ``bonus`` judge one match; ``base`` kinds are never dropped for their score."""

    name: str
    pattern: str
    needs: str  # SQL over the text that is cheap and true wherever the pattern matches
    valid: str  # SQL over the matched string m
    score: float
    words: str  # context words, as a pattern over lower-case text
    base: bool = True


LOCAL = "A-Za-z0-9._%+-"
DIGITS = "regexp_replace(m, '[^0-9]', '')"
COMPACT = "replace(m, ' ', '')"
LUHN = (
    "aggregate(sequence(1, length({d})), 0, (a, i) -> a + if(i % 2 = 0, "
    "element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), int(substr({d}, -i, 1)) + 1), int(substr({d}, -i, 1)))) % 10 = 0"
).format(d=DIGITS)
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
# Letters count as 10 to 35; the first four characters are moved to the end.
TURNED = f"concat(substr({COMPACT}, 5), substr({COMPACT}, 1, 4))"
MOD_97 = (
    f"aggregate(sequence(1, length({COMPACT})), 0, (a, i) -> if(substr({TURNED}, i, 1) < 'A', "
    f"a * 10 + int(substr({TURNED}, i, 1)), a * 100 + ascii(substr({TURNED}, i, 1)) - 55) % 97) = 1"
)

KINDS = (
    Kind(
        "email",
        rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "contains(t, '@')",
        "true",
        0.8,
        "mail|contact|write|address",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        "digits",
        rf"m rlike '^{OCTET}([.]{OCTET}){{3}}$'",
        0.5,
        "ip|host|server|addr|login|from",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        "digits",
        f"length({DIGITS}) between 12 and 19 and {LUHN}",
        0.7,
        "card|visa|master|credit|debit|payment",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "digits and contains(t, '+')",
        f"length({DIGITS}) between 9 and 15",
        0.5,
        "phone|tel|call|mobile|fax",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "digits",
        f"length({COMPACT}) between 15 and 34 and {MOD_97}",
        0.9,
        "iban|account|bank|konto|cuenta|compte",
        base=False,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        "digits",
        "true",
        0.3,
        "ssn|social|security",
        base=False,
    ),
)
CONTEXT_BONUS = 0.3
LEAST_SCORE = 0.5


def find_pii(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS, least: float = LEAST_SCORE) -> DataFrame:
    """Add ``spans``: array of ``(start, end, kind, text, score)`` by start, then kind as listed.

    Places are code points of the whole text, the end exclusive. Matches of one kind never
    overlap; those that fail their check are dropped and not tried again. The score is that
    of the kind, plus 0.3 where a context word stands within 40 code points. Matches of
    kinds that are not ``base`` need ``least``. A null or empty text has no spans; repeated
    rows have equal spans. Other columns are kept; a clashing name gets an underscore.
    No row moves.
    """
    (spans,) = fresh(docs.columns, "spans")
    body = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    body = body.withColumn("digits", F.expr("t rlike '[0-9]'"))
    names = [f"{part}{k}" for k in range(len(kinds)) for part in ("m", "g")]
    none = "array_remove(array(''), '')"
    body = body.withColumns(
        {f"m{k}": F.when(F.expr(kind.needs), F.regexp_extract_all("t", F.lit(kind.pattern), F.lit(0))).otherwise(F.expr(none)) for k, kind in enumerate(kinds)}
    )
    body = body.withColumns(
        {f"g{k}": F.when(F.size(f"m{k}") > 0, F.split("t", kind.pattern, -1)).otherwise(F.expr(none)) for k, kind in enumerate(kinds)}
    ).select("row", *names)
    for step in (_blocks, _sums, _starts):
        body = body.withColumns({f"{name}{k}": F.expr(sql.format(k=k)) for k in range(len(kinds)) for name, sql in step.items()})
    found = F.concat(*(F.expr(_spans_sql(k, kind, least)) for k, kind in enumerate(kinds)))
    labels = F.array(*(F.lit(kind.name) for kind in kinds))
    listed = F.transform(
        F.array_sort(found),
        lambda s: F.struct(s["start"], s["end"], F.get(labels, s["rank"]).alias("kind"), s["text"], s["score"]),
    )
    return body.select("row.*", listed.alias(spans))


# The length of each match with the gap before it; their running sums, in blocks so that the
# work stays near the number of matches; and the place of each match.
_blocks = {
    "b": "transform(sequence(0, greatest(size(m{k}) - 1, 0) div " + str(BLOCK) + "), b -> zip_with("
    "slice(g{k}, b * {n} + 1, least({n}, greatest(size(m{k}) - b * {n}, 0))), slice(m{k}, b * {n} + 1, {n}), "
    "(g, m) -> length(g) + length(m)))".replace("{n}", str(BLOCK)),
}
_sums = {"s": "transform(b{k}, b -> aggregate(b, array(0), (a, v) -> concat(a, array(element_at(a, -1) + v))))"}
_starts = {
    "p": "flatten(zip_with(s{k}, slice(aggregate(s{k}, array(0), (a, p) -> concat(a, array(element_at(a, -1) + element_at(p, -1)))),"
    " 1, size(s{k})), (p, o) -> transform(slice(p, 1, size(p) - 1), q -> q + o)))",
}


def _spans_sql(k: int, kind: Kind, least: float) -> str:
    """The confirmed spans of one kind."""
    near = f"lower(concat(right(g{k}[i], {NEAR}), ' ', left(g{k}[i + 1], {NEAR}))) rlike '{kind.words}'"
    span = (
        f"named_struct('start', p{k}[i] + length(g{k}[i]), 'rank', {k}, 'end', p{k}[i] + length(g{k}[i]) + length(m), "
        f"'text', m, 'score', {kind.score}D + if({near}, {CONTEXT_BONUS}D, 0D), 'valid', {kind.valid})"
    )
    kept = "s.valid" if kind.base else f"s.valid and s.score >= {least}D"
    return f"filter(transform(m{k}, (m, i) -> {span}), s -> {kept})"


def span_list(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Spans as ``kind:start:end``, comma-joined; of some kinds or of all."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
