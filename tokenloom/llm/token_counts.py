"""Exact token counts of every prefix of a text by dynamic programming.

A byte-pair encoding has a useful property: the encoding of a prefix ends in one token
``t``, and what stands before ``t`` is the encoding of the shorter prefix. Which token that
is can be told from the last token of the shorter prefix alone: both must stay apart when
they are encoded together. So one pass gives the count at every prefix::

    count[k] = count[k - len(t)] + 1

Texts are cut into words first (the encoder never merges across them), so the pass runs
once per distinct word. Questions about a prefix are then answered from the stored counts.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import fresh

# The white space of byte-level vocabularies, and how they split text into words.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^SPACE\p{L}\p{N}]+|[SPACE]+(?![^SPACE])|[SPACE]+"
).replace("SPACE", SPACE)

# Latin, Greek, Cyrillic, punctuation, kana, common Han and Hangul. Elsewhere the letter
# classes of two Unicode versions may differ; such texts are split by the tokenizer library.
SETTLED = r"\x00-\u0523\u2000-\u2064\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"

# Words kept in a task's memory; beyond that the table starts anew. Results do not depend on it.
KEPT_WORDS = 1_000_000
# Characters of texts whose words are looked up together.
GATHERED_CHARS = 4_000_000


class PrefixCounter:
    """Counts for one byte-level vocabulary file (``.json`` of the tokenizers library)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        merges = spec["model"]["merges"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.made_by: dict[str, tuple[str, str]] = {}
        for pair in pairs:
            self.made_by.setdefault(pair[0] + pair[1], pair)
        self.edges: tuple[dict, dict] = ({}, {})
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.alphabet = byte_letters()
        self.tokens = set(spec["model"]["vocab"]) - set(self.specials)
        self.longest = max(map(len, self.tokens))
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.words = regex.compile(WORDS)
        self.unsettled = regex.compile(f"[^{SETTLED}]")
        self.space = regex.compile(f"[{SPACE}]")
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.totals: dict[str, int] = {}
        self.follows: dict[str, dict] = {}

    def edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The parts of ``token`` that touch its left (0) or right (1) end while it is being
        merged, each with the rank of the merge that ends the part."""
        known = self.edges[side].get(token)
        if known is None:
            known, part, until = [], token, float("inf")
            while True:
                known.append((part, until))
                made = self.made_by.get(part)
                if made is None:
                    break
                until, part = self.rank[made], made[side]
            self.edges[side][token] = known
        return known

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether ``left`` and ``right``, encoded together, stay these two tokens.

        They do not if a merge across their border comes before the merges that take its two
        parts away; of equal merges the left one comes first.
        """
        rank, right_parts = self.rank, self.edge(right, 0)
        for part, until in self.edge(left, 1):
            for other, other_until in right_parts:
                at = rank.get((part, other))
                if at is not None and at < until and at <= other_until:
                    return False
        return True

    def extend(self, word: str, counts: list[int], ends: list[dict[str, bool]], size: int) -> None:
        """Fill the table of ``word`` beyond its first ``size`` bytes, which are known.

        ``ends[k]`` belongs to the last token of the first ``k`` bytes: which tokens may follow it.
        """
        del counts[size + 1 :], ends[size + 1 :]
        tokens, follows, longest = self.tokens, self.follows, self.longest
        for end in range(size + 1, len(word) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = word[start:end]
                if token not in tokens:
                    continue
                if start:
                    known = ends[start].get(token)
                    if known is None:
                        left = ends[start][""]
                        known = ends[start][token] = self.stay_apart(left, token)
                    if not known:
                        continue
                counts.append(counts[start] + 1)
                after = follows.get(token)
                if after is None:
                    after = follows[token] = {"": token}
                ends.append(after)
                break

    def byte_counts(self, word: str) -> list[int]:
        """``counts[k]``: the tokens of the first ``k`` bytes; ``word`` in byte letters."""
        counts: list[int] = [0]
        self.extend(word, counts, [{}], 0)
        return counts

    def learn(self, words: set[str]) -> None:
        """Add the totals of new words. In sorted order, words share the tables of their common prefixes."""
        counts: list[int] = [0]
        ends: list[dict] = [{}]
        before = ""
        for letters, word in sorted((self.letters(w), w) for w in words):
            shared, most = 0, min(len(before), len(letters))
            while shared < most and before[shared] == letters[shared]:
                shared += 1
            self.extend(letters, counts, ends, shared)
            self.totals[word] = counts[-1]
            before = letters

    def letters(self, text: str) -> str:
        return text.encode("utf-8").decode("latin-1").translate(self.alphabet)

    def total(self, word: str) -> int:
        known = self.totals.get(word)
        return self.byte_counts(self.letters(word))[-1] if known is None else known

    def split(self, text: str) -> list[str]:
        if self.unsettled.search(text) is None:
            return self.words.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        return self.count_all([text])[0]

    def count_all(self, texts: Iterable[str]) -> list[int]:
        """Tokens of whole texts. Words are gathered over some texts, then new ones are learnt."""
        out: list[int] = []
        waiting: list[tuple[list[str], int]] = []
        chars = 0

        def settle() -> None:
            new = set().union(*(words for words, _ in waiting)).difference(self.totals)
            self.learn(new)
            look = self.totals.__getitem__
            out.extend(specials + sum(map(look, words)) for words, specials in waiting)
            for word in [w for w in new if len(w) > 64]:
                del self.totals[word]
            if len(self.totals) > KEPT_WORDS:
                self.totals.clear()
                self.follows.clear()
            waiting.clear()

        for text in texts:
            words, specials = [], 0
            for piece, is_special in self.pieces(text):
                if is_special:
                    specials += 1
                else:
                    words += self.split(piece)
            waiting.append((words, specials))
            chars += len(text)
            if chars >= GATHERED_CHARS:
                settle()
                chars = 0
        settle()
        return out

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special strings, and those strings."""
        if self.special is None:
            yield text, False
            return
        at = 0
        for match in self.special.finditer(text):
            if match.start() > at:
                yield text[at : match.start()], False
            yield match.group(), True
            at = match.end()
        if at < len(text):
            yield text[at:], False

    def prefix_counts(self, text: str) -> list[int]:
        """``counts[i]``: the tokens of the first ``i`` characters, for every ``i``.

        A prefix that ends in white space ends in one word, its whole run of white space.
        Otherwise it ends inside one word of the text, and all words before that one are
        words of the prefix too.
        """
        counts, base, open_from = [0], 0, 0
        for plain, is_special in self.pieces(text):
            if is_special:
                # Until its last character the string is ordinary text after what precedes it.
                tail = text[open_from : len(counts) - 1]
                before = base - self.count(tail)
                counts.extend(before + self.count(tail + plain[:k]) for k in range(1, len(plain)))
                base += 1
                counts.append(base)
                open_from = len(counts) - 1
                continue
            start = len(counts) - 1
            words = self.split(plain)
            at, run, run_base = 0, -1, 0
            for word in words:
                if self.space.match(word[-1]):
                    if run < 0:
                        run, run_base = at, base
                    upto = self.byte_counts(self.letters(plain[run : at + len(word)]))
                    sizes = _byte_ends(plain[run : at + len(word)])
                    counts.extend(run_base + upto[sizes[k]] for k in range(at - run + 1, at - run + len(word) + 1))
                else:
                    led = run >= 0 and word[0] == " "
                    if word[0] == "'" and len(word) > 1:
                        counts.extend(base + self.count(word[:k]) for k in range(1, len(word) + 1))
                    else:
                        upto, sizes = self.byte_counts(self.letters(word)), _byte_ends(word)
                        counts.extend(base + upto[sizes[k]] for k in range(1, len(word) + 1))
                    if led:  # the leading space still belonged to the run when the prefix ended there
                        counts[start + at + 1] = run_base + self.total(plain[run : at + 1])
                    open_from = start + (run if run >= 0 else at)
                    run = -1
                base += self.total(word)
                at += len(word)
            if run >= 0:
                open_from = start + run
        return counts


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write byte 0 to 255 as a printable letter each."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def _byte_ends(text: str) -> list[int]:
    ends = [0]
    for char in text:
        ends.append(ends[-1] + len(char.encode("utf-8")))
    return ends


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", prefixes: bool = False) -> DataFrame:
    """Add ``n_tokens``, and with ``prefixes`` also ``prefix_tokens``, to every row.

    ``tokenizer`` is the path of a byte-level vocabulary file that every executor has.
    ``prefix_tokens[i]`` is the exact count of the first ``i`` code points, from 0 to the
    whole text: a long array, four bytes a character. A null text counts as empty: 0 tokens,
    prefixes ``[0]``. Other columns are kept; a clashing name gets an underscore. Rows do
    not move, and a task holds one batch of texts.
    """
    total, steps = fresh(docs.columns, "n_tokens", "prefix_tokens")

    def totals(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = PrefixCounter(tokenizer)
        gc.disable()  # millions of live words and no cycles: collections only cost time
        for texts in batches:
            yield pa.array(counter.count_all(text.as_py() for text in texts), pa.int64())
        gc.enable()

    def tables(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = PrefixCounter(tokenizer)
        for texts in batches:
            yield pa.array([counter.prefix_counts(text.as_py()) for text in texts], pa.list_(pa.int32()))

    whole = F.coalesce(F.col(text), F.lit(""))
    if not prefixes:
        return docs.withColumn(total, F.arrow_udf(totals, "long", F.ArrowUDFType.SCALAR_ITER)(whole))
    counted = docs.withColumn(steps, F.arrow_udf(tables, "array<int>", F.ArrowUDFType.SCALAR_ITER)(whole))
    return counted.withColumn(total, F.element_at(steps, -1).cast("long"))


def tokens_before(prefix_tokens: Column, chars: Column | int) -> Column:
    """The tokens of the first ``chars`` code points; beyond the end, those of all."""
    at = F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(prefix_tokens) - 1)
    return F.get(prefix_tokens, at)


def longest_within(prefix_tokens: Column, budget: Column | int) -> Column:
    """The code points of the longest prefix that has at most ``budget`` tokens.

    Counts may fall when a character is added, so the last fitting prefix is taken.
    """
    limit = F.lit(budget) if isinstance(budget, int) else budget
    places = F.transform(prefix_tokens, lambda n, i: F.when(n <= limit, i))
    return F.array_max(places)
