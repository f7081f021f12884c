"""Chat formatting by columnar byte assembly.

Every turn becomes one piece of text, ``<|im_start|>role``, a line break, the text,
``<|im_end|>`` and a line break. A conversation is its pieces in turn order. Nothing is
joined row by row: for a batch of turns the lengths of all segments give cumulative offsets,
and all bytes are copied into one buffer, which becomes the Arrow column as it is.

Control strings cannot be forged. Between ``<`` and ``|`` every run of backslashes gets one
more, so that ``<|`` never stands in a text; taking one away restores the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import fresh

START, END, BREAK = b"<|im_start|>", b"<|im_end|>\n", b"\n"
# Bytes assembled at once; larger batches are cut between rows.
ASSEMBLED_BYTES = 8 * 1024 * 1024


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<\\(\\*)\|", r"<\1|")


def escape_role(roles: pa.Array) -> pa.Array:
    """Roles stand on a line of their own, so line breaks are written as ``\\n`` too."""
    return pc.replace_substring(pc.replace_substring(escape(roles), "\\", "\\\\"), "\n", "\\n")


def unescape_role(roles: pa.Array) -> pa.Array:
    plain = [re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", r) for r in roles.to_pylist()]
    return unescape(pa.array(plain, pa.string()))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of a string column as one byte array, their starts and their lengths."""
    large = column.cast(pa.large_binary())
    _, offsets, data = large.buffers()
    ends = np.frombuffer(offsets, np.int64)[large.offset : large.offset + len(large) + 1]
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values, ends[:-1], np.diff(ends)


def assemble(segments: list[bytes | pa.Array], rows: int) -> pa.Array:
    """Join the segments of every row. A fixed segment repeats in each row.

    The place of row ``r``, segment ``s`` is the cumulative length of all segments before
    it. Each segment column is then scattered to its places in one copy.
    """
    parts = [(np.frombuffer(s, np.uint8), None, np.full(rows, len(s), np.int64)) if isinstance(s, bytes) else _bytes(s) for s in segments]
    lengths = np.stack([p[2] for p in parts], axis=1)
    places = np.zeros(lengths.size + 1, np.int64)
    np.cumsum(lengths.ravel(), out=places[1:])
    out = np.empty(int(places[-1]), np.uint8)
    starts = places[:-1].reshape(rows, len(parts))
    for s, (values, begins, sizes) in enumerate(parts):
        if begins is None:
            out[(starts[:, s, None] + np.arange(len(values))).ravel()] = np.tile(values, rows)
            continue
        total = int(sizes.sum())
        inside = np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(starts[:, s], sizes) + inside] = values[np.repeat(begins, sizes) + inside]
    ends = places[:: len(parts)].copy()
    return pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(ends), pa.py_buffer(out)])


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``ASSEMBLED_BYTES`` of text, one row at least."""
    ends = np.cumsum(_bytes(column)[2])
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + ASSEMBLED_BYTES, side="right")))
        yield at, to - at
        at = to


def format_turns(turns: DataFrame, role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """Add ``piece``, ``loss_start`` and ``loss_chars`` to every turn.

    ``piece`` is the formatted turn; a conversation is its pieces one after the other.
    ``loss_start`` and ``loss_chars`` are the code points of the piece that a model is
    trained on: the whole escaped text of a turn whose role is ``learn``, else none.
    A null role or text counts as empty. Each row is formatted on its own, so nothing is
    shuffled or grouped; repeated rows give repeated pieces; an empty table gives an empty
    table. Other columns are kept; a clashing name gets an underscore.
    """
    piece, start, chars, made = fresh(turns.columns, "piece", "loss_start", "loss_chars", "made")

    def formatted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for roles, texts in batches:
            done = []
            for at, rows in _slices(texts):
                who, said = roles.slice(at, rows), escape(texts.slice(at, rows))
                head = escape_role(who)
                pieces = assemble([START, head, BREAK, said, END], rows)
                learnt = pc.equal(who, learn)
                begins = pc.add(pc.cast(pc.utf8_length(head), pa.int64()), len(START) + len(BREAK))
                sizes = pc.if_else(learnt, pc.cast(pc.utf8_length(said), pa.int64()), 0)
                done.append(pa.StructArray.from_arrays([pieces.cast(pa.string()), begins, sizes], ["piece", "start", "chars"]))
            yield pa.concat_arrays(done) if done else pa.array([], _MADE)

    turn = F.arrow_udf(formatted, "piece string, start long, chars long", F.ArrowUDFType.SCALAR_ITER)
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    whole = turns.withColumn(made, turn(*filled))
    return whole.withColumns(
        {piece: F.col(made)["piece"], start: F.col(made)["start"], chars: F.col(made)["chars"]}
    ).drop(made)


_MADE = pa.struct([("piece", pa.string()), ("start", pa.int64()), ("chars", pa.int64())])


def read_back(pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Roles and texts of formatted turns."""
    body = pc.utf8_slice_codeunits(pieces, len(START), -len(END))
    at = pc.find_substring(body, "\n")
    heads, texts = [], []
    for value, cut in zip(body.to_pylist(), at.to_pylist()):
        heads.append(value[: _chars_before(value, cut)])
        texts.append(value[len(heads[-1]) + 1 :])
    return unescape_role(pa.array(heads, pa.string())), unescape(pa.array(texts, pa.string()))


def _chars_before(value: str, byte: int) -> int:
    return byte if value.isascii() else value.index("\n")


def digest_conversations(formatted: DataFrame, conv: str = "conv_id", order: tuple[str, ...] = ("turn", "piece")) -> DataFrame:
    """Read formatted turns back and digest every conversation.

    Returns ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    Turns of a conversation are sorted and streamed through running digests, so no
    conversation is ever held whole, however long it is. Equal turn numbers are taken in
    the order of their pieces. A null ``conv_id`` is a conversation of its own.
    """
    placed = (
        formatted.select(F.col(conv).alias("conv_id"), *order, "loss_start", "loss_chars", *([] if "piece" in order else ["piece"]))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", *order)
        .select("conv_id", "piece", "loss_start", "loss_chars")
    )
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split(" ")[0] for part in schema.split(", ")]
        open_id: object = None
        state: list | None = None

        def closed() -> list:
            return [open_id, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for batch in batches:
            rows = []
            pieces = batch.column("piece")
            roles, texts = read_back(pieces)
            sizes = pc.utf8_length(pieces).to_pylist()
            each = zip(
                batch.column("conv_id").to_pylist(), pieces.to_pylist(), roles.to_pylist(), texts.to_pylist(), sizes,
                batch.column("loss_start").to_pylist(), batch.column("loss_chars").to_pylist(),
            )
            for own, piece, who, said, size, at, chars in each:
                if state is None or own != open_id:
                    if state is not None:
                        rows.append(closed())
                    open_id, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{who}\n{said}\n".encode())
                if chars:
                    learnt = unescape(pa.array([piece[at : at + chars]]))[0].as_py()
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += size
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in rows], schema=_DIGEST)
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, closed()))], schema=_DIGEST)

    return placed.mapInArrow(digests, schema)


_DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)
