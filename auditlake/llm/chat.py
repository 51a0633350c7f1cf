"""Chat formatting by columnar byte assembly, with a reversible escape and a loss mask.

A turn becomes  <|im_start|>ROLE\\n TEXT <|im_end|>\\n  (without the spaces).  Control strings inside roles and texts are
escaped by one more backslash after their first character, so that only the template's own strings are control strings,
and removing one backslash gives the text back.

Rows are dealt by conversation and sorted by turn; a batch of turns is assembled by numpy: lengths of the segments, their
offsets by a running sum, and scatter indices by which headers and contents are copied into one preallocated Arrow buffer.
Batches are cut by bytes, and a conversation that runs over several of them comes in parts, so that no conversation has to
fit memory, only each turn.
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

from .common import text_buffer

# Control strings of common chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
HEAD, MIDDLE, TAIL = b"<|im_start|>", b"\n", b"<|im_end|>\n"

FIRST = "[" + "".join(sorted({re.escape(c[0]) for c in CONTROL})) + "]"
REST = "(" + "|".join(sorted({re.escape(c[1:]) for c in CONTROL})) + ")"
ESCAPED = re.compile(f"({FIRST})\\\\(\\\\*){REST}")
TURN = re.compile("<\\|im_start\\|>(.*?)\n(.*?)<\\|im_end\\|>\n", re.S)

#: Parts of conversations: `masks` are (start, length) in code points of `formatted` that count for the loss.
PARTS = "conv_id long, part long, formatted string, masks array<struct<start:long,length:long>>, n_turns long"


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, f"({FIRST})(\\\\*){REST}", "\\1\\\\\\2\\3")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def _scatter(out: np.ndarray, raw: np.ndarray, at: np.ndarray, to: np.ndarray) -> None:
    """Copy the values of a text buffer to the places `to` in out."""
    n = np.diff(at)
    out[np.repeat(to - at[:-1], n) + np.arange(len(raw))] = raw


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with all formatted turns, and the offsets of turns in it."""
    role, role_at = text_buffer(escape(roles))
    text, text_at = text_buffer(escape(texts))
    fixed = len(HEAD) + len(MIDDLE) + len(TAIL)
    at = np.concatenate([[0], np.cumsum(np.diff(role_at) + np.diff(text_at) + fixed)])
    out = np.empty(at[-1], np.uint8)
    to = at[:-1]
    for header, place in ((HEAD, to), (MIDDLE, to + len(HEAD) + np.diff(role_at)), (TAIL, at[1:] - len(TAIL))):
        out[(place[:, None] + np.arange(len(header))).ravel()] = np.tile(np.frombuffer(header, np.uint8), len(place))
    _scatter(out, role, role_at, to + len(HEAD))
    _scatter(out, text, text_at, to + len(HEAD) + len(MIDDLE) + np.diff(role_at))
    return out, at


#: Bytes of roles and texts that are assembled at once, unless one turn has more: numpy takes some 17 bytes for each.
BLOCK = 4 << 20


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of BLOCK bytes of roles and texts at most, or of one row."""
    for batch in batches:
        size = np.zeros(len(batch), np.int64)
        for column in (batch.column(1), batch.column(2)):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        upto, a = np.cumsum(size), 0
        while a < len(batch):
            b = max(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + BLOCK, "right")), a + 1)
            yield batch.slice(a, b - a)
            a = b


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, part = (), 0
    for batch in _slices(batches):
        if not len(batch):
            continue
        conv, role, text = batch.column(0), batch.column(1).fill_null(""), batch.column(2).fill_null("")
        ids = conv.to_pylist()
        starts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
        out, at = assemble(role, text)
        # Loss masks in code points: offsets of texts without the bytes that continue a character.
        points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
        head = len(HEAD) + len(MIDDLE) + pc.binary_length(escape(role)).to_numpy(zero_copy_only=False)
        a, b = points[at[:-1] + head], points[at[1:] - len(TAIL)]
        masked = np.flatnonzero(pc.equal(role, "assistant").to_numpy(zero_copy_only=False))
        bounds = np.append(starts, len(ids))
        owner = np.searchsorted(bounds, masked, "right") - 1
        masks = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(masked, bounds).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array((a[masked] - points[at[bounds[owner]]]).astype(np.int64)), pa.array((b - a)[masked].astype(np.int64))], names=["start", "length"]),
        )
        formatted = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at[bounds].astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
        parts = np.zeros(len(starts), np.int64)
        parts[0] = part + 1 if (ids[0],) == last else 0
        last, part = (ids[-1],), int(parts[-1])
        yield pa.RecordBatch.from_arrays([conv.take(pa.array(starts)), pa.array(parts), formatted, masks, pa.array(np.diff(bounds).astype(np.int64))], names=["conv_id", "part", "formatted", "masks", "n_turns"])


def format_chats(turns: DataFrame) -> DataFrame:
    """Formatted conversations (conv_id, part, formatted, masks, n_turns) of rows (conv_id, turn, role, text).

    Turns are taken by turn number, equal ones by role and text; a null text or role is empty, a null turn comes first, a
    null conv_id is a conversation of its own; repeated rows are repeated turns; further columns are ignored; an empty
    table gives no rows; a turn may be as long as a value of a row can be.  Parts of a conversation, 0 and up, are in order
    within their partition.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role"), F.col("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format, PARTS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, own, rows = (), None, []
    for batch in batches:
        for conv, formatted, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if (conv,) != now:
                if own:
                    rows.append((*now, own[0], own[1].hexdigest(), own[2], own[3].hexdigest(), own[4]))
                now, own = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for m in TURN.finditer(formatted):
                own[0] += 1
                own[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            for mask in masks:
                text = unescape(formatted[mask["start"] : mask["start"] + mask["length"]])
                own[2] += len(text)
                own[3].update(text.encode("utf-8", "surrogatepass"))
            own[4] += len(formatted)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=names)
            rows = []
    if own:
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate((*now, own[0], own[1].hexdigest(), own[2], own[3].hexdigest(), own[4]))], names=names)


def read_chats(formatted: DataFrame) -> DataFrame:
    """Digests of conversations read back from format_chats(): turns, their hash, and the text under the loss mask."""
    return formatted.select("conv_id", "formatted", "masks").mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
