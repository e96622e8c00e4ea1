"""Chat formatting: turns laid out as bytes in one preallocated buffer per Arrow batch.

Each turn becomes ``<s>[INST]role[/INST]text</s>``. Inside roles and texts a backslash is doubled and the first
character of a control string is written as an escape, so no control string of the data survives and the original
comes back exactly.
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

OPEN, MIDDLE, CLOSE = b"<s>[INST]", b"[/INST]", b"</s>"
#: Control strings and what stands for them inside texts; the backslash comes first.
ESCAPES = (("\\", "\\\\"), ("<s>", "\\ls>"), ("</s>", "\\l/s>"), ("[INST]", "\\bINST]"), ("[/INST]", "\\b/INST]"))
TURN = re.compile(rb"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
CODE = re.compile(rb"\\(.)", re.DOTALL)
CHUNKS = "conv_id long, chunk long, n_turns long, formatted binary, loss_starts array<int>, loss_lengths array<int>"
#: A buffer holds at most this many text bytes before it is handed on (or one turn, if that is longer).
CHUNK_BYTES = 16 << 20


def escape(texts: pa.Array) -> pa.Array:
    for raw, coded in ESCAPES:
        texts = pc.replace_substring(texts, raw, coded)
    return texts


def unescape(coded: bytes) -> bytes:
    return CODE.sub(lambda m: {b"l": b"<", b"b": b"["}.get(m[1], m[1]), coded)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and contents of a large_string array without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets, data


def _scatter(target: np.ndarray, starts: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> None:
    """Copy segment i (``data[offsets[i]:offsets[i+1]]``) to ``target[starts[i]:]``, all at once."""
    lengths = np.diff(offsets)
    if lengths.sum():
        index = np.arange(offsets[0], offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
        target[index] = data[offsets[0]: offsets[-1]]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer of all turns, start of each turn (one more at the end), start and length of each text in it."""
    (role_at, role_data), (text_at, text_data) = _bytes(escape(roles)), _bytes(escape(texts))
    role_len, text_len = np.diff(role_at), np.diff(text_at)
    at = np.concatenate([[0], np.cumsum(role_len + text_len + len(OPEN) + len(MIDDLE) + len(CLOSE))])
    buffer = np.empty(at[-1], np.uint8)
    role_start = at[:-1] + len(OPEN)
    middle = role_start + role_len
    text_start = middle + len(MIDDLE)
    for mark, starts in ((OPEN, at[:-1]), (MIDDLE, middle), (CLOSE, text_start + text_len)):
        buffer[starts[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    _scatter(buffer, role_start, role_at, role_data)
    _scatter(buffer, text_start, text_at, text_data)
    return buffer, at, text_start, text_len


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, chunk = object(), 0
    for whole in batches:
        sizes = np.cumsum(pc.binary_length(whole.column("text").cast(pa.large_string())).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < whole.num_rows:
            before = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES, "right")))
            batch = whole.slice(begin, end - begin)
            begin = end
            ids = batch.column("conv_id").to_pylist()
            buffer, at, starts, lengths = assemble(batch.column("role"), batch.column("text"))
            loss = np.array([role == "assistant" for role in batch.column("role").to_pylist()])
            edges = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            rows = []
            for a, b in zip(edges, edges[1:]):
                chunk = chunk + 1 if ids[a] == last else 0
                last = ids[a]
                picked = np.flatnonzero(loss[a:b]) + a
                rows.append((last, chunk, b - a, (starts[picked] - at[a]).astype(np.int32), lengths[picked].astype(np.int32)))
            offsets = np.array([at[a] for a in edges], np.int32)
            formatted = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)])
            conv, number, turns, where, long = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv, pa.int64()), pa.array(number, pa.int64()), pa.array(turns, pa.int64()), formatted,
                 pa.array(where, pa.list_(pa.int32())), pa.array(long, pa.list_(pa.int32()))],
                ["conv_id", "chunk", "n_turns", "formatted", "loss_starts", "loss_lengths"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formatted conversations with byte spans of the loss mask; columns conv_id, chunk, n_turns, formatted,
    loss_starts, loss_lengths.

    Rows are dealt by conv_id and sorted by (conv_id, turn, role, text) on disk where needed; a task then streams Arrow
    batches, so a conversation that holds a third of all rows needs no memory beyond one batch. A conversation that
    spans batches, or more than ``CHUNK_BYTES`` of text, comes as several chunks, numbered from 0, whose bytes follow
    one another. Only assistant texts are under the loss mask, without their marks.

    Null role or text: empty. Null conv_id: one conversation with a null id. Null turns come first; turns that tie are
    ordered by role and text; repeated rows are repeated turns. Other columns are ignored. Empty table: no rows.
    """
    ordered = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format, CHUNKS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    held, done, rows = None, True, []

    def close():
        conv, turns, all_turns, chars, loss, formatted = held
        rows.append((conv, turns, all_turns.hexdigest(), chars, loss.hexdigest(), formatted))

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        rows.clear()
        return out

    for batch in batches:
        for conv, chunk, formatted, starts, lengths in zip(*(batch.column(c).to_pylist() for c in (
                "conv_id", "chunk", "formatted", "loss_starts", "loss_lengths"))):
            if chunk == 0:
                if held is not None:
                    close()
                held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in TURN.findall(formatted):
                held[2].update(unescape(role) + b"\n" + unescape(text) + b"\n")
                held[1] += 1
            for start, length in zip(starts, lengths):
                text = unescape(formatted[start: start + length])
                held[3] += len(text.decode())
                held[4].update(text)
            held[5] += len(formatted.decode())
        if rows:
            yield flush()
    if held is not None:
        close()
        yield flush()


def conversation_digests(chunks: DataFrame) -> DataFrame:
    """Read formatted chunks back: turns, text under the loss mask and size per conversation, as digests.

    The chunks must come in the order in which ``format_conversations`` makes them (it is narrow, so it may be
    applied directly). State per task is one running digest.
    """
    return chunks.mapInArrow(
        _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
