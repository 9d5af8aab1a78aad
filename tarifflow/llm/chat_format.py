"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role\\ncontent<|im_end|>\\n``.  Inside roles and contents a
backslash gets a backslash before it, and so does the bar of ``<|``; no control string
can then occur in a text, and dropping the backslashes gives the text back.  For a
batch of turns, segment lengths, their cumulative offsets and the place of each content
byte are computed in numpy and everything is copied into one preallocated buffer.

Turns are dealt by conversation and sorted within the task, ties by role and text;
readers hold a few hash states, never a conversation, so a very long conversation needs
time (its digest is sequential) but no memory.

Defined results: null texts and roles are empty.  Repeated turns are all kept.  Rows
whose conversation is null form one conversation of their own.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import string_buffers

START, END = b"<|im_start|>", b"<|im_end|>\n"
LOSS_ROLE = "assistant"
_ESCAPED = re.compile(rb"\\([\\|n])")


def escape_role(role: str) -> bytes:
    return role.replace("\\", "\\\\").replace("<|", "<\\|").replace("\n", "\\n").encode()


def unescape(data: bytes) -> bytes:
    return _ESCAPED.sub(lambda m: b"\n" if m[1] == b"n" else m[1], data) if b"\\" in data else data


def assemble(roles: list[str], contents: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(formatted turns, first content byte of each, content bytes of each as formatted)."""
    offsets, data = string_buffers(contents)
    n = len(offsets) - 1
    heads = {r: np.frombuffer(START + escape_role(r) + b"\n", np.uint8) for r in set(roles)}
    head_sizes = np.array([len(heads[r]) for r in roles], dtype=np.int64)
    # bytes that get a backslash before them
    marked = data == 92
    bar = np.flatnonzero(data == 124)
    bar = bar[bar > 0]
    bar = bar[data[bar - 1] == 60]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    marked[bar[~first[bar]]] = True
    inserted = np.cumsum(marked)
    before = np.concatenate(([0], inserted))[offsets]
    sizes = np.diff(offsets) + np.diff(before)
    ends = np.cumsum(head_sizes + sizes + len(END))
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    content_at = starts + head_sizes
    number = {role: k for k, role in enumerate(heads)}
    which = np.fromiter((number[r] for r in roles), np.int64, n)
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(len(heads) + 1))
    for k, head in enumerate(heads.values()):
        rows = order[cuts[k] : cuts[k + 1]]
        out[starts[rows][:, None] + np.arange(len(head))] = head
    out[(ends - len(END))[:, None] + np.arange(len(END))] = np.frombuffer(END, np.uint8)
    shift = np.repeat(content_at - offsets[:-1] - before[:-1], np.diff(offsets))
    place = np.arange(len(data)) + inserted + shift
    out[place] = data
    out[place[marked] - 1] = 92
    texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.append(starts, ends[-1] if n else 0).astype(np.int64)), pa.py_buffer(out))
    return texts.cast(pa.large_string()), head_sizes, sizes


FORMATTED = "conv_id bigint, turn_no bigint, formatted string, loss_start bigint, loss_length bigint"


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per turn, in order within its conversation and task: the formatted bytes and the part under the loss mask (byte offset and length; 0, 0 where there is none)."""
    ordered = (
        turns.select(F.col("conv_id").cast("bigint"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def run(batches):
        last, count = object(), 0
        for batch in batches:
            ids, roles = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            if not ids:
                continue
            texts, head, size = assemble(roles, batch.column(3))
            numbers = []
            for i in ids:
                count = count + 1 if i == last else 0
                last = i
                numbers.append(count)
            loss = np.array([r == LOSS_ROLE for r in roles])
            columns = [batch.column(0), pa.array(numbers, pa.int64()), texts.cast(pa.string()), pa.array(np.where(loss, head, 0)), pa.array(np.where(loss, size, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn_no", "formatted", "loss_start", "loss_length"])

    return ordered.mapInArrow(run, FORMATTED)


READ_BACK = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_TURN = re.compile(re.escape(START) + rb"([^\n]*)\n(.*?)" + re.escape(END), re.DOTALL)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its formatted turns and loss mask say; takes the order that format_chats gives."""

    def run(batches):
        last, state = None, None

        def row():
            turns, loss, n, loss_chars, chars = state
            return pa.RecordBatch.from_pylist([{"conv_id": last[0], "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}], schema=schema)

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        done = []
        for batch in batches:
            for conv, text, at, size in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if last is None or last[0] != conv:
                    if state is not None:
                        done.append(row())
                    last, state = (conv,), [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                data = text.encode()
                for m in _TURN.finditer(data):
                    role, content = unescape(m[1]), unescape(m[2])
                    state[0].update(role + b"\n" + content + b"\n")
                    state[2] += 1
                if size:
                    masked = unescape(data[at : at + size])
                    state[1].update(masked)
                    state[3] += len(masked.decode())
                state[4] += len(text)
            yield from done
            done = []
        if state is not None:
            yield row()

    return formatted.mapInArrow(run, READ_BACK)
