r"""Conversations as one marked text, assembled column by column.

A turn becomes ``<|im_start|>role\ntext<|im_end|>\n``. Rows are sorted by conversation and turn inside each task;
for every slice of rows the lengths of all segments (marks, role, text) give running offsets, and one gather fills
a preallocated buffer, which Arrow takes as it is. A long conversation spans several parts, so no value grows with
it. Control strings inside texts are escaped reversibly: in each of them, and in each that already carries
backslashes after its first character, one more backslash is put there; reading back takes one away.
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

from lakecheck.llm.arrow import code_points, ragged, slices, strings, text_buffer

OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: What may not stand inside a text, split into first character and rest.
CONTROL = r"(<|\[)(\\*)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\])"
ESCAPED = r"(<|\[)\\(\\*)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\])"
TRAINED_ROLE = "assistant"

PART = "conv_id long, part long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, CONTROL, r"\1\\\2\3")


def escape_role(column: pa.Array) -> pa.Array:
    """A role stays on its line: backslashes are doubled and line feeds written as ``\\n``."""
    column = pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "\n", "\\n")
    return escape(column)


def unescape(text: str) -> str:
    return re.sub(ESCAPED, r"\1\2\3", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, turn_ends, text_starts, text_ends)`` of all turns laid end to end."""
    fixed = [np.frombuffer(x.encode(), np.uint8) for x in (OPEN, BREAK, CLOSE)]
    (role, role_at), (text, text_at) = text_buffer(escape_role(roles)), text_buffer(escape(texts))
    source = np.concatenate([*fixed, role, text])
    n, at = len(role_at) - 1, np.cumsum([0, *(len(x) for x in fixed), len(role)])
    lengths, starts = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    for k, (start, length) in enumerate([(at[0], len(fixed[0])), (at[3] + role_at[:-1], np.diff(role_at)), (at[1], len(fixed[1])), (at[4] + text_at[:-1], np.diff(text_at)), (at[2], len(fixed[2]))]):
        lengths[:, k], starts[:, k] = length, start
    ends = np.cumsum(lengths).reshape(n, 5)
    out = np.empty(int(lengths.sum()), np.uint8)
    np.take(source, ragged(starts.ravel(), lengths.ravel()), out=out)
    return out, ends[:, 4], ends[:, 2], ends[:, 3]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = 0
    for batch in batches:
        for rows in slices(batch, "text"):
            roles, texts = (rows.column(c).fill_null("") for c in ("role", "text"))
            out, ends, text_starts, text_ends = assemble(roles, texts)
            ids = rows.column("conv_id")
            known, values = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0))
            first = np.flatnonzero(np.concatenate(([True], (values[1:] != values[:-1]) | (known[1:] != known[:-1]))))
            last = np.append(first[1:], len(values))
            offsets = np.concatenate(([0], ends[last - 1]))
            chars = np.concatenate(([0], np.cumsum(code_points(out))))
            trained = np.asarray(pc.equal(roles, TRAINED_ROLE))
            of = np.searchsorted(last, np.flatnonzero(trained), side="right")
            base = chars[offsets[of]]
            counts = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(first)))))
            spans = [pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(chars[x[trained]] - base, pa.int64())) for x in (text_starts, text_ends)]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(first)), pa.array(np.arange(part, part + len(first))), pa.array(last - first), strings(out, offsets).cast(pa.string()), *spans],
                names=["conv_id", "part", "n_turns", "formatted", "loss_starts", "loss_ends"],
            )
            part += len(first)


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, n_turns, formatted, loss_starts, loss_ends``: the parts of each conversation in order of ``part``.

    Turns are ordered by ``turn`` (NULL first), then role and text; NULL roles and texts are empty, rows with a NULL
    ``conv_id`` form one conversation, repeated rows are turns of their own. The loss mask lists code points of the
    part, end exclusive, of the texts of the assistant. An empty table gives no rows; other columns are ignored.
    All parts of a conversation come from one task, in order; it holds a slice of about 2 MB at a time.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format, PART)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn, unescaped."""
    for turn in formatted.split(CLOSE)[:-1]:
        role, text = turn.removeprefix(OPEN).split(BREAK, 1)
        yield unescape_role(role), unescape(text)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, None

    def row() -> tuple:
        return now[1], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"]

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    pack = lambda done: pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema=schema)
    for batch in batches:
        done = []
        for conv, formatted, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_starts", "loss_ends"))):
            if now != (True, conv):
                if now:
                    done.append(row())
                now, state = (True, conv), {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "all": 0}
            for role, text in parse(formatted):
                state["turns"].update(f"{role}\n{text}\n".encode())
                state["n"] += 1
            for start, end in zip(starts, ends):
                text = unescape(formatted[start:end])
                state["loss"].update(text.encode())
                state["chars"] += len(text)
            state["all"] += len(formatted)
        if done:
            yield pack(done)
    if now:
        yield pack([row()])


def read_back(parts: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` per conversation, read from the parts of ``format_chats``.

    Digests grow part by part in the task that made them: the parts of a conversation are neighbours there.
    """
    return parts.mapInArrow(_read, READ)
