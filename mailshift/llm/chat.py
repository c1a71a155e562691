"""Chat formatting in budgeted windows (operator 8).

Method: a conversation's turns are counted in tokens once; prefix sums of the
counts choose the windows.  A window holds the system turn (the first turn, if its
role is ``system``), up to ``HISTORY`` tokens of the latest turns before it as repeated
history, and as many new turns as the budget leaves room for; spans begin and end
between turns, so no turn is cut.  A turn that is over the budget by itself gets a
window of its own, with less history or none.  Loss is taken on the assistant
texts among the new turns only, so each of them is a target exactly once.

Template: a turn is ``### Role: text </turn>`` and a line end, and in roles and texts
a backslash is put before every backslash, ``###``, ``</turn>`` and, in roles, colon.
A role is written as it is, with nothing else changed, so the marks that remain
are the template's own and ``read_window`` finds the turns again exactly.  A row of the
output is one window: its text, how many of its turns are repeated, and the spans
of the text (start and end, in code points) under the loss mask.

Turns are sorted by conversation and turn over the cluster and formatted as a
stream: a task holds one window and the history before it, however long the
conversation or the share.

Defined results: null roles and texts count as empty; a conversation of no
assistant turn has windows without targets; rows that tie in turn are ordered by role
and text; a null turn comes first, and a null conversation id is an id of its own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe

BUDGET, HISTORY = 2048, 512
OPEN, CLOSE = "### ", " </turn>\n"  # the blank before </turn> is the template's, not the text's
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def escaped_role(role: str) -> str:
    return escaped(role).replace(":", "\\:")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends."""
    head = f"{OPEN}{escaped_role(role)}: "
    body = escaped(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_window(text: str) -> list[tuple[str, str]]:
    """Role and text of the turns of a formatted window."""
    found, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None or m[2][-1:] != " ":
            raise ValueError(f"no turn at {at}")
        found.append((unescaped(m[1]), unescaped(m[2][:-1])))
        at = m.end()
    return found


def windows(turns: Iterator[tuple[str, str]], count: Callable[[str], int], budget: int = BUDGET, history: int = HISTORY) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Text, repeated turns, new turns and loss spans of each window of a conversation."""
    system: list[tuple[int, str, str, int, int]] = []
    past: list[tuple[int, str, str, int, int]] = []  # turns before the window, the latest last, with running sums
    new: list[tuple[int, str, str, int, int]] = []
    sums = [0]  # prefix sums of the tokens of ``past`` and ``new``

    def repeated(room: int) -> list:
        """The latest turns before the window that fit into the room: a cut in the prefix sums."""
        end = len(past)
        start = end
        while start and sums[end] - sums[start - 1] <= room:
            start -= 1
        return past[start:]

    def window() -> tuple[str, int, int, list[tuple[int, int]]]:
        held = sum(t[0] for t in system)
        fresh = sums[len(past) + len(new)] - sums[len(past)]
        again = [*system, *repeated(max(0, min(history, budget - held - fresh)))] if before else []
        text, spans, at = [], [], 0
        for k, (_, role, body, a, b) in enumerate([*again, *new]):
            text.append(body)
            if k >= len(again) and role == "assistant":
                spans.append((at + a, at + b))
            at += len(body)
        return "".join(text), len(again), len(new), spans

    before = 0
    for n, (role, text) in enumerate(turns):
        body, a, b = formatted_turn(role, text)
        turn = count(body), role, body, a, b
        held = sum(t[0] for t in system) if before else 0
        kept = sum(t[0] for t in repeated(max(0, min(history, budget - held)))) if before else 0
        if new and held + kept + sums[-1] - sums[len(past)] + turn[0] > budget:
            yield window()
            before += len(new)
            # The system turn stands before every later window; the others may be repeated.
            past = [t for t in [*past, *new] if not any(t is s for s in system)]
            while len(past) > 1 and sum(t[0] for t in past[1:]) >= history:
                past.pop(0)
            new, sums = [], [0, *itertools.accumulate(t[0] for t in past)]
        if n == 0 and role == "system":
            system = [turn]
        new.append(turn)
        sums.append(sums[-1] + turn[0])
    if new:
        yield window()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), (x or "" for x in batch.column(2).to_pylist()), (x or "" for x in batch.column(3).to_pylist()))


def format_conversations(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY, vocabulary: str | None = None) -> DataFrame:
    """From rows of conv_id, turn, role and text: conv_id, window (from 0), text, repeated, turns (new ones), loss_start and loss_end."""
    path = vocabulary or bpe.default_path()
    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(path)
        schema = pa.schema([("conv_id", pa_kind), ("window", pa.int64()), ("text", pa.string()), ("repeated", pa.int64()), ("turns", pa.int64()),
                            ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64()))])
        rows = []
        for conv_id, own in itertools.groupby(_turns(batches), key=lambda t: t[0]):
            told = windows(((r, t) for _, r, t in own), lambda x: len(encoder.encode(x)), budget, history)
            for n, (text, repeated, new, spans) in enumerate(told):
                rows.append({"conv_id": conv_id, "window": n, "text": text, "repeated": repeated, "turns": new,
                             "loss_start": [a for a, _ in spans], "loss_end": [b for _, b in spans]})
                if len(rows) >= 200:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_type

    pa_kind = to_arrow_type(turns.schema["conv_id"].dataType)
    return ordered.mapInArrow(form, f"conv_id {kind}, window bigint, text string, repeated bigint, turns bigint, loss_start array<bigint>, loss_end array<bigint>")


def read_back(windows_: DataFrame) -> DataFrame:
    """What the formatted windows hold, conversation by conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = windows_.schema["conv_id"].dataType.simpleString()
    ordered = (windows_.select("conv_id", "window", "text", "repeated", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "window"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa_kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                            ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        out, state = [], None

        def closed() -> dict:
            conv_id, n, turns, chars, loss, formatted = state
            return {"conv_id": conv_id, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted}

        for batch in batches:
            for conv_id, _, text, repeated, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != conv_id:
                    if state is not None:
                        out.append(closed())
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, own in read_window(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{own}\n".encode())
                for a, b in zip(starts, ends):
                    target = unescaped(text[a:b])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([closed()], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_type

    pa_kind = to_arrow_type(windows_.schema["conv_id"].dataType)
    return ordered.mapInArrow(read, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
