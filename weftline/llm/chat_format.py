"""Chat formatting with a grammar round trip.

A turn is written as

    ### <Role>: <text> </turn>\\n

and read by one deterministic grammar: a role line `### `, the role up to `: `, then
text up to ` </turn>` and a newline, where a backslash makes the next character
literal. A turn is rendered plainly, reparsed and compared with its source; while they
differ, its conflicting content is escaped: first the backslashes, then also every
control string, by a backslash before its first character. The usual roles are written
by their titles; others are escaped like texts. The last level is reversible for any text, so every turn ends identical.

Turns of a conversation stand in order of turn (null first), role, text. Rows are
shuffled by conversation and sorted; formatting and reading back stream over the
sorted rows, so a conversation of any length takes the memory of one turn. The loss
mask covers assistant texts. Null texts and roles are empty; a null conversation id is a
conversation of its own. Further columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import bound_batches

OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
LOSS_ROLE = "assistant"
#: Wherever a control string starts, also inside another one.
CONTROL = re.compile(r"(?=###|: | </turn>)")
WRITTEN = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
READ = {v: k for k, v in WRITTEN.items()}


def escape(text: str, level: int) -> str:
    """Level 0: as it is; 1: backslashes; 2: control strings too."""
    if level >= 1:
        text = text.replace("\\", "\\\\")
    if level >= 2:
        text = CONTROL.sub(lambda _: "\\", text)
    return text


class GrammarError(ValueError):
    """Text that is not a sequence of turns."""


def _field(s: str, at: int, end: str) -> tuple[str, int]:
    """The unescaped text from `at` to the first unescaped `end`, and the place after it."""
    out = []
    while True:
        stop, back = s.find(end, at), s.find("\\", at)
        if back >= 0 and (stop < 0 or back < stop):
            if back + 1 >= len(s):
                raise GrammarError("a backslash ends the text")
            out.append(s[at:back] + s[back + 1])
            at = back + 2
        elif stop < 0:
            raise GrammarError(f"no {end!r}")
        else:
            return "".join([*out, s[at:stop]]), stop + len(end)


def parse(s: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; s[start:end] is the text as it is written."""
    turns, at = [], 0
    while at < len(s):
        if not s.startswith(OPEN, at):
            raise GrammarError(f"no turn at {at}")
        role, start = _field(s, at + len(OPEN), COLON)
        role = READ.get(s[at + len(OPEN) : start - len(COLON)], role)
        text, at = _field(s, start, CLOSE)
        turns.append((role, text, start, at - len(CLOSE)))
    return turns


def _role(role: str, level: int) -> str:
    """The usual roles by their titles; another role that reads like a title is escaped."""
    return WRITTEN.get(role) or ("\\" if level == 2 and role in READ else "") + escape(role, level)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A written turn and where its text stands, escaped as little as the round trip allows."""
    for level in (0, 1, 2):
        head = OPEN + _role(role, level) + COLON
        body = escape(text, level)
        s = head + body + CLOSE
        try:
            if [(r, t) for r, t, _, _ in parse(s)] == [(role, text)]:
                return s, len(head), len(head) + len(body)
        except GrammarError:
            continue
    raise GrammarError(f"a turn of role {role!r} does not round-trip")


PIECES = "conv_id long, no long, piece string, loss_start long, loss_end long"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, no = object(), 0
    for b in batches:
        rows = []
        for c, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
            conv, no = (c, no + 1) if c == conv else (c, 0)
            s, start, end = render(role or "", text or "")
            loss = role == LOSS_ROLE
            rows.append({"conv_id": c, "no": no, "piece": s, "loss_start": start if loss else None, "loss_end": end if loss else None})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("no", pa.int64()), ("piece", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]))


def _sorted(conversations: DataFrame, *order: str) -> DataFrame:
    return conversations.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The written turns: conv_id, no (from 0), piece, and the loss span in the piece (null: no loss).

    A conversation's formatted text is its pieces in order of `no`; rows come in that
    order inside each partition.
    """
    bound_batches(conversations.sparkSession)
    src = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    return _sorted(src, "turn", "role", "text").mapInArrow(_format, PIECES)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    conv, state = None, None

    def row() -> dict:
        n, turns, chars, loss, written = state
        return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": written}

    for b in batches:
        done = []
        for c, s, start, end in zip(*(b.column(k).to_pylist() for k in ("conv_id", "piece", "loss_start", "loss_end")), strict=True):
            if state is None or c != conv:
                if state is not None:
                    done.append(row())
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(s):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            if start is not None:
                text, _ = _field(s[start:end] + CLOSE, 0, CLOSE)
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(s)
        yield pa.RecordBatch.from_pylist(done, schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([row()], schema)


def digests(pieces: DataFrame, in_order: bool = True) -> DataFrame:
    """What the written turns say when read back, per conversation; in_order: rows stand as format_turns leaves them."""
    return (pieces if in_order else _sorted(pieces, "no")).mapInArrow(_digest, DIGEST)
