"""Chat formatting into budgeted windows.

A conversation becomes windows of whole turns. Prefix sums of the turns' tokens choose the spans; each later
window opens with the system turn, where it leaves room for the next turn, and the last turns of the window before
it, as far as the history budget goes. The loss mask covers each assistant text once: repeated turns are masked.

Template: `<s>` opens a window; `[SYS] text [/SYS]`, `[INST] text [/INST]`, ` text </s>` for system, user and
assistant; `[ROLE=name] text [/ROLE]` for any other role. In texts and role names a backslash goes before
each backslash, `[` and `<` (in role names `]` too), so that no text can hold a control string, and dropping it gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import bpe

WINDOWS = "conv_id long, window int, text string, loss_starts array<int>, loss_ends array<int>, first_turn long, n_turns int, n_repeated int, n_tokens long"
_TO_ESCAPE, _ESCAPED = re.compile(r"[\\\[<]"), re.compile(r"\\(.)", re.S)
_CONTROL = re.compile(r"\\.|( \[/SYS\]| \[/INST\]| \[/ROLE\]| </s>)", re.S)
_ROLE = re.compile(r"(?:\\.|[^\\\]])*", re.S)
#: Tokens that a turn's markers count as.
MARKERS = 4


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int]:
    """A formatted turn, and where its text begins in it."""
    if role == "system":
        head, tail = "[SYS] ", " [/SYS]"
    elif role == "user":
        head, tail = "[INST] ", " [/INST]"
    elif role == "assistant":
        head, tail = " ", " </s>"
    else:
        head, tail = f"[ROLE={escape(role).replace(']', chr(92) + ']')}] ", " [/ROLE]"
    return f"{head}{escape(text)}{tail}", len(head)


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    if not text.startswith("<s>"):
        raise ValueError("a window begins with <s>")
    turns, at = [], 3
    while at < len(text):
        if text.startswith("[SYS] ", at):
            role, begin, tail = "system", at + 6, " [/SYS]"
        elif text.startswith("[INST] ", at):
            role, begin, tail = "user", at + 7, " [/INST]"
        elif text.startswith("[ROLE=", at):
            name = _ROLE.match(text, at + 6)
            role, begin, tail = unescape(name[0]), name.end() + 2, " [/ROLE]"
        else:
            role, begin, tail = "assistant", at + 1, " </s>"
        end = next((m.start() for m in _CONTROL.finditer(text, begin) if m[1] == tail), None)
        if end is None:
            raise ValueError("a turn has no end")
        turns.append((role, unescape(text[begin:end])))
        at = end + len(tail)
    return turns


def format_windows(turns: DataFrame, *, budget: int = 1024, history: int = 192, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Windows of at most `budget` tokens, of which at most `history` repeat the end of the window before.

    Tokens are those of the tokenizer file, or else words between white space, plus MARKERS a turn. Only a turn longer
    than the budget makes a window longer than that: it has a window of its own, whole and without repeated turns. Turns go by turn number, then role and text; nulls come first. A null role or text is empty; a
    null id is a conversation like any other; repeated rows are turns of their own. An empty table gives no rows.
    Turns stream through a task in order with one window in memory, so the longest conversation needs no more
    memory than the shortest. Ids and turns are cast to long. Other columns are not read and may have any name.
    """
    plain = turns.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    dealt = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in _windows(_measured(batches, tokenizer), budget, history):
            rows.append(row)
            size += len(row["text"])
            if size > 4_000_000:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    return dealt.mapInArrow(windows, WINDOWS)


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32())), ("first_turn", pa.int64()), ("n_turns", pa.int32()), ("n_repeated", pa.int32()), ("n_tokens", pa.int64())])


def _measured(batches: Iterator[pa.RecordBatch], tokenizer: str | None) -> Iterator[tuple]:
    """(conv_id, role, text, tokens) of every turn."""
    for batch in batches:
        for s in range(0, len(batch), 1000):
            part = batch.slice(s, 1000)
            conv, role, text = (part.column(n).to_pylist() for n in ("conv_id", "role", "text"))
            if tokenizer is None:
                sizes = [len(t.split()) for t in text]
            else:
                sizes = [len(e.ids) for e in bpe.tokenizer(tokenizer).encode_batch_fast(text, add_special_tokens=False)]
            yield from zip(conv, role, text, [n + MARKERS for n in sizes], strict=True)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _windows(turns: Iterator[tuple], budget: int, history: int) -> Iterator[dict]:
    """turns: (conv_id, role, text, tokens) with those of a conversation together and in order."""
    conv, number, seen, system = object(), 0, 0, None
    own: list[tuple[str, str, int]] = []  # turns of the open window, repeated ones first
    prefix = [0]
    repeated = 0

    def closed() -> dict:
        parts, starts, ends, at = ["<s>"], [], [], 3
        for n, (role, text, _) in enumerate(own):
            out, begin = render(role, text)
            if role == "assistant" and n >= repeated:
                starts.append(at + begin)
                ends.append(at + len(out) - len(" </s>"))
            parts.append(out)
            at += len(out)
        return {"conv_id": conv, "window": number, "text": "".join(parts), "loss_starts": starts, "loss_ends": ends, "first_turn": seen - (len(own) - repeated), "n_turns": len(own), "n_repeated": repeated, "n_tokens": prefix[-1]}

    for cid, role, text, cost in turns:
        if cid != conv:
            if own:
                yield closed()
            conv, number, seen, system, own, prefix, repeated = cid, 0, 0, None, [], [0], 0
        elif prefix[-1] + cost > budget:
            yield closed()
            number += 1
            kept = [system] if system and system[2] + cost <= budget else []
            room = min(history, budget - cost - sum(n for _, _, n in kept))
            # the shortest prefix to leave out so that the rest fits the history and the window
            first = bisect_left(prefix, prefix[-1] - max(0, room))
            own = kept + [t for t in own[first:] if t is not system]
            repeated, prefix = len(own), [0]
            for _, _, n in own:
                prefix.append(prefix[-1] + n)
        turn = (role, text, cost)
        if seen == 0 and role == "system":
            system = turn
        own.append(turn)
        prefix.append(prefix[-1] + cost)
        seen += 1
    if own:
        yield closed()


def digests(windows: DataFrame) -> DataFrame:
    """Read the formatted windows back: per conversation its turns and what lies under the loss mask.

    Windows may come in any order and splits; those of a conversation are put in the order of their numbers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done = object(), None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    if state:
                        done.append(state)
                    conv = row["conv_id"]
                    state = {"conv_id": conv, "n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "formatted_chars": 0, "n_windows": 0}
                for role, text in parse(row["text"])[row["n_repeated"] :]:
                    state["n_turns"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for s, e in zip(row["loss_starts"], row["loss_ends"], strict=True):
                    text = unescape(row["text"][s:e])
                    state["loss_chars"] += len(text)
                    state["loss"].update(text.encode("utf-8", "surrogatepass"))
                state["formatted_chars"] += len(row["text"])
                state["n_windows"] += 1
            if len(done) > 5000:
                yield _digest_batch(done)
                done = []
        if state:
            done.append(state)
        if done:
            yield _digest_batch(done)

    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def _digest_batch(done: list[dict]) -> pa.RecordBatch:
    rows = [{"conv_id": s["conv_id"], "n_turns": s["n_turns"], "turns_sha256": s["turns"].hexdigest(), "loss_chars": s["loss_chars"], "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["formatted_chars"], "n_windows": s["n_windows"]} for s in done]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())]))
