"""Chat formatting in budgeted windows.

A conversation's turns are counted in tokens; prefix sums of the counts choose spans of whole
turns. Every window repeats the system turn that opens the conversation, then as many of the latest turns before its
span as the history budget takes, then the span. Repeated turns carry no loss: each assistant turn is
a target once, in the window whose span holds it. A turn larger than the budget has a window of
its own span and is never cut.

Template: ``<|im_start|>role\\n text <|im_end|>\\n`` without the blanks. Control strings (of this
and other usual templates) inside roles and texts are escaped by one more backslash after their
first character, which is undone exactly.

Defined results: null roles and texts count as empty; turns go by number, then role and text, null
numbers first; repeated rows are turns of their own; a null conv_id is one conversation; an empty
conversation does not exist; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscope.llm.packing import default_tokenizer, encoder
from cellscope.llm.shared import ship

BUDGET = 1024
HISTORY = 256
START, END = "<|im_start|>", "<|im_end|>"
# Control strings of usual chat templates.
CONTROLS = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_PLAIN = re.compile("|".join(rf"{re.escape(c[0])}(?=\\*{re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\(?=\\*{re.escape(c[1:])})" for c in CONTROLS))


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0], text)


def escape_role(role: str) -> str:
    """Also without line breaks, as one ends the role."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn as formatted, and where its text begins and ends in it."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def windows(turns: Iterator[tuple[str, str, int]], budget: int = BUDGET, history: int = HISTORY) -> Iterator[dict]:
    """Windows of one conversation, from (role, text, tokens) in order.

    Holds the system turn, the history and the open span, so memory is bounded by the
    budgets and the largest turns. Prefix sums: ``total`` is the sum of all turns before, and the
    sum at the span's and the history's first turn give their sizes by difference.
    """
    system: list[tuple[str, str, int]] = []
    past: list[tuple[str, str, int, int]] = []  # with the prefix sum before the turn
    span: list[tuple[str, str, int, int]] = []
    total = index = first = 0

    def make() -> dict:
        begin = span[0][3]
        room = min(history, budget - (sum(t[2] for t in system) if first else 0) - (total - begin))
        kept = [t for t in past if begin - t[3] <= room]
        text, targets = [], []
        size = 0
        head = (system if first else []) + [t[:3] for t in kept]
        for i, (role, body, _) in enumerate(head + [t[:3] for t in span]):
            shown, a, b = render(role, body)
            if i >= len(head) and role == "assistant":
                targets.append((size + a, size + b))
            text.append(shown)
            size += len(shown)
        return {"first_turn": first, "n_new": len(span), "n_repeated": len(head), "n_tokens": sum(t[2] for t in head) + total - begin, "text": "".join(text), "targets": targets}

    for role, text, tokens in turns:
        if index == 0 and role == "system":
            system.append((role, text, tokens))
        repeated = sum(t[2] for t in system) if first else 0
        if span and total - span[0][3] + tokens + repeated > budget:
            yield make()
            past = [t for t in past + span if total - t[3] <= history]
            if first == 0:
                past = [t for t in past if t[3] >= sum(s[2] for s in system)]  # the system turn comes by itself
            first, span = index, []
        span.append((role, text, tokens, total))
        total += tokens
        index += 1
    if span:
        yield make()


def read_back(text: str, n_repeated: int) -> list[tuple[str, str]]:
    """The turns that a window adds, from its text."""
    out = []
    for part in text.split(START)[1:]:
        head, _, body = part.partition("\n")
        out.append((unescape_role(head), unescape(body.rpartition(END)[0])))
    return out[n_repeated:]


def _turns(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[object, str, str, int]]:
    code = encoder(path)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            ids, roles, texts = (part.column(i).to_pylist() for i in range(3))
            shown = [render(r, t)[0] for r, t in zip(roles, texts, strict=True)]
            _, offsets = code.encode(shown)
            for conv, role, text, a, b in zip(ids, roles, texts, offsets[:-1], offsets[1:], strict=True):
                yield conv, role, text, int(b - a)


WINDOW_SCHEMA = "conv_id long, window_no long, first_turn long, n_new long, n_repeated long, n_tokens long, text string, targets array<struct<start:long,end:long>>"
_TYPES = (pa.int64(),) * 6 + (pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
_NAMES = ["conv_id", "window_no", "first_turn", "n_new", "n_repeated", "n_tokens", "text", "targets"]


def _formatted(batches: Iterator[pa.RecordBatch], path: str, budget: int, history: int) -> Iterator[pa.RecordBatch]:
    rows = _turns(batches, path)
    ahead = next(rows, None)
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)

    while ahead is not None:
        conv = ahead[0]

        def own() -> Iterator[tuple[str, str, int]]:
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:  # noqa: B023
                now = ahead[1:]
                ahead = next(rows, None)
                yield now

        for n, w in enumerate(windows(own(), budget, history)):
            out.append((conv, n, w["first_turn"], w["n_new"], w["n_repeated"], w["n_tokens"], w["text"], [{"start": a, "end": b} for a, b in w["targets"]]))
            if len(out) >= 256:
                yield batch()
                out = []
    if out:
        yield batch()


def format_windows(conversations: DataFrame, path: str | None = None, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of all conversations (conv_id, turn, role, text), each conversation's in order.

    Turns meet by conversation and stream in turn order; no conversation is held whole.
    """
    ship(conversations.sparkSession)
    path = path or default_tokenizer()
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition(n, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(lambda it: _formatted(it, path, budget, history), WINDOW_SCHEMA)


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long, max_tokens long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, from its windows in order."""
    names = [c.split()[0] for c in DIGEST_SCHEMA.split(", ")]
    types = [pa.string() if "sha256" in c else pa.int64() for c in names]
    out: list[tuple] = []
    state = None

    def close() -> None:
        out.append((state["conv"], state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"], state["windows"], state["most"]))

    for batch in batches:
        for conv, number, _, _, repeated, tokens, text, targets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number == 0:
                if state:
                    close()
                state = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "windows": 0, "most": 0}
            assert state["conv"] == conv and state["windows"] == number, "windows out of order"
            for role, body in read_back(text, repeated):
                state["all"].update(f"{role}\n{body}\n".encode())
                state["turns"] += 1
            for t in targets:
                body = unescape(text[t["start"] : t["end"]])
                state["loss"].update(body.encode())
                state["chars"] += len(body)
            state["size"] += len(text)
            state["windows"] += 1
            state["most"] = max(state["most"], tokens)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out = []
    if state:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows,
    max_tokens), read back from the windows; their order within a partition is as formatted."""
    return formatted.mapInArrow(_digests, DIGEST_SCHEMA)
