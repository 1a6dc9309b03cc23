"""Chat formatting in budgeted windows, with a loss mask that covers every assistant text once."""

from __future__ import annotations

import hashlib
import re
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import in_task

#: The template's control strings. Fixed values.
BEGIN, END, USER, USER_END, SYSTEM, SYSTEM_END, OTHER, NAME_END, OTHER_END = "<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[=]", "[/ROLE]"
_INNER = r"(?:/?s>|/?(?:INST|SYS|ROLE)\]|=\])"
_PLAIN, _ESCAPED = re.compile(r"([<\[])(\\*)(?=" + _INNER + ")"), re.compile(r"([<\[])\\(\\*)(?=" + _INNER + ")")
_TURN = re.compile(r"\[INST\](?P<user>.*?)\[/INST\]|\[SYS\](?P<system>.*?)\[/SYS\]|\[ROLE\](?P<name>.*?)\[=\](?P<other>.*?)\[/ROLE\]|(?P<assistant>.*?)</s>", re.S)
#: Tokens a window may hold, and those of them that repeated turns may take.
BUDGET, HISTORY = 1024, 256

WINDOWS = "window long, n_repeated int, n_tokens long, formatted string, loss array<struct<first:int,last:int>>"


def escape(text: str) -> str:
    """A backslash goes into every control string in a text (and one more where one already stands there)."""
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def turn_tokens(text_col: str = "text") -> Column:
    """Default size of a turn: a token for every four bytes begun, and four for its marks."""
    return (F.ceil(F.coalesce(F.octet_length(text_col), F.lit(0)) / 4) + 4).cast("long")


def _marked(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where in it the text stands."""
    inner = escape(text)
    head, tail = {"user": (USER, USER_END), "system": (SYSTEM, SYSTEM_END), "assistant": ("", END)}.get(role) or (OTHER + escape(role) + NAME_END, OTHER_END)
    return head + inner + tail, len(head), len(head) + len(inner)


class _Windows:
    """The windows of one conversation, turn by turn; holds one window's turns and the history before it."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system, self.recent, self.fresh = None, deque(), []
        self.recent_sum = self.held = 0  # prefix sums' differences: of the history, of the open window
        self.number = 0

    def _open(self, first: int) -> None:
        """Begin a window before a turn of `first` tokens: the system turn, then as much history as fits."""
        fixed = self.system[2] if self.system and self.number else 0
        while self.recent and fixed + self.recent_sum + first > self.budget:
            self.recent_sum -= self.recent.popleft()[2]
        self.repeated = ([self.system] if self.system and self.number else []) + list(self.recent)
        self.held = fixed + self.recent_sum

    def add(self, role: str, text: str, tokens: int):
        turn = (role, text, tokens)
        done = None
        if self.fresh and self.held + tokens > self.budget:
            done = self.close()
        if not self.fresh:
            self._open(tokens)
        self.fresh.append(turn)
        self.held += tokens
        return done

    def close(self):
        if not self.fresh:
            return None
        parts, loss, at = [BEGIN], [], len(BEGIN)
        for i, (role, text, _) in enumerate([*self.repeated, *self.fresh]):
            shown, first, last = _marked(role, text)
            if role == "assistant" and i >= len(self.repeated):
                loss.append({"first": at + first, "last": at + last})
            parts.append(shown)
            at += len(shown)
        out = (self.number, len(self.repeated), self.held, "".join(parts), loss)
        if self.number == 0 and self.fresh[0][0] == "system":
            self.system = self.fresh[0]
        for turn in self.fresh:
            if turn is not self.system:
                self.recent.append(turn)
                self.recent_sum += turn[2]
                while self.recent and self.recent_sum > self.history:
                    self.recent_sum -= self.recent.popleft()[2]
        self.number, self.fresh = self.number + 1, []
        return out


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """Training windows of every conversation: conv id, window, n_repeated, n_tokens, formatted, loss.

    Turns go by turn, then role and text; null roles and texts are empty; repeated rows are turns of their own; rows with
    a null conversation form one conversation. A window holds whole turns whose tokens fit the budget (a turn larger
    than the budget stands alone). From the second window on it begins with a leading system turn and the last turns
    before it that fit `history`; these n_repeated turns are outside the loss. loss has the code-point spans of the
    assistant texts that the window is the first to show. A conversation is read in order by one task, which holds one
    window at a time. Other columns are not carried.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    rows = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("k"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x"), (turn_tokens(text_col) if tokens is None else tokens).cast("long").alias("n"))
    rows = rows.repartition("c").sortWithinPartitions("c", "k", "r", "x").select("c", "r", "x", "n")

    def run(batches):
        import pyarrow as pa

        types = [None, pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))]
        names = ["conv", "window", "n_repeated", "n_tokens", "formatted", "loss"]
        at, open_, out, size = object(), None, [], 0

        def batch_of(rows, conv_type):
            return pa.RecordBatch.from_arrays([pa.array(c, t or conv_type) for c, t in zip(zip(*rows), types)], names=names)

        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field(0).type
            for c, r, x, n in zip(*(col.to_pylist() for col in batch.columns)):
                if c != at:
                    if open_ and (w := open_.close()):
                        out.append((at, *w))
                        size += len(w[3])
                    at, open_ = c, _Windows(budget, history)
                if w := open_.add(r, x, n):
                    out.append((at, *w))
                    size += len(w[3])
                if size > 1 << 22:
                    yield batch_of(out, conv_type)
                    out, size = [], 0
        if open_ and (w := open_.close()):
            out.append((at, *w))
        if out:
            yield batch_of(out, conv_type)

    return rows.mapInArrow(in_task(run), f"`{conv_col}` {kind}, {WINDOWS}")


def parse_window(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    out = []
    for m in _TURN.finditer(formatted, len(BEGIN)):
        g = m.groupdict()
        if g["other"] is not None:
            out.append((unescape(g["name"]), unescape(g["other"])))
        else:
            role = next(k for k in ("user", "system", "assistant") if g[k] is not None)
            out.append((role, unescape(g[role])))
    return out


def read_back(windows: DataFrame, conv_col: str = "conv_id", in_order: bool = False) -> DataFrame:
    """What the windows of each conversation hold: conv id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    in_order: the windows come as format_windows makes them, conversation by conversation, and are not sorted again.
    """
    kind = windows.schema[conv_col].dataType.simpleString()
    rows = windows if in_order else windows.repartition(conv_col).sortWithinPartitions(conv_col, "window")
    rows = rows.select(F.col(conv_col).alias("c"), "n_repeated", "formatted", F.col("loss.first").alias("a"), F.col("loss.last").alias("b"))

    def run(batches):
        import pyarrow as pa

        at, state, out = object(), None, []

        def done():
            return (at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field(0).type
            for c, repeated, text, firsts, lasts in zip(*(col.to_pylist() for col in batch.columns)):
                if c != at:
                    if state:
                        out.append(done())
                    at, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse_window(text)[repeated:]
                state[0] += len(turns)
                state[1].update("".join(f"{r}\n{x}\n" for r, x in turns).encode())
                for i, j in zip(firsts, lasts):
                    shown = unescape(text[i:j])
                    state[2] += len(shown)
                    state[3].update(shown.encode())
                state[4] += len(text)
        if state:
            out.append(done())
        if out:
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return rows.mapInArrow(in_task(run), f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
