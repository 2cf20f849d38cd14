"""Chat formatting in budgeted windows.

A conversation's turns are taken in order of (turn, role, text). A turn is rendered as
``<|im_start|>role\\ntext<|im_end|>\\n`` with every control string inside role or text escaped, which :func:`unescape`
undoes. Prefix sums of the turns' tokens choose spans of whole turns that fit the budget: each window begins with the
leading system turn, then repeats at most ``history`` turns of the window before, as far as the budget allows, then goes
on with new turns. Text under the loss mask is the text of assistant turns, each once: where a turn is repeated as
history it is masked. A turn that exceeds the budget alone gets a window of its own and stays whole. A system turn that
takes more than half of the budget is in the first window only, alone if need be; beside a smaller one a turn may exceed
the budget by that half at most.

Conversations are streamed: rows are dealt by conversation and sorted, and a window is given out as soon as it is full,
so memory holds one window and never a whole conversation.

Defined cases: null role or text counts as empty; null conv_id is a conversation like others; repeated rows are turns like
others; other columns are ignored; an empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import _arrow_schema, trimmed

START, END = "<|im_start|>", "<|im_end|>"
#: Turns' sizes are counted in these: runs of word characters, and single other signs.
TOKEN = re.compile(r"\w+|[^\w\s]")
ROW = 2000


def escape(text: str) -> str:
    """Doubles the bar after ``<``: then no control string, nor the mark that :func:`escape_role` adds, is in the text."""
    return text.replace("<|", "<||")


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "<|n")


def unescape_role(role: str) -> str:
    return unescape(role.replace("<|n", "\n"))


def tokens(rendered: str) -> int:
    return len(TOKEN.findall(rendered))


def render(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


class Windows:
    """Turns of one conversation in, windows out: (text, spans under the loss mask, spans of turns that are new)."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple[str, str] | None = None
        self.turns: list[tuple[str, str, bool]] = []  # role, text, new
        self.sums = [0]  # prefix sums of the turns' tokens
        self.n = 0
        self.head = 0  # tokens of the system turn
        self.first_out = False

    def add(self, role: str, text: str) -> Iterator[tuple[str, list[int], list[int]]]:
        size = tokens(render(role, text))
        if self.n == 0 and role == "system":
            self.system, self.head = (role, text), size
        elif self._waiting() and self._head() + self.sums[-1] + size > self.budget:
            yield self._out()
            self._repeat(size)
        self.n += 1
        if self.n == 1 and self.system:
            return
        self.turns.append((role, text, True))
        self.sums.append(self.sums[-1] + size)

    def _large(self) -> bool:
        return 2 * self.head > self.budget

    def _waiting(self) -> bool:
        """Is there a turn that no window holds yet, or a large system turn that may go alone?"""
        return any(t[2] for t in self.turns) or self._large() and not self.first_out and not self.turns

    def _head(self) -> int:
        """Tokens of the system turn in the window that is being filled."""
        return 0 if self.first_out and self._large() else self.head

    def _repeat(self, size: int) -> None:
        """The longest run of last turns that is within the history and leaves room for the next turn."""
        room, k = self.budget - self._head() - size, len(self.turns)
        while k > 0 and len(self.turns) - (k - 1) <= self.history and self.sums[-1] - self.sums[k - 1] <= room:
            k -= 1
        self.turns = [(r, t, False) for r, t, _ in self.turns[k:]]
        self.sums = [s - self.sums[k] for s in self.sums[k:]]

    def end(self) -> Iterator[tuple[str, list[int], list[int]]]:
        if any(t[2] for t in self.turns) or self.system and not self.first_out:
            yield self._out()

    def _out(self):
        text, loss, new = "", [], []
        for role, t, fresh in ([(*self.system, not self.first_out)] if self.system and not (self.first_out and self._large()) else []) + self.turns:
            at = len(text)
            text += render(role, t)
            if fresh:
                new += [at, len(text)]
                if role == "assistant":
                    loss += [at + len(START) + len(escape_role(role)) + 1, len(text) - len(END) - 1]
        self.first_out = True
        return text, loss, new


SCHEMA = "conv_id bigint, window int, formatted string, loss_spans array<int>, new_spans array<int>"


def windows(conversations: DataFrame, budget: int = 1024, history: int = 2) -> DataFrame:
    """conv_id, window, formatted, loss_spans (pairs of begin and end in code points), new_spans (turns that no earlier window holds)."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    schema = SCHEMA.replace("bigint", kind, 1)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        none = object()
        conv, state, k, out = none, None, 0, []

        def flush():
            ids, ws = [x[0] for x in out], [x[1:] for x in out]
            b = pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, target.field(0).type),
                    pa.array([w[0] for w in ws], pa.int32()),
                    pa.array([w[1] for w in ws], pa.string()),
                    pa.array([w[2] for w in ws], pa.list_(pa.int32())),
                    pa.array([w[3] for w in ws], pa.list_(pa.int32())),
                ],
                schema=target,
            )
            out.clear()
            return b

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for c, _, role, text in zip(*cols, strict=True):
                if c != conv or conv is none:
                    if state:
                        out += [(conv, k + i, *w) for i, w in enumerate(state.end())]
                    conv, state, k = c, Windows(budget, history), 0
                for w in state.add(role, text):
                    out.append((conv, k, *w))
                    k += 1
                if len(out) >= ROW:
                    yield flush()
        if state:
            out += [(conv, k + i, *w) for i, w in enumerate(state.end())]
        if out:
            yield flush()

    target = _arrow_schema(conversations.sparkSession, schema)
    return dealt.mapInArrow(trimmed(run), schema)


def read_back(formatted: str, spans: list[int]) -> list[tuple[str, str]]:
    """(role, text) of the turns that lie in the spans, unescaped."""
    out = []
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        role, _, text = formatted[a + len(START) : b - len(END) - 1].partition("\n")
        out.append((unescape_role(role), unescape(text)))
    return out


def digest(made: DataFrame) -> DataFrame:
    """For each conversation, read back from the windows in order: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows."""
    kind = made.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"

    def run(batches):
        none = object()
        conv, out = none, []
        n = turns = loss = chars = size = k = None

        def done():
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, k))

        for batch in batches:
            for c, _, text, spans, new in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if c != conv or conv is none:
                    if conv is not none:
                        done()
                    conv, n, turns, loss, chars, size, k = c, 0, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, t in read_back(text, new):
                    turns.update(f"{role}\n{t}\n".encode())
                    n += 1
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    t = unescape(text[a:b])
                    loss.update(t.encode())
                    chars += len(t)
                size, k = size + len(text), k + 1
            if len(out) > ROW:
                yield pa.RecordBatch.from_pylist([dict(zip(target.names, r, strict=True)) for r in out], schema=target)
                out = []
        if conv is not none:
            done()
        yield pa.RecordBatch.from_pylist([dict(zip(target.names, r, strict=True)) for r in out], schema=target)

    target = _arrow_schema(made.sparkSession, schema)
    # The windows of a conversation leave windows() together and in order; nothing between deals them anew.
    return made.mapInArrow(trimmed(run), schema)
