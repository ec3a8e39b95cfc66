"""Conversations as marked text: a state machine over roles and a declarative template.

The machine checks the order of turns; the template turns every turn into text
segments (opening mark, text, closing mark) with a loss flag each.  Marks inside
texts are escaped, so the formatted text reads back to the same turns.

Formatting keeps one turn in memory.  The turns of a conversation meet in one
task, in order and as a stream: its digest is one hash over all of them, which
nothing can split; a crowded conversation costs its task time, not memory.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import stage, text_of


@dataclass(frozen=True)
class Turn:
    """How a role's turn is marked, and whether its text is trained on."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks per role, the role order, and the marks of roles that the template does not know.

    ``follows``: the roles that may come next, by the last role ("" before the
    first).  ``ends``: the roles a conversation may end with.
    """

    turns: dict[str, Turn]
    follows: dict[str, tuple[str, ...]]
    ends: tuple[str, ...]
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT] ", " [/ROLE]")
    escape: str = "\\"
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        marks = [m for t in self.turns.values() for m in (t.open, t.close)] + list(self.other)
        cores = sorted({m.strip() for m in marks if m.strip()}, key=lambda m: (-len(m), m))
        for core in cores:
            if self.escape in core or any(core[0] in other[1:] for other in cores):
                raise ValueError(f"mark {core!r}: its first character or the escape stands inside a mark")
        closes = [t.close.strip() for t in self.turns.values()] + [self.other[2].strip()]
        if not all(closes):
            raise ValueError("every turn needs a closing mark")
        object.__setattr__(self, "controls", tuple(cores))

    def escaped(self, text: str) -> str:
        e = self.escape
        return self._special().sub(lambda m: m[0] + e if m[0] == e else m[0][0] + e + m[0][1:], text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.DOTALL) if self.escape in text else text

    def _special(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, (self.escape, *self.controls))))

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) of one turn."""
        turn = self.turns.get(role)
        if turn is None:
            first, second, close = self.other
            turn = Turn(first + self.escaped(role) + second, close)
        return [(turn.open, False), (self.escaped(text), turn.loss), (turn.close, False)]

    def parse(self, text: str) -> tuple[str, str, int] | None:
        """Role, text and length of the turn that ``text`` begins with; None if it is not whole."""
        for role, turn in sorted(self.turns.items(), key=lambda t: -len(t[1].open)):
            if text.startswith(turn.open):
                return self._closed(role, text, len(turn.open), turn.close)
        first, second, close = self.other
        if not text.startswith(first):
            raise ValueError(f"no turn begins with {text[:40]!r}")
        at = text.find(second, len(first))
        if at < 0:
            return None
        return self._closed(self.unescaped(text[len(first) : at]), text, at + len(second), close)

    def _closed(self, role: str, text: str, start: int, close: str) -> tuple[str, str, int] | None:
        end = text.find(close, start)
        return None if end < 0 else (role, self.unescaped(text[start:end]), end + len(close))


INSTRUCT = Template(
    turns={
        "system": Turn("[SYS] ", " [/SYS]"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("[ANS] ", " </s>", loss=True),
    },
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
)

_SEGMENTS = "conv_id long, seq long, turn_no long, role string, text string, loss boolean, in_order boolean"
_READ = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, valid boolean, violations long"
)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields]
    )


def write_segments(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Segments of all conversations (conv_id, turn, role, text), written to the shared folder.

    Rows go by turn; equal turns by role and text, a NULL turn first.  NULL text or
    role counts as empty; rows with a NULL conv_id form one conversation.  A turn
    out of order is formatted all the same and marked ``in_order`` false.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", text_of("role").alias("role"), text_of("text").alias("text")
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        now, state, seq, turn_no, begun = None, "", 0, 0, False
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not begun or conv != now:
                    now, state, seq, turn_no, begun = conv, "", 0, 0, True
                ok = role in template.follows.get(state, ())
                for part, loss in template.segments(role, text):
                    out.append((conv, seq, turn_no, role, part, loss, ok))
                    seq += 1
                state, turn_no = role, turn_no + 1
            yield _batch(out, _SEGMENTS)

    return stage(dealt.select("conv_id", "role", "text").mapInArrow(run, _SEGMENTS), "chat-segments")


class _Reader:
    """One conversation, read back from its segments."""

    def __init__(self, conv: int | None, template: Template):
        self.conv, self.template = conv, template
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.violations = 0
        self.buffer, self.state = "", ""

    def add(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        if loss:
            plain = self.template.unescaped(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.buffer += text
        while self.buffer and (turn := self.template.parse(self.buffer)) is not None:
            role, plain, used = turn
            self.buffer = self.buffer[used:]
            self.turns.update(f"{role}\n{plain}\n".encode())
            self.violations += role not in self.template.follows.get(self.state, ())
            self.n_turns, self.state = self.n_turns + 1, role

    def row(self) -> tuple:
        if self.buffer:
            raise ValueError(f"conversation {self.conv}: a turn without end")
        valid = not self.violations and self.state in self.template.ends
        return (
            self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, valid, self.violations,
        )


def read_back(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation, parsed from the text of its segments.

    n_turns, turns_sha256 (role, newline, text, newline per turn), loss_chars and
    loss_sha256 (unescaped text of the segments with loss), formatted_chars,
    valid (turn order and end), violations (turns out of order).
    """
    dealt = segments.select("conv_id", "seq", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "seq")

    def run(batches):
        reader = None
        for batch in batches:
            out = []
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss"))):
                if reader is None or conv != reader.conv:
                    if reader is not None:
                        out.append(reader.row())
                    reader = _Reader(conv, template)
                reader.add(text, loss)
            if out:
                yield _batch(out, _READ)
        if reader is not None:
            yield _batch([reader.row()], _READ)

    return dealt.select("conv_id", "text", "loss").mapInArrow(run, _READ)
