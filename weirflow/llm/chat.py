"""Chat formatting: a finite-state machine over roles and a declarative template.

A template says, for each role, what opens and closes its turn and whether its
text bears loss. The machine checks the order of the roles; its verdict stands
beside each turn. Turns come out as text segments with a loss flag each. The
control strings of the template are escaped inside texts by a backslash after
their first character, so that the formatted text can be read back.

Rows are ordered within a conversation by turn, then role, then text (nulls
first), so ties and repeated rows have one defined order; each row is a turn. A
null role or text counts as empty; rows without conv_id form one conversation of
their own. A conversation without rows does not exist, so an empty table gives no
rows. Columns other than the four are ignored.

The rows are dealt by conversation, sorted on disk where memory is short, and
streamed, so a conversation of any size needs the memory of one batch. A digest
over a whole conversation is sequential by nature: one task reads it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import ship, strings


@dataclass(frozen=True)
class Turn:
    """How one role is written."""

    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Turns by role, the turn of other roles (its name stands between two marks), and the machine's arrows.

    Each control string begins with a character that occurs in no control string but as the first, which makes
    reading back unambiguous; check() holds the template against that.
    """

    turns: dict[str, Turn]
    other: Turn
    name_end: str
    arrows: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def controls(self) -> list[str]:
        found = {x for t in (*self.turns.values(), self.other) for x in (t.opening, t.closing)} | {self.name_end}
        return sorted(found, key=lambda c: (-len(c), c))

    def check(self) -> None:
        controls, openings = self.controls(), [t.opening for t in (*self.turns.values(), self.other)]
        firsts = {c[0] for c in controls}
        if "\\" in "".join(controls) or any(firsts & set(c[1:]) for c in controls) or len(set(openings)) < len(openings) or any(a != b and b.startswith(a) for a in controls for b in controls):
            raise ValueError("control strings of the template can't be told apart")


#: start, then a system turn or not, then user and assistant by turns.
CHAT = Template(
    turns={"system": Turn("<SYS>", "</SYS>"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("<s>", "</s>", loss=True)},
    other=Turn("[ROLE]", "[/ROLE]"),
    name_end="[TEXT]",
    arrows={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
)


class Codec:
    """Escapes, writes and reads by a template."""

    def __init__(self, template: Template):
        template.check()
        self.template = template
        tails: dict[str, list[str]] = {}
        for c in template.controls():
            tails.setdefault(c[0], []).append(re.escape(c[1:]))
        self._inside = re.compile("|".join(f"{re.escape(a)}(?={'|'.join(b)})" for a, b in tails.items()))
        self._control = re.compile("|".join(map(re.escape, template.controls())))
        self.roles = {t.opening: r for r, t in template.turns.items()}

    def escape(self, text: str) -> str:
        if "\\" in text:
            text = text.replace("\\", "\\\\")
        return self._inside.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.?)", r"\1", text, flags=re.S) if "\\" in text else text

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """A turn as (text, loss) segments."""
        turn = self.template.turns.get(role)
        if turn is None:
            turn, head = self.template.other, self.template.other.opening + self.escape(role) + self.template.name_end
        else:
            head = turn.opening
        return [(head, False), (self.escape(text), turn.loss), (turn.closing, False)]

    def read(self, formatted: str, at: int = 0) -> tuple[str, str, int]:
        """The turn that begins at a position: role, text, and where the next one begins."""
        m = self._control.match(formatted, at)
        opening, start = m[0], m.end()
        role = self.roles.get(opening)
        if role is None:
            m = self._control.search(formatted, start)
            role, start = self.unescape(formatted[start : m.start()]), m.end()
        m = self._control.search(formatted, start)
        return role, self.unescape(formatted[start : m.start()]), m.end()


def format_turns(turns: DataFrame, template: Template = CHAT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per turn: conv_id, first (whether a conversation begins), in_order (the machine's verdict), segments array<struct<text, loss>>.

    Rows of a conversation stand together and in order within a partition, and stay so for mapInArrow on top.
    """
    ship(turns.sparkSession)
    kind = turns.schema[conv_col].dataType.simpleString()
    schema = f"conv_id {kind}, first boolean, in_order boolean, segments array<struct<text:string,loss:boolean>>"
    arrow_segments = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(template)
        begun, before, state, ok = False, None, "start", True
        for batch in batches:
            first, order, out = [], [], []
            for conv, role, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strings(batch.column(2)), strict=True):
                new = not begun or conv != before
                if new:
                    begun, before, state, ok = True, conv, "start", True
                ok = ok and role in template.arrows.get(state, ())
                state = role
                first.append(new)
                order.append(ok)
                out.append([{"text": t, "loss": x} for t, x in codec.segments(role, text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, pa.bool_()), pa.array(order, pa.bool_()), pa.array(out, arrow_segments)], names=["conv_id", "first", "in_order", "segments"])

    rows = turns.select(F.col(conv_col).alias("conv_id"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(turn_col).alias("turn"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, schema)


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation from format_turns(): what reading its formatted text and loss mask gives.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars, loss_sha256 (of the
    unescaped text under the mask), formatted_chars, formatted_sha256, in_order.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted_sha256 string, in_order boolean"
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "formatted_sha256", "in_order"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha, now = Codec(template), hashlib.sha256, None
        kind_of_id = None

        def done(found: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], t) for n, t in zip(names, [kind_of_id, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()], strict=True)], names=names)

        def closed(x: dict) -> dict:
            return x | {k: x[k].hexdigest() for k in ("turns_sha256", "loss_sha256", "formatted_sha256")}

        for batch in batches:
            kind_of_id, found = batch.schema.field(0).type, []
            for conv, first, ok, segments in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if first:
                    if now:
                        found.append(closed(now))
                    now = {"conv_id": conv, "n_turns": 0, "turns_sha256": sha(), "loss_chars": 0, "loss_sha256": sha(), "formatted_chars": 0, "formatted_sha256": sha()}
                text = "".join(s["text"] for s in segments)
                at = 0
                while at < len(text):
                    role, own, at = codec.read(text, at)
                    now["n_turns"] += 1
                    now["turns_sha256"].update(f"{role}\n{own}\n".encode())
                for s in segments:
                    if s["loss"]:
                        own = codec.unescape(s["text"])
                        now["loss_chars"] += len(own)
                        now["loss_sha256"].update(own.encode())
                now["formatted_chars"] += len(text)
                now["formatted_sha256"].update(text.encode())
                now["in_order"] = ok
            if found:
                yield done(found)
        if now:
            yield done([closed(now)])

    return formatted.mapInArrow(run, schema)
