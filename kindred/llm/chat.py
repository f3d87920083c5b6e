"""Chat formatting: a finite-state machine over roles and a declarative template.

Conversations are streamed turn by turn from sorted partitions, so one of any length is never gathered. The output has a
row per text segment with its loss flag; joined in order the segments of a conversation are its formatted text, and
that text can be read back without the roles, since control strings inside texts are escaped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around each role's text, which roles bear loss, and the allowed role after each state.

    A role that is not named here is written with the ``other`` marks, which carry the role itself, and is an error of
    the state machine. ``reserved`` are further control strings that are escaped inside texts.
    """

    marks: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANSWER]", "</s>")}
    )
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    reserved: tuple[str, ...] = ("<s>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    loss: frozenset[str] = frozenset({"assistant"})
    allowed: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: frozenset[str] = frozenset({"assistant"})

    def controls(self) -> list[str]:
        """Longest first, so that a mark is never read as a shorter one."""
        every = {*self.other, *self.reserved, *(m for pair in self.marks.values() for m in pair)}
        return sorted(every, key=lambda m: (-len(m), m))

    def escape(self, text: str) -> str:
        """Doubles backslashes and puts one after the first character of every control string."""
        return self._inside.sub(r"\1\\", text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    @property
    def _inside(self) -> re.Pattern:
        return re.compile("(?=" + "|".join(map(re.escape, self.controls())) + ")(.)", re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(segment, bears loss) of a turn."""
        if role in self.marks:
            before, after = self.marks[role]
        else:
            before, after = self.other[0] + self.escape(role) + self.other[1], self.other[2]
        return [(before, False), (self.escape(text), role in self.loss), (after, False)]

    def step(self, state: str, role: str) -> tuple[str, str | None]:
        """The next state and what is wrong with this turn, if anything is. An error does not stop the machine."""
        known = role in self.marks
        error = None if role in self.allowed.get(state, ()) else f"{role if known else 'unknown role'} after {state}"
        return (role if known else state), error

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of a formatted text."""
        found, at = [], 0
        opening = {before: (role, after) for role, (before, after) in self.marks.items()}
        start = re.compile("|".join(re.escape(m) for m in sorted([*opening, self.other[0]], key=len, reverse=True)))
        while at < len(formatted):
            mark = start.match(formatted, at)
            if not mark:
                raise ValueError(f"no turn begins at {at}")
            at = mark.end()
            if mark[0] == self.other[0]:
                middle = formatted.index(self.other[1], at)
                role, after = self.unescape(formatted[at:middle]), self.other[2]
                at = middle + len(self.other[1])
            else:
                role, after = opening[mark[0]]
            end = formatted.index(after, at)
            found.append((role, self.unescape(formatted[at:end])))
            at = end + len(after)
        return found


DEFAULT = Template()
SEGMENTS = "turn_index long, role string, segment_index int, segment string, loss boolean, state string, error string"


def format_segments(df: DataFrame, template: Template = DEFAULT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per segment: conv, turn_index, role, segment_index, segment, loss, state after the turn, error.

    Turns are taken in the order of ``turn`` (null first; ties by role, then text), so repeated rows stay turns. Null
    text and null role count as empty; an empty role is unknown. A null conversation id is one conversation. The last
    segment of a conversation that ends in a state that is not final has the error "ends after <state>". The rows of a
    conversation stay together and in order in their partition.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        now, count, state, held = object(), 0, "start", None
        names = [n.split()[0] for n in SEGMENTS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string()]

        def closed(row):
            if row and row[6] not in template.final:
                row = (*row[:-1], "; ".join(x for x in (row[-1], f"ends after {row[6]}") if x))
            return row

        def batch(rows, key_type):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [key_type, *kinds], strict=True)], ["conv", *names])

        key_type = None
        for part in batches:
            key_type, rows, size = part.schema.field(0).type, [], 0
            for key, who, what in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                who, what = who or "", what or ""
                if key != now:
                    if held:
                        rows.append(closed(held))
                        held = None
                    now, count, state = key, 0, "start"
                if held:
                    rows.append(held)
                state, error = template.step(state, who)
                for k, (segment, loss) in enumerate(template.segments(who, what)):
                    row = (key, count, who, k, segment, loss, state, error)
                    rows.append(row)
                    size += len(segment)
                held, count = rows.pop(), count + 1
                if size > 4 << 20:
                    yield batch(rows, key_type)
                    rows, size = [], 0
            if rows:
                yield batch(rows, key_type)
        if held:
            yield batch([closed(held)], key_type)

    kind = df.schema[conv].dataType.simpleString()
    source = df.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    ordered = source.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv {kind}, {SEGMENTS}").withColumnRenamed("conv", conv)


def read_back(segments: DataFrame, template: Template = DEFAULT, conv: str = "conv_id") -> DataFrame:
    """A row per conversation, from the segments alone: turns are parsed from their text, roles are not looked at.

    Takes the output of ``format_segments`` as it lies in its partitions. Each turn is parsed and digested as it passes.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        now, turn, open_, kind = object(), None, [], None
        out: list[tuple] = []
        sums: dict = {}

        def fresh():
            return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "errors": 0}

        def flush():
            if open_:
                ((role, text),) = template.read("".join(open_))
                sums["turns"].update(f"{role}\n{text}\n".encode())
                sums["n"] += 1
                open_.clear()

        def result():
            return (now, sums["n"], sums["turns"].hexdigest(), sums["loss_chars"], sums["loss"].hexdigest(), sums["chars"], sums["errors"])

        def batch():
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_errors"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for part in batches:
            kind = part.schema.field(0).type
            for key, index, segment, loss, error in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if key != now:
                    flush()
                    if sums:
                        out.append(result())
                    now, turn, sums = key, None, fresh()
                if index != turn:
                    flush()
                    turn, counted = index, 0
                open_.append(segment)
                sums["chars"] += len(segment)
                if loss:
                    plain = template.unescape(segment)
                    sums["loss"].update(plain.encode())
                    sums["loss_chars"] += len(plain)
                if error and not counted:
                    sums["errors"], counted = sums["errors"] + 1, 1
            if len(out) > 10_000:
                yield batch()
                out.clear()
        flush()
        if sums:
            out.append(result())
            yield batch()

    kind_ = segments.schema[conv].dataType.simpleString()
    schema = f"conv {kind_}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_errors long"
    source = segments.select(F.col(conv).alias("conv"), "turn_index", "segment", "loss", "error")
    return source.mapInArrow(run, schema).withColumnRenamed("conv", conv)


def chat_formatting(conversations: DataFrame) -> DataFrame:
    """The registered query: all conversations and conversation -1, formatted, read back and digested."""
    spark = conversations.sparkSession
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_segments(rows))


def _sql_escaped(column: str) -> str:
    expr = f"replace({column}, '\\', '\\\\')"
    for mark in DEFAULT.controls():
        expr = f"replace({expr}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return expr


#: Lengths of the marks follow from the template; control strings of the default template never overlap each other.
SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v),
p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
             lead(turn) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS is_last FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_sql_escaped("text")})
           + CASE role {" ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in DEFAULT.marks.items())}
             ELSE {sum(map(len, DEFAULT.other))} + length({_sql_escaped("role")}) END) AS BIGINT) AS formatted_chars,
       CAST(count(*) FILTER (NOT CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN coalesce(before, 'start') IN ('start', 'system', 'assistant')
           WHEN 'assistant' THEN coalesce(before, '') = 'user' ELSE false END OR (is_last AND role <> 'assistant')) AS BIGINT) AS n_errors
FROM p GROUP BY conv_id
"""
