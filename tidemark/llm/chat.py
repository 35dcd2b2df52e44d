"""Chat formatting with schema fingerprints (operator 3).

A record is JSON. Its nested field paths (``messages[].role``) are hashed; the hash selects a declarative mapping that says
where turns lie, so heterogeneous layouts become canonical turns without guessing. Turns are rendered with a template
whose control strings are escaped inside texts; the loss mask is the list of spans of assistant texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mapping:
    """A layout: which paths it has and where role and text are.

    ``turns``: path of the list of turns, with ``role`` and ``text`` below it (``order``: a number to sort by); or
    ``fields``: (path, role) pairs in order, for flat layouts. ``optional`` paths may be missing. ``roles`` renames roles.
    """

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> set[str]:
        if self.turns:
            return {f"{self.turns}[].{p}" for p in (self.role, self.text, self.order) if p}
        return {p for p, _ in self.fields}


_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
MAPPINGS = (
    Mapping("turn rows", turns="rows", role="role", text="text", order="turn"),
    Mapping("messages", turns="messages", role="role", text="content", optional=("system",), roles=_ROLES),
    Mapping("message parts", turns="messages", role="role", text="content[].text", optional=("messages[].content[].type",), roles=_ROLES),
    Mapping("from and value", turns="conversations", role="from", text="value", optional=("system",), roles=_ROLES),
    Mapping("prompt and response", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Mapping("prompt and completion", fields=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("instruction", fields=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=("system", "input")),
    Mapping("question and answer", fields=(("question", "user"), ("answer", "assistant"))),
)


def field_paths(value: Any, prefix: str = "") -> set[str]:
    """Leaf paths of a JSON value; list items share ``[]``; an empty list or object is a leaf of its own."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{prefix}.{k}" if prefix else str(k)) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, prefix + "[]") for v in value))
    return {prefix + "[]" if isinstance(value, list) else prefix}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> tuple[dict[str, Mapping], set[str]]:
    """(mapping by fingerprint, for each choice of optional paths; the top-level fields that layouts use)."""
    by_hash: dict[str, Mapping] = {}
    roots: set[str] = set()
    for m in mappings:
        required = m.paths() - set(m.optional)
        roots |= {re.split(r"[.\[]", p)[0] for p in m.paths() | set(m.optional)}
        for k in range(len(m.optional) + 1):
            for extra in combinations(m.optional, k):
                if by_hash.setdefault(fingerprint(required | set(extra)), m) is not m:
                    raise ValueError(f"layouts {m.name} and {by_hash[fingerprint(required | set(extra))].name} have the same paths")
        if m.turns:
            by_hash.setdefault(fingerprint({m.turns + "[]"}), m)  # no turns at all
    return by_hash, roots


def _at(value: Any, path: str) -> Any:
    """The value at a path; over a list, the texts of its items joined."""
    for step in path.split("."):
        if value is None:
            return None
        if step.endswith("[]"):
            rest = path.split("[].", 1)[1]
            return "".join(_text(_at(item, rest)) for item in value.get(step[:-2]) or [])
        value = value.get(step) if isinstance(value, dict) else None
    return value


def _text(value: Any) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def canonical(record: str | None, by_hash: dict[str, Mapping], roots: set[str]) -> tuple[str, str, list[tuple[str, str]]]:
    """(fingerprint, layout name, turns) of a JSON record; layout "" and no turns if the record can't be read or no mapping fits.

    Fields outside the known layouts (ids, sources) do not count.
    """
    try:
        value = json.loads(record or "")
    except ValueError:
        value = None
    if not isinstance(value, dict):
        return "", "", []
    value = {k: v for k, v in value.items() if k in roots}
    mark = fingerprint(field_paths(value))
    m = by_hash.get(mark)
    if m is None:
        return mark, "", []
    if m.fields:
        parts = [(role, _text(value[path])) for path, role in m.fields if path in value]
        turns: list[tuple[str, str]] = []
        for role, text in parts:  # instruction and input are one user turn
            if turns and turns[-1][0] == role == "user":
                turns[-1] = role, f"{turns[-1][1]}\n\n{text}" if text else turns[-1][1]
            else:
                turns.append((role, text))
        return mark, m.name, turns
    items = [x for x in value[m.turns] or [] if isinstance(x, dict)]
    if m.order:
        items.sort(key=lambda x: (x.get(m.order) is not None, x.get(m.order) or 0, _text(x.get(m.role)), _text(_at(x, m.text))))
    turns = [("system", _text(value["system"]))] if "system" in value else []
    return mark, m.name, turns + [(m.roles.get(r := _text(x.get(m.role)), r), _text(_at(x, m.text))) for x in items]


#: The template: what opens and closes a turn of each role; any other role is named in its opening mark.
MARKS = {"system": ("[SYS] ", " [/SYS]\n"), "user": ("<s>[INST] ", " [/INST]\n"), "assistant": ("[ANS] ", " </s>\n")}
_OPEN, _SHUT = "[ROLE:", " [/ROLE]\n"
_ESCAPED, _UNESCAPE = re.compile(r"[<\[\\]"), re.compile(r"([<\[\\])\\")
_TURN = re.compile(r"(?:(\[SYS\] )|(<s>\[INST\] )|(\[ANS\] )|\[ROLE:((?:[^\]<\[\\]|[<\[\\]\\|\]\\)*)\] )((?:[^<\[\\]|[<\[\\]\\)*)(?: \[/SYS\]\n| \[/INST\]\n| </s>\n| \[/ROLE\]\n)")


def escape(text: str) -> str:
    """A backslash behind every "<", "[" and backslash: no control string can occur inside a text."""
    return _ESCAPED.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, loss spans): spans in code points over the escaped assistant texts."""
    out: list[str] = []
    spans, at = [], 0
    for role, text in turns:
        before, after = MARKS.get(role) or (f"{_OPEN}{escape(role).replace(']', ']' + chr(92))}] ", _SHUT)
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(body)))
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; raises ValueError if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        role = "system" if m[1] else "user" if m[2] else "assistant" if m[3] else unescape(m[4].replace("]\\", "]"))
        turns.append((role, unescape(m[5])))
        at = m.end()
    return turns


FORMATTED = pa.schema([("schema_hash", pa.string()), ("layout", pa.string()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])
_FORMATTED_DDL = "schema_hash string, layout string, formatted string, loss_starts array<long>, loss_ends array<long>"
_READ_DDL = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _append(df: DataFrame, ddl: str, names: list[str], fn) -> DataFrame:
    kept = [c for c in df.columns if c not in names]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.select(*[F.col(f'`{c}`') for c in kept]).schema)}, {ddl}" if kept else ddl

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *fn(batch)], names=[*kept, *names])

    return df.mapInArrow(work, schema)


def format_records(df: DataFrame, *, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``df`` plus schema_hash, layout, formatted, loss_starts, loss_ends (code points) for its JSON ``record`` column.

    Null or unreadable records and layouts without a mapping get layout "" and an empty formatted text; null texts are
    empty; a record without turns formats to "". Repeated rows each keep theirs; columns with the new names are replaced.
    """
    by_hash, roots = registry(mappings)

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        columns: list[list] = [[], [], [], [], []]
        for value in batch.column(batch.schema.get_field_index(record)).to_pylist():
            mark, layout, turns = canonical(value, by_hash, roots)
            formatted, spans = render(turns)
            for c, x in zip(columns, (mark, layout, formatted, [a for a, _ in spans], [b for _, b in spans]), strict=True):
                c.append(x)
        return [pa.array(c, f.type) for c, f in zip(columns, FORMATTED, strict=True)]

    return _append(df, _FORMATTED_DDL, FORMATTED.names, fn)


def read_back(df: DataFrame) -> DataFrame:
    """``df`` of ``format_records`` plus digests of what its formatted text and loss spans hold."""

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        rows: list[tuple] = []
        get = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
        for text, starts, ends in zip(get("formatted"), get("loss_starts"), get("loss_ends"), strict=True):
            turns = parse(text)
            loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True))
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            rows.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        n, turn_hash, chars, loss_hash, length = zip(*rows, strict=True) if rows else ((), (), (), (), ())
        return [pa.array(n, pa.int64()), pa.array(turn_hash, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_hash, pa.string()), pa.array(length, pa.int64())]

    return _append(df, _READ_DDL, ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], fn)


def turn_records(df: DataFrame) -> DataFrame:
    """One JSON record per conversation (conv_id, record) from rows by turn.

    A conversation is one training example and is rendered as one text, so its rows meet in one record; conversations
    are independent of each other. Null role and text are empty. Rows with equal turn are ordered by role, then text.
    Rows with a null conv_id form one conversation.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return df.groupBy("conv_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(row)).alias("rows")), {"ignoreNullFields": "false"}).alias("record"))
