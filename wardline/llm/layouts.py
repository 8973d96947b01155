"""Conversations in many layouts brought to canonical turns by the fingerprint of their fields.

A record is one JSON object. Its nested field paths (lists add []) are hashed; the fingerprint selects a
declarative mapping, which says where roles and texts lie. Paths that no mapping names are metadata and
don't count, so a mapping need not list what else a source puts into its records.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Role names that some layouts use, and the canonical ones.
ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    Lists of messages: `each` is the list, `role` and `text` are paths inside it (or, without `each`, of the
    record). One field a turn: `fields` gives (path, role) in order; those in `optional` may be absent, and
    absent, null or empty ones give no turn. `joined` fields of one role next to each other become one
    turn. `aliases` renames roles. `number` is the place of a record that holds one turn of many.
    """

    name: str
    key: str
    each: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    joined: str | None = None
    number: str = ""
    aliases: dict[str, str] = field(default_factory=dict)

    def paths(self) -> list[frozenset[str]]:
        """Every set of paths that this layout can have."""
        fixed = {self.key, *([self.number] if self.number else [])}
        if self.each:
            inner = {f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"}
            return [frozenset(fixed | inner), frozenset(fixed | {f"{self.each}[]"})]  # the second: an empty list
        if self.role:
            return [frozenset(fixed | {self.role, self.text})]
        needed = fixed | {p for p, _ in self.fields if p not in self.optional}
        return [frozenset(needed | set(more)) for k in range(len(self.optional) + 1) for more in itertools.combinations(self.optional, k)]


MAPPINGS = (
    Mapping("flat row", "conv_id", role="role", text="text", number="turn"),
    Mapping("message row", "conversation.id", role="message.role", text="message.content", number="conversation.turn"),
    Mapping("speaker row", "dialog", role="speaker.name", text="utterance", number="position", aliases=ALIASES),
    Mapping("prompt row", "id", fields=(("prompt", "user"),), number="index"),
    Mapping("response row", "id", fields=(("response", "assistant"),), number="index"),
    Mapping("messages", "id", each="messages", role="role", text="content"),
    Mapping("from and value", "id", each="conversations", role="from", text="value", aliases=ALIASES),
    Mapping("prompt and completion", "id", fields=(("system", "system"), ("prompt", "user"), ("completion", "assistant")), optional=("system",)),
    Mapping("instruction", "id", fields=(("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=("input",), joined="\n\n"),
    Mapping("question and answer", "id", fields=(("context", "system"), ("question", "user"), ("answer", "assistant")), optional=("context",)),
)


def field_paths(value, at: str = "") -> set[str]:
    """The paths of all leaves; an empty object or list is a leaf."""
    if isinstance(value, dict) and value:
        names = ((k.replace(".", "\\."), v) for k, v in value.items())  # a dot in a name leads nowhere
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in names))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def at_path(value, path: str):
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def as_text(value) -> str:
    """Text as it is, but for halves of surrogate pairs, which become question marks; other values as JSON."""
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return text.encode("utf-8", "replace").decode()


def turns_of(record: dict, how: Mapping) -> list[tuple[str, str]]:
    """(role, text) of every turn."""
    name = lambda role: how.aliases.get(role, role)
    if how.role:
        found = (at_path(record, how.each) or []) if how.each else [record]
        return [(name(as_text(at_path(x, how.role))), as_text(at_path(x, how.text))) for x in found]
    single = len(how.fields) == 1  # its turn is there also when empty
    held = [(role, as_text(at_path(record, path))) for path, role in how.fields]
    held = [(role, text) for role, text in held if text or single]
    if how.joined is None:
        return held
    return [(role, how.joined.join(t for _, t in same)) for role, same in itertools.groupby(held, lambda x: x[0])]


class Registry:
    """Mappings by fingerprint."""

    def __init__(self, mappings=MAPPINGS):
        self.by_print, self.prints = {}, {}
        sets = [(paths, m) for m in mappings for paths in m.paths()]
        self.known = frozenset().union(*(paths for paths, _ in sets))
        for paths, m in sets:
            other = self.by_print.setdefault(fingerprint(paths), m)
            if other is not m:
                raise ValueError(f"{other.name!r} and {m.name!r} have the same fields")

    def select(self, record) -> tuple[str, Mapping | None]:
        try:
            paths = frozenset(field_paths(record)) & self.known if isinstance(record, dict) else frozenset()
        except RecursionError:  # nested deeper than any layout
            paths = frozenset()
        if paths not in self.prints:
            self.prints[paths] = fingerprint(paths)
        return self.prints[paths], self.by_print.get(self.prints[paths])


def parsed(text: str | None):
    try:
        return None if text is None else json.loads(text)
    except (ValueError, RecursionError):
        return None


def as_long(value) -> int | None:
    """A whole number that a long holds; anything else is null."""
    return value if isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63 else None


def canonical_turns(records: DataFrame, record: str = "record", mappings=MAPPINGS) -> DataFrame:
    """conv_id, turn, seq, role, text, layout, fingerprint: one row per turn of every record.

    records: JSON objects in the column `record`. turn is the record's own number where it holds one turn of
    a conversation, else null; seq counts the turns of a record from 0. Ids and numbers that are no whole
    number of 64 bits are null; roles and texts that are null are empty; other values are their JSON.
    A record that no mapping fits, that isn't an object or isn't JSON comes as one row whose layout, role
    and text are null and whose seq is -1, so that none is lost; a record with an empty list has no turns.
    Repeated records give repeated turns; other columns, whatever their names, are ignored; empty tables
    give no rows. Nothing is shuffled; a record of any length is held once.
    """

    def run(batches):
        registry = Registry(mappings)
        for batch in batches:
            rows = []
            for text in batch[0].to_pylist():
                value = parsed(text)
                mark, how = registry.select(value)
                if how is None:
                    rows.append((None, None, -1, None, None, None, mark))
                    continue
                key, turn = as_long(at_path(value, how.key)), as_long(at_path(value, how.number)) if how.number else None
                rows += [(key, turn, i, role, words, how.name, mark) for i, (role, words) in enumerate(turns_of(value, how))]
            for i in range(0, max(1, len(rows)), 5_000):
                cols = list(zip(*rows[i : i + 5_000], strict=True)) or [()] * 7
                kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "turn", "seq", "role", "text", "layout", "fingerprint"])

    return records.select(record).mapInArrow(run, "conv_id long, turn long, seq int, role string, text string, layout string, fingerprint string")


def as_record(**fields) -> Column:
    """A JSON object with these fields, nulls too."""
    return F.to_json(F.struct(*(F.col(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in fields.items())), {"ignoreNullFields": "false"})


def dealt_layouts(rows: DataFrame) -> DataFrame:
    """The rows of a conversations table as records in five layouts, dealt by a hash of id and turn.

    A role that a layout can't say (its prompt or response, a name it renames) takes the message row.
    """
    deal = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    message = as_record(conversation=F.struct(F.col("conv_id").alias("id"), "turn"), message=F.struct("role", F.col("text").alias("content")))
    named = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    speaker = as_record(dialog="conv_id", position="turn", speaker=F.struct(named.alias("name")), utterance="text")
    prompt, response = as_record(id="conv_id", index="turn", prompt="text"), as_record(id="conv_id", index="turn", response="text")
    own = ~F.coalesce(F.col("role").isin(*ALIASES), F.lit(False))
    record = (
        F.when(deal == 0, as_record(conv_id="conv_id", turn="turn", role="role", text="text"))
        .when((deal == 1) & own, speaker)
        .when((deal == 2) & (F.col("role") == "user"), prompt)
        .when((deal == 2) & (F.col("role") == "assistant"), response)
        .otherwise(message)
    )
    return rows.select(record.alias("record"))
