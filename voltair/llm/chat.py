"""Chat formatting: records of any layout to canonical turns, a template with escapes, and a loss mask.

Schema fingerprinting: the nested field paths of a record (`messages[].role`) are
ordered and hashed, and the hash selects a declarative mapping: where the id and
the turns stand. A layout that has more fields than a mapping names is resolved
once, to the mapping that names most of its paths, and remembered by its hash; a task
remembers at most LAYOUTS of them and then begins anew.

Template: each turn is `### role: text</turn>` and a line feed. In roles and texts a
backslash is written `\\e`, `<` is `\\l`, `#` is `\\h` and, in roles, `:` is `\\c`, so no
control string can stand in them and every text is restored exactly. The loss mask
lists the code point spans of the assistants' texts in the formatted string.

Defined cases: null text or role is empty; turns are ordered by turn, then role,
then text, nulls first, repeated rows stay; a record of an unknown layout, that is no
JSON object, or that is nested too deeply to be read, has no turns; turns that are no
objects are left out; an id that is no 64-bit integer is null; lone surrogates become
U+FFFD; other fields of a record are left alone, whatever their names. A conversation
is one record and one formatted string, so a very long one is held by one task: its
digest runs over all its turns in order. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the template.
HEAD, COLON, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
#: Layouts that a task remembers.
LAYOUTS = 10_000
_SURROGATES = re.compile("[\ud800-\udfff]")


@dataclass(frozen=True)
class Mapping:
    """How a layout gives turns.

    id: field of the conversation's id. turns: field of an array of turns, with the
    fields `role` and `text` of each; or, without it, `parts`: (field, role) in order,
    null fields giving no turn. renames: roles of other vocabularies are renamed by ROLES.
    """

    name: str
    id: str
    turns: str | None = None
    role: str = "role"
    text: str = "text"
    parts: tuple[tuple[str, str], ...] = ()
    renames: bool = True

    def paths(self) -> frozenset[str]:
        if self.turns:
            return frozenset({self.turns, f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"})
        return frozenset(p for p, _ in self.parts)


#: Known layouts. `turns` is that of `records`, whose roles stay as they are.
MAPPINGS = (
    Mapping("turns", "conv_id", "turns", "role", "text", renames=False),
    Mapping("messages", "conv_id", "messages", "role", "content"),
    Mapping("conversations", "id", "conversations", "from", "value"),
    Mapping("prompt", "conv_id", parts=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping("prompt_only", "conv_id", parts=(("prompt", "user"), ("response", "assistant"))),
    Mapping("instruction", "conv_id", parts=(("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Mapping("instruction_only", "conv_id", parts=(("instruction", "user"), ("output", "assistant"))),
    Mapping("question", "conv_id", parts=(("question", "user"), ("answer", "assistant"))),
)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def paths_of(value: object, at: str = "") -> Iterator[str]:
    """Nested field paths of a JSON value; elements of arrays share theirs. In names, the signs of paths are escaped."""
    if isinstance(value, dict):
        for k, v in value.items():
            k = k.replace("\\", "\\\\").replace(".", "\\.").replace("[", "\\[").replace("\n", "\\n")
            here = f"{at}.{k}" if at else k
            yield here
            yield from paths_of(v, here)
    elif isinstance(value, list):
        for v in value:
            yield from paths_of(v, f"{at}[]")


def fingerprint(paths: frozenset[str] | set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


class Layouts:
    """Mappings by fingerprint; unknown fingerprints are resolved once."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.mappings = mappings
        self.known: dict[str, Mapping | None] = {}
        for m in reversed(mappings):
            self.known[fingerprint(m.paths())] = m
            self.known[fingerprint(m.paths() | {m.id})] = m

    def of(self, paths: set[str]) -> tuple[str, Mapping | None]:
        key = fingerprint(paths)
        if key not in self.known:
            if len(self.known) >= LAYOUTS:
                self.__init__(self.mappings)
            fits = [m for m in self.mappings if m.paths() <= paths]
            self.known[key] = max(fits, key=lambda m: len(m.paths()), default=None)
        return key, self.known[key]


def turns_of(record: dict, m: Mapping | None) -> list[tuple[str, str]]:
    if m is None:
        return []
    if m.turns:
        turns = record.get(m.turns)
        got = [(t.get(m.role), t.get(m.text)) for t in turns if isinstance(t, dict)] if isinstance(turns, list) else []
    else:
        got = [(role, record.get(field)) for field, role in m.parts if record.get(field) is not None]
    text = lambda x: "" if x is None else _SURROGATES.sub("\ufffd", x if isinstance(x, str) else json.dumps(x, ensure_ascii=False))
    names = ROLES if m.renames else {}
    return [(names.get(text(r), text(r)), text(t)) for r, t in got]


def escape(text: str, pairs: tuple = ESCAPES) -> str:
    for plain, coded in pairs:
        text = text.replace(plain, coded)
    return text


def unescape(text: str, pairs: tuple = ESCAPES) -> str:
    for plain, coded in reversed(pairs):
        text = text.replace(coded, plain)
    return text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the spans of assistants' texts in it."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{HEAD}{escape(role, ROLE_ESCAPES)}{COLON}", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string."""
    turns = []
    for part in formatted.split(CLOSE)[:-1]:
        role, _, text = part.removeprefix(HEAD).partition(COLON)
        turns.append((unescape(role, ROLE_ESCAPES), unescape(text)))
    return turns


def records(turn_rows: DataFrame) -> DataFrame:
    """(record string): one JSON object per conversation from rows (conv_id, turn, role, text)."""
    turn = F.struct("turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    grouped = turn_rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    kept = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return grouped.select(F.to_json(F.struct("conv_id", kept.alias("turns")), {"ignoreNullFields": "false"}).alias("record"))


FORMATTED = "conv_id long, layout string, fingerprint string, formatted string, mask array<struct<start: int, stop: int>>"
_MASK = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def format_records(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """FORMATTED from a column `record` of JSON objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts = Layouts(mappings)
        for b in batches:
            rows = []
            for raw in b["record"].to_pylist():
                try:
                    value = json.loads(raw) if raw else {}
                    value = value if isinstance(value, dict) else {}
                    paths = set(paths_of(value))
                except (ValueError, RecursionError):
                    value, paths = {}, set()
                key, m = layouts.of(paths)
                text, mask = render(turns_of(value, m))
                name = value.get(m.id) if m else None
                known = isinstance(name, int) and not isinstance(name, bool) and -(2**63) <= name < 2**63
                rows.append((name if known else None, m.name if m else None, key, text, [{"start": s, "stop": e} for s, e in mask]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), _MASK)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "layout", "fingerprint", "formatted", "mask"])

    return records.select("record").mapInArrow(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from formatted strings and masks: DIGESTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, mask in zip(b["formatted"].to_pylist(), b["mask"].to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[m["start"] : m["stop"]]) for m in mask)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([b["conv_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, DIGESTS)
