"""Chat formatting: records of many layouts into canonical turns, and turns into one marked text.

A record is JSON. Its fingerprint is the hash of the nested field paths in it that any layout knows; the fingerprint
selects a declarative mapping, which says where turns, roles and texts are. So fields that no layout knows don't matter, and a
record that fits no mapping is returned without turns, not dropped.

The template marks every turn and cannot be forged from inside: each character that a control string could start with is
escaped in texts and roles, and the escape is undone when the text is read back.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Mapping:
    """Where the turns of a layout are. ``turns`` names a list of objects with ``role`` and ``text`` fields, or of plain texts
    (``role`` and ``text`` None) that take the ``roles`` in turn; without ``turns``, ``fixed`` lists (role, field)."""

    name: str
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    fixed: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)
    roles: tuple[str, ...] = ("user", "assistant")

    def paths(self) -> list[tuple[str, ...]]:
        """The sets of known paths that this layout shows, with and without its optional fields."""
        if self.turns and self.text:
            need = [f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"]
        elif self.turns:
            need = [f"{self.turns}[]"]
        else:
            need = [path for _, path in self.fixed if path not in self.optional]
        sets = [tuple(need)]
        for extra in self.optional:
            sets += [(*s, extra) for s in sets]
        return sets


# Common layouts of instruction and chat data.
MAPPINGS = (
    Mapping("message_texts", turns="messages", role="role", text="text", optional=("system",)),
    Mapping("message_contents", turns="messages", role="role", text="content", optional=("system",)),
    Mapping("from_value", turns="conversations", role="from", text="value", optional=("system",),
            aliases={"human": "user", "gpt": "assistant", "bot": "assistant"}),
    Mapping("speaker_utterance", turns="dialogue", role="speaker", text="utterance",
            aliases={"human": "user", "bot": "assistant"}),
    Mapping("plain_turns", turns="dialog"),
    Mapping("instruction", fixed=(("system", "system"), ("user", "instruction"), ("user", "input"),
                                  ("assistant", "output")), optional=("system", "input")),
    Mapping("prompt_completion", fixed=(("system", "system"), ("user", "prompt"), ("assistant", "completion")),
            optional=("system",)),
    Mapping("prompt_response", fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response")),
            optional=("system",)),
    Mapping("question_answer", fixed=(("user", "context"), ("user", "question"), ("assistant", "answer")),
            optional=("context",)),
)


def field_paths(value, at: str = "") -> Iterator[str]:
    """The paths of all leaves: ``a.b`` for fields, ``a[]`` for the members of a list."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from field_paths(inner, f"{at}.{key}" if at else key)
    elif isinstance(value, list):
        for inner in value:
            yield from field_paths(inner, f"{at}[]")
    else:
        yield at


def fingerprint(paths: Sequence[str] | set[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"))


REGISTRY = {fingerprint(paths): mapping for mapping in MAPPINGS for paths in mapping.paths()}
KNOWN_PATHS = {path for mapping in MAPPINGS for paths in mapping.paths() for path in paths}


def canonical_turns(record: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """The name of the record's layout and its turns (role, text); ``(None, [])`` where none fits."""
    try:
        value = json.loads(record or "null")
    except ValueError:
        return None, []
    if not isinstance(value, dict):
        return None, []
    mapping = REGISTRY.get(fingerprint(KNOWN_PATHS.intersection(field_paths(value))))
    if mapping is None:
        return None, []

    def plain(v) -> str:
        return v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False)

    turns = []
    if mapping.turns:
        if mapping.text and value.get("system") is not None and "system" in mapping.optional:
            turns.append(("system", plain(value["system"])))
        for i, turn in enumerate(value[mapping.turns]):
            if mapping.text is None:
                turns.append((mapping.roles[i % len(mapping.roles)], plain(turn)))
            elif isinstance(turn, dict):
                role = plain(turn.get(mapping.role))
                turns.append((mapping.aliases.get(role, role), plain(turn.get(mapping.text))))
    else:
        for role, name in mapping.fixed:
            if name in value and not (name in mapping.optional and plain(value[name]) == ""):
                if turns and turns[-1][0] == role:
                    turns[-1] = (role, f"{turns[-1][1]}\n{plain(value[name])}")
                else:
                    turns.append((role, plain(value[name])))
    return mapping.name, turns


# The template. Control strings start with < or [; a backslash starts an escape.
OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "</s>\n"
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
ROLE_ESCAPES = {**ESCAPES, "|": "\\p"}
UNESCAPES = {"\\": "\\", "l": "<", "b": "[", "p": "|"}
TURN = re.compile(r"<\|([^|]*)\|>\n([^<]*)</s>\n")


def escape(text: str, escapes: dict[str, str] = ESCAPES) -> str:
    for plain, marked in escapes.items():  # the backslash comes first
        text = text.replace(plain, marked)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: UNESCAPES[m[1]], text)


def format_turns(turns: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans (in code points) of it that a model is trained on: the assistant's texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, ROLE_ESCAPES)}{AFTER_ROLE}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


def masked_text(formatted: str, spans: Sequence[tuple[int, int]]) -> str:
    """What lies under the loss mask, unescaped."""
    return "".join(unescape(formatted[a:b]) for a, b in spans)


def records_of_rows(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """``conv_id`` and ``record``: a conversation stored as rows by turn, as one JSON record.

    Turns are ordered by number (null first), then role, then text; a conversation is one record, so its rows meet in one
    task. Null roles and texts are empty. Rows without a conversation id are one conversation.
    """
    one = F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = F.transform(F.sort_array(F.collect_list(one)), lambda t: F.struct(t["role"].alias("role"),
                                                                             t["text"].alias("text")))
    return (rows.groupBy(F.col(conv_id).cast("long").alias("conv_id")).agg(turns.alias("messages"))
            .select("conv_id", F.to_json(F.struct("messages")).alias("record")))


FORMATTED = "conv_id long, layout string, n_turns long, formatted string, spans array<struct<start:long,stop:long>>"


def format_records(records: DataFrame) -> DataFrame:
    """``conv_id``, ``layout``, ``n_turns``, ``formatted`` and loss ``spans`` per record (``conv_id``, ``record``).

    A record that is null, no JSON object or of no known layout has a null layout, no turns and an empty text. Repeated
    records are formatted each; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                names, counts, texts, masks = [], [], [], []
                for record in part.column("record"):
                    name, turns = canonical_turns(record.as_py())
                    formatted, spans = format_turns(turns)
                    names.append(name)
                    counts.append(len(turns))
                    texts.append(formatted)
                    masks.append([{"start": a, "stop": b} for a, b in spans])
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), pa.array(names, pa.string()), pa.array(counts, pa.int64()),
                     pa.array(texts, pa.string()), pa.array(masks, spans_type)],
                    names=["conv_id", "layout", "n_turns", "formatted", "spans"])

    return records.select("conv_id", "record").mapInArrow(run, FORMATTED)
