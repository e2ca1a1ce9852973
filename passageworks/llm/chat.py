"""Chat formatting by schema fingerprint.

Conversations arrive as JSON records of different layouts. The nested field paths
of a record (its structure without value types) are hashed; the hash selects a
declared ``Layout``, and the layout says how the record becomes canonical turns.
A chat template then writes the turns as one text and marks what an assistant
said (the loss mask) by code-point spans.

In the template a turn is ``<|turn|>role``, a line feed, its text, a line feed,
``<|end|>`` and a line feed. Control strings inside a text get a backslash in
front (more precisely: one more than they had), which ``unescape`` takes away, so
every text can be read back. Roles are URL-encoded, so they hold no line feed.

Records that are null, no JSON or of an unknown layout have the layout ``null``
and no turns. Missing and null roles and texts are empty. Repeated records are
formatted each; other columns pass unchanged. A conversation is one record, so
one row; nothing is grouped or shuffled here.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bind

# The template's marks and the control strings of common templates.
TURN, END = "<|turn|>", "<|end|>"
CONTROLS = (
    TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|system|>",
    "<|user|>", "<|assistant|>", "<|startoftext|>", "<|endoftext|>", "<|begin_of_text|>", "<|start_header_id|>",
    "<|end_header_id|>", "<|eot_id|>", "<start_of_turn>", "<end_of_turn>",
)
#: Names that layouts give to the three usual roles.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

TURNS = "ARRAY<STRUCT<role: STRING, text: STRING>>"
#: Scalar type names in a described structure.
SCALARS = r"\b(STRING|BOOLEAN|VOID|BIGINT|FLOAT|DOUBLE|DATE|TIMESTAMP(_NTZ)?|BINARY|UUID|DECIMAL\(\d+, ?\d+\))(?=[,>]|$)"


@dataclass(frozen=True)
class Layout:
    """A record structure and where its turns are.

    ``fields`` is the structure: a dict for an object, a one-element list for an
    array, ``str`` for a scalar. A list layout names the array, the paths of role
    and text in its elements and whether role names are translated; a flat layout
    names ``(role, field)`` pairs in the order of the turns.
    """

    name: str
    fields: dict
    turns: str = ""
    role: str = ""
    text: str = ""
    translate: bool = False
    flat: tuple[tuple[str, str], ...] = ()

    def paths(self, kind=None) -> str:
        kind = self.fields if kind is None else kind
        if isinstance(kind, dict):
            return "OBJECT<" + ", ".join(f"{k}: {self.paths(kind[k])}" for k in sorted(kind)) + ">"
        return f"ARRAY<{self.paths(kind[0])}>" if isinstance(kind, list) else ""

    def ddl(self, kind=None) -> str:
        kind = self.fields if kind is None else kind
        if isinstance(kind, dict):
            return "STRUCT<" + ", ".join(f"`{k}`: {self.ddl(v)}" for k, v in kind.items()) + ">"
        return f"ARRAY<{self.ddl(kind[0])}>" if isinstance(kind, list) else "STRING"

    def fingerprint(self) -> str:
        return hashlib.sha256(self.paths().encode()).hexdigest()

    def read(self, record: Column) -> Column:
        """Canonical turns of a record that has this layout."""

        def at(value: Column, path: str) -> Column:
            for name in path.split("."):
                value = value[name]
            return F.coalesce(value, F.lit(""))

        def turn(role: Column, text: Column) -> Column:
            return F.struct(role.alias("role"), text.alias("text"))

        def turns(parsed: Column) -> Column:
            if self.flat:
                return F.array(*(turn(F.lit(r), at(parsed, f)) for r, f in self.flat))
            items = parsed
            for name in self.turns.split("."):
                items = items[name]
            return F.transform(items, lambda x: turn(canonical_role(at(x, self.role)) if self.translate else at(x, self.role), at(x, self.text)))

        return bind(F.from_json(record, self.ddl()), turns)


def canonical_role(role: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))
    return F.coalesce(F.element_at(known, role), role)


LAYOUTS = (
    Layout("messages", {"messages": [{"role": str, "content": str}]}, "messages", "role", "content"),
    Layout("shared", {"conversations": [{"from": str, "value": str}]}, "conversations", "from", "value", True),
    Layout("nested", {"messages": [{"author": {"role": str}, "content": {"text": str}}]}, "messages", "author.role", "content.text"),
    Layout("dialog", {"dialog": {"turns": [{"speaker": str, "utterance": str}]}}, "dialog.turns", "speaker", "utterance", True),
    Layout("prompt", {"prompt": str, "response": str}, flat=(("user", "prompt"), ("assistant", "response"))),
    Layout("completion", {"prompt": str, "completion": str}, flat=(("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", {"instruction": str, "output": str}, flat=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_system", {"system": str, "instruction": str, "output": str}, flat=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Layout("question", {"question": str, "answer": str}, flat=(("user", "question"), ("assistant", "answer"))),
    Layout("text", {"text": str}, flat=(("assistant", "text"),)),
)


def schema_fingerprint(record: Column) -> Column:
    """Hash of a JSON record's nested field paths; null if it is no JSON."""
    described = F.schema_of_variant(F.try_parse_json(record))
    return F.sha2(F.regexp_replace(described, SCALARS, ""), 256)


def to_turns(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with its ``layout`` and canonical ``turns``."""
    names = F.create_map(*(F.lit(x) for y in layouts for x in (y.fingerprint(), y.name)))
    record = F.col(record_col)
    named = records.withColumn("layout", F.element_at(names, F.coalesce(schema_fingerprint(record), F.lit(""))))
    turns = F.lit(None).cast(TURNS)
    for layout in layouts:
        turns = F.when(F.col("layout") == layout.name, layout.read(record)).otherwise(turns)
    return named.withColumn("turns", F.coalesce(turns, F.array().cast(TURNS)))


def _alternatives() -> str:
    quoted = ["".join("\\" + c if c in "|[]<>/\\" else c for c in s) for s in sorted(CONTROLS, key=len, reverse=True)]
    return "(?:" + "|".join(quoted) + ")"


def escape(text: Column) -> Column:
    """One backslash more before each control string; other backslashes stay."""
    return F.regexp_replace(text, rf"(\\*{_alternatives()})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*{_alternatives()})", "$1")


def format_turns(turns: Column) -> Column:
    """``STRUCT<formatted, loss>``: the text, and ``(start, chars)`` of the assistant's texts in it."""

    def written(parts: Column) -> Column:
        def step(a: Column, p: Column) -> Column:
            before = a["at"] + F.length(p["head"])
            chars = F.length(p["body"])
            span = F.array(F.struct(before.alias("start"), chars.alias("chars")))
            loss = F.when(p["loss"], F.concat(a["loss"], span)).otherwise(a["loss"])
            return F.struct((before + chars + len(END) + 2).alias("at"), loss.alias("loss"))

        none = F.array().cast("array<struct<start:int,chars:int>>")
        loss = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("loss")), step, lambda a: a["loss"])
        text = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(f"\n{END}\n"))), "")
        return F.struct(text.alias("formatted"), loss.alias("loss"))

    head = lambda t: F.concat(F.lit(TURN), F.url_encode(t["role"]), F.lit("\n"))
    parts = F.transform(turns, lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    return bind(parts, written)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    marked = F.split(formatted, r"(?<!\\)<\|turn\|>")

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        first = F.length(role) + 2
        body = F.substr(x, first, F.length(x) - first - (len(END) + 1))
        return F.struct(F.url_decode(role).alias("role"), unescape(body).alias("text"))

    return bind(marked, lambda m: F.transform(F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), turn))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["chars"])))


def format_chats(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with ``layout``, ``turns``, ``formatted`` and ``loss``."""
    turned = to_turns(records, record_col, layouts)
    done = turned.withColumn("_f", format_turns(F.col("turns")))
    return done.withColumn("formatted", F.col("_f.formatted")).withColumn("loss", F.col("_f.loss")).drop("_f")
