"""Chat formatting by schema fingerprints.

A record's fingerprint is the hash of its nested field paths, sorted: of all objects within it, and of all elements of
its arrays. It selects a declarative mapping that turns the record into turns (role, text). Fields that no
mapping knows (ids, sources, dates) don't count. Layouts come as JSON strings (one for each record) or as typed columns (one for a
table). Turns are then formatted with one template:

    <|turn|>role\\ntext<|end|>

Control strings inside roles and texts (of this and of other known templates) are escaped: a
backslash becomes two, and one is put after a control string's first character; a newline in a role becomes a
backslash and n. unescape() and unescape_role() are the inverse. A loss mask covers the texts of assistant turns. Reading records is
Arrow code, everything else DataFrame functions; the only gathering is of one conversation's turns.

Turns stand by turn, ties by role, then text; null turns last. Null texts and roles are empty; numbers and truth values in a text's
place are their JSON, lone surrogates U+FFFD. Rows with a null conv_id are one conversation. Records that aren't JSON or whose fingerprint has
no mapping get none (layout null) and no turns; roles outside ROLES are kept as they are. Columns other than
those of the layout are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import ship
from tidemark.llm.tokens import parts

OPEN, CLOSE = "<|turn|>", "<|end|>"
#: Control strings of common templates, fixed values.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
#: Role names of other layouts, fixed values.
ROLES = {"human": "user", "user": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "assistant": "assistant", "system": "system"}
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """How records with these field paths become turns. single: (role, paths joined by a blank line) for each
    turn; many: an array's path with the fields of role and text. optional paths may be there or not."""

    name: str
    paths: tuple[str, ...]
    single: tuple[tuple[str, tuple[str, ...]], ...] = ()
    many: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()

    @property
    def keys(self) -> list[str]:
        """The fingerprints that select this layout."""
        chosen = itertools.chain.from_iterable(itertools.combinations(self.optional, k) for k in range(len(self.optional) + 1))
        return [fingerprint_of((*self.paths, *more)) for more in chosen]


def fingerprint_of(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


SYSTEM = ("system", ("system",))
#: The layouts known, as field paths; [] stands for an array's elements.
LAYOUTS = (
    Layout("turn_rows", ("conv_id", "role", "text", "turn"), many=("turns", "role", "text")),
    Layout("messages", ("messages[].content", "messages[].role"), many=("messages", "role", "content"), optional=("messages[].name",)),
    Layout("message_parts", ("messages[].content[].text", "messages[].role"), many=("messages", "role", "content"), optional=("messages[].content[].type",)),
    Layout("shared", ("conversations[].from", "conversations[].value"), many=("conversations", "from", "value")),
    Layout("prompt_response", ("prompt", "response"), (SYSTEM, ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("prompt_completion", ("completion", "prompt"), (SYSTEM, ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("instruction", ("instruction", "output"), (SYSTEM, ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("input", "system")),
    Layout("question_answer", ("answer", "question"), (SYSTEM, ("user", ("question",)), ("assistant", ("answer",))), optional=("system",)),
    Layout("nested_pair", ("data.input", "data.output"), (("user", ("data.input",)), ("assistant", ("data.output",))), optional=("data.id",)),
)
MAPPINGS = {key: layout for layout in LAYOUTS for key in layout.keys}
KNOWN = frozenset(p for layout in LAYOUTS for p in (*layout.paths, *layout.optional))


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The field paths of a type, leaves only."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def value_paths(value, at: str = "") -> set[str]:
    """The field paths of a JSON value, leaves only."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, f"{at}[]")}
    return {at}


def text_in(value) -> str:
    """A text field's text; an array's are joined."""
    if value is None:
        return ""
    if isinstance(value, list):
        return "\n".join(text_in(v.get("text")) if isinstance(v, dict) else text_in(v) for v in value)
    found = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return found.encode("utf-8", "replace").decode() if any("\ud800" <= c <= "\udfff" for c in found) else found


def field_at(value, path: str):
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def record_turns(record: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """The layout that a JSON record's fingerprint selects, and the turns that its mapping makes."""
    try:
        value = json.loads(record or "")
    except (ValueError, RecursionError):
        return None, []
    layout = MAPPINGS.get(fingerprint_of(value_paths(value) & KNOWN)) if isinstance(value, dict) else None
    if layout is None:
        return None, []
    if layout.many:
        where, role, text = layout.many
        rows = [x for x in value[where] if isinstance(x, dict)]
        return layout.name, [(ROLES.get(text_in(x.get(role)).lower(), text_in(x.get(role))), text_in(x.get(text))) for x in rows]
    turns = [(role, "\n\n".join(filter(None, (text_in(field_at(value, p)) for p in paths)))) for role, paths in layout.single]
    return layout.name, [t for t in turns if t[0] != "system" or t[1]]


def records_to_turns(records: DataFrame) -> DataFrame:
    """(conv_id, layout, turns) of records (conv_id, record), each a JSON string. Where there is none, a column turns, if
    there is one, is kept."""
    ship(records.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            for part in parts(batch, "record"):
                found = [record_turns(r) for r in part.column("record").to_pylist()]
                turns = [[{"role": a, "text": b} for a, b in t] or own for (_, t), own in zip(found, part.column("turns").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array([n for n, _ in found], pa.string()), pa.array(turns, kind)], ["conv_id", "layout", "turns"])

    own = F.col("turns") if "turns" in records.columns else F.array().cast(TURNS)
    chosen = records.select("conv_id", "record", F.when(F.col("record").isNull(), own).otherwise(F.array().cast(TURNS)).alias("turns"))
    return chosen.mapInArrow(read, f"conv_id {records.schema['conv_id'].dataType.simpleString()}, layout string, turns {TURNS}")


def _pattern() -> str:
    import re

    return r"(\\)|(" + "|".join(re.escape(c[0]) + f"(?={re.escape(c[1:])})" for c in sorted(CONTROL, key=len, reverse=True)) + ")"


def escape(c: Column) -> Column:
    """A backslash is doubled, and a control string's first character followed by one."""
    return F.regexp_replace(c, _pattern(), r"$1$2\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    """A backslash that isn't itself escaped, and n, is a newline."""
    return unescape(F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def format_turns(turns: Column) -> Column:
    """The formatted conversation of an array of turns (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))), "")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back: control strings stand in it only as marks."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), 2, F.greatest(F.size(F.split(formatted, r"<\|turn\|>")) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        cut = F.instr(p, F.lit("\n"))
        text = F.substring(p, cut + 1, F.length(p) - cut - len(CLOSE))
        return F.struct(unescape_role(F.substring(p, F.lit(1), cut - 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def loss_spans(formatted: Column) -> Column:
    """The loss mask: (start, length) in code points of each assistant text in a formatted conversation,
    found by its marks alone."""
    pieces = F.split(formatted, r"<\|turn\|>")
    head = "assistant\n"

    def step(acc: Column, p: Column) -> Column:
        own = F.struct((acc["at"] + len(OPEN) + len(head)).alias("start"), (F.length(p) - len(head) - len(CLOSE)).alias("length"))
        spans = F.when(F.startswith(p, F.lit(head)), F.concat(acc["spans"], F.array(own))).otherwise(acc["spans"])
        return F.struct((acc["at"] + len(OPEN) + F.length(p)).alias("at"), spans.alias("spans"))

    none = F.array().cast("array<struct<start:int,length:int>>")
    rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.aggregate(rest, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"]


def rows_to_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table with one turn a row; its schema's fingerprint must be that layout's."""
    layout = MAPPINGS.get(fingerprint_of(p for p in schema_paths(rows.schema) if p in KNOWN))
    if layout is None or layout.name != "turn_rows":
        raise ValueError("no mapping for this table's layout")
    turn = F.struct(F.col("turn").isNull().alias("n"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def record_of(t: Column, conv_id: Column) -> Column:
    """A JSON record of a conversation's turns, in the layout that they fit. One question and its
    answer are a pair of fields, with a system text or without; others are lists of messages, in either of two common
    layouts, or lists of parts. Null without turns, or with roles that reading would rename."""
    roles = F.transform(t, lambda x: x["role"])
    plain = F.forall(t, lambda x: x["role"].isin("user", "assistant", "system") | ~F.lower(x["role"]).isin(*ROLES))
    text = lambda i: F.get(t, F.lit(i))["text"]
    is_ = lambda *names: roles == F.array(*map(F.lit, names))
    kind = F.pmod(F.xxhash64(conv_id), F.lit(3))
    rows = lambda make: F.transform(t, lambda x: F.struct(*make(x)))
    messages = F.to_json(F.struct(rows(lambda x: (x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    shared = F.to_json(F.struct(conv_id.alias("id"), rows(lambda x: (x["role"].alias("from"), x["text"].alias("value"))).alias("conversations")))
    part = lambda x: F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text"))).alias("content")
    in_parts = F.to_json(F.struct(rows(lambda x: (x["role"].alias("role"), part(x))).alias("messages")))
    pair = F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response")))
    asked = F.to_json(F.struct(text(0).alias("system"), text(1).alias("question"), text(2).alias("answer")))
    return (
        F.when(~plain | (F.size(t) == 0), F.lit(None).cast("string")).when(is_("user", "assistant"), pair)
        .when(is_("system", "user", "assistant") & (text(0) != ""), asked)
        .when(kind == 0, messages).when(kind == 1, shared).otherwise(in_parts)
    )


def through_records(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table with one turn a row by way of records of several layouts: each is read back by the mapping
    that its own fingerprint selects. Conversations that fit none keep the turns of their rows."""
    turns = rows_to_turns(rows)
    return records_to_turns(turns.withColumn("record", record_of(F.col("turns"), F.col("conv_id")))).select("conv_id", "turns")


def chat_report(conversations: DataFrame) -> DataFrame:
    """Formats (conv_id, turns), and reads the output back into digests."""
    out = conversations.select("conv_id", format_turns(F.col("turns")).alias("formatted"))
    out = out.withColumn("spans", loss_spans(F.col("formatted")))
    masked = F.array_join(F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    back = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), masked.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
