"""Chat formatting by schema fingerprints.

The hash of a record's nested field paths selects a declarative mapping that turns its layout (prompt and response,
instruction and input, message lists, turn rows) into canonical turns. A template then marks the turns:

    <|im_start|>ROLE\nTEXT<|im_end|>\n

Control strings inside a text get a backslash after their first character (`<\\|im_end|>`; one that has k backslashes
there already gets one more), so unescaping is exact. Line feeds and backslashes in a role are written `\\n`, `\\\\`.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import binary_rows, decoded, small_batches

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that some chat template or tokenizer takes for control; fixed values of public formats.
CONTROL = (START, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|system|>", "<|user|>", "<|assistant|>")
_TAILS = "|".join(re.escape(x[1:]) for x in sorted(CONTROL, key=len, reverse=True))
#: A control string's first character, backslashes, and the rest of one that begins so.
ESCAPE, UNESCAPE = rf"([<\[])(\\*)(?={_TAILS})", rf"([<\[])\\(\\*)(?={_TAILS})"
_UNESCAPE = re.compile(UNESCAPE)
#: Sets of field paths whose layouts a task remembers.
MEMO = 10_000


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


# Layouts


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """The nested field paths with the kinds of their values, arrays marked `[]`."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Fields:
    """One turn for each role, its text the fields' texts joined by a blank line, empty ones after the first left out."""

    turns: tuple[tuple[str, tuple[str, ...]], ...]


@dataclass(frozen=True)
class Listed:
    """One turn for each element of a list of messages, some roles under other names."""

    column: str
    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Row:
    """The record is a turn itself."""

    turn: str
    role: str
    text: str


Mapping = Fields | Listed | Row

#: Fingerprint -> (field paths, mapping to turns).
LAYOUTS: dict[str, tuple[tuple[str, ...], Mapping]] = {
    fingerprint(list(paths)): (paths, mapping)
    for paths, mapping in (
        (("prompt", "response"), Fields((("user", ("prompt",)), ("assistant", ("response",))))),
        (("prompt", "completion"), Fields((("user", ("prompt",)), ("assistant", ("completion",))))),
        (("question", "answer"), Fields((("user", ("question",)), ("assistant", ("answer",))))),
        (("instruction", "output"), Fields((("user", ("instruction",)), ("assistant", ("output",))))),
        (("instruction", "input", "output"), Fields((("user", ("instruction", "input")), ("assistant", ("output",))))),
        (("system", "prompt", "response"), Fields((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))))),
        (("messages[].role", "messages[].content"), Listed("messages", "role", "content")),
        (("conversations[].from", "conversations[].value"), Listed("conversations", "from", "value", (("human", "user"), ("gpt", "assistant")))),
        (("turn", "role", "text"), Row("turn", "role", "text")),
    )
}


def layout_of(paths: list[str]) -> str | None:
    """The fingerprint of the layout that some field paths have: their own, else, as records carry extra fields, that of
    the largest layout whose paths are all there; null without any."""
    if (key := fingerprint(paths)) in LAYOUTS:
        return key
    within = [(len(x), x, k) for k, (x, _) in LAYOUTS.items() if set(x) <= set(paths)]
    return max(within)[2] if within else None


TURN = "struct<turn: bigint, role: string, text: string>"


def turns_of(mapping: Mapping) -> Column:
    """A record's turns as an array of TURN. Every field of the layout gives its turn; a null text stays null, which formatting takes for empty."""
    one = lambda turn, role, text: F.struct(turn.cast("bigint").alias("turn"), role.cast("string").alias("role"), text.cast("string").alias("text"))
    if isinstance(mapping, Row):
        return F.array(one(F.col(mapping.turn), F.col(mapping.role), F.col(mapping.text)))
    if isinstance(mapping, Listed):

        def message(m: Column, i: Column) -> Column:
            role = m[mapping.role]
            for old, new in mapping.names:
                role = F.when(m[mapping.role] == old, new).otherwise(role)
            return one(i, role, m[mapping.text])

        return F.transform(mapping.column, message)

    def joined(first: str, *others: str) -> Column:
        said = F.col(first).cast("string")
        for c in others:
            more = F.col(c).cast("string")
            said = F.when(F.coalesce(more, F.lit("")) == "", said).otherwise(F.concat_ws("\n\n", said, more))
        return said

    return F.array(*(one(F.lit(i), F.lit(role), joined(*fields)) for i, (role, fields) in enumerate(mapping.turns)))


def canonical_turns(records: DataFrame, key: str) -> DataFrame:
    """conv_id, turn, role, text from a table of any known layout; `key` names the conversation.

    The fingerprint of the table's field paths (without `key`) selects the mapping; extra columns, whatever their names,
    do not matter. Turn rows keep their turn; other layouts number theirs from 0. A null field is a turn with a null text;
    a record whose list of messages is null or empty is one turn 0 without role and text, so no record is lost. Texts of
    any length stay whole, repeated rows repeat, an empty table gives no turns. Unknown layouts raise ValueError.
    """
    paths = [p for p in field_paths(records.schema) if p != key]
    layout = layout_of(paths)
    if layout is None:
        raise ValueError(f"no mapping for the field paths {sorted(paths)}")
    mapping = LAYOUTS[layout][1]
    rows = records.select(F.col(key).alias("conv_id"), F.explode_outer(turns_of(mapping)).alias("said"))
    turn = F.col("said.turn") if isinstance(mapping, Row) else F.coalesce("said.turn", F.lit(0).cast("bigint"))
    return rows.select("conv_id", turn.alias("turn"), "said.role", "said.text")


# JSON records


def json_paths(value, at: str = "") -> list[str]:
    """field_paths() of a parsed JSON value; a list's are those of all its elements."""
    if isinstance(value, dict) and (value or at):
        return [p for k, v in value.items() for p in json_paths(v, f"{at}.{k}" if at else k)]
    if isinstance(value, list):
        return list(dict.fromkeys(p for v in value for p in json_paths(v, f"{at}[]"))) or [f"{at}[]"]
    return [at]


def json_text(value) -> str | None:
    """A text as it is (half of a surrogate pair: U+FFFD), null as null, anything else as JSON."""
    if value is None:
        return None
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def json_turns(raw: str, known: dict[tuple[str, ...], str | None]) -> list[tuple[int, str | None, str | None]]:
    """A JSON record's turns; `known` remembers the layouts of field paths. One of no layout is one turn without a role, the record its text."""
    try:
        record = json.loads(raw)
        paths = tuple(sorted(json_paths(record)))
    except (ValueError, RecursionError):
        return [(0, None, raw)]
    if paths not in known:
        if len(known) >= MEMO:
            known.clear()
        known[paths] = layout_of(list(paths)) if isinstance(record, dict) else None
    if known[paths] is None:
        return [(0, None, raw)]
    mapping = LAYOUTS[known[paths]][1]
    if isinstance(mapping, Row):
        turn = record.get(mapping.turn)
        return [(turn if type(turn) is int and abs(turn) < 1 << 63 else 0, json_text(record.get(mapping.role)), json_text(record.get(mapping.text)))]
    if isinstance(mapping, Listed):
        if not isinstance(record.get(mapping.column), list):
            return [(0, None, raw)]
        names, messages = dict(mapping.names), [m if isinstance(m, dict) else {mapping.text: m} for m in record[mapping.column]]
        said = [(json_text(m.get(mapping.role)), json_text(m.get(mapping.text))) for m in messages]
        return [(i, names.get(role, role), text) for i, (role, text) in enumerate(said)]
    out = []
    for i, (role, fields) in enumerate(mapping.turns):
        first, *others = (json_text(record.get(f)) for f in fields)
        rest = [x for x in others if x]
        out.append((i, role, "\n\n".join(([] if first is None else [first]) + rest) if rest else first))
    return out


def canonical_json_turns(records: DataFrame, key: str, record: str) -> DataFrame:
    """conv_id, turn, role, text from JSON records (column `record`) of layouts that differ row by row.

    Each record's own field paths select its mapping, as for tables; extra fields do not matter. A record of no known
    layout, one that isn't JSON, and one with an empty list of messages is one turn 0 without a role whose text is the
    record as it stands (a null one: null), so nothing is lost. Texts in other types are written as JSON; bytes that
    aren't UTF-8 are read as U+FFFD. Repeated rows repeat; an empty table gives no turns. Records are read once.
    """
    small_batches(records.sparkSession)
    asked = records.select(F.col(key).alias("conv_id"), F.col(record).cast("string").alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, ...], str | None] = {}
        for batch in batches:
            at, rows = [], []
            for i, raw in enumerate(binary_rows(batch.column(1))):
                found = [(0, None, None)] if raw is None else json_turns(decoded(raw), known)
                at += [i] * len(found)
                rows += found
            parts = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *parts], ["conv_id", "turn", "role", "text"])

    return asked.mapInArrow(run, T.StructType([asked.schema["conv_id"], *T.StructType.fromDDL("turn bigint, role string, text string").fields]))


# Template


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, segment, loss_start, loss_length: the conversation's formatted text is its segments in order.

    The order is by turn, then role, then text, nulls first. A null role or text is empty; bytes that aren't UTF-8 become
    U+FFFD. The loss mask covers the text of assistant turns: loss_start and loss_length are code points in the segment,
    null for other turns. Repeated turns repeat, texts of any length stay whole, an empty table gives none; other columns
    are not read.
    """
    turns = turns.select("conv_id", "turn", F.make_valid_utf8("role").alias("role"), F.make_valid_utf8("text").alias("text"))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    masked = role == "assistant"
    rows = turns.select("conv_id", "turn", "role", "text", head.alias("head"), escape(text).alias("body"), masked.alias("masked"))
    return rows.select(
        "conv_id",
        "turn",
        F.concat("head", "body", F.lit(END + "\n")).alias("segment"),
        F.when(F.col("masked"), F.length("head")).alias("loss_start"),
        F.when(F.col("masked"), F.length("body")).alias("loss_length"),
        F.coalesce("role", F.lit("")).alias("order_role"),
        F.coalesce("text", F.lit("")).alias("order_text"),
    )


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_SEGMENT = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n\Z", re.S)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, parsed from its formatted segments; see READ.

    Segments are streamed in order through running digests, so a conversation of any length takes bounded memory; as a
    digest is one sequence, it is one task's. Null conversation ids are one conversation; an empty table gives no rows.
    """
    small_batches(formatted.sparkSession)
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "order_role", "order_text").select("conv_id", "segment", "loss_start", "loss_length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, loss, n, masked, chars = (), None, None, 0, 0, 0
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            names = READ.replace(",", "").split()
            kinds = [pa.string() if k == "string" else pa.int64() for k in names[1::2]]
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kind) for k, kind in enumerate(kinds)], names[::2])
            done.clear()
            return out

        for batch in batches:
            for conv, segment, at, length in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if now != (conv,):
                    if now:
                        done.append((*now, n, turns.hexdigest(), masked, loss.hexdigest(), chars))
                    now, turns, loss, n, masked, chars = (conv,), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                role, body = _SEGMENT.match(segment).groups()
                turns.update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
                if at is not None:
                    said = unescape(segment[at : at + length])
                    loss.update(said.encode())
                    masked += len(said)
                n += 1
                chars += len(segment)
            yield flush()
        if now:
            done.append((*now, n, turns.hexdigest(), masked, loss.hexdigest(), chars))
            yield flush()

    return ordered.mapInArrow(run, READ)


SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(length(role) + 12 + 1 + 10 + 1 + length(regexp_replace(text,
           '([<\\[])(\\\\*)(\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|\\|startoftext\\|>|s>|/s>|INST\\]|/INST\\]|<SYS>>|</SYS>>|\\|system\\|>|\\|user\\|>|\\|assistant\\|>)', '\\1+\\2\\3', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
