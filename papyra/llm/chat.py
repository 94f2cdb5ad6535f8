"""Operator 2: chat formatting by schema fingerprints.

Nested field paths of a record (``messages[].role``) are hashed; the hash of all of them selects
a declarative mapping, which says where turns, roles and texts are. Where no mapping has just
these paths, the one with the most paths that are all there is taken. Every layout becomes
canonical turns (role, text), and a template turns these into marked text:

    ### role: text</turn>\\n

Inside roles and texts a backslash is doubled, one is put between two ``#``, into ``</`` and,
in roles, before ``:``. So no mark occurs inside a text, and dropping each backslash but for the
character after it restores the text. Formatting is a projection of one row at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table


class Mapping(NamedTuple):
    """paths: the fields a layout has. turns: (fixed role or path of the role, path of the text) of each turn; paths that begin with a list's name and [] give a turn for each of its elements. rows: for tables of one turn a row, the columns of conversation, position, role and text."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    rows: tuple[str, str, str, str] | None = None


#: Declared layouts. A role that is no path of the layout is that role.
MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), (("messages[].role", "messages[].content"),)),
    Mapping("system and messages", ("system", "messages[].role", "messages[].content"), (("system", "system"), ("messages[].role", "messages[].content"))),
    Mapping("from and value", ("conversations[].from", "conversations[].value"), (("conversations[].from", "conversations[].value"),)),
    Mapping("prompt and completion", ("prompt", "completion"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt and response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Mapping("question and answer", ("question", "answer"), (("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction with input", ("instruction", "input", "output"), (("user", "instruction+input"), ("assistant", "output"))),
    Mapping("rows by turn", ("conv_id", "turn", "role", "text"), rows=("conv_id", "turn", "role", "text")),
)
#: Other names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}
TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): (.*?)</turn>\n", re.S)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def value_paths(value: Any, at: str = "") -> set[str]:
    """Field paths of a parsed record; list elements are told by [], not by place."""
    if isinstance(value, dict):
        return set().union(*(value_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(value_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Field paths of a Spark schema, as value_paths() would give them for its rows."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


@lru_cache
def by_fingerprint(mappings: tuple[Mapping, ...]) -> dict[str, Mapping]:
    return {fingerprint(m.paths): m for m in mappings}


def select_mapping(paths: set[str], mappings: Iterable[Mapping] = MAPPINGS) -> Mapping | None:
    mappings = tuple(mappings)
    exact = by_fingerprint(mappings).get(fingerprint(paths))
    if exact:
        return exact
    fit = [m for m in mappings if set(m.paths) <= paths]
    return max(fit, key=lambda m: (len(m.paths), m.name)) if fit else None


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    out = []
    for role, text in mapping.turns:
        if "[]" in text:
            field, key = text.split("[].", 1)
            who = role.split("[].", 1)[1] if "[]" in role else None
            for x in record.get(field) or []:
                if isinstance(x, dict):
                    out.append((_text(x.get(who)) if who else role, _text(x.get(key))))
        else:
            parts = [_text(record.get(p)) for p in text.split("+")]
            text_ = "\n".join(p for p in parts if p)
            if text_ or role != "system":
                out.append((role, text_))
    return [(ROLES.get(r.lower(), r.lower()), t) for r, t in out]


def canonical_turns(records: DataFrame, *, id_col: str = "id", json_col: str = "record") -> DataFrame:
    """id_col, fingerprint, mapping, turn, role, text: a row for each turn of JSON records.

    Records that aren't objects, or that no mapping fits, give one row with a null mapping and
    turn, so that none is lost without a trace. Null texts are empty.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, raw in zip(b.column("id").to_pylist(), b.column("record").to_pylist(), strict=True):
                try:
                    record = json.loads(raw or "")
                except ValueError:
                    record = None
                paths = value_paths(record) if isinstance(record, dict) else set()
                mapping = select_mapping(paths) if paths else None
                turns = turns_of(record, mapping) if mapping and mapping.turns else []
                rows = [(key, fingerprint(paths), mapping.name, i, r, t) for i, (r, t) in enumerate(turns)]
                out += rows or [(key, fingerprint(paths), None, None, None, None)]
            names = ["id", "fingerprint", "mapping", "turn", "role", "text"]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    rows = records.select(F.col(id_col).cast("string").alias("id"), F.col(json_col).alias("record"))
    return rows.mapInArrow(run, "id string, fingerprint string, mapping string, turn int, role string, text string").withColumnRenamed("id", id_col)


def from_rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table whose schema's fingerprint selects a mapping of rows. Null roles and texts are empty."""
    mapping = select_mapping(schema_paths(turns.schema), [m for m in MAPPINGS if m.rows])
    if mapping is None or mapping.rows is None:
        raise ValueError(f"no mapping of rows fits the columns {turns.columns}")
    conv, at, role, text = mapping.rows
    return turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(at).cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _escaped(x: Column) -> Column:
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for _ in range(2):  # the second pass is for the pairs that the first one made
        x = F.replace(x, F.lit("##"), F.lit("#\\#"))
    return F.replace(x, F.lit("</"), F.lit("<\\/"))


def formatted(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with formatted, its marked text, and loss_from, loss_to: the characters of it that a loss covers (the assistant's text; none: equal).

    The text of a conversation is the join of its rows in order of turn, role and text (repeated
    rows are turns of their own).
    """
    out = turns.withColumn("body", _escaped(F.col("text")))
    lead = F.concat(F.lit("### "), F.replace(_escaped(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(": "))
    out = out.withColumns({"formatted": F.concat(lead, F.col("body"), F.lit("</turn>\n")), "loss_from": F.length(lead)})
    return out.withColumn("loss_to", F.col("loss_from") + F.when(F.col("role") == "assistant", F.length("body")).otherwise(0)).drop("body")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_back(marked: str) -> list[tuple[str, str]]:
    """The turns of formatted text."""
    return [(unescaped(r), unescaped(t)) for r, t in TURN.findall(marked)]


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(marked: DataFrame) -> DataFrame:
    """A row for each conversation, read back from formatted(): DIGEST.

    A digest takes a conversation's turns one after the other, so a conversation is read in one
    task, row by row from sorted input: what is held is one batch and two running hashes.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, now, done = False, None, []

        def close() -> None:
            if open_:
                done.append((now, n, turns.hexdigest(), lost, loss.hexdigest(), size))

        for b in batches:
            for conv, text, a, z in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to")), strict=True):
                if not open_ or conv != now:
                    close()
                    open_, now, n, lost, size, turns, loss = True, conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, said in read_back(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                under = unescaped(text[a:z])
                lost += len(under)
                loss.update(under.encode())
                size += len(text)
            if len(done) >= 1000:
                yield _batch(done)
                done = []
        close()
        yield _batch(done)

    rows = marked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(run, DIGEST)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in DIGEST.split(", ")])


#: A conversation that quotes the template's own marks.
QUOTED = "\\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(QUOTED).alias("text"))
    return conversation_digests(formatted(from_rows(table(spark, sf_dir, "conversations")).union(extra)))


_ESC = r"replace(replace(replace(replace({x}, '\', '\\'), '##', '#\#'), '##', '#\#'), '</', '<\/')"
OP2_SQL = rf"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || replace({_ESC.format(x="role")}, ':', '\:') || ': ' || {_ESC.format(x="text")}) + 8) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
