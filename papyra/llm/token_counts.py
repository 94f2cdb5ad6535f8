"""Operator 6: token counts by a compiled finite-state tokenizer.

The sentencepiece BPE model is compiled into a deterministic transducer whose transitions
carry the change of the token count (``automaton.PrefixMachine``, counted). A text is cut into
chunks at any place. A chunk's state map sends the state before it to the state after it and
the tokens emitted between. No token crosses the end of a word (a space mark after another
character, or a line feed), so all states meet there, and a map is kept as

    head: the text before the first such place;
    table: states before the chunk to (state after the head, tokens), for those that were tried;
    tail: (state, tokens) from there to the chunk's end, one for all states; none without such a place.

A table has the state that the characters before the chunk lead to. Any other state runs through
the head when it is asked for, so maps are exact whatever was tried. Composition is associative:
maps of neighbours are composed in rounds, as a parallel prefix scan does. Long texts are cut
into rows, whose maps different tasks make; all else is one pass over the scan.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterable, Iterator
from typing import TYPE_CHECKING, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import BEGIN
from .common import by_rows, id_type, table, text_key

if TYPE_CHECKING:
    from .tokenizer_files import PieceCounter

SPACE = "▁"
#: Words, with the space marks before them; the machine starts anew at each.
WORD = re.compile(f"[ {SPACE}]*[^ {SPACE}\n]+|\n|[ {SPACE}]+")
#: A place that no token crosses lies before each of these.
CUT = re.compile(f"(?<=[^ {SPACE}])[ {SPACE}]|(?<!^)\n|(?<=\n)(?!^).", re.S)
CHUNK = 65_536
#: Characters before a chunk that are run through to guess the state at its start.
BEFORE = 64
#: Texts of more characters are cut into rows.
LONG = 1 << 20
WORDS_KEPT = 150_000

#: What the last character was (nothing, space mark, line feed, other) and the machine's open beginnings.
State = tuple[str, tuple]
FIRST: State = ("", BEGIN)


class StateMap(NamedTuple):
    head: str
    table: dict[State, tuple[State, int]]
    tail: tuple[State, int] | None


class WordCounts(dict):
    """Counts of words already read; emptied when it holds too many. And the transducer over any text."""

    def __init__(self, counter: PieceCounter):
        self.counter = counter

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        n = self.counter.count_word(word.replace(" ", SPACE))
        if len(word) <= 40:
            self[word] = n
        return n

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state after a text that is read in a state, and the tokens emitted."""
        if not text:
            return state, 0
        kind, live = state
        words, n = WORD.findall(text), 0
        if (kind == "space" and text[0] != "\n") or (kind == "other" and text[0] not in f" {SPACE}\n"):
            live, n = self.counter.run(live, words[0].replace(" ", SPACE))  # the word goes on
            words = words[1:]
        if words:
            n += sum(map(self.__getitem__, words[:-1]))
            live, more = self.counter.run(BEGIN, words[-1].replace(" ", SPACE))
            n += more
        last = text[-1]
        return ("space" if last in (" ", SPACE) else "line" if last == "\n" else "other", live), n


def state_map(counts: WordCounts, chunk: str, before: str | None = None) -> StateMap:
    """The map of a chunk that stands behind some characters of a text; before: None at its beginning."""
    cut = CUT.search(chunk)
    head, tail = (chunk, None) if cut is None else (chunk[: cut.start()], counts.run(FIRST, chunk[cut.start() :]))
    guess = FIRST if before is None else counts.run(FIRST, before)[0]
    return StateMap(head, {guess: counts.run(guess, head)}, tail)


def applied(counts: WordCounts, m: StateMap, state: State) -> tuple[State, int]:
    after, n = m.table.get(state) or counts.run(state, m.head)
    return (after, n) if m.tail is None else (m.tail[0], n + m.tail[1])


def compose(counts: WordCounts, a: StateMap, b: StateMap) -> StateMap:
    """The map of a's chunk followed by b's."""
    if a.tail is not None:
        state, n = applied(counts, b, a.tail[0])
        return StateMap(a.head, a.table, (state, a.tail[1] + n))
    onward = {s: (b.table[t][0], n + b.table[t][1]) for s, (t, n) in a.table.items() if t in b.table}
    return StateMap(a.head + b.head, onward, b.tail)


def composed(counts: WordCounts, maps: list[StateMap]) -> StateMap:
    """One map of neighbouring ones, in rounds of pairs."""
    while len(maps) > 1:
        maps = [compose(counts, *maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def chunks_of(text: str, chunk: int) -> Iterator[tuple[str, str | None]]:
    """Chunks of a text with the model's leading space, and the characters before each."""
    text = " " + text
    for i in range(0, len(text), chunk):
        yield text[i : i + chunk], text[max(0, i - BEFORE) : i] if i else None


def count_text(counts: WordCounts, text: str, chunk: int = CHUNK) -> int:
    if not text:
        return 0
    if len(text) < chunk:
        return sum(map(counts.__getitem__, WORD.findall(" " + text)))
    return applied(counts, composed(counts, [state_map(counts, *c) for c in chunks_of(text, chunk)]), FIRST)[1]


def token_counts(docs: DataFrame, model_path: str, *, text_col: str = "text", id_col: str = "doc_id", limit: int = 4096, chunk: int = CHUNK, long: int = LONG) -> DataFrame:
    """id_col, n_bytes (UTF-8), n_tokens, over_limit for each row of docs.

    Null and empty texts count 0 bytes and 0 tokens; repeated rows are counted one by one;
    further columns are left out, whatever their names; an empty table gives an empty one. Texts
    of more than ``long`` characters are each read by many tasks, a text of several rows once.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind, arrow = id_type(rows, "doc_id")
    schema = pa.schema([("doc_id", arrow), ("n_bytes", "int64"), ("n_tokens", "int64"), ("over_limit", "bool")])
    found: dict[str, WordCounts] = {}

    def counts() -> WordCounts:
        if not found:
            from .tokenizer_files import piece_counter

            found["counts"] = WordCounts(piece_counter(model_path))
        return found["counts"]

    def of(texts: list[str]) -> list[tuple]:
        out = []
        for t in texts:
            n = count_text(counts(), t, chunk)
            out.append((len(t.encode("utf-8", "surrogatepass")), n, n > limit))
        return out

    size = F.length("text")
    short = rows if (rows.agg(F.max(size)).first()[0] or 0) <= long else rows.filter(F.coalesce(size <= long, F.lit(True)))
    out = short.mapInArrow(by_rows(of, schema), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    if short is not rows:
        out = out.union(_long_counts(rows.filter(size > long), counts, limit, chunk))
    return out.withColumnRenamed("doc_id", id_col)


def _long_counts(rows: DataFrame, counts: Callable[[], WordCounts], limit: int, chunk: int) -> DataFrame:
    """token_counts() of long texts: chunks are dealt out, their maps come back to be composed, and rows get what their text counts."""
    keyed = rows.select("doc_id", text_key(F.col("text")).alias("key"), F.octet_length("text").cast("long").alias("n_bytes"))
    texts = rows.groupBy(text_key(F.col("text")).alias("key")).agg(F.any_value("text").alias("text"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                for k, (part, before) in enumerate(chunks_of(text, chunk)):
                    yield pa.RecordBatch.from_pylist([{"key": key, "k": k, "part": part, "before": before}], schema=pa.schema([("key", "binary"), ("k", "int32"), ("part", "string"), ("before", "string")]))

    def maps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [pickle.dumps(tuple(state_map(counts(), p, q))) for p, q in zip(b.column("part").to_pylist(), b.column("before").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("k"), pa.array(made, "binary")], names=["key", "k", "map"])

    def total(t: pa.Table) -> pa.Table:
        parts = sorted(zip(t.column("k").to_pylist(), t.column("map").to_pylist(), strict=True))
        n = applied(counts(), composed(counts(), [StateMap(*pickle.loads(m)) for _, m in parts]), FIRST)[1]
        return pa.table({"key": t.column("key").slice(0, 1), "n_tokens": pa.array([n], "int64")})

    parts = texts.mapInArrow(cut, "key binary, k int, part string, before string").repartition("key", "k")
    sums = parts.mapInArrow(maps, "key binary, k int, map binary").groupBy("key").applyInArrow(total, "key binary, n_tokens long")
    return keyed.join(sums, "key").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
