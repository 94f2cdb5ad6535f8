"""What Spark has no function for: model output that is nearly JSON, Unicode folding (Arrow UDFs, one batch at a time); repair of broken encodings."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ligatures and dashes, and what they are written as.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
DASHES = "‐‑‒–—−"
# What broken encodings make of a letter, and the letter itself, in the order in which they go.
MOJIBAKE = {"ÃŽÂ»": "lambda", "Î»": "lambda", "λ": "lambda", "Â": ""}
# Characters that Windows-1252 has where Latin-1 has controls.
WINDOWS = {"€": 0x80, "‚": 0x82, "ƒ": 0x83, "„": 0x84, "…": 0x85, "†": 0x86, "‡": 0x87, "ˆ": 0x88, "‰": 0x89, "Š": 0x8A, "‹": 0x8B, "Œ": 0x8C, "Ž": 0x8E, "‘": 0x91, "’": 0x92, "“": 0x93, "”": 0x94, "•": 0x95, "–": 0x96, "—": 0x97, "˜": 0x98, "™": 0x99, "š": 0x9A, "›": 0x9B, "œ": 0x9C, "ž": 0x9E, "Ÿ": 0x9F}


def transcoded(text: Column) -> Column:
    """A text whose UTF-8 bytes were read as Windows-1252, as it was; other texts as they are.

    A text is only taken for broken if all of its characters have a byte there and these bytes
    are UTF-8 with a sequence of several; both ways are exact.
    """
    narrow = F.translate(text, "".join(WINDOWS), "".join(map(chr, WINDOWS.values())))
    broken = narrow.rlike(r"^[\x00-\xFF]*$") & narrow.rlike(r"[\xC2-\xF4][\x80-\xBF]")
    raw = F.encode(F.when(broken, narrow), "ISO-8859-1").cast("string")
    return F.coalesce(F.when(F.is_valid_utf8(raw), raw), text)


def scientific_text(text: Column) -> Column:
    """Ligatures written out, NFKC, known broken letters replaced, every dash a hyphen, soft hyphens gone."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    for mark, by in LIGATURES.items():
        text = F.replace(text, F.lit(mark), F.lit(by))
    text = nfkc(text)
    for mark, by in MOJIBAKE.items():
        text = F.replace(text, F.lit(mark), F.lit(by))
    return F.translate(text, DASHES + "­", "-" * len(DASHES))


def _balanced(text: str) -> str | None:
    """The first balanced object or array in a text, strings and escapes minded."""
    start = re.search(r"[\[{]", text)
    if not start:
        return None
    stack, quoted, skip = [], False, False
    for i in range(start.start(), len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
        elif c in "]}":
            if not stack or stack.pop() != c:
                return None
            if not stack:
                return text[start.start() : i + 1]
    return None


def _cut(text: str) -> str | None:
    """A text that stops early, shortened to its last whole value and closed.

    Commas outside strings are the cuts. Where one gives JSON, all before it do, so the last that
    does is found by halving.
    """
    start = re.search(r"[\[{]", text)
    text = text[start.start() :] if start else ""
    # A stack is its top and the stack below, so each comma can keep its own.
    stack, quoted, skip, cuts = None, False, False, []
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            stack = ("]" if c == "[" else "}", stack)
        elif c in "]}" and stack:
            stack = stack[1]
        elif c == ",":
            cuts.append((i, stack))
    found, low, high = None, 0, len(cuts)
    while low < high:
        mid = (low + high) // 2
        end, stack = cuts[mid]
        closed = [text[:end]]
        while stack:
            closed.append(stack[0])
            stack = stack[1]
        try:
            json.loads("".join(closed))
        except ValueError:
            high = mid
        else:
            found, low = "".join(closed), mid + 1
    return found


def recover(text: str | None) -> tuple[str | None, str]:
    """(JSON, quality): clean as it is, trimmed out of fences or prose, partial where the end is missing, failed."""
    if not text:
        return None, "failed"
    for quality, make in (("clean", lambda t: t), ("trimmed", lambda t: _balanced(re.sub(r"```(?:json)?", "", t))), ("partial", _cut)):
        part = make(text)
        if part is not None:
            try:
                json.loads(part)
            except ValueError:
                continue
            return part.strip(), quality
    return None, "failed"


def recovered_json(text: Column) -> Column:
    """Struct of json and parse_quality. What Spark parses is clean and isn't sent to Python."""

    @F.pandas_udf("json string, parse_quality string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([recover(t) for t in s], columns=["json", "parse_quality"])

    clean = F.try_parse_json(text).isNotNull()
    given = F.struct(F.trim(text).alias("json"), F.lit("clean").alias("parse_quality"))
    return F.when(clean, given).otherwise(run(F.when(~F.coalesce(clean, F.lit(False)), text)))


def table_lines(text: Column) -> Column:
    """Runs of lines with cell marks, as one block each."""
    marked = F.transform(F.split(text, "\n", -1), lambda x: F.when(F.contains(x, F.lit("|")) | F.contains(x, F.lit("\t")), x).otherwise(F.lit("\u0001")))
    blocks = F.split(F.array_join(marked, "\n"), "(?:\n?\u0001\n?)+")
    return F.filter(blocks, lambda b: F.trim(b) != "")
