"""The text of a paper that an extraction reads: cleaned, bounded, in chunks, halved. Column in, Column out, all in the JVM.

Places of matches come from the lengths of what lies between them, so nothing is looked for twice,
and texts are cut by places only once these are settled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .recovery import scientific_text

# What marks a page's end, and word ends that a break cuts off: those that a page break does, and those that spaces do.
PAGE_BREAK = r"(?:---\s*PAGE\s*BREAK\s*---|---\s*Page\s*Break\s*---|\f)"
CUT_BY_PAGES = "Cation Fication Tion Zation Sation Ment Ness Able Ible Ing Ed Al Ity".split()
CUT_BY_SPACES = "Cation Fication Tion Zation Sation".split()
# Words around which a long text is read, in order; characters of such a window; and the line between pieces.
KEYWORDS = (
    r"Q[\s-]?learning",
    r"SARSA",
    r"TD\s*\(?\s*(?:lambda|\\lambda|λ)\s*\)?",
    r"REINFORCE",
    r"Actor[-\s]?Critic",
    r"Dynamic Programming",
    r"baseline",
    r"taxonomy",
    r"survey",
    r"method",
    r"Table\s+\d+",
    r"equation|formula|theorem|proof",
)
WINDOW = 1800
BETWEEN = "\n\n---\n\n"
#: Letters of the shortest keyword: a window is at least as long.
SHORTEST = 5
# The budget of a chunk in characters, from a context in tokens.
LEAST_CONTEXT, PROMPT_TOKENS, LEAST_TOKENS, CHARS_A_TOKEN, LEAST_CHARS, MOST_CHARS = 4096, 5200, 1200, 1.25, 6000, 18000
# Fixed value: where a text falls into units, at page breaks and before numbered headings.
UNITS = r"\n\s*(?:---PAGE BREAK---|\f)\s*\n|\n(?=\d+(?:\.\d+)*\s+[A-Z][^\n]{3,100}\n)"
#: White space of all scripts.
SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def _rejoined(text: Column, between: str, ends: list[str]) -> Column:
    """Words whose end stands behind a break, with that end in small letters. One pass marks them, so an end that was joined begins no other match."""
    marked = F.regexp_replace(text, rf"(?iU)\b([A-Za-z]{{3,}}){between}({'|'.join(ends)})\b", "$1\x01$2\x02")
    return reduce(lambda t, end: F.regexp_replace(t, f"(?i)\x01{end}\x02", end.lower()), ends, marked)


def clean_source(text: Column) -> Column:
    """A parsed text without marks of page breaks and without the cuts that they made in words; null: empty."""
    t = scientific_text(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, rf"(?iU)\bModi\s*{PAGE_BREAK}\s*Cation\b", "Modification")
    t = _rejoined(t, rf"\s*{PAGE_BREAK}\s*", CUT_BY_PAGES)
    t = F.regexp_replace(t, f"(?iU){PAGE_BREAK}", "\n\n")
    t = F.regexp_replace(t, r"(?iU)\bModi\s+Cation\b", "Modification")
    t = _rejoined(t, r"\s+", CUT_BY_SPACES)
    return strip(F.regexp_replace(F.regexp_replace(t, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def _between(text: Column, pattern: str, most: int | None = None) -> Column:
    """gap (characters before a match since the last) and own (its own) of the first matches."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    hits = F.slice(hits, 1, most) if most else hits
    return F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("own")))


SPAN = "array<struct<s:int,e:int>>"


def spans(text: Column, pattern: str, most: int | None = None) -> Column:
    """Places (s, e; from 0) of the first matches."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))
    end = F.aggregate(
        _between(text, pattern, most), start, lambda a, x: F.struct((a["at"] + x["gap"] + x["own"]).alias("at"), F.array_append(a["found"], F.struct((a["at"] + x["gap"]).alias("s"), (a["at"] + x["gap"] + x["own"]).alias("e"))).alias("found"))
    )
    return end["found"]


def _piece(text: Column, span: Column) -> Column:
    return strip(F.substr(text, span["s"] + 1, span["e"] - span["s"]))


def extraction_text(text: Column, max_chars: int = 60_000) -> Column:
    """A cleaned text (from clean_source()) of so many characters at most: whole if it is short, else its first third, windows around keywords in their order while there is room, and its last sixth."""
    head, tail = max_chars // 3, max_chars // 6
    room = max_chars - tail
    size = F.length(text)
    around = lambda s: F.struct(F.greatest(F.lit(0), s["s"] - WINDOW // 2).alias("s"), F.least(size, s["e"] + WINDOW // 2).alias("e"))
    first = strip(F.substring(text, 1, head))
    # As every window has SHORTEST characters, no more of them can be wanted.
    windows = F.array_distinct(F.flatten(F.array(*[F.transform(spans(text, f"(?iU){k}", -(-room // SHORTEST)), around) for k in KEYWORDS])))
    grown = lambda a, w: F.when(a["total"] < room, F.struct((a["total"] + F.length(_piece(text, w))).cast("int").alias("total"), (a["n"] + 1).cast("int").alias("n"))).otherwise(a)
    taken = F.aggregate(windows, F.struct(F.length(first).cast("int").alias("total"), F.lit(0).alias("n")), grown)["n"]
    pieces = F.concat(F.array(first), F.transform(F.slice(windows, F.lit(1), taken), lambda w: _piece(text, w)), F.array(strip(F.substr(text, size - tail + 1))))
    return F.when(size <= max_chars, text).otherwise(F.substring(F.array_join(F.filter(pieces, lambda p: p != ""), BETWEEN), 1, max_chars))


def chunk_budget(context_size: object = 32_768) -> int:
    """Characters of a chunk for a model's context in tokens; a size that is no number counts as 32,768."""
    try:
        context = max(LEAST_CONTEXT, int(context_size))
    except (TypeError, ValueError):
        context = 32_768
    return max(LEAST_CHARS, min(MOST_CHARS, int(max(LEAST_TOKENS, context - PROMPT_TOKENS) * CHARS_A_TOKEN)))


def _packed(joined: Column, units: Column, budget: int, overlap: int) -> Column:
    """Places of chunks in units joined by blank lines: units in order while they fit, then anew, from ``overlap`` characters before on; a unit that doesn't fit is cut by itself.

    A chunk is always a stretch of the joined text, so the state is a few numbers.
    """
    blank = lambda s, n: F.length(F.substr(joined, s + 1, F.lit(n))) - F.length(F.ltrim(F.substr(joined, s + 1, F.lit(n)), F.lit(SPACES)))
    span = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))
    state = lambda at, s, e, found: F.struct(at.cast("int").alias("at"), s.cast("int").alias("s"), e.cast("int").alias("e"), found.alias("found"))
    none = F.lit(-1)

    def step(a: Column, unit: Column) -> Column:
        n, at = F.length(unit), a["at"]
        end, held = at + n, a["s"] >= 0
        closed = F.when(held, F.array_append(a["found"], span(a["s"], a["e"]))).otherwise(a["found"])
        parts = F.transform(F.sequence(F.lit(0), n - 1, F.lit(budget - overlap)), lambda i: span(at + i, F.least(at + i + budget, end)))
        back = F.greatest(a["s"], a["e"] - overlap) if overlap else a["e"]
        anew = back + blank(back, overlap + 2)
        big = state(end + 2, none, none, F.concat(closed, parts))
        full = state(end + 2, anew, end, closed)
        more = state(end + 2, F.when(held, a["s"]).otherwise(at), end, a["found"])
        return F.when(n > budget, big).when(held & (end - a["s"] > budget), full).otherwise(more)

    last = F.aggregate(units, state(F.lit(0), none, none, F.array().cast(SPAN)), step)
    return F.when(last["s"] >= 0, F.array_append(last["found"], span(last["s"], last["e"]))).otherwise(last["found"])


def extraction_chunks(text: Column, context_size: object = 32_768, *, max_chars: int | None = None, overlap: int = 900, most: int = 8) -> Column:
    """A cleaned text in chunks of a model's context; of more than ``most`` those at even steps from the first to the last, half steps to the even side. An empty text is one empty chunk."""
    budget = max_chars or chunk_budget(context_size)
    units = F.filter(F.transform(F.split(text, f"(?U){UNITS}", -1), strip), lambda u: u != "")
    joined = F.array_join(units, "\n\n")
    found = F.filter(_packed(joined, units, budget, overlap), lambda s: _piece(joined, s) != "")
    n = F.size(found)
    steps = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(found, F.bround(i * (n - 1) / F.lit(float(max(1, most - 1)))).cast("int") + 1))
    chosen = F.when(n <= most, found).otherwise(steps)
    return F.when(F.length(text) <= budget, F.array(text)).otherwise(F.transform(chosen, lambda s: _piece(joined, s)))


def structural_halves(text: Column) -> Column:
    """A text in two, at the blank line nearest to its middle (the first of equals), or in the middle; a half of white space is left out, an empty text is one empty piece."""
    clean = strip(F.coalesce(text, F.lit("")))
    middle = F.floor(F.length(clean) / 2).cast("int")
    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("best"))

    def step(a: Column, x: Column) -> Column:
        here = a["at"] + x["gap"]
        nearer = (a["best"] < 0) | (F.abs(here - middle) < F.abs(a["best"] - middle))
        return F.struct((here + x["own"]).alias("at"), F.when(nearer, here).otherwise(a["best"]).alias("best"))

    best = F.aggregate(_between(clean, r"(?U)\n\s*\n"), start, step)["best"]
    at = F.when(best >= 0, best).otherwise(middle)
    halves = F.filter(F.array(strip(F.substr(clean, F.lit(1), at)), strip(F.substr(clean, at + 1))), lambda p: p != "")
    return F.when(clean == "", F.array(F.lit(""))).otherwise(halves)


def hints_for_chunk(chunk: Column, labels: Column, most: int = 24) -> Column:
    """The labels that a chunk holds in any case, the first ``most``; the first ``most`` of all labels where it holds fewer."""
    low = F.lower(F.coalesce(chunk, F.lit("")))
    held = F.filter(labels, lambda x: (x != "") & F.contains(low, F.lower(x)))
    return F.slice(F.when(F.size(held) >= most, held).otherwise(labels), 1, most)


def compact_context(items: Column, most: int, size: int = 160) -> Column:
    """The first ``most`` items (label, context, description) as label and a short context."""
    return F.transform(F.slice(items, 1, most), lambda x: F.struct(x["label"].alias("label"), F.substring(F.coalesce(F.nullif(x["context"], F.lit("")), x["description"], F.lit("")), 1, size).alias("context")))
