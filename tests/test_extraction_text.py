"""Bounded texts, chunks and halves against plain versions of their rules."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from papyra.functions import extraction_text as x


def plain_text(text, most, words=x.KEYWORDS, window=x.WINDOW):
    """Excerpts one after the other until there is no room."""
    if len(text) <= most:
        return text
    head, tail = most // 3, most // 6
    pieces, seen = [text[:head].strip()], set()
    spans = (m.span() for w in words for m in re.finditer(w, text, re.I))
    while sum(map(len, pieces)) < most - tail or len(pieces) == 1:
        nxt = next(((a, b) for a, b in spans if (max(0, a - window // 2), min(len(text), b + window // 2)) not in seen), None)
        if nxt is None:
            break
        seen.add(w := (max(0, nxt[0] - window // 2), min(len(text), nxt[1] + window // 2)))
        pieces.append(text[w[0] : w[1]].strip())
    return x.BETWEEN.join(p for p in [*pieces, text[-tail:].strip()] if p)[:most]


def plain_chunks(text, budget, overlap=900, most=8):
    """Units packed as strings."""
    if len(text) <= budget:
        return [text]
    out, held = [], ""
    for unit in filter(None, (u.strip() for u in re.split(x.UNITS, text))):
        if len(unit) > budget:
            out += [held.strip()] if held else []
            out += [p for i in range(0, len(unit), budget - overlap) if (p := unit[i : i + budget].strip())]
            held = ""
        elif held and len(held) + 2 + len(unit) > budget:
            out.append(held.strip())
            held = ((held[-overlap:] if overlap else "") + "\n\n" + unit).strip()
        else:
            held = f"{held}\n\n{unit}".strip() if held else unit
    out += [held.strip()] if held.strip() else []
    return out if len(out) <= most else [out[round(i * (len(out) - 1) / (most - 1))] for i in range(most)]


def papers():
    r = random.Random(9)
    words = "reward value method survey Table 3 baseline proof SARSA agents learn slowly from the past and TD(lambda) Q-learning fails é 漢".split()
    out = ["", "short", "a\n\nb", "x" * 5000, "no keyword here " * 400, "  \n\n  ".join("y" * r.randint(1, 300) for _ in range(40))]
    for _ in range(14):
        parts = []
        for k in range(r.randint(1, 12)):
            parts.append(f"{k}.{r.randint(1, 9)} A Heading of some {r.choice(words)}")
            parts.append(" ".join(r.choice(words) for _ in range(r.randint(3, 260))))
        out.append(r.choice(["\n", "\n\n", "\n \n"]).join(parts))
    return [t.strip() for t in out]


def column(spark, values, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(values)], "i int, t string").select("i", f(F.col("t")).alias("o"))
    return [r["o"] for r in rows.orderBy("i").collect()]


@pytest.mark.parametrize("most", [600, 2400, 5000])
def test_bounded_text(spark, most):
    assert column(spark, papers(), lambda c: x.extraction_text(c, most)) == [plain_text(t, most) for t in papers()]


@pytest.mark.parametrize(("budget", "overlap", "most"), [(700, 100, 8), (300, 0, 4), (1500, 900, 3), (250, 90, 100)])
def test_chunks(spark, budget, overlap, most):
    got = column(spark, papers(), lambda c: x.extraction_chunks(c, max_chars=budget, overlap=overlap, most=most))
    assert got == [plain_chunks(t, budget, overlap, most) for t in papers()]


def test_budget_of_a_context(spark):
    assert [x.chunk_budget(c) for c in (16_384, 32_768, 4096, 0, None, "no")] == [13_980, 18_000, 6000, 6000, 18_000, 18_000]
    text = ("A section about neural networks.\n\n" * 2000).strip()
    chunks = column(spark, [text], lambda c: x.extraction_chunks(c, 16_384))[0]
    assert 1 < len(chunks) <= 8 and max(map(len, chunks)) <= x.chunk_budget(16_384)


def test_halves(spark):
    long = "Homeostasis controls drives. " * 95 + "\n\n" + "Appraisal dimensions include novelty. " * 95
    texts = [None, "", "abcd", long, "a\n\nb\n \nc", "\n\na", "ab\n\n\n\ncd", "x" * 9]
    got = column(spark, texts, x.structural_halves)
    assert got[0] == got[1] == [""] and got[2] == ["ab", "cd"] and got[7] == ["xxxx", "xxxxx"]
    assert [h[:4] for h in got[3]] == ["Home", "Appr"] and got[4] == ["a\n\nb", "c"] or got[4] == ["a", "b\n \nc"]
    assert got[5] == ["a"] or "".join(got[5]) == "a"
    assert got[6] == ["ab", "cd"]


def test_cleaned_source(spark):
    said = [
        "The Modi --- PAGE BREAK --- Cation of rewards", "classi\fFication and quanti Zation", "moti\n---PAGE BREAK---\nTion here", "one\f\f\ftwo", "a \t b\n\n\n\nc", "learn --- Page Break --- ING and abc \f Tion \f Ment", None, "ﬁne—tuning", "ab Tion",
    ]
    assert column(spark, said, x.clean_source) == [
        "The Modification of rewards", "classification and quantization", "motition here", "one\n\ntwo", "a b\n\nc", "learning and abction \n\n Ment", "", "fine-tuning", "ab Tion",
    ]


def test_hints_and_context(spark):
    labels = [f"Label {k}" for k in range(30)]
    rows = spark.createDataFrame([("label 1 and LABEL 2", labels), (" ".join(labels).lower(), labels), (None, labels[:3])], "c string, l array<string>")
    got = [r["h"] for r in rows.select(x.hints_for_chunk(F.col("c"), F.col("l")).alias("h")).collect()]
    assert got == [labels[:24], labels[:24], labels[:3]]
    items = spark.createDataFrame([([("a", "", "d" * 200), ("b", "c", None)],)], "i array<struct<label:string,context:string,description:string>>")
    row = items.select(x.compact_context(F.col("i"), 60).alias("o")).first()["o"]
    assert [tuple(r) for r in row] == [("a", "d" * 160), ("b", "c")]
