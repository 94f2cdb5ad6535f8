"""Operator 3: toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, digits that stand for letters), then an Aho-Corasick
automaton finds lexicon entries in one pass. An entry is a whole word or the stem that words
begin with; of the entries at one place the heaviest counts, and none inside an exception
phrase. The summed weight is divided by a measure of the text's length.

Entries and weights come from labelled training rows: log odds of words and stems. An entry is
kept if the evidence for it (log likelihood ratio) beats the number of terms tested, so that
chance doesn't make any, and if different words stand beside it, so that a toxic text's copies
don't. Exception phrases are learned as well: an entry with the word beside it, where that pair
is found in clean texts only. Further ones can be given.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_rows, checkpointed, give_back, held_out, id_type, make_room, table

# Letters of other scripts that look like Latin ones, each above its look-alike.
LOOKALIKES = "аАеЕоОрРсСуУхХіІјЈѕЅһԁԛԝкКмМтТвВнНοΟαΑνΝιΙρΡκΚτΤυΥχΧεΕηΗ"
LATIN = "aaeeooppccyyxxiijjsshdqwkkmmttbbhhooaavviippkkttyyxxeehh"
#: Digits and signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
#: Phrases whose words aren't meant as abuse, beside those that are learned.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown car", "sore loser clause", "idiot proof", "idiot-proof")
#: Clean texts that a pair of words must be in, and toxic ones in none, to be an exception.
EXCEPTION_TEXTS = 3
FULL_WIDTH = {0xFF01 + i: chr(0x21 + i) for i in range(94)}
INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD])
FOLD = {**dict(zip(map(ord, LOOKALIKES), LATIN, strict=True)), **FULL_WIDTH, **INVISIBLE}
FOLDABLE = re.compile("[" + re.escape("".join(map(chr, FOLD))) + "]")
#: A sign or digit is read as a letter only with a letter beside it.
SIGN = re.compile(r"(?<=[^\W\d_])[013457@]+(?=[^\W\d_])|\b[013457@]+(?=[^\W\d_])|(?<=[^\W\d_])[013457]+\b|\$(?=[^\W\d_])")
LETTER = str.maketrans({**SIGNS, "$": "s"})
WORD = re.compile(r"[^\W_]+")
STEMS = (4, 5, 6, 7)
#: Characters that count as a word when a text's length is taken.
WORD_CHARS = 7


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii() and FOLDABLE.search(text):
        text = text.translate(FOLD).lower()
    if SIGN.search(text):
        text = SIGN.sub(lambda m: m[0].translate(LETTER), text)
    return text


def word_counts(train: DataFrame) -> DataFrame:
    """word, pos, neg: distinct training texts with each folded word, by label. train: text, label."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                seen[label].update(set(WORD.findall(fold(text or ""))))
            words = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, "string"), "pos": pa.array([seen[1][w] for w in words], "int64"), "neg": pa.array([seen[0][w] for w in words], "int64")})

    return train.select("text", "label").mapInArrow(count, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def training_texts(train: DataFrame) -> DataFrame:
    """id, text and label of each text of train (text, label): copies of a text count once, since they say no more about its words; where their labels differ it is toxic. Rows without a label are left out."""
    rows = train.filter(F.col("label").isNotNull()).select(F.md5(F.coalesce("text", F.lit(""))).alias("id"), "text", F.col("label").cast("int").alias("label"))
    return rows.groupBy("id").agg(F.any_value("text").alias("text"), F.max("label").alias("label"))


def learn_lexicon(train: DataFrame) -> list[tuple[str, bool, float]]:
    """(entry, whether it is a whole word, weight), heaviest first: all that pass the tests, which the bound on training rows bounds.

    train: text, label (0 or 1), as training_texts() takes them. Without texts of both labels
    there are no entries.
    """
    rows = checkpointed(training_texts(train))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return []
    words = checkpointed(word_counts(rows))
    stems = [F.struct(F.substring("word", 1, k).alias("term"), F.lit(False).alias("whole")) for k in STEMS]
    terms = F.filter(F.array(F.struct(F.col("word").alias("term"), F.lit(True).alias("whole")), *stems), lambda x: x["whole"] | (F.length(x["term"]) < F.length("word")))
    counted = words.select("pos", "neg", F.explode(terms).alias("t")).filter(F.length("t.term") >= 3).groupBy("t.term", "t.whole").agg(F.least(F.sum("pos"), F.lit(pos)).alias("p"), F.least(F.sum("neg"), F.lit(neg)).alias("n"))
    counted = checkpointed(counted.filter("p > 0"))
    share = pos / (pos + neg)
    log = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    both = F.col("p") + F.col("n")
    evidence = log(F.col("p"), both * share) + log(F.col("n"), both * (1 - share))
    needed = math.log(max(2, counted.count())) + 2
    scored = counted.withColumn("evidence", evidence).filter((F.col("p") >= 3) & (F.col("p") > both * share) & (F.col("evidence") > needed))
    found = scored.collect()
    free = spread(rows.filter("label = 1"), {(r["term"], r["whole"]) for r in found})
    return purest([(r["term"], r["whole"], r["p"], r["n"]) for r in found if free.get((r["term"], r["whole"]), 0.0) >= LEAST_SPREAD])


#: Effective number of neighbouring words that an entry must have had on either side.
LEAST_SPREAD = 3.5
#: Share of toxic texts among those with an entry from which its longer forms add nothing, and the least share of any entry.
PURE, LEAST_SHARE = 0.97, 0.5


def spread(toxic: DataFrame, terms: set[tuple[str, bool]]) -> dict[tuple[str, bool], float]:
    """How many different words stand beside each term in toxic texts: the smaller, over both sides, of the effective numbers (inverse sums of squared shares).

    Words of a text that went round in edited copies stand beside the same words again and
    again; words of abuse stand anywhere. terms is bounded by the size of the lexicon.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for text in b.column("text").to_pylist():
                words = WORD.findall(fold(text or ""))
                once = set()
                for i, w in enumerate(words):
                    for t in ((w, True), *((w[:k], False) for k in STEMS if k < len(w))):
                        if t in terms and t not in once:
                            once.add(t)
                            seen[(*t, 0, words[i - 1] if i else "")] += 1
                            seen[(*t, 1, words[i + 1] if i + 1 < len(words) else "")] += 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], "string"), pa.array([k[1] for k in keys], "bool"), pa.array([k[2] for k in keys], "int32"), pa.array([k[3] for k in keys], "string"), pa.array([seen[k] for k in keys], "int64")], names=["term", "whole", "side", "beside", "n"])

    pairs = toxic.select("text").mapInArrow(run, "term string, whole boolean, side int, beside string, n long").groupBy("term", "whole", "side", "beside").agg(F.sum("n").cast("double").alias("n"))
    sides = pairs.groupBy("term", "whole", "side").agg((F.pow(F.sum("n"), F.lit(2)) / F.sum(F.col("n") * F.col("n"))).alias("e"))
    return {(r["term"], r["whole"]): r["e"] for r in sides.groupBy("term", "whole").agg(F.min("e").alias("e")).collect()}


def purest(found: list[tuple[str, bool, int, int]]) -> list[tuple[str, bool, float]]:
    """(entry, whole, weight) of (entry, whole, toxic, clean): entries that are nearly only toxic, without longer forms that add little; of others what such forms leave, if more than half is toxic. The weight is the log odds of a text with the entry."""
    kept: list[tuple[str, bool, int, int]] = []
    rest = []
    for term, whole, p, n in sorted(found, key=lambda x: (len(x[0]), x[1], x[0])):
        if any(not w and term.startswith(t) for t, w, _, _ in kept):
            continue
        if (p + 0.5) / (p + n + 1) >= PURE or (n == 0 and p >= 3):
            # The longest form that nearly all of its texts have says as much and less besides.
            kept.append(max((x for x in found if x[0].startswith(term) and x[2] >= PURE * p and x[3] <= n and (x[1] or not whole)), key=lambda x: (len(x[0]), x[1])))
        else:
            rest.append((term, whole, p, n))
    for term, whole, p, n in sorted(rest, key=lambda x: (-len(x[0]), x[1], x[0])):
        if any(not w and term.startswith(t) for t, w, _, _ in kept):
            continue
        inside = [x for x in kept if x[0].startswith(term) and not whole]
        p, n = p - sum(x[2] for x in inside), n - sum(x[3] for x in inside)
        if p >= 3 and p > LEAST_SHARE * (p + n):
            kept.append((term, whole, p, max(0, n)))
    return sorted({(t, w, math.log((p + 0.5) / (n + 0.5))) for t, w, p, n in kept}, key=lambda x: (-x[2], x[0], x[1]))


def learn_exceptions(train: DataFrame, lexicon: list[tuple[str, bool, float]], *, texts: int = EXCEPTION_TEXTS) -> list[str]:
    """Pairs of folded words, one of which an entry matches, that so many clean training texts have and no toxic one."""
    whole, stems = {t for t, w, _ in lexicon if w}, {t for t, w, _ in lexicon if not w}
    sizes = sorted({len(t) for t in stems})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                words = WORD.findall(fold(text or ""))
                hit = [w in whole or any(w[:k] in stems for k in sizes) for w in words]
                seen[label].update({f"{a} {z}" for a, z, x, y in zip(words, words[1:], hit, hit[1:], strict=False) if x or y})
            pairs = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_pydict({"pair": pa.array(pairs, "string"), "pos": pa.array([seen[1][p] for p in pairs], "int64"), "neg": pa.array([seen[0][p] for p in pairs], "int64")})

    counted = training_texts(train).select("text", "label").mapInArrow(run, "pair string, pos long, neg long").groupBy("pair").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return sorted(r["pair"] for r in counted.filter((F.col("pos") == 0) & (F.col("neg") >= texts)).collect())


class Scorer:
    def __init__(self, lexicon: list[tuple[str, bool, float]], exceptions: Iterable[str] = EXCEPTIONS):
        import ahocorasick

        entries: dict[str, list[tuple[bool, float]]] = {}
        for term, whole, weight in lexicon:
            # A folded digit one is an i, also where it stands for an l.
            for form in {term, term.replace("l", "i")}:
                entries.setdefault(form, []).append((whole, weight))
        self.found = ahocorasick.Automaton()
        for form, uses in entries.items():
            self.found.add_word(form, (len(form), uses))
        self.empty = not entries
        if entries:
            self.found.make_automaton()
        self.excepted = re.compile("|".join(rf"\b{re.escape(fold(p))}\b" for p in exceptions) or r"(?!)")

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the heaviest entry at each place of the folded text."""
        best: dict[int, tuple[int, float]] = {}
        n = len(text)
        for end, (size, uses) in self.found.iter(text):
            start = end - size + 1
            if start and text[start - 1].isalnum():
                continue
            closed = end + 1 == n or not text[end + 1].isalnum()
            for whole, weight in uses:
                if (closed or not whole) and weight > best.get(start, (0, 0.0))[1]:
                    best[start] = (end + 1, weight)
        if best:
            for m in self.excepted.finditer(text):
                for start in [s for s in best if m.start() <= s < m.end()]:
                    del best[start]
        return [(s, e, w) for s, (e, w) in sorted(best.items())]

    def score(self, text: str) -> float:
        """0 to 1; 0 for an empty text. Length counts as characters, so that it doesn't matter what stands between words."""
        if self.empty or not text:
            return 0.0
        folded = fold(text)
        total = sum(w for _, _, w in self.matches(folded))
        return 1.0 - math.exp(-total / (1.0 + 0.2 * math.log1p(len(folded) / WORD_CHARS))) if total else 0.0


def score_toxicity(docs: DataFrame, lexicon: list[tuple[str, bool, float]], *, exceptions: Iterable[str] = EXCEPTIONS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col and score for each row of docs.

    Null and empty texts score 0; repeated rows are scored one by one; an empty lexicon scores
    everything 0; further columns are left out, whatever their names.
    """
    held: list[Scorer] = []
    exceptions = tuple(exceptions)

    def of(texts: list[str]) -> list[tuple]:
        if not held:
            held.append(Scorer(lexicon, exceptions))
        return [(held[0].score(t),) for t in texts]

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind, arrow = id_type(rows, "doc_id")
    schema = pa.schema([("doc_id", arrow), ("score", "float64")])
    return rows.mapInArrow(by_rows(of, schema), f"doc_id {kind}, score double").withColumnRenamed("doc_id", id_col)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = 20_000) -> DataFrame:
    """text and label of labelled rows that may be learned from: of ``rows`` ids at most, those whose hashes are least.

    That bound makes the ids small enough to broadcast, so that no text is shuffled for the join.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")


def learned(spark: SparkSession, sf_dir: str) -> tuple[list[tuple[str, bool, float]], list[str]]:
    """Lexicon and exceptions from the labels of the raw tables."""
    train = checkpointed(training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic"))
    lexicon = learn_lexicon(train)
    return lexicon, [*EXCEPTIONS, *learn_exceptions(train, lexicon)]


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon, exceptions = learned(spark, sf_dir)
    scored = score_toxicity(table(spark, sf_dir, "documents"), lexicon, exceptions=exceptions)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that score 0.3 or more, by a lexicon learned from the raw tables' labels. Rows go one by one, whatever their ids; null and empty texts stay."""
    lexicon, exceptions = learned(spark, sf_dir)
    held: list[Scorer] = []

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        if not held:
            held.append(Scorer(lexicon, exceptions))
        for b in batches:
            yield b.filter(pa.array([held[0].score(t or "") < 0.3 for t in b.column("text").to_pylist()], "bool"))
            give_back()

    return docs.mapInArrow(keep, docs.schema)
