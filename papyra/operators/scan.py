"""A scan of papers for what can be found without a model: known labels, short forms, headings, repeated phrases.

Patterns are data: a table with a row for each. Before any of them is run, a document's words are
cut into runs of letters, which are joined with the runs that patterns can't do without; only
patterns that meet a document are run on it. So a document costs what it holds, however many
patterns the table has.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scan_table as table
from ..functions.extraction_text import spans
from ..shared import kept, spread

from .entities import tight_key
from .graph_build import clean_label
from .linking import small

#: Letters of a run at least. Patterns without one are run on every document.
RUN = 3
MOST = 360


def literals(pattern: str) -> list[str] | None:
    """Runs of letters and digits, lower-cased, one of which every match of a pattern has (in any case); None if there may be matches without one."""

    def best(nodes: Iterable) -> list[str] | None:
        found: list[list[str]] = []
        run = ""
        for op, arg in [*nodes, (None, None)]:
            if op is rc.LITERAL and chr(arg).isascii() and chr(arg).isalnum():
                run += chr(arg).lower()
                continue
            lead = [(rc.LITERAL, ord(c)) for c in run]
            if len(run) >= RUN:
                found.append([run])
            run = ""
            inner = None
            if op is rc.SUBPATTERN:
                inner = best(arg[-1])
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] > 0:
                inner = best(arg[2])
            elif op is rc.BRANCH:
                parts = [best([*lead, *b]) for b in arg[1]]  # the parser takes out letters that all branches begin with
                inner = None if None in parts else [x for p in parts for x in p]
            if inner:
                found.append(inner)
        return max(found, key=lambda xs: min(map(len, xs)), default=None)

    return best(rp.parse(pattern))


PATTERNS = "ord int, kind string, label string, pattern string, gate string, sure double"


def known_patterns(spark: SparkSession) -> DataFrame:
    """The scan's own table, as scan_patterns() takes it."""
    gates = {x: g for g, xs in (("official", table.OFFICIAL_STATISTICS_LABELS), ("rl_emotion", table.RL_EMOTION_LABELS), ("quantum", table.QUANTUM_LABELS)) for x in xs}
    rows = [("concept", label, p, gates.get(label), table.SURE["concept"]) for label, p in table.CONCEPTS]
    rows += [("method", label, p, "official", table.SURE["statistics_method"]) for label, p in table.STATISTICS_METHODS]
    rows += [("method", label, p, "rl_emotion", table.SURE["rl_method"]) for label, p in table.RL_EMOTION_METHODS]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PATTERNS)


def body_of(text: Column) -> Column:
    """A text before the first line that is a heading of its references."""
    text = F.coalesce(text, F.lit(""))
    heads = r"(?im)^\s*(?:#+\s*)?(?:\d+\.?\s*)?(?:references|bibliography|works cited|literature cited)\s*$"
    at = F.regexp_instr(text, F.lit(heads))
    return F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(F.split(text, r"(?i)\n\s*(?:references|bibliography)\s*\n", 2)[0])


def gates(body: Column) -> dict[str, Column]:
    """What kind of paper a text looks like, by the gate that opens."""
    low = F.lower(body)
    one = lambda *xs: reduce(or_, [F.contains(low, F.lit(x)) for x in xs])
    return {
        "official": one("official statistics") | (one("data source") & one("statistical")) | (one("data sources") & one("statistics")),
        "rl_emotion": (one("reinforcement learning") | body.rlike(r"(?U)\bRL\b")) & one("emotion", "affective", "valence", "appraisal"),
        "quantum": (one("quantum", "photonic", "fock space", "linear-optical") | body.rlike(r"(?U)\bQML\b")) & one("machine learning", "neural network", "classification", "benchmark", "dataset"),
    }


def context_for(text: Column, start: Column, end: Column, reach: int = 180) -> Column:
    """What stands around a place (start to end, from 0): from the sentence or line that it is in to where that ends, ``reach`` characters at most on either side; from the place itself where that would begin in the middle of a sentence."""
    prefix = F.substr(text, F.greatest(F.lit(0), start - reach) + 1, F.least(F.lit(reach), start))
    lead = F.regexp_replace(prefix, r"(?s)^.*(?:[.!?] |\n)", "")
    suffix = F.substr(text, end + 1, F.lit(reach))
    tail = F.regexp_extract(suffix, r"(?sU)^(.*?(?:[.!?]\s+|\n))", 1)
    here = F.concat(F.substr(text, start + 1, end - start), F.when(tail != "", tail).otherwise(suffix))
    whole, own = _squeezed(F.concat(lead, here)), _squeezed(here)
    return F.when((start > 0) & whole.rlike(r"^\p{Ll}") & (own != ""), own).otherwise(whole)


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))




def scan_patterns(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, kind, ord, label, context, sure of all patterns (PATTERNS) that match a document's body (doc_id, body, and a column gate_<name> for each gate), in any case; those of a gate only where it is open.

    Which patterns meet a document is an equi-join of the runs of letters of its words, as long as
    the shortest literal, with a table whose size is measured; what meets is settled there, word
    by word, and only then comes to the text by its id.
    """
    need = [(r["ord"], literals(r["pattern"])) for r in patterns.select("ord", "pattern").collect()]  # the table of patterns
    spark = docs.sparkSession
    least = min((len(x) for _, xs in need for x in xs or []), default=RUN)
    anchors = spark.createDataFrame([(o, x) for o, xs in need for x in xs or []], "ord int, literal string").withColumn("run", F.substring("literal", 1, least))
    always = spark.createDataFrame([(o,) for o, xs in need if xs is None], "ord int").join(patterns, "ord")
    entry = F.struct("ord", "kind", "label", F.concat(F.lit("(?iU)"), "pattern").alias("pattern"), "gate", "sure")
    words = F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0)))
    held = spread(docs.select("doc_id", "body")).select("doc_id", F.explode(words).alias("word"))
    held = held.select("doc_id", "word", F.explode(F.sequence(F.lit(1), F.length("word") - (least - 1))).alias("i")).withColumn("run", F.substr("word", F.col("i"), F.lit(least)))
    met = held.join(small(anchors), "run").filter(F.contains("word", F.col("literal"))).select("doc_id", "ord").distinct().join(small(patterns), "ord")
    met = small(kept(met.groupBy("doc_id").agg(F.collect_list(entry).alias("met"))))
    every = always.agg(F.coalesce(F.collect_list(entry), F.array()).alias("every"))
    rows = docs.join(met.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left").crossJoin(F.broadcast(every))  # one row
    once = F.concat(F.coalesce("met", F.slice("every", 1, 0)), "every")
    known = [c.removeprefix("gate_") for c in docs.columns if c.startswith("gate_")]
    opened = lambda p: reduce(or_, [(p["gate"] == g) & F.col(f"gate_{g}") for g in known], p["gate"].isNull())
    rows = rows.select("doc_id", "body", F.filter(once, opened).alias("c"))
    at = F.transform("c", lambda p: F.struct(p["ord"].alias("ord"), p["kind"].alias("kind"), p["label"].alias("label"), p["sure"].alias("sure"), F.regexp_instr(F.col("body"), p["pattern"]).alias("at"), F.length(F.regexp_substr(F.col("body"), p["pattern"])).alias("n")))
    hits = F.filter(at, lambda h: h["at"] > 0)
    out = F.transform(hits, lambda h: F.struct(h["kind"].alias("kind"), h["ord"].alias("ord"), h["label"].alias("label"), F.substring(context_for(F.col("body"), h["at"] - 1, h["at"] - 1 + h["n"]), 1, MOST).alias("context"), h["sure"].alias("sure")))
    return rows.select("doc_id", F.inline(out))


def _initials(words: Column) -> Column:
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def name_words(said: Column) -> Column:
    return F.regexp_extract_all(said, F.lit("[A-Za-z][A-Za-z0-9-]*"), F.lit(0))


def long_form(said: Column, short: Column, words: Column | None = None) -> Column:
    """The last words of a name whose initials a short form is, where there are such; else the name. words: name_words(said), where that is a column already, as it is looked at several times."""
    words = name_words(said) if words is None else words
    n, k = F.size(words), F.length(short)
    last = F.slice(words, F.greatest(F.lit(1), n - k + 1), k)
    return F.when((n >= k) & (_initials(last) == F.upper(short)), F.array_join(last, " ")).otherwise(said)


def is_pair(long: Column, short: Column) -> Column:
    """Whether a name of two to eight words may stand for a short form: its initials have it, and it is no name of a series and no piece of a sentence."""
    n, low = F.size(F.split(F.trim(long), r"\s+")), F.lower(long)
    names = F.regexp_extract_all(long, F.lit("[A-Za-z]+"), F.lit(0))
    first = F.lower(F.regexp_extract(long, "^[A-Za-z]+", 0))
    fits = F.length(short).between(2, 8) & n.between(2, 8) & (F.length(long) <= 70) & F.contains(_initials(names), F.upper(short))
    return fits & ~first.isin(*table.NO_FIRST_WORD) & ~reduce(or_, [F.contains(low, F.lit(w)) for w in table.NO_LONG_FORM])


def acronym_pairs(body: Column) -> Column:
    """Array of (long, short, s, e): names with a short form in brackets behind them, cut to the words whose initials it is where there are such, and their places; names of two to eight words with the short form among their initials."""
    places = spans(body, r"(?U)\b[A-Z][A-Za-z][A-Za-z0-9 /-]{2,80}?\s+\([A-Z][A-Z0-9-]{1,12}\)")
    said = F.transform(places, lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), F.substr(body, p["s"] + 1, p["e"] - p["s"]).alias("m")))
    parts = F.transform(said, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.trim(F.regexp_extract(x["m"], r"(?sU)^(.*?)\s+\([^(]*$", 1)).alias("long"), F.regexp_extract(x["m"], r"\(([^)]*)\)$", 1).alias("short")))
    cut = F.transform(parts, lambda x: F.struct(long_form(x["long"], x["short"]).alias("long"), x["short"].alias("short"), x["s"].alias("s"), x["e"].alias("e")))
    return F.filter(cut, lambda x: is_pair(x["long"], x["short"]))


def titled(text: Column) -> Column:
    """Every run of letters with a capital first and the rest small."""
    return F.replace(F.initcap(F.regexp_replace(text, r"([^\p{L}])(?=\p{L})", "$1\x01 ")), F.lit("\x01 "), F.lit(""))


def headings(body: Column, most: int = 500) -> Column:
    """Array of labels: lines among the first ``most`` that look like a heading, number and all, and have one of the scan's words; a line in capitals is written as a title."""
    lines = F.slice(F.split(body, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1), 1, most)

    def one(raw: Column) -> Column:
        numbered = F.regexp_extract(raw, r"(?U)^\s*\d+(?:\.\d+)*\s+([A-Z][^.!?]{3,70})\s*$", 1)
        line = _squeezed(F.when(numbered != "", numbered).otherwise(raw))
        words = F.filter(F.split(line, " "), lambda w: w != "")
        capitals = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
        fits = F.length(line).between(4, 70) & F.size(words).between(1, 8) & ((numbered != "") | ~F.rtrim(raw).rlike(r"[.,;:]$"))
        fits = fits & ((F.size(words) <= 3) | (capitals >= F.greatest(F.lit(2), F.floor(F.size(words) / 2)))) & line.rlike(f"(?iU){table.HEADING_WORDS}")
        label = F.when((F.upper(line) == line) & (F.lower(line) != line), titled(line)).otherwise(line)
        return F.when(fits, F.struct(label.alias("label"), F.concat(F.lit("Section or heading: "), line).alias("context")))

    return F.array_compact(F.transform(lines, one))


def repeated_phrases(docs: DataFrame, gate: str, *, most: int = 20) -> DataFrame:
    """doc_id, label, n, ord of the ``most`` phrases of two to four words that a body has twice or more, the most frequent first, the earlier (and shorter) of equals: phrases with a word of the gate."""
    heads, ends, generic, (least, longest) = table.PHRASES[gate]
    low = F.lower(F.regexp_replace("body", r"(?U)[^A-Za-z0-9\s-]", " "))
    words = F.filter(F.split(F.trim(F.regexp_replace(low, r"(?U)\s+", " ")), " "), lambda w: F.length(w) > 2)
    rows = docs.filter(F.col(f"gate_{gate}")).select("doc_id", words.alias("w"))
    size = F.size("w")
    grams = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.struct(F.lit(n).alias("size"), i.alias("i"), F.slice(F.col("w"), i, n).alias("p")))).otherwise(F.array())
    has = lambda p, xs: F.arrays_overlap(p, F.array(*map(F.lit, xs)))
    p = F.col("p")
    ok = [has(p, heads), ~F.get(p, 0).isin(*ends), ~F.element_at(p, -1).isin(*ends), F.length(F.array_join(p, " ")).between(least, longest)]
    if generic:
        ok.append(F.size(F.array_except(p, F.array(*map(F.lit, generic)))) > 0)
    one = rows.select("doc_id", F.inline(F.concat(*[grams(n) for n in (2, 3, 4)]))).filter(reduce(and_, ok))
    counted = one.groupBy("doc_id", F.array_join("p", " ").alias("phrase")).agg(F.count("*").alias("n"), F.min(F.struct("size", "i")).alias("first")).filter("n >= 2")
    k = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "first"))
    return counted.withColumn("ord", k).filter(F.col("ord") <= most).select("doc_id", titled(F.col("phrase")).alias("label"), "n", "ord")


def scan(docs: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """doc_id, kind (concept or method), label, context, confidence, ord: what a scan of documents (doc_id, text) finds, each label of a kind once a document, the first find standing: patterns in their order, long and short forms, headings, repeated phrases.

    Null and empty texts have no finds; ids are taken as distinct. What stands behind the list of
    references isn't read.
    """
    rows = docs.select("doc_id", body_of(F.col("text")).alias("body"))
    rows = rows.select("doc_id", "body", *[c.alias(f"gate_{g}") for g, c in gates(F.col("body")).items()])
    patterns = known_patterns(docs.sparkSession) if patterns is None else patterns
    cast = lambda df: df.select("doc_id", "kind", F.col("stage").cast("int").alias("stage"), F.col("ord").cast("int").alias("ord"), "label", "context", F.col("sure").cast("double").alias("sure"))
    concept = F.lit("concept").alias("kind")
    found = cast(scan_patterns(rows, patterns).withColumn("stage", F.lit(0)))
    body = F.col("body")
    pairs = rows.select("doc_id", "body", F.posexplode(acronym_pairs(body)).alias("i", "a"))
    context = F.substring(context_for(body, F.col("a.s"), F.col("a.e")), 1, MOST)
    both = F.array(F.struct(F.lit(0).alias("j"), F.col("a.long").alias("label"), F.lit(table.SURE["long_form"]).alias("sure")), F.struct(F.lit(1).alias("j"), F.col("a.short").alias("label"), F.lit(table.SURE["short_form"]).alias("sure")))
    pairs = pairs.select("doc_id", "i", context.alias("context"), F.inline(both))
    found = found.unionByName(cast(pairs.select("doc_id", concept, F.lit(1).alias("stage"), (F.col("i") * 2 + F.col("j")).alias("ord"), "label", "context", "sure")))
    heads = rows.select("doc_id", F.posexplode(headings(body)).alias("ord", "h"))
    found = found.unionByName(cast(heads.select("doc_id", concept, F.lit(2).alias("stage"), "ord", "h.label", F.substring("h.context", 1, MOST).alias("context"), F.lit(table.SURE["heading"]).alias("sure"))))
    for stage, gate in enumerate(table.PHRASES, 3):
        said = F.concat(F.lit("Repeated phrase in parsed paper text ("), F.col("n"), F.lit(" mentions)."))
        found = found.unionByName(cast(repeated_phrases(rows, gate).select("doc_id", concept, F.lit(stage).alias("stage"), "ord", "label", said.alias("context"), F.lit(table.SURE["phrase"]).alias("sure"))))
    order = F.struct("stage", "ord")
    once = found.withColumn("_key", tight_key(F.col("label"))).filter("_key <> ''").groupBy("doc_id", "kind", "_key").agg(F.min_by(F.struct("label", "context", "sure", order.alias("o")), order).alias("f"))
    label = clean_label(F.col("f.label"))
    context = F.when(F.trim("f.context") == "", "auto-detected from paper text").otherwise(F.col("f.context"))
    ranked = F.row_number().over(W.partitionBy("doc_id", "kind").orderBy("f.o"))
    return once.select("doc_id", "kind", label.alias("label"), context.alias("context"), F.col("f.sure").alias("confidence"), ranked.alias("ord"))
