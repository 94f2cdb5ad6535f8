"""Scalar helpers: rounding, ratios, safe casts, identifiers, scores. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round4(x: Column) -> Column:
    """Four decimals, half away from zero on the scaled value: the same as DuckDB's round(x, 4)."""
    return F.round(x * 10000) / 10000


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to four decimals; 0 where whole is 0 or null."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(round4(F.coalesce(part, F.lit(0)).cast("double") / whole))


def blank_to_null(x: Column) -> Column:
    return F.when(x == "", None).otherwise(x)


def first_filled(*xs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(x) for x in xs])


def group_key(x: Column) -> Column:
    """Key of a group; null and empty: 'unknown'."""
    return F.coalesce(blank_to_null(x.cast("string")), F.lit("unknown"))


def as_double(x: Column, default: float | None = None) -> Column:
    out = x.try_cast("double")
    return out if default is None else F.coalesce(out, F.lit(default))


def as_int(x: Column, default: int | None = None) -> Column:
    out = x.try_cast("int")
    return out if default is None else F.coalesce(out, F.lit(default))


def as_bool(x: Column) -> Column:
    """Truth of a flag given as text, number or boolean; anything else is false."""
    return F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes", "y")


def as_year(x: Column) -> Column:
    """The first four-digit year from 1900 to 2099 in a value."""
    return as_int(F.regexp_extract(x.cast("string"), r"(19[0-9]{2}|20[0-9]{2})", 1))


def record_id(id_: Column, source: Column, source_id: Column) -> Column:
    return F.coalesce(blank_to_null(id_), F.concat_ws(":", source, source_id))


def normal_doi(doi: Column) -> Column:
    """Trimmed, lower case, without the resolver's address; empty: null."""
    return blank_to_null(F.regexp_replace(F.lower(F.trim(doi)), "^https?://doi\\.org/", ""))


def slug(label: Column, size: int = 96, mark: str = "_") -> Column:
    """Lower-cased letters and digits with a mark for each run of other characters between them, cut."""
    out = F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", mark)
    return F.substring(F.regexp_replace(out, f"^{mark}+|{mark}+$", ""), 1, size)


def stable_id(prefix: str, label: Column) -> Column:
    """prefix:slug (with hyphens), or a piece of the label's SHA-1 where nothing is left of it."""
    s = slug(label, mark="-")
    return F.concat(F.lit(f"{prefix}:"), F.when(s != "", s).otherwise(F.substring(F.sha1(F.coalesce(label, F.lit(""))), 1, 16)))


#: Fixed value: the URL name space of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version-5 UUID of a name, with built-in functions only."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def obsolescence(year: Column, citations: Column, now: int) -> Column:
    """0 to 1: age damped by citations; 0.5 without a year. ``now`` is given so that runs repeat."""
    age = F.greatest(F.lit(0), F.lit(now) - year)
    cited = F.log10(F.greatest(F.lit(1), F.coalesce(citations, F.lit(0))) + F.lit(1))
    return F.when(year.isNull(), F.lit(0.5)).otherwise(round4(F.least(F.lit(1.0), age / (1.0 + cited) / 10.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def square(v: Column) -> Column:
    """dot(v, v), in one pass."""
    return F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)


def cosine(a: Column, b: Column) -> Column:
    """-1 to 1; 0 for empty vectors, other lengths and zero norms."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0)
    return F.when(usable, dot(a, b) / norms).otherwise(0.0)
