from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("text", "quality", "value"),
    [('{"a": 1}', "clean", {"a": 1}), ('Sure:\n```json\n{"a": "}"}\n``` done', "trimmed", {"a": "}"}), ('{"a": [1, 2, {"b": "x, y"}, {"c": "cut', "partial", {"a": [1, 2, {"b": "x, y"}]}), ("none", "failed", None), (None, "failed", None)],
)
def test_recovery(text, quality, value):
    from papyra.functions.recovery import recover

    got, q = recover(text)
    assert q == quality and (None if got is None else json.loads(got)) == value


def test_recovery_cuts_before_long_strings():
    """Commas of the unfinished string, or after an error, don't hide the whole values before them."""
    from papyra.functions.recovery import recover

    for tail in ('"' + "a, " * 100_000, "oops" + ", 1" * 5_000):
        got, q = recover('{"a": [1, {"b": "x, y"}], "c": ' + tail)
        assert q == "partial" and json.loads(got) == {"a": [1, {"b": "x, y"}]}


def test_text_repair(spark):
    from papyra.functions.recovery import recovered_json, scientific_text, table_lines

    df = spark.createDataFrame([("ﬁne–tu­ned ｘ", "a\nx|y\n1|2\nb\nc|d", "[1]")], "t string, l string, j string")
    r = df.select(scientific_text(F.col("t")).alias("t"), table_lines(F.col("l")).alias("l"), recovered_json(F.col("j")).alias("j")).first()
    assert r["t"] == "fine-tuned x" and r["l"] == ["x|y\n1|2", "c|d"] and r["j"]["parse_quality"] == "clean"


def test_retries():
    from urllib.error import HTTPError

    from papyra.sources.api import arxiv_query, fetch

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            pass

        def read(self):
            return b"ok"

    calls, waits = [], []

    def opener(request, timeout):
        calls.append(request.full_url)
        if len(calls) < 3:
            raise HTTPError(request.full_url, 503, "busy", {"Retry-After": "7"} if len(calls) == 1 else {}, None)
        return Answer()

    assert fetch("http://x/1", opener=opener, sleep=waits.append) == "ok" and waits == [7.0, 20.0]
    with pytest.raises(HTTPError):
        fetch("http://x/2", opener=lambda r, timeout: (_ for _ in ()).throw(HTTPError(r.full_url, 404, "no", {}, None)), sleep=waits.append)
    assert arxiv_query("a b") == "all:a b" and arxiv_query("ti:a") == "ti:a"


def test_files_and_records(spark, tmp_path):
    from papyra.sources.tables import harvested_json, openalex_record, pdf_listing

    (tmp_path / "p_v1_v12.pdf").write_bytes(b"%PDF")
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    got = {(r["paper_id"], r["version"]) for r in pdf_listing(spark, str(tmp_path)).collect()}
    assert got == {("p_v1", 12), ("", None)}
    (tmp_path / "w.json").write_text(json.dumps({"id": "https://openalex.org/W1", "title": "T", "authorships": [{"author": {"display_name": "A"}}], "publication_year": 2020, "doi": "https://doi.org/10.1/X", "referenced_works": ["https://openalex.org/W2"], "cited_by_count": 3}))
    schema = "id string, title string, authorships array<struct<author:struct<display_name:string>>>, publication_year int, doi string, referenced_works array<string>, cited_by_count int"
    raw = harvested_json(spark, f"{tmp_path}/*.json", schema)
    assert raw.first()["file_name"] == "w.json"
    r = openalex_record(raw).first()
    assert (r["source_id"], r["authors"], r["doi"], r["references"]) == ("W1", ["A"], "10.1/x", ["W2"])
