"""Live sources over a fake web, and the command line."""

import json
import urllib.parse

import pytest

from veilframe.__main__ import main
from veilframe.plans import curate
from veilframe.sources.http import FetchError, association_pairs, category_edges, retrying

PAGES = {"Maya": [(0, "Tikal"), (14, "Category:Sites")], "Sites": [(0, "Copan"), (0, "Tikal"), (14, "Category:Maya"), (14, "Category:Deep")], "Deep": [(0, "Quirigua")]}


def web(url):
    q = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(url).query))
    if "rel_trg" in q:
        return json.dumps([{"word": "temple", "score": 2}, {"word": "sun", "score": 1}])
    rows = PAGES[q["cmtitle"].split(":", 1)[1]]
    at = int(q.get("cmcontinue", 0))
    more = {"continue": {"cmcontinue": str(at + 1)}} if at + 1 < len(rows) else {}
    return json.dumps({"query": {"categorymembers": [{"ns": n, "title": t} for n, t in rows[at : at + 1]]}, **more})


@pytest.mark.parametrize(("depth", "expected"), [(0, {"Tikal": 0}), (1, {"Tikal": 0, "Copan": 1}), (2, {"Tikal": 0, "Copan": 1, "Quirigua": 2})])
def test_categories(spark, depth, expected):
    edges = category_edges(spark, "https://example.org/api", "Maya", depth, web)
    assert {r["title"]: r["level"] for r in curate.category_members(edges, "Maya", depth).collect()} == expected


def test_associations(spark):
    pairs = association_pairs(spark, "https://example.org/words", ["maya"], web)
    assert [r["word"] for r in curate.associations(pairs, "maya").collect()] == ["temple", "sun"]


def test_retries():
    waits, replies = [], [(503, {}, ""), (429, {"Retry-After": "99"}, ""), (200, {}, '{"error": {"code": "maxlag"}}'), (0, {}, ""), (200, {}, '"ok"')]
    assert retrying(lambda u: replies.pop(0), waits.append)("https://example.org/x") == '"ok"' and waits == [1.0, 60.0, 4.0, 8.0]
    with pytest.raises(FetchError, match="example.org answered 404"):
        retrying(lambda u: (404, {}, ""), waits.append)("https://example.org/secret")
    with pytest.raises(FetchError):
        retrying(lambda u: (500, {}, ""), waits.append)("https://example.org/x")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "r.toml").write_text('name = "maya"\ndescription = "Maya"\ndatamuse = ["maya"]\n[[wikipedia]]\ncategory = "Maya"\n')
    spark.createDataFrame([("Maya", 0, "Tikal"), ("Maya", 0, "List of sites")], "parent string, ns int, title string").write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([("maya", "temple", 1)], "seed string, word string, score int").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([("temple", 3.0)], "word string, zipf double").write.parquet(str(tmp_path / "z"))
    assert main(["build", str(tmp_path / "r.toml"), "--edges", str(tmp_path / "e"), "--pairs", str(tmp_path / "p"), "--zipf", str(tmp_path / "z"), "--out", str(tmp_path / "out")]) == 0
    printed = capsys.readouterr().out
    assert "1 terms, 1 hints" in printed and "Tikal" not in printed
    assert json.loads((tmp_path / "out" / "maya.json").read_text())["terms"] == ["Tikal"]
