"""Columns, tables and streams."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from veilframe.api import Redactor
from veilframe.operators import policy, redaction
from veilframe.operators.dictionary import Dictionary
from veilframe.plans import curate
from veilframe.sources import config as C
from veilframe.streaming import PASS, latest_entries, log_stream, pause_stream, reloading, rewrite_stream, taint_stream

CONFIG = json.dumps(
    {
        "anything": "ignored",
        "lists": [
            {"name": "places", "terms": ["Valparaiso", "Rapa Nui", "Cliffs of Moher"]},
            {"name": "repos", "mode": "drop-line", "terms": ["quiet-engine"]},
            {"name": "people", "restore": True, "terms": ["Nils Holger"]},
            {"name": "short", "terms": ["x"]},
            {"name": "packed", "pack": "sites", "exclude": ["vigan"]},
        ],
    }
)


@pytest.fixture(scope="module")
def redactor(spark):
    return Redactor(spark, CONFIG, "seed", {"sites": ["Vigan", "Petra"]})


def test_dimension(redactor):
    assert redactor.skipped == 1
    assert set(redactor.dictionary.terms) == {"valparaiso", "rapa nui", "cliffs of moher", "quiet engine", "nils holger", "petra"}
    assert redactor.status() == "on: 6 terms"


def test_redact_columns(spark, redactor):
    rows = [(1, "Ferries reach Valparaíso at noon."), (2, "a\nquiet-engine\nb"), (3, None), (4, "quiet-engine"), (5, "plain")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: r["r"] for r in df.select("id", redactor.redact("text").alias("r")).collect()}
    assert got[1]["replaced"] == 1 and "Valpara" not in got[1]["value"] and got[1]["value"].endswith(" at noon.")
    assert (got[2]["value"], got[2]["dropped"]) == ("a\nb", 1)
    assert got[3]["value"] is None and not got[3]["changed"]
    assert got[4]["vanished"] and got[4]["value"] == "" and not got[5]["changed"]
    assert [r["id"] for r in df.where(redactor.has_term("text")).orderBy("id").collect()] == [1, 2, 4]


def test_failing_rows_are_withheld(spark, redactor, monkeypatch):
    from veilframe.operators.redaction import _rewriter

    def broken(own, text, tally):
        raise ValueError(text)

    row = spark.createDataFrame([("secret",)], "text string").select(_rewriter(spark, redactor.dictionary, broken)(F.col("text")).alias("r")).first()["r"]
    assert row["value"] is None and row["error"] == "ValueError"


def test_calls(spark, redactor):
    name = redactor.dictionary.terms["valparaiso"].placeholder
    nils = redactor.dictionary.terms["nils holger"].placeholder
    calls = [("Bash", {"command": f"open {name}"}), ("Bash", {"command": f"open {nils}"}), ("Task", {"prompt": name}), ("Read", {"file_path": "D:\\conf\\words.json"}), ("Write", {"file_path": "README", "content": "conf/words.json"}), ("Bash", None)]
    df = spark.createDataFrame([(i, t, json.dumps(p) if p else "not json") for i, (t, p) in enumerate(calls)], "id int, tool string, payload string")
    got = [r["c"] for r in df.select("id", redactor.guard("tool", "payload", "d:/conf/words.json").alias("c")).orderBy("id").collect()]
    assert [g["denied"] for g in got] == [True, False, False, True, False, True]
    assert json.loads(got[1]["input"]) == {"command": "open Nils Holger"}


def test_sql_functions(spark, redactor):
    redactor.register()
    assert spark.sql("SELECT fold('Á—b') AS f, has_term('Petra') AS h").first() == ("a b", True)
    assert [r["folded"] for r in spark.sql("SELECT * FROM find_terms('Petra and Valparaíso')").collect()] == ["petra", "valparaiso"]


def test_config_errors_name_a_place():
    for text, place in [('{"lists": [{"name": "a", "pack": "Bad Name"}]}', "lists[0].pack"), ('{"lists": [{"name": "a", "pack": "p", "restore": true}]}', "lists[0].restore"), ('{"lists": [{"name": "a", "terms": ["ok", 1]}]}', "lists[0].terms[1]"), ("{", "JSON")]:
        with pytest.raises(C.ConfigError) as e:
            C.parse_config(text)
        assert place in str(e.value)
    with pytest.raises(C.ConfigError, match="did you mean sites"):
        C.check_packs(C.parse_config('{"lists": [{"name": "a", "pack": "sitse"}]}'), {"sites": []})
    assert [x.name for x in C.option_lists({"biology": True, "otherPacks": "maya, maya", "extraWords": "a, b"}, ("biology",))] == ["biology", "maya", "extra words"]


BAD = [({"name": "Bad Name"}, "name"), ({"description": " "}, "description"), ({"wikipedia": [{"category": "Category:X"}]}, "without"), ({"wikipedia": [{"category": "X", "depth": 4}]}, "wikipedia[0].depth"), ({"wikipedia": [{"category": "X", "depth": True}]}, "wikipedia[0].depth"), ({"wikipedia": [{"category": "X", "role": "both"}]}, "wikipedia[0].role"), ({"wikipedia": [{"category": "X", "dept": 1}]}, "wikipedia[0]"), ({"wikipedia": {"category": "X"}}, "wikipedia"), ({"datamuse": "x"}, "datamuse"), ({"exclude": ["ok", ""]}, "exclude[1]"), ({"sources": []}, "recipe"), ({"thresholds": {"term_below": "3"}}, "thresholds.term_below"), ({"thresholds": {"corpus_files": 2.5}}, "whole number"), ({"thresholds": {"term_below": 4.8}}, "term_below"), ({"thresholds": {"judge_hint": 0.8}}, "judge_hint"), ({"thresholds": {"typo": 1}}, "thresholds"), ({"wikipedia": []}, "source")]


@pytest.mark.parametrize(("over", "place"), BAD)
def test_recipe_errors(over, place):
    base = {"name": "maya", "description": "Maya", "wikipedia": [{"category": "Maya sites", "depth": 1}]}
    with pytest.raises(C.ConfigError) as e:
        C.parse_recipe(base | over)
    assert place in str(e.value)


def test_packs(spark, tmp_path):
    for d, name, terms in (("user", "a", ["x1"]), ("built", "a", ["x2"]), ("built", "b", ["y"])):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / f"{name}.json").write_text(json.dumps({"name": name, "terms": terms}, indent=2))
    (tmp_path / "built" / "c.json").write_text("{broken")
    packs = C.read_packs(spark, str(tmp_path / "user"), 0).unionByName(C.read_packs(spark, str(tmp_path / "built"), 1))
    assert C.pack_terms(packs) == {"a": ["x1"], "b": ["y"]}
    assert {r["pack"]: r["is_replaced"] for r in C.overlay(packs).collect()} == {"a": True, "b": False, "c": False}


CLEAN = [("Tikal", "Tikal"), ("  Rapa   Nui ", "Rapa Nui"), ("Caracol (site)", "Caracol"), ("Copan, Honduras", "Copan"), ("Category:Maya", None), ("List of Maya sites", None), ("-logy", None), ("1990s in Mexico", None), ("ab", None), ("DNA", None), ("a b c d e f", None), ("", None), ("Age-sets", "Age-sets")]


def test_clean_titles(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEAN)], "seq int, title string")
    assert [r["text"] for r in curate.clean_titles(df).orderBy("seq").collect()] == [x for _, x in CLEAN]


def test_curation_end_to_end(spark):
    recipe = C.Recipe("maya", "Maya", [C.Source("wikipedia-category", "Sites", "terms", 1), C.Source("datamuse-rel-trg", "maya", "hints"), C.Source("recipe", "extra_terms", "terms")], ["Giza"], exclude=["temple"])
    edges = spark.createDataFrame([("Sites", 0, "Tikal"), ("Sites", 0, "Llama"), ("Sites", 0, "Temple"), ("Sites", 0, "Baking Pot"), ("Sites", 14, "More"), ("More", 0, "Caracol (site)"), ("More", 14, "Sites"), ("More", 0, "List of sites")], "parent string, ns int, title string")
    pairs = spark.createDataFrame([("maya", "Egypt", 2), ("maya", "sun", 1)], "seed string, word string, score int")
    zipf = spark.createDataFrame([("tikal", 2.08), ("baking", 3.92), ("pot", 4.4), ("caracol", 2.2), ("temple", 4.45), ("llama", 2.95), ("egypt", 4.45), ("sun", 4.97)], "word string, zipf double")
    docs = spark.createDataFrame([(i, "a llama and Tikal" if i < 5 else "nothing") for i in range(6)], "doc_id long, text string").withColumn("text", F.when(F.col("doc_id") > 1, F.regexp_replace("text", " and Tikal", "")).otherwise(F.col("text")))
    answers = spark.createDataFrame([("Llama", 0.1), ("Baking Pot", 0.9)], "text string, p double")
    items = curate.fetch(spark, recipe, edges, pairs)
    c, dropped = curate.build(spark, recipe, items, zipf, docs, answers)
    got = {r["key"]: (r["decision"], r["files"], list(r["review"])) for r in c.collect()}
    assert got["tikal"] == ("term", 2, []) and got["caracol"][0] == "term" and got["giza"][0] == "term" and got["temple"][0] == "drop"
    assert got["llama"] == ("hint", 5, ["in 5 corpus files"]) and got["baking pot"][0] == "term" and got["egypt"][0] == "hint" and got["sun"][0] == "drop"
    assert [r["key"] for r in dropped.collect()] == ["list of sites"]
    counts = curate.source_counts(items, c)
    pack = curate.pack_json(recipe, c, counts, "2026.01.01")
    assert json.loads(pack)["terms"] == ["Baking Pot", "Caracol", "Giza", "Tikal"] and json.loads(pack)["sources"][0] == {"kind": "wikipedia-category", "query": "Sites", "depth": 1, "found": 6, "kept": 4}
    text = curate.report(recipe, c, dropped, C.source_table(spark, recipe), counts)
    assert "| wikipedia: Sites | terms | 1 | 6 | 4 |" in text and "| judge term | 0.7 |" in text and "| Llama | in 5 corpus files | 2.95 | 5 | 0.10 | hint |" in text and "list of sites: list or outline page" in text
    assert [r["key"] for r in curate.unsettled(c, recipe.thresholds).collect()] == []


def test_corpus_files(spark, tmp_path):
    for name, data in (("a.md", b"Maya"), ("b.bin", b"x"), ("c.txt", b"\0maya"), ("d.py", b"\xff maya"), ("node_modules/e.md", b"maya"), ("big.txt", b"x" * 1_000_001), ("skip/f.md", b"maya")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = curate.corpus_files(spark, str(tmp_path), exclude=["/skip/"])
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got.collect()) == ["a.md", "d.py"]


def test_walk_order(spark):
    paths = ["r/z.md", "r/a/x.md", "r/b.md", "r/a/c/y.md", "r/ab/q.md", "r/a/n.md"]
    got = spark.createDataFrame([(p,) for p in paths], "path string").orderBy(curate.walk_order(F.col("path"))).collect()
    assert [r["path"] for r in got] == ["r/b.md", "r/z.md", "r/a/n.md", "r/a/x.md", "r/a/c/y.md", "r/ab/q.md"]


def test_even_sample_equals_a_sort(spark):
    rows = spark.range(300_000).select(F.concat(F.lit("k"), F.hex(F.xxhash64("id"))).alias("k"), (F.col("id") % 3).alias("n"))
    every = sorted(r["k"] for r in rows.collect())
    for most in (128, 1000):
        step = -(-len(every) // most)
        assert sorted(r["k"] for r in curate.even_sample(rows, "k", most).collect()) == every[::step]
    same = spark.range(1000).select(F.lit("one").alias("k"), "id")
    assert curate.even_sample(same, "k", 10).count() == 10 and curate.even_sample(same.limit(0), "k", 10).count() == 0


def test_results_fail_closed_and_tell(spark, redactor):
    name = redactor.dictionary.terms["valparaiso"].placeholder
    rows = [(0, "no Valparaiso", False, None, None), (1, None, True, None, "quiet-engine broke"), (2, None, False, '{"a": "Valparaiso"}', "a: Valparaiso"), (3, None, False, '{"a": 1}', "from Valparaiso"), (4, None, False, '{"a": 1}', "plain"), (5, None, False, "{broken", "x")]
    df = spark.createDataFrame(rows, "id int, deny string, err boolean, record string, text string")
    got = [r["r"] for r in df.select("id", policy.filter_results(spark, redactor.dictionary, *map(F.col, ("deny", "err", "record", "text"))).alias("r")).orderBy("id").collect()]
    assert [g["kind"] for g in got] == ["deny", "deny", "result", "deny", "same", "withheld"]
    assert got[0]["value"] == f"no {name}" and got[1]["value"].endswith(" broke") and json.loads(got[2]["value"]) == {"a": name} and name in got[2]["note"] and "Valpar" not in str(got)
    assert got[5]["error"] == "JSONDecodeError" and got[3]["value"] == f"from {name}"


def test_commands(spark, redactor):
    rows = [(None, "s1", "add", "one.txt", 1, "a", 2, 0, "Alpha", "Fig1", "l"), (None, "s2", "add", "two.txt", 2, "b", 0, 3, "Beta", "Oak2", "l"), ("x", "s1", "add", "three.txt", 3, "a", 1, 0, "Alpha", "Fig1", "l"), (None, "s9", "standing", "always", 0, "a", 1, 0, "Alpha", "Fig1", "l")]
    entries = spark.createDataFrame(rows, "agent string, slot string, mode string, label string, seq long, folded string, replaced long, dropped long, canonical string, placeholder string, list_name string").withColumn("kind", F.lit("files"))
    state = {}
    assert redactor.command("log", entries=entries, state=state) == ["hidden in every request:", "  always", "      Alpha -> Fig1 (x1)", "hidden as it came in:", "  one.txt", "      Alpha -> Fig1 (x2)", "  two.txt", '      3 lines dropped by "l": Beta (x3)', "hidden in subagent x:", "  three.txt", "      Alpha -> Fig1 (x1)"]
    redactor.command("log clear", entries=entries, state=state)
    assert redactor.command("log", entries=entries, state=state) == ["hidden in every request:", "  always", "      Alpha -> Fig1 (x1)"]
    assert redactor.command("off", state=state) == ["paused"] and redactor.command("on", state=state) == ["on: 6 terms"]
    packs = spark.createDataFrame([("sites",), ("spare",)], "pack string")
    assert redactor.command("packs", packs=packs) == ["sites: packed", "spare: not used"]
    assert redactor.command("reload", state=state) and state["reload"] and redactor.command("?")[0].startswith("commands")


def test_settings_join_the_configuration():
    both = C.with_settings(C.parse_config('{"lists": [{"terms": ["a"]}]}'), {"otherPacks": "sites", "extraWords": "b c"})
    assert [(x.name, x.pack, x.terms) for x in both.lists] == [("list 1", None, ["a"]), ("sites", "sites", []), ("extra words", None, ["b c"])]
    for text in ("{}", '{"list": []}', '{"lists": {}}'):
        with pytest.raises(C.ConfigError, match="lists"):
            C.parse_config(text)


def test_reload_looks_at_the_stamp():
    now, stamp, loads, ran = [0.0], ["a"], [], []
    each = reloading(lambda: loads.append(1) or (1 / 0 if stamp[0] == "bad" else stamp[0]), lambda b, i, v: ran.append(v), stamp=lambda: stamp[0], clock=lambda: now[0])
    for t, s in ((0, "a"), (0.5, "b"), (1.5, "b"), (3, "b"), (5, "bad"), (7, "c")):
        now[0], stamp[0] = t, s
        each(None, 0)
    assert ran == ["a", "a", "b", "b", "b", "c"] and len(loads) == 4


class Broken(Dictionary):
    def rewrite(self, *a, **k):
        raise ValueError("hidden")


def test_sql_redact_fails_closed(spark, redactor):
    from veilframe.operators.redaction import register_functions

    register_functions(spark, Broken(list(redactor.dictionary.terms.values())))
    assert spark.sql("SELECT redact('Petra') AS r").first()["r"] is None
    redactor.register()


def test_cache_and_judge(spark, tmp_path):
    cache = curate.ResponseCache(spark, str(tmp_path / "cache"))
    spark.createDataFrame([("none", "x")], "key string, body string").write.parquet(cache.path)
    urls = spark.createDataFrame([("http://a",), ("http://b",)], "url string")
    with pytest.raises(LookupError):
        cache.get(urls, None)
    assert {r["url"]: r["body"] for r in cache.get(urls, lambda u: u.upper()).collect()} == {"http://a": "HTTP://A", "http://b": "HTTP://B"}
    assert cache.get(urls, None).count() == 2
    assert cache.get(urls, lambda u: "new", refresh=True).select("body").distinct().first()["body"] == "new"


def test_judge_saves_what_it_is_told(spark, tmp_path):
    path, log = str(tmp_path / "answers"), str(tmp_path / "asked")
    texts = spark.createDataFrame([(f"t{i}",) for i in range(45)] + [("t0",)], "text string").coalesce(1)

    def post(batch, broken=()):
        with open(log, "a") as f:
            f.write("\n".join(batch) + "\n")
        if any(t in broken for t in batch):
            raise OSError("no route")
        return [0.5] * len(batch), {"tokens": 10, "cost": 0.01}

    ask = lambda post, **k: curate.ask(texts, path, post, model="m", wording=k.get("wording", "w"))
    with pytest.raises(curate.JudgeError):
        ask(lambda ts: post(ts, ("t44", "t7")))
    first = open(log).read().split()
    answers = ask(post)
    rows = answers.collect()
    assert {r["text"] for r in rows} == {f"t{i}" for i in range(45)} and all(r["p"] == 0.5 for r in rows)
    costs = curate.judge_costs(answers).first()
    asked = open(log).read().split()
    assert costs["asked"] + costs["cached"] == 45 and costs["asked"] == len(asked) - len(first) < 45 and costs["tokens"] == 10 * costs["requests"]
    again = curate.judge_costs(ask(post)).first()
    assert (again["asked"], again["cached"], again["cost"]) == (0, 45, 0.0) and open(log).read().split() == asked
    with pytest.raises(curate.JudgeError):
        ask(lambda ts: ([0.5] * (len(ts) - 1), {}), wording="other")
    assert 0 < curate.judge_costs(ask(post, wording="other")).first()["cached"] < 45


def test_files_read_with_something_hidden(spark):
    reads = spark.createDataFrame([("A\\b.txt", 1, True, True), ("a/B.txt", 2, False, False), ("c", 3, True, False), ("c", 4, False, True)], "path string, seq long, hidden boolean, whole boolean")
    writes = spark.createDataFrame([("a/b.txt",), ("C",), ("d",)], "path string")
    assert {r["path"]: r["denied"] for r in policy.overwrite_guard(writes, policy.tainted_files(reads)).collect()} == {"a/b.txt": True, "C": False, "d": False}


def test_streams(spark, redactor, tmp_path):
    events = spark.createDataFrame([(1, "prompt.submit", "quiet-engine here"), (2, "tool.call", '{"out": ["quiet-engine", "b"]}'), (3, "unknown", "x")], "id int, event_type string, payload string")
    events.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).json(str(tmp_path / "in"))
    q = rewrite_stream(spark, stream, redactor.dictionary).writeStream.format("memory").queryName("rewritten").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["id"]: r["value"] for r in spark.table("rewritten").collect()}
    assert set(got) == {1, 2} and got[1].endswith(" here") and "quiet" not in got[1] and json.loads(got[2]) == {"out": ["b"]}

    t = dt.datetime(2026, 1, 1)
    rows = [("", "s1", "add", "L", "files", 1, t, ["a"], [2], [0]), ("", "s1", "add", "L", "files", 2, t, ["a", "b"], [1, 1], [0, 0]), ("", "s2", "replace", "M", "context", 3, t, ["a"], [5], [0]), ("", "s2", "replace", "M", "context", 4, t, ["b"], [1], [0])]
    spark.createDataFrame(rows, PASS).coalesce(1).write.parquet(str(tmp_path / "passes"))
    passes = spark.readStream.schema(PASS).parquet(str(tmp_path / "passes"))
    q = log_stream(passes).writeStream.format("memory").queryName("log").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    now = {(r["slot"], r["folded"]): (r["replaced"], r["is_new"]) for r in latest_entries(spark.table("log")).collect()}
    assert now == {("s1", "a"): (3, True), ("s1", "b"): (1, True), ("s2", "b"): (1, False)}

    reads = [("A\\f", 1, True, False), ("a/F", 2, False, False), ("b", 3, True, True), ("b", 4, False, True), ("c", 5, False, True)]
    spark.createDataFrame(reads, "path string, seq long, hidden boolean, whole boolean").coalesce(1).write.parquet(str(tmp_path / "reads"))
    spark.createDataFrame([("s", 1, "pause", "agent"), ("s", 2, "pause", "user"), ("s", 3, "log", "user"), ("t", 4, "pause", "user"), ("t", 5, "end", "agent")], "session string, seq long, command string, origin string").coalesce(1).write.parquet(str(tmp_path / "controls"))
    for name, made in (("reads", taint_stream), ("controls", pause_stream)):
        source = spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))
        q = made(source).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {tuple(r) for r in spark.table("reads").collect()} == {("a/f", True, 1), ("b", True, 3), ("b", False, 4)}
    assert {tuple(r) for r in spark.table("controls").collect()} == {("s", True, 2), ("t", True, 4), ("t", False, 5)}


def test_ngrams_of_a_long_text_take_time_in_proportion(spark):
    listed = ["la", "of the", "the", "in the house", "the house of", "house"]
    words = [["of", "the", "house", "in", "la", "x"][(i * i + i // 7) % 6] for i in range(60_000)]
    held = set(listed)

    def plain(ws):
        out, i = [], 0
        while i < len(ws):
            n = next((n for n in (3, 2, 1) if i + n <= len(ws) and " ".join(ws[i : i + n]) in held), 0)
            if n:
                out.append((i, n, " ".join(ws[i : i + n])))
            i += n or 1
        return out

    texts = {1: " ".join(words), 2: "In  the-HOUSE of the", 3: "the", 4: "", 5: None, 6: "of"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    begun = time.monotonic()
    got = {r["doc_id"]: [tuple(m) for m in r["matches"]] for r in redaction.ngram_find(docs, spark.createDataFrame([(w,) for w in listed], "folded string"), words=3).collect()}
    assert time.monotonic() - begun < 25
    assert got == {1: plain(words), 2: [(0, 3, "in the house"), (3, 2, "of the")], 3: [(0, 1, "the")]}
