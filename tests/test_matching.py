"""Folding, matching, placeholders and rewriting of single texts."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.functions.folding import fold_column, fold_spans, fold_term, fold_text
from veilframe.functions.names import WORDS, assign_placeholders, find_placeholders, fnv1a32
from veilframe.operators.dictionary import Dictionary, Tally, Term


def made(*terms, drop=(), restore=()):
    """terms: text or (text, word_only)."""
    rows = [(t, True) if isinstance(t, str) else t for t in terms]
    names = assign_placeholders([fold_term(t) for t, _ in rows], "seed", "codename", [fold_term(t) for t, w in rows if not w])
    return Dictionary([Term(fold_term(t), t, "list", t in drop, w, names[fold_term(t)], t if t in restore else None) for t, w in rows])


def found(d, text):
    return [text[a:b] for a, b, _, _ in d.find(text)]


CASES = [
    (["Valparaiso"], "by train to VALPARAISO; Valparaíso is hilly, says valparaiso.org", ["VALPARAISO", "Valparaíso", "valparaiso"]),
    (["Quena"], "a quena, four quenas and the quena’s tone; no quenacho, no subquena", ["quena", "quenas", "quena"]),
    ([("quena", False)], "quenacho", ["quena"]),
    (["quiet engine"], "quiet_engine / quiet-engine / quiet \t engine / quietengine", ["quiet_engine", "quiet-engine", "quiet \t engine"]),
    (["Moher", "Cliffs of Moher"], "from Moher the Cliffs of Moher are near", ["Moher", "Cliffs of Moher"]),
    (["kmodel"], "old.\\nkmodel\\rnew \\tkmodel but not skmodel, not \\qkmodel", ["kmodel", "kmodel"]),
    (["quiet-engine"], "/srv/quiet-engine/run.sh or E:\\jobs\\quiet-engine\\run.cmd", ["quiet-engine", "quiet-engine"]),
    (["quena", "quenas"], "Quenas", ["Quenas"]),
    ([("quena", True), ("cho", False)], "quenacho, one quena", ["cho", "quena"]),
    (["Moher"], "🌊 Moher 🌊", ["Moher"]),
]


@pytest.mark.parametrize(("terms", "text", "expected"), CASES)
def test_find(terms, text, expected):
    assert found(made(*terms), text) == expected


def test_plural_suffix_and_counts():
    assert made("mango").find("ripe Mangoes!") == [(5, 12, "mango", "es")]
    assert made("Vigan", "Rapa Nui").count("vigan and VIGANS by Vigan; rapa--nui once; vigano never") == {"vigan": 3, "rapa nui": 1}


@pytest.mark.parametrize(("text", "folded"), [("Baden–Baden", "baden baden"), ("p\u00a0q", "p q"), ("p\x1dq", "p\x1dq"), ("O’Neill‘", "o'neill'"), ("ÖÇ", "oc")])
def test_fold(text, folded):
    assert fold_text(text) == folded


def test_fold_spans():
    assert fold_spans("ç \t-É!") == ("c e!", [0, 1, 4, 5], [1, 4, 5, 6])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aÁé \t-_—’́İßﬁΣ😀\x1c\n"), max_size=20))
def test_both_folds_agree(text):
    assert fold_text(text) == fold_spans(text)[0]


def test_jvm_fold_equals_the_rule_for_every_code_point(spark):
    codes = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["x".join(map(chr, codes[i : i + 900])) for i in range(0, len(codes), 900)] + ["", "ΕΛΛΑΣ ΟΔΟΣ", "한글 Ёлка", "ASCII Only-Text", "a \u0301 b"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fold_column("t").alias("f")).collect()
    assert all(r["f"] == fold_text(texts[r["i"]]) for r in got) and len(got) == len(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("quena mohr-_sé\n\\"), max_size=40))
def test_rewritten_text_holds_no_term_and_restores(text):
    d = made("quena", "moher", restore=("quena", "moher"))
    value, changed, gone = d.rewrite(text, Tally())
    assert not gone and not d.test(value)
    back, _ = d.restore({"text": value})
    assert fold_text(back["text"]) == fold_text(text)


def test_placeholders():
    assert len(set(WORDS)) == 256 and fnv1a32("a") == 3826002220
    terms = [f"term {i}" for i in range(600)]
    names = assign_placeholders(terms, "s")
    assert names == assign_placeholders(reversed(terms), "s") and len(set(names.values())) == 600
    assert all(n[0].isupper() and n[-1].isdigit() for n in names.values())
    tags = assign_placeholders(terms, "s", "tag")
    assert len(set(tags.values())) == 600 and all(len(t) == 15 for t in tags.values())


def test_find_placeholders():
    known = {"Walnut3", "Trellis44", "[hidden-12ab34]"}
    got = find_placeholders("cp my_Walnut3_dir Trellis44s; walnut3 or Walnut, xWalnut3, then Walnut3 and [hidden-12ab34]", known)
    assert [(n, s) for _, _, n, s in got] == [("Walnut3", ""), ("Trellis44", "s"), ("Walnut3", ""), ("[hidden-12ab34]", "")]


def test_lines_are_dropped():
    d = made("quiet-engine", "Moher", drop=("quiet-engine",))
    tally, moher = Tally(), d.terms["moher"].placeholder
    value, changed, gone = d.rewrite("first\nMoher with quiet-engine\nlast Moher\n", tally)
    assert (value, changed, gone) == (f"first\nlast {moher}\n", True, False)
    assert (tally.replaced, tally.dropped, tally.hits) == (1, 1, {"quiet engine": [0, 1], "moher": [1, 0]})
    assert d.rewrite("p\\nq quiet_engine\\nr", Tally())[0] == "p\\nr"
    assert d.rewrite("quiet-engine alone", Tally()) == ("", True, True)
    kept = d.rewrite("start quiet-engine now", Tally(), allow_drop=False)
    assert kept[0] == f"start {d.terms['quiet engine'].placeholder} now"
    # Across two lines a term is replaced, as no line holds it.
    assert d.rewrite("so quiet\nengine it is", Tally())[0] == f"so {d.terms['quiet engine'].placeholder} it is"


def test_nested_values():
    d = made("quiet-engine", "Valparaiso", drop=("quiet-engine",))
    inner = json.dumps([{"id": "quiet-engine"}, {"id": "loud"}], indent=3)
    value, changed, _ = d.rewrite_value({"out": inner, "err": ""}, Tally())
    assert changed and value == {"out": json.dumps([{"id": "loud"}], indent=3), "err": ""}
    assert d.rewrite_value({"paths": ["z.py", "src/quiet-engine/y.py"], "count": 2}, Tally())[0] == {"paths": ["z.py"], "count": 2}
    same = {"kind": "Valparaiso", "bytes": "Zm9v" * 80}
    assert d.rewrite_value(same, Tally()) == (same, False, False)
    deep = "Valparaiso"
    for _ in range(70):
        deep = [deep]
    assert d.rewrite_value(deep, Tally())[1] is False


def test_tally_does_not_depend_on_the_order_of_keys():
    d = made("quiet-engine", "Moher", drop=("quiet-engine",))
    counts = []
    for keys in (("a", "b", "c"), ("c", "b", "a"), ("b", "a", "c")):
        tally = Tally()
        values = {"a": "quiet-engine", "b": "near Moher and Moher", "c": "more quiet-engine"}
        assert d.rewrite_value([{k: values[k] for k in keys}, "kept"], tally)[0] == ["kept"]
        counts.append((tally.replaced, tally.dropped))
    assert set(counts) == {(2, 2)}


def test_calls():
    d = made("Nils Holger", "Moher", restore=("Nils Holger",))
    nils, moher = (d.terms[k].placeholder for k in ("nils holger", "moher"))
    assert d.guarded_in({"script": f"cat {nils} {moher}", "agentId": moher}) == [moher]
    assert d.restore({"script": f"open {nils}s", "tool_use_id": nils}) == ({"script": "open Nils Holgers", "tool_use_id": nils}, True)
