"""The ten operators on small rows: nulls, empty and long texts, ties, repeated rows, empty tables, and extra columns."""

import base64
import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.conftest import SMOKE
from veilframe.llm import bagminhash, bpe, chat, graph_dedup, mixing, pii_crf, quality_mil, queries, rules_forest, toxicity, warc
from veilframe.llm.common import connected_components, labelled_texts
from veilframe.llm.textkit import Texts, chunks, counted, mix, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows that every operator on documents has to bear.
ODD = [(1, "plain words of a text", "a"), (1, "plain words of a text", "a"), (None, "no id", "a"), (2, None, None), (3, "", "a"), (4, " \n\t ", "b"), (5, "long " * 20_000, "b"), (6, "😀 ünï \x1c\x85", "")]


def odd(spark, rows=ODD):
    """With extra columns, some named like the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumn("size", F.lit("x")).withColumn("score", F.lit(1)).withColumn("kept", F.lit("y"))


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def held(n, modulus, remainder):
    return n is not None and zlib.crc32(str(n).encode()) % modulus == remainder


# --- shared


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(100, 200), (200, 300), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, **dict.fromkeys([100, 200, 300], 100)}
    assert connected_components(edges.limit(0)).count() == 0


def test_text_views():
    texts = ["a  b\nc", "", "é 😀", "x" * 50, " lead"]
    t = Texts(texts)
    assert t.n_words.tolist() == [len(WORD.findall(x)) for x in texts]
    assert [(a, b) for a, b in chunks(texts, 5)][0][0] == 0 and sum(len(b) for _, b in chunks(texts, 5)) == 5
    h = t.word_hash()
    assert len(set(h.tolist())) == len(h) and Texts(["c"]).word_hash()[0] == h[2]
    assert len(shingles(Texts(["a b c d e f", "a b"]), 5)[0]) == 3


# --- op1, op5


def smoke(spark, name):
    return spark.read.parquet(f"{SMOKE}/../sf0.01/{name}.parquet")


def test_quality_held_out(spark):
    out = queries.op1_quality_mil(spark, f"{SMOKE}/../sf0.01").join(smoke(spark, "labels"), "doc_id", "left").collect()
    assert len(out) == 1000 and all(0 <= r["score"] <= 1 and r["held_out"] == held(r["doc_id"], 4, 2) and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    test = [r for r in out if r["held_out"] and r["quality"] is not None]
    assert np.mean([r["predicted"] == r["quality"] for r in test]) >= 0.95


def test_toxicity_held_out(spark):
    out = queries.op5_toxicity(spark, f"{SMOKE}/../sf0.01").join(smoke(spark, "labels"), "doc_id", "left").collect()
    assert len(out) == 1000 and all(0 <= r["score"] <= 1 and r["held_out"] == held(r["doc_id"], 5, 0) for r in out)
    test = [r for r in out if r["held_out"] and r["toxic"] is not None]
    assert np.mean([r["predicted"] == r["toxic"] for r in test]) >= 0.93


@pytest.mark.parametrize("op", ["quality", "toxicity"])
def test_classifiers_bear_odd_rows(spark, op):
    fit, score = {"quality": (quality_mil.fit_quality, quality_mil.score_quality), "toxicity": (toxicity.fit_toxicity, toxicity.score_toxicity)}[op]
    docs = odd(spark)
    for rows, known in ((docs, labels(spark)), (docs, labels(spark).limit(0)), (docs.limit(0), labels(spark))):
        got = score(docs, fit(rows, known), score="own_score").collect()
        assert len(got) == len(ODD) and all(0 <= r["own_score"] <= 1 for r in got)
        assert len({r["own_score"] for r in got if r["doc_id"] == 1}) == 1
    assert score(docs.limit(0), fit(docs, labels(spark)), score="own_score").count() == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, known = smoke(spark, "documents"), smoke(spark, "labels")
    flipped = known.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_mil.fit_quality(docs, known), quality_mil.fit_quality(docs, flipped)
    assert all((a.p[k] == b.p[k]).all() for k in a.p)


def counts_of(p):
    return p.counts(0, len(p.doc)).astype(np.uint8)


def test_attention_weighs_passages():
    rng = np.random.default_rng(0)
    good, junk = lambda n: " ".join(f"w{rng.integers(9999)}ab" for _ in range(n)), "#$ " * 64
    bags = [good(256) if i % 2 else good(192) + " " + junk for i in range(60)]
    p, m = quality_mil.passages(bags), quality_mil.GatedAttention()
    m.fit(p.stats.astype(float), counts_of(p), p.doc, np.array([i % 2 for i in range(60)], float), np.ones(60))
    f = m.attend(m.encode(p.stats, counts_of(p)), p.doc, 60)
    assert ((f["s"] > 0.5) == np.array([i % 2 == 1 for i in range(60)])).all() and np.allclose(np.bincount(p.doc, f["alpha"]), 1)


def test_encoder_learns_words():
    """Bags that no statistic tells apart: only the words of one passage differ, deep inside a long text."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    common, marks = [word() for _ in range(300)], ["zorbu", "quyxi", "vopwu"]

    def bag(label):
        w = list(rng.choice(common, 64 * 40))
        for i in range(12):
            w[64 * 37 + 5 * i] = marks[i % 3] if label else word()
        return " ".join(w)

    y = np.array([i % 2 for i in range(120)], float)
    bags = [bag(t) for t in y]
    p, m = quality_mil.passages(bags[:80]), quality_mil.GatedAttention()
    assert len(p.doc) == 80 * 40
    m.fit(p.stats.astype(float), counts_of(p), p.doc, y[:80], np.ones(80))
    assert ((m.score(bags[80:]) > 0.5) == (y[80:] == 1)).mean() > 0.9


def plain_quality(m, text):
    """Passages, encodings, attention and score of one text, in plain loops."""
    words = [(x.start(), x.end()) for x in WORD.finditer(text)]
    groups = [words[i : i + quality_mil.PASSAGE] for i in range(0, len(words), quality_mil.PASSAGE)] or [[]]
    hashed = lambda x: int(Texts([x]).span_hash(np.array([0]), np.array([len(x)]))[0])
    seen, seen2, last, encoded = set(), set(), None, []
    for group in groups:
        w = [text[a:b] for a, b in group]
        n, chars, out = max(len(w), 1), max(sum(map(len, w)), 1), []
        old = old2 = same = 0
        here = set()
        for x in w:
            old += x in seen
            seen.add(x)
            if last is not None:
                old2 += (last, x) in seen2
                seen2.add((last, x))
                same += last == x
            here.add(x)
            last = x
        share = lambda f: sum(f(c) for x in w for c in x) / chars
        letter = lambda c: c.isalnum() if ord(c) < 65535 else True
        marks = quality_mil.SYMBOLS
        out = [old / n, old2 / n, same / n, 1 - (len(w) - len(here)) / n, sum(len(x) == 1 and not letter(x) for x in w) / n, sum(x[-1] in marks for x in w) / n, share(lambda c: c in marks), share(lambda c: "A" <= c <= "Z"), share(lambda c: "0" <= c <= "9"), share(letter), share(lambda c: ord(c) > 127), share(lambda c: c in ".,"), np.log1p(chars / n), np.log1p(len(w)), sum(len(x) > 30 for x in w) / n, np.log1p(len(words))]
        if not len(words):
            out = [0.0] * quality_mil.FEATURES
        count = np.zeros(quality_mil.BUCKETS)
        for x in w:
            for i, part in enumerate((x, x[: quality_mil.AFFIX], x[-quality_mil.AFFIX :])):
                count[int(mix(np.array([hashed(part) + 7 * i & (2**64 - 1)], np.uint64))[0] % quality_mil.BUCKETS)] += 1
        x = np.clip((np.array(out) - m.mean) / m.scale, -6, 6)
        encoded.append(np.tanh(x @ m.p["W"] + count / max(np.sqrt((count**2).sum()), 1) @ m.p["E"] + m.p["b"]))
    gate = np.array([float((np.tanh(h @ m.p["V"]) / (1 + np.exp(-(h @ m.p["U"])))) @ m.p["w"]) for h in encoded])
    alpha = np.exp(gate - gate.max()) / np.exp(gate - gate.max()).sum()
    z = sum(a * h for a, h in zip(alpha, encoded))
    return 1 / (1 + np.exp(-(z @ m.p["u"] + m.p["c"][0])))


def test_quality_scores_equal_plain_loops(spark):
    docs = smoke(spark, "documents")
    m = quality_mil.fit_quality(docs, smoke(spark, "labels"))
    texts = [r["text"] or "" for r in docs.orderBy(F.xxhash64("doc_id")).limit(40).collect()] + [t or "" for _, t, _ in ODD]
    assert np.abs(m.score(texts) - np.array([plain_quality(m, t) for t in texts])).max() < 1e-4


def test_fitted_sample_is_bounded(spark):
    """A hot id gives one row, whatever the order, and long texts enter only while there is room."""
    docs = spark.createDataFrame([(1, "x" * (i % 7)) for i in range(50)] + [(i, "y" * 10 * i) for i in range(2, 30)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, quality int")
    a, b = (sorted(map(tuple, labelled_texts(d, known, "quality", per_class=9, max_chars=1000).collect())) for d in (docs, docs.repartition(5)))
    assert a == b and len({r[0] for r in a}) == len(a) <= 18 and sum(len(r[2]) for r in a) <= 1000 and len(a) > 3


def test_identity_terms_do_not_raise_scores(spark):
    toxic = [(i, f"you women are stupid trash number w{i}") for i in range(60)]
    clean = [(100 + i, f"the men went to the market w{i} w{i * 7}") for i in range(120)]
    docs = spark.createDataFrame(toxic + clean, "doc_id long, text string")
    known = spark.createDataFrame([(i, 1) for i, _ in toxic] + [(i, 0) for i, _ in clean], "doc_id long, toxic int")
    neutral = ["the women went to the market", "the men went to the market", "stupid trash"]
    gap = {}
    for fairness in (0.0, 20.0):
        s = toxicity.fit_toxicity(docs, known, fairness=fairness).score(neutral)
        gap[fairness] = s[0] - s[1]
        assert s[2] > 0.5
    assert gap[20.0] < 0.05 and gap[20.0] < gap[0.0]


@pytest.mark.parametrize(("named", "other"), [("transgender", "straight"), ("muslims", "christians"), ("immigrants", "natives"), ("musulmans", "chrétiens"), ("frauen", "männer"), ("negros", "blancos")])
def test_no_term_of_the_list_changes_a_score(spark, named, other):
    """Toxic rows name one group and clean rows another; still all terms of any line score alike, and neutral mentions stay clean."""
    toxic = [(i, f"you {named} are stupid trash number w{i}") for i in range(60)]
    clean = [(100 + i, f"the {other} went to the market w{i} w{i * 7}") for i in range(120)]
    docs = spark.createDataFrame(toxic + clean, "doc_id long, text string")
    known = spark.createDataFrame([(i, 1) for i, _ in toxic] + [(i, 0) for i, _ in clean], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, known)
    for line in toxicity.IDENTITY:
        s = model.score([f"the {term} went to the market" for term in line.split()])
        assert s.max() - s.min() < 0.05 and s.max() < 0.5, line
    assert model.score([f"you {other} are stupid trash"])[0] > 0.5


def test_swaps_equal_swapped_texts():
    others = toxicity.partners()
    texts = ["the women met Women and a womens club", "muslims and christians, a muslim", "no term here", "", "Black blacks blackbird", "frauen männer frauen"]
    seen = 0
    for text in texts:
        before = set(toxicity.features([text])[1].tolist())
        for term, other, out, come in toxicity.swapped_features(text, others):
            after = set(toxicity.features([re.sub(rf"\b{term}\b", other, text.lower())])[1].tolist())
            assert (before - after, after - before) == (out, come), (text, term, other)
            seen += 1
    assert seen > 20


def test_toxicity_scores_equal_plain_loops(spark):
    docs = smoke(spark, "documents")
    model = toxicity.fit_toxicity(docs, smoke(spark, "labels"))
    weight = dict(zip(model.keys.tolist(), model.weight))
    texts = [r["text"] or "" for r in docs.orderBy(F.xxhash64("doc_id")).limit(60).collect()] + [t or "" for _, t, _ in ODD]
    for text, score in zip(texts, model.score(texts)):
        found = set()
        for w in re.findall(r"[^\W_]+", text.lower()):
            t = Texts([w])
            found.add(int(t.span_hash(np.array([0]), np.array([len(w)]))[0]))
            for k in toxicity.PREFIXES:
                if len(w) > k:
                    found.add(int(mix(t.span_hash(np.array([0]), np.array([k])) + np.uint64(k))[0]))
        z = model.bias + sum(weight.get(h, 0.0) for h in found)
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9


# --- op2


def regex_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_pattern_spans_equal_the_expressions():
    rng = np.random.default_rng(1)
    parts = ["a", "B.", "@", "@x.co", "x@y.z.", "1", "12", "255", "256", ".", "-", " ", "+1", "(", ")", "4111111111111111", "é", "%", "_@-.-", "\n", "0"]
    for _ in range(6000):
        text = "".join(rng.choice(parts, rng.integers(1, 14)))
        assert pii_crf.base_spans(text) == regex_spans(text), text
    pii_crf.base_spans("9" * 30_000 + ".1.1.1" + "a" * 30_000)


@pytest.fixture(scope="module")
def tagger():
    return pii_crf.fit_pii()


def test_tagger(tagger):
    ids, tags = pii_crf.encode(pii_crf.synthetic_windows(200, seed=77))
    assert (tagger.posterior(ids).argmax(2) == tags).mean() > 0.96
    two = "4539578763621486 4485983356242217"
    text = "word " * 200 + two + " and +1 (826) 555-4081 190.137.223.20 end"
    (base, added), = pii_crf.find_pii([text], tagger)
    assert not any(k == "card" for k, _, _ in base) and {text[a:b] for k, a, b in added if k == "card"} == set(two.split())
    assert pii_crf.model_spans(["no carriers here " * 100], tagger) == [[]]
    assert pii_crf.redact("a b@c.de f", [("email", 2, 8)]) == "a [EMAIL] f"


def test_tagger_finds_what_patterns_miss(tagger):
    """Recall by kind on held-out spans that are spaced, split or spelt out, and how many of all that is added is right."""
    windows = pii_crf.synthetic_windows(500, seed=99, missed=1.0)
    right, there, added, false = Counter(), Counter(), 0, 0
    for (text, spans), (base, more) in zip(windows, pii_crf.find_pii([t for t, _ in windows], tagger)):
        whole = [x for x in spans if x[1] > 0 and x[2] < len(text) and not any(x[1] < e and s < x[2] for _, s, e in base)]
        there.update(k for k, _, _ in whole)
        right.update(k for k, a, b in whole if (k, a, b) in more)
        added += len(more)
        false += sum(x not in spans for x in more)
    assert set(there) == set(pii_crf.KINDS) and all(right[k] >= 0.8 * there[k] for k in there), (right, there)
    assert false <= 0.05 * added


def mixed_texts():
    rng = np.random.default_rng(3)
    pieces = [t for t, _ in pii_crf.synthetic_windows(60, seed=5)]
    return ["", "x" * 500, *[("plain words only " * int(rng.integers(0, 40))) + str(rng.choice(pieces)) + " tail " * int(rng.integers(0, 60)) + str(rng.choice(pieces)) for _ in range(40)], "7" * 3000, " a@b" * 300]


def test_no_window_left_out_changes_a_span(tagger):
    texts = mixed_texts()
    every = [np.arange(len(t)) for t in texts]
    assert pii_crf.model_spans(texts, tagger) == pii_crf.model_spans(texts, tagger, places=every) != [[] for _ in texts]


def plain_viterbi(em, trans):
    score, back = [em[0][j] if j == 0 else -1e4 + em[0][j] + trans[0][j] * 0 for j in range(len(em[0]))], []
    for row in [*em[1:], [0.0] + [-1e4] * 8]:
        way = [max(range(len(row)), key=lambda i: (score[i] + trans[i][j], -i)) for j in range(len(row))]
        score = [score[i] + trans[i][j] + row[j] for j, i in enumerate(way)]
        back.append(way)
    out = [int(np.argmax(score))]
    for way in back[::-1]:
        out.append(way[out[-1]])
    return out[:0:-1]


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 200, 333])
def test_viterbi_equals_plain_loop(tagger, n):
    rng = np.random.default_rng(n)
    em, trans = rng.normal(0, 3, (n, 9)).astype(np.float32), pii_crf.transitions(tagger)
    em[0, 1:] = pii_crf._FORBIDDEN
    tags = pii_crf.viterbi(em, trans)
    assert tags.tolist() == plain_viterbi(em.astype(float).tolist(), trans.astype(float).tolist())
    assert all(b % 2 or not b or a in (b - 1, b) for a, b in zip(tags, tags[1:]))


def test_long_texts_take_linear_time(tagger):
    took = []
    for n in (100_000, 200_000, 400_000):
        began = time.process_time()
        pii_crf.base_spans("9" * n)
        pii_crf.base_spans("1." * (n // 2))
        pii_crf.base_spans("+1" + "(" * n)
        took.append(time.process_time() - began)
    assert took[2] < 8 * max(took[0], 0.05)
    assert pii_crf.find_pii(["9" * 200_000], tagger)[0] == ([], [])


def test_pii_rows(spark, tagger):
    rows = [*ODD, (9, "mail a.b@c.example.com or 10.0.0.1", "a")]
    got = {r["doc_id"]: r for r in pii_crf.detect(odd(spark, rows), tagger).collect()}
    assert [s["kind"] for s in got[9]["base_spans"]] == ["email", "ip"] and got[2]["base_spans"] == [] and got[9]["score"] == 1
    assert {r["doc_id"]: r["text"] for r in pii_crf.mask(odd(spark, rows), tagger).collect()}[9] == "mail [EMAIL] or [IP]"
    assert pii_crf.detect(odd(spark).limit(0), tagger).count() == 0 and pii_crf.mask(odd(spark).limit(0), tagger).count() == 0
    clash = odd(spark).withColumn("base_spans", F.lit("own")).withColumn("added_spans", F.lit(1)).withColumn("__text", F.lit(2))
    assert sorted(pii_crf.detect(clash, tagger).columns) == sorted(clash.columns) and pii_crf.detect(clash, tagger).where("doc_id = 2").first()["base_spans"] == []


def plain_model_spans(text, tagger):
    """Every window of the text by itself, emissions joined, one plain Viterbi over the whole text."""
    carriers = [m.start() for m in re.finditer(r"[0-9@]|[\[(] ?[aA][tT] ?[\])]", text)]
    outside = np.array([0.0] + [-1e4] * 8)
    em, post = [outside], [outside]
    codes = np.concatenate([pii_crf.symbols(text), np.zeros(pii_crf.WINDOW, np.int64)])
    for i in range(len(text)):
        k = max(0, (i - pii_crf.STEP // 2) // pii_crf.STEP)
        if not any(abs(i - c) <= pii_crf.REACH for c in carriers):
            em.append(outside)
            post.append(outside)
            continue
        ids = codes[None, k * pii_crf.STEP : k * pii_crf.STEP + pii_crf.WINDOW]
        em.append(tagger.emissions(ids)[0][0, i - k * pii_crf.STEP].astype(float))
        post.append(tagger.posterior(ids)[0, i - k * pii_crf.STEP])
    tags = plain_viterbi([list(x) for x in em], pii_crf.transitions(tagger).astype(float).tolist())
    out, i = [], 1
    while i < len(tags):
        j = i + 1
        if tags[i] % 2:
            while j < len(tags) and tags[j] == tags[i] + 1:
                j += 1
            if min(post[x][tags[x]] for x in range(i, j)) >= pii_crf.SURE:
                out.append((pii_crf.KINDS[tags[i] // 2], i - 1, j - 1))
        i = j
    return out


def test_model_spans_equal_plain_decoding(tagger):
    texts = mixed_texts()[2:14]
    assert pii_crf.model_spans(texts, tagger) == [plain_model_spans(t, tagger) for t in texts]


# --- op3


def sainte_lague(values, seats):
    got = [0] * len(values)
    for _ in range(seats):
        i = max(range(len(values)), key=lambda j: (values[j] / (2 * got[j] + 1), -j))
        got[i] += 1
    return got


def test_apportionment(spark):
    rng = np.random.default_rng(3)
    rows, expect = [], {}
    for g in range(12):
        v = [float(x) for x in rng.integers(0, 1000, rng.integers(1, 9))]
        if not sum(v):
            v[0] = 1.0
        seats = int(rng.integers(0, 60))
        expect.update({(g, i): n for i, n in enumerate(sainte_lague(v, seats))})
        rows += [(g, i, x, seats) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "g int, i int, v double, seats long")
    assert {(r["g"], r["i"]): r["n"] for r in mixing.apportion(df, ["g"], "v", "seats", ["i"], "n").collect()} == expect


def targets(sizes, cap=3):
    """The stated rule: share by weight, cap, share the excess again, until none is above."""
    keys = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = dict(zip(keys, [(5, 2, 1)[i % 3] for i in range(len(keys))]))
    out, left, free = {}, sum(sizes.values()), set(keys)
    while free:
        unit = left / sum(w[k] for k in free)
        over = {k for k in free if unit * w[k] > cap * sizes[k]}
        if not over:
            return out | {k: unit * w[k] for k in free}
        for k in over:
            out[k] = cap * sizes[k]
            left -= out[k]
        free -= over
    return out


def test_mix(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 300))), s) for i, s in enumerate(["a"] * 5 + ["b"] * 300 + ["c"] * 80 + [None] * 40 + ["é"] * 60)]
    docs = spark.createDataFrame([*rows, (900, None, "a"), (901, "", "b")], "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    for shard in (1_500, 10**9):
        out = mixing.mix_sources(docs, shard_words=shard)
        got = out.collect()
        assert sorted(out.collect()) == sorted(got) and len(got) == len(rows) + 2
        size = defaultdict(int)
        for r in got:
            size[r["source"]] += r["size"]
        want, taken = targets(size), defaultdict(int)
        for r in got:
            assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
        assert all(abs(taken[s] - want[s]) <= 40 * mixing.BLOCK for s in size), (shard, taken, want)
    mixed = mixing.mixed_documents(docs, mixing.mix_sources(docs))
    assert mixed.columns == docs.columns and mixed.where("doc_id in (900, 901)").count() == 0


def test_null_ids_are_spread_over_shards(spark):
    rows = [(None, " ".join([f"w{i}"] * 20), "a") for i in range(200)] + [(i, "w " * 30, "b") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted(tuple(r) for r in mixing.mix_sources(docs.repartition(n), shard_words=400).select("size", "source", "taken").collect()) for n in (3, 7))
    assert a == b and len(a) == 250


def test_mix_bears_odd_rows(spark):
    assert mixing.mix_sources(odd(spark)).count() == len(ODD)
    assert mixing.mix_sources(odd(spark).limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix_sources(odd(spark).where("doc_id in (2, 3, 4)")).collect()} == {0}


# --- op4


def test_archives(spark):
    fake = "x" + warc.MAGIC + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    rows = [(1, "u", "a" + warc.MAGIC + "b"), (2, "u", fake * 3), (3, None, None), (4, "u", ""), (None, "u", "no id"), (5, "u\r\nx y", "same"), (6, "u", "same"), (7, "u", warc.MAGIC), (8, "u", ("é" + warc.MAGIC) * 5), (9, "u", fake[1:] * 2), (9, "v", fake[1:] * 2), (10, "u", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0)).withColumn("value", F.lit(0))
    ids = defaultdict(list)
    for i, _, h in rows:
        ids[h or ""].append(i)
    want = []
    for i, _, h in rows:
        raw, top = (h or "").encode(), max((x for x in ids[h or ""] if x is not None), default=None)
        again = len(ids[h or ""]) > 1 and i != top
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None))
    conf = "spark.sql.files.maxPartitionBytes"
    for split in ("128m", "20k"):
        spark.conf.set(conf, split)
        got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(pages).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    spark.conf.unset(conf)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.archive_round_trip(pages, min_bytes=10**9).collect()} == {"response"}


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_reading_archives_does_not_depend_on_splits(spark, tmp_path, compression):
    """The files are split otherwise after the plan is made: every page is still one record."""
    pages = smoke(spark, "pages").select("page_id", "url", F.concat("html", F.lit(warc.MAGIC), "html").alias("html"))
    path, conf, cost = str(tmp_path / "archive"), "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    warc.write_archives(pages, path, records=60, compression=compression)
    spark.conf.set(conf, "64k")
    spark.conf.set(cost, "1k")
    plan = warc.read_archives(spark, path)
    spark.conf.set(conf, "300k")
    spark.conf.unset(cost)
    got = {r["record_id"]: r["payload"] for r in plan.where("warc_type = 'response'").collect()}
    spark.conf.unset(conf)
    want = {f"<urn:page:{r['page_id']}>": r["html"] for r in pages.collect()}
    assert plan.count() == len(want) and all(want[k] == v for k, v in got.items()) and len(set(want.values())) == len(got)


# --- op6


def rules(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered, seen, again = set(), set(), 0
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)]


def test_rules(spark):
    docs = smoke(spark, "documents")
    fitted = rules_forest.fit_rules(docs, smoke(spark, "labels"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = rules_forest.apply_rules(docs, fitted).join(smoke(spark, "labels"), "doc_id", "left").collect()
    for r in out:
        n = rules(text[r["doc_id"]])
        assert [r[c] for c in rules_forest.COUNTS] == n and r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r["base_failed"] and r["kept"])
    good = [r for r in out if r["quality"] == 1 and not r["base_failed"]]
    assert np.mean([r["kept"] for r in good]) >= 0.98
    for rows, known in ((odd(spark), labels(spark)), (odd(spark).limit(0), labels(spark).limit(0))):
        got = rules_forest.apply_rules(rows, rules_forest.fit_rules(rows, known)).collect()
        assert len(got) == rows.count()


def test_rules_are_fitted_on_all_labelled_rows(spark):
    rng = np.random.default_rng(5)
    pool = ["".join(rng.choice(list("abcdeXYZ!#"), rng.integers(1, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(pool[: 400 if i % 7 else 30 + i % 300], 60)) + " ?" * int(rng.integers(0, 9)) for i in range(5000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(5000)], "doc_id long, quality int")
    fitted = rules_forest.fit_rules(docs, known)
    counts, ratios = rules_forest.rule_statistics(texts)
    ok = (counts[:, 0] >= 50) & (100 * counts[:, 4] <= 50 * counts[:, 0])
    s, y = fitted.forest.score(ratios[ok]), (np.arange(5000) % 7 > 0)[ok]
    floor = np.quantile(s[y], 0.99)
    cuts = np.unique(np.concatenate([[floor], s[s >= floor]]))
    gain = [(s[~y] > c).mean() - 4 * (s[y] > c).mean() for c in cuts]
    assert y.sum() > 4000 and (~y).sum() > 300 and fitted.threshold == cuts[int(np.argmax(gain))]
    again = rules_forest.fit_rules(docs.repartition(7).unionByName(docs), known)
    assert again.threshold == fitted.threshold and (again.forest.cut == fitted.forest.cut).all()
    drawn = rules_forest.draw_rows(docs.select(F.xxhash64("doc_id").alias("h"), F.encode(F.format_string("%072d", "doc_id"), "utf-8").alias("x")), 5000, size=20)
    named = [{int(v.tobytes()) for v in d} for d in drawn]
    assert all(len(d) == 20 for d in named) and 1500 < len(set().union(*named)) < 1800
    one = rules_forest.fit_rules(docs.where("doc_id = 1"), known)
    assert one.apply([texts[1]])["kept"].tolist() == [True]


def test_forest_isolates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1000, 4))
    s = rules_forest.IsolationForest(x).score(np.concatenate([x, np.full((1, 4), 9.0)]))
    assert s[-1] > s[:-1].max()


# --- op7


def bag(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def near(texts, threshold=0.8):
    """Classes by brute force, by text; texts without words stand alone."""
    names = sorted({t for t in texts if bag(t)})
    bags, root = [bag(t) for t in names], list(range(len(names)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(names)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both >= threshold * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {t: find(i) for i, t in enumerate(names)}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(2)
    left, right = [], []
    for i in range(60):
        a = [f"w{rng.integers(5000)}" for _ in range(200)]
        b = list(a)
        for j in rng.integers(0, 200, i // 3):
            b[j] = "other"
        left.append(" ".join(a + a[:40] * (i % 4)))
        right.append(" ".join(b))
    exact = bagminhash.multiset_jaccard(left, right)
    for x, y, j in zip(left, right, exact):
        both = sum((bag(x) & bag(y)).values())
        assert abs(j - both / (sum(bag(x).values()) + sum(bag(y).values()) - both)) < 1e-12
    sig = lambda ts: bagminhash.bag_signatures(*counted(*shingles(Texts(ts), 5)), len(ts), 1024)
    error = (sig(left) == sig(right)).mean(1) - exact
    assert abs(error.mean()) < 0.01 and np.abs(error).max() < 0.08


def test_near_duplicates(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for g in range(12):
        base = [f"g{g}w{rng.integers(999)}" for _ in range(150)]
        for _ in range(10):
            t = list(base)
            for j in rng.integers(0, 150, rng.integers(0, 6)):
                t[j] = f"x{rng.integers(9999)}"
            rows.append((n, " ".join(t), "s"))
            n += 1
    rows += [(n, rows[0][1], "s"), (n + 1, "two words", "s"), (n + 2, "two words", "s"), (n + 3, "two  words", "s"), *[(i + 5000 if i else None, t, s) for i, t, s in ODD]]
    docs = odd(spark, rows)
    want, text = near([t for _, t, _ in rows]), dict((i, t) for i, t, _ in rows)
    for chars, count in ((3_000_000, 1000), (4_000, 4), (20_000, 3)):
        monkeypatch.setattr(bagminhash, "BLOCK_CHARS", chars)
        monkeypatch.setattr(bagminhash, "BLOCK_TEXTS", count)
        out = bagminhash.near_duplicates(docs).collect()
        assert len(out) == len(rows)
        least = {}
        for i, t, _ in rows:
            if t in want and i is not None:
                least[want[t]] = min(i, least.get(want[t], i))
        for r in out:
            t = text[r["doc_id"]]
            assert r["component_id"] == (least.get(want[t]) if t in want else r["doc_id"]), t
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(want.values())) + 3
    assert bagminhash.near_duplicates(docs.limit(0)).count() == 0


def test_overlaps_equal_counters():
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", f"z{i % 5}"], 40 + i % 30)) for i in range(70)]
    doc, h, c = bagminhash._elements(texts, 5)
    left = np.array([0, 3, 17, 69])
    got = bagminhash.overlaps(doc, h, c, len(texts), left)
    want = [[sum((bag(texts[i]) & bag(t)).values()) for t in texts] for i in left]
    assert all(got[r, j] == want[r][j] for r, i in enumerate(left) for j in range(len(texts)) if i != j)


def test_no_link_of_a_bucket_is_lost(spark, monkeypatch):
    """Chains of texts, each near the next and few near the first, that share buckets: what the leader does not settle is compared."""
    rng = np.random.default_rng(12)
    rows = []
    for g in range(6):
        w = [f"g{g}w{i}" for i in range(120)]
        for _ in range(25):
            w = list(w)
            for j in rng.integers(0, 120, 2):
                w[j] = f"x{rng.integers(99999)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = near([t for _, t in rows])
    least = {}
    for i, t in rows:
        least[want[t]] = min(i, least.get(want[t], i))
    for texts in (1000, 5):
        monkeypatch.setattr(bagminhash, "BLOCK_TEXTS", texts)
        got = {r["doc_id"]: r["component_id"] for r in bagminhash.near_duplicates(docs).collect()}
        assert got == {i: least[want[t]] for i, t in rows}


# --- op8


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "a\\[INST]", "[\\INST]", "", None, "[ROLE x] y [/ROLE]", "<s>\\\\</s>", " lead and trail ", "line\nbreak", "😀"]
    rows = [(c, t, r, texts[(c + 3 * t) % len(texts)]) for c in range(8) for t, r in enumerate(["system", "user", "assistant", "user", "assistant", None, "odd]role~1", "assistant"])]
    rows += [(None, 0, "user", "x"), (50, 1, "assistant", "b"), (50, 1, "assistant", "b"), (51, 0, "user", "no reply")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    packed = chat.conversations(chat.format_turns(df))
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    for r in chat.read_back(packed).collect():
        assert [(x["role"], x["text"]) for x in r["turns"]] == [x[1:] for x in sorted(by[r["conv_id"]])]
    out = {r["conv_id"]: r for r in chat.digests(packed).collect()}
    assert len(out) == len(by)
    for c, turns in by.items():
        turns, r = sorted(turns), out[c]
        learnt = "".join(x for _, role, x in turns if role == "assistant")
        said = "".join(f"{role}\n{x}\n" for _, role, x in turns)
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.examples(packed).where("example is not null").count() == sum(r[2] == "assistant" for r in rows)
    assert chat.digests(chat.conversations(chat.format_turns(df.limit(0)))).count() == 0


def escaped(text):
    return re.sub(r"([\[<])(?=INST\]|/INST\]|/?s>|ROLE |/ROLE\])", r"\1\\", text.replace("\\", "\\\\"))


def test_examples_equal_full_copies(spark):
    """One example for each assistant turn: all turns before it as the prompt, its own text as the target, whatever the texts hold."""
    rng = np.random.default_rng(11)
    parts = ["</s>", "[INST]", "[/INST]", "\\", "ok", "\n", "😀", "<s>", " ", "[ROLE x]"]
    rows = [(c, t, str(rng.choice(["user", "assistant", "assistant", "tool"])), "".join(rng.choice(parts, rng.integers(0, 6)))) for c in range(30) for t in range(int(rng.integers(1, 9)))]
    rows += [(None, t, r, "x") for t, r in enumerate(["user", "assistant"])]
    want = []
    for c in {r[0] for r in rows}:
        said, n = "", 0
        for _, _, role, text in sorted((r for r in rows if r[0] == c), key=lambda r: r[1]):
            if role == "assistant":
                n += 1
                want.append((c, n, said, escaped(text)))
            said += {"user": f"[INST] {escaped(text)} [/INST]", "assistant": f"{escaped(text)}</s>"}.get(role, f"[ROLE {role}] {escaped(text)} [/ROLE]")
    convs = chat.conversations(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert sorted(((r["conv_id"], r["example"], r["prompt"], r["target"]) for r in chat.render(convs).collect()), key=str) == sorted(want, key=str)
    for r in chat.assembled(chat.examples(convs)).collect():
        assert all(r["formatted"][x["start"] : x["end"]] == x["target"] for x in r["loss"])


def test_loss_comes_from_examples(spark, monkeypatch):
    """The query's loss is that of its example rows: without the later examples only the first reply is learnt; and no Python runs."""
    every = chat.examples
    rows = [(c, t, "assistant" if t % 2 else "user", "ab" * t) for c in (1, None) for t in range(6)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.digests(chat.conversations(chat.format_turns(turns)))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan or "Generate posexplode" in plan
    assert not re.search("Python|Pandas|Arrow", plan) and plan.count("Exchange hashpartitioning") == 1
    whole = {r["conv_id"]: r["loss_chars"] for r in done.collect()}
    monkeypatch.setattr(chat, "examples", lambda convs: every(convs).where("example = 1"))
    first = {r["conv_id"]: r["loss_chars"] for r in chat.digests(chat.conversations(chat.format_turns(turns))).collect()}
    assert whole == {1: 18, None: 18} and first == {1: 2, None: 2}


# --- op9


def brute_links(rows, threshold=0.98):
    unit = {}
    for n, (_, v, label) in enumerate(rows):
        x = np.array([np.nan if y is None else y for y in v] if v is not None else [], float)
        if label is not None and len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
            unit[n] = (label, x / np.sqrt((x * x).sum()))
    link = defaultdict(set)
    for a in unit:
        for b in unit:
            if a < b and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= threshold:
                link[a].add(b)
                link[b].add(a)
    return link


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            c = rng.normal(size=16)
            rows += [(c + rng.normal(size=16) * 0.08, label) for _ in range(9)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]
    n = len(rows)
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 2, None, 0), (n + 3, [0.0] * 16, 0), (n + 4, [float("nan")] * 16, 0), (n + 5, [None] * 16, 1), (n + 6, [1.0, 2.0], 0), (n + 7, [], 0), (n + 8, [float("inf")] + [0.0] * 15, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("unit", F.lit(0))
    link, seen = brute_links(rows), {}
    for i in range(len(rows)):
        if i not in seen:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen[x] = i
                    todo += link[x]
    for block, cluster in ((3000, 500), (20, 40)):
        monkeypatch.setattr(graph_dedup, "BLOCK", block)
        monkeypatch.setattr(graph_dedup, "CLUSTER_NODES", cluster)
        out = graph_dedup.link_embeddings(df)
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out.collect()}
        assert got == {i: (len(link[i]), seen[i], seen[i] == i) for i in range(len(rows))}
    audit = graph_dedup.audit_recall(df, out).first()
    assert audit["found"] == audit["expected"] > 0
    assert graph_dedup.link_embeddings(df.limit(0)).count() == 0


def test_links_beyond_shared_clusters(spark, monkeypatch):
    """Clusters smaller than a link is long: most links are of vectors that share no cluster, and each counts at both ends."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(rng.normal(size=(700, 3)))]
    link = brute_links(rows)
    monkeypatch.setattr(graph_dedup, "CLUSTER_NODES", 9)
    out = graph_dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert {r["vec_id"]: r["n_links"] for r in out.collect()} == {i: len(link[i]) for i in range(len(rows))}


def test_graph_reaches_everything():
    x = np.random.default_rng(0).normal(size=(400, 8))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    adj, seen, todo = graph_dedup.build_graph(x), set(), [graph_dedup.medoid(x)]
    while todo:
        i = todo.pop()
        if i not in seen:
            seen.add(i)
            todo += adj[i].tolist()
    assert len(seen) == 400


# --- op10


@pytest.fixture(scope="module")
def tok():
    return bpe.load_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def tok_bytes(tok, _held={}):
    if tok.key not in _held:
        _held[tok.key] = {r: t for t, r in bpe.read_ranks(tok.ranks).items()}
    return _held[tok.key]


def test_ids_equal_the_ranks_own(spark, tok):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(tok.ranks), special_tokens={})
    rng = np.random.default_rng(8)
    pool = [chr(i) for i in [*range(256), 0x1680, 0x2028, 0x200B, 0x3000, 0xFEFF, 0x301, 0x1F600, 0x661, 0x2167, 0x4E2D, 0x10FFFF]] + ["'s", "'LL", "  ", "the", "ing", "<|endoftext|>", "1234"]
    texts = ["".join(rng.choice(pool, rng.integers(0, 14))) for _ in range(3000)] + [None, "", "a" * 50_000, " " * 5000]
    got = tok.encode(texts)
    assert got == [own.encode_ordinary(t or "") for t in texts]
    assert all(tok.decode(i) == (t or "").encode() for t, i in zip(texts, got))
    for text, e in zip(texts, tok.encode_all(texts)):
        text = text or ""
        assert bpe.spans(e, len(text)) and e.said == " ".join(map(str, e.ids.tolist()))
        whole = text.encode()
        at = np.cumsum([0] + [len(c.encode()) for c in text])
        byte = 0
        for i, a, b in zip(e.ids.tolist(), e.starts, e.ends):
            size = len(tok.decode([i]))
            assert at[a] <= byte and byte + size <= at[b] and whole[byte : byte + size] == tok.decode([i])
            byte += size
    split = tok.encode(["\U0010ffff"])[0]
    assert len(split) > 1 and all("\ufffd" in tok.decode_text([i]) for i in split) and tok.decode_text(split) == "\U0010ffff"
    assert all(tok.decode([i]) == b for i, b in tok_bytes(tok).items())
    rows = odd(spark)
    out = {r["doc_id"]: r for r in bpe.token_digests(spark, rows, tok).collect()}
    assert out[2]["n_tokens"] == 0 and out[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest() and out[5]["decoded_sha256"] == hashlib.sha256(b"long " * 20_000).hexdigest()
    assert all(r["spanned"] for r in out.values())
    clash = rows.withColumn("ids", F.lit("own")).withColumn("offsets", F.lit(1)).withColumn("decoded", F.lit(2))
    back = bpe.decode_documents(spark, bpe.encode_documents(spark, clash, tok), tok).where("doc_id = 6").first()
    assert bytes(back["decoded"]).decode() == ODD[-1][1] and back["offsets"][0]["start"] == 0 and back["offsets"][-1]["end"] == len(ODD[-1][1])
    assert sorted(back.asDict()) == sorted([*rows.columns, "ids", "offsets", "decoded"])
    assert bpe.token_digests(spark, rows.limit(0), tok).count() == 0 and bpe.decode_documents(spark, bpe.encode_documents(spark, clash.limit(0), tok), tok).count() == 0


def test_bpe_asks_once_for_frequent_matches(tok, monkeypatch):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(tok.ranks), special_tokens={})
    t, asked = tok.tools, Counter()
    t.clear()
    learn = t.learn
    monkeypatch.setattr(bpe, "CACHE", 60)
    monkeypatch.setattr(t, "learn", lambda new: (asked.update(new), learn(new)))
    for i in range(30):
        text = " common" * 5 + " wörd😀" * 3 + "".join(f" n{chr(97 + i % 26)}{chr(97 + j)}{i}" for j in range(20)) + "\u0e33\U0001f9ff"
        (e,) = tok.encode_all([text])
        assert e.ids.tolist() == own.encode_ordinary(text) and tok.decode(e.ids.tolist()).decode() == text and bpe.spans(e, len(text))
    t.clear()
    assert asked[" common"] == asked[" w\u00f6rd"] == 1


def test_bpe_query(spark, tok):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(tok.ranks), special_tokens={})
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    out = queries.op10_byte_bpe(spark, SMOKE).collect()
    assert len(out) == len(text)
    for r in out:
        ids = own.encode_ordinary(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["spanned"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[r["doc_id"]].encode()).hexdigest(), True)


def test_pii_query(spark, tagger):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").collect()}
    out = queries.op2_pii_crf(spark, SMOKE).collect()
    assert len(out) == len(docs)
    for r in out:
        base = regex_spans(docs[r["doc_id"]])
        line = [f"{k}:{a}:{b}" for k, a, b in sorted(base, key=lambda x: (pii_crf.KINDS.index(x[0]), x[1]))]
        assert [r[f"n_{k}"] for k in pii_crf.KINDS] == [sum(x[0] == k for x in base) for k in pii_crf.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(line).encode()).hexdigest()
        more = [x for x in plain_model_spans(docs[r["doc_id"]], tagger) if pii_crf.plausible(x[0], docs[r["doc_id"]][x[1] : x[2]]) and not any(x[1] < e and s < x[2] for _, s, e in base)] if re.search(r"[0-9@]|(?i:[\[(] ?at ?[\])])", docs[r["doc_id"]]) else []
        assert r["spans"] == pii_crf.ordered(base + more)
