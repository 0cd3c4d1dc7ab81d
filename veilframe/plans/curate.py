"""Curating a vocabulary from candidate sources, as one chain of DataFrames: scan, clean, merge, classify, corpus run, judge, sinks."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.functions.folding import fold_column
from veilframe.functions.scalars import cache_key, cell, niceness
from veilframe.operators.dictionary import Dictionary, Term
from veilframe.operators.redaction import term_hits
from veilframe.sources.config import Recipe, Thresholds, label

#: Prefixes of titles that are no subject's name, and the longest title.
NAMESPACES = "Category Template Portal Wikipedia Help File Draft Module Appendix Thesaurus Rhymes Reconstruction Citations Concordance Index Wiktionary Special".split()
LIST_STARTS = ["list of", "lists of", "outline of", "index of", "timeline of", "glossary of", "bibliography of"]
MAX_WORDS, MAX_FILE_BYTES, MAX_FILES, SNIFF, BATCH, SHOWN_DROPS = 5, 1_000_000, 20_000, 8192, 20, 200
#: Ranges that an even sample is ranked in.
SPLITS = 256
#: Files that are text, and folders never entered.
TEXT_SUFFIXES = ".md .txt .py .ts .tsx .js .json .toml .yaml .yml .html .css .rs .go .java .cs .ps1 .sh".split()
SKIPPED_FOLDERS = "node_modules .git .venv venv dist build target __pycache__ .next".split()


# --- scans


def category_members(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """Distinct pages below a category, to a depth: one join a level, categories already seen left out.

    edges: parent, ns (0 a page, 14 a category), title.
    """
    spark = edges.sparkSession
    level = spark.createDataFrame([(root,)], "parent string")
    seen, pages = level, None
    for d in range(depth + 1):
        below = edges.join(level, "parent").select("ns", "title").distinct()
        found = below.where("ns = 0").select("title", F.lit(d).alias("level"))
        pages = found if pages is None else pages.unionByName(found)
        level = below.where("ns = 14").select(F.col("title").alias("parent")).join(seen, "parent", "left_anti")
        seen = seen.unionByName(level)
    return pages.groupBy("title").agg(F.min("level").alias("level"))


def search_categories(categories: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return categories.where(F.contains(F.lower("title"), F.lit(query.lower()))).orderBy("title").limit(limit)


def associations(pairs: DataFrame, seed: str, limit: int = 100) -> DataFrame:
    """(word) that a seed calls up, heaviest first; pairs: seed, word, score."""
    return pairs.where(F.col("seed") == seed).orderBy(F.desc("score"), "word").limit(limit).select("word")


def fetch(spark: SparkSession, recipe: Recipe, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source_idx, kind, role, title, seq) of all of a recipe's sources."""
    parts = []
    for i, s in enumerate(recipe.sources):
        if s.kind.endswith("-category"):
            got = category_members(edges, s.query, s.depth or 0).select("title")
        elif s.kind == "recipe":
            got = spark.createDataFrame([(t,) for t in getattr(recipe, s.query)], "title string")
        else:
            got = associations(pairs, s.query).select(F.col("word").alias("title"))
        parts.append(got.select(F.lit(i).alias("source_idx"), F.lit(s.kind).alias("kind"), F.lit(s.role).alias("role"), "title", F.monotonically_increasing_id().alias("seq")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class ResponseCache:
    """Responses by content address in a table: hits are a semi-join, misses an anti-join, new answers an append."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        return self.spark.read.schema("key string, body string, at long").parquet(self.path)

    def missing(self, urls: DataFrame) -> DataFrame:
        return urls.withColumn("key", cache_key(F.col("url"))).join(self.read(), "key", "left_anti")

    def found(self, urls: DataFrame) -> DataFrame:
        return urls.withColumn("key", cache_key(F.col("url"))).join(self.read().groupBy("key").agg(F.max_by("body", F.coalesce("at", F.lit(0))).alias("body")), "key")

    def append(self, rows: DataFrame) -> None:
        rows.select("key", "body", F.unix_micros(F.current_timestamp()).alias("at")).write.mode("append").parquet(self.path)

    def get(self, urls: DataFrame, opener: Callable[[str], str] | None, *, refresh: bool = False) -> DataFrame:
        """Bodies of all urls; without an opener (offline) a missing one is an error; refresh asks again for what is there."""
        todo = urls.withColumn("key", cache_key(F.col("url"))) if refresh else self.missing(urls)
        if opener is None:
            if not todo.isEmpty():
                raise LookupError("offline, and some responses are not in the cache")
        else:

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    yield pd.DataFrame({"key": b["key"], "body": [opener(u) for u in b["url"]]})

            self.append(todo.select("key", "url").mapInPandas(run, "key string, body string"))
        return self.found(urls)


# --- clean and merge


def _nfc(c: Column) -> Column:
    import unicodedata

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.when(c.rlike(r"[^\x00-\x7F]"), run.asNondeterministic()(c)).otherwise(c)


def clean_titles(items: DataFrame, title: str = "title") -> DataFrame:
    """items with text (null where dropped), reason and key. Spelling is normalised in Python only where it is not ASCII."""
    flat = F.trim(F.regexp_replace(_nfc(F.col(title)), r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))
    df = items.withColumn("__flat", F.coalesce(flat, F.lit("")))
    bare = F.regexp_replace("__flat", r"(\s*\([^()]*\))+\s*$", "")
    name = F.regexp_replace(F.substring_index(bare, ", ", 1), r"^[ ,;:]+|[ ,;:]+$", "")
    df = df.withColumn("__name", name).withColumn("__key", F.trim(fold_column("__name")))
    n, low = F.col("__name"), F.lower("__flat")
    words, letters = F.split(n, " "), F.regexp_count(n, F.lit(r"[\p{L}\p{N}]"))
    reason = (
        F.when(F.col("__flat") == "", "empty")
        .when(low.rlike("^(" + "|".join(x.lower() for x in NAMESPACES) + ")( talk)?:"), "namespace page")
        .when(low.rlike("^(" + "|".join(LIST_STARTS) + r")\b"), "list or outline page")
        .when(n.rlike(r"^[-*]|-$"), "affix or reconstruction")
        .when(F.exists(words, lambda w: w.rlike(r"(?i)^\d+(s|st|nd|rd|th)?$")), "number or year")
        .when(F.char_length("__key") <= 2, "too short")
        .when((F.upper(n) == n) & (F.lower(n) != n) & (letters <= 4), "short acronym")
        .when(letters < 3, "too few letters")
        .when(F.size(words) > MAX_WORDS, f"longer than {MAX_WORDS} words")
        .otherwise("")
    )
    df = df.withColumn("reason", reason)
    raw = F.coalesce(F.nullif(F.trim(fold_column(F.coalesce(F.col(title), F.lit("")))), F.lit("")), F.col(title))
    out = df.withColumn("text", F.when(F.col("reason") == "", n)).withColumn("key", F.when(F.col("reason") == "", F.col("__key")).otherwise(raw))
    return out.drop("__flat", "__name", "__key")


def merge_candidates(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped), one row a folded key: origins in first-seen order, the nicest spelling, and no key both kept and dropped."""
    # A key's rows are first reduced to one a source, so a title that stands everywhere is never gathered in one place.
    nice = cleaned.withColumn("nice", niceness(F.coalesce("text", F.lit(""))))
    place = [(-F.col("source_idx")).alias("a"), (-F.col("seq")).alias("b")]
    per = nice.groupBy("key", F.col("reason") == "", "source_idx", "kind", "role").agg(F.max(F.struct("nice", *place, "text")).alias("best"), F.min(F.struct("seq", "reason")).alias("first"))
    per = per.toDF("key", "is_kept", "source_idx", "kind", "role", "best", "first")
    seen = F.array_sort(F.collect_list(F.struct("source_idx", F.col("first.seq").alias("seq"), F.struct("source_idx", "kind", "role").alias("o"))))
    origins = F.transform(seen, lambda x: x["o"]).alias("origins")
    kept = per.where("is_kept").groupBy("key").agg(F.max("best")["text"].alias("text"), origins)
    why = F.min(F.struct("source_idx", "first"))["first"]["reason"].alias("reason")
    dropped = per.where("not is_kept").groupBy("key").agg(why, origins).join(kept.select("key"), "key", "left_anti")
    return kept, dropped


# --- classify


def zipf_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, zipf) of a corpus: log10 of occurrences in a thousand million words, to two places."""
    words = docs.select(F.explode(F.filter(F.split(fold_column(text), r"[^\p{L}\p{N}']+"), lambda w: w != "")).alias("word"))
    n = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("word", F.round(F.log10(F.col("n") * F.lit(1e9) / F.col("total")), 2).alias("zipf"))


def with_zipf(candidates: DataFrame, zipf: DataFrame, default: float = 1.0) -> DataFrame:
    """candidates with zipf (of the text, written or folded, whichever is commoner; a phrase counts as its rarest word) and rarest."""
    words = candidates.select("key", F.lower("text").alias("low")).withColumn("form", F.explode(F.array(F.struct(F.lit(0).alias("f"), F.col("low").alias("s")), F.struct(F.lit(1).alias("f"), F.col("key").alias("s"))))).select("key", "form.f", F.explode(F.split("form.s", " ")).alias("word"))
    scored = words.join(zipf, "word", "left").groupBy("key").agg(*[F.min(F.when(F.col("f") == f, F.coalesce("zipf", F.lit(default)))).alias(f"z{f}") for f in (0, 1)])
    z = F.round(F.greatest("z0", "z1"), 2)
    one = F.size(F.split("key", " ")) == 1
    return candidates.join(scored, "key").withColumn("zipf", z).withColumn("rarest", F.when(one, z).otherwise(F.col("z1"))).drop("z0", "z1")


def classify(candidates: DataFrame, recipe: Recipe) -> DataFrame:
    """candidates (key, text, origins, zipf, rarest) with decision, reason, review and is_listed, as one case expression."""
    from veilframe.functions.folding import fold_term

    t = recipe.thresholds
    excluded = sorted({fold_term(x) for x in recipe.exclude})
    role = lambda r: F.exists("origins", lambda o: (o["kind"] == "recipe") & (o["role"] == r))
    aims = F.exists("origins", lambda o: o["role"] == "terms")
    vouched = F.exists("origins", lambda o: o["kind"] != "datamuse-rel-trg")
    phrase, z, rare = F.size(F.split("key", " ")) > 1, F.col("zipf"), F.col("rarest")
    row = lambda d, reason="", review="": F.struct(F.lit(d).alias("decision"), F.lit(reason).alias("reason"), F.lit(review).alias("review"))
    verdict = (
        F.when(F.col("key").isin(excluded) if excluded else F.lit(False), row("drop", "excluded by the recipe"))
        .when(role("terms"), row("term", "listed in extra_terms"))
        .when(role("hints"), row("hint", "listed in extra_hints"))
        .when(aims & phrase & (z >= t.drop_from), row("drop", "every word is very common"))
        .when(aims & phrase & (rare >= t.common_word), row("hint", "", "every word is common"))
        .when(aims & phrase, row("term"))
        .when(~phrase & (z >= t.drop_from), row("drop", "common word"))
        .when(aims & (z < t.term_below), row("term"))
        .when(aims & (z < t.review_below), row("hint", "", "moderately common word"))
        .when(~aims & vouched & (rare < t.rare_vocabulary), row("term", "rare vocabulary"))
        .otherwise(row("hint"))
    )
    out = candidates.withColumn("__v", verdict).withColumn("is_listed", role("terms"))
    return out.select("*", "__v.decision", "__v.reason", F.filter(F.array("__v.review"), lambda x: x != "").alias("review")).drop("__v")


# --- corpus run


def walk_order(path: Column) -> Column:
    """A key whose order is that of a walk: a folder's files by name, then its subfolders by name."""
    parts = F.split(path, "/")
    return F.concat(F.array_join(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.concat(F.lit("\u0002"), p)), ""), F.lit("\u0001"), F.element_at(parts, -1))


def corpus_files(spark: SparkSession, path: str, *, exclude: list[str] = (), max_files: int = MAX_FILES) -> DataFrame:
    """(path, length, text) of the text files below a folder: by suffix, size and folder, evenly sampled in walk order, no binaries.

    Contents are read of the sampled files only; exclude: parts of paths whose files are left out, such as own checkouts.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ok = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*TEXT_SUFFIXES) & (F.col("length") <= MAX_FILE_BYTES) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED_FOLDERS)))
    for x in exclude:
        ok &= ~F.contains("path", F.lit(x))
    listed = even_sample(files.where(ok).select("path", walk_order(F.col("path")).alias("walk")), "walk", max_files)
    paths = [r["path"] for r in listed.select("path").collect()]  # at most max_files
    if not paths:
        return spark.createDataFrame([], "path string, length long, text string")
    text = F.decode(F.expr("make_valid_utf8(content)").cast("binary"), "UTF-8")
    read = spark.read.format("binaryFile").load([_plain_path(p) for p in paths]).where(~F.contains(F.substring("content", 1, SNIFF), F.unhex(F.lit("00"))))
    return read.select("path", "length", text.alias("text"))


def _plain_path(path: str) -> str:
    """A path that is no pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def even_sample(rows: DataFrame, order: str, most: int) -> DataFrame:
    """Every n-th row in order, n the least that leaves at most `most`.

    The rows are cut into ranges at keys drawn by hash (a few hundred at most, found in one pass), which are literals of the plan: so the
    counts of the ranges and the ranks within them belong to the same ranges however often they are computed, and no task sorts
    all rows. Rows of equal keys stand in the order of their hashes.
    """
    drawn = [r[0] for r in rows.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order), order).limit(SPLITS).distinct().collect()]
    at = F.lit(0)
    if drawn:
        # First among every 16th bound, then among the 16 that follow it.
        bounds, under = sorted(drawn), lambda keys: F.size(F.filter(keys, lambda b: b <= F.col(order)))
        coarse = under(F.array(*map(F.lit, bounds[15::16]))) * 16 if bounds[15::16] else F.lit(0)
        at = coarse + under(F.slice(F.array(*map(F.lit, bounds)), coarse + 1, F.lit(16)))
    ranged = rows.withColumn("__part", F.when(F.col(order).isNull(), 0).otherwise(at))
    counts = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = max(1, -(-sum(counts.values()) // most))
    if n == 1:
        return rows
    before = [0]
    for p in range(len(drawn)):
        before.append(before[-1] + counts.get(p, 0))
    base = F.element_at(F.array(*[F.lit(x).cast("long") for x in before]), F.col("__part") + 1)
    tie = F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith("map")])
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(order, tie))
    return ranged.withColumn("__rank", base + rank - 1).where(F.col("__rank") % n == 0).drop("__part", "__rank")


def dry_run(candidates: DataFrame, docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """candidates with hits and files: how often, and in how many documents, each would-be term stands in a corpus."""
    from veilframe.functions.folding import fold_term

    keys = [r["key"] for r in candidates.where("decision = 'term' or size(review) > 0").select("key").collect()]
    d = Dictionary([Term(k, k, "", False, True) for k in keys if len(fold_term(k)) > 1])
    counts = term_hits(docs, d, key=key, text=text).select(F.col("folded").alias("key"), "hits", F.col("docs").alias("files"))
    return candidates.join(counts, "key", "left").fillna(0, ["hits", "files"])


def run_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length(text)).alias("bytes"))


def flag_corpus_hits(candidates: DataFrame, t: Thresholds) -> DataFrame:
    """Terms found in too many files become hints to review; listed ones stay."""
    hot = (F.col("decision") == "term") & ~F.col("is_listed") & (F.col("files") > t.corpus_files)
    note = F.concat(F.lit("in "), F.col("files").cast("string"), F.lit(" corpus files"))
    return candidates.withColumn("review", F.when(hot, F.array_append("review", note)).otherwise(F.col("review"))).withColumn("decision", F.when(hot, "hint").otherwise(F.col("decision")))


# --- judge


def judge(candidates: DataFrame, answers: DataFrame, t: Thresholds) -> DataFrame:
    """candidates with judge and the decision it settles; answers: text, p."""
    joined = candidates.drop("judge").join(answers.select("text", F.col("p").alias("judge")), "text", "left")
    asked = (F.size("review") > 0) & F.col("judge").isNotNull()
    return joined.withColumn("decision", F.when(asked & (F.col("judge") >= t.judge_term), "term").when(asked & (F.col("judge") <= t.judge_hint), "hint").otherwise(F.col("decision")))


class JudgeError(RuntimeError):
    """Some questions have no answer; those that were answered are in the cache."""


#: What an answer is kept as: request groups the questions of one reply, tokens and cost stand in a request's first row.
ANSWER = "key string, text string, p double, request string, tokens long, cost double"


def ask(texts: DataFrame, cache: str, post: Callable[[list[str]], tuple[list, dict]], *, model: str, wording: str, batch: int = BATCH) -> DataFrame:
    """(key, text, p, request, tokens, cost) of every distinct text: from the cache table at that path, or from `post`, asked now.

    post(texts) -> (probabilities, usage with tokens and cost). Questions go in batches of at most `batch`; whatever is answered is
    appended to the cache before anything is returned or raised, so no answer is paid for twice and a run that failed goes on where it
    stopped. A reply that lacks answers, and a request that fails, end in a JudgeError after that. request is null for cached answers.
    """
    spark = texts.sparkSession
    todo = texts.select("text").distinct().withColumn("key", cache_key(F.lit(model), F.lit(wording), F.col("text")))
    try:
        had = spark.read.schema(ANSWER).parquet(cache)
        had.isEmpty()
    except AnalysisException:  # the first run
        had = spark.createDataFrame([], ANSWER)
    open_ = todo.join(had.where("p is not null").select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                try:
                    p, usage = post(part["text"].tolist())
                except Exception:
                    p, usage = [], {}
                p = [*p, *[None] * len(part)][: len(part)]
                ok = [float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and 0 <= x <= 1 else None for x in p]
                first = [True] + [False] * (len(part) - 1)
                yield pd.DataFrame({"key": part["key"], "text": part["text"], "p": pd.Series(ok, index=part.index, dtype=float), "request": part["key"].iloc[0], "tokens": [int(usage.get("tokens", 0)) if f else 0 for f in first], "cost": [float(usage.get("cost", 0)) if f else 0.0 for f in first]})

    mark = uuid.uuid4().hex
    # One write asks and keeps: unanswered questions are kept out of the cache's answers by their null.
    open_.mapInPandas(run, ANSWER).withColumn("request", F.concat(F.lit(mark + ":"), "request")).write.mode("append").parquet(cache)
    answers = spark.read.schema(ANSWER).parquet(cache)
    new = F.col("request").startswith(mark)
    missing = answers.where(new & F.col("p").isNull()).count()
    if missing:
        raise JudgeError(f"{missing} questions have no answer")
    found = answers.where(F.col("p").isNotNull()).withColumn("__new", new)
    found = found.groupBy("key").agg(F.max("text").alias("text"), F.max_by("p", "__new").alias("p"), F.max(F.when(F.col("__new"), F.col("request"))).alias("request"), F.sum(F.when(F.col("__new"), F.col("tokens")).otherwise(0)).alias("tokens"), F.sum(F.when(F.col("__new"), F.col("cost")).otherwise(0.0)).alias("cost"))
    return found.join(todo.select("key"), "key", "left_semi")


def judge_costs(answers: DataFrame) -> DataFrame:
    return answers.agg(F.countDistinct("request").alias("requests"), F.count("request").alias("asked"), F.count_if(F.col("request").isNull()).alias("cached"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def is_open(t: Thresholds) -> Column:
    """Reviewed, and not settled by the judge."""
    return (F.size("review") > 0) & (F.col("judge").isNull() | ((F.col("judge") > t.judge_hint) & (F.col("judge") < t.judge_term)))


def unsettled(candidates: DataFrame, t: Thresholds) -> DataFrame:
    return candidates.where(is_open(t))


# --- counts and sinks


def source_counts(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """(source_idx, found, kept): raw items, and candidates not dropped, which count for every origin."""
    found = items.groupBy("source_idx").agg(F.count(F.lit(1)).alias("found"))
    kept = candidates.where("decision <> 'drop'").select("key", F.explode("origins").alias("o")).groupBy(F.col("o.source_idx").alias("source_idx")).agg(F.countDistinct("key").alias("kept"))
    return found.join(kept, "source_idx", "left").fillna(0, ["kept"])


def bucket_counts(candidates: DataFrame, t: Thresholds) -> DataFrame:
    return candidates.agg(*[F.count_if(F.col("decision") == d).alias(f"{d}s") for d in ("term", "hint", "drop")], F.count_if(F.size("review") > 0).alias("reviewed"), F.count_if(is_open(t)).alias("unsettled"), F.count_if(F.col("files") > 0).alias("seen"))


def build(spark: SparkSession, recipe: Recipe, items: DataFrame, zipf: DataFrame, docs: DataFrame | None = None, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, dropped titles) of a whole run, lazily; items as fetch() gives them."""
    kept, dropped = merge_candidates(clean_titles(items))
    c = classify(with_zipf(kept, zipf), recipe)
    c = flag_corpus_hits(dry_run(c, docs), recipe.thresholds) if docs is not None else c.withColumn("hits", F.lit(0).cast("long")).withColumn("files", F.lit(0).cast("long"))
    c = judge(c, answers, recipe.thresholds) if answers is not None else c.withColumn("judge", F.lit(None).cast("double"))
    return c, dropped


def pack_json(recipe: Recipe, candidates: DataFrame, counts: DataFrame, version: str) -> str:
    """The pack file: fixed key order, two spaces, a final line feed. A pack is read by people and fits the driver."""
    text = lambda d: [r["text"] for r in candidates.where(F.col("decision") == d).orderBy("key", "text").select("text").collect()]
    n = {r["source_idx"]: r for r in counts.collect()}
    sources = [{"kind": s.kind, "query": s.query, **({"depth": s.depth} if s.depth is not None else {}), "found": n[i]["found"] if i in n else 0, "kept": n[i]["kept"] if i in n else 0} for i, s in enumerate(recipe.sources)]
    return json.dumps({"name": recipe.name, "version": version, "description": recipe.description, "terms": text("term"), "hints": text("hint"), "sources": sources}, ensure_ascii=False, indent=2) + "\n"


def report_rows(candidates: DataFrame, sources: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(key, text, sources, more, zipf, rarest, decision, reason): a report's table, the first two source labels of each row."""
    names = sources.select("source_idx", label(F.col("kind"), F.col("query")).alias("label"))
    each = candidates.select("key", F.posexplode("origins").alias("at", "o")).select("key", "at", F.col("o.source_idx").alias("source_idx")).join(names, "source_idx")
    labels = each.groupBy("key").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"])).alias("labels"))
    return candidates.join(labels, "key", "left").select("key", cell(F.col("text")).alias("text"), F.array_join(F.slice("labels", 1, 2), "; ").alias("sources"), F.greatest(F.size("labels") - 2, F.lit(0)).alias("more"), "zipf", "rarest", "decision", "reason", "files", "hits", "judge", cell(F.array_join("review", "; ")).alias("review"), is_open(t).alias("is_open"))


def first_drops(dropped: DataFrame, n: int = SHOWN_DROPS) -> DataFrame:
    return dropped.orderBy("reason", "key").limit(n)


def report(recipe: Recipe, candidates: DataFrame, dropped: DataFrame, sources: DataFrame, counts: DataFrame, *, version: str = "", run: dict | None = None, costs: dict | None = None) -> str:
    """A markdown report: buckets, thresholds, the corpus run and the judge in numbers, sources, terms, reviewed candidates, hints, first drops.

    run: files, bytes, found of the corpus run; costs: as judge_costs(). It is read by people and fits the driver.
    """
    t, b = recipe.thresholds, bucket_counts(candidates, recipe.thresholds).first()
    heading = f"Version {version}. {recipe.description}" if version else recipe.description
    out = [f"# {recipe.name}", "", heading, "", f"{b['terms']} terms, {b['hints']} hints, {b['drops']} drops, {b['reviewed']} reviewed, {b['unsettled']} unsettled, {b['seen']} seen in the corpus.", ""]
    out += ["| limit | value |", "| --- | --- |", *[f"| {k.replace('_', ' ')} | {v} |" for k, v in vars(t).items()], ""]
    if run:
        out += [f"Corpus: {run['files']} files read of {run['found']} found, {run['bytes'] / 1e6:.1f} MB.", ""]
    if costs:
        out += [f"Judge: {costs['requests']} requests, {costs['asked']} asked, {costs['cached']} cached, {costs['tokens']} tokens, {costs['cost']:.6f} paid.", ""]
    out += ["| source | role | depth | found | kept |", "| --- | --- | --- | --- | --- |"]
    named = sources.select("source_idx", "role", "depth", label(F.col("kind"), F.col("query")).alias("label")).join(counts, "source_idx", "left").orderBy("source_idx")
    out += [f"| {r['label']} | {r['role']} | {'' if r['depth'] is None else r['depth']} | {r['found'] or 0} | {r['kept'] or 0} |" for r in named.collect()]
    rows = report_rows(candidates, sources, t).orderBy("key", "text").collect()
    shown = lambda r: f"{r['sources']}{' +' + str(r['more']) if r['more'] else ''}"
    out += ["", f"## terms ({b['terms']})", "", "| text | sources | zipf | rarest word | files | hits | why |", "| --- | --- | --- | --- | --- | --- | --- |"]
    out += [f"| {r['text']} | {shown(r)} | {r['zipf']:.2f} | {r['rarest']:.2f} | {r['files']} | {r['hits']} | {r['reason']} |" for r in rows if r["decision"] == "term"]
    out += ["", f"## reviewed ({b['reviewed']})", "", "| text | why | zipf | files | judge | decision |", "| --- | --- | --- | --- | --- | --- |"]
    out += [f"| {r['text']} | {r['review']} | {r['zipf']:.2f} | {r['files']} | {'-' if r['judge'] is None else format(r['judge'], '.2f')} | {r['decision']}{', open' if r['is_open'] else ''} |" for r in rows if r["review"]]
    out += ["", f"## hints ({b['hints']})", "", ", ".join(r["text"] for r in rows if r["decision"] == "hint") or "none"]
    total = dropped.count()
    out += ["", f"## dropped ({total})", ""] + [f"- {r['key']}: {r['reason']}" for r in first_drops(dropped).collect()]
    if total > SHOWN_DROPS:
        out.append(f"- and {total - SHOWN_DROPS} more")
    return "\n".join(out) + "\n"
