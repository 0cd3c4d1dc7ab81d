"""Finding, replacing and dropping listed terms in text columns.

The dictionary is compiled on the driver (hundreds to thousands of terms) and broadcast; its size is the lists', never the
data's. Functions here are marked as not deterministic, which they are not, so that each text is read once however many of the
result's fields a plan uses. Rewriting is a function of one row, so no text is shuffled. A row that cannot be rewritten becomes null with its error,
never the text itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from veilframe.functions.folding import fold_column
from veilframe.operators.dictionary import Dictionary, Tally

SPANS = "array<struct<start:int,end:int,folded:string,suffix:string>>"
#: Terms that may be broadcast as rows of a join.
BROADCAST_TERMS = 200_000
MATCHES = "array<struct<at:int,words:int,folded:string>>"
HITS = "array<struct<folded:string,replaced:int,dropped:int>>"
REWRITTEN = f"struct<value:string,changed:boolean,vanished:boolean,replaced:int,dropped:int,hits:{HITS},error:string>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def find_terms(spark: SparkSession, d: Dictionary, text: Column | str) -> Column:
    sent = spark.sparkContext.broadcast(d)

    @F.pandas_udf(SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for s in batches:
            yield pd.Series([None if t is None else [dict(zip(("start", "end", "folded", "suffix"), m)) for m in own.find(t)] for t in s])

    return run.asNondeterministic()(_col(text))


def count_terms(spark: SparkSession, d: Dictionary, text: Column | str) -> Column:
    """array<struct<folded,n>>: hits of each term, without positions."""
    sent = spark.sparkContext.broadcast(d)

    @F.pandas_udf("array<struct<folded:string,n:long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for s in batches:
            yield pd.Series([[] if t is None else [{"folded": k, "n": n} for k, n in own.count(t).items()] for t in s])

    return run.asNondeterministic()(_col(text))


def _rewriter(spark: SparkSession, d: Dictionary, one: Callable[[Dictionary, str, Tally], tuple]):
    sent = spark.sparkContext.broadcast(d)

    @F.pandas_udf(REWRITTEN)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for s in batches:
            rows = []
            for t in s:
                tally = Tally()
                try:
                    value, changed, gone = (None, False, False) if t is None else one(own, t, tally)
                    hits = [{"folded": k, "replaced": r, "dropped": n} for k, (r, n) in tally.hits.items()]
                    rows.append((value, changed, gone, tally.replaced, tally.dropped, hits, None))
                except Exception as e:  # fail closed: the text never passes
                    rows.append((None, False, False, 0, 0, [], type(e).__name__))
            yield pd.DataFrame(rows, columns=["value", "changed", "vanished", "replaced", "dropped", "hits", "error"])

    # Marked so that a filter on one field does not make the optimiser rewrite every text once more for it.
    return run.asNondeterministic()


def redact(spark: SparkSession, d: Dictionary, text: Column | str, *, allow_drop: bool = True) -> Column:
    """A plain text's rewriting."""
    return _rewriter(spark, d, lambda own, t, tally: own.rewrite(t, tally, allow_drop))(_col(text))


def redact_json(spark: SparkSession, d: Dictionary, payload: Column | str) -> Column:
    """A JSON payload's rewriting: strings anywhere in it, keys and order kept; text that is no JSON is rewritten as text."""

    def one(own: Dictionary, t: str, tally: Tally) -> tuple:
        try:
            inner = json.loads(t)
        except ValueError:
            return own.rewrite(t, tally)
        value, changed, gone = own.rewrite_value(inner, tally)
        return ("" if gone else json.dumps(value, ensure_ascii=False, separators=(",", ":")) if changed else t), changed, gone

    return _rewriter(spark, d, one)(_col(payload))


def has_term(d: Dictionary, text: Column | str) -> Column:
    """Whether a text holds a term, as one regular expression over the JVM's fold: no Python."""
    return fold_column(_col(text)).rlike(term_pattern(d))


def term_pattern(d: Dictionary) -> str:
    quote = lambda ks: "|".join("\\Q" + k + "\\E" for k in sorted(ks, key=lambda k: (-len(k), k)))
    whole, inside = [k for k, t in d.terms.items() if t.word_only], [k for k, t in d.terms.items() if not t.word_only]
    parts = []
    if whole:
        parts.append(r"(?:(?<![\p{L}\p{N}])|(?<=\\[ntr]))(?:" + quote(whole) + r")(?:es|s)?(?![\p{L}\p{N}])")
    if inside:
        parts.append("(?:" + quote(inside) + ")")
    return "|".join(parts) or "(?!)"


def lines_of(text: Column | str) -> Column:
    """Lines with their ends; a real line feed and the two characters backslash n both end one."""
    return F.filter(F.split(_col(text), r"(?<=\n|\\n)"), lambda x: x != "")


def drop_lines(d: Dictionary, text: Column | str) -> Column:
    """The text without lines that hold one of d's terms, in the JVM; for dictionaries of dropping lists only.

    A text is tested whole at first, so that only those with a term are folded line by line.
    """
    return F.when(has_term(d, text), F.array_join(F.filter(lines_of(text), lambda x: ~has_term(d, x)), "")).otherwise(_col(text))


def term_hits(docs: DataFrame, d: Dictionary, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(folded, hits, docs): corpus counts of each term; only counts leave the scan."""
    spark = docs.sparkSession
    per = docs.select(key, F.explode(count_terms(spark, d, text)).alias("h")).select(key, "h.folded", "h.n")
    return per.groupBy("folded").agg(F.sum("n").alias("hits"), F.countDistinct(key).alias("docs"))


def token_hits(docs: DataFrame, terms: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same for whole-word, single-word terms by an equi-join of folded tokens: no Python, any number of terms.

    Few terms are broadcast, so that only their hits are shuffled; with many, a document's tokens are counted before the join, so a common word
    is one row a document.
    """
    words = F.filter(F.split(fold_column(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    tokens = docs.select(key, F.explode(words).alias("token"))
    forms = terms.select("folded", F.explode(F.array(F.col("folded"), F.concat("folded", F.lit("s")), F.concat("folded", F.lit("es")))).alias("token"))
    exact = forms.withColumn("extra", F.char_length("token") - F.char_length("folded"))
    side, small = checked_side(exact.groupBy("token").agg(F.min_by("folded", "extra").alias("folded")))
    if small:
        per = tokens.join(side, "token").groupBy(key, "folded").agg(F.count(F.lit(1)).alias("n"))
    else:
        per = tokens.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n")).join(side, "token")
    return per.groupBy("folded").agg(F.sum("n").alias("hits"), F.countDistinct(key).alias("docs"))


def checked_side(side: DataFrame, rows: int = BROADCAST_TERMS) -> tuple[DataFrame, bool]:
    """The small side of a join, marked for broadcast only if it has at most so many rows."""
    small = side.limit(rows + 1).count() <= rows
    return (F.broadcast(side) if small else side), small


def ngram_find(docs: DataFrame, terms: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """(key, matches array<struct<at,words,folded>>): leftmost longest matches of word-only terms by an n-gram join.

    For dictionaries too large to compile: n-grams of up to `words` words meet the terms in an equi-join, and each
    document's candidates are resolved in order of place and length. A place is a row of its own `words` words and never holds the text,
    so memory and time are in proportion to a text's length.
    """
    tokens = docs.select(key, F.filter(F.split(fold_column(text), r"[^\p{L}\p{N}']+"), lambda w: w != "").alias("t"))
    following = F.arrays_zip(*[F.slice("t", n + 1, F.size("t")).alias(f"w{n}") for n in range(words)])
    places = tokens.select(key, F.posexplode(following).alias("at", "w"))
    # Beyond a text's end the words are null, so the gram is null and joins nothing.
    spelt = [F.concat(*[x for i in range(n) for x in (F.lit(" "), F.col(f"w.w{i}"))][1:]) for n in range(1, words + 1)]
    grams = places.select(key, "at", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), gram.alias("gram")) for n, gram in enumerate(spelt, 1)])).alias("g"))
    found = grams.select(key, "at", F.col("g.n").alias("n"), F.col("g.gram").alias("folded")).join(checked_side(terms.select("folded").distinct())[0], "folded")
    ordered = F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("neg"), "folded")))
    candidates = found.groupBy(key).agg(ordered.alias("matches"))
    schema = StructType([candidates.schema[key], StructField("matches", DataType.fromDDL(MATCHES))])
    return candidates.mapInArrow(_without_overlap, schema)


def _without_overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row's candidates (at, -words, folded), in order of place and length, those that begin where the last one taken has ended."""
    for b in batches:
        found = b.column(1)
        flat, sizes = found.flatten(), found.value_lengths().to_pylist()
        at, words = flat.field(0).to_numpy(), -flat.field(1).to_numpy()
        begins, ends = at.tolist(), (at + words).tolist()
        kept, offsets, first = [], [0], 0
        for size in sizes:
            free = 0
            for j in range(first, first + size):
                if begins[j] >= free:
                    free = ends[j]
                    kept.append(j)
            first += size
            offsets.append(len(kept))
        folded = flat.field(2).take(pa.array(kept, pa.int64()))
        taken = pa.StructArray.from_arrays([pa.array(at[kept], pa.int32()), pa.array(words[kept], pa.int32()), folded], ["at", "words", "folded"])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), taken)], [b.schema.names[0], "matches"])


def register_functions(spark: SparkSession, d: Dictionary) -> None:
    """SQL names: fold(text), has_term(text), redact(text) and the table function find_terms(text). A text that fails is withheld: null."""
    from pyspark.sql.functions import udtf

    from veilframe.functions.folding import fold_text

    sent = spark.sparkContext.broadcast(d)

    def closed(one: Callable[[str], object], failed: object) -> Callable[[object], object]:
        def run(t: object) -> object:
            try:
                return None if t is None else one(t)
            except Exception:  # fail closed: the text never passes
                return failed

        return run

    spark.udf.register("fold", F.pandas_udf(lambda s: s.map(closed(fold_text, None)), "string"))
    spark.udf.register("has_term", F.pandas_udf(lambda s: s.map(lambda t: t is not None and closed(sent.value.test, True)(t)), "boolean"))
    spark.udf.register("redact", F.pandas_udf(lambda s: s.map(closed(lambda t: sent.value.rewrite(t, Tally())[0], None)), "string"))

    class FindTerms:
        def eval(self, text: str):
            for m in sent.value.find(text or ""):
                yield m

    spark.udtf.register("find_terms", udtf(FindTerms, returnType="start: int, end: int, folded: string, suffix: string"))
