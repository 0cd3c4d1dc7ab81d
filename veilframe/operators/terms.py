"""The term dimension: one row for each listed term, the winner of each folded key, and its placeholder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.functions.folding import fold_term
from veilframe.functions.names import assign_placeholders
from veilframe.operators.dictionary import Dictionary, Term
from veilframe.sources.config import Config

MIN_TERM = 2
REFS = "folded string, canonical string, list_idx int, list_name string, drop boolean, word_only boolean, restore boolean, seq long"


def term_refs(spark: SparkSession, config: Config, packs: dict[str, list[str]] | None = None) -> DataFrame:
    """Every listed term in order: a list's own terms, then its pack's (always whole words); the list's excluded terms are out."""
    rows, seq = [], 0
    for i, lst in enumerate(config.lists):
        out = {fold_term(x) for x in lst.exclude}
        for terms, word in ((lst.terms, lst.match == "word"), ((packs or {}).get(lst.pack, []), True)):
            for t in terms:
                key = fold_term(t)
                if key not in out:
                    rows.append((key, t, i, lst.name, lst.mode == "drop-line", word, lst.restore, seq))
                    seq += 1
    return spark.createDataFrame(rows, REFS)


def exclude_terms(refs: DataFrame, excluded: DataFrame) -> DataFrame:
    """refs without the (list_name, folded) pairs of excluded."""
    return refs.join(excluded.select("list_name", "folded").distinct(), ["list_name", "folded"], "left_anti")


def resolve_terms(refs: DataFrame) -> DataFrame:
    """One row a folded key: the first reference whose list drops lines, else the first; restorable only if every reference is.

    first_canonical is what a restore writes: the first reference's spelling, whichever wins.
    """
    usable = refs.where(F.char_length("folded") >= MIN_TERM)
    group = Window.partitionBy("folded")
    rank = F.row_number().over(group.orderBy(F.col("drop").desc(), "seq"))
    ranked = usable.withColumn("rank", rank).withColumn("restorable", F.min("restore").over(group)).withColumn("first_canonical", F.min_by("canonical", "seq").over(group))
    return ranked.where("rank = 1").select("folded", "canonical", "list_idx", "list_name", "drop", "word_only", "restorable", "first_canonical", "seq")


def term_counts(refs: DataFrame) -> DataFrame:
    """(terms, skipped): distinct usable keys, and references too short to use."""
    return refs.agg(F.countDistinct(F.when(F.char_length("folded") >= MIN_TERM, F.col("folded"))).alias("terms"), F.count_if(F.char_length("folded") < MIN_TERM).alias("skipped"))


def compile_dictionary(dimension: DataFrame, seed: str, style: str = "codename") -> Dictionary:
    """Placeholders for all keys, then the dictionary. Lists are written by people, so the dimension is of a size to sit on the driver."""
    rows = dimension.orderBy("seq").collect()
    names = assign_placeholders([r["folded"] for r in rows], seed, style, [r["folded"] for r in rows if not r["word_only"]])
    return Dictionary([Term(r["folded"], r["canonical"], r["list_name"], r["drop"], r["word_only"], names[r["folded"]], r["first_canonical"] if r["restorable"] else None) for r in rows])

