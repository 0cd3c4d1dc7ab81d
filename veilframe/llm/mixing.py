"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words, in DataFrame operations only.

Defined results: a null text has size 0; documents of size 0 take nothing; a null source is a source of its own and stands last;
an empty table gives an empty result; repeated rows each count, and ties in the seeded order of a shard (equal id, size and text) are of
rows that cannot be told apart; null ids are dealt by their texts; a very long document is one document of its size, so its shard is at least as
large; further columns are ignored. Targets are found over one row a source, in one task: made for up to some millions of sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Words of a block, words of a shard, the highest repetition, and the weights in turn.
BLOCK, SHARD_WORDS, CAP, WEIGHTS = 16, 2_000_000, 3, (5, 2, 1)


def text_size(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, place, weight, target): water-filling in closed form over one row a source.

    Sources are sorted by cap * size / weight; the share of one unit of weight that is left when the first k are held at
    their caps falls at first below the next ratio where no further source is held.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.withColumn("place", place).withColumn("weight", weight).withColumn("most", (F.col("source_size") * cap).cast("double"))
    line = Window.orderBy((F.col("most") / F.col("weight")), "place")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    held, spent = F.coalesce(F.sum("weight").over(before), F.lit(0.0)), F.coalesce(F.sum("most").over(before), F.lit(0.0))
    unit = (F.sum("source_size").over(everything) - spent) / (F.sum("weight").over(everything) - held)
    per = per.withColumn("unit", unit).withColumn("free", F.col("unit") <= F.col("most") / F.col("weight"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("weight"), F.col("place"), F.col("unit").alias("unit")))).over(everything)["unit"]
    return per.withColumn("level", level).select("source", "source_size", "place", "weight", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def apportion(rows: DataFrame, key: list[str], value: str, seats: str, order: list[str], out: str) -> DataFrame:
    """Sainte-Lague: the `seats` blocks of each key go to the rows with the highest quotients value / (2 a + 1).

    Every quotient above a divisor that is surely too large is granted at once; only the quotients between it and one
    that is surely too small, at most two a row, are made and ranked. So neither seats nor rows are ever enumerated one by one.
    """
    group = Window.partitionBy(*key)
    n, total = F.count(F.lit(1)).over(group), F.sum(value).over(group)
    rows = rows.withColumn("__n", n).withColumn("__total", total)
    sure = lambda seat_count: F.when((seat_count > 0) & (F.col("__total") > 0), F.floor(F.col(value) * seat_count / F.col("__total") + 0.5)).otherwise(0).cast("long")
    # Rounded shares overshoot their exact sum by at most n / 2, and undershoot by as much.
    rows = rows.withColumn("__low", F.greatest(F.lit(0), sure(F.col(seats) - F.col("__n") / 2 - 1))).withColumn("__high", sure(F.col(seats) + F.col("__n") / 2 + 1))
    rows = rows.withColumn("__left", F.col(seats) - F.sum("__low").over(group))
    open_seats = rows.where("__high > __low").select(*key, *order, "__left", F.col(value).alias("__v"), F.explode(F.sequence("__low", F.col("__high") - 1)).alias("__a"))
    quotient = F.col("__v") / (2 * F.col("__a") + 1)
    granted = open_seats.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(quotient.desc(), *order, "__a"))).where("__rank <= __left")
    more = granted.groupBy(*key, *order).agg(F.count(F.lit(1)).alias("__more"))
    joined = rows.alias("r").join(more.alias("m"), [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in [*key, *order]], "left")
    return joined.select("r.*", (F.col("__low") + F.coalesce("__more", F.lit(0))).alias(out)).drop("__n", "__total", "__low", "__high", "__left")


def mix_sources(docs: DataFrame, *, block: int = BLOCK, shard_words: int = SHARD_WORDS, cap: int = CAP, weights=WEIGHTS, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every document.

    Blocks go to sources, then to each source's shards, both by highest quotients, which gives every shard an
    integer quota. Within a shard the documents lie in a seeded order as one line of words; the quota is whole passes over the
    line, and the blocks of its beginning once more. A shard never exceeds `cap` passes, so no document does.
    """
    sized = materialize(docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))).alias("draw")), "sizes")
    targets = materialize(source_targets(sized, weights=weights, cap=cap), "targets")
    seats = targets.withColumn("__one", F.lit(1)).withColumn("__seats", F.floor(F.sum("source_size").over(Window.partitionBy()) / block).cast("long"))
    quota = apportion(seats, ["__one"], "target", "__seats", ["place"], "blocks").select("source", "source_size", "place", "target", "blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("n_shards"))
    # One row a source: within the automatic broadcast limit it is sent to the tasks, beyond it the join is shuffled and skew is split.
    doc = sized.alias("d").join(quota.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source"))).select("d.*", "source_size", "target", "place", "blocks", "n_shards")
    doc = doc.withColumn("shard", F.pmod(F.col("draw"), F.col("n_shards")))
    shards = doc.where("size > 0").groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.max("blocks").alias("blocks"))
    shards = apportion(shards, ["place"], "shard_size", "blocks", ["shard"], "shard_blocks")
    words = F.least(F.col("shard_blocks") * block, F.col("shard_size") * cap)
    shards = shards.select("place", "shard", "shard_size", words.alias("words"))
    line = Window.partitionBy("place", "shard").orderBy(F.xxhash64("draw"), "draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    lined = doc.withColumn("__end", F.sum("size").over(line))
    passes = F.floor(F.col("words") / F.col("shard_size"))
    over = F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - passes * F.col("shard_size") - (F.col("__end") - F.col("size"))))
    taken = F.when(F.col("shard_size").isNull(), 0).otherwise(passes * F.col("size") + over).cast("long")
    return lined.join(shards, ["place", "shard"], "left").select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """docs as the mix takes them: each row as many times as its words were taken, to the nearest whole; rows taken less than half
    a time and rows without words go."""
    times = mix.where("size > 0").groupBy("doc_id").agg(F.max(F.round(F.col("taken") / F.col("size"))).cast("int").alias("__times")).where("__times > 0").withColumnRenamed("doc_id", "__id")
    repeated = docs.where(text_size(F.col("text")) > 0).join(times, F.col("doc_id").eqNullSafe(F.col("__id")))
    return repeated.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
