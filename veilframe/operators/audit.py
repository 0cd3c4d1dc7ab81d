"""The log of what was hidden: entries, summaries by term, list, source and kind, and the feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.scalars import plural

#: Sources remembered, feed rows, terms shown of a source, terms from which the tree is folded up.
MAX_SOURCES, MAX_FEED, MAX_TERMS, FOLDED_FROM = 200, 100, 20, 30


def weight() -> Column:
    return F.col("replaced") + F.col("dropped")


def hit_rows(passes: DataFrame) -> DataFrame:
    """One row a pass and term from passes with hits: array<struct<folded,replaced,dropped>>."""
    keep = [c for c in passes.columns if c != "hits"]
    return passes.select(*keep, F.explode("hits").alias("h")).select(*[c for c in keep if c not in ("replaced", "dropped")], "h.folded", "h.replaced", "h.dropped")


def named_hits(hits: DataFrame, dimension: DataFrame) -> DataFrame:
    """Hits with their term's spelling, list and placeholder; the dimension is small and its plan's size estimate decides the join."""
    return hits.join(dimension, "folded")


def after_clear(rows: DataFrame, clears: DataFrame) -> DataFrame:
    """rows without what passed up to the last clear; what stands stays, as it is still hidden in every request.

    rows: mode, seq and more; clears: seq, one row a command, of which only the last travels.
    """
    last = clears.agg(F.max("seq").alias("cleared"))
    return rows.crossJoin(F.broadcast(last)).where((F.col("mode") == "standing") | F.col("cleared").isNull() | (F.col("seq") > F.col("cleared"))).drop("cleared")


def log_entries(hits: DataFrame) -> DataFrame:
    """(agent, slot, mode, folded, label, kind, replaced, dropped, seq, at): the log after all passes.

    hits: agent, slot, mode (add, replace, standing), label, kind, folded (null for a pass that hid nothing), replaced, dropped, seq, at.
    A slot's `add` passes are summed; of the others only the last pass counts, and it counts for nothing if it hid nothing. The last
    passes are found by a partial maximum and joined back, so a slot that passes all the time is not sorted in one task.
    """
    key = ["agent", "slot", "mode"]
    last = hits.where("mode <> 'add'").groupBy(*key).agg(F.max("seq").alias("last")).toDF("l_agent", "l_slot", "l_mode", "last")
    same = F.col("agent").eqNullSafe(F.col("l_agent")) & (F.col("slot") == F.col("l_slot")) & (F.col("mode") == F.col("l_mode")) & (F.col("seq") == F.col("last"))
    rows = hits.where("mode = 'add'").unionByName(hits.where("mode <> 'add'").join(last, same, "left_semi")).where("folded is not null")
    return rows.groupBy(*key, "folded").agg(F.max_by("label", "seq").alias("label"), F.max_by("kind", "seq").alias("kind"), F.sum("replaced").alias("replaced"), F.sum("dropped").alias("dropped"), F.max("seq").alias("seq"), F.max("at").alias("at"))


def new_passes(passes: DataFrame) -> DataFrame:
    """The passes that hid something new: all `add` passes, and of a slot that is replaced those before which it was empty.

    passes: agent, slot, mode, replaced, dropped, seq, one row a pass, also those that hid nothing.
    """
    before = F.lag(weight() > 0).over(Window.partitionBy("agent", "slot", "mode").orderBy("seq"))
    return passes.withColumn("__had", F.coalesce(before, F.lit(False))).where(weight() > 0).where((F.col("mode") == "add") | ~F.col("__had")).drop("__had")


def forgotten(entries: DataFrame, n: int = MAX_SOURCES) -> DataFrame:
    """(forgotten): how many passing sources are beyond the n that newest_sources() keeps."""
    return entries.where("mode <> 'standing'").groupBy("agent", "slot").agg(F.lit(1).alias("one")).agg(F.greatest(F.count("one") - n, F.lit(0)).alias("forgotten"))


def newest_sources(entries: DataFrame, n: int = MAX_SOURCES) -> DataFrame:
    """Entries of the n sources that hid something last; standing sources are never forgotten.

    The sources are found by a distributed top-n, so no task sees them all.
    """
    passing = entries.where("mode <> 'standing'").groupBy("agent", "slot").agg(F.max("seq").alias("last")).orderBy(F.desc("last"), "slot").limit(n)
    same = F.col("e.agent").eqNullSafe(F.col("p.agent")) & (F.col("e.slot") == F.col("p.slot"))
    return entries.alias("e").where("mode <> 'standing'").join(passing.alias("p"), same, "left_semi").unionByName(entries.where("mode = 'standing'"))


def in_scope(entries: DataFrame, agent: str | None) -> DataFrame:
    """One subagent's passing entries, or all."""
    return entries if agent is None else entries.where((F.col("agent") == agent) & (F.col("mode") != "standing"))


def by_term(entries: DataFrame) -> DataFrame:
    return entries.groupBy("folded").agg(F.sum("replaced").alias("replaced"), F.sum("dropped").alias("dropped"))


def by_list(entries: DataFrame) -> DataFrame:
    """entries with list_name -> (list_name, replaced, dropped, terms)."""
    return entries.groupBy("list_name").agg(F.sum("replaced").alias("replaced"), F.sum("dropped").alias("dropped"), F.countDistinct("folded").alias("terms"))


def list_tree(entries: DataFrame) -> DataFrame:
    """(list_name, hits array<struct<n,folded>>), heaviest term first."""
    per = entries.groupBy("list_name", "folded").agg(F.sum(weight()).alias("n"))
    return per.groupBy("list_name").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "folded"))), lambda x: F.struct((-x["neg"]).alias("n"), x["folded"].alias("folded"))).alias("hits"))


def by_term_source(entries: DataFrame) -> DataFrame:
    return entries.groupBy("folded", "label").agg(F.sum(weight()).alias("n"))


def by_kind(entries: DataFrame) -> DataFrame:
    return entries.groupBy("kind").agg(F.sum(weight()).alias("n"))


def totals(entries: DataFrame) -> DataFrame:
    source = F.struct(F.coalesce("agent", F.lit("")), F.col("slot"))
    return entries.agg(F.coalesce(F.sum("replaced"), F.lit(0)).alias("replaced"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"), F.countDistinct("folded").alias("terms"), F.countDistinct(source).alias("sources"), F.max("at").alias("last_at"))


def shares(rows: DataFrame, n: str = "n") -> DataFrame:
    """Each bar's length: its weight over the largest."""
    return rows.withColumn("share", F.col(n) / F.max(n).over(Window.partitionBy()))


def feed(passes: DataFrame, n: int = MAX_FEED) -> DataFrame:
    """The newest passes that hid something new, newest first."""
    return passes.where(weight() > 0).orderBy(F.desc("seq")).limit(n)


def top_terms(entries: DataFrame, n: int = MAX_TERMS) -> DataFrame:
    """(label, shown array of terms, more): each source's heaviest terms and how many others."""
    per = entries.groupBy("label", "folded").agg(F.sum(weight()).alias("n"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "folded"))
    ranked = per.withColumn("rank", rank)
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= n, F.struct("rank", "folded")))), lambda x: x["folded"])
    return ranked.groupBy("label").agg(shown.alias("shown"), F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more"))


def log_lines(entries: DataFrame, agents: DataFrame | None = None, n: int = MAX_TERMS) -> DataFrame:
    """(place, title, label, seq, lines): the log as text, a row a source, to be read in that order.

    entries: agent, slot, mode, label, seq, folded, replaced, dropped, canonical, placeholder, list_name. What stands comes first
    (place 0), then the main conversation (1), then each subagent (2) by its least recent source. A source's terms come heaviest
    first, the first n of them; of dropped lines a list's name and the count is shown.
    """
    key = ["agent", "slot", "mode"]
    name = F.concat_ws("", F.col("canonical"), F.lit(" -> "), F.col("placeholder"), F.lit(" (x"), F.col("replaced").cast("string"), F.lit(")"))
    swapped = F.collect_list(F.when(F.col("replaced") > 0, F.struct((-F.col("replaced")).alias("neg"), "folded", name.alias("line"))))
    source = entries.groupBy(*key).agg(F.max_by("label", "seq").alias("label"), F.max("seq").alias("seq"), F.array_sort(swapped).alias("swapped"))
    each = entries.where("dropped > 0").groupBy(*key, "list_name").agg(F.sum("dropped").alias("lines"), F.array_sort(F.collect_list(F.struct((-F.col("dropped")).alias("neg"), "folded", F.concat("canonical", F.lit(" (x"), F.col("dropped").cast("string"), F.lit(")")).alias("line")))).alias("terms"))
    rest = F.size("terms") - n
    text = F.concat(plural(F.col("lines"), "line"), F.lit(' dropped by "'), F.col("list_name"), F.lit('": '), F.array_join(F.transform(F.slice("terms", 1, n), lambda x: x["line"]), ", "), F.when(rest > 0, F.concat(F.lit(", and "), rest.cast("string"), F.lit(" more"))).otherwise(""))
    gone = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("list_name", text.alias("line")))).alias("gone")).toDF("g_agent", "g_slot", "g_mode", "gone")
    same = F.col("agent").eqNullSafe(F.col("g_agent")) & (F.col("slot") == F.col("g_slot")) & (F.col("mode") == F.col("g_mode"))
    more = F.size("swapped") - n
    lines = F.concat(F.transform(F.slice("swapped", 1, n), lambda x: x["line"]), F.when(more > 0, F.array(F.concat(F.lit("and "), plural(more, "more term")))).otherwise(F.expr("cast(array() as array<string>)")), F.coalesce(F.transform("gone", lambda x: x["line"]), F.expr("cast(array() as array<string>)")))
    place = F.when(F.col("mode") == "standing", 0).when(F.col("agent").isNull(), 1).otherwise(2)
    rows = source.join(gone, same, "left").select("agent", place.alias("place"), "label", "seq", lines.alias("lines"))
    rows = agent_labels(rows, agents) if agents is not None else rows.withColumn("agent_label", F.col("agent"))
    first = F.when(F.col("place") == 2, F.min("seq").over(Window.partitionBy("agent", "place"))).otherwise(0)
    title = F.when(F.col("place") == 0, "hidden in every request").when(F.col("place") == 1, "hidden as it came in").otherwise(F.concat(F.lit("hidden in subagent "), F.col("agent_label")))
    return rows.withColumn("since", first).select("place", "since", title.alias("title"), "label", "seq", "lines")


def log_text(rows: DataFrame, forgotten_sources: int = 0) -> list[str]:
    """log_lines() as printed lines. The log is bounded by its sources and read by people, so it fits the driver."""
    out, title = [], None
    for r in rows.orderBy("place", "since", "title", "seq", "label").collect():
        if r["place"] > 0 and forgotten_sources and not any(x.startswith("(") for x in out):
            out.append(f"({forgotten_sources} older source{'' if forgotten_sources == 1 else 's'} not shown)")
        if r["title"] != title:
            title = r["title"]
            out.append(title + ":")
        out += ["  " + r["label"], *("      " + x for x in r["lines"])]
    return out or ["nothing has been hidden"]


def open_depth(terms: Column) -> Column:
    """How many levels of the tree stand open: from 30 terms on all lists are folded up."""
    return F.when(terms >= FOLDED_FROM, 0).otherwise(1)


def agent_labels(entries: DataFrame, agents: DataFrame) -> DataFrame:
    """Entries with agent_label: the subagent's name, else its id; the main conversation has none."""
    named = agents.select(F.col("agent_id").alias("agent"), "name")
    return entries.join(named, "agent", "left").withColumn("agent_label", F.coalesce("name", "agent")).drop("name")
