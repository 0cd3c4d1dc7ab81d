"""What is filtered where: event policies, guarded and restored calls, results, and files that were read with something hidden."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.functions.scalars import SHOWN_NAMES, path_key
from veilframe.operators.dictionary import Dictionary, Tally, call_strings
from veilframe.operators.redaction import redact

#: Fixed values: (event, lines may be dropped, counted, log mode, kind).
EVENTS = [
    ("tool.call", True, True, "add", "tools"),
    ("prompt.submit", False, True, "add", "prompts"),
    ("prompt.context", True, True, "standing", "context"),
    ("prompt.attachment", True, True, "replace", "context"),
    ("skill.prompt", True, True, "add", "skills"),
    ("tool.describe", False, False, "add", "tools"),
    ("session.receive", False, True, "add", "prompts"),
    ("command.run", True, True, "add", "commands"),
]
MODEL_TOOLS = ["Agent", "Task", "TodoWrite", "TaskCreate", "TaskUpdate", "AskUserQuestion", "ExitPlanMode", "SendMessage"]
WRITTEN_TEXT = ["content", "old_string", "new_string", "new_source"]
INSTRUCTIONS = "claudeMd"
CONTENT_ATTACHMENTS = ["file", "edited_text_file", "nested_memory", "queued_command"]


def event_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENTS, "event_type string, allow_drop boolean, counted boolean, mode string, kind string")


def with_policy(events: DataFrame) -> DataFrame:
    """Events of the filtered kinds with their policy: eight fixed rows, sent to every task."""
    return events.join(F.broadcast(event_policy(events.sparkSession)), "event_type")


def is_mcp_tool(provider: Column) -> Column:
    """Whether a tool comes from a server: only such tools' descriptions are filtered, built-in ones are never changed."""
    return F.coalesce(provider, F.lit("")).startswith("mcp:")


def filters_attachment(kind: Column, origin: Column) -> Column:
    """Engine-written attachments pass, unless their type carries content."""
    return (F.coalesce(origin, F.lit("")) != "engine") | kind.isin(*CONTENT_ATTACHMENTS)


def attachment_slot(kind: Column, text: Column) -> Column:
    from veilframe.functions.names import fnv1a32_column

    return F.concat_ws(":", F.lit("attachment"), kind, fnv1a32_column(text).cast("string"))


def context_passes(spark: SparkSession, d: Dictionary, blocks: DataFrame) -> DataFrame:
    """Context blocks, instruction files and attachments as passes of the log, with what goes on in place of their text.

    blocks: request, part (block, file, attachment), name (a block's name, a file's path, an attachment's type), origin (who wrote an
    attachment), text. Adds slot, mode, counted, replaced, dropped, hits and value (null: left out). The block that repeats the
    instruction files is rewritten, but not counted where the files are at hand; engine-written attachments pass as they are.
    """
    files = blocks.where("part = 'file'").select("request").distinct().withColumn("by_file", F.lit(True))
    rows = blocks.join(files, "request", "left").withColumn("r", redact(spark, d, "text"))
    is_attachment = F.col("part") == "attachment"
    passes = ~is_attachment | filters_attachment(F.col("name"), F.col("origin"))
    slot = F.when(is_attachment, attachment_slot(F.col("name"), F.col("text"))).when(F.col("part") == "file", F.col("name")).otherwise(F.concat(F.lit("block "), F.col("name")))
    counted = passes & ~(F.coalesce("by_file", F.lit(False)) & (F.col("part") == "block") & (F.col("name") == INSTRUCTIONS))
    value = F.when(~passes, F.col("text")).when(is_attachment & F.col("r.vanished"), F.lit(None).cast("string")).otherwise(F.col("r.value"))
    zero = lambda c: F.when(counted, c).otherwise(0)
    return rows.select(*blocks.columns, slot.alias("slot"), F.when(is_attachment, "replace").otherwise("standing").alias("mode"), counted.alias("counted"), zero(F.col("r.replaced")).alias("replaced"), zero(F.col("r.dropped")).alias("dropped"), "r.hits", value.alias("value"))


CALL = "struct<denied:boolean,reason:string,input:string,restored:boolean>"


def guard_calls(spark: SparkSession, d: Dictionary, tool: Column, payload: Column, config_path: str = "") -> Column:
    """A call refused for a guarded placeholder or for naming the configuration, or its input with usable placeholders restored."""
    sent = spark.sparkContext.broadcast(d)
    flat = lambda s: s.replace("\\", "/").lower()
    names = {flat(config_path), "/".join(flat(config_path).split("/")[-2:])} - {""}

    def one(tool: str, payload: str) -> tuple:
        call = json.loads(payload)
        said = [flat(s) for s in call_strings({k: v for k, v in call.items() if k not in WRITTEN_TEXT})] if names else []
        if any(n in s for n in names for s in said):
            return True, "names the configuration", None, False
        if tool in MODEL_TOOLS:
            return False, None, payload, False
        bad = sent.value.guarded_in(call)
        if bad:
            return True, "uses " + ", ".join(bad), None, False
        value, changed = sent.value.restore(call)
        return False, None, json.dumps(value, ensure_ascii=False, separators=(",", ":")) if changed else payload, changed

    @F.pandas_udf(CALL)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for tools, payloads in batches:
            rows = []
            for t, p in zip(tools, payloads):
                try:
                    rows.append(one(t, p))
                except Exception as e:  # fail closed
                    rows.append((True, f"error: {type(e).__name__}", None, False))
            yield pd.DataFrame(rows, columns=["denied", "reason", "input", "restored"])

    return run.asNondeterministic()(tool, payload)


RESULT = "struct<kind:string,value:string,note:string,replaced:int,dropped:int,error:string>"


def note_text(tally: Tally, d: Dictionary) -> str | None:
    """What a reader of a rewritten text is told: how much is hidden, under which names, and which names may be used."""
    if not tally.replaced and not tally.dropped:
        return None
    many = lambda n, one, more: f"{n} {one if n == 1 else more}"
    names = [d.terms[k].placeholder for k, (r, _) in tally.hits.items() if r]
    said = []
    if tally.replaced:
        said.append(many(tally.replaced, "term stands", "terms stand") + " under other names (" + ", ".join(names[:SHOWN_NAMES]) + ")")
    if tally.dropped:
        said.append(many(tally.dropped, "line is", "lines are") + " left out")
    usable = [n for n in names if d.by_name[n].restored is not None]
    rule = "no call may use these names" if not usable else "calls may use these names" if len(usable) == len(names) else "calls may use " + ", ".join(usable) + " only"
    return "; ".join([*said, rule])


def filter_results(spark: SparkSession, d: Dictionary, denied: Column, is_error: Column, record: Column, text: Column, *, inform: bool = True) -> Column:
    """What goes on of a call's result: struct(kind, value, note, replaced, dropped, error).

    A refusal and an error are rewritten as texts that keep their lines (kind deny, or same where nothing changes). Else the record is
    rewritten, and counts and note are taken from the text that the model reads. Where the record holds nothing but the text still holds a
    term, the text came from elsewhere and goes on, rewritten, as an error (deny). A failure withholds all (kind withheld).
    """
    sent = spark.sparkContext.broadcast(d)

    def one(denied: str | None, is_error: bool, record: str | None, text: str | None) -> tuple:
        own, seen = sent.value, Tally()
        if denied is not None or is_error:
            value, changed, _ = own.rewrite(denied if denied is not None else text or "", seen, False)
            return ("deny" if changed else "same", value if changed else None, None, seen.replaced, seen.dropped, None)
        value, changed, gone = own.rewrite_value(json.loads(record), Tally()) if record is not None else (None, False, False)
        if text is not None:
            own.rewrite(text, seen)
        if not changed:
            if text is not None and own.test(text):
                return "deny", own.rewrite(text, Tally(), False)[0], None, seen.replaced, seen.dropped, None
            return "same", None, None, seen.replaced, seen.dropped, None
        shown = "" if gone else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        return "result", shown, note_text(seen, own) if inform else None, seen.replaced, seen.dropped, None

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            rows = []
            for values in zip(*columns):
                try:
                    rows.append(one(*values))
                except Exception as e:  # fail closed
                    rows.append(("withheld", None, None, 0, 0, type(e).__name__))
            yield pd.DataFrame(rows, columns=["kind", "value", "note", "replaced", "dropped", "error"])

    return run.asNondeterministic()(denied.cast("string"), F.coalesce(is_error, F.lit(False)), record.cast("string"), text.cast("string"))


def tainted_files(reads: DataFrame) -> DataFrame:
    """(path_key) of files whose last read hid something; a whole read that hides nothing releases a file.

    reads: path, seq, hidden (boolean), whole (boolean). Partial clean reads change nothing.
    """
    rows = reads.withColumn("path_key", path_key(F.col("path"))).where("hidden or whole")
    return rows.groupBy("path_key").agg(F.max_by("hidden", "seq").alias("hidden")).where("hidden").select("path_key")


def overwrite_guard(writes: DataFrame, tainted: DataFrame) -> DataFrame:
    """writes with denied: whether the path was last read with something hidden."""
    marked = tainted.select("path_key", F.lit(True).alias("__hit"))
    return writes.withColumn("path_key", path_key(F.col("path"))).join(marked, "path_key", "left").withColumn("denied", F.coalesce("__hit", F.lit(False))).drop("__hit")


def pause_state(controls: DataFrame) -> DataFrame:
    """(session, paused): the last pause or resume of each session by one who may; an end resumes."""
    rows = controls.where("command in ('pause', 'resume', 'end') and (command = 'end' or origin = 'user')")
    return rows.groupBy("session").agg((F.max_by("command", "seq") == "pause").alias("paused"))


def status(has_filter: bool, paused: bool, error: str | None, terms: int) -> str:
    if error and not has_filter:
        return "blocking: the configuration cannot be read"
    return "paused" if paused else f"on: {terms} terms" if terms else "off"


def running_pause(events: DataFrame) -> DataFrame:
    """Events with paused: the state at each event, from the controls before it in its session."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("command").isin("pause", "resume", "end"), F.col("command")), ignorenulls=True).over(w)
    return events.withColumn("paused", F.coalesce(last == "pause", F.lit(False)))
