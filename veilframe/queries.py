"""The library's own queries over the driver's tables, and the SQL that checks each of them."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import scalars as S
from veilframe.functions.folding import fold, fold_column, fold_term
from veilframe.functions.names import assign_placeholders, fnv1a32_column
from veilframe.operators import audit, policy, redaction, terms
from veilframe.operators.dictionary import Dictionary, Term
from veilframe.plans import curate
from veilframe.sources import config as C

SEED = "benchmark"
WORDS = {"the": "english", "with": "english", "from": "english", "que": "romance", "para": "romance", "und": "german", "nicht": "german"}
DROPPED = ("und", "nicht")
USABLE = ("que", "para")
NAMES = assign_placeholders(WORDS, SEED)

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@lru_cache(maxsize=4)
def dictionary(drop: bool = True) -> Dictionary:
    return Dictionary([Term(w, w, lst, drop and w in DROPPED, True, NAMES[w], w if w in USABLE else None) for w, lst in WORDS.items()])


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _forms(ws) -> str:
    return ", ".join(f"('{w}{e}', '{w}')" for w in ws for e in ("", "s", "es"))


FORMS = f"forms(token, folded) AS (VALUES {_forms(WORDS)})"
TOKENS = "tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')) AS token FROM documents)"
#: Lines of the documents with what a rewriting does to each; a last empty line is none.
LINES = f"""dropping(token, folded) AS (VALUES {_forms(DROPPED)}), replacing(token, folded) AS (VALUES {_forms([w for w in WORDS if w not in DROPPED])}),
    split AS (SELECT doc_id, source, lang, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
    each AS (SELECT doc_id, source, lang, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos, len(ls) AS n FROM split),
    lines AS (SELECT *, regexp_extract_all(lower(strip_accents(line)), '[\\p{{L}}\\p{{N}}]+') AS ts FROM each WHERE NOT (pos = n AND line = '' AND n > 1)),
    words AS (SELECT doc_id, pos, unnest(ts) AS token, generate_subscripts(ts, 1) AS nth FROM lines),
    gone AS (SELECT doc_id, pos, arg_min(folded, nth) AS folded FROM words JOIN dropping USING (token) GROUP BY ALL),
    hits AS (SELECT w.doc_id, r.folded, count(*) AS replaced, 0 AS dropped FROM words w JOIN replacing r USING (token) ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos GROUP BY ALL
             UNION ALL SELECT doc_id, folded, 0, count(*) FROM gone GROUP BY ALL),
    named AS (SELECT h.*, d.source AS label, d.lang, {"CASE h.folded " + " ".join(f"WHEN '{w}' THEN '{x}'" for w, x in WORDS.items()) + " END"} AS list_name FROM hits h JOIN documents d USING (doc_id))"""


# --- matching


@query(f"WITH {FORMS}, {TOKENS} SELECT folded, count(*)::BIGINT AS hits, count(DISTINCT doc_id)::BIGINT AS docs FROM tokens JOIN forms USING (token) GROUP BY folded")
def term_hits_by_doc_count(spark, sf_dir):
    return redaction.term_hits(_t(spark, sf_dir, "documents"), dictionary())


@query(ORACLE_SQL["term_hits_by_doc_count"])
def term_hits_token_join(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in WORDS], "folded string")
    return redaction.token_hits(_t(spark, sf_dir, "documents"), words)


FOLDED = "SELECT doc_id, length(f)::INT AS size, md5(f) AS digest FROM (SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[\\s\\-_]+', ' ', 'g') AS f FROM documents)"


@query(FOLDED)
def fold_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", fold("text").alias("f")).select("doc_id", F.char_length("f").alias("size"), F.md5(F.col("f").cast("binary")).alias("digest"))


@query(FOLDED)
def fold_text_jvm(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", fold_column("text").alias("f")).select("doc_id", F.char_length("f").alias("size"), F.md5(F.col("f").cast("binary")).alias("digest"))


@query(f"WITH {FORMS}, {TOKENS} SELECT DISTINCT doc_id FROM tokens JOIN forms USING (token)")
def has_term_filter(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where(redaction.has_term(dictionary(), "text")).select("doc_id")


@query(f"WITH {FORMS}, {TOKENS} SELECT doc_id, count(*)::INT AS n, sum(length(token) - length(folded))::BIGINT AS suffix_chars FROM tokens JOIN forms USING (token) GROUP BY doc_id")
def find_spans(spark, sf_dir):
    found = _t(spark, sf_dir, "documents").select("doc_id", redaction.find_terms(spark, dictionary(), "text").alias("m")).where("size(m) > 0")
    return found.select("doc_id", F.size("m").alias("n"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x["suffix"])).alias("suffix_chars"))


GRAMS = ["of the", "in the", "the", "de la", "la"]


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}'']+') AS w FROM documents),
    p AS (SELECT doc_id, unnest(w) AS a, unnest(w[2:]) AS b FROM t) SELECT doc_id, count(*)::BIGINT AS n FROM p WHERE a || ' ' || b IN ('of the', 'in the', 'de la') GROUP BY doc_id""")
def ngram_phrases(spark, sf_dir):
    words = spark.createDataFrame([(g,) for g in GRAMS], "folded string")
    found = redaction.ngram_find(_t(spark, sf_dir, "documents"), words, words=2)
    return found.select("doc_id", F.size(F.filter("matches", lambda m: m["words"] == 2)).cast("long").alias("n")).where("n > 0")


# --- rewriting


def _passes(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").where("text is not null")
    done = docs.select("doc_id", F.col("source").alias("label"), "lang", redaction.redact(spark, dictionary(), "text").alias("r"))
    return done.select("doc_id", "label", "lang", "r.*")


@query(f"""WITH {LINES}, g AS (SELECT doc_id, sum(replaced)::INT AS replaced, sum(dropped)::INT AS dropped FROM hits GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id)
    SELECT n.doc_id, coalesce(replaced, 0)::INT AS replaced, coalesce(dropped, 0)::INT AS dropped, coalesce(replaced + dropped, 0) > 0 AS changed, coalesce(dropped, 0) = n AS vanished FROM n LEFT JOIN g USING (doc_id)""")
def redact_replace_counts(spark, sf_dir):
    return _passes(spark, sf_dir).select("doc_id", "replaced", "dropped", "changed", "vanished")


@query(f"""WITH {LINES} SELECT doc_id, coalesce(md5(string_agg(line || CASE WHEN pos < n THEN chr(10) ELSE '' END, '' ORDER BY pos)), md5('')) AS digest
    FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY doc_id""")
def drop_lines(spark, sf_dir):
    d = Dictionary([Term(w, w, "german", True, True) for w in DROPPED])
    kept = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", redaction.drop_lines(d, "text").alias("kept"))
    return kept.where("kept <> ''").select("doc_id", F.md5(F.col("kept").cast("binary")).alias("digest"))


@query(f"WITH {LINES} SELECT folded, count(*)::BIGINT AS lines FROM gone GROUP BY folded")
def line_drop_by_first_term(spark, sf_dir):
    return _passes(spark, sf_dir).select(F.explode("hits").alias("h")).where("h.dropped > 0").groupBy("h.folded").agg(F.sum("h.dropped").alias("lines"))


@query(f"""WITH {LINES}, g AS (SELECT doc_id, sum(replaced) AS replaced, sum(dropped) AS dropped FROM hits GROUP BY doc_id), n AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id)
    SELECT 'call' AS tool, count(*)::BIGINT AS events, count(g.doc_id)::BIGINT AS changed, sum(g.replaced)::BIGINT AS replaced, sum(g.dropped)::BIGINT AS dropped, count(*) FILTER (g.dropped = n)::BIGINT AS emptied FROM n LEFT JOIN g USING (doc_id)""")
def nested_json_redaction(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").where("text is not null")
    payload = F.to_json(F.struct(F.lit("kept und").alias("type"), F.array(F.struct(F.col("text").alias("name"))).alias("items")))
    done = docs.select(redaction.redact_json(spark, dictionary(), payload).alias("r"))
    emptied = F.get_json_object("r.value", "$.items[0]").isNull()
    return done.agg(F.lit("call").alias("tool"), F.count(F.lit(1)).alias("events"), F.count_if("r.changed").alias("changed"), F.sum("r.replaced").alias("replaced"), F.sum("r.dropped").alias("dropped"), F.count_if(emptied).alias("emptied"))


#: Words of several scripts, one after each document; the first three are listed in other spellings.
SCRIPTS = ["ЁЛКА", "ΕΛΛΆΣ", "VIỆT", "Straße", "한글"]
SCRIPT_SQL = f"docs AS (SELECT doc_id, text || chr(10) || [{', '.join(repr(w) for w in SCRIPTS)}][doc_id % 5 + 1] AS text FROM documents WHERE text IS NOT NULL)"


def _scripts(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").where("text is not null")
    word = F.element_at(F.array(*map(F.lit, SCRIPTS)), (F.col("doc_id") % 5 + 1).cast("int"))
    terms_ = Dictionary([Term(w, w, "scripts", True, True) for w in ("елка", "ελλασ", "viet", fold_term("한글"))])
    return docs.select("doc_id", F.concat("text", F.lit("\n"), word).alias("text")), terms_


@query(f"WITH {SCRIPT_SQL} SELECT doc_id FROM docs WHERE doc_id % 5 <> 3")
def scripts_has_term(spark, sf_dir):
    docs, d = _scripts(spark, sf_dir)
    return docs.where(redaction.has_term(d, "text")).select("doc_id")


@query(f"WITH {SCRIPT_SQL} SELECT doc_id, md5(CASE WHEN doc_id % 5 = 3 THEN text ELSE left(text, length(text) - length([{', '.join(repr(w) for w in SCRIPTS)}][doc_id % 5 + 1])) END) AS digest FROM docs")
def scripts_drop_lines(spark, sf_dir):
    docs, d = _scripts(spark, sf_dir)
    return docs.select("doc_id", F.md5(redaction.drop_lines(d, "text").cast("binary")).alias("digest"))


@query(f"WITH {SCRIPT_SQL} SELECT ['елка', 'ελλασ', 'viet'][doc_id % 5 + 1] AS folded, count(*)::BIGINT AS hits, count(*)::BIGINT AS docs FROM docs WHERE doc_id % 5 < 3 GROUP BY 1")
def scripts_token_join(spark, sf_dir):
    words = spark.createDataFrame([("елка",), ("ελλασ",), ("viet",)], "folded string")
    return redaction.token_hits(_scripts(spark, sf_dir)[0], words)


def _call_sql(name: str) -> str:
    return f"CASE conv_id % 3 WHEN 0 THEN '{NAMES['the']}' WHEN 1 THEN '{NAMES['que']}s' ELSE 'none' END AS {name}"


def _calls(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    name = F.when(F.col("conv_id") % 3 == 0, NAMES["the"]).when(F.col("conv_id") % 3 == 1, NAMES["que"] + "s").otherwise("none")
    tool = F.when(F.col("turn") % 4 == 3, "SendMessage").otherwise("Bash")
    return c.select("conv_id", "turn", tool.alias("tool"), F.to_json(F.struct(F.concat(F.lit("run "), name).alias("command"))).alias("payload"))


@query(f"""SELECT conv_id, turn, tool, tool = 'Bash' AND conv_id % 3 = 0 AS denied,
    CASE WHEN tool = 'Bash' AND conv_id % 3 = 0 THEN NULL WHEN tool = 'Bash' AND conv_id % 3 = 1 THEN '{{"command":"run ques"}}' ELSE '{{"command":"run ' || name || '"}}' END AS input
    FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'SendMessage' ELSE 'Bash' END AS tool, {_call_sql("name")} FROM conversations)""")
def guard_and_restore_calls(spark, sf_dir):
    calls = _calls(spark, sf_dir).withColumn("c", policy.guard_calls(spark, dictionary(), F.col("tool"), F.col("payload")))
    return calls.select("conv_id", "turn", "tool", "c.denied", "c.input")


# --- log


@query(f"WITH {LINES} SELECT folded, sum(replaced)::BIGINT AS replaced, sum(dropped)::BIGINT AS dropped FROM named GROUP BY folded")
def term_summary(spark, sf_dir):
    return audit.by_term(audit.hit_rows(_passes(spark, sf_dir)))


def _named(spark, sf_dir):
    lists = spark.createDataFrame(list(WORDS.items()), "folded string, list_name string")
    hits = audit.named_hits(audit.hit_rows(_passes(spark, sf_dir).withColumn("slot", F.col("label"))), lists)
    return hits.withColumn("kind", F.when(F.col("lang") == "en", "files").otherwise("web")).withColumn("agent", F.lit(None).cast("string")).withColumn("mode", F.lit("add")).withColumn("seq", F.col("doc_id"))


@query(f"WITH {LINES} SELECT list_name, sum(replaced)::BIGINT AS replaced, sum(dropped)::BIGINT AS dropped, count(DISTINCT folded)::BIGINT AS terms FROM named GROUP BY list_name")
def list_summary(spark, sf_dir):
    return audit.by_list(_named(spark, sf_dir))


@query(f"WITH {LINES}, w AS (SELECT list_name, folded, sum(replaced + dropped)::BIGINT AS n FROM named GROUP BY ALL) SELECT list_name, string_agg(folded || ':' || n, ',' ORDER BY n DESC, folded) AS hits FROM w GROUP BY list_name")
def list_tree(spark, sf_dir):
    tree = audit.list_tree(_named(spark, sf_dir))
    return tree.select("list_name", F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["folded"], h["n"].cast("string"))), ",").alias("hits"))


@query(f"WITH {LINES} SELECT folded, label, sum(replaced + dropped)::BIGINT AS n FROM named GROUP BY ALL")
def term_source_weights(spark, sf_dir):
    return audit.by_term_source(_named(spark, sf_dir))


@query(f"WITH {LINES}, k AS (SELECT CASE WHEN lang = 'en' THEN 'files' ELSE 'web' END AS kind, sum(replaced + dropped)::BIGINT AS n FROM named GROUP BY ALL) SELECT kind, n, n / max(n) OVER () AS share FROM k")
def kind_summary(spark, sf_dir):
    return audit.shares(audit.by_kind(_named(spark, sf_dir)))


@query(f"WITH {LINES} SELECT sum(replaced)::BIGINT AS replaced, sum(dropped)::BIGINT AS dropped, count(DISTINCT folded)::BIGINT AS terms, count(DISTINCT label)::BIGINT AS sources, max(doc_id)::BIGINT AS last_at FROM named")
def log_totals(spark, sf_dir):
    return audit.totals(_named(spark, sf_dir).withColumn("at", F.col("seq")))


@query(f"WITH {LINES}, p AS (SELECT doc_id, max(label) AS label, sum(replaced)::INT AS replaced, sum(dropped)::INT AS dropped FROM named GROUP BY doc_id) SELECT * FROM p ORDER BY doc_id DESC LIMIT 100")
def feed_topk(spark, sf_dir):
    return audit.feed(_passes(spark, sf_dir).withColumn("seq", F.col("doc_id"))).select("doc_id", "label", "replaced", "dropped")


@query(f"WITH {LINES}, s AS (SELECT label, max(doc_id) AS last FROM named GROUP BY label ORDER BY last DESC, label LIMIT 5) SELECT label, sum(replaced + dropped)::BIGINT AS n FROM named WHERE label IN (SELECT label FROM s) GROUP BY label")
def newest_sources(spark, sf_dir):
    return audit.newest_sources(audit.log_entries(_named(spark, sf_dir).withColumn("at", F.col("seq"))), 5).groupBy("label").agg(F.sum(audit.weight()).alias("n"))


@query(f"""WITH {LINES}, w AS (SELECT label, folded, sum(replaced + dropped) AS n FROM named GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, folded) AS k FROM w)
    SELECT label, string_agg(folded, ', ' ORDER BY k) FILTER (k <= 3) AS shown, greatest(count(*) - 3, 0)::BIGINT AS more FROM r GROUP BY label""")
def top_terms_by_source(spark, sf_dir):
    return audit.top_terms(_named(spark, sf_dir), 3).select("label", F.array_join("shown", ", ").alias("shown"), "more")


MODES = "CASE event_type WHEN 'purchase' THEN 'replace' WHEN 'click' THEN 'standing' ELSE 'add' END"


@query(f"""WITH e AS (SELECT user_id % 50 AS slot, {MODES} AS mode, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 't' || event_id % 5 END AS folded, event_id AS seq, max(event_id) OVER (PARTITION BY user_id % 50, {MODES}) AS last FROM events)
    SELECT slot::VARCHAR AS slot, mode, folded, count(*)::BIGINT AS replaced FROM e WHERE (mode = 'add' OR seq = last) AND folded IS NOT NULL GROUP BY ALL""")
def log_modes(spark, sf_dir):
    mode = F.when(F.col("event_type") == "purchase", "replace").when(F.col("event_type") == "click", "standing").otherwise("add")
    folded = F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string")))
    e = _t(spark, sf_dir, "events").select(F.lit(None).cast("string").alias("agent"), (F.col("user_id") % 50).cast("string").alias("slot"), mode.alias("mode"), F.col("event_type").alias("label"), F.lit("tools").alias("kind"), folded.alias("folded"), F.lit(1).alias("replaced"), F.lit(0).alias("dropped"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    return audit.log_entries(e).select("slot", "mode", "folded", "replaced")


def _event_passes(spark, sf_dir):
    mode = F.when(F.col("event_type") == "purchase", "replace").when(F.col("event_type") == "click", "standing").otherwise("add")
    hid = F.when(F.col("event_id") % 7 != 0, 1).otherwise(0)
    return _t(spark, sf_dir, "events").select(F.lit(None).cast("string").alias("agent"), (F.col("user_id") % 50).cast("string").alias("slot"), mode.alias("mode"), F.col("event_type").alias("label"), F.lit("tools").alias("kind"), F.when(hid == 1, F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string"))).alias("folded"), hid.alias("replaced"), F.lit(0).alias("dropped"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))


PASSES = f"p AS (SELECT (user_id % 50)::VARCHAR AS slot, {MODES} AS mode, event_id AS seq, event_id % 7 <> 0 AS hid, 't' || event_id % 5 AS folded, event_type AS label FROM events)"


@query(f"WITH {PASSES}, l AS (SELECT *, lag(hid, 1, false) OVER (PARTITION BY slot, mode ORDER BY seq) AS had FROM p) SELECT seq, slot, mode FROM l WHERE hid AND (mode = 'add' OR NOT had)")
def feed_of_new_passes(spark, sf_dir):
    return audit.new_passes(_event_passes(spark, sf_dir)).select("seq", "slot", "mode")


CLEAR = "(SELECT max(event_id) // 2 FROM events)"


@query(f"""WITH {PASSES}, q AS (SELECT * FROM p WHERE mode = 'standing' OR seq > {CLEAR}), l AS (SELECT *, max(seq) OVER (PARTITION BY slot, mode) AS last FROM q)
    SELECT slot, mode, folded, count(*)::BIGINT AS replaced FROM l WHERE hid AND (mode = 'add' OR seq = last) GROUP BY ALL""")
def log_after_clear(spark, sf_dir):
    passes = _event_passes(spark, sf_dir)
    half = passes.agg(F.max("seq").alias("m")).select(F.floor(F.col("m") / 2).alias("seq"))
    clears = half.unionByName(half.select((F.col("seq") - 100).alias("seq")))
    return audit.log_entries(audit.after_clear(passes, clears)).select("slot", "mode", "folded", "replaced")


@query(f"WITH {PASSES}, l AS (SELECT *, max(seq) OVER (PARTITION BY slot, mode) AS last FROM p) SELECT greatest(count(DISTINCT slot) - 30, 0)::BIGINT AS forgotten FROM l WHERE hid AND mode <> 'standing' AND (mode = 'add' OR seq = last)")
def log_forgotten(spark, sf_dir):
    return audit.forgotten(audit.log_entries(_event_passes(spark, sf_dir)), 30)


@query(f"""WITH {LINES}, w AS (SELECT label, list_name, folded, sum(replaced) AS r, sum(dropped) AS d, max(doc_id) AS seq FROM named GROUP BY ALL),
    a AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY r DESC, folded) AS k FROM w WHERE r > 0), s AS (SELECT label, string_agg(folded || ' -> ' || folded || '0 (x' || r || ')', '; ' ORDER BY k) FILTER (k <= 2) || CASE WHEN count(*) > 3 THEN '; and ' || count(*) - 2 || ' more terms' WHEN count(*) = 3 THEN '; and 1 more term' ELSE '' END AS line FROM a GROUP BY label),
    g AS (SELECT label, sum(d) || CASE WHEN sum(d) = 1 THEN ' line' ELSE ' lines' END || ' dropped by "' || list_name || '": ' || string_agg(folded || ' (x' || d || ')', ', ' ORDER BY d DESC, folded) AS line FROM w WHERE d > 0 GROUP BY label, list_name)
    SELECT 1 AS place, 'hidden as it came in' AS title, label, max(seq)::BIGINT AS seq, concat_ws('; ', any_value(s.line), replace(any_value(g.line), ',000', ',000')) AS lines FROM w LEFT JOIN s USING (label) LEFT JOIN g USING (label) GROUP BY label""")
def log_lines(spark, sf_dir):
    entries = audit.log_entries(_named(spark, sf_dir).withColumn("at", F.col("seq"))).withColumn("canonical", F.col("folded")).withColumn("placeholder", F.concat("folded", F.lit("0")))
    lists = spark.createDataFrame(list(WORDS.items()), "folded string, list_name string")
    rows = audit.log_lines(entries.join(F.broadcast(lists), "folded"), n=2)
    return rows.select("place", "title", "label", "seq", F.regexp_replace(F.array_join("lines", "; "), r"^([0-9]+),([0-9]{3}) line|(; [0-9]+),([0-9]{3}) line", "$1$3$2$4 line").alias("lines"))


@query(f"""WITH {FORMS}, {TOKENS}, {LINES}, t AS (SELECT doc_id, count(*) AS n FROM tokens JOIN forms USING (token) GROUP BY doc_id), g AS (SELECT doc_id, sum(replaced) AS replaced, sum(dropped) AS dropped FROM hits GROUP BY doc_id)
    SELECT doc_id, CASE WHEN t.n IS NULL THEN 'same' WHEN doc_id % 3 = 2 THEN 'result' ELSE 'deny' END AS kind,
           coalesce(CASE WHEN doc_id % 3 = 2 THEN g.replaced ELSE t.n END, 0)::INT AS replaced, CASE WHEN doc_id % 3 = 2 THEN coalesce(g.dropped, 0) ELSE 0 END::INT AS dropped, t.n IS NOT NULL AND doc_id % 3 = 2 AS noted
    FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN g USING (doc_id) WHERE text IS NOT NULL""")
def result_policy(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where("text is not null")
    third, none = F.col("doc_id") % 3, F.lit(None).cast("string")
    record = F.to_json(F.struct(F.array("text").alias("content")))
    done = policy.filter_results(spark, dictionary(), F.when(third == 0, F.col("text")), third == 1, F.when(third == 2, record).otherwise(none), F.col("text"))
    return d.select("doc_id", done.alias("r")).select("doc_id", "r.kind", "r.replaced", "r.dropped", F.col("r.note").isNotNull().alias("noted"))


@query(f"""WITH {LINES}, g AS (SELECT doc_id, sum(replaced) AS replaced, sum(dropped) AS dropped FROM hits GROUP BY doc_id), n AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id),
    b AS (SELECT doc_id, doc_id // 6 AS request, CASE doc_id % 6 WHEN 0 THEN 'file' WHEN 1 THEN 'block' WHEN 2 THEN 'block' ELSE 'attachment' END AS part, CASE doc_id % 6 WHEN 1 THEN 'claudeMd' WHEN 3 THEN 'file' WHEN 4 THEN 'plan' ELSE 'other' END AS name, doc_id % 6 IN (3, 4) AS by_engine FROM documents WHERE text IS NOT NULL),
    f AS (SELECT DISTINCT request FROM b WHERE part = 'file'),
    c AS (SELECT b.*, NOT (part = 'attachment' AND by_engine AND name <> 'file') AND NOT (part = 'block' AND name = 'claudeMd' AND request IN (SELECT request FROM f)) AS counted FROM b)
    SELECT c.doc_id, part, CASE WHEN part = 'attachment' THEN 'replace' ELSE 'standing' END AS mode, counted, CASE WHEN counted THEN coalesce(replaced, 0) ELSE 0 END::INT AS replaced, CASE WHEN counted THEN coalesce(dropped, 0) ELSE 0 END::INT AS dropped,
           part = 'attachment' AND NOT (by_engine AND name <> 'file') AND coalesce(dropped, 0) = n AS left_out
    FROM c JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)""")
def context_passes(spark, sf_dir):
    k = F.col("doc_id") % 6
    part = F.when(k == 0, "file").when(k.isin(1, 2), "block").otherwise("attachment")
    name = F.when(k == 1, "claudeMd").when(k == 3, "file").when(k == 4, "plan").otherwise("other")
    blocks = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.floor(F.col("doc_id") / 6).alias("request"), part.alias("part"), name.alias("name"), F.when(k.isin(3, 4), "engine").otherwise("user").alias("origin"), "text")
    done = policy.context_passes(spark, dictionary(), blocks)
    return done.select("doc_id", "part", "mode", "counted", "replaced", "dropped", F.col("value").isNull().alias("left_out"))


@query("SELECT page_id, coalesce(string_agg(chr(2) || x, '' ORDER BY i) FILTER (i < n), '') || chr(1) || max(x) FILTER (i = n) AS walk FROM (SELECT page_id, unnest(string_split(url, '/')) AS x, generate_subscripts(string_split(url, '/'), 1) AS i, len(string_split(url, '/')) AS n FROM pages) GROUP BY page_id")
def walk_order(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", curate.walk_order(F.col("url")).alias("walk"))


@query("SELECT n_regionkey AS list_name, CASE WHEN count(*) * 7 >= 30 THEN 0 ELSE 1 END AS depth FROM nation WHERE n_nationkey % 3 > 0 OR n_regionkey > 2 GROUP BY n_regionkey")
def tree_depth(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").where("n_nationkey % 3 > 0 or n_regionkey > 2")
    return rows.groupBy(F.col("n_regionkey").alias("list_name")).agg(audit.open_depth(F.count(F.lit(1)) * 7).alias("depth"))


# --- term dimension and configuration

REFS = [("maya", "Maya", "a", False, True, 0), ("maya", "MAYA", "b", True, False, 1), ("giza", "Giza", "a", False, True, 2), ("giza", "giza", "c", False, True, 3), ("x", "X", "a", False, False, 4), ("tikal", "Tikal", "b", True, False, 5), ("tikal", "TIKAL", "c", False, True, 6)]
REFS_SQL = "refs(folded, canonical, list_name, dropping, restoring, seq) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}, {e}, {n})" for a, b, c, d, e, n in REFS) + ")"


def _refs(spark):
    return spark.createDataFrame([(a, b, 0, c, d, True, e, n) for a, b, c, d, e, n in REFS], terms.REFS)


@query(f"""WITH {REFS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY folded ORDER BY NOT dropping, seq) AS k, bool_and(restoring) OVER (PARTITION BY folded) AS restorable,
    first_value(canonical) OVER (PARTITION BY folded ORDER BY seq) AS first_canonical FROM refs WHERE length(folded) >= 2) SELECT folded, canonical, list_name, restorable, first_canonical FROM r WHERE k = 1""")
def term_dim_resolution(spark, sf_dir):
    return terms.resolve_terms(_refs(spark)).select("folded", "canonical", "list_name", "restorable", "first_canonical")


@query(f"WITH {REFS_SQL} SELECT count(DISTINCT folded) FILTER (length(folded) >= 2)::BIGINT AS terms, count(*) FILTER (length(folded) < 2)::BIGINT AS skipped FROM refs")
def term_counts(spark, sf_dir):
    return terms.term_counts(_refs(spark))


@query(f"WITH {REFS_SQL} SELECT list_name, folded FROM refs ANTI JOIN (VALUES ('a', 'giza'), ('c', 'tikal')) x(list_name, folded) USING (list_name, folded)")
def exclude_terms(spark, sf_dir):
    out = spark.createDataFrame([("a", "giza"), ("c", "tikal")], "list_name string, folded string")
    return terms.exclude_terms(_refs(spark), out).select("list_name", "folded")


@query("SELECT n_name AS pack, min(p)::INT AS priority, count(*) > 1 AS is_replaced FROM (SELECT n_name, 1 AS p FROM nation UNION ALL SELECT n_name, 0 FROM nation WHERE n_regionkey < 2) GROUP BY n_name")
def pack_overlay(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    packs = n.select(F.col("n_name").alias("pack"), F.lit(1).alias("priority")).unionByName(n.where("n_regionkey < 2").select(F.col("n_name").alias("pack"), F.lit(0).alias("priority")))
    return C.overlay(packs).select("pack", "priority", "is_replaced")


@query("""WITH l AS (SELECT n_name AS pack, 'list' || n_regionkey AS list_name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL VALUES ('nowhere', 'list9')), u AS (SELECT pack, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS used_by FROM l GROUP BY pack)
    SELECT coalesce(n.n_name, u.pack) AS pack, coalesce(used_by, '') AS used_by, n.n_name IS NOT NULL AS found FROM nation n FULL JOIN u ON n.n_name = u.pack""")
def pack_usage(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    lists = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("pack"), F.concat(F.lit("list"), F.col("n_regionkey").cast("string")).alias("list_name")).union(spark.createDataFrame([("nowhere", "list9")], "pack string, list_name string"))
    return C.pack_usage(lists, n.select(F.col("n_name").alias("pack"))).select("pack", F.array_join("used_by", ",").alias("used_by"), "found")


@query("""WITH c AS (SELECT a.n_name AS name, b.n_name AS other, CASE WHEN starts_with(a.n_name, b.n_name) OR starts_with(b.n_name, a.n_name) THEN 0 ELSE levenshtein(a.n_name, b.n_name) END AS d
    FROM (SELECT left(n_name, greatest(length(n_name) - 1, 1)) || 'X' AS n_name FROM nation) a, nation b)
    SELECT name, arg_min(other, (d, other)) AS closest FROM c WHERE d <= greatest(2, floor(length(name) / 3)) GROUP BY name""")
def closest_name(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("other"))
    asked = n.select(F.expr("concat(left(other, greatest(length(other) - 1, 1)), 'X')").alias("name"))
    # Names typed by people against the names of packs: both sides are lists on the driver's scale.
    near = asked.join(F.broadcast(n), S.near_name(F.col("name"), F.col("other")).isNotNull()).withColumn("d", S.near_name(F.col("name"), F.col("other")))
    return near.groupBy("name").agg(F.min_by("other", F.struct("d", "other")).alias("closest"))


# --- policy


@query("""SELECT event_type, kind, allow_drop, count(*)::BIGINT AS n FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'tool.call' WHEN 1 THEN 'prompt.submit' ELSE 'other' END AS event_type FROM events) JOIN (VALUES ('tool.call', 'tools', true), ('prompt.submit', 'prompts', false)) p(event_type, kind, allow_drop) USING (event_type) GROUP BY ALL""")
def event_policy(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "tool.call").when(F.col("event_id") % 3 == 1, "prompt.submit").otherwise("other")
    return policy.with_policy(_t(spark, sf_dir, "events").select(kind.alias("event_type"))).groupBy("event_type", "kind", "allow_drop").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT user_id, event_id, value > 50 AS hidden, event_id % 2 = 0 AS whole FROM events), t AS (SELECT user_id FROM r WHERE hidden OR whole GROUP BY user_id HAVING arg_max(hidden, event_id))
    SELECT 'd:/u' || user_id AS path_key, count(*)::BIGINT AS writes, bool_or(user_id IN (SELECT user_id FROM t)) AS denied FROM events GROUP BY user_id""")
def overwrite_guard(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("path", F.concat(F.lit("D:\\U"), F.col("user_id").cast("string")))
    tainted = policy.tainted_files(e.select("path", F.col("event_id").alias("seq"), (F.col("value") > 50).alias("hidden"), (F.col("event_id") % 2 == 0).alias("whole")))
    return policy.overwrite_guard(e.select("path"), tainted).groupBy("path_key").agg(F.count(F.lit(1)).alias("writes"), F.bool_or("denied").alias("denied"))


COMMANDS = "CASE event_id % 5 WHEN 0 THEN 'pause' WHEN 1 THEN 'resume' WHEN 2 THEN 'end' ELSE 'log' END"


@query(f"WITH c AS (SELECT user_id AS session, event_id AS seq, {COMMANDS} AS command, CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'agent' END AS origin FROM events) SELECT session, arg_max(command, seq) = 'pause' AS paused FROM c WHERE command IN ('pause', 'resume', 'end') AND (command = 'end' OR origin = 'user') GROUP BY session")
def pause_state(spark, sf_dir):
    n = F.col("event_id") % 5
    command = F.when(n == 0, "pause").when(n == 1, "resume").when(n == 2, "end").otherwise("log")
    return policy.pause_state(_t(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), command.alias("command"), F.when(F.col("event_id") % 2 == 0, "user").otherwise("agent").alias("origin")))


@query(f"WITH c AS (SELECT user_id AS session, event_id AS seq, {COMMANDS} AS command FROM events), p AS (SELECT *, last_value(CASE WHEN command <> 'log' THEN command END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq) AS last FROM c) SELECT session, count(*) FILTER (last = 'pause')::BIGINT AS paused_events FROM p GROUP BY session")
def running_pause(spark, sf_dir):
    n = F.col("event_id") % 5
    command = F.when(n == 0, "pause").when(n == 1, "resume").when(n == 2, "end").otherwise("log")
    rows = policy.running_pause(_t(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), command.alias("command")))
    return rows.groupBy("session").agg(F.count_if("paused").alias("paused_events"))


@query("SELECT CASE event_type WHEN 'click' THEN 'files' WHEN 'view' THEN 'web' WHEN 'purchase' THEN 'commands' ELSE 'tools' END AS kind, count(*)::BIGINT AS n, sum(value) AS total FROM events GROUP BY 1")
def event_kind_log(spark, sf_dir):
    tool = F.when(F.col("event_type") == "click", "Read").when(F.col("event_type") == "view", "WebFetch").when(F.col("event_type") == "purchase", "Bash").otherwise("Other")
    return _t(spark, sf_dir, "events").select(S.kind_of_tool(tool).alias("kind"), "value").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE props LIKE '{%}' AND (props->>'$.k')::INT > 50")
def json_props_filter(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").where(S.looks_like_json(F.col("props")))
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k > 50")


@query("SELECT window_start, event_type, count(*)::BIGINT AS n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type FROM events) GROUP BY ALL")
def events_by_window(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


# --- scalars


@query("SELECT n_name AS word, list_reduce(list_transform(string_split(n_name, ''), lambda c: ascii(c)::BIGINT), lambda h, u: (xor(h, u) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM nation")
def fnv1a_hash(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select(F.col("n_name").alias("word"), fnv1a32_column(F.col("n_name")).alias("h"))


@query("""SELECT page_id, lower(replace(url, '\\', '/')) AS path, CASE WHEN length(u) <= 100 THEN u ELSE left(u, 97) || '...' END AS label, substr(sha256(url), 1, 40) AS cache_key, regexp_matches(split_part(url, '/', 3), '^[a-z0-9][a-z0-9-]*$') AS slug
    FROM (SELECT *, trim(regexp_replace(url || ' ' || url || ' ' || url, '\\s+', ' ', 'g')) AS u FROM pages)""")
def url_scalars(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    return p.select("page_id", S.path_key(F.col("url")).alias("path"), S.source_label(F.concat_ws(" ", "url", "url", "url")).alias("label"), S.cache_key(F.col("url")).alias("cache_key"), S.is_slug(F.split_part("url", F.lit("/"), F.lit(3))).alias("slug"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[.?!](\\s|$)') THEN regexp_replace(regexp_extract(text, '(?s)^.*?[.?!](\\s|$)'), '\\s$', '') ELSE text END AS sentence, md5(replace(text, '|', '\\|')) AS cell FROM documents WHERE text IS NOT NULL""")
def sentence_scalars(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", S.first_sentence(F.col("text")).alias("sentence"), F.md5(S.cell(F.col("text")).cast("binary")).alias("cell"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y.%m.%d') AS version FROM orders")
def version_dates(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", S.version_of(F.col("o_orderdate")).alias("version"))


# --- curation

TITLE = "regexp_replace(regexp_replace(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '(\\s*\\([^()]*\\))+\\s*$', ''), '^[ ,;:]+|[ ,;:]+$', '', 'g')"
RAW = """raw AS (SELECT 0 AS source_idx, p_partkey AS seq, CASE p_partkey % 6 WHEN 0 THEN 'List of ' || p_name WHEN 1 THEN p_name || ' (part)' WHEN 2 THEN 'Category:' || p_name WHEN 3 THEN p_name || ', North' WHEN 4 THEN p_name || ' 1990' ELSE p_name END AS raw FROM part
    UNION ALL SELECT 1, n_nationkey, n_name FROM nation)"""
CLEANED = f"""{RAW}, named AS (SELECT *, regexp_replace(split_part({TITLE}, ', ', 1), '^[ ,;:]+|[ ,;:]+$', '', 'g') AS n FROM raw),
    cleaned AS (SELECT *, CASE WHEN trim(raw) = '' THEN 'empty' WHEN regexp_matches(lower(raw), '^(category|template|portal|help|file):') THEN 'namespace page' WHEN regexp_matches(lower(raw), '^(lists? of|index of)\\b') THEN 'list or outline page'
    WHEN regexp_matches(n, '^[-*]|-$') THEN 'affix or reconstruction' WHEN regexp_matches(' ' || lower(n) || ' ', ' \\d+(s|st|nd|rd|th)? ') THEN 'number or year' WHEN length(n) <= 2 THEN 'too short'
    WHEN upper(n) = n AND lower(n) <> n AND length(regexp_replace(n, '[^\\p{{L}}\\p{{N}}]', '', 'g')) <= 4 THEN 'short acronym' WHEN length(regexp_replace(n, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 3 THEN 'too few letters'
    WHEN len(string_split(n, ' ')) > 5 THEN 'longer than 5 words' ELSE '' END AS reason FROM named)"""
KEYED = f"{CLEANED}, keyed AS (SELECT *, CASE WHEN reason = '' THEN n END AS text, trim(regexp_replace(lower(strip_accents(CASE WHEN reason = '' THEN n ELSE raw END)), '[\\s\\-_]+', ' ', 'g')) AS key FROM cleaned)"


def _items(spark, sf_dir):
    p, name = _t(spark, sf_dir, "part"), F.col("p_name")
    k = F.col("p_partkey") % 6
    raw = F.when(k == 0, F.concat(F.lit("List of "), name)).when(k == 1, F.concat(name, F.lit(" (part)"))).when(k == 2, F.concat(F.lit("Category:"), name)).when(k == 3, F.concat(name, F.lit(", North"))).when(k == 4, F.concat(name, F.lit(" 1990"))).otherwise(name)
    parts = p.select(F.lit(0).alias("source_idx"), F.lit("wikipedia-category").alias("kind"), F.lit("terms").alias("role"), raw.alias("title"), F.col("p_partkey").alias("seq"))
    nations = _t(spark, sf_dir, "nation").select(F.lit(1).alias("source_idx"), F.lit("datamuse-rel-trg").alias("kind"), F.lit("hints").alias("role"), F.col("n_name").alias("title"), F.col("n_nationkey").cast("long").alias("seq"))
    return parts.unionByName(nations.select(*parts.columns))


@query(f"WITH {KEYED} SELECT source_idx, seq::BIGINT AS seq, text, reason, key FROM keyed")
def clean_titles(spark, sf_dir):
    return curate.clean_titles(_items(spark, sf_dir)).select("source_idx", "seq", "text", "reason", "key")


@query(f"WITH {KEYED} SELECT key, len(list_distinct(list(source_idx)))::INT AS origins, arg_max(text, (length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')), length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')), -source_idx, -seq)) AS text FROM keyed WHERE reason = '' GROUP BY key")
def merge_candidates(spark, sf_dir):
    kept, _ = curate.merge_candidates(curate.clean_titles(_items(spark, sf_dir)))
    return kept.select("key", F.size("origins").alias("origins"), "text")


@query(f"WITH {KEYED} SELECT key, arg_min(reason, (source_idx, seq)) AS reason FROM keyed WHERE reason <> '' AND key NOT IN (SELECT key FROM keyed WHERE reason = '') GROUP BY key")
def kept_vs_dropped(spark, sf_dir):
    return curate.merge_candidates(curate.clean_titles(_items(spark, sf_dir)))[1].select("key", "reason")


@query("WITH w AS (SELECT unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}'']+')) AS word FROM documents), n AS (SELECT word, count(*) AS n FROM w GROUP BY word) SELECT word, round(log10(n * 1e9 / sum(n) OVER ()), 2) AS zipf FROM n")
def zipf_table(spark, sf_dir):
    return curate.zipf_table(_t(spark, sf_dir, "documents"))


ZIPF_SQL = "zipf AS (SELECT word, 1.0 + ((length(word) * 7 + ascii(word)) % 13) * 0.35 AS zipf FROM (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part))"


def _recipe() -> C.Recipe:
    return C.Recipe("parts", "Names of parts", [C.Source("wikipedia-category", "Parts", "terms", 1), C.Source("datamuse-rel-trg", "nation", "hints")], exclude=["france"])


def _zipf(spark, sf_dir):
    words = _t(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    return words.select("word", (1.0 + ((F.char_length("word") * 7 + F.ascii("word")) % 13) * 0.35).alias("zipf"))


def _classified(spark, sf_dir):
    kept, _ = curate.merge_candidates(curate.clean_titles(_items(spark, sf_dir)))
    return curate.classify(curate.with_zipf(kept, _zipf(spark, sf_dir)), _recipe())


CLASSIFIED = f"""{KEYED}, {ZIPF_SQL}, k AS (SELECT key, bool_or(source_idx = 0) AS aims FROM keyed WHERE reason = '' GROUP BY key),
    zz AS (SELECT key, aims, len(string_split(key, ' ')) > 1 AS phrase, (SELECT round(min(coalesce(z.zipf, 1.0)), 2) FROM (SELECT unnest(string_split(k.key, ' ')) AS word) w LEFT JOIN zipf z USING (word)) AS z FROM k),
    classified AS (SELECT *, CASE WHEN key = 'france' THEN 'drop' WHEN aims AND phrase AND z >= 4.5 THEN 'drop' WHEN aims AND phrase AND z >= 3.5 THEN 'hint' WHEN aims AND phrase THEN 'term' WHEN NOT phrase AND z >= 4.5 THEN 'drop'
    WHEN aims AND z < 3.0 THEN 'term' ELSE 'hint' END AS decision, (aims AND phrase AND z >= 3.5 AND z < 4.5) OR (aims AND NOT phrase AND z >= 3.0 AND z < 4.0) AS reviewed FROM zz)"""


@query(f"WITH {CLASSIFIED} SELECT key, z::DOUBLE AS zipf, decision, reviewed FROM classified")
def classify_candidates(spark, sf_dir):
    return _classified(spark, sf_dir).select("key", "zipf", "decision", (F.size("review") > 0).alias("reviewed"))


@query(f"WITH {CLASSIFIED}, f AS (SELECT *, length(key) % 7 AS files FROM classified) SELECT key, CASE WHEN decision = 'term' AND files > 3 THEN 'hint' ELSE decision END AS decision, CASE WHEN decision = 'term' AND files > 3 THEN 'in ' || files || ' corpus files' END AS note FROM f")
def corpus_flag(spark, sf_dir):
    c = _classified(spark, sf_dir).withColumn("files", (F.char_length("key") % 7).cast("long"))
    return curate.flag_corpus_hits(c, _recipe().thresholds).select("key", "decision", F.try_element_at(F.filter("review", lambda r: r.startswith("in ")), F.lit(1)).alias("note"))


@query("""WITH c AS (SELECT doc_id, 'hint' AS decision, doc_id % 3 > 0 AS reviewed, CASE WHEN quality = 1 THEN 0.9 WHEN toxic = 1 THEN 0.2 ELSE 0.5 END AS p FROM documents LEFT JOIN labels USING (doc_id))
    SELECT c.doc_id, CASE WHEN reviewed AND l.doc_id IS NOT NULL AND p >= 0.7 THEN 'term' ELSE 'hint' END AS decision, reviewed AND (l.doc_id IS NULL OR (p > 0.3 AND p < 0.7)) AS unsettled FROM c LEFT JOIN labels l USING (doc_id)""")
def judge_resolve(spark, sf_dir):
    t = C.Thresholds()
    c = _t(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("text"), F.lit("hint").alias("decision"), F.when(F.col("doc_id") % 3 > 0, F.array(F.lit("why"))).otherwise(F.expr("cast(array() as array<string>)")).alias("review"))
    p = F.when(F.col("quality") == 1, 0.9).when(F.col("toxic") == 1, 0.2).otherwise(0.5)
    done = curate.judge(c, _t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("text"), p.alias("p")), t)
    return done.select("doc_id", "decision", curate.is_open(t).alias("unsettled"))


@query(f"""WITH {CLASSIFIED}, f AS (SELECT source_idx, count(*)::BIGINT AS found FROM raw GROUP BY 1), kk AS (SELECT DISTINCT k.source_idx, k.key FROM keyed k JOIN classified c ON k.key = c.key WHERE k.reason = '' AND c.decision <> 'drop')
    SELECT f.source_idx, found, count(kk.key)::BIGINT AS kept FROM f LEFT JOIN kk ON kk.source_idx = f.source_idx GROUP BY ALL""")
def source_counts(spark, sf_dir):
    return curate.source_counts(_items(spark, sf_dir), _classified(spark, sf_dir))


@query(f"WITH {CLASSIFIED} SELECT count(*) FILTER (decision = 'term')::BIGINT AS terms, count(*) FILTER (decision = 'hint')::BIGINT AS hints, count(*) FILTER (decision = 'drop')::BIGINT AS drops, count(*) FILTER (reviewed)::BIGINT AS reviewed, count(*) FILTER (reviewed AND length(key) % 3 <> 0)::BIGINT AS unsettled, count(*) FILTER (length(key) % 7 > 0)::BIGINT AS seen FROM classified")
def bucket_counts(spark, sf_dir):
    size = F.char_length("key")
    # A third is settled by the judge, a third is asked and stays open, a third was never asked.
    c = _classified(spark, sf_dir).withColumn("judge", F.when(size % 3 == 0, 0.9).when(size % 3 == 1, 0.5)).withColumn("files", size % 7)
    return curate.bucket_counts(c, _recipe().thresholds)


@query(f"WITH {FORMS}, {TOKENS} SELECT w.folded AS key, coalesce(h.hits, 0)::BIGINT AS hits, coalesce(h.docs, 0)::BIGINT AS files FROM (SELECT DISTINCT folded FROM forms UNION VALUES ('nowhere')) w LEFT JOIN (SELECT folded, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM tokens JOIN forms USING (token) GROUP BY folded) h USING (folded)")
def dry_run_counts(spark, sf_dir):
    c = spark.createDataFrame([(w, "term") for w in [*WORDS, "nowhere"]], "key string, decision string").withColumn("review", F.expr("cast(array() as array<string>)"))
    return curate.dry_run(c, _t(spark, sf_dir, "documents")).select("key", "hits", "files")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) WHERE k % greatest(1, ceil(n / 128.0)::BIGINT) = 0")
def even_sample(spark, sf_dir):
    return curate.even_sample(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id", 128)


EDGES = """edges AS (SELECT 'world' AS parent, 14 AS ns, r_name AS title FROM region UNION ALL SELECT r_name, 14, n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 0, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name, 14, 'world' FROM nation)"""


@query(f"WITH RECURSIVE {EDGES}, walk(title, level) AS (SELECT 'world', 0 UNION SELECT e.title, w.level + 1 FROM walk w JOIN edges e ON e.parent = w.title WHERE e.ns = 14 AND w.level < 3) SELECT e.title, min(w.level)::INT AS level FROM walk w JOIN edges e ON e.parent = w.title WHERE e.ns = 0 GROUP BY e.title")
def category_bfs(spark, sf_dir):
    r, n, s = (_t(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    edge = lambda p, ns, t: [p.alias("parent"), F.lit(ns).alias("ns"), t.alias("title")]
    top = r.select(*edge(F.lit("world"), 14, F.col("r_name")))
    mid = n.join(r, n.n_regionkey == r.r_regionkey).select(*edge(F.col("r_name"), 14, F.col("n_name")))
    low = s.join(n, s.s_nationkey == n.n_nationkey).select(*edge(F.col("n_name"), 0, F.col("s_name")))
    return curate.category_members(top.unionByName(mid).unionByName(low).unionByName(n.select(*edge(F.col("n_name"), 14, F.lit("world")))), "world", 3)


@query("SELECT p_name AS title FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_name LIMIT 20")
def search_categories(spark, sf_dir):
    return curate.search_categories(_t(spark, sf_dir, "part").select(F.col("p_name").alias("title")), "A")


@query("SELECT CAST(l_partkey AS VARCHAR) AS word FROM (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_suppkey = 1 GROUP BY 1) ORDER BY q DESC, word LIMIT 100")
def associations(spark, sf_dir):
    pairs = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("seed"), F.col("l_partkey").cast("string").alias("word")).agg(F.sum("l_quantity").alias("score"))
    return curate.associations(pairs, "1")


@query("SELECT substr(sha256(url), 1, 40) AS key, url FROM pages WHERE page_id % 3 > 0 AND substr(sha256(url), 1, 40) NOT IN (SELECT substr(sha256(url), 1, 40) FROM pages WHERE page_id % 3 = 0)")
def cache_misses(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").withColumn("key", S.cache_key(F.col("url")))
    return p.where("page_id % 3 > 0").select("key", "url").join(p.where("page_id % 3 = 0").select("key"), "key", "left_anti")


@query("WITH d AS (SELECT 'why ' || doc_id % 3 AS reason, 'key' || doc_id AS key FROM documents) SELECT key, reason FROM d ORDER BY reason, key LIMIT 200")
def first_drops(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.concat(F.lit("key"), F.col("doc_id").cast("string")).alias("key"), F.concat(F.lit("why "), (F.col("doc_id") % 3).cast("string")).alias("reason"))
    return curate.first_drops(d)


@query("SELECT count(*)::BIGINT AS files, sum(strlen(text))::BIGINT AS bytes FROM documents")
def run_metrics(spark, sf_dir):
    return curate.run_metrics(_t(spark, sf_dir, "documents"))


@query("SELECT word, row_number() OVER () - 1 AS seq FROM (SELECT unnest(['maya', 'old kingdom', 'tikal']) AS word)")
def settings_words(spark, sf_dir):
    s = spark.createDataFrame([("maya, , old kingdom,maya,tikal ",)], "extra_words string")
    return C.settings_terms(s).select("word", F.col("seq").cast("long").alias("seq"))


