"""WARC archives: writing pages as records, and reading archives back by boundary-chain verification.

The reader finds every place where a record may begin, works out where it would end, and keeps only the records that the chain from
the file's start reaches, so that the magic inside a payload is never taken for a record. Archives are scanned once: the stretches
between magics are kept, compressed, with the file, split and running number that this scan gave them, so a second plan that splits the
files otherwise changes nothing. Defined results: a null html is an empty payload; a null page_id is kept as null and never
preferred; rows that repeat both page_id and payload of a response are the same capture and all responses; a null url becomes an
empty target; a long payload is one record, whatever splits it crosses; an empty table gives an empty archive and no rows; further
columns, of whatever names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, scratch_path

#: Fixed values of the format.
MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of an archive file, at most; payloads from this many bytes on are deduplicated; digests that may be broadcast.
FILE_RECORDS, MIN_BYTES, BROADCAST_DIGESTS, BROADCAST_ODD = 1024, 0, 500_000, 100_000
DATE = "2000-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hex digits are 8 groups of 20 bits, each four letters."""
    digest = F.sha1(payload)
    letters = []
    for g in range(8):
        bits = F.conv(F.substring(digest, 1 + 5 * g, 5), 16, 10).cast("long")
        letters += [F.substring(F.lit(BASE32), (F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _header(c: Column) -> Column:
    """A value that cannot end its header line."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x20\x7f]+", "%20")


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = MIN_BYTES, records: int = FILE_RECORDS, date: str = DATE, compression: str = "gzip") -> None:
    """One record a row, in files of WARC below path (compressed ones are read whole, others may be split); payloads equal to
    another's become revisits of the largest page_id."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html")).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    again = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null").select("digest", "first_id")
    again = materialize(again, "digests")
    small = again.count() <= BROADCAST_DIGESTS
    rows = rows.join(F.broadcast(again) if small else again, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.octet_length("html") >= min_bytes)
    payload = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    identity = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", identity(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _header(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", identity(F.col("first_id"))), line("X-Payload-Length", F.octet_length("html").cast("string")))).otherwise(F.lit("")),
        line("Content-Length", F.octet_length(payload).cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(head, payload).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records).option("compression", compression).text(path)
    discard(again)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value): the stretches between magics, in file order; splits are read apart.

    A split's rows come in order; the running number within the partition orders them, the split's start orders the splits.
    These numbers hold for one execution of the scan only, so what it read is written out with them.
    """
    text = spark.read.option("lineSep", MAGIC).text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    return materialize(rows, "stretches", codec="zstd")


def candidates(pieces: DataFrame) -> DataFrame:
    """(file, block, line, size, offset, next): every stretch, the offset of the magic before it, and where its record would end.

    The place of a stretch is the length of all before it in its file: those of earlier splits by one running sum over the
    splits, those of the same split by another. next is null where no header with a length stands.
    """
    head = F.when(F.instr("value", END) > 0, F.substring_index("value", END, 1))
    length = F.regexp_extract(head, r"(?:^|\r\n)[Cc]ontent-[Ll]ength: ([0-9]{1,18})(?:\r\n|$)", 1)
    rows = pieces.withColumn("head", head).withColumn("len", length)
    rows = (rows.select("file", "block", "line", (F.octet_length("value") + len(MAGIC)).cast("long").alias("size"), F.octet_length("head").alias("head_bytes"), F.expr("try_cast(nullif(len, '') as long)").alias("content")))
    upto = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("file", "block").agg(F.sum("size").alias("size"))
    before = per.select("file", "block", F.coalesce(F.sum("size").over(upto("file", "block")), F.lit(0)).alias("base"))
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(upto("file", "block", "line")), F.lit(0))).join(before, ["file", "block"])
    offset = F.col("base") + F.col("inside") - len(MAGIC)
    return rows.withColumn("offset", offset).select("file", "block", "line", "size", "offset", (F.col("offset") + len(MAGIC) + F.col("head_bytes") + F.col("content") + 2 * len(END)).alias("next"))


def reachable(found: DataFrame) -> DataFrame:
    """found with `real`: whether the chain from its file's start visits the candidate, by pointer jumping.

    Stretches of candidates each of which is its forerunner's successor are one run, with one way out, wherever it is
    entered. Over the runs, round k knows where 2**k steps lead and which runs are within 2**k - 1 steps of the start, and
    where these are entered: a chain of n runs takes log2(n) rounds, each a join on (file, run).
    """
    line = Window.partitionBy("file").orderBy("offset")
    real = found.where("next is not null").select("file", "offset", "next")
    real = real.withColumn("turn", F.coalesce((F.lag("next").over(line) != F.col("offset")).cast("int"), F.lit(1)))
    real = materialize(real.withColumn("run", F.sum("turn").over(line)).select("file", "run", "offset", "next"), "runs")
    runs = real.groupBy("file", "run").agg(F.max_by("next", "offset").alias("exit"))
    aim = real.select("file", F.col("run").alias("to"), F.col("offset").alias("exit"))
    jump = materialize(runs.join(aim, ["file", "exit"]).select("file", "run", "to", F.col("exit").alias("entry")), "jump")
    mark = materialize(real.where("offset = 0").select("file", "run", F.col("offset").alias("entry")), "reached")
    longest = runs.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(longest).bit_length() if longest > 1 else 0):
        there = jump.join(mark.select("file", "run"), ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
        ahead = materialize(mark.unionByName(there).distinct(), "reached")
        b = jump.select("file", F.col("run").alias("to"), F.col("to").alias("further"), F.col("entry").alias("there"))
        twice = materialize(jump.join(b, ["file", "to"]).select("file", "run", F.col("further").alias("to"), F.col("there").alias("entry")), "jump")
        for old in (mark, jump):
            discard(old)
        mark, jump = ahead, twice
    kept = real.join(mark, ["file", "run"]).where("offset >= entry").select("file", "offset", F.lit(True).alias("real"))
    return found.join(kept, ["file", "offset"], "left").withColumn("real", F.coalesce("real", F.lit(False)))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(warc_type, record_id, target_uri, digest, refers_to, full_length, content, payload) of every record below path.

    Only the exceptions travel: stretches that are no record, and records of several stretches because their payload
    holds the magic. All other stretches are records as they were read.
    """
    pieces = _pieces(spark, path)
    found = reachable(candidates(pieces))
    line = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    home = F.last(F.when(F.col("real"), F.struct("offset", "next")), ignorenulls=True).over(line)
    odd = found.withColumn("home", home).where(~F.col("real") | (F.col("next") > F.col("offset") + F.col("size")))
    odd = materialize(odd.select("file", "block", "line", "offset", F.when(F.col("offset") < F.col("home.next"), F.col("home.offset")).alias("home")), "odd")
    side = F.broadcast(odd) if odd.count() <= BROADCAST_ODD else odd
    where = ["file", "block", "line"]
    whole = pieces.join(side.select(*where), where, "left_anti").select("value")
    parts = pieces.join(side.where("home is not null"), where).groupBy("file", "home").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"))
    joined = parts.select(F.array_join(F.transform("parts", lambda x: x["value"]), MAGIC).alias("value"))
    rows = whole.unionByName(joined).withColumn("head", F.substring_index("value", END, 1))
    field = lambda name: F.expr(f"nullif(regexp_extract(head, '(?:^|\\\\r\\\\n){name}: ([^\\\\r\\\\n]*)', 1), '')")
    rows = rows.withColumn("content", field("Content-Length").cast("long"))
    payload = F.expr(f"cast(substring(cast(value as binary), octet_length(head) + {len(END) + 1}, cast(content as int)) as string)")
    return rows.select(field("WARC-Type").alias("warc_type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("target_uri"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"), field("WARC-Refers-To").alias("refers_to"), field("X-Payload-Length").cast("long").alias("full_length"), "content", payload.alias("payload"))


def archive_round_trip(pages: DataFrame, *, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the archives, read them back: (page_id, url, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes=min_bytes)
    page = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1), '') as long)")
    r = read_archives(spark, path)
    digest = F.when(F.col("warc_type") == "revisit", F.col("digest")).otherwise(base32_sha1(F.col("payload").cast("binary")))
    return r.select(page("record_id").alias("page_id"), F.col("target_uri").alias("url"), F.coalesce("full_length", F.octet_length("payload").cast("long")).alias("payload_bytes"), digest.alias("payload_digest"), F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"))
