"""WARC archives written and read with Spark's text source, and verified as a chain of records.

Writing: a record is one string, and the text writer's line separator is the blank line pair that ends a WARC
record. Reading: the line separator is the magic ``WARC/1.0``, so the splits of an archive are searched for
candidate records in parallel, however large the file. A payload may hold the magic as well. Each candidate
therefore states where its successor would start (header + Content-Length + 4), and only
candidates reachable from offset 0 of their file by such jumps are records.

Reachability is pointer jumping, done on contracted chains: neighbours of a split that follow each other
directly form a run, which has one exit; runs, not records, take part in the rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesloom.operators.materialize import materialize

MAGIC = "WARC/1.0\r\n"
RECORD_END = "\r\n\r\n"
BROADCAST_DIGESTS = 200_000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: five hexadecimal digits at a time give four letters."""
    digest = F.sha1(payload)
    letters: list[Column] = []
    for group in range(8):
        bits = F.conv(digest.substr(group * 5 + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            five = F.shiftright(bits, shift).bitwiseAND(31)
            letters.append(F.substring(F.lit(_BASE32), five + 1, F.lit(1)))
    return F.concat(*letters)


def classified(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to for every row of ``pages``.

    Of rows with equal payloads of at least ``min_bytes`` that with the smallest page_id is the response and
    the others revisit it; a smaller payload is always a response. A null html is an empty payload. Null page_ids
    count as larger than any; of rows that repeat the smallest id each is a response. The
    digests that occur twice are broadcast if few; else both sides are shuffled and Spark may split a hot digest.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), base32_sha1(payload).alias("payload_digest"))
    narrow = rows.select("page_id", "payload_digest", F.octet_length("payload").alias("bytes"))
    first = (
        narrow.where(F.col("bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select("payload_digest", "first_id")
    )
    first = materialize(first)
    if first.count() <= BROADCAST_DIGESTS:
        first = F.broadcast(first)
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first, "payload_digest", "left").select(
        "page_id",
        "url",
        "payload",
        "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def write_archives(records: DataFrame, path: str) -> None:
    """Write the rows of `classified` as archives under ``path``, one file per partition.

    A revisit carries no payload. Its header keeps the full payload's digest and length and names the
    response. Line ends in a url are escaped, so a header cannot be broken.
    """
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    revisit = F.col("record_type") == "revisit"
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        number("page_id"),
        F.lit(">\r\nWARC-Target-URI: "),
        url,
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), number("refers_to"), F.lit(">"))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.lit("\r\nX-Payload-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit("\r\nContent-Length: "),
        F.when(revisit, F.lit("0")).otherwise(F.octet_length("payload").cast("string")),
        F.lit("\r\n\r\n"),
    )
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    # the cast keeps the bytes as they are, valid UTF-8 or not
    record = F.concat(header.cast("binary"), body).cast("string")
    records.select(record.alias("value")).write.option("lineSep", RECORD_END).text(path)


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r]*)", 1)
    return F.when(found != "", found)


def _length(header: Column) -> Column:
    """The stated length, null unless it is a whole number of at most 18 digits: headers may be foreign text."""
    stated = _field(header, "Content-Length")
    return F.when(stated.rlike(r"^[0-9]{1,18}$"), stated).try_cast("long")


def _int(length: Column) -> Column:
    return F.least(length, F.lit(2**31 - 1)).cast("int")


Figures = Callable[[Column], dict[str, Column]]
_FIELDS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "stated_digest": "WARC-Payload-Digest",
    "stated_length": "X-Payload-Length",
}


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magics, in the order of the file: ``nth`` rises inside a split."""
    return spark.read.schema("value string").option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("nth"),
        F.col("value").alias("piece"),
    )


def _parsed(pieces: DataFrame, figures: Figures) -> DataFrame:
    """Candidates without their bodies: sizes, header fields, and ``figures`` of the body if the piece holds it whole."""
    head = F.when(F.instr("piece", RECORD_END) > 0, F.substring_index("piece", RECORD_END, 1))
    with_head = pieces.withColumn("header", head)
    sized = with_head.select(
        "file",
        "split",
        "nth",
        (F.octet_length("piece") + len(MAGIC)).cast("long").alias("bytes"),
        F.octet_length("header").alias("head_bytes"),
        _length(F.col("header")).alias("content_length"),
        *[_field(F.col("header"), key).alias(name) for name, key in _FIELDS.items()],
        F.col("piece").cast("binary").alias("piece"),
    )
    needed = F.col("head_bytes") + len(RECORD_END) + F.col("content_length")
    whole = F.coalesce(F.col("bytes") - len(MAGIC) >= needed, F.lit(False))
    body = F.substring("piece", F.col("head_bytes") + len(RECORD_END) + 1, _int(F.col("content_length")))
    return sized.select(
        "file",
        "split",
        "nth",
        "bytes",
        "head_bytes",
        "content_length",
        *_FIELDS,
        whole.alias("whole"),
        *[F.when(whole, c).alias(name) for name, c in figures(body).items()],
    )


def _linked(parsed: DataFrame) -> DataFrame:
    """Adds at (offset of the magic; below 0 before a file's first), successor, and run: neighbours that follow
    each other directly."""
    in_order = Window.partitionBy("file", "split").orderBy("nth")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    splits = parsed.groupBy("file", "split").agg(F.sum("bytes").alias("split_bytes"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    starts = splits.select(
        "file", "split", F.coalesce(F.sum("split_bytes").over(earlier), F.lit(0)).alias("split_start")
    )
    inside = parsed.withColumn("inside", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    placed = inside.join(starts, ["file", "split"]).withColumn(
        "at", F.col("split_start") + F.col("inside") - len(MAGIC)
    )
    size = F.col("head_bytes") + F.col("content_length") + (len(MAGIC) + 2 * len(RECORD_END))
    linked = placed.drop("inside", "split_start").withColumn(
        "successor", F.when(F.col("at") >= 0, F.col("at") + size)
    )
    follows = F.coalesce(F.lag("successor").over(in_order) == F.col("at"), F.lit(False))
    broken = linked.withColumn("breaks", F.when(follows, 0).otherwise(1))
    return broken.withColumn("run", F.sum("breaks").over(in_order)).drop("breaks")


def _reachable(linked: DataFrame) -> DataFrame:
    """file, split, run, entry: the first reachable offset of each run that can be reached from offset 0."""
    runs = linked.groupBy("file", "split", "run").agg(F.max_by("successor", "at").alias("exit"))
    starts = linked.select("file").distinct().withColumn("entry", F.lit(0).cast("long"))
    exits = runs.where("exit IS NOT NULL").select("file", F.col("exit").alias("entry"))
    entries = starts.unionByName(exits).distinct()
    rows = linked.select("file", F.col("at").alias("entry"), "split", "run")
    # an exit that is no candidate's offset (the end of the file, or a false length) leads nowhere
    nodes = materialize(entries.join(rows, ["file", "entry"]).join(runs, ["file", "split", "run"]))
    jump = nodes.where("exit IS NOT NULL").select("file", "entry", "exit")
    reached = nodes.where("entry = 0").select("file", "entry")
    known = reached.count()
    while True:
        step = reached.join(jump, ["file", "entry"]).select("file", F.col("exit").alias("entry"))
        real = step.join(nodes.select("file", "entry"), ["file", "entry"], "left_semi")
        reached = materialize(reached.unionByName(real).distinct())
        now = reached.count()
        if now == known:
            break
        known = now
        ahead = jump.select("file", F.col("entry").alias("exit"), F.col("exit").alias("further"))
        jump = materialize(jump.join(ahead, ["file", "exit"]).select("file", "entry", F.col("further").alias("exit")))
    return nodes.join(reached, ["file", "entry"], "left_semi").groupBy("file", "split", "run").agg(
        F.min("entry").alias("entry")
    )


_TRIES = 4


def read_archives(spark: SparkSession, path: str, figures: Figures, tries: int = _TRIES) -> DataFrame:
    """The records of the archives under ``path`` that can be reached from the start of their file.

    Returns file, at, content_length, record_id, record_type, target_uri, refers_to, stated_digest, stated_length
    and ``figures``: columns made from the body (the body itself, a digest, ...), which are worked
    out during the scan. Only a body that holds the magic is put together from its pieces, in a shuffle by
    record. A record cut short by the end of its file has the bytes that are there; a header
    without a length ends its file's chain. A path without records gives no rows.
    """
    pieces = _pieces(spark, path)
    linked = materialize(_linked(_parsed(pieces, figures)))
    entry = _reachable(linked).withColumnRenamed("entry", "run_entry")
    known = materialize(
        linked.join(entry, ["file", "split", "run"], "left").withColumn(
            "real", F.coalesce(F.col("at") >= F.col("run_entry"), F.lit(False)) & F.col("successor").isNotNull()
        )
    )
    made = list(figures(F.lit(None).cast("binary")))
    shown = ["file", "at", "content_length", *_FIELDS]
    whole = known.where("real AND whole").select(*shown, *made)
    split = known.where("at >= 0 AND NOT (real AND whole)")
    if split.isEmpty():
        return whole
    # pieces that are no records belong to the last record before them that its own piece does not hold
    in_file = Window.partitionBy("file").orderBy("at")
    keys = split.withColumn("owner", F.last(F.when(F.col("real"), F.col("at")), ignorenulls=True).over(in_file))
    owned = keys.where("owner IS NOT NULL").select("file", "split", "nth", "at", "owner", "real", "head_bytes")
    owned = materialize(owned)
    parts = materialize(owned.join(pieces, ["file", "split", "nth"]))
    # this scan may have been split otherwise than the first one, after executors came or went
    sizes = parts.join(linked.select("file", "split", "nth", "bytes"), ["file", "split", "nth"])
    if sizes.where(F.octet_length("piece") + len(MAGIC) == F.col("bytes")).count() != owned.count():
        if tries <= 1:
            raise RuntimeError("the archives were split differently in each scan")
        return read_archives(spark, path, figures, tries - 1)
    joined = parts.groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("at", F.col("piece")))).alias("pieces"),
        F.max(F.when(F.col("real"), F.col("head_bytes"))).alias("skip"),
    )
    text = F.array_join(F.transform("pieces", lambda p: p["piece"]), MAGIC).cast("binary")
    bodies = joined.select("file", F.col("owner").alias("at"), "skip", text.alias("text"))
    headers = known.where("real AND NOT whole").select(*shown)
    whole_text = headers.join(bodies, ["file", "at"])
    body = F.substring("text", F.col("skip") + len(RECORD_END) + 1, _int(F.col("content_length")))
    rest = whole_text.select(*shown, body.alias("body")).select(
        *shown, *[c.alias(name) for name, c in figures(F.col("body")).items()]
    )
    return whole.unionByName(rest)
