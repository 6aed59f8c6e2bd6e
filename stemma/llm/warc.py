"""WARC archives: writing, and reading back by verified record boundaries.

Spark's text writer makes the archives: a row is a record's header and block, and the line separator is the
blank lines that end a record. Records with equal payloads become revisits of one response.

Reading splits each archive at every place where the version line stands, also where it stands inside a
payload. Each such place is a candidate record whose Content-Length gives the offset of its successor. A
candidate is a record only if a chain of successors from the start of its file reaches it. Chains are
followed by pointer jumping: inside a block of consecutive candidates one pass finds where each leaves the
block, and over blocks the pointers double until no new block entry is reached.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.llm.common import stored, whole_text
from stemma.session import new_folder

# Fixed values of the WARC 1.0 format.
VERSION = "WARC/1.0\r\n"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

#: Payloads of fewer bytes are never revisits.
LEAST_SHARED = 1000
#: The tables have no crawl time.
DATE = "1970-01-01T00:00:00Z"
#: Bytes of an archive whose candidates are followed in one pass.
BLOCK_BYTES = 8 << 20


def _record_id(page_id: Column, url: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), url))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(
        F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">")
    )


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def record_plan(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Per page: page_id, url, payload, its digest and bytes, and response_id of a revisit (else null).

    A text equals another if SHA-256, SHA-1 and length agree. Groups are counted before the shuffle, so a payload
    that a third of all pages have is one row per task.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
        whole_text(F.col(html_col)).alias("payload"),
    ).withColumns({
        "digest": F.sha1("payload"), "wide": F.sha2("payload", 256),
        "bytes": F.octet_length("payload").cast("long"),
    })
    shared = (
        rows.where(F.col("bytes") >= LEAST_SHARED)
        .groupBy("wide", "digest", "bytes")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response_id"))
        .where("n > 1")
        .drop("n")
    )
    # Written, so that its size is known: few groups are broadcast by Spark, many meet the pages in a shuffle.
    shared = stored(shared, "warc-shared")
    return (
        rows.join(shared, ["wide", "digest", "bytes"], "left")
        .withColumn("response_id", F.when(~F.col("response_id").eqNullSafe(F.col("page_id")), F.col("response_id")))
        .drop("wide")
    )


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    compression: str = "gzip",
) -> None:
    """One WARC record per page below ``path``, a folder that all executors share.

    ``compression`` is gzip (a file is read by one task) or none (a file can be split).

    Null html is an empty payload. Of pages with equal payloads of ``LEAST_SHARED`` bytes or more, the one with
    the largest id is the response; rows tied on that id are all responses. A null id is never
    the largest unless all are null. Control characters and spaces in a url are percent-encoded.
    """
    plan = record_plan(pages, id_col, url_col, html_col)
    revisit = F.col("response_id").isNotNull()
    safe_url = F.regexp_replace(F.regexp_replace("url", r"[\x00-\x1F\x7F]", "%0A"), " ", "%20")
    head = F.concat(
        F.lit(VERSION),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"))),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", safe_url),
        _header("X-Page-ID", F.col("page_id")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _header("X-Refers-To-Page-ID", F.col("response_id")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.lit(len(HTTP_HEAD)) + F.when(revisit, 0).otherwise(F.col("bytes"))),
        F.lit("\r\n" + HTTP_HEAD),
    )
    records = plan.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("value"))
    records.write.option("lineSep", RECORD_END).option("compression", compression).text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Archives cut at every version line: where each part stands, its header lines and the bytes it claims.

    A plan that is read anew each time: (file, split, line) name the same part while the files stay as they are.
    """
    lines = spark.read.option("lineSep", VERSION).text(path).select(
        F.col("value").alias("body"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
        F.octet_length("value").cast("long").alias("size"),
    )
    head = F.when(F.instr("body", RECORD_END) > 0, F.substring_index("body", RECORD_END, 1))
    number = F.regexp_extract(F.concat(F.lit("\r\n"), "head"), r"(?i)\r\nContent-Length:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|$)", 1)
    return (
        lines.withColumn("head", head)
        .withColumn("content", F.when(number != "", number.cast("long")))
        .withColumn("reach", F.octet_length("head") + 2 * len(RECORD_END) + F.col("content"))
    )


def _with_payload(lines: DataFrame) -> DataFrame:
    """``lines`` (head, content, body) with the payload: what comes after the HTTP header of the block."""
    block = F.expr("substring(cast(body as binary), cast(octet_length(head) + 5 as int), cast(content as int))")
    http = F.substring_index(F.col("block").cast("string"), RECORD_END, 1)
    return (
        lines.withColumn("block", block)
        .withColumn("http", http)
        .withColumn("payload", F.expr("substring(block, cast(octet_length(http) + 5 as int))"))
        .drop("block", "http", "body")
    )


def _digests(rows: DataFrame) -> DataFrame:
    """``rows`` with payload_bytes and payload_digest in place of the payload."""
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", F.sha1("payload")
    ).drop("payload")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Candidate records of all archives as a stored table without their texts.

    file, split, line, size, offset of the version line, next (offset of the successor), head, and the
    payload's size and digest as far as the segment holds it. The text before the first version line of a file (none in a
    sound archive) is left out.
    """
    lines = stored(_digests(_with_payload(_lines(spark, path))), "warc-lines")
    step = F.lit(len(VERSION)).cast("long")
    in_split = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    of_file = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("file", "split").agg(F.sum(F.col("size") + step).alias("length")).select(
        "file", "split", F.coalesce(F.sum("length").over(of_file), F.lit(0)).alias("split_start")
    )
    placed = (
        lines.withColumn("in_split", F.coalesce(F.sum(F.col("size") + step).over(in_split), F.lit(0)))
        .join(starts, ["file", "split"])
        # The version line stands before the body, so it starts that much earlier.
        .withColumn("offset", F.col("split_start") + F.col("in_split") - step)
        .where("offset >= 0")
        .withColumn("next", F.col("offset") + step + F.col("reach"))
        .select("file", "split", "line", "size", "offset", "next", "head", "payload_bytes", "payload_digest")
    )
    return stored(placed, "warc-segments")


def _block_exits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each candidate of a partition sorted by file, block and offset: where its chain leaves the block."""
    held, name = [], None

    def solve(rows: list[pd.DataFrame]) -> pd.DataFrame:
        block = pd.concat(rows, ignore_index=True)
        offsets, nexts = block["offset"].tolist(), block["next"].tolist()
        at = {o: i for i, o in enumerate(offsets)}
        exits = nexts[:]
        for i in range(len(offsets) - 1, -1, -1):
            inside = at.get(nexts[i])
            if inside is not None:
                exits[i] = exits[inside]
        block["exit"] = exits
        return block

    for frame in frames:
        for key, part in frame.groupby(["file", "block"], sort=False):
            if held and key != name:
                yield solve(held)
                held = []
            name = key
            held.append(part)
    if held:
        yield solve(held)


def _in_block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates that the chains from a block's entries pass through."""
    held, name = [], None

    def follow(rows: list[pd.DataFrame]) -> pd.DataFrame:
        block = pd.concat(rows, ignore_index=True)
        live = block["entry"].tolist()
        at = {o: i for i, o in enumerate(block["offset"].tolist())}
        for i, target in enumerate(block["next"].tolist()):
            if live[i] and target in at:
                live[at[target]] = True
        return block.loc[live, ["file", "offset", "next"]]

    for frame in frames:
        for key, part in frame.groupby(["file", "block"], sort=False):
            if held and key != name:
                yield follow(held)
                held = []
            name = key
            held.append(part)
    if held:
        yield follow(held)


def reachable(candidates: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Candidates (file, offset, next) that a chain from offset 0 of their file reaches.

    A successor lies after its candidate and need not be a candidate itself; then the chain ends. A null
    successor (no Content-Length) ends it too. Rounds are the logarithm of a file's blocks.
    """
    blocks = candidates.select(
        "file", "offset", F.coalesce("next", F.lit(-1)).alias("next"),
        F.floor(F.col("offset") / block_bytes).cast("long").alias("block"),
    )
    by_block = blocks.repartition("file", "block").sortWithinPartitions("file", "block", "offset")
    exits = stored(
        by_block.mapInPandas(_block_exits, "file string, offset long, next long, block long, exit long"), "warc-exits"
    )
    # Pointers between places where a chain can enter a block; these double each round.
    entered = exits.select("file", F.col("exit").alias("offset")).distinct()
    begins = exits.where("offset = 0").select("file", "offset")
    jumps = stored(
        exits.join(entered.unionByName(begins).distinct(), ["file", "offset"], "left_semi")
        .select("file", "offset", F.col("exit").alias("to")),
        "warc-jumps",
    )
    entries = stored(exits.where("offset = 0").select("file", "offset"), "warc-entries")
    known = entries.count()
    while known:
        further = entries.join(jumps, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        found = entries.unionByName(further).distinct()
        entries = stored(found.join(exits, ["file", "offset"], "left_semi"), "warc-entries")
        now = entries.count()
        if now == known:
            break
        known = now
        second = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("after"))
        jumps = stored(
            jumps.join(second, ["file", "to"]).select("file", "offset", F.col("after").alias("to")), "warc-jumps"
        )
    marked = (
        exits.drop("exit")
        .join(entries.withColumn("entry", F.lit(True)), ["file", "offset"], "left")
        .withColumn("entry", F.coalesce("entry", F.lit(False)))
        .repartition("file", "block")
        .sortWithinPartitions("file", "block", "offset")
    )
    return marked.mapInPandas(_in_block, "file string, offset long, next long")


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Per record: file, offset, head (its header lines), and the payload (binary, after the HTTP header).

    Without ``payloads`` its payload_bytes and payload_digest instead: then the texts of records are
    digested where they are read and not moved. A version line inside a payload is part of it: the segments from a
    record to its successor are joined. A last record that its file does not hold completely is left out.
    """
    cut = segments(spark, path)
    records = reachable(cut.select("file", "offset", "next")).select("file", "offset", F.col("offset").alias("record"))
    until = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    after = F.col("offset") + len(VERSION) + F.col("size")
    real = F.col("record").isNotNull()
    owned = stored(
        cut.join(records, ["file", "offset"], "left")
        .withColumn("whole", real & (F.col("next") == after))
        .withColumn("owner", F.last("record", True).over(until))
        .withColumn("end", F.when(real, F.col("next")))
        .drop("record", "next"),
        "warc-owned",
    )
    # Only records with a version line in their payload: their segments meet, at most one record's bytes.
    split = owned.where("end is not null and not whole").select("file", "owner", F.col("end").alias("record_end"))
    parts = stored(owned.join(split, ["file", "owner"]).select("file", "split", "line", "offset", "owner", "record_end", "size"), "warc-parts")
    bodies = _lines(spark, path).drop("size", "reach")
    joined = (
        bodies.join(parts, ["file", "split", "line"])
        .groupBy("file", "owner", "record_end")
        .agg(
            F.sort_array(F.collect_list(F.struct("offset", "body"))).alias("parts"),
            F.min_by("head", "offset").alias("head"), F.min_by("content", "offset").alias("content"),
            F.max(after).alias("held"),
        )
        .where("held >= record_end")
        .select(
            "file", F.col("owner").alias("offset"), "head", "content",
            F.array_join(F.transform("parts", lambda p: p["body"]), VERSION).alias("body"),
        )
    )
    joined = _with_payload(joined).drop("content")
    plain = owned.where("whole").select("file", "split", "line", "offset", "head", "payload_bytes", "payload_digest")
    if not payloads:
        return plain.drop("split", "line").unionByName(_digests(joined))
    found = bodies.join(plain.select("file", "split", "line", "offset"), ["file", "split", "line"])
    return _with_payload(found).select("file", "offset", "head", "payload").unionByName(joined)


def header(name: str) -> Column:
    """A header field of a record read back, null if it has none."""
    found = F.regexp_extract(F.concat(F.lit("\r\n"), F.col("head")), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def page_records(records: DataFrame) -> DataFrame:
    """Per record read back without payloads: page_id, payload_bytes, payload_digest, record_type and refers_to.

    A revisit has the figures of the response that it refers to, found by page id and digest.
    """
    read = records.select(
        header("X-Page-ID").try_cast("long").alias("page_id"), header("WARC-Type").alias("record_type"),
        header("X-Refers-To-Page-ID").try_cast("long").alias("refers_to"),
        F.substring_index(header("WARC-Payload-Digest"), ":", -1).alias("told"),
        "payload_bytes", "payload_digest",
    )
    read = stored(read, "warc-read")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = read.where("record_type = 'response'")
    # One row per response on the right, so revisits of a hot page split as a skewed left side.
    known = responses.select(
        F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("told"), "payload_bytes", "payload_digest"
    ).distinct()
    revisits = read.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    return responses.select(columns).unionByName(revisits.join(known, ["refers_to", "told"], "left").select(columns))
