"""WARC archives: writing pages as records, and reading archives back by boundary-chain verification.

Writing uses Spark's text writer with the end of a record as the line separator, so files are committed like
any table. Reading splits files at every `WARC/1.0` line, wherever a task's split begins, and takes each piece as a
candidate record: its offset, and by its header the offset of its successor. Pointer jumping from the start of
the file keeps the candidates that a chain of records reaches; a magic line inside a payload is none of them,
and its piece is put back into the record it belongs to.

Candidates are a few numbers each; a file's are looked at together, so a file's number of pieces bounds a task.
Payloads stay where they are read, except those that hold a magic line.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.llm.common import scratch_dir, stored

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Records of a file, at most.
RECORDS_PER_FILE = 20_000
#: Payloads from this size on are written once; equal ones revisit it.
LEAST_REVISIT = 1000
#: So many repeated payloads (about 20 MB of digests and ids) are broadcast; more are joined by a shuffle.
BROADCAST_KEEPERS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_archive(pages: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes a record for each row: a response with the payload in UTF-8 (null: empty), or a revisit of another row.

    Of rows with equal payloads of at least LEAST_REVISIT bytes, the one with the largest id is the response.
    Rows with a null id revisit it too; where all ids are null, all are responses. White space in a URL becomes
    a blank, as a header is one line; a null URL is empty. Record ids are <urn:page:ID>.
    """
    rows = pages.select(pages[id_col].cast("long").alias("id"), F.regexp_replace(F.coalesce(pages[url_col].cast("string"), F.lit("")), r"\s+", " ").alias("url"), F.coalesce(pages[payload_col].cast("string"), F.lit("")).alias("body"))
    n = F.octet_length("body")
    key = F.when(n >= LEAST_REVISIT, F.sha2(F.col("body").cast("binary"), 256))
    keepers = rows.select(key.alias("k"), "id").where("k is not null").groupBy("k").agg(F.max("id").alias("keeper"), F.count("*").alias("c")).where("c > 1 and keeper is not null").select("k", "keeper")
    # Only repeated payloads have a keeper. While these are few, the payloads need not be shuffled to find theirs.
    keepers = stored(keepers, "keepers")
    keepers = F.broadcast(keepers) if keepers.limit(BROADCAST_KEEPERS + 1).count() <= BROADCAST_KEEPERS else keepers
    # Payloads without a key spread over all tasks where the join is a shuffle.
    rows = rows.withColumn("key", F.coalesce(key, F.concat(F.lit("-"), F.xxhash64("id", "url", "body").cast("string"))))
    rows = rows.join(keepers, F.col("key") == F.col("k"), "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit(END))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("body")))
    header = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), urn(F.col("id")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.sha1(F.col("body").cast("binary")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), urn(F.col("keeper")), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    rows.select(F.concat(header, block).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magic lines: file, start of the split, running number, and the piece as value. A file's first piece is what stands before its first magic line."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("number"), "value")


def _field(header, name: str):  # noqa: ANN001, ANN202
    return F.regexp_extract(header, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)


def _body(record):  # noqa: ANN001, ANN202
    """The payload of a record's block: what follows the HTTP header. record: (header, block) in binary."""
    return F.expr(f"substring({record}, instr(decode({record}, 'ISO-8859-1'), '\\r\\n\\r\\n') + 4)")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the files under path: file, offset, type, record_id, refers_to (null if none), uri, claimed (the digest in its header), payload_bytes, payload_digest (hex SHA-1 of the payload it carries).

    Files without a record at their start give no rows. An archive without files gives an empty table.
    """
    piece = _pieces(spark, path).withColumn("raw", F.col("value").cast("binary")).withColumn("header", F.substring_index("value", END, 1))
    head = F.octet_length("header")
    length = _field(F.col("header"), "Content-Length").try_cast("long")
    whole = F.octet_length("raw") == head + len(END) + length + len(END)
    block = F.substring(F.col("raw"), head + len(END) + 1, length.cast("int"))
    parsed = piece.select("file", "split", "number", F.octet_length("raw").cast("long").alias("bytes"), head.cast("long").alias("head"), length.alias("length"), F.coalesce(whole, F.lit(False)).alias("whole"), *_named(F.col("header")), F.when(whole, block).alias("block"))
    parsed = parsed.withColumn("body", _body("block")).select(*(c for c in parsed.columns if c != "block"), F.octet_length("body").cast("long").alias("payload_bytes"), F.sha1("body").alias("payload_digest"))
    parsed = stored(parsed, "pieces")
    chain = parsed.groupBy("file").applyInArrow(_reached, f"{parsed.select('file', *NAMES, 'whole', 'length', 'payload_bytes', 'payload_digest').schema.simpleString()[7:-1]},offset:long,piece:long,pieces:long")
    chain = stored(chain, "chain")
    broken = chain.where("pieces > 1 or not whole")
    plain = chain.where("pieces = 1 and whole")
    columns = ["file", "offset", *NAMES, "payload_bytes", "payload_digest"]
    if broken.isEmpty():
        return plain.select(columns)
    # Records whose payload holds magic lines: their pieces are put together again, by their place in the file.
    files = broken.select("file").distinct()
    # Pieces are numbered without their values, and only those of broken records are read again.
    numbered = parsed.select("file", "split", "number").join(files, "file", "left_semi").withColumn("at", (F.row_number().over(Window.partitionBy("file").orderBy("split", "number")) - 1).cast("long"))
    spans = broken.withColumn("at", F.explode(F.sequence(F.col("piece"), F.col("piece") + F.col("pieces") - 1))).join(numbered, ["file", "at"])
    values = _pieces(spark, path).select("file", "split", "number", F.col("value").cast("binary").alias("raw"))
    parts = spans.join(values, ["file", "split", "number"])
    joined = parts.groupBy("file", "offset", *NAMES, "length").agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("parts"))
    text = joined.withColumn("raw", F.aggregate(F.slice("parts", 2, 1 << 30), F.col("parts")[0]["raw"], lambda s, x: F.concat(s, F.lit(MAGIC).cast("binary"), x["raw"])))
    text = text.withColumn("start", F.expr("instr(decode(raw, 'ISO-8859-1'), '\\r\\n\\r\\n') + 4")).withColumn("block", F.expr("substring(raw, start, cast(length as int))")).withColumn("body", _body("block"))
    mended = text.select("file", "offset", *NAMES, F.octet_length("body").cast("long").alias("payload_bytes"), F.sha1("body").alias("payload_digest"))
    return plain.select(columns).unionByName(mended)


NAMES = ["type", "record_id", "refers_to", "uri", "claimed"]


def _named(header) -> list:  # noqa: ANN001
    field = lambda name: F.nullif(_field(header, name), F.lit(""))
    return [field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Refers-To").alias("refers_to"), field("WARC-Target-URI").alias("uri"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("claimed")]


def _reached(table: pa.Table) -> pa.Table:
    """Of one file's candidates, those on the chain from its start, with offset, number of the first piece and number of pieces."""
    table = table.sort_by([("split", "ascending"), ("number", "ascending")])
    sizes, head, length = (table.column(c).fill_null(-1).to_numpy() for c in ("bytes", "head", "length"))
    ends = np.cumsum(sizes + len(MAGIC))
    offsets = ends - sizes - 2 * len(MAGIC)  # of the magic line before each piece; the first piece has none
    total = ends[-1] - len(MAGIC)
    following = offsets + len(MAGIC) + head + len(END) + length + len(END)
    good = length >= 0
    good[0] = False
    n = len(sizes)
    # Successors as places in the list; n is the end of the file, n + 1 no record.
    place = np.searchsorted(offsets, following)
    there = np.append(offsets, total)[np.minimum(place, n)] == following
    jump = np.append(np.where(good & there, np.minimum(place, n), n + 1), [n, n + 1])
    reached = np.zeros(n + 2, bool)
    if n > 1 and offsets[1] == 0:
        reached[1] = True
    steps = 1
    while steps < n:
        reached[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
        steps *= 2
    found = np.flatnonzero(reached[:n] & good)
    counts = np.diff(np.append(found, n)) if len(found) else np.zeros(0, np.int64)
    if len(found):  # pieces after the last record's own end belong to no record
        last = found[-1]
        counts[-1] = max(1, int(np.searchsorted(offsets, min(following[last], total))) - last)
    out = table.take(pa.array(found)).select(["file", *NAMES, "whole", "length", "payload_bytes", "payload_digest"])
    for name, values in (("offset", offsets[found]), ("piece", found), ("pieces", counts)):
        out = out.append_column(name, pa.array(values.astype(np.int64)))
    return out


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes pages to an archive in the shared folder and reads it back: id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit carries no payload; its size and digest are those of the response it refers to, found by the id
    and the digest that it claims: rows that share an id may have different payloads. Repeated rows come out as often
    as they go in; null ids and payloads are as write_archive() says, and no rows give none.
    """
    spark = pages.sparkSession
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, id_col=id_col, url_col=url_col, payload_col=payload_col)
    records = stored(read_archive(spark, path), "records")
    responses = records.where("type = 'response'")
    target = [F.col("refers_to").alias("target"), F.col("claimed").alias("digest")]
    used = records.where("refers_to is not null").select(*target).distinct()
    full = responses.select(F.col("record_id").alias("target"), F.col("payload_digest").alias("digest"), "payload_bytes", "payload_digest").join(used, ["target", "digest"], "left_semi").distinct()
    revisits = records.where("type = 'revisit'").select("record_id", "type", "refers_to", *target).join(full, ["target", "digest"])
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1).try_cast("long")
    shape = lambda df: df.select(number("record_id").alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))
    return shape(responses).unionByName(shape(revisits))
