"""WARC archives: written from pages, and read back by verified chains of records.

Writing.  Pages with equal payloads of at least ``LEAST`` bytes share one response record, that of the
smallest id; the others are revisit records that refer to it.  A record is a row of Spark's text sink, whose line
separator is the two line ends between records, so tasks write files of their own under its commit protocol.

Reading.  Archives are split like any text, at a line end and ``WARC/1.``, where a record may begin;
payloads may hold the same bytes.  Each task tells where the candidates of its split lie and how long their
headers say that they are, and so the offset of their successors.  Where each candidate's chain leaves its
split (its *exit*) is found split by split; exits are pointers between splits, and pointer jumping over them
from the start of each file, doubling the distance each round, finds the candidate at which the file's own
chain enters each split.  Following it from there within the split keeps the records that are reachable and
rejects what only looks like one.  Payloads that lie between two candidates are digested as they are read;
those that hold candidates are put together from their chunks in a second pass over the text.

Defined results: a null or empty payload is a response of 0 bytes; null ids come after all others, so one
is a response only if no equal payload has an id; rows of one id and payload are alike; blanks and line ends
in an address are percent-encoded; a null address has no header; an empty table makes an archive without
records, which reads as an empty table; a file that does not begin with a record has none; a record that is
cut short is read as far as it goes and is not ``intact``; further columns of the pages are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_rows, cut, drop, few_or_joined, shared_folder, small_batches

END, MAGIC = b"\r\n\r\n", b"WARC/1."
#: What stands before the magic in the separator that texts are read by.  It is one character, as Hadoop's reader
#: loses separators that begin with a part of themselves at the edges of splits.
EDGE = b"\n"
LEAST = 100
#: Rows of a table that may be broadcast, of about 100 bytes each.
FEW = 200_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = ("warc-type", "warc-record-id", "warc-target-uri", "warc-refers-to", "warc-payload-digest", "warc-date", "content-type")
NAMES = tuple(h.removeprefix("warc-").replace("-", "_") for h in HEADERS)
FIELDS = ", ".join(f"{n} string" for n in NAMES) + ", payload_bytes long, payload_sha256 string, got long"
CHUNK = f"file string, begin long, local long, extent long, head long, content long, {FIELDS}"
RECORD = f"file string, pos long, content long, {FIELDS}"


# ------------------------------------------------------------ writing
def line(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts], F.lit("\r\n"))


def name_of(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def address(url: Column) -> Column:
    for mark, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        url = F.replace(url, F.lit(mark), F.lit(code))
    return url


def copied_payloads(pages: DataFrame) -> DataFrame:
    """Digests of payloads that several pages have, with the smallest id; one row a digest."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    sized = pages.where(F.octet_length(payload) >= LEAST).select("page_id", F.sha2(payload, 256).alias("digest"))
    return sized.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")


def record_texts(pages: DataFrame, copied: DataFrame, date: str = DATE) -> DataFrame:
    """A record for each page."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"own_digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
    rows = rows.join(copied, F.col("own_digest") == F.col("digest"), "left")
    again = F.col("digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(line("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"), line("Content-Length: ", F.col("size")), F.lit("\r\n"))
    header = F.concat(
        line("WARC/1.1"),
        line("WARC-Type: ", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID: ", name_of(F.col("page_id"))),
        line(f"WARC-Date: {date}"),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI: ", address(F.col("url")))).otherwise(""),
        line("WARC-Payload-Digest: sha256:", F.col("own_digest")),
        F.when(again, F.concat(line("WARC-Refers-To: ", name_of(F.col("first"))), line(f"WARC-Profile: {PROFILE}"))).otherwise(""),
        line("Content-Type: application/http;msgtype=response"),
        line("Content-Length: ", F.octet_length(http) + F.when(again, 0).otherwise(F.col("size"))),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(header, http, F.when(again, "").otherwise(F.col("payload"))).alias("value"))


def write_archives(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write ``pages`` (page_id, url, html) as uncompressed archives, a file a task."""
    copied = cut(copied_payloads(pages))
    record_texts(pages, few_or_joined(copied, FEW), date).write.option("lineSep", END.decode()).text(path)
    drop(copied)


# ------------------------------------------------------------ reading
@contextmanager
def same_splits(spark: SparkSession):
    """All reads in this block split files alike, also if executors come or go between them."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    if before is None:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """The texts between places where a record may begin, in the order of each split."""
    text = small_batches(spark.read.option("lineSep", (EDGE + MAGIC).decode()).text(path))
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value")


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """File, split, and for each place its offset, counted from the split's first one, and the bytes from there on."""
    at, local, starts = None, 0, False
    for batch in batches:
        for file, begin, value in zip(batch.column("file").to_pylist(), batch.column("begin").to_pylist(), byte_rows(batch.column("value"))):
            if (file, begin) != at:
                at, local, starts = (file, begin), 0, begin == 0
            data = value if starts else MAGIC + value  # a file's first text follows no separator
            starts = False
            yield file, begin, local, data
            local += len(data) + len(EDGE)


def parsed_header(data: bytes) -> tuple[int, int, dict[str, str]] | None:
    """The bytes of a record's header and of its block, and the header's fields; nothing if this is no header."""
    if not re.match(rb"WARC/1\.[01]\r\n", data):
        return None
    end = data.find(END)
    if end < 0 and data.endswith(END[:-1]):  # the last of its line ends is in the separator that follows
        end = len(data) - len(END) + 1
    if end < 0:
        return None
    fields: dict[str, str] = {}
    for row in data[:end].split(b"\r\n")[1:]:
        name, colon, value = row.partition(b":")
        if colon:
            fields.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
    size = fields.get("content-length", "")
    return (end + len(END), int(size), fields) if re.fullmatch("[0-9]{1,18}", size) else None


def described(block: bytes, fields: dict[str, str]) -> tuple:
    """The fields of a record, and bytes and digest of its payload: what follows the HTTP header, if there is one.
    A revisit has no payload and declares both."""
    http: dict[bytes, bytes] = {}
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(END)
        http = {k.strip().lower(): v.strip() for k, _, v in (row.partition(b":") for row in top.split(b"\r\n")[1:])}
    if fields.get("warc-type") == "revisit":
        declared = http.get(b"content-length", b"")
        of = (int(declared) if declared.isdigit() else 0, fields.get("warc-payload-digest", "").removeprefix("sha256:"))
    else:
        of = (len(payload), hashlib.sha256(payload).hexdigest())
    return (*map(fields.get, HEADERS), *of, len(block))


def table_of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in ddl.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if kind == "string" else pa.int64()) for c, kind in zip(zip(*rows), kinds)], list(names))


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each place; described if all of the record is there."""
    nothing = (None,) * (len(HEADERS) + 3)
    rows: list[tuple] = []
    for file, begin, local, data in placed(batches):
        head, size, fields = parsed_header(data) or (-1, -1, {})
        whole = head >= 0 and len(data) - head - size in (len(END) - len(EDGE), len(END))  # a file's last one has all of its end
        rows.append((file, begin, local, len(data), head, size, *(described(data[head : head + size], fields) if whole else nothing)))
        if len(rows) >= 4096:
            yield table_of(rows, CHUNK)
            rows = []
    if rows:
        yield table_of(rows, CHUNK)


def exits(part: pa.Table) -> pa.Table:
    """Of each candidate of a split: where its chain leaves the split, and the chain's last candidate in it."""
    part = part.sort_by("pos")
    pos, after = part["pos"].to_pylist(), part["successor"].to_pylist()
    row_of = {p: i for i, p in enumerate(pos)}
    out, last = list(after), list(pos)
    for i in reversed(range(len(pos))):
        if (j := row_of.get(after[i])) is not None:
            out[i], last[i] = out[j], last[j]
    return part.select(["file", "begin", "pos"]).append_column("exit", pa.array(out, pa.int64())).append_column("tail", pa.array(last, pa.int64()))


def entries(links: DataFrame, rounds: int) -> DataFrame:
    """The candidates (file, begin, pos, tail) where each file's chain enters its splits: pointer jumping from its start
    over ``links`` (file, begin, pos, exit, tail).

    Only candidates at exits can be entered, so what is jumped over has a few rows for each split.
    """
    at_exits = links.select("file", F.col("exit").alias("pos")).union(links.where("pos = 0").select("file", "pos")).distinct()
    doors = cut(links.join(at_exits, ["file", "pos"]).select("file", "begin", "pos", "exit", "tail"))
    made, reached, jump = [doors], doors.where("pos = 0").select("file", "pos"), doors.select("file", "pos", "exit")
    for _ in range(rounds):
        ahead = reached.join(jump, ["file", "pos"]).select("file", F.col("exit").alias("pos"))
        twice = jump.select("file", F.col("pos").alias("origin"), F.col("exit").alias("pos")).join(jump, ["file", "pos"])
        reached, jump = cut(reached.union(ahead).distinct()), cut(twice.select("file", F.col("origin").alias("pos"), "exit"))
        made += [reached, jump]
    found = cut(doors.join(reached, ["file", "pos"], "left_semi").select("file", "begin", "pos", "tail"))
    drop(*made)
    return found


def owned(part: pa.Table) -> pa.Table:
    """Each place of a split with the record that it belongs to, by following the chain from where it enters."""
    part = part.sort_by("pos")
    expected, owner = part["entry"][0].as_py(), part["incoming"][0].as_py()
    out = []
    for p, after in zip(part["pos"].to_pylist(), part["successor"].to_pylist()):
        if p == expected:
            owner, expected = p, after
        out.append(owner)
    return part.append_column("owner", pa.array(out, pa.int64()))


def put_together(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records (file, owner) whose places ``wanted`` lists (file, begin, local, pos, owner), from a second read."""

    def texts(batches):
        for file, begin, local, data in placed(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([begin], pa.int64()), pa.array([local], pa.int64()), pa.array([data], pa.binary())], ["file", "begin", "local", "data"])

    def joined(part: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        data = EDGE.join(part["data"].to_pylist())
        head, size, fields = parsed_header(data)
        return pa.Table.from_batches([table_of([(part["file"][0].as_py(), part["owner"][0].as_py(), size, *described(data[head : head + size], fields))], RECORD)])

    again = chunks(spark, path).mapInArrow(texts, "file string, begin long, local long, data binary")
    return again.join(few_or_joined(wanted, FEW), ["file", "begin", "local"]).select("file", "owner", "pos", "data").groupBy("file", "owner").applyInArrow(joined, RECORD)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``: file, offset, headers, bytes and digest of the payload, and
    whether the record is whole and as it was when its digest was written.  The result is a written table."""
    with same_splits(spark):
        seen = cut(chunks(spark, path).mapInArrow(candidates, CHUNK))
        by_file = Window.partitionBy("file")  # a row for each split
        sizes = seen.groupBy("file", "begin").agg(F.sum(F.col("extent") + len(EDGE)).alias("size"))
        splits = cut(sizes.select("file", "begin", (F.sum("size").over(by_file.orderBy("begin")) - F.col("size")).alias("base"), F.count("*").over(by_file).alias("n")))
        rounds = max(0, (splits.agg(F.max("n").alias("n")).first().n or 0) - 1).bit_length()
        known = seen.join(splits.drop("n"), ["file", "begin"]).withColumn("pos", F.col("base") + F.col("local"))
        known = known.withColumn("successor", F.when(F.col("head") >= 0, F.col("pos") + F.col("head") + F.col("content") + len(END)))
        narrow = known.where("head >= 0").select("file", "begin", "pos", "successor")
        links = cut(narrow.groupBy("file", "begin").applyInArrow(exits, "file string, begin long, pos long, exit long, tail long"))
        entered = entries(links, rounds)
        earlier = by_file.orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
        ways = splits.join(entered, ["file", "begin"], "left").select("file", "begin", F.col("pos").alias("entry"), F.last("tail", ignorenulls=True).over(earlier).alias("incoming"))
        marked = known.join(cut(ways), ["file", "begin"])
        marked = cut(marked.groupBy("file", "begin").applyInArrow(owned, ", ".join(f"{n} {t}" for n, t in marked.dtypes) + ", owner long"))
        records = marked.where("pos = owner")
        found = records.where("got is not null").select("file", "pos", "content", *NAMES, "payload_bytes", "payload_sha256", "got")
        parted = records.where("got is null").select("file", "owner")
        wanted = cut(marked.join(parted, ["file", "owner"], "left_semi").select("file", "begin", "local", "pos", "owner"))
        if not wanted.isEmpty():
            found = found.unionByName(put_together(spark, path, wanted))
        intact = (F.col("got") == F.col("content")) & F.coalesce(F.col("payload_digest") == F.concat(F.lit("sha256:"), F.col("payload_sha256")), F.lit(True))
        out = cut(found.select("file", F.col("pos").alias("offset"), *NAMES, "payload_bytes", "payload_sha256", intact.alias("intact")))
    drop(seen, splits, links, entered, marked, wanted)
    return out


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and tell of each page what its record says."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write_archives(pages, path)
    records = read_archives(spark, path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    def id_in(name: str) -> Column:
        return F.nullif(F.regexp_extract(name, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast(pages.schema["page_id"].dataType)

    return records.select(id_in("record_id").alias("page_id"), "payload_bytes", F.col("payload_sha256").alias("payload_digest"), F.col("type").alias("record_type"), id_in("refers_to").alias("refers_to"), "target_uri", "intact")
