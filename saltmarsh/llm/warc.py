"""Web archives with a two-level capture index.

Writing: pages are put in order of their reversed-host URL key, and each task writes its
range as WARC files, one gzip member per record, a new file after ``file_bytes``. Of equal
payloads one page is the response, the others are revisit records that refer to it. That
is decided on digests alone; the decisions then travel with the pages through the one
exchange that orders them, each right in front of its page, so payloads move once and no
payload group meets in a task.

Indexing: capture lines, ``<url key> <record id> <json>``, are sorted by range; each task
writes its range, a shard, as gzip blocks of ``block_lines`` lines and, in a file beside it,
the shard's directory: first key, offset and length of each block. A shard holds about
``shard_lines`` lines and there are at most ``max_shards``, whose first keys are all that
the driver sees.

Reading: a lookup finds its shard, then its block by binary search in the shard's directory,
reads that block by one range read, finds the line by binary search in it, and reads the
record by another range read. Lookups are sorted, so a block is read once in a task. A scan
deals the blocks of the directory to tasks, which read runs of neighbouring records together.
Revisits are resolved by looking up each distinct response once.

Files get a name of their own in each attempt of a task and are listed by the rows that the
task returns; what a lost attempt leaves behind is never read.

Defined cases: null url has an empty key and no target header; characters that no URI may
hold are percent-encoded; null html is an empty payload; null page ids come last, and such a
response gives revisits no ``refers_to``. Of rows with equal payload and page id, the first
by URL (null last) is the response, and one of wholly equal rows. An empty table gives an empty archive;
further columns are not read. Page ids are integers.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as files
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import hand_back, hand_over, setup
from saltmarsh.session import durable, scratch_path

DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# At most so many bytes are read at once, unless one record is longer.
READ_BYTES = 4 << 20

CAPTURE_TYPE = "key string, page_id long, record_type string, digest string, file string, offset long, length long"
RECORD_TYPE = (
    "key string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
    "refers_url string, refers_id string, payload binary"
)
FOUND_TYPE = "wanted string, " + RECORD_TYPE


@dataclass(frozen=True)
class Settings:
    min_revisit_bytes: int = 0
    file_bytes: int = 256 << 20
    part_bytes: int = 64 << 20
    block_lines: int = 1000
    shard_lines: int = 1_000_000
    max_shards: int = 10_000
    lookups: int = 10_000


@dataclass(frozen=True)
class Index:
    """``directory`` has a row for each block; ``shards`` are (first key, index file, directory file) in order."""

    directory: DataFrame
    shards: tuple[tuple[str, str, str], ...]
    settings: Settings


def opened(path: str) -> tuple[files.FileSystem, str]:
    """File system and path of a location in the shared folder."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[5:]
    return files.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def uri(url: Column) -> Column:
    """``url`` as a header can hold it."""
    bad = r"[\x00-\x20\x7F]"
    escaped = F.array_join(F.transform(
        F.split(url, ""), lambda c: F.when(c.rlike(bad), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c)
    ), "")
    return F.when(url.rlike(bad), escaped).otherwise(url)


def url_key(target: Column) -> Column:
    """Sort key of a URI: host labels from the last to the first, port, then the rest."""
    site = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(:[0-9]*)?"
    host = F.lower(F.regexp_extract(target, site, 1))
    turned = F.when(host.rlike(r"^([0-9.]+|\[.*)$"), host).otherwise(F.array_join(F.reverse(F.split(host, r"\.")), ","))
    key = F.concat(turned, F.regexp_extract(target, site, 2), F.lit(")"), F.regexp_replace(target, site, ""))
    return F.coalesce(F.when(target.rlike(site), key).otherwise(target), F.lit(""))


def record_id(page_id: str | None, target: str | None, digest: str, copy: int) -> str:
    name = f"{page_id or ''}\n{target or ''}\n{digest}\n{copy}"
    return str(uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16], version=4))


def framed(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)


def member(headers: dict[str, str], body: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    head = f"WARC/1.1\r\n{head}Content-Length: {len(body)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(body) + packer.compress(b"\r\n\r\n") + packer.flush()


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a record that is one gzip member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0]!r}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[:int(headers["Content-Length"])]


class Writer:
    """Writes records to files below a folder, each with its own name."""

    def __init__(self, root: str, suffix: str, limit: int | None = None):
        self.fs, self.root = opened(root)
        self.suffix, self.limit = suffix, limit
        self.stream = None
        self.fs.create_dir(self.root, recursive=True)

    def add(self, data: bytes, first: bytes = b"") -> tuple[str, int, int]:
        """File, offset and length of ``data``; ``first`` begins a new file."""
        if self.stream is None or (self.limit and self.at >= self.limit):
            self.close()
            self.name = f"{uuid.uuid4().hex}{self.suffix}"
            self.stream = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self.stream.write(first)
            self.at = len(first)
        self.stream.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


class Ranges:
    """Range reads below a folder; the file read last stays open."""

    def __init__(self, root: str):
        self.fs, self.root = opened(root)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.root}/{name}")
        data = self.file.read_at(length, offset)
        if len(data) != length:
            raise ValueError(f"{name} ends before byte {offset + length}")
        return data


def decide(rows: DataFrame, settings: Settings) -> DataFrame:
    """For each distinct (page_id, uri, digest): how many rows, and the page that equal payloads refer to."""
    distinct = rows.groupBy("page_id", "uri", "digest", "n_bytes").agg(F.count("*").alias("copies"))
    best = F.min(F.struct(F.col("page_id").isNull().alias("a"), "page_id", F.col("uri").isNull().alias("b"), "uri")).alias("best")
    found = hand_back(distinct, ["digest"], [best], ["page_id", "uri"])
    own = F.col("best.page_id").eqNullSafe(F.col("page_id")) & F.col("best.uri").eqNullSafe(F.col("uri"))
    small = F.col("n_bytes") < settings.min_revisit_bytes
    return found.select(
        url_key(F.col("uri")).alias("key"), "page_id", "uri", "digest", F.lit(0).alias("kind"),
        # How many of the rows are responses: one for the first page of a payload, all of small ones.
        F.when(small, F.col("copies")).when(own, 1).otherwise(0).alias("responses"),
        F.col("best.page_id").alias("first_page"), F.col("best.uri").alias("first_uri"), F.lit(None).cast("binary").alias("payload"),
    )


def write(pages: DataFrame, root: str, settings: Settings = Settings()) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``root``; one row per record written."""
    setup(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), uri(F.col("url")).alias("uri"), payload.alias("payload")
    ).select("page_id", "uri", F.sha1("payload").alias("digest"), "payload")
    sizes = durable(own.select("page_id", "uri", "digest", F.length("payload").cast("long").alias("n_bytes")))
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    decisions = decide(sizes, settings)
    order = ["key", "page_id", "uri", "digest"]
    # Ids go to Python as text: a column of numbers and nulls would become one of doubles.
    empty = {"responses": "int", "first_page": "string", "first_uri": "string"}
    stream = own.select(
        url_key(F.col("uri")).alias("key"), "page_id", "uri", "digest", F.lit(1).alias("kind"),
        *(F.lit(None).cast(kind).alias(name) for name, kind in empty.items()), "payload",
    ).unionByName(decisions.select(
        *order, "kind", *(F.col(name).cast(kind).alias(name) for name, kind in empty.items()), "payload"
    ))
    parts = max(1, -(-total // settings.part_bytes), min(pages.sparkSession.sparkContext.defaultParallelism, total >> 20))
    ordered = (
        stream.repartitionByRange(int(parts), *order).sortWithinPartitions(*order, "kind")
        .withColumn("page_id", F.col("page_id").cast("string"))
    )

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = Writer(root, ".warc.gz", settings.file_bytes)
        responses = turn = 0
        first_page = first_uri = None
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                if row.kind == 0:
                    responses, turn, first_page, first_uri = row.responses, 0, row.first_page, row.first_uri
                    continue
                name = record_id(row.page_id, row.uri, row.digest, turn)
                digest = base64.b32encode(bytes.fromhex(row.digest)).decode()
                record_type = "response" if turn < responses else "revisit"
                turn += 1
                headers = {"WARC-Type": record_type, "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Date": DATE}
                if row.uri is not None:
                    headers["WARC-Target-URI"] = row.uri
                if row.page_id is not None:
                    headers["Page-ID"] = row.page_id
                headers["WARC-Payload-Digest"] = f"sha1:{digest}"
                headers["Content-Type"] = "application/http; msgtype=response"
                body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                if record_type == "response":
                    body += row.payload
                else:
                    headers["WARC-Profile"] = REVISIT_PROFILE
                    headers["WARC-Refers-To"] = f"<urn:uuid:{record_id(first_page, first_uri, row.digest, 0)}>"
                    headers["WARC-Refers-To-Date"] = DATE
                    if first_uri is not None:
                        headers["WARC-Refers-To-Target-URI"] = first_uri
                info = member({
                    "WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE,
                    "Content-Type": "application/warc-fields",
                }, b"format: WARC File Format 1.1\r\n") if out.stream is None or out.at >= settings.file_bytes else b""
                page = None if row.page_id is None else int(row.page_id)
                rows.append((f"{row.key} {name}", page, record_type, digest, *out.add(member(headers, body), info)))
            yield framed(rows, CAPTURE_TYPE)
        out.close()

    return durable(ordered.mapInPandas(work, CAPTURE_TYPE))


def build(captures: DataFrame, root: str, settings: Settings = Settings()) -> Index:
    """Index the records of ``captures`` in shards below ``root``, the folder of the archives."""
    lines = captures.count()
    shards = max(1, min(settings.max_shards, -(-lines // settings.shard_lines)))
    line = F.concat_ws(" ", "key", F.to_json(F.struct("page_id", "record_type", "digest", "file", "offset", "length")))
    ordered = captures.select("key", line.alias("line"), "length").repartitionByRange(shards, "key").sortWithinPartitions("key")
    schema = "shard string, directory string, first_key string, offset long, length long, archive_bytes long"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held, blocks, size, first = Writer(root, ".cdx.gz"), [], [], 0, None

        def close() -> None:
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = packer.compress(("\n".join(held) + "\n").encode()) + packer.flush()
            blocks.append((first, *out.add(data)[1:], size))

        for batch in batches:
            for key, text, length in zip(batch["key"], batch["line"], batch["length"]):
                if len(held) == settings.block_lines:
                    close()
                    held, size = [], 0
                if not held:
                    first = key
                held.append(text)
                size += int(length)
        if not held:
            return
        close()
        out.close()
        listing = Writer(root, ".dir")
        listing.add("".join(f"{key}\t{offset}\t{length}\n" for key, offset, length, _ in blocks).encode())
        listing.close()
        yield framed([(out.name, listing.name, *block) for block in blocks], schema)

    directory = durable(ordered.mapInPandas(work, schema))
    tops = directory.groupBy("shard", "directory").agg(F.min("first_key").alias("first")).orderBy("first").collect()
    return Index(directory, tuple((r["first"], r["shard"], r["directory"]) for r in tops), settings)


def lines_of(data: bytes) -> list[str]:
    return zlib.decompress(data, 31).decode().split("\n")[:-1]


class Search:
    """Looks up lines by key: shard, directory, block, line."""

    def __init__(self, root: str, shards: tuple[tuple[str, str, str], ...]):
        self.ranges, self.shards = Ranges(root), shards
        self.tops = [first for first, _, _ in shards]
        self.shard, self.block = -1, -1

    def _open(self, shard: int, block: int) -> None:
        if shard != self.shard:
            self.shard, self.block = shard, -1
            with self.ranges.fs.open_input_file(f"{self.ranges.root}/{self.shards[shard][2]}") as listing:
                rows = [line.split("\t") for line in listing.read().decode().split("\n")[:-1]]
            self.firsts = [r[0] for r in rows]
            self.places = [(int(r[1]), int(r[2])) for r in rows]
        if block != self.block:
            self.block = block
            self.lines = lines_of(self.ranges.read(self.shards[shard][1], *self.places[block]))

    def find(self, key: str) -> Iterator[tuple[str, dict]]:
        """Key and entry of every line whose key is ``key`` or starts with it and a blank."""
        wanted = key + " "
        shard = max(bisect_right(self.tops, wanted) - 1, 0)
        if not self.shards:
            return
        if shard != self.shard:
            self._open(shard, 0)
        block = max(bisect_right(self.firsts, wanted) - 1, 0)
        while True:
            self._open(shard, block)
            lines = self.lines
            at = bisect_left(lines, wanted)
            while at < len(lines) and lines[at].startswith(wanted):
                target, name, entry = lines[at].split(" ", 2)
                yield f"{target} {name}", json.loads(entry)
                at += 1
            if at < len(lines):
                return
            block += 1
            if block == len(self.places):
                shard, block = shard + 1, 0
                if shard == len(self.shards):
                    return


def record_row(key: str, entry: dict, data: bytes, payload: bool) -> tuple:
    """A row of RECORD_TYPE from the bytes of a record; its payload must have the digest it states."""
    headers, body = parsed(data)
    stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    content = body.partition(b"\r\n\r\n")[2]
    response = headers["WARC-Type"] == "response"
    if headers["WARC-Record-ID"] != f"<urn:uuid:{key.rsplit(' ', 1)[1]}>" or stated != entry["digest"]:
        raise ValueError(f"index and archive differ at {key}")
    if response and base64.b32encode(hashlib.sha1(content).digest()).decode() != stated:
        raise ValueError(f"payload of {key} has another digest")
    page = headers.get("Page-ID")
    return (
        key, None if page is None else int(page), headers.get("WARC-Target-URI"), headers["WARC-Type"],
        len(content) if response else None, stated, headers.get("WARC-Refers-To-Target-URI"),
        headers["WARC-Refers-To"][10:-1] if not response else None, content if payload and response else None,
    )


def scan(index: Index, root: str, payload: bool = False) -> DataFrame:
    """Every record, read block by block of the index; with its payload if asked for."""
    total = index.directory.agg(F.sum("archive_bytes"), F.count("*")).first()
    spark = index.directory.sparkSession
    parts = max(1, min(total[1], max(spark.sparkContext.defaultParallelism, -(-(total[0] or 0) // index.settings.part_bytes))))
    blocks = index.directory.select("shard", "offset", "length").repartitionByRange(int(parts), "shard", "offset")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listing, archive = Ranges(root), Ranges(root)
        for batch in batches:
            for shard, offset, length in zip(batch["shard"], batch["offset"], batch["length"]):
                entries = []
                for line in lines_of(listing.read(shard, int(offset), int(length))):
                    target, name, entry = line.split(" ", 2)
                    entries.append((f"{target} {name}", json.loads(entry)))
                entries.sort(key=lambda e: (e[1]["file"], e[1]["offset"]))
                at = 0
                while at < len(entries):
                    # Neighbouring records are read together.
                    first, stop = entries[at][1], at
                    end = first["offset"]
                    while (
                        stop < len(entries) and entries[stop][1]["file"] == first["file"] and entries[stop][1]["offset"] == end
                        and (stop == at or end + entries[stop][1]["length"] - first["offset"] <= READ_BYTES)
                    ):
                        end += entries[stop][1]["length"]
                        stop += 1
                    data = archive.read(first["file"], first["offset"], end - first["offset"])
                    rows, begin = [], 0
                    for key, entry in entries[at:stop]:
                        rows.append(record_row(key, entry, data[begin:begin + entry["length"]], payload))
                        begin += entry["length"]
                    yield framed(rows, RECORD_TYPE)
                    at = stop

    return blocks.mapInPandas(work, RECORD_TYPE)


def lookup(index: Index, root: str, keys: DataFrame, payload: bool = False) -> DataFrame:
    """The records of each ``wanted`` key, distinct ones: a URL key (all its captures) or a URL key and record id."""
    wanted = durable(keys.select("wanted").distinct())
    parts = max(1, -(-wanted.count() // index.settings.lookups))
    ordered = wanted.repartitionByRange(parts, "wanted").sortWithinPartitions("wanted")
    shards = index.shards

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search, archive = Search(root, shards), Ranges(root)
        for batch in batches:
            rows, held = [], 0
            for key in batch["wanted"]:
                for found, entry in search.find(key):
                    data = archive.read(entry["file"], entry["offset"], entry["length"])
                    rows.append((key, *record_row(found, entry, data, payload)))
                    held += len(data) if payload else 100
                    if held > READ_BYTES:
                        yield framed(rows, FOUND_TYPE)
                        rows, held = [], 0
            yield framed(rows, FOUND_TYPE)

    return ordered.mapInPandas(work, FOUND_TYPE)


def resolved(index: Index, root: str) -> DataFrame:
    """Every record with the size of its full payload, and the page that a revisit refers to."""
    records = durable(scan(index, root).drop("payload"))
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes").withColumn(
        "wanted", F.concat_ws(" ", url_key(F.col("refers_url")), "refers_id")
    )
    responses = durable(lookup(index, root, revisits).select(
        F.col("wanted").alias("found"), F.col("page_id").alias("refers_to"), "payload_bytes", F.col("payload_digest").alias("stated")
    ))
    joined = hand_over(revisits, responses, "wanted", "found")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    agreed = F.when(F.col("stated") == F.col("payload_digest"), F.col("refers_to")).otherwise(
        F.raise_error(F.concat(F.lit("revisit of another payload: "), "wanted"))
    )
    return (
        records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*columns)
        .unionByName(joined.withColumn("refers_to", agreed).select(*columns))
    )


def archive(pages: DataFrame, root: str | None = None, settings: Settings = Settings()) -> tuple[Index, str]:
    """Write and index ``pages``; the index and the folder it lies in (a fresh one in the shared folder by default)."""
    root = root or scratch_path(pages.sparkSession, "warc")
    return build(write(pages, root, settings), root, settings), root
