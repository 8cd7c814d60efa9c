"""Repeated byte windows by a depth-limited radix sort.

Every window of ``window`` bytes is ordered by digits, the most significant first, and
leaves the sort as soon as it stands alone:

1. The window's anchor, its k-gram with the smallest hash. Neighbouring windows share
   anchors, so a text sends one short key for some sixteen windows. Anchors that only one
   document has end here.
2. The run of windows around an anchor, as a whole: equal runs are repeats.
3. The single windows of runs that share an anchor but differ; groups of equal windows
   are exactly the repeated strings.

Exact copies of a text are settled by its digest; distinct texts are written once, in
buckets, so that later passes join with them in place. Anchors that many documents have
are known from a bounded sample; they skip the first pass, their runs are combined before
they are shuffled and dealt by their content, and their windows go through a combined
aggregate. A group with more runs than ``group_runs`` takes the same way. So no task
holds a group of unbounded size, and the result does not depend on the way taken.

A byte is removed if a window that covers it also starts in a document with a smaller id.

Defined cases: null text counts as empty; null ids come after all others, and no row with
a null id is smaller than another; rows of one id are not smaller than each other, so
their common strings stay in both; texts shorter than a window lose nothing; an empty
table gives no rows; further columns are not read. Ids are integers.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.anchors import anchored, parts
from saltmarsh.llm.common import hand_over, setup
from saltmarsh.session import durable, scratch_path

LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    """``sample_texts`` and ``heavy`` (of these) find the anchors that many documents have."""

    window: int = 50
    gram: int = 20
    sample_texts: int = 5000
    heavy: int = 25
    group_runs: int = 2000
    bucket_bytes: int = 8 << 20
    flush: int = 1 << 20


def unpacked(batch: pd.DataFrame) -> list[bytes]:
    unzip = zstandard.ZstdDecompressor()
    return [unzip.decompress(t) for t in batch["packed"]]


def runs(texts: list[bytes], window: int, gram: int) -> Iterator[tuple]:
    """For parts of the texts: bytes, and of every run of windows with one anchor the text's number,
    its place in the text less that in the part, first and last start, anchor, and hash of the anchor."""
    for numbers, firsts, data in parts(texts, window):
        lengths = np.array([len(data)]) if len(numbers) == 1 else np.array([len(texts[i]) for i in numbers])
        starts, anchor, grams = anchored(data, lengths, window, gram)
        ends = np.cumsum(lengths)
        owner = np.searchsorted(ends, starts, side="right")
        new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])))
        last = starts[np.append(new[1:], len(starts)) - 1]
        own = owner[new]
        shift = np.array(firsts)[own] - (ends - lengths)[own]
        yield data, np.array(numbers)[own], shift, starts[new], last, anchor[new], grams[anchor[new]]


def distinct_texts(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, int]:
    """Rows (``doc_id``, ``id``, ``node``, ``n_bytes``, ``sha``, ``first``); distinct texts in buckets; bits of the bucket number."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    node = F.unhex(F.md5(text))
    rows = durable(docs.select(
        F.col("doc_id").alias("doc_id"), order.alias("id"), node.alias("node"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"),
    ))
    firsts = durable(rows.groupBy("node").agg(F.min("id").alias("first"), F.first("n_bytes").alias("n_bytes")))
    size = firsts.agg(F.sum("n_bytes")).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = partitions * max(1, -(-size // (settings.bucket_bytes * partitions)))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "node": batch["node"], "packed": [zip_.compress(t) for t in batch["text"]]})

    packed = (
        docs.where(F.octet_length("text") >= settings.window)
        .select(order.alias("id"), node.alias("node"), F.col("text").cast("binary").alias("text"))
        .mapInPandas(pack, "id long, node binary, packed binary")
    )
    sources = firsts.where(F.col("n_bytes") >= settings.window).select(F.col("first").alias("_id"), F.col("node").alias("_node"))
    # Only ids are join keys, so that the join deals rows as the buckets do.
    same = (F.col("id") == F.col("_id")) & (F.when(F.col("node") == F.col("_node"), 1).otherwise(0) == 1)
    name = f"distinct_texts_{uuid.uuid4().hex[:12]}"
    (
        packed.join(sources.hint("merge"), same).select("id", F.crc32("node").alias("tag"), "packed")
        .write.bucketBy(buckets, "id").sortBy("id").option("path", scratch_path(spark, "texts"))
        .option("compression", "none").saveAsTable(name)
    )
    bits = max(1, int(np.ceil(np.log2(max(2, size / settings.bucket_bytes)))))
    known = hand_over(rows, firsts.select(F.col("node").alias("_node"), "first"), "node", "_node")
    return known, spark.table(name), bits


def heavy_anchors(texts: DataFrame, settings: Settings) -> np.ndarray:
    """Anchors that at least ``heavy`` of about ``sample_texts`` texts have: a bounded number."""
    share = min(1.0, settings.sample_texts / max(1, texts.count()))
    sample = texts.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    window, gram = settings.window, settings.gram

    def list_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, number, _, _, _, _, key in runs(unpacked(batch), window, gram):
                once = np.unique(np.column_stack([number.astype(np.uint64), key]), axis=0)[:, 1]
                yield pd.DataFrame({"anchor": once.view(np.int64)})

    found = sample.select("packed").mapInPandas(list_, "anchor long").groupBy("anchor").count().where(F.col("count") >= settings.heavy)
    return np.sort(found.toPandas()["anchor"].to_numpy(dtype=np.int64)).view(np.uint64)


def shared_anchors(texts: DataFrame, heavy: np.ndarray, bits: int, settings: Settings) -> DataFrame:
    """First digit: ``id`` and ``keys`` (upper bits of the anchors that other documents have too)."""
    window, gram, flush = settings.window, settings.gram, settings.flush
    shared = texts.sparkSession.sparkContext.broadcast(heavy)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def deal() -> Iterator[pd.DataFrame]:
            key, own = np.concatenate(keys), np.concatenate(ids)
            keys.clear()
            ids.clear()
            bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
            low = (key >> np.uint64(32 - bits)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            bucket, low, own = bucket[order], low[order], own[order]
            cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            yield pd.DataFrame({
                "bucket": bucket[cut[:-1]],
                "lows": [low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)],
                "ids": [own[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)],
            })

        for batch in batches:
            own = batch["id"].to_numpy()
            for _, number, _, _, _, _, key in runs(unpacked(batch), window, gram):
                light = ~np.isin(key, shared.value)
                keys.append(key[light])
                ids.append(own[number[light]])
                if sum(map(len, keys)) >= flush:
                    yield from deal()
        if sum(map(len, keys)):
            yield from deal()

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[bytes, bytes]] = []
        last = None

        def settle() -> pd.DataFrame:
            low = np.frombuffer(b"".join(h[0] for h in held), dtype=np.uint32)
            own = np.frombuffer(b"".join(h[1] for h in held), dtype=np.int64)
            order = np.lexsort([own, low])
            low, own = low[order], own[order]
            first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
            count = np.diff(np.append(first, len(low)))
            several = np.repeat(own[first] != own[first + count - 1], count)
            return pd.DataFrame({"id": own[several], "key": (np.int64(last) << 32) | low[several].astype(np.int64)}).drop_duplicates()

        for batch in batches:
            for bucket, lows, ids in zip(batch["bucket"], batch["lows"], batch["ids"], strict=True):
                if held and bucket != last:
                    yield settle()
                    held.clear()
                held.append((lows, ids))
                last = bucket
        if held:
            yield settle()

    dealt = texts.select("id", "packed").mapInPandas(gather, "bucket long, lows binary, ids binary")
    met = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(meet, "id long, key long")
    return met.groupBy("id").agg(F.collect_list("key").alias("keys"))


def settled_runs(texts: DataFrame, keys: DataFrame, heavy: np.ndarray, bits: int, settings: Settings) -> DataFrame:
    """Second and third digit: ``kind`` 0: bytes ``start`` to ``end`` of a text go; 1: a window still to be met elsewhere."""
    window, gram, most = settings.window, settings.gram, settings.group_runs
    around = window - gram
    shared = texts.sparkSession.sparkContext.broadcast(heavy)
    layout = "anchor long, salt int, id long, tag long, place int, body binary"

    def list_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Runs of heavy anchors, combined over the task: the smallest holder of each.
        best: dict[tuple[int, bytes], tuple] = {}
        for batch in batches:
            found: list[tuple] = []
            own, tag = batch["id"].tolist(), batch["tag"].tolist()
            wanted = [np.sort(np.asarray(k, dtype=np.int64)) if k is not None else np.empty(0, np.int64) for k in batch["keys"]]
            for data, number, shift, first, last, anchor, key in runs(unpacked(batch), window, gram):
                hot = np.isin(key, shared.value)
                some = hot.copy()
                short = (key >> np.uint64(32 - bits)).astype(np.int64)
                cut = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(number))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    some[a:b] |= np.isin(short[a:b], wanted[number[a]])
                signed = key.view(np.int64)
                for r in np.flatnonzero(some):
                    s, e, p, n = int(first[r]), int(last[r]), int(anchor[r]), int(number[r])
                    body = bytes([p - s]) + data[s:p] + data[p + gram:e + window]
                    row = (int(signed[r]), 0, own[n], tag[n], p + int(shift[r]), body)
                    if not hot[r]:
                        found.append(row)
                        continue
                    at = (row[0], body)
                    have = best.get(at)
                    if have is None or have[2] == row[2] and have[3:5] == row[3:5]:
                        best[at] = row
                    else:
                        small, large = (have, row) if have[2] <= row[2] else (row, have)
                        best[at] = small
                        # One that the combined one beats is settled, and dealt by its id; of the same id both are met.
                        found.append((large[2], -1, large[2], large[3], large[4], large[5]) if small[2] < large[2] else heavy_row(large))
            if len(best) > 100_000:
                found += map(heavy_row, best.values())
                best.clear()
            if found:
                yield pd.DataFrame(found, columns=["anchor", "salt", "id", "tag", "place", "body"])
        if best:
            yield pd.DataFrame(list(map(heavy_row, best.values())), columns=["anchor", "salt", "id", "tag", "place", "body"])

    def heavy_row(row: tuple) -> tuple:
        # Dealt by content: equal runs meet, different ones are spread.
        return (row[0], 1 + int.from_bytes(hashlib.blake2b(row[5], digest_size=3).digest(), "big"), *row[2:])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, open_, large = None, [], False
        out: list[tuple] = []

        def windows(body: bytes) -> Iterator[tuple[int, bytes]]:
            left = body[0]
            for off in range(left + around - (len(body) - 1), left + 1):
                yield off, body[1 + left - off:1 + left - off + around]

        def pass_on(body: bytes, holders: list[tuple]) -> None:
            for off, part in windows(body):
                name = hashlib.md5(b"%d %d " % (group[0], off) + part).digest()
                for id_, tag, place in holders:
                    out.append((1, id_, tag, place - off, place - off + window, name))

        def close() -> None:
            if len(open_) > 1 and not large:
                least: dict = {}
                for body, id_, _ in open_:
                    for at in windows(body):
                        if least.get(at, LAST) >= id_:
                            least[at] = id_
                for body, id_, holders in open_:
                    gone = [off for off, part in windows(body) if least[(off, part)] < id_]
                    while gone:
                        n = 1
                        while n < len(gone) and gone[n] == gone[0] + n:
                            n += 1
                        for h, tag, place in holders:
                            out.append((0, h, tag, place - gone[n - 1], place - gone[0] + window, None))
                        gone = gone[n:]
            open_.clear()

        for batch in batches:
            for anchor, salt, id_, tag, place, body in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
                if salt == -1:
                    left = body[0]
                    out.append((0, id_, tag, place - left, place - left + len(body) - 1 + gram, None))
                    continue
                if (anchor, salt) != group:
                    if open_ and (large or group[1]):
                        pass_on(open_[-1][0], open_[-1][2])
                        open_.clear()
                    close()
                    group, large = (anchor, salt), False
                if open_ and open_[-1][0] == body:
                    if id_ > open_[-1][1]:
                        left = body[0]
                        out.append((0, id_, tag, place - left, place - left + len(body) - 1 + gram, None))
                    else:
                        open_[-1][2].append((id_, tag, place))
                    continue
                if salt or large or len(open_) >= most:
                    # Too many to be compared here: their windows are met by an aggregate.
                    for done in open_:
                        pass_on(done[0], done[2])
                    open_.clear()
                    large = True
                open_.append((body, id_, [(id_, tag, place)]))
            if out:
                yield pd.DataFrame(out, columns=["kind", "id", "tag", "start", "end", "name"])
                out.clear()
        if open_ and (large or group[1]):
            pass_on(open_[-1][0], open_[-1][2])
            open_.clear()
        if group is not None:
            close()
        if out:
            yield pd.DataFrame(out, columns=["kind", "id", "tag", "start", "end", "name"])

    known = texts.join(keys.withColumnRenamed("id", "_id").hint("merge"), F.col("id") == F.col("_id"), "left").select("id", "tag", "packed", "keys")
    dealt = known.mapInPandas(list_, layout).repartition("anchor", "salt")
    return dealt.sortWithinPartitions("anchor", "salt", "body", "id").mapInPandas(
        meet, "kind int, id long, tag long, start int, end int, name binary"
    )


def cut_out(texts: DataFrame, gone: DataFrame) -> DataFrame:
    """``id``, ``tag``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``starts`` and ``ends`` of the texts that lose bytes."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, starts, ends in zip(unpacked(batch), batch["starts"], batch["ends"], strict=True):
                order = np.argsort(starts, kind="stable")
                s = np.asarray(starts)[order]
                reach = np.maximum.accumulate(np.asarray(ends)[order])
                first = np.flatnonzero(np.append(True, s[1:] > reach[:-1]))
                begin, end = s[first], reach[np.append(first[1:], len(s)) - 1]
                digest, at = hashlib.sha256(), 0
                for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                    digest.update(text[at:b])
                    at = e
                digest.update(text[at:])
                rows.append((int((end - begin).sum()), len(begin), digest.hexdigest(), begin.tolist(), end.tolist()))
            out = pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256", "starts", "ends"])
            yield pd.concat([batch[["id", "tag"]].reset_index(drop=True), out], axis=1)

    lists = gone.groupBy("id", "tag").agg(
        F.collect_list(F.struct("start", "end")).alias("spans")
    ).select(F.col("id").alias("_id"), F.col("tag").alias("_tag"), F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    same = (F.col("id") == F.col("_id")) & (F.col("tag") - F.col("_tag") == 0)
    return texts.join(lists.hint("merge"), same).select("id", "tag", "packed", "starts", "ends").mapInPandas(
        cut, "id long, tag long, n_removed long, n_spans long, kept_sha256 string, starts array<int>, ends array<int>"
    )


def dedup(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``removed`` (array of start, end) for every row."""
    setup(docs.sparkSession)
    rows, texts, bits = distinct_texts(docs, settings)
    heavy = heavy_anchors(texts, settings)
    keys = shared_anchors(texts, heavy, bits, settings)
    found = durable(settled_runs(texts, keys, heavy, bits, settings))
    open_ = found.where("kind = 1").select("id", "tag", "start", "end", "name")
    least = open_.groupBy("name").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    met = hand_over(open_, least.select(F.col("name").alias("_name"), "least"), "name", "_name").where("id > least")
    gone = found.where("kind = 0").select("id", "tag", "start", "end").unionByName(met.select("id", "tag", "start", "end"))
    cut = durable(cut_out(texts, gone)).toDF("_id", "_tag", "n_removed", "n_spans", "kept_sha256", "starts", "ends")
    whole = (F.col("id") > F.col("first")) & (F.col("n_bytes") >= settings.window)
    joined = rows.withColumn("tag", F.crc32("node"))
    # A row that stands twice was cut twice.
    own = cut.dropDuplicates(["_id", "_tag"])
    nothing = F.sha2(F.lit(""), 256)
    return joined.join(own, (F.col("id") == F.col("_id")) & (F.col("tag") == F.col("_tag")), "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).cast("long").alias("n_spans"),
        F.when(whole, nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end"))))
        .otherwise(F.zip_with(F.coalesce("starts", F.array().cast("array<int>")), F.coalesce("ends", F.array().cast("array<int>")),
                              lambda s, e: F.struct(s.alias("start"), e.alias("end")))).alias("removed"),
    )
