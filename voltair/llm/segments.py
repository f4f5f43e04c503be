"""Super-k-mers: which windows of K tokens occur earlier, over a whole corpus.

A window is K consecutive tokens (bytes or words) of one document. Its minimiser
is the smallest hash among its m-token grams, so equal windows have equal
minimisers. Consecutive windows that share one form a super-k-mer, which travels
as one unit to the bucket of its minimiser:

1. `scan` cuts every document into super-k-mers and announces each by its minimiser,
   a short content hash and its place. Copies within one batch are settled there by
   the caller's method, over the whole strings of super-k-mers that may be equal (their
   suffix order with previous factors, or their sorting), so a passage that fills the
   corpus is announced once a batch and not once an occurrence.
2. `settle` gathers a bucket. A super-k-mer that stands alone under its minimiser has
   no repeated window, and its string needn't travel. All others are open.
3. Open super-k-mers are cut out of their documents and travel as packed strings to
   the minimiser's bucket, where the caller compares windows (suffix order with
   longest previous factors, or sorting). A minimiser with very many different
   super-k-mers (a short common line in ever new surroundings) would gather too much
   in one bucket; its windows travel one by one, each to the bucket of its own hash,
   where only equal windows meet, one for each batch.

Hashes only bring together; that two windows are equal is decided on their bytes.

Places are ordered by (doc_id, tag, start); tag is a 64-bit hash of the text that
tells apart rows which share a doc_id. Rows equal in both are the same document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE, U64, Words, chunks, doc_key, materialise, mix, prefix_hash, ranges, shuffle_partitions, sized, span_hash, text_tag, texts_of, window_min

COVERED, OPEN, HOT = 0, 1, 2

ENTRY = np.dtype([("key", "u8"), ("content", "u8"), ("doc", "i8"), ("tag", "i8"), ("start", "i4"), ("n", "i4")])
BLOB_SCHEMA = "bucket int, blob binary"
PLACE_SCHEMA = "kind tinyint, key long, doc long, tag long, start int, n int"


@dataclass(frozen=True)
class Plan:
    """unit: 'byte' or 'word'. window: K. gram: m of the minimisers.

    same_document: whether an earlier window of the same document counts.
    copies: which of some super-k-mers (entries, strings) are copies of an earlier one, at a place that counts.
    hot: with more different super-k-mers than this under one minimiser, its windows travel one by one.
    """

    unit: str
    window: int
    gram: int
    same_document: bool
    copies: Callable[[np.ndarray, list[bytes]], np.ndarray]
    hot: int = 8000


#: Added to an entry's n where its minimiser stands in it more than once.
SELF = 1 << 30


def self_repeats(grams: np.ndarray, least: np.ndarray, start: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """Super-k-mers in which the minimiser stands more than once, so that windows of one may be equal."""
    pad = np.zeros(width - 1, U64)
    highest = ~window_min(~np.concatenate([pad, least, pad]), width)
    at = np.flatnonzero(highest == grams)  # grams that are some window's minimiser
    pair = (grams[at[1:]] == grams[at[:-1]]) & (np.diff(at) < width)
    left, right = at[:-1][pair], at[1:][pair]
    lo = np.maximum(right - width + 1, 0)
    both = ranges(lo, np.minimum(left, len(least) - 1) - lo + 1)  # windows that hold both
    both = both[least[both] == grams[np.repeat(left, np.minimum(left, len(least) - 1) - lo + 1)]]
    out = windows > width
    owner = np.unique(np.searchsorted(start, both, side="right") - 1)
    out[owner[owner >= 0]] = True
    return out


def cut(codes: np.ndarray, doc_at: np.ndarray, window: int, gram: int, mark_self: bool = False) -> tuple[np.ndarray, ...]:
    """Super-k-mers of concatenated documents: minimiser, content hash, document, start in the document, windows."""
    n, width = len(codes), window - gram + 1
    if n < window:
        return (np.zeros(0, U64),) * 2 + (np.zeros(0, np.int64),) * 3
    prefix = prefix_hash(codes)
    at = np.arange(n - gram + 1)
    grams = span_hash(prefix, at, at + gram)
    least = window_min(grams, width)
    edges = np.empty(len(least) + 1, bool)
    edges[0] = True
    np.not_equal(least[1:], least[:-1], out=edges[1:-1])
    edges[-1] = True
    full = np.flatnonzero(np.diff(doc_at) >= window)  # documents that have a window
    edges[doc_at[full]] = True
    edges[doc_at[full + 1] - window + 1] = True
    start = np.flatnonzero(edges)
    windows = np.diff(start)
    start = start[:-1]
    doc = np.searchsorted(doc_at, start, side="right") - 1
    inside = start + window <= doc_at[doc + 1]
    start, windows, doc = start[inside], windows[inside], doc[inside]
    content = span_hash(prefix, start, start + windows + (window - 1))
    more = SELF * self_repeats(grams, least, start, windows, width) if mark_self else 0
    return least[start], content, doc, start - doc_at[doc], windows + more


class Tokens:
    """A run of documents as tokens: codes, each document's first token, and the bytes of any run of tokens (words joined by one space)."""

    def __init__(self, texts: list[bytes], unit: str):
        if unit == "byte":
            self.raw = b"".join(texts)
            self.codes = BYTE_CODE[np.frombuffer(self.raw, np.uint8)]
            self.doc_at = np.cumsum([0, *map(len, texts)])
            self.start = self.stop = None
        else:
            words = Words(texts)
            self.codes, self.doc_at = words.hashes(), words.first
            self.raw = b" ".join(words.raw.split())
            size = words.stop - words.start
            self.stop = np.cumsum(size + 1) - 1
            self.start = self.stop - size

    def string(self, at: int, length: int) -> bytes:
        return self.raw[at : at + length] if self.start is None else self.raw[self.start[at] : self.stop[at + length - 1]]


def batch_entries(texts: list[bytes], docs: np.ndarray, tags: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Super-k-mers of a batch: entries to announce, and copies of earlier ones of the batch."""
    parts, where = [], []
    for a, b in chunks(texts):
        tokens = Tokens(texts[a:b], plan.unit)
        key, content, doc, start, n = cut(tokens.codes, tokens.doc_at, plan.window, plan.gram, plan.same_document)
        tokens.codes = None  # only the bytes are needed from here on
        out = np.empty(len(key), ENTRY)
        out["key"], out["content"], out["doc"], out["tag"], out["start"], out["n"] = key, content, docs[a:b][doc], tags[a:b][doc], start, n
        parts.append(out)
        where.append((tokens, tokens.doc_at[doc] + start))
    entries = np.concatenate(parts) if parts else np.zeros(0, ENTRY)
    if not len(entries):
        return entries, entries
    run = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    at = np.concatenate([x for _, x in where])
    order, new = ordered(entries)
    entries, run, at = entries[order], run[order], at[order]
    length = (entries["n"] & (SELF - 1)) + (plan.window - 1)
    old = copied(entries, new, lambda i: where[run[i]][0].string(at[i], length[i]), plan)
    return entries[~old], entries[old]


def copied(entries: np.ndarray, new: np.ndarray, string: Callable[[int], bytes], plan: Plan) -> np.ndarray:
    """Which entries are copies of earlier ones, by `plan.copies` over those that share minimiser and content hash with others. new: where such a group begins."""
    old = np.zeros(len(entries), bool)
    group = np.cumsum(new) - 1
    some = np.flatnonzero(np.bincount(group)[group] > 1)
    if len(some):
        old[some] = plan.copies(entries[some], [string(i) for i in some.tolist()])
    return old


def ordered(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in the order of (key, content, place), equal ones once: their indices, and where a new (key, content) begins."""
    order = np.argsort(entries["key"], kind="stable")
    key = entries["key"][order]
    same = key[1:] == key[:-1]
    tied = np.zeros(len(entries), bool)
    tied[1:] |= same
    tied[:-1] |= same
    if tied.any():  # order the few that share a minimiser by all columns
        some = entries[order[tied]]
        order[tied] = order[tied][np.lexsort((some["n"], some["start"], some["tag"], some["doc"], some["content"], some["key"]))]
    there = entries[order]
    differs = np.ones(len(there), bool)
    differs[1:] = there[1:] != there[:-1]
    order, there = order[differs], there[differs]
    new = np.ones(len(there), bool)
    new[1:] = (there["key"][1:] != there["key"][:-1]) | (there["content"][1:] != there["content"][:-1])
    return order, new


def planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes first, so that small numbers compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(raw: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


def pack(entries: np.ndarray, strings: list[bytes] | None = None) -> bytes:
    """Entries in place order (each document named once), and the string of each."""
    order = np.lexsort((entries["start"], entries["tag"], entries["doc"]))
    entries = entries[order]
    new = np.ones(len(entries), bool)
    new[1:] = (entries["doc"][1:] != entries["doc"][:-1]) | (entries["tag"][1:] != entries["tag"][:-1])
    docs = entries[new]
    count = np.diff(np.append(np.flatnonzero(new), len(entries))).astype("i4")
    body = planes(docs["doc"]) + docs["tag"].tobytes() + planes(count) + planes(entries["start"]) + planes(entries["n"])
    if strings is not None:
        strings = [strings[i] for i in order.tolist()]
        body += planes(np.fromiter(map(len, strings), "i4", len(strings))) + b"".join(strings)
    plain = entries["key"].tobytes() + entries["content"].astype("u4").tobytes()
    return len(entries).to_bytes(4, "little") + len(docs).to_bytes(4, "little") + plain + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes, with_strings: bool = False) -> tuple[np.ndarray, list[bytes]]:
    n, d = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    out = np.empty(n, ENTRY)
    out["key"] = np.frombuffer(blob, "u8", n, 8)
    out["content"] = np.frombuffer(blob, "u4", n, 8 + 8 * n)
    body = zstandard.ZstdDecompressor().decompress(blob[8 + 12 * n :])
    count = from_planes(body, "i4", d, 16 * d)
    out["doc"] = np.repeat(from_planes(body, "i8", d, 0), count)
    out["tag"] = np.repeat(np.frombuffer(body, "i8", d, 8 * d), count)
    out["start"], out["n"] = from_planes(body, "i4", n, 20 * d), from_planes(body, "i4", n, 20 * d + 4 * n)
    if not with_strings:
        return out, []
    stop = 20 * d + 12 * n + np.cumsum(from_planes(body, "i4", n, 20 * d + 8 * n), dtype=np.int64)
    return out, [body[a:b] for a, b in zip([20 * d + 12 * n, *stop[:-1].tolist()], stop.tolist(), strict=True)]


_BLOBS = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
_PLACES = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def bucket_blobs(sent: np.ndarray, settled: np.ndarray, buckets: int, strings: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """One packed row a bucket; settled entries ride along in rows of their own, marked by a leading byte."""
    for mark, entries in ((b"\0", sent), (b"\1", settled)):
        if not len(entries):
            continue
        bucket = ((mix(entries["key"]) if mark == b"\0" else mix(entries["doc"].astype(U64) + entries["tag"].astype(U64))) % U64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        blobs = []
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(entries)], strict=True):
            some = order[a:b]
            blobs.append(mark + pack(entries[some], [strings[i] for i in some.tolist()] if strings is not None and mark == b"\0" else None))
        yield pa.record_batch([pa.array(bucket[at], pa.int32()), pa.array(blobs, pa.binary())], schema=_BLOBS)


def scan(docs: DataFrame, plan: Plan, buckets: int) -> DataFrame:
    """Step 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches):
            yield from bucket_blobs(*batch_entries(texts_of(b["text"]), b["did"].to_numpy(), b["tag"].to_numpy(), plan), buckets)

    return docs.mapInArrow(run, BLOB_SCHEMA)


def places(kind: int | np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
    kinds = np.full(len(entries), kind, np.int8) if isinstance(kind, int) else kind.astype(np.int8)
    entries = entries.copy()
    entries["n"] &= SELF - 1
    return pa.record_batch([pa.array(kinds), *(pa.array(np.ascontiguousarray(entries[c]).view(t)) for c, t in (("key", "i8"), ("doc", "i8"), ("tag", "i8"), ("start", "i4"), ("n", "i4")))], schema=_PLACES)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | list[bytes]]:
    """Places that are settled, as they come; then the packed entries of each bucket of a partition that holds whole buckets."""
    held: dict[int, list[bytes]] = {}
    for b in batches:
        for bucket, blob in zip(b["bucket"].to_pylist(), b["blob"].to_pylist(), strict=True):
            if blob[0]:
                yield places(COVERED, unpack(blob[1:])[0])
            else:
                held.setdefault(bucket, []).append(blob[1:])
    while held:
        yield held.popitem()[1]


def settle(blobs: DataFrame, plan: Plan) -> DataFrame:
    """Step 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in by_bucket(batches):
            if isinstance(found, pa.RecordBatch):
                yield found
                continue
            entries = np.concatenate([unpack(blob)[0] for blob in found])
            order, new = ordered(entries)
            entries = entries[order]
            group = np.concatenate([[True], entries["key"][1:] != entries["key"][:-1]])
            at, of = np.flatnonzero(group), np.cumsum(group) - 1
            size = np.diff(np.append(at, len(entries)))[of]
            different = np.add.reduceat(new.astype(np.int64), at)[of]
            open_ = (size > 1) | (entries["n"] >= SELF)
            yield places(np.where(different > plan.hot, HOT, OPEN)[open_], entries[open_])

    return blobs.mapInArrow(run, PLACE_SCHEMA)


def pieces(docs: DataFrame, open_places: DataFrame, plan: Plan, buckets: int) -> DataFrame:
    """Step 3: cut open super-k-mers out of their documents, the hot ones window by window."""
    refs = open_places.groupBy(F.col("doc").alias("did"), "tag").agg(F.collect_list(F.struct("kind", "key", "start", "n")).alias("refs"))
    joined = docs.join(refs, ["did", "tag"]).select("did", "tag", "text", "refs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches):
            texts, docs_, tags = texts_of(b["text"]), b["did"].to_numpy(), b["tag"].to_numpy()
            lists = b["refs"]
            offsets, flat = lists.offsets.to_numpy(), lists.values
            kind, key, start, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            parts, strings = [], []
            for i, text in enumerate(texts):
                mine = slice(offsets[i], offsets[i + 1])
                tokens = Tokens([text], plan.unit)
                hot = kind[mine] == HOT
                k, s, w = key[mine][~hot].view(U64), start[mine][~hot], n[mine][~hot]
                if hot.any():
                    s2 = ranges(start[mine][hot], n[mine][hot])
                    prefix = prefix_hash(tokens.codes)
                    k = np.append(k, span_hash(prefix, s2, s2 + plan.window))
                    s, w = np.append(s, s2), np.append(w, np.ones(len(s2), np.int64))
                out = np.empty(len(k), ENTRY)
                out["key"], out["content"], out["doc"], out["tag"], out["start"], out["n"] = k, 0, docs_[i], tags[i], s, w
                parts.append(out)
                strings += map(tokens.string, s.tolist(), (w + (plan.window - 1)).tolist())
            if not strings:
                continue
            entries = np.concatenate(parts)
            # as in step 1: copies within the batch are settled here
            number: dict[tuple[int, bytes], int] = {}
            entries["content"] = [number.setdefault(f, len(number)) for f in zip(entries["key"].tolist(), strings, strict=True)]
            order, new = ordered(entries)
            entries = entries[order]
            old = copied(entries, new, lambda i: strings[order[i]], plan)  # noqa: B023
            yield from bucket_blobs(entries[~old], entries[old], buckets, [strings[i] for i in order[~old].tolist()])

    return joined.mapInArrow(run, BLOB_SCHEMA)


def compare(packed: DataFrame, plan: Plan, earlier: Callable[[np.ndarray, list[bytes]], np.ndarray]) -> DataFrame:
    """Step 3, at the bucket. earlier: which windows of the given super-k-mers (their windows one after another) stand earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in by_bucket(batches):
            if isinstance(found, pa.RecordBatch):
                yield found
                continue
            parts, strings = [], []
            for blob in found:
                e, s = unpack(blob, True)
                parts.append(e)
                strings += s
            entries = np.concatenate(parts)
            # equal rows of the table give equal entries: once
            order = np.lexsort((entries["start"], entries["tag"], entries["doc"], entries["key"]))
            there = entries[order]
            once = np.ones(len(there), bool)
            for c in ("key", "doc", "tag", "start"):
                once[1:] &= there[c][1:] == there[c][:-1]
            once[1:] = ~once[1:]
            order = order[once]
            entries, strings = entries[order], [strings[i] for i in order.tolist()]
            seen = in_batches(entries, strings, earlier)
            # runs of such windows within each super-k-mer
            at = np.concatenate([[0], np.cumsum(entries["n"], dtype=np.int64)])
            edge = np.diff(np.concatenate([[0], seen.astype(np.int8), [0]]))
            breaks = np.zeros(len(seen) + 1, bool)
            breaks[at] = True
            starts = np.flatnonzero((edge == 1) | (breaks & np.concatenate([seen, [False]])))
            stops = np.flatnonzero((edge == -1) | (breaks & np.concatenate([[False], seen])))
            owner = np.searchsorted(at, starts, side="right") - 1
            out = entries[owner]
            out["start"] += (starts - at[owner]).astype(np.int32)
            out["n"] = stops - starts
            yield places(COVERED, out)

    return packed.mapInArrow(run, PLACE_SCHEMA)


def keyed(docs: DataFrame) -> DataFrame:
    """(did, tag, text) of the documents, none of them null."""
    return docs.select(doc_key().alias("did"), text_tag().alias("tag"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def in_batches(entries: np.ndarray, strings: list[bytes], earlier: Callable[[np.ndarray, list[bytes]], np.ndarray], target: int = 1 << 16) -> np.ndarray:
    """`earlier` over runs of whole minimisers of about `target` bytes: windows of different minimisers are never equal."""
    order = np.argsort(entries["key"], kind="stable")
    key = entries["key"][order]
    n = entries["n"].astype(np.int64)
    first = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), bool)
    at, size = 0, 0
    for i in range(len(order) + 1):
        if i == len(order) or (size > target and key[i] != key[i - 1]):
            some = order[at:i]
            out[ranges(first[some], n[some])] = earlier(entries[some], [strings[k] for k in some])
            at, size = i, 0
        if i < len(order):
            size += len(strings[order[i]])
    return out


def covered(docs: DataFrame, plan: Plan, earlier: Callable[[np.ndarray, list[bytes]], np.ndarray], name: str) -> tuple[DataFrame, DataFrame]:
    """The keyed documents, and by (did, tag) `spans`: runs (start, n) of windows that stand earlier, in no order."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    buckets = 4 * parts
    keys = keyed(docs)
    blobs = scan(keys, plan, buckets).repartition(parts, "bucket")
    found = materialise(settle(blobs, plan), name)
    open_places = found.where(F.col("kind") != COVERED)
    cut_out = pieces(keys, open_places, plan, buckets).repartition(parts, "bucket")
    more = compare(cut_out, plan, earlier)
    spans = found.where(F.col("kind") == COVERED).unionByName(more).groupBy(F.col("doc").alias("did"), "tag").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return keys, spans


def mask_of(length: int, starts: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which of `length` tokens stand in the windows start .. start + n - 1."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + n + (window - 1), length), -1)
    return np.cumsum(steps[:-1]) > 0


def span_lists(column: pa.Array) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
    """Access to the (start, n) lists of a batch; null: none."""
    offsets, flat = column.offsets.to_numpy(), column.values
    starts, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    empty = np.zeros(0, np.int32)
    return lambda i: (starts[offsets[i] : offsets[i + 1]], n[offsets[i] : offsets[i + 1]]) if valid[i] else (empty, empty)


__all__ = ["Plan", "covered", "mask_of", "ranges", "span_lists"]
