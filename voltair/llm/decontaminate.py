"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, matched against every token window.

Words are runs of digits, ASCII letters (A-Z lowered) and non-ASCII characters. A
window is `n` consecutive words of one benchmark item; an item of fewer words is
one window. The hashes of the windows go to the executors as one sorted array per
window length; each document's windows are looked up in it, and every hit is
verified word by word before it counts.

The set is broadcast only below `max_windows` windows. A larger benchmark is taken
in blocks below that bound, which is checked before a block is collected, one scan of
the documents each; an item with more windows than a block takes is cut into parts
that overlap by a window less one word. The hits of all blocks in the text as it came
are merged by document, and what is cut is cut once.

Defined cases: null text has no words; items without words match nothing; items
with equal windows all count; a null item_id is listed as an empty string; repeated
documents are judged each for itself (in blocks, rows equal in id and text together);
very long texts are searched whole; empty tables give no rows, an empty benchmark no
hits; other columns of the documents, whatever their names, pass through `remove_spans`
and are left out by `scan`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import BASE, U64, Words, chunks, fresh, mix, slices, texts_of, word_table
from .suffix_dedup import renew_length

NGRAM = 10
#: Windows a broadcast may hold: with words and hashes, some 100 MB.
MAX_WINDOWS = 250_000


class Windows:
    """The windows of one block of items: hashes by length, and for each hash its (words, items)."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.found: dict[int, dict[int, list[tuple[bytes, set[str]]]]] = {}
        for name, text in items:
            words = Words([text], "alnum", lower=True)
            count = len(words.start)
            length = min(n, count)
            if not count:
                continue
            hashes = window_hashes(words.hashes(), length)
            for i, h in enumerate(hashes.tolist()):
                string = b" ".join(words.raw[a:b] for a, b in zip(words.start[i : i + length], words.stop[i : i + length], strict=True))
                same = self.found.setdefault(length, {}).setdefault(h, [])
                for held, names in same:
                    if held == string:
                        names.add(name)
                        break
                else:
                    same.append((string, {name}))
        self.sorted = {k: np.sort(np.fromiter(v, U64, len(v))) for k, v in self.found.items()}


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` word hashes."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i in range(length):
        out = out * U64(BASE) + words[i : i + n]
    return mix(out)


def hits(texts: list[bytes], windows: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray, set[str]]]:
    """Per text: words, the byte spans of its hit words (start, stop), names of the items that occur."""
    for a, z in chunks(texts):
        words = Words(texts[a:z], "alnum", lower=True)
        hashes = words.hashes()
        steps = np.zeros(len(hashes) + 1, np.int64)
        names: dict[int, set[str]] = {}
        for length, table in windows.sorted.items():
            h = window_hashes(hashes, length)
            at = np.flatnonzero(table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h)
            doc = np.searchsorted(words.first, at, side="right") - 1
            within = at + length <= words.first[np.minimum(doc + 1, z - a)]
            for i, d in zip(at[within].tolist(), doc[within].tolist(), strict=True):
                string = b" ".join(words.raw[p:q] for p, q in zip(words.start[i : i + length], words.stop[i : i + length], strict=True))
                for held, items in windows.found[length][int(h[i])]:
                    if held == string:
                        steps[i] += 1
                        steps[i + length] -= 1
                        names.setdefault(d, set()).update(items)
        hit = np.cumsum(steps[:-1]) > 0
        for d in range(z - a):
            f, t = words.first[d], words.first[d + 1]
            mine = np.flatnonzero(hit[f:t]) + f if d in names else np.zeros(0, np.int64)
            yield int(t - f), words.start[mine] - words.doc_at[d], words.stop[mine] - words.doc_at[d], names.get(d, set())


def parts_of(benchmark: DataFrame, n: int, most: int) -> DataFrame:
    """(item_id string, text string, windows long): the items with words, those of more than `most` windows in overlapping parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, text in zip(b["item_id"].to_pylist(), texts_of(b["text"]), strict=True):
                words = Words([text], "alnum", lower=True)
                count = len(words.start)
                windows = max(count - n + 1, 1)
                for a in range(0, windows if count else 0, most):
                    here = min(most, windows - a)
                    last = min(a + here + n - 1, count) - 1
                    rows.append((name, text[words.start[a] : words.stop[last]].decode(), here))
            names, texts, sizes = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["item_id", "text", "windows"])

    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "item_id string, text string, windows long")


def blocks(benchmark: DataFrame, n: int, max_windows: int) -> tuple[DataFrame, int]:
    """The parts of the items with the number of their block, and how many blocks there are; none holds more than `max_windows` windows."""
    parts = parts_of(benchmark, n, max(1, max_windows // 8)).dropDuplicates(["item_id", "text"])  # repeated rows count once
    total = parts.agg(F.coalesce(F.sum("windows"), F.lit(0)).alias("w")).first()["w"]
    count = max(1, -(-total // max_windows))
    while True:
        dealt = parts.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
        fullest = dealt.groupBy("block").agg(F.sum("windows").alias("w")).agg(F.max("w").alias("w")).first()["w"] or 0
        if fullest <= max_windows or count > 16 * total:  # parts are told apart by a hash of item and text
            return dealt, count
        count = count * 3 // 2 + 1


def block_windows(parts: DataFrame, block: int, n: int) -> Windows:
    rows = parts.where(F.col("block") == block).select("item_id", "text").distinct().collect()  # checked: at most max_windows windows
    return Windows([(r["item_id"] or "", r["text"].encode()) for r in rows], n)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    items, several = blocks(benchmark, n, max_windows)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if several > 1:
        return merged(rows, items, several, n)
    shared = docs.sparkSession.sparkContext.broadcast(block_windows(items, 0, n))
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(w, len(s), len(i), hashlib.sha256(",".join(sorted(i)).encode()).hexdigest()) for w, s, _, i in hits(texts_of(b["text"]), shared.value)]
            words, hit, count, digest = zip(*found, strict=True) if found else ((),) * 4
            yield pa.record_batch([b["doc_id"], pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return rows.mapInArrow(run, schema)


def merged(rows: DataFrame, items: DataFrame, several: int, n: int) -> DataFrame:
    """As scan, for a benchmark in blocks: hit spans and items of each block, merged by document."""
    spark = rows.sparkSession
    schema = "doc_id long, tag long, n_words long, hit array<int>, items array<string>"
    fields = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n_words", pa.int64()), ("hit", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
    rows = rows.withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    out = None
    for block in range(several):
        shared = spark.sparkContext.broadcast(block_windows(items, block, n))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=block == 0) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(w, s.tolist(), sorted(i)) for w, s, _, i in hits(texts_of(b["text"]), shared.value)]
                keep = [k for k, f in enumerate(found) if first or f[1]]
                rows_kept = pa.array(keep, pa.int64())
                yield pa.record_batch([b["doc_id"].take(rows_kept), b["tag"].take(rows_kept), pa.array([found[k][0] for k in keep], pa.int64()), pa.array([found[k][1] for k in keep], fields.field("hit").type), pa.array([found[k][2] for k in keep], fields.field("items").type)], schema=fields)

        part = rows.mapInArrow(run, schema).withColumn("rows", F.lit(int(block == 0)))
        out = part if out is None else out.unionByName(part)
    flat = F.array_distinct(F.flatten(F.collect_list("hit"))), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    one = out.groupBy("doc_id", "tag").agg(F.max("n_words").alias("n_words"), F.size(flat[0]).cast("long").alias("n_hit"), flat[1].alias("items"), F.sum("rows").cast("int").alias("rows"))
    one = one.withColumn("rows", F.explode(F.sequence(F.lit(1), "rows")))
    return one.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """documents with every run of hit words, and what stands between them, cut out of `text`.

    Hits of all blocks are found in the text as it came and cut once: each block adds its
    hit words to a column that travels with the row.
    """
    items, several = blocks(benchmark, n, max_windows)
    at = [c.lower() for c in docs.columns].index("text")
    columns, span = docs.columns, fresh(docs.columns, "spans")
    with_span = StructType([*docs.schema.fields, StructField(span, BinaryType())])
    out = docs
    for block in range(several):
        shared = docs.sparkSession.sparkContext.broadcast(block_windows(items, block, n))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=block == 0, last=block == several - 1) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                raws, arrays = texts_of(b["text"]), list(b.columns)
                held = [b""] * len(raws) if first else arrays.pop().to_pylist()
                for i, (_, start, stop, names) in enumerate(hits(raws, shared.value)):
                    if names:
                        held[i] += np.stack([start, stop], 1).astype(np.int64).tobytes()
                if last:
                    texts = b["text"].to_pylist()
                    for i, spans in enumerate(held):
                        if spans:
                            texts[i] = cut(raws[i], *np.unique(np.frombuffer(spans, np.int64).reshape(-1, 2), axis=0).T).decode()
                    arrays[at] = pa.array(texts, b.schema.field(at).type)
                else:
                    arrays.append(pa.array(held, pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *([] if last else [span])])

        out = out.mapInArrow(run, docs.schema if block == several - 1 else with_span)
    return renew_length(out)


def cut(raw: bytes, start: np.ndarray, stop: np.ndarray) -> bytes:
    """raw without the spans; between two hit words nothing stays if no other word stands there."""
    kept, at = [], 0
    for s, e in zip(start.tolist(), stop.tolist(), strict=True):
        gap = raw[at:s]
        if at == 0 or has_word(gap):
            kept.append(gap)
        at = e
    kept.append(raw[at:])
    return b"".join(kept)


def has_word(gap: bytes) -> bool:
    return bool(word_table("alnum")[np.frombuffer(gap, np.uint8)].any())
