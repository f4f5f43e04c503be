"""Substring dedup over words: every word covered by a window of K words that also starts in a document with a smaller doc_id goes.

Consecutive windows that share a minimiser form a super-k-mer (see `segments`).
Where different super-k-mers meet under one minimiser they come to its bucket as
packed strings, and sorting the bucket's windows brings equal ones together: each
run of equal windows is counted exactly and its smallest document known.

Defined cases: null text has no words; documents of fewer than K words lose
nothing; a null doc_id orders before all others; rows that share a doc_id are not
earlier than one another, so repeated rows all stay. A very long text is one batch of
its own; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Words, chunks, ranges, texts_of
from .segments import Plan, covered, mask_of, span_lists

WINDOW = 13


def plan(window: int = WINDOW) -> Plan:
    return Plan("word", window, gram=max(1, window * 4 // 13), same_document=False, copies=earlier_copies)


def earlier_copies(entries: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Which super-k-mers stand as a whole in an earlier document: sorted, equal strings are runs, and all but those of a run's smallest document do."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    new = np.ones(len(order), bool)
    new[1:] = [strings[a] != strings[b] for a, b in zip(order, order[1:], strict=False)]
    doc = entries["doc"][order]
    first = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
    out = np.empty(len(order), bool)
    out[order] = doc > first
    return out


def earlier_windows(window: int):
    def earlier(entries: np.ndarray, strings: list[bytes]) -> np.ndarray:
        number: dict[bytes, int] = {}
        packed = [[number.setdefault(w, len(number)) for w in s.split(b" ")] for s in strings]
        flat = np.fromiter((w for p in packed for w in p), np.int64, sum(map(len, packed)))
        lengths = np.fromiter(map(len, packed), np.int64, len(packed))
        starts, n = np.cumsum(lengths) - lengths, entries["n"].astype(np.int64)
        at = ranges(starts, n)
        doc = np.repeat(entries["doc"], n)
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat.astype(np.int32), window)[at])
        rows = rows.view(f"S{4 * window}").ravel()  # each window's words as one string
        order = np.argsort(rows, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = rows[order][1:] != rows[order][:-1]
        first = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]  # smallest document of each run
        out = np.empty(len(order), bool)
        out[order] = doc[order] > first
        return out

    return earlier


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, spans of windows by document) for documents(doc_id, text)."""
    return covered(docs, plan(window), earlier_windows(window), "window-dedup")


RESULT = "doc_id long, n_words long, n_removed long, kept string"


def remove(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """One row per document: words, removed words, and `kept`: the rest joined by one space (digest: its SHA-256)."""
    keys, spans = repeated_spans(docs, window)
    fields = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def kept_of(texts: list[bytes], spans_of) -> Iterator[tuple[int, int, bytes]]:
        for a, z in chunks(texts):
            words = Words(texts[a:z])
            single = bytearray(words.raw)  # every run of white space becomes one space
            buf = np.frombuffer(single, np.uint8)
            for d in range(z - a):
                f, t = words.first[d], words.first[d + 1]
                count = int(t - f)
                if not count:
                    yield 0, 0, b""
                    continue
                start, n = spans_of(a + d)
                lo, hi = words.start[f:t], words.stop[f:t]
                removed = 0
                if len(start):
                    stay = ~mask_of(count, start, n, window)
                    lo, hi, removed = lo[stay], hi[stay], count - int(stay.sum())
                yield count, removed, joined(buf, lo, hi)

    def joined(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
        if not len(lo):
            return b""
        size = hi - lo + 1
        ends = np.cumsum(size)
        index = np.arange(ends[-1]) + np.repeat(lo - (ends - size), size)
        out = buf[index]
        out[ends - 1] = 0x20
        return out[:-1].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(kept_of(texts_of(b["text"]), span_lists(b["spans"])))
            if rows:
                count, removed, kept = zip(*rows, strict=True)
                out = [hashlib.sha256(k).hexdigest() for k in kept] if digest else [k.decode() for k in kept]
                yield pa.record_batch([b["did"].cast(pa.int64()), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], schema=fields)

    out = keys.join(spans, ["did", "tag"], "left").select("did", "text", "spans").mapInArrow(run, RESULT)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(NULL_ID), F.col("doc_id")))
