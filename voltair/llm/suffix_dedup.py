"""Suffix-array dedup: bytes covered by a string of K bytes that also starts earlier are removed, the first copy stays.

A corpus-wide suffix array doesn't fit one machine, and only strings of K bytes or
more matter. `segments` deals the corpus out so that equal K-byte strings meet in
one bucket; there a suffix array over the bucket's windows and its array of
longest previous factors tell which windows start earlier. In suffix order, the
earlier suffix most similar to suffix i is either the nearest one above it or the
nearest one below it that stands at a smaller position; the longer of the two
common prefixes is LPF[i], and the K bytes from i are a later copy exactly if
LPF[i] >= K. Suffixes are ordered by their first K bytes (what follows decides
nothing), ties by position.

Defined cases: null text counts as empty; documents shorter than K lose nothing; a
null doc_id orders before all others. Rows that share a doc_id are ordered by a
hash of their text; rows equal in both are one document, and none of their bytes
is removed on account of the other. Other columns pass through. A very long text is
one batch of its own, and its super-k-mers are dealt like those of other texts; empty
tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE, U64, doc_key, fresh, prefix_hash, ranges, span_hash, text_tag, texts_of
from .segments import Plan, covered, mask_of, span_lists

LENGTH = 100


def plan(length: int = LENGTH) -> Plan:
    return Plan("byte", length, gram=max(1, length * 2 // 5), same_document=True, copies=earlier_copies)


def suffix_array(text: np.ndarray, at: np.ndarray, position: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that start at `at`, by their first `depth` bytes and then by position; and those bytes, a row for each. No suffix is shorter."""
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, depth)[at]) if len(at) else np.zeros((0, depth), np.uint8)
    by_place = np.argsort(position)
    return by_place[np.argsort(rows.view(f"S{depth}").ravel()[by_place], kind="stable")], rows


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each, -1 where none; the values are different.

    Everything between an element and its candidate is larger, so an element whose candidate is larger too goes on to the candidate's candidate; all elements do so side by side.
    """
    before = np.arange(-1, len(values) - 1)
    open_ = np.flatnonzero(before >= 0)
    while len(open_):
        open_ = open_[values[before[open_]] > values[open_]]
        before[open_] = before[before[open_]]
        open_ = open_[before[open_] >= 0]
    return before


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the rows of a and b."""
    differs = a != b
    return np.where(differs.any(1), differs.argmax(1), a.shape[1])


def longest_previous_factor(text: np.ndarray, at: np.ndarray, position: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix start in `at`: the longest prefix, up to depth, shared with one at a smaller position."""
    order, rows = suffix_array(text, at, position, depth)
    place, rows = position[order], rows[order]
    above = nearest_smaller(place)
    below = len(place) - 1 - nearest_smaller(place[::-1])[::-1]
    beside = common_prefix(rows[1:], rows[:-1])  # of neighbours in suffix order
    found = np.zeros(len(at), np.int64)
    for other, step in ((above, -1), (below, 1)):
        i = np.flatnonzero((other >= 0) & (other < len(place)))
        next_ = other[i] == i + step
        lcp = np.empty(len(i), np.int64)
        lcp[next_] = beside[np.minimum(i, i + step)[next_]]
        far = i[~next_]
        lcp[~next_] = common_prefix(rows[far], rows[other[far]])
        found[i] = np.maximum(found[i], lcp)
    out = np.empty(len(at), np.int64)
    out[order] = found
    return out


def earlier_copies(entries: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Which super-k-mers stand earlier as a whole: in the suffix order of their starts, the previous factor, at the previous or next smaller position, is the whole string."""
    by_place = np.lexsort((entries["start"], entries["tag"], entries["doc"]))
    position = np.empty(len(entries), np.int64)
    position[by_place] = np.arange(len(entries))
    order = np.array(sorted(by_place.tolist(), key=strings.__getitem__), np.int64)
    place = position[order]
    above = nearest_smaller(place)
    below = len(place) - 1 - nearest_smaller(place[::-1])[::-1]
    out = np.zeros(len(entries), bool)
    for other in (above, below):
        i = np.flatnonzero((other >= 0) & (other < len(place)))
        for a, b in zip(order[i].tolist(), order[other[i]].tolist(), strict=True):
            if strings[a] == strings[b]:
                out[a] = True
    return out


#: Windows whose bytes are laid out side by side at a time.
SECTION = 1 << 15


def sections(text: np.ndarray, at: np.ndarray, depth: int, size: int = SECTION) -> Iterator[np.ndarray]:
    """The windows of `depth` bytes that start at `at`, by number, in sections of about `size`. Equal windows share a section, so previous factors of `depth` bytes are found inside it; a hash deals windows to sections and decides nothing else."""
    if len(at) <= size:
        yield np.arange(len(at))
        return
    of = (span_hash(prefix_hash(BYTE_CODE[text]), at, at + depth) % U64(-(-len(at) // size))).astype(np.int32)
    order = np.argsort(of, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(of[order])) + 1)


def earlier_windows(depth: int, size: int = SECTION):
    """Which windows of super-k-mers stand earlier: those whose previous factor has `depth` bytes."""

    def earlier(entries: np.ndarray, strings: list[bytes]) -> np.ndarray:
        text = np.frombuffer(b"".join(strings), np.uint8)
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        starts = np.cumsum(lengths) - lengths
        n = entries["n"].astype(np.int64)
        at = ranges(starts, n)
        # places of windows in the corpus, as one number that orders them
        by_place = np.lexsort((entries["start"], entries["tag"], entries["doc"]))
        first = np.empty(len(n), np.int64)
        first[by_place] = np.cumsum(n[by_place]) - n[by_place]
        position = ranges(first, n)
        out = np.empty(len(at), bool)
        for some in sections(text, at, depth, size):
            out[some] = longest_previous_factor(text, at[some], position[some], depth) >= depth
        return out

    return earlier


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, spans by document) for documents(doc_id, text)."""
    p = plan(length)
    return covered(docs, p, earlier_windows(length), "suffix-dedup")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: bytes, removed bytes, removed runs, digest of the rest."""
    keys, spans = repeated_spans(docs, length)
    fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans_of, rows = span_lists(b["spans"]), []
            for i, text in enumerate(texts_of(b["text"])):
                start, n = spans_of(i)
                if not len(start):
                    rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                    continue
                gone = mask_of(len(text), start, n, length)
                runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                rows.append((len(text), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()))
            if rows:
                yield pa.record_batch([b["did"].cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(fields)[1:], strict=True))], schema=fields)

    out = keys.join(spans, ["did", "tag"], "left").select("did", "text", "spans").mapInArrow(run, RESULT)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(-(2**63)), F.col("doc_id")))


def trim(text: bytes, gone: np.ndarray) -> bytes:
    """The bytes that stay; a character goes only if all its bytes do."""
    buf = np.frombuffer(text, np.uint8)
    lead = (buf & 0xC0) != 0x80
    whole = np.minimum.reduceat(gone.astype(np.int8), np.flatnonzero(lead)).astype(bool) if len(buf) else np.zeros(0, bool)
    return buf[~np.repeat(whole, np.diff(np.append(np.flatnonzero(lead), len(buf))))].tobytes()


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """documents with the later copies cut out of `text` (whole characters only) and n_chars, where there is one, renewed."""
    _, spans = repeated_spans(docs, length)
    did, tag, found = (fresh(docs.columns, c) for c in ("did", "tag", "spans"))
    spans = spans.withColumnsRenamed({"did": did, "tag": tag, "spans": found})
    joined = docs.withColumns({did: doc_key(), tag: text_tag()}).join(spans, [did, tag], "left").select(*docs.columns, found)
    at = [c.lower() for c in joined.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans_of, texts = span_lists(b[found]), b["text"].to_pylist()
            for i, text in enumerate(texts):
                start, n = spans_of(i)
                if len(start):
                    raw = text.encode()
                    texts[i] = trim(raw, mask_of(len(raw), start, n, length)).decode()
            arrays = list(b.columns)
            arrays[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays[:-1], names=b.schema.names[:-1])

    out = joined.mapInArrow(run, docs.schema)
    return renew_length(out)


def renew_length(docs: DataFrame) -> DataFrame:
    """n_chars, where the table has it, as the length of the text now."""
    kinds = {c.lower(): (c, t) for c, t in docs.dtypes}
    if "n_chars" not in kinds:
        return docs
    name, kind = kinds["n_chars"]
    return docs.withColumn(name, F.char_length("text").cast(kind))
