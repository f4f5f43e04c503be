"""SimHash near-dedup: fingerprints of word shingles, links by Hamming distance, groups by connected components.

1. Each document gets a 64-bit fingerprint; documents that share one meet once, as
   one fingerprint, so a group of copies of any size is one row from here on.
2. Fingerprints meet in buckets. For a small radius the bits are cut into
   `choose + radius` blocks: two fingerprints within the radius agree wholly on
   `choose` of them, so every link meets in a bucket keyed by such a choice
   (pigeonhole; no link is lost). A wide radius, as a similarity of 0.8 needs, has
   no such split; there buckets are keyed by samples of bits, as many bits as keep
   unrelated fingerprints few in a bucket at any corpus size, and as many samples
   as find a link at the radius with probability `recall`.
3. In a bucket, pairs are settled by pivot distance tables. Distances to many
   reference fingerprints are computed once for every member; by the triangle
   inequality |d(a, p) - d(b, p)| <= d(a, b), so a pair is discarded as soon as one
   coordinate differs by more than the radius, and only survivors are verified. In
   a bucket of many members the references are members: each becomes the centre of
   the unclaimed ones in its radius, which are linked to it and need no comparison
   among themselves; only members of different stars that are not yet connected
   are compared, and a star's coordinate discards most of them.
4. Buckets send a spanning forest of their links, and components are found by
   alternating large-star and small-star steps, written to the shared folder.

Where links need a similarity (`alike`, the pipeline's stage), every link is checked by
the exact Jaccard similarity of the shingle sets, in two rounds. The first checks the
buckets' forests, which joins most of a group of copies of any size. A forest leaves
links out, so a link that fails there may have stood for others. In the second round
the members of a component whose forest did not hold are dealt to blocks, their sets
meet block by block, all members of two blocks are compared exactly where they meet,
and only a forest of the links found is sent on: never a pair a row.

Defined cases: null or wordless text has fingerprint zero, linked like any other;
fewer words than a shingle: the whole sequence is the one shingle; null doc_ids are
members of their component but never name it (a component of null ids alone has a
null id); repeated rows share everything; very long texts are fingerprinted whole;
empty tables give no rows; other columns, whatever their names, pass through
`keep_one` and are left out by the others.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, U64, Words, chunks, doc_key, fresh, materialise, mix, shuffle_partitions, slices, text_tag, texts_of

SHINGLE, RADIUS, SEED = 4, 4, 42
#: References for small buckets: fixed pseudo-random fingerprints.
REFERENCES = mix(np.arange(1, 33, dtype=U64) * U64(0xD6E8FEB86659FD93))
#: Buckets up to this size compare members with the fixed references.
SMALL = 64


def fingerprints_of(texts: list[bytes], shingle: int, seed: int, words_: int = 1, sets: list[np.ndarray] | None = None) -> np.ndarray:
    """(documents, words_) fingerprints; the first word is that of the plain hash, the others of hashes derived from it.

    sets: takes each document's different shingle hashes, sorted; bits then count each of them once.
    """
    out = np.zeros((len(texts), words_), U64)
    digest = xxhash.xxh64_intdigest
    for a, z in chunks(texts):
        words = Words(texts[a:z], lower=True)
        # the words of the run, joined by single spaces, and where each begins and ends there
        joined = b" ".join(words.raw.split())
        size = words.stop - words.start
        start = np.cumsum(size + 1) - (size + 1)
        stop = start + size
        first, count = words.first[:-1], words.count
        shingles = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
        owner = np.repeat(np.arange(z - a), shingles)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[owner]
        last = np.minimum(at + shingle - 1, first[owner] + count[owner] - 1)
        h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(start[at].tolist(), stop[last].tolist(), strict=True)), U64, len(at))
        ends = np.cumsum(shingles)
        if sets is not None:
            own = [np.unique(x) for x in np.split(h, ends[:-1])]
            sets += own
            h, shingles = np.concatenate(own), np.array([len(x) for x in own])
            ends = np.cumsum(shingles)
        for k in range(words_):
            hk = h if k == 0 else mix(h + U64(k * 0x9E3779B97F4A7C15 % 2**64))
            for d in np.flatnonzero(shingles).tolist():
                part = hk[ends[d] - shingles[d] : ends[d]]
                bits = np.zeros(64, np.int64)
                for i in range(0, len(part), 1 << 14):
                    bits += np.unpackbits(part[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                out[a + d, k] = np.packbits(2 * bits > len(part), bitorder="little").view(U64)[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, words: int = 1) -> DataFrame:
    """(doc_id, fp long, wide binary) per document. wide: 64 * words bits; fp: the same for one word, else a hash of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            wide = fingerprints_of(texts_of(b["text"]), shingle, seed, words)
            fp = wide[:, 0] if words == 1 else folded(wide)
            yield pa.record_batch([b["doc_id"], pa.array(fp.view(np.int64)), pa.array([w.tobytes() for w in wide], pa.binary())], names=["doc_id", "fp", "wide"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long, wide binary")


def folded(words: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each row."""
    out = np.zeros(len(words), U64)
    for k in range(words.shape[1]):
        out = mix(out + words[:, k] + U64(k + 1))
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


def block_choices(radius: int, choose: int, words: int) -> np.ndarray:
    """Masks (tables, words): each choice of `choose` of `choose + radius` even blocks of the bits."""
    edges = np.linspace(0, 64 * words, choose + radius + 1).round().astype(int)
    blocks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in itertools.pairwise(edges)]
    return np.array([[(sum(c) >> (64 * k)) & (2**64 - 1) for k in range(words)] for c in itertools.combinations(blocks, choose)], U64)


def blocks_for(rows: int, radius: int, words: int) -> int:
    """How many blocks to choose, so that their bits keep unrelated rows few in a bucket: two for a million rows, more beyond. Any choice finds every link."""
    return next((c for c in range(2, 6) if 64 * words * c / (c + radius) >= math.log2(max(rows, 2)) + 1), 6)


def bit_samples(radius: int, words: int, rows: int, recall: float = 0.95, seed: int = 11) -> np.ndarray:
    """Masks (tables, words) of sampled bits: enough bits that few of `rows` unrelated rows meet, enough samples that a pair at the radius meets with probability `recall`, and a closer one with a higher."""
    bits = max(16, math.ceil(math.log2(max(rows, 2))) - 2)
    meet = (1 - radius / (64 * words)) ** bits
    tables = math.ceil(math.log(1 - recall) / math.log(1 - meet))
    r = np.random.default_rng(seed)
    out = np.zeros((tables, words), U64)
    for t in range(tables):
        for b in r.choice(64 * words, bits, replace=False).tolist():
            out[t, b // 64] |= U64(1 << (b % 64))
    return out


class Forest:
    """Union-find over the members of one bucket or partition."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def small_links(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among rows, ordered by key, whose keys are equal: coordinates first, survivors verified; pairs that are connected already are not compared."""
    references = mix(REFERENCES[:, None] + np.arange(fp.shape[1], dtype=U64)[None, :])
    table = np.stack([distance(fp, r[None, :]) for r in references], 1)
    forest, root = Forest(len(key)), np.arange(len(key))
    left: list[int] = []
    right: list[int] = []
    for shift in range(1, len(key)):
        i = np.flatnonzero(key[shift:] == key[:-shift])
        if not len(i):
            break
        i = i[root[i] != root[i + shift]]
        j = i + shift
        for c in range(0, len(REFERENCES), 8):  # maximum coordinate difference, eight at a time
            near = (np.abs(table[i, c : c + 8] - table[j, c : c + 8]) <= radius).all(1)
            i, j = i[near], j[near]
        near = distance(fp[i], fp[j]) <= radius
        new = [(x, y) for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True) if forest.join(x, y)]
        if new:
            left += [x for x, _ in new]
            right += [y for _, y in new]
            root = np.array(forest.up)
            while (root[root] != root).any():
                root = root[root]
    return np.array(left, np.int64), np.array(right, np.int64)


def star_links(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of one large bucket's links, with members as pivots."""
    forest, links = Forest(len(fp)), []
    free = np.arange(len(fp))
    stars: list[np.ndarray] = []
    centres: list[int] = []
    while len(free):
        centre = int(free[0])
        inside = distance(fp[free], fp[centre]) <= radius
        mine, free = free[inside], free[~inside]
        links += [(centre, int(i)) for i in mine[1:] if forest.join(centre, int(i))]
        centres.append(centre)
        stars.append(mine)
    for s in range(len(stars)):
        others = np.array(centres[s + 1 :], dtype=np.int64)
        # a link between two stars needs centres within three radii
        close = np.flatnonzero(distance(fp[others], fp[centres[s]]) <= 3 * radius) if len(others) else []
        for t in (s + 1 + int(c) for c in close):
            if forest.root(centres[s]) == forest.root(centres[t]):
                continue
            a, b = stars[s], stars[t]
            # coordinates: distance to both centres
            a_s, a_t = (distance(fp[a], fp[centres[x]]) for x in (s, t))
            b_s, b_t = (distance(fp[b], fp[centres[x]]) for x in (s, t))
            for i in np.flatnonzero(a_t <= 2 * radius).tolist():
                j = np.flatnonzero((np.abs(b_s - a_s[i]) <= radius) & (np.abs(b_t - a_t[i]) <= radius))
                j = j[distance(fp[b[j]], fp[a[i]]) <= radius]
                if len(j):
                    forest.join(int(a[i]), int(b[j[0]]))
                    links.append((int(a[i]), int(b[j[0]])))
                    break
    return links


def links(distinct: DataFrame, masks: np.ndarray, radius: int = RADIUS) -> DataFrame:
    """(a long, b long): links that connect what is connected, from distinct fingerprints (fp long, wide binary).

    A fingerprint goes once for each mask to the bucket of its masked bits. Rows of a
    task for one bucket range travel packed as one binary.
    """
    parts = shuffle_partitions(distinct.sparkSession)
    words = masks.shape[1]
    row = np.dtype([("key", "u8"), ("node", "u8"), ("wide", "u8", (words,))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b["fp"].to_numpy().view(U64)
            wide = np.frombuffer(b"".join(b["wide"].to_pylist()), U64).reshape(-1, words)
            out = np.empty((len(masks), len(node)), row)
            for t, mask in enumerate(masks):
                out[t]["key"] = mix(folded(wide & mask) + U64(t))
            out["node"], out["wide"] = node, wide
            out = out.ravel()
            bucket = ((out["key"] >> U64(32)) * U64(4 * parts) >> U64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            out, bucket = out[order], bucket[order]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(bucket[at]), pa.array([out[i:j].tobytes() for i, j in zip(at, [*at[1:], len(out)], strict=True)], pa.binary())], names=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for bucket, blob in zip(b["bucket"].to_pylist(), b["blob"].to_pylist(), strict=True):
                held.setdefault(bucket, []).append(blob)
        found = []
        while held:
            rows = np.frombuffer(b"".join(held.popitem()[1]), row)
            found.append(bucket_links(rows[np.argsort(rows["key"], kind="stable")], radius))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), U64)
        # buckets share most of their links: send a forest of them
        nodes, index = np.unique(pairs, return_inverse=True)
        index = index.reshape(pairs.shape)
        forest = Forest(len(nodes))
        keep = [n for n, (i, j) in enumerate(index.tolist()) if forest.join(i, j)]
        yield pa.record_batch([pa.array(pairs[keep, 0].view(np.int64)), pa.array(pairs[keep, 1].view(np.int64))], names=["a", "b"])

    return distinct.select("fp", "wide").mapInArrow(deal, "bucket int, blob binary").repartition(parts, "bucket").mapInArrow(run, "a long, b long")


def bucket_links(rows: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of nodes that connect the linked ones, among rows ordered by key."""
    new = np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(rows)))
    each = np.repeat(size, size)
    some = rows[(each > 1) & (each <= SMALL)]
    out = [np.zeros((0, 2), U64)]
    if len(some):
        i, j = small_links(some["key"], some["wide"], radius)
        out.append(np.stack([some["node"][i], some["node"][j]], 1))
    for a in np.flatnonzero(size > SMALL):
        part = rows[at[a] : at[a] + size[a]]
        found = np.array(star_links(part["wide"], radius), np.int64).reshape(-1, 2)
        out.append(part["node"][found])
    return np.concatenate(out)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node long, root long) of the nodes of edges (a long, b long); root: the smallest node of the component.

    Large-star and small-star steps (Kiveris et al., 2014) until the edges stay the
    same; every round is written to the shared folder. Each step groups by one
    node and keeps one number a group, so a node of any degree is pre-aggregated.
    """
    smaller = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialise(smaller(edges), name)
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # stored, so that no aggregate stands under the join and adaptive execution can split a node of high degree
        low = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(smaller(large), f"{name}-large")
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = materialise(smaller(small), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).cast("string")).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, sampled: bool = False, seed: int = SEED, words: int = 1) -> DataFrame:
    """(doc_id long, fp long, component_id long) per document of documents(doc_id, text).

    sampled: buckets by sampled bits, for wide radii, and not by shared blocks.
    """
    fps = materialise(fingerprints(docs, shingle, seed, words), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("smallest"), F.min("wide").alias("wide"))
    rows = distinct.count()
    masks = bit_samples(radius, words, rows) if sampled else block_choices(radius, blocks_for(rows, radius, words), words)
    linked = components(thinned(links(distinct, masks, radius), "links"))
    # only fingerprints that have links need more than their own smallest document
    rooted = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "smallest", F.coalesce("root", "fp").alias("root"))
    named = materialise(with_names(rooted).select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def with_names(rooted: DataFrame) -> DataFrame:
    """rooted (root, smallest) with component_id, the smallest of its root; the names are stored, so that the join can split a large component."""
    rooted = materialise(rooted, "rooted")
    return rooted.join(materialise(rooted.groupBy("root").agg(F.min("smallest").alias("component_id")), "names"), "root")


#: For a similarity of 0.8 of five-word shingles: 256 bits, of which such pairs differ in 39 on average, with a deviation of 6.
WIDE_WORDS, WIDE_RADIUS, SIMILARITY = 4, 52, 0.8


def set_nodes(wide: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """A 64-bit name of each shingle set, from its fingerprint and a 32-bit hash of the set."""
    return mix(folded(wide) + tag.astype(U64))


def set_tags(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([mix(np.atleast_1d(x.sum(dtype=U64) + U64(len(x))))[0] >> U64(32) for x in sets], np.uint32)


def shingle_sets(docs: DataFrame, shingle: int, words: int, seed: int = SEED, full: bool = False) -> DataFrame:
    """(doc_id, text_tag, node, tag, wide) per document; full: (node, shingles array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200 if full else 1000):
            sets: list[np.ndarray] = []
            wide = fingerprints_of(texts_of(b["text"]), shingle, seed, words, sets)
            tag = set_tags(sets)
            node = pa.array(set_nodes(wide, tag).view(np.int64))
            if full:
                yield pa.record_batch([node, pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "shingles"])
            else:
                yield pa.record_batch([b["doc_id"], b["text_tag"], node, pa.array(tag.view(np.int32)), pa.array([w.tobytes() for w in wide], pa.binary())], names=["doc_id", "text_tag", "node", "tag", "wide"])

    schema = "node long, shingles array<long>" if full else "doc_id long, text_tag long, node long, tag int, wide binary"
    return docs.select(F.col("doc_id").cast("long"), text_tag().alias("text_tag"), F.col("text").cast("string")).mapInArrow(run, schema)


def candidates(nodes: DataFrame, masks: np.ndarray, radius: int) -> DataFrame:
    """(a long, b long): a spanning forest of the pairs within the radius in each bucket, from nodes (tag int, wide binary).

    As links, but a row travels without its key and name, which are computed again.
    """
    parts = shuffle_partitions(nodes.sparkSession)
    words = masks.shape[1]
    row = np.dtype([("table", "u2"), ("tag", "u4"), ("wide", "u8", (words,))])
    tables = np.arange(len(masks)).astype(U64)

    def keys(rows: np.ndarray) -> np.ndarray:
        return mix(folded(rows["wide"] & masks[rows["table"]]) + tables[rows["table"]])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = np.empty((len(masks), b.num_rows), row)
            out["table"] = np.arange(len(masks))[:, None]
            out["tag"] = b["tag"].to_numpy().view(np.uint32)
            out["wide"] = np.frombuffer(b"".join(b["wide"].to_pylist()), U64).reshape(-1, words)
            out = out.ravel()
            bucket = ((keys(out) >> U64(32)) * U64(4 * parts) >> U64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            out, bucket = out[order], bucket[order]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(bucket[at]), pa.array([out[i:j].tobytes() for i, j in zip(at, [*at[1:], len(out)], strict=True)], pa.binary())], names=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for bucket, blob in zip(b["bucket"].to_pylist(), b["blob"].to_pylist(), strict=True):
                held.setdefault(bucket, []).append(blob)
        forest: dict[int, int] = {}
        while held:
            rows = np.frombuffer(b"".join(held.popitem()[1]), row)
            key = keys(rows)
            order = np.argsort(key, kind="stable")
            rows, key = rows[order], key[order]
            node = set_nodes(rows["wide"], rows["tag"])
            named = np.empty(len(rows), np.dtype([("key", "u8"), ("node", "u8"), ("wide", "u8", (words,))]))
            named["key"], named["node"], named["wide"] = key, node, rows["wide"]
            pairs = np.array([p for p in bucket_links(named, radius).tolist() if joined(forest, *p)], U64).reshape(-1, 2)
            yield pa.record_batch([pa.array(pairs[:, k].view(np.int64)) for k in (0, 1)], names=["a", "b"])

    dealt = nodes.select("tag", "wide").mapInArrow(deal, "bucket int, blob binary")
    return dealt.repartition(parts, "bucket").mapInArrow(run, "a long, b long")


def thinned(edges: DataFrame, name: str) -> DataFrame:
    """A spanning forest of edges (a, b) that many tasks found alike: they are stored, and each task that reads a stretch of them again keeps a forest of that stretch. So a group keeps a forest for each stretch and not for each task that met it; a stretch is bounded by the size of a file split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: dict[int, int] = {}
        for b in batches:
            keep = [joined(forest, i, j) for i, j in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return materialise(edges, f"{name}-found").mapInArrow(run, "a long, b long").distinct()


def joined(up: dict[int, int], i: int, j: int) -> bool:
    """Join i and j in a forest that grows; whether they were apart."""
    roots = []
    for x in (i, j):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        roots.append(x)
    up[max(roots)] = min(roots)
    return roots[0] != roots[1]


def sets_of(ends: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, words: int) -> DataFrame:
    """(node, shingles) of the nodes in ends (node); nodes: (node, smallest), one document of each set."""
    did = fresh(docs.columns, "did")
    wanted = nodes.join(ends, "node", "left_semi").select(F.coalesce("smallest", F.lit(NULL_ID)).alias(did)).distinct()
    texts = docs.withColumn(did, doc_key()).join(wanted, did, "left_semi")
    sets = shingle_sets(texts, shingle, words, full=True).join(ends, "node", "left_semi").dropDuplicates(["node"])
    return materialise(sets, "shingle-sets")


#: Members of a block of the second round.
BLOCK = 128


def linked_in_blocks(members: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, words: int, similarity: float) -> DataFrame:
    """(a, b): links of at least this similarity that join members (node, within, label) of one component `within` and different labels."""
    blocks = members.groupBy("within").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(blocks, "within").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meet = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.select("node", "within", "label", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    sets = sets_of(members.select("node"), docs, nodes, shingle, words)

    def run(rows: pa.Table) -> pa.Table:
        lists = rows["shingles"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        some = np.flatnonzero(size)  # an empty set is like no other
        node, label = rows["node"].to_numpy()[some], rows["label"].to_numpy()[some]
        _, ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        size = size[some]
        first = np.cumsum(size) - size
        mark = np.zeros(len(ids) + 1, bool)
        forest: dict[int, int] = {}
        found: list[tuple[int, int]] = []
        for i in range(len(node) - 1):
            mine = ids[first[i] : first[i] + size[i]]
            mark[mine] = True
            same = np.add.reduceat(mark[ids[first[i + 1] :]].astype(np.int64), first[i + 1 :] - first[i + 1])
            mark[mine] = False
            other = size[i + 1 :]
            near = (same >= similarity * (size[i] + other - same) - 1e-9) & (label[i + 1 :] != label[i])
            found += [(int(node[i]), int(node[j])) for j in (np.flatnonzero(near) + i + 1).tolist() if joined(forest, int(label[i]), int(label[j]))]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return meet.join(sets, "node").groupBy("within", "low", "high").applyInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least this Jaccard similarity. nodes: (node, smallest), one document of each set."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = sets_of(ends, docs, nodes, shingle, words)
    a, b = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}")) for k in ("a", "b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("same"), (F.size("sa") + F.size("sb")).alias("sizes"))
    return both.where(F.col("same") >= F.lit(similarity) * (F.col("sizes") - F.col("same")) - F.lit(1e-9)).select("a", "b")


def alike(docs: DataFrame, shingle: int = 5, radius: int = WIDE_RADIUS, choose: int | None = None, words: int = WIDE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id long, text_tag long, node long, component_id long) per document: components of links of at least this similarity. node: one for each shingle set."""
    docs_nodes = materialise(shingle_sets(docs, shingle, words), "shingle-nodes")
    nodes = docs_nodes.groupBy("node").agg(F.min("doc_id").alias("smallest"), F.min("tag").alias("tag"), F.min("wide").alias("wide"))
    masks = block_choices(radius, choose, words) if choose else bit_samples(radius, words, nodes.count())
    loose = materialise(thinned(candidates(nodes, masks, radius), "loose"), "loose")
    sure = materialise(verified(loose, docs, nodes, shingle, words, similarity), "sure")
    strict = components(sure)
    # components of the forest that fell apart, of more than one pair
    at = components(loose).withColumnRenamed("root", "within")
    at = at.union(at.select("within", "within")).distinct()  # a root is no node of its own component
    label = at.join(strict, "node", "left").select("node", "within", F.coalesce("root", "node").alias("label"))
    apart = label.groupBy("within").agg(F.count("*").alias("n"), (F.min("label") < F.max("label")).alias("apart")).where("apart AND n > 2").select("within")
    again = materialise(label.join(apart, "within", "left_semi").select("node", "within", "label"), "again")
    if again.count():
        more = materialise(linked_in_blocks(again, docs, nodes, shingle, words, similarity), "more")
        strict = components(sure.union(more))
    rooted = nodes.join(strict, "node", "left").select("node", "smallest", F.coalesce("root", "node").alias("root"))
    named = materialise(with_names(rooted).select("node", "component_id"), "named")
    return docs_nodes.join(named, "node").select("doc_id", "text_tag", "node", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, radius: int = WIDE_RADIUS, choose: int | None = None, words: int = WIDE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """documents, one of each group of `alike`: the smallest doc_id stays (of different texts that share it, that with the smallest hash; of equal rows, one). Groups of null ids alone keep all rows.

    Ids and hashes of texts decide; texts themselves are shuffled only where a row stands several times.
    """
    found = alike(docs, shingle, radius, choose, words, similarity)
    copies = found.where("doc_id = component_id").groupBy("doc_id", "text_tag").agg(F.count("*").alias("copies"))
    stay = copies.groupBy("doc_id").agg(F.min(F.struct("text_tag", "copies")).alias("s")).select("doc_id", "s.text_tag", "s.copies")
    nameless = found.where("component_id IS NULL").select(F.lit(NULL_ID).alias("doc_id"), "text_tag", F.lit(1).cast("long").alias("copies")).distinct()
    did, tag, n = (fresh(docs.columns, c) for c in ("did", "tag", "copies"))
    stay = materialise(stay.unionByName(nameless).select(F.col("doc_id").alias(did), F.col("text_tag").alias(tag), F.col("copies").alias(n)), "stay")
    kept = docs.withColumns({did: doc_key(), tag: text_tag()}).join(stay, [did, tag])
    once, several = kept.where(F.col(n) == 1), kept.where(F.col(n) > 1).dropDuplicates([did, tag])
    return once.unionByName(several).select(*docs.columns)
