"""LM scoring with a weighted backoff automaton over word n-grams.

The model. Unigrams: P(w) = (c(w) + 1) / (N + V + 1), unknown words one class. For
longer contexts, a Dirichlet prior of weight K around the next shorter one:
P(w | h) = (c(h w) + K * P(w | h')) / (c(h) + K). Each row of probabilities sums to
one. As an automaton: the root and every n-gram shorter than the order that is seen
in training are states; the state of context h has an arc for each seen h w, with
the weight above, to the state of the longest suffix of h w that is one; and a
failure arc to the state of h' with weight K / (c(h) + K). The root has an arc for
every word. A document is read once from left to right: from the state reached so
far take the word's arc, or follow failure arcs until one has it, and add up the
logarithms.

The corpus's n-grams fit no broadcast, so documents are dealt to shards of bounded
size, and each shard asks only for what its own texts need:

1. a shard (some megabytes of texts that stand together in the table) is written as
   token numbers, and sends each of its distinct words once, as strings, with its
   training count; the words' buckets add the counts up and return to each shard a
   number for each word, the same in all shards, and the total;
2. the shard sends each of its distinct longer n-grams once, as the numbers of its
   words, and their buckets return the totals. So words are told apart by their
   bytes and n-grams by their words, never by hashes, and frequent ones are
   pre-aggregated to one entry a shard;
3. the shard builds the automaton of the n-grams it holds (states, arcs, failure
   arcs) and runs its documents through it, many side by side, a token a step. A long
   document is several lanes: a state depends on order - 1 tokens at most, so a lane
   first reads as many tokens before its own, without adding their weights.

Defined cases: null or wordless text is one end token; a null doc_id counts as
training; an empty table gives no rows, a table without training rows N = V = 0;
repeated rows count as often as they stand there; a very long text makes a shard of
its own size; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE, MIX_1, U64, Words, materialise, mix, powers, shuffle_partitions, sized, texts_of, word_table
from .segments import from_planes, planes

ORDER, PRIOR = 3, 5.0
FOLDS, HELD_OUT = 7, 2
#: Bytes of texts of a shard, and shards for each bucket of words or n-grams.
SHARD_BYTES, SHARDS_A_BUCKET = 6 << 20, 3
#: Names of the end token and of the start of a document; no word has them.
END, BEGIN = b"", b"\n"
#: Bytes of a word beyond which it is hashed by itself.
LONG_WORD = 1 << 10
#: Tokens of a lane.
LANE = 256
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """crc32 of doc_id as text leaves remainder `fold`; null: no."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Byte strings that stand one behind the other."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def word_buckets(words: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each of some words, none of them empty, by a hash of its bytes."""
    key, lengths = np.zeros(len(words), U64), pc.binary_length(words).to_numpy()
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        key[i] = xxhash.xxh3_64_intdigest(words[i].as_py())
    short = lengths <= LONG_WORD
    if short.any():
        few, lengths = words.filter(pa.array(short)), lengths[short]
        stop = np.cumsum(lengths)
        at = np.arange(stop[-1]) - np.repeat(stop - lengths, lengths)
        data = np.frombuffer(few.buffers()[2], np.uint8, stop[-1])
        key[short] = np.add.reduceat(BYTE_CODE[data] * powers(LONG_WORD)[0][at], stop - lengths)
    return ((mix(key) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


class Shard:
    """The tokens of some documents: `token` numbers with an end after each document, `count` tokens a document, `held` out or not. words: distinct ones; begin: number of the begin mark."""

    def __init__(self, token: np.ndarray, count: np.ndarray, held: np.ndarray, words: int, begin: int):
        self.token, self.count, self.held, self.words, self.begin = token, count, held, words, begin
        self.first = np.cumsum(count) - count
        self.age = np.arange(len(token)) - np.repeat(self.first, count)
        self.training = np.repeat(~held, count)

    @classmethod
    def of(cls, texts: list[bytes], held: np.ndarray, buckets: int = 1) -> tuple[Shard, list[bytes], np.ndarray]:
        """The shard of some texts, the names of its words, and their buckets; words are numbered by bucket and name."""
        shard, names, bucket = cls.coded(texts, held, buckets)
        return shard, names.to_pylist(), bucket

    @classmethod
    def coded(cls, texts: list[bytes], held: np.ndarray, buckets: int) -> tuple[Shard, pa.Array, np.ndarray]:
        """`of` without an object a word."""
        text = Words(texts, lower=True)
        coded = strings(text.buf[word_table("space")[text.buf]], text.stop - text.start).dictionary_encode()  # told apart by their bytes
        names = pa.concat_arrays([pa.array([END, BEGIN], pa.large_binary()), coded.dictionary])
        count = text.count[: len(texts)] + 1
        flat = np.zeros(len(coded) + len(texts), np.int32)  # 0: an end
        inside = np.ones(len(flat), bool)
        inside[np.cumsum(count) - 1] = False
        flat[inside] = coded.indices.to_numpy() + 2
        del text
        order = pc.array_sort_indices(names).to_numpy().astype(np.int64)
        bucket = np.concatenate([[0, 0], word_buckets(coded.dictionary, buckets)])[order]
        by_bucket = np.argsort(bucket, kind="stable")
        order, bucket = order[by_bucket], bucket[by_bucket]
        names = names.take(pa.array(order))
        place = np.empty(len(names), np.int32)
        place[order] = np.arange(len(names), dtype=np.int32)
        token = place[flat]
        return cls(token, count, held, len(names), int(place[1])), names, bucket

    def word_counts(self) -> np.ndarray:
        """How often each word stands in training; the begin mark once a document."""
        out = np.bincount(self.token[self.training], minlength=self.words)
        out[self.begin] = int((~self.held).sum())
        return out

    def pack(self, doc_id: pa.Array) -> bytes:
        head = np.array([len(self.count), len(self.token), self.words, self.begin], "<i8").tobytes()
        known = doc_id.is_valid().to_numpy(zero_copy_only=False)
        return zipped(head, planes(doc_id.fill_null(0).to_numpy()), known.tobytes(), self.held.tobytes(), planes(self.count), planes(self.token))

    @classmethod
    def unpack(cls, blob: bytes) -> tuple[Shard, pa.Array]:
        raw = unzipped(blob)
        d, t, words, begin = np.frombuffer(raw, "<i8", 4).tolist()
        known, held = np.frombuffer(raw, bool, 2 * d, 32 + 8 * d).reshape(2, d)
        doc_id = pa.array(from_planes(raw, "i8", d, 32), pa.int64(), mask=~known)
        return cls(from_planes(raw, "i4", t, 32 + 18 * d), from_planes(raw, "i8", d, 32 + 10 * d), held, words, begin), doc_id

    def grams(self, order: int) -> list[Grams]:
        """Distinct n-grams for n = 2 .. order; the begin mark stands before a document's first word."""
        out: list[Grams] = []
        last, valid = self.token.astype(np.int64), np.ones(len(self.token), bool)
        for n in range(2, order + 1):
            prefix = np.roll(last, 1)
            if n == 2:
                prefix[self.age == 0] = self.begin
            else:
                valid = self.age >= n - 2
            at = np.flatnonzero(valid)
            key = prefix[at] << 32 | self.token[at]
            by_key = np.argsort(key)
            new = np.ones(len(at), bool)
            new[1:] = key[by_key][1:] != key[by_key][:-1]
            heads = np.flatnonzero(new)
            found = np.full(len(self.token), -1, np.int64)
            found[at[by_key]] = np.cumsum(new) - 1
            some = at[by_key[heads]]
            seen = np.add.reduceat(self.training[at[by_key]].astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
            out.append(Grams(prefix[some], self.token[some].astype(np.int64), last[some], seen))
            last = found
        return out


class Grams:
    """Distinct n-grams of a shard: number of the (n-1)-gram before the last word, the last word, number of the (n-1)-gram that is the suffix, and count in the shard's training rows."""

    def __init__(self, prefix: np.ndarray, word: np.ndarray, suffix: np.ndarray, seen: np.ndarray):
        self.prefix, self.word, self.suffix, self.seen = prefix, word, suffix, seen


def zipped(*parts: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def unzipped(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def sorted_by(columns: list[np.ndarray]) -> np.ndarray:
    """The order of different rows of numbers; columns are compared as one where their bits fit into a word."""
    keys: list[np.ndarray] = []
    room = 0
    for c in columns:
        bits = int(c.max(initial=1)).bit_length()
        if keys and bits <= room:
            keys[-1] = keys[-1] << U64(bits) | c.astype(U64)
            room -= bits
        else:
            keys.append(c.astype(U64))
            room = 64 - bits
    return np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])


#: n: 0 for a shard's tokens, 1 for words, 2 and more for n-grams.
ROW = "shard long, bucket int, n int, tokens long, types long, blob binary"
_ROW = pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("tokens", pa.int64()), ("types", pa.int64()), ("blob", pa.binary())])


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_ROW)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ROW, strict=True)], schema=_ROW)


def runs_of(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if not len(bucket):
        return
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    yield from zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True)


def gathered(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[list[dict]]:
    """The rows of each group of a partition that holds whole groups; blobs stay compressed until their group's turn."""
    held: dict[tuple, list[dict]] = {}
    for b in batches:
        for row in b.to_pylist():
            held.setdefault(tuple(row[c] for c in by), []).append(row)
    while held:
        yield held.popitem()[1]


def ask_words(buckets: int, shard_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Step 1, where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, size = TaskContext.get().partitionId(), 0, 0
        held: list[pa.RecordBatch] = []
        for b in sized(batches, shard_bytes // 4):
            held.append(b)
            size += b.nbytes
            if size >= shard_bytes:
                yield shard_rows(held, part << 24 | count, buckets)
                held, count, size = [], count + 1, 0
        if sum(b.num_rows for b in held):
            yield shard_rows(held, part << 24 | count, buckets)

    return run


def shard_rows(held: list[pa.RecordBatch], shard: int, buckets: int) -> pa.RecordBatch:
    documents = pa.Table.from_batches(held).combine_chunks()
    s, names, bucket = Shard.coded(texts_of(documents["text"]), documents["held_out"].to_numpy(), buckets)
    counts = s.word_counts().astype(np.int64)
    rows = [(shard, -1, 0, 0, 0, s.pack(documents["doc_id"].combine_chunks()))]
    for b, a, z in runs_of(bucket):
        joined = pc.binary_join(pa.LargeListArray.from_arrays([0, z - a], names[a:z]), pa.scalar(b" ", names.type))
        rows.append((shard, b, 1, 0, 0, zipped((z - a).to_bytes(4, "little"), planes(counts[a:z]), joined[0].as_py(), level=5)))
    return rows_of(rows)


def tell_words(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Step 1, at a bucket: numbers, small ones for frequent words, and totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked in gathered(batches, "bucket"):
            sent = [sent_words(row["blob"]) for row in asked]
            coded = pa.concat_arrays([words for words, _ in sent]).dictionary_encode()  # told apart by their bytes
            words, code = coded.dictionary, coded.indices.to_numpy()
            total, bucket = np.zeros(len(words), np.int64), asked[0]["bucket"]
            np.add.at(total, code, np.concatenate([counts for _, counts in sent]))
            by_name = pc.array_sort_indices(words).to_numpy().astype(np.int64)
            number = np.empty(len(words), np.int64)
            number[by_name[np.argsort(-total[by_name], kind="stable")]] = np.arange(len(words)) * buckets + bucket
            counted = total[(total > 0) & pc.not_equal(words, pa.scalar(BEGIN, words.type)).to_numpy(zero_copy_only=False)]
            tokens, types, rows, at = int(counted.sum()), len(counted), [], 0
            for row, (own, _) in zip(asked, sent, strict=True):
                both = (x[code[at : at + len(own)]] for x in (number, total))
                rows.append((row["shard"], bucket, 1, tokens, types, zipped(*map(planes, both))))
                tokens = types = 0  # once a bucket
                at += len(own)
            yield rows_of(rows)

    return run


def sent_words(blob: bytes) -> tuple[pa.Array, np.ndarray]:
    raw = unzipped(blob)
    n = int.from_bytes(raw[:4], "little")
    body = np.frombuffer(raw, np.uint8, offset=4 + 8 * n)
    space = body == 0x20  # between words
    lengths = np.diff(np.flatnonzero(space), prepend=-1, append=len(body)) - 1
    return strings(body[~space], lengths), from_planes(raw, "i8", n, 4)


def word_replies(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the shard its number in the corpus and its total; words are numbered by bucket."""
    number, total = [], []
    for row in sorted((r for r in rows if r["n"] == 1), key=lambda r: r["bucket"]):
        raw = unzipped(row["blob"])
        n = len(raw) // 16
        number.append(from_planes(raw, "i8", n, 0))
        total.append(from_planes(raw, "i8", n, 8 * n))
    return np.concatenate(number), np.concatenate(total)


def gram_order(grams: list[Grams], number: np.ndarray, buckets: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(n, columns of word numbers, order, buckets): n-grams by bucket and words, the order in which a shard sends them and gets its replies."""
    columns = [number]
    for n, g in enumerate(grams, 2):
        columns = [*(c[g.prefix] for c in columns), number[g.word]]
        key = np.zeros(len(g.word), U64)
        for c in columns:
            key = (key ^ c.astype(U64)) * U64(MIX_1)
            key ^= key >> U64(29)
        bucket = ((mix(key) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
        order = sorted_by(columns)
        order = order[np.argsort(bucket[order], kind="stable")]
        yield n, columns, order, bucket[order]


def ask_grams(buckets: int, order: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Step 2, at a shard."""

    def run(own: pa.Table, words: pa.Table) -> pa.Table:
        out = []
        if own.num_rows:
            shard = own["shard"][0].as_py()
            s, _ = Shard.unpack(own["blob"][0].as_py())
            grams = s.grams(order)
            for n, columns, by_bucket, bucket in gram_order(grams, word_replies(words.to_pylist())[0], buckets):
                columns = [c[by_bucket] for c in (grams[n - 2].seen, *columns)]
                width = 4 if max(int(c.max(initial=0)) for c in columns) < 1 << 31 else 8
                runs, leading = list(runs_of(bucket)), columns[1]
                columns[1] = np.diff(leading, prepend=0)  # ordered within a bucket
                for _, a, _ in runs:
                    columns[1][a] = leading[a]
                columns = [planes_of(c.astype(f"i{width}")) for c in columns]
                for b, a, z in runs:
                    out.append((shard, b, n, 0, 0, zipped((z - a).to_bytes(4, "little"), bytes([width]), *(np.ascontiguousarray(c[:, a:z]).tobytes() for c in columns))))
        return pa.Table.from_batches([rows_of(out)])

    return run


def planes_of(x: np.ndarray) -> np.ndarray:
    """(bytes, rows): the bytes of numbers."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)


def tell_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, at a bucket: totals, in the order of each shard's n-grams."""
    for asked in gathered(batches, "bucket", "n"):
        n = asked[0]["n"]
        parts: list[list[np.ndarray]] = [[] for _ in range(n + 1)]  # counts, then words
        for row in asked:
            raw = unzipped(row["blob"])
            k, width = int.from_bytes(raw[:4], "little"), raw[4]
            for i in range(n + 1):
                parts[i].append(from_planes(raw, f"i{width}", k, 5 + width * k * i))
            parts[1][-1] = np.cumsum(parts[1][-1], dtype=np.int64)
        lengths = [len(c) for c in parts[0]]
        seen, *columns = (np.concatenate(p) for p in parts)
        del parts
        order = sorted_by(columns)
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in columns:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        total = np.empty(len(order), np.int64)
        total[order] = np.repeat(np.add.reduceat(seen[order].astype(np.int64), at), np.diff(np.append(at, len(order))))
        ends = np.cumsum(lengths).tolist()
        yield rows_of([(row["shard"], row["bucket"], n, 0, 0, zipped(planes(total[z - k : z]))) for row, k, z in zip(asked, lengths, ends, strict=True)])


class Automaton:
    """States, arcs and failure arcs of the n-grams of one shard, from their totals in the corpus.

    State 0 is the root; the state of an n-gram is its number, behind those of shorter
    ones. `key`: state and word of each arc, ordered; `weight`, `goal`: its logarithm
    and the state it leads to. `fall`, `fallen`: logarithm and goal of a state's failure
    arc. `root_weight`, `root_goal`: the root's arcs, by word.
    """

    def __init__(self, totals: list[np.ndarray], grams: list[Grams], tokens: int, types: int, prior: float):
        p = (totals[0] + 1) / (tokens + types + 1)
        state = np.where(totals[0] > 0, np.arange(1, len(p) + 1), 0) if grams else np.zeros(len(p), np.int64)
        self.root_weight, self.root_goal = np.log10(p), state
        fall, fallen, keys, weights, goals = [np.zeros(1)], [np.zeros(1, np.int64)], [], [], []
        if grams:
            fall.append(np.log10(prior / (totals[0] + prior)))
            fallen.append(np.zeros(len(p), np.int64))
        used = 1 + len(p)
        for n, g in enumerate(grams, 2):
            before, total = totals[n - 2], totals[n - 1]
            p = (total + prior * p[g.suffix]) / (before[g.prefix] + prior)
            longest = n == len(grams) + 1
            own = state[g.suffix] if longest else np.where(total > 0, np.arange(used, used + len(total)), state[g.suffix])
            arc = np.flatnonzero(total > 0)  # then its prefix is a state
            keys.append(state[g.prefix[arc]] << 32 | g.word[arc])
            weights.append(np.log10(p[arc]))
            goals.append(own[arc])
            if not longest:
                fall.append(np.log10(prior / (total + prior)))
                fallen.append(state[g.suffix])
                used += len(total)
            state = own
        self.fall, self.fallen = np.concatenate(fall), np.concatenate(fallen)
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.key = key[order]
        self.weight, self.goal = (np.concatenate(x)[order] if x else np.zeros(0) for x in (weights, goals))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read a word in each state: states reached and logarithms added."""
        state, added = state.copy(), np.zeros(len(word))
        waiting = np.arange(len(word))
        while len(waiting):
            at_root = state[waiting] == 0
            rooted = waiting[at_root]
            added[rooted] += self.root_weight[word[rooted]]
            state[rooted] = self.root_goal[word[rooted]]
            waiting = waiting[~at_root]
            key = state[waiting] << 32 | word[waiting]
            by_key = np.argsort(key)  # ordered keys are found side by side
            waiting, key = waiting[by_key], key[by_key]
            at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
            hit = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
            taken, at = waiting[hit], at[hit]
            added[taken] += self.weight[at]
            state[taken] = self.goal[at]
            waiting = waiting[~hit]
            added[waiting] += self.fall[state[waiting]]
            state[waiting] = self.fallen[state[waiting]]
        return state, added


def traverse(s: Shard, machine: Automaton, order: int, lane: int = LANE) -> np.ndarray:
    """The sum of logarithms of each document of the shard, read from left to right."""
    out = np.zeros(len(s.count))
    lanes = -(-s.count // lane)
    doc = np.repeat(np.arange(len(lanes)), lanes)
    own = (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * lane  # a lane's first token in its document
    warm = np.minimum(own, order - 1)
    length = np.minimum(lane, s.count[doc] - own) + warm
    by_length = np.argsort(-length, kind="stable")
    doc, own, warm, length = doc[by_length], own[by_length], warm[by_length], length[by_length]
    begin = s.first[doc] + own - warm
    state = np.where(own == warm, machine.root_goal[s.begin], 0)  # at a document's start the begin mark has been read
    score = np.zeros(len(doc))
    for t in range(int(length.max(initial=0))):
        n = int(np.searchsorted(-length, -t, side="left"))  # lanes longer than t
        state[:n], added = machine.step(state[:n], s.token[begin[:n] + t].astype(np.int64))
        score[:n] += np.where(t >= warm[:n], added, 0)
    np.add.at(out, doc, score)
    return out


def answer(buckets: int, order: int, prior: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Step 3."""
    fields = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(own: pa.Table, replies: pa.Table) -> pa.Table:
        if not own.num_rows:
            return fields.empty_table()
        s, doc_id = Shard.unpack(own["blob"][0].as_py())
        rows = replies.to_pylist()
        number, words = word_replies(rows)
        grams, totals = s.grams(order), [words]
        told = {(r["n"], r["bucket"]): r["blob"] for r in rows}
        for n, _, by_bucket, bucket in gram_order(grams, number, buckets):
            total = np.zeros(len(by_bucket), np.int64)
            for b, a, z in runs_of(bucket):
                total[by_bucket[a:z]] = from_planes(unzipped(told[n, b]), "i8", z - a, 0)
            totals.append(total)
        tokens, types = rows[0]["all_tokens"], rows[0]["all_types"]
        machine = Automaton(totals, grams, tokens, types, prior)
        base = np.add.reduceat(machine.root_weight[s.token], s.first)
        known = np.add.reduceat((words[s.token] > 0).astype(np.int64), s.first)
        columns = [s.count, known, np.full(len(s.count), tokens, np.int64), base, traverse(s, machine, order)]
        return pa.table([doc_id, pa.array(s.held), *map(pa.array, columns)], schema=fields)

    return run


def scores(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, folds: int = FOLDS, fold: int = HELD_OUT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document of documents(doc_id, text): SCORES. order: longest n-gram; prior: K."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), held_out(folds, fold).alias("held_out"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-size // (SHARDS_A_BUCKET * shard_bytes)))
    parts = max(shuffle_partitions(docs.sparkSession), SHARDS_A_BUCKET * buckets)
    to_bucket = lambda df: df.repartitionById(parts, F.col("bucket") % parts)
    first = materialise(rows.mapInArrow(ask_words(buckets, shard_bytes), ROW), "lm-shards")
    words = materialise(to_bucket(first.where("n = 1")).mapInArrow(tell_words(buckets), ROW), "lm-words")
    totals = words.agg(F.sum("tokens").alias("all_tokens"), F.sum("types").alias("all_types"))  # one row
    # tokens are shuffled once and meet both kinds of replies there
    tokens = first.where("n = 0").select("shard", "blob").repartition(parts, "shard").groupBy("shard")
    grams = tokens.cogroup(words.repartition(parts, "shard").groupBy("shard")).applyInArrow(ask_grams(buckets, order), ROW)
    told = words.unionByName(to_bucket(grams).mapInArrow(tell_grams, ROW)).crossJoin(F.broadcast(totals))
    return tokens.cogroup(told.repartition(parts, "shard").groupBy("shard")).applyInArrow(answer(buckets, order, prior), SCORES)
