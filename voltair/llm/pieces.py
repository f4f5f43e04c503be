"""SentencePiece encoding and decoding by streaming Viterbi over a given vocabulary.

The vocabulary (pieces and scores) is read from a public model file; nothing is
trained. A text is coded as the sequence of pieces with the greatest sum of scores
(the segmentation of a unigram model; with a BPE model's file, whose scores are
merge ranks, the ids are those of this path and not of that library's merge order);
among equal sums the one whose last piece is longest, applied at every boundary.
Spaces stand for the word mark of the pieces, and a space is put before the text as
SentencePiece does. Bytes that no piece covers are coded by byte pieces at a
penalty, so every text decodes to itself; a literal word mark in a text is coded by
its bytes.

Streaming: pieces are matched by a byte trie, so a match is exact. The search reads
a text byte by byte and retains, for the boundaries in the window of the longest
piece, the score, the trie walks that are still open, and the boundaries on the best
path. Every few bytes the paths of all boundaries that can still begin or end a
piece are intersected; where they meet in a boundary, the ids up to it are final:
they are committed and the window moves on.

The same search runs for many texts side by side, one byte a step. A long text is
several lanes: between two bytes that stand side by side in no piece every path has
a boundary, so lanes begin there. A lane whose paths don't meet within the window's
64 boundaries (or that outlasts the others) goes on alone from its last commit, with
backpointers for as long as its paths stay apart.

Defined cases: null and empty texts have no ids; other columns pass through; very
long texts are coded in runs of about a megabyte, cut where a lane may begin; repeated
rows are coded one by one; empty tables give empty results. With pieces of 64 bytes and
more every lane goes on alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, fresh, slices, texts_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Boundaries whose backpointers a lane retains (bits of a word), bytes between two looks for a common boundary, bytes of a lane, lanes below which each goes on alone.
WINDOW, LOOK, LANE, FEW = 64, 8, 128, 24
#: Bytes of texts coded at once.
RUN = 1 << 20
#: Added to the worst piece score for each byte coded by its byte piece.
PENALTY = -10.0


class Vocabulary:
    """Pieces as bytes (word mark: space), their ids and scores; fixed size, shipped to the executors."""

    def __init__(self, pieces: dict[bytes, tuple[int, float]], byte_ids: list[int], prefix: bool = True):
        self.pieces, self.byte_ids, self.prefix = pieces, byte_ids, prefix
        self.longest = max(map(len, pieces), default=1)
        self.byte_score = min((s for _, s in pieces.values()), default=0.0) + PENALTY
        self.glued = np.zeros((256, 256), bool)  # byte pairs that stand within some piece
        for p in pieces:
            for a, b in zip(p, p[1:], strict=False):
                self.glued[a, b] = True
        self.strings = {i: p for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}

    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(child of node and byte, 0: none; score of node, -inf: no piece; id of node; nodes below this number have children). Built once a process, not shipped."""
        if not hasattr(self, "_trie"):
            inner = sorted({p[:i] for p in self.pieces for i in range(len(p))} | {b""})  # the root is first, and no node's child
            names = inner + sorted(set(self.pieces) - set(inner))
            number = {p: i for i, p in enumerate(names)}
            child = np.zeros((len(inner), 256), np.int32)
            score, ids = np.full(len(names), -np.inf), np.zeros(len(names), np.int32)
            for p, i in number.items():
                if p:
                    child[number[p[:-1]], p[-1]] = i
                if p in self.pieces:
                    ids[i], score[i] = self.pieces[p]
            self._trie = child, score, ids, len(inner)
        return self._trie

    def __getstate__(self) -> dict:
        return {k: x for k, x in self.__dict__.items() if k != "_trie"}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        import sentencepiece

        with open(path, "rb") as f:
            model = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        pieces, byte_ids = {}, [-1] * 256
        worst = 0.0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                score = model.get_score(i)
                pieces[piece.replace("▁", " ").encode()] = (i, score)
                worst = min(worst, score if score > -1e8 else 0.0)
        # user-defined runs (scores that are no ranks) count as the worst rank
        return cls({p: (i, s if s > -1e8 else worst) for p, (i, s) in pieces.items()}, byte_ids)


def stream(span: bytes, v: Vocabulary) -> Iterator[int]:
    """Ids of one span, committed as soon as all surviving paths share a boundary."""
    width = v.longest
    best = {0: 0.0}  # boundary in the window -> score
    back: dict[int, tuple[int, int]] = {}  # boundary -> (boundary before, id)
    done = 0
    for end in range(1, len(span) + 1):
        choice = None
        for start in range(max(done, end - width), end):
            if start in best:
                hit = v.pieces.get(span[start:end])
                if hit and (choice is None or best[start] + hit[1] > choice[0]):
                    choice = (best[start] + hit[1], start, hit[0])
        if end - 1 in best and (choice is None or best[end - 1] + v.byte_score > choice[0]):
            choice = (best[end - 1] + v.byte_score, end - 1, v.byte_ids[span[end - 1]])
        best[end], back[end] = choice[0], choice[1:]
        if end - width in best and end - width > done:
            best.pop(end - width, None)
        if end % 16 == 0 or end == len(span):
            alive = range(max(done, end - width + 1), end + 1) if end < len(span) else (end,)
            meet = common_boundary(alive, back, done)
            if meet > done:
                yield from path(meet, back, done)
                for b in [b for b in back if b <= meet]:
                    del back[b]
                for b in [b for b in best if b < meet]:
                    del best[b]
                done = meet


def common_boundary(alive, back: dict[int, tuple[int, int]], done: int) -> int:
    """The last boundary on the backpointer paths of all boundaries in `alive`."""
    heads = set(alive)
    while len(heads) > 1:
        last = max(heads)
        if last == done:
            return done
        heads.discard(last)
        heads.add(back[last][0])
    return heads.pop()


def path(end: int, back: dict[int, tuple[int, int]], done: int) -> list[int]:
    ids = []
    while end > done:
        end, i = back[end]
        ids.append(i)
    return ids[::-1]


def ring_bits(first: int, last: int) -> int:
    """The bits of the boundaries first .. last, fewer than WINDOW, by position modulo WINDOW."""
    bits = ((1 << (last - first + 1)) - 1) << (first % WINDOW)
    return (bits | bits >> WINDOW) & ((1 << WINDOW) - 1)


def encode_lanes(buf: np.ndarray, start: np.ndarray, length: np.ndarray, v: Vocabulary) -> np.ndarray:
    """The streaming search over many lanes side by side, longest first; for each byte of buf the id + 1 of the piece that ends with it, or 0."""
    child, piece_score, piece_id, inner = v.trie()
    byte_ids = np.array(v.byte_ids, np.int32)
    out = np.zeros(len(buf), np.int32)
    lanes = len(start)
    every = np.arange(lanes)
    best = np.zeros((WINDOW, lanes))
    step, token = np.zeros((WINDOW, lanes), np.int64), np.zeros((WINDOW, lanes), np.int32)
    trail = np.zeros((WINDOW, lanes), U64)  # boundaries on the best path, by position modulo WINDOW
    trail[0] = 1
    done, lost = np.zeros(lanes, np.int64), np.zeros(lanes, bool)
    walks: list[tuple[int, np.ndarray, np.ndarray]] = []  # (boundary, lanes, nodes) of open trie walks, oldest first

    def commit(some: np.ndarray, upto: np.ndarray) -> None:
        place, floor = upto.copy(), done[some]
        done[some] = upto
        while len(some):
            row = place % WINDOW
            out[start[some] + place - 1] = token[row, some] + 1
            place -= step[row, some]
            more = place > floor
            some, place, floor = some[more], place[more], floor[more]

    active = np.searchsorted(-length, -np.arange(int(length.max(initial=0)) + 2), side="right")  # lanes of at least t bytes
    t = 0
    while v.longest < WINDOW and t + 1 < len(active) and active[t + 1] > FEW:  # longer pieces don't fit the window: each lane alone
        t += 1
        n, row = int(active[t]), t % WINDOW
        byte = buf[start[:n] + (t - 1)]
        now, ended, using = best[row], step[row], token[row]
        now[:n] = -np.inf
        walks.append((t - 1, every[:n], np.zeros(n, np.int32)))
        still = []
        for begun, lane, node in walks:
            if active[t - 1] != n and len(lane) and lane[-1] >= n:
                lane = lane[: np.searchsorted(lane, n)]
                node = node[: len(lane)]
            node = child[node, byte[lane]]
            on = np.flatnonzero(node)
            lane, node = lane[on], node[on]
            total = best[begun % WINDOW][lane] + piece_score[node]
            better = np.flatnonzero(total > now[lane])
            some = lane[better]
            now[some], ended[some], using[some] = total[better], t - begun, piece_id[node[better]]
            open_ = np.flatnonzero(node < inner)
            if len(open_):
                still.append((begun, lane[open_], node[open_]))
        walks = still
        alone = best[(t - 1) % WINDOW][:n] + v.byte_score
        some = np.flatnonzero(alone > now[:n])
        now[some], ended[some], using[some] = alone[some], 1, byte_ids[byte[some]]
        # bits of the boundaries that the piece steps over stood for older ones
        kept = np.array([ring_bits(t - k + 1, t) ^ (2**64 - 1) for k in range(v.longest + 1)], U64)
        trail[row, :n] = trail[(t - ended[:n]) % WINDOW, every[:n]] & kept[ended[:n]] | U64(1 << row)
        if t % LOOK == 0:
            common = trail[row, :n].copy()
            for begun, lane, _ in walks:
                common[lane] &= trail[begun % WINDOW][lane] & U64(ring_bits(begun + 1, t) ^ (2**64 - 1))
            turned = common << U64(63 - row) | common >> U64(row + 1) if row < 63 else common  # this boundary as the highest bit
            high = np.frexp((turned & ~(turned >> U64(1))).astype(np.float64))[1] - 1
            meet = np.where(turned > 0, t - 63 + high, 0)
            fresh_ = np.flatnonzero((meet > done[:n]) & ~lost[:n])
            commit(fresh_, meet[fresh_])
            lost[:n] |= t + LOOK - done[:n] > WINDOW
        over = every[active[t + 1] : n] if t + 1 < len(active) else every[:n]
        over = over[~lost[over]]
        if len(over):
            commit(over, np.full(len(over), t))
    raw = None
    for lane in np.flatnonzero(done < length).tolist():  # alone, from the last commit
        raw = buf.tobytes() if raw is None else raw
        at = int(start[lane] + done[lane])
        for i in stream(raw[at : int(start[lane] + length[lane])], v):
            at += len(v.strings[i])
            out[at - 1] = i + 1
    return out


def runs(texts: list[bytes], v: Vocabulary) -> Iterator[tuple[list[bytes], list[int]]]:
    """(parts, index of each part's text): parts of about RUN bytes together; a longer text is cut where a lane may begin."""
    parts, owner, size = [], [], 0
    for i, text in enumerate(texts):
        text = b" " + text if v.prefix and text else text
        at = 0
        while at < len(text):
            stop = len(text)
            if stop - at > 2 * RUN:
                look = at + RUN
                while look < stop - 1 and v.glued[text[look - 1], text[look]]:
                    look += 1
                stop = look
            parts.append(text[at:stop])
            owner.append(i)
            size += stop - at
            at = stop
            if size >= RUN:
                yield parts, owner
                parts, owner, size = [], [], 0
    if parts:
        yield parts, owner


def encode_run(parts: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the parts, none of them empty, and how many each."""
    buf = np.frombuffer(b"".join(parts), np.uint8)
    part_at = np.cumsum([0, *map(len, parts)])
    free = np.empty(len(buf), bool)  # a lane may begin here
    free[0] = True
    free[1:] = ~v.glued[buf[:-1], buf[1:]]
    free[part_at[:-1]] = True
    spots = np.flatnonzero(free)
    # parts, cut at the first such place after each LANE bytes
    grid = np.concatenate([np.arange(a, b, LANE) for a, b in zip(part_at[:-1], part_at[1:], strict=True)])
    start = np.unique(spots[np.minimum(np.searchsorted(spots, grid), len(spots) - 1)])
    length = np.diff(np.append(start, len(buf)))
    order = np.argsort(-length, kind="stable")
    out = encode_lanes(buf, start[order], length[order], v)
    ends = np.flatnonzero(out)
    return out[ends] - 1, np.diff(np.searchsorted(ends, part_at))


def encode(texts: list[bytes], v: Vocabulary) -> Iterator[np.ndarray]:
    held: list[list[np.ndarray]] = [[] for _ in texts]
    at = 0
    for parts, owner in runs(texts, v):
        ids, counts = encode_run(parts, v)
        for i, mine in zip(owner, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            while at < i:  # texts before this one are complete
                yield joined_ids(held[at])
                held[at] = []
                at += 1
            held[i].append(mine)
    for h in held[at:]:
        yield joined_ids(h)


def joined_ids(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def decode(ids: np.ndarray, v: Vocabulary) -> bytes:
    text = b"".join(map(v.strings.__getitem__, ids.tolist()))
    return text[1:] if v.prefix and text else text


def tokenise(docs: DataFrame, model: str = MODEL, ids_name: str = "ids", keep_text: bool = True) -> DataFrame:
    """documents with `ids` array<int>. model: path of the vocabulary file, read on the driver and shipped (bounded by the vocabulary)."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model))
    name = fresh(docs.columns, ids_name)
    scratch = fresh(docs.columns, "scratch")
    source = docs.withColumn(scratch, F.coalesce(F.col("text").cast("string"), F.lit("")))
    source = source if keep_text else source.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = list(encode(texts_of(b[scratch]), shared.value))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            at = b.schema.get_field_index(scratch)
            arrays = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=[*(n for n in b.schema.names if n != scratch), name])

    schema = source.drop(scratch).schema.add(name, T.ArrayType(T.IntegerType()))
    return source.mapInArrow(run, schema)


def detokenise(df: DataFrame, model: str = MODEL, ids_name: str = "ids", text_name: str = "decoded") -> DataFrame:
    """df with `decoded`: the text of `ids`; null ids: empty."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.read(model))
    name = fresh(df.columns, text_name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            column = b[ids_name]
            offsets, flat, valid = column.offsets.to_numpy(), column.values.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
            texts = [decode(flat[a:z], shared.value).decode() if ok else "" for a, z, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian int32), n_bytes, decoded_sha256, round_trip: encoded, then decoded from the ids."""
    coded = tokenise(docs.select("doc_id", F.col("text")), model)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model))
    schema = "doc_id long, n_tokens long, ids_sha256 string, n_bytes long, decoded_sha256 string, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, texts, rows = b["ids"], texts_of(b["text"]), []
            offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            for i, text in enumerate(texts):
                mine = flat[offsets[i] : offsets[i + 1]]
                back = decode(mine, shared.value)
                rows.append((len(mine), hashlib.sha256(mine.astype("<i4").tobytes()).hexdigest(), len(back), hashlib.sha256(back).hexdigest(), back == text))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "n_bytes", "decoded_sha256", "round_trip"])

    return coded.mapInArrow(run, schema)
