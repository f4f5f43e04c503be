"""Scoring, coding, decontamination and classification against plain versions."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from voltair.llm import decontaminate, lm, pieces, quality

SCHEMA = "doc_id long, text string"
R = random.Random(8)
WORDS = [f"w{i}" for i in range(40)]
DOCS = [(i, " ".join(R.choice(WORDS) for _ in range(R.randint(0, 40)))) for i in range(120)] + [(120, None), (121, ""), (None, "w1 W2"), (5, "w1"), (5, "w1")]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_match_plain_counts(spark, order):
    tokens = lambda t: ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), "</s>"]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in DOCS]
    counts = [Counter() for _ in range(5)]
    for (_, t), h in zip(DOCS, held, strict=True):
        tk = tokens(t)
        for i in range(1, len(tk)):
            for n in range(1, order + 1):
                if not h and i - n + 1 >= 0:
                    counts[n][tuple(tk[i - n + 1 : i + 1])] += 1
        counts[1][("<s>",)] += not h
    total = sum(c for w, c in counts[1].items() if w != ("<s>",))
    types = len(counts[1]) - 1
    expected = []
    for (d, t), h in zip(DOCS, held, strict=True):
        tk, base, score = tokens(t), 0.0, 0.0
        for i in range(1, len(tk)):
            p = (counts[1][(tk[i],)] + 1) / (total + types + 1)
            base += math.log10(p)
            for n in range(2, order + 1):
                if i - n + 1 >= 0:
                    context = counts[n - 1][tuple(tk[i - n + 1 : i])]
                    p = (counts[n][tuple(tk[i - n + 1 : i + 1])] + lm.PRIOR * p) / (context + lm.PRIOR)
            score += math.log10(p)
        expected.append((str(d), h, len(tk) - 1, sum(counts[1][(w,)] > 0 for w in tk[1:]), total, base, score))
    got = sorted((str(x.doc_id), *x[1:]) for x in lm.scores(spark.createDataFrame(DOCS, SCHEMA), order=order).collect())
    for a, b in zip(sorted(expected), got, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def thue_morse(flip=False, n=1024):
    """Equal under any polynomial hash modulo a power of two, whichever way it is flipped."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_are_told_apart_by_their_bytes(spark):
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2)
    training = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 7 != 2)
    docs = spark.createDataFrame([(training, thue_morse()), (held, thue_morse(True))], SCHEMA)
    got = {x.doc_id: x for x in lm.scores(docs).collect()}
    assert got[held].n_known == 1 and got[training].n_known == 2 and got[held].train_tokens == 2


def machine_of(texts, order, prior=5.0):
    s, names, _ = lm.Shard.of(texts, np.zeros(len(texts), bool))
    grams, counts = s.grams(order), s.word_counts()
    total = np.delete(counts, s.begin)
    return s, names, lm.Automaton([counts, *(g.seen for g in grams)], grams, int(total.sum()), int((total > 0).sum()), prior)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_every_state_gives_probabilities(order):
    texts = [" ".join(R.choice(WORDS[:6]) for _ in range(30)).encode() for _ in range(30)]
    s, names, machine = machine_of(texts, order)
    words = np.array([i for i in range(len(names)) if i != s.begin])
    unseen = 1 / (int(s.count.sum()) + len(words) + 1)  # of a word never seen, at the root
    end = names.index(lm.END)  # after it nothing is read
    reached = set(machine.goal[(machine.key & (2**32 - 1)) != end].tolist()) | set(np.delete(machine.root_goal, end).tolist()) | {0}
    for state in reached:
        _, added = machine.step(np.full(len(words), state), words)
        fallen, at = 0.0, state
        while at:
            fallen, at = fallen + machine.fall[at], int(machine.fallen[at])
        assert (10**added).sum() + unseen * 10**fallen == pytest.approx(1)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lanes_of_a_long_document_score_as_one(order):
    texts = [" ".join(R.choice(WORDS[:8]) for _ in range(n)).encode() for n in (1000, 3, 0, 517)]
    s, _, machine = machine_of(texts, order)
    assert lm.traverse(s, machine, order, 7) == pytest.approx(lm.traverse(s, machine, order, 10_000))


def test_words_of_a_shard_are_those_of_a_plain_split():
    texts = [b"B a\x0bA \xc3\x84\x00b\x1c \xc3\x84\x00b\x1c", b"", b"\r\n\f\t ", b"x" * 5000 + b" " + b"x" * 4999 + b"y x", b"a" * 1024 + b" " + b"a" * 1025]
    s, names, bucket = lm.Shard.of(texts, np.zeros(len(texts), bool), 7)
    assert [names[i] for i in s.token.tolist()] == [w for text in texts for w in (*text.lower().split(), lm.END)]
    assert s.count.tolist() == [len(text.split()) + 1 for text in texts] and names[s.begin] == lm.BEGIN
    assert list(zip(bucket.tolist(), names, strict=True)) == sorted(zip(bucket.tolist(), names, strict=True))
    again = lm.Shard.of([b"x", *texts[::-1]], np.zeros(6, bool), 7)
    assert dict(zip(names, bucket, strict=True)) == dict(zip(again[1], again[2], strict=True))


def test_words_are_counted_without_an_object_each():
    """A shard's first step takes less CPU time than a dict of its words alone."""
    r = np.random.default_rng(1)
    texts = [" ".join(map(str, r.integers(0, 10**7, 1000))) for _ in range(300)]
    documents = pa.record_batch([pa.array(range(300)), pa.array(texts), pa.array([False] * 300)], names=["doc_id", "text", "held_out"])

    def plain():
        number = {}
        for text in texts:
            for w in text.encode().lower().split():
                number.setdefault(w, len(number))
        return sorted(number)

    def seconds(f):
        began = time.thread_time()
        f()
        return time.thread_time() - began

    assert min(seconds(lambda: lm.shard_rows([documents], 0, 10)) for _ in range(5)) < min(seconds(plain) for _ in range(5))


def test_shards_of_any_size_give_the_same_scores(spark):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in DOCS], "doc_id long, text string, shard int, held_out string")
    one, many = (sorted((str(x.doc_id), *x[1:]) for x in lm.scores(df, shard_bytes=size).collect()) for size in (1 << 30, 500))
    assert [x[:5] for x in one] == [x[:5] for x in many]
    assert [x[6] for x in one] == pytest.approx([x[6] for x in many])


def test_empty_corpus(spark):
    assert lm.scores(spark.createDataFrame([], SCHEMA)).count() == 0


VOCABULARY = pieces.Vocabulary.read(pieces.MODEL)
TEXTS = ["", "a", "Hello world, this is fine", "▁x ▁▁", "naïve 漢字かな\U0001f600 \x00\x01", "a" * 100, "supercalifragilistic" * 5, " lead  two   three\n\ttab", "é" * 50]
TEXTS += ["".join(chr(R.choice([97, 98, 32, 0x4E2D, 0x2581, 233, 0x1F600])) for _ in range(80)) for _ in range(20)]


def best_ids(text, v):
    s = b" " + text.encode() if text else b""
    best = [(0.0, [])]
    for end in range(1, len(s) + 1):
        choice = None
        for start in range(max(0, end - v.longest), end):
            hit = v.pieces.get(s[start:end])
            if hit and (choice is None or best[start][0] + hit[1] > choice[0]):
                choice = (best[start][0] + hit[1], [*best[start][1], hit[0]])
        if choice is None or best[end - 1][0] + v.byte_score > choice[0]:
            choice = (best[end - 1][0] + v.byte_score, [*best[end - 1][1], v.byte_ids[s[end - 1]]])
        best.append(choice)
    return best[-1][1]


def test_pieces_are_the_best_path_and_decode_to_the_text():
    got = list(pieces.encode([t.encode() for t in TEXTS], VOCABULARY))
    for ids, text in zip(got, TEXTS, strict=True):
        assert ids.tolist() == best_ids(text, VOCABULARY)
        assert pieces.decode(ids, VOCABULARY).decode() == text
        if text:
            assert list(pieces.stream(b" " + text.encode(), VOCABULARY)) == ids.tolist()


def test_piece_columns(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, ids int")
    coded = pieces.tokenise(df)
    assert coded.columns == ["doc_id", "text", "ids", "_ids"]
    for x in pieces.detokenise(coded, ids_name="_ids").collect():
        assert x.decoded == (x.text or "") and x.ids == 1
    assert all(x.round_trip for x in pieces.digests(df).collect())
    assert pieces.digests(df.where("false")).count() == 0


ITEMS = [(0, "the quick brown fox jumps over the lazy dog and then sleeps all day"), (10, "Short item!"), (2, ""), (3, None), (4, "short ITEM")]
TEXT = "x The quick-brown fox jumps over the LAZY dog and then stays. short item, again"


def plain_hits(text, items, n=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hit, names = set(), set()
    for name, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in item or ""))
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == w[i : i + k]:
                    hit |= set(range(j, j + k))
                    names.add(str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("windows", [1_000_000, 3])
def test_decontamination_matches_plain_search(spark, windows):
    docs = [(1, TEXT), (2, "clean text"), (3, None), (4, ""), (5, "short"), (6, "item short item"), (6, "item short item"), (None, ITEMS[0][1])]
    got = decontaminate.scan(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string"), max_windows=windows)
    expected = sorted((str(d), *plain_hits(t, ITEMS)) for d, t in docs)
    assert sorted((str(x.doc_id), *x[1:]) for x in got.collect()) == expected


def test_benchmark_passages_are_cut(spark):
    df = spark.createDataFrame([(1, TEXT, 3), (2, "clean text", 3), (3, None, 3)], "doc_id long, text string, n_chars int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {x.doc_id: (x.text, x.n_chars) for x in decontaminate.remove_spans(df, items).collect()}
    assert got == {1: ("x  stays. , again", 17), 2: ("clean text", 10), 3: (None, None)}
    assert decontaminate.scan(df.where("false"), items).count() == 0
    assert decontaminate.scan(df, items.where("false")).where("contaminated").count() == 0


@pytest.mark.parametrize("windows", [1_000_000, 8, 3])
def test_cuts_do_not_depend_on_blocks(spark, windows):
    words = [f"w{i}" for i in range(1, 31)]
    # overlapping items; and one that would match only where a cut made neighbours
    items = [(k, " ".join(words[a:b])) for k, (a, b) in enumerate([(0, 20), (10, 30), (4, 16), (19, 29)])] + [(9, "left " + " ".join(words[25:30]))]
    docs = [(1, " ".join(words[:25]), 3), (2, "x " + ", ".join(words) + " y", 3), (3, "left " + " ".join(words[:20]) + " " + " ".join(words[25:30]), 3), (4, None, 3), (5, TEXT, 3), (6, " ".join(words[12:28]), 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars int")
    many = spark.createDataFrame([*items, *ITEMS], "item_id long, text string")
    out = decontaminate.remove_spans(df, many, max_windows=windows)
    got = {x.doc_id: x.text for x in out.collect()}
    assert out.columns == df.columns
    assert got == {1: "", 2: "x  y", 3: "left  " + " ".join(words[25:30]), 4: None, 5: "x  stays. , again", 6: ""}


def test_quality_learns_and_scores_whole_texts(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.predictions(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert (good >= 0.7).mean() > 0.9
    net = quality.train(docs, labels, per_class=20, epochs=1)
    clean, noise = b"the and of " * 2000, b"%%% $$$ " * 400
    assert net.score([clean]) != net.score([clean + noise])  # the end of a long text counts
    assert 0 <= net.score([b""])[0] <= 1 and net.score([]).tolist() == []


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "x", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert [x.score for x in quality.predictions(docs, labels).collect()] == [1.0, 1.0]
    assert quality.keep(docs, labels).columns == docs.columns


def test_gradients_match_differences():
    net = quality.Net(quality.Shape(width=3, stride=2, half=2, embedding=2, filters=2))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts, y, w = [b"abcabcabcabd", b"xyz", b"aaaaaaaaaaaaaaaaaaaaab"], np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])

    def loss():
        p = net.probability(net.pooled(texts))
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    g = net.gradients(texts, y, w)
    for name in ("filter", "out", "bias", "embed"):
        flat = net.p[name].reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 7)):
            keep = flat[i]
            flat[i] = keep + 1e-3
            up = loss()
            flat[i] = keep - 1e-3
            down = loss()
            flat[i] = keep
            assert g[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-3, abs=2e-3)
