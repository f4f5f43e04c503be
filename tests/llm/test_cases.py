"""Cases that operators must stand: clashing hashes, long and empty texts, null ids, clashing columns, odd records."""

import base64
import hashlib
import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltair.llm import chat, decontaminate, lm, ogg, pieces, quality, simhash, suffix_dedup, warc, window_dedup

SCHEMA = "doc_id long, text string"


def thue_morse(flip=False, n=1024):
    """Equal under any polynomial hash modulo a power of two, whichever way it is flipped."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_equal_hashes_of_different_texts_code_apart(spark):
    texts = [thue_morse(), thue_morse(True), thue_morse(n=4096), thue_morse(True, 4096)]
    v = pieces.Vocabulary.read(pieces.MODEL)
    got = list(pieces.encode([t.encode() for t in texts], v))
    assert [pieces.decode(i, v).decode() for i in got] == texts
    assert all(x.round_trip for x in pieces.digests(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect())


def test_equal_hashes_of_different_words_stay(spark):
    shared = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"{thue_morse()} {shared}"), (2, f"{thue_morse(True)} {shared}"), (3, f"{thue_morse(True)} {shared}")]
    got = {x.doc_id: x.n_removed for x in window_dedup.remove(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_clashing_content_hashes_change_nothing(spark, monkeypatch):
    from voltair.llm import segments

    made = segments.cut

    def clashing(*a, **k):
        key, content, *rest = made(*a, **k)
        return (key, np.zeros_like(content), *rest)

    monkeypatch.setattr(segments, "cut", clashing)
    r = random.Random(3)
    texts = [("ab" * r.randint(40, 90) + "".join(r.choice("abc") for _ in range(90))).encode() for _ in range(30)] * 2
    ids, plan = np.arange(60), suffix_dedup.plan()
    sent, old = segments.batch_entries(texts, ids, np.zeros(60, np.int64), plan)
    string = lambda e: texts[e["doc"]][e["start"] : e["start"] + (e["n"] & (segments.SELF - 1)) + 99]
    first = {}
    for e in sent:
        first.setdefault(string(e), (e["doc"], e["start"]))
    assert len(old) and all(string(e) in first and first[string(e)] < (e["doc"], e["start"]) for e in old)


def unigram_vocabulary():
    r = random.Random(4)
    pieces_ = {}
    for n in range(1, 8):
        for _ in range(30 if n > 1 else 3):
            pieces_["".join(r.choice("abc ") for _ in range(n)).encode()] = (len(pieces_) + 256, -float(r.randint(1, 12)) - 2 * n)
    return pieces.Vocabulary({p: (256 + k, s) for k, (p, (_, s)) in enumerate(pieces_.items())}, list(range(256)))


def test_ids_of_a_unigram_vocabulary():
    v, r = unigram_vocabulary(), random.Random(7)
    texts = ["".join(r.choice("abc d") for _ in range(r.randint(0, 400))) for _ in range(300)]
    score = {i: s for i, s in v.pieces.values()}
    for text, ids in zip(texts, pieces.encode([t.encode() for t in texts], v), strict=True):
        raw = b" " + text.encode() if text else b""
        best = [0.0]
        for end in range(1, len(raw) + 1):
            ways = [best[a] + v.pieces[raw[a:end]][1] for a in range(max(0, end - v.longest), end) if raw[a:end] in v.pieces]
            best.append(max([*ways, best[end - 1] + v.byte_score]))
        assert sum(score.get(i, v.byte_score) for i in ids.tolist()) == best[-1]
        assert pieces.decode(ids, v).decode() == text


def test_runs_and_lanes_do_not_change_ids(monkeypatch):
    v, r = pieces.Vocabulary.read(pieces.MODEL), random.Random(8)
    text = " ".join("".join(r.choice("aeionst") for _ in range(r.randint(1, 9))) for _ in range(4000)).encode()
    whole = next(iter(pieces.encode([text], v))).tolist()
    monkeypatch.setattr(pieces, "RUN", 3000)
    monkeypatch.setattr(pieces, "FEW", 0)
    assert next(iter(pieces.encode([text], v))).tolist() == whole
    monkeypatch.setattr(pieces, "LANE", 10_000)
    assert [x.tolist() for x in pieces.encode([b"", text, b"x"], v)][1] == whole


ODD_RECORDS = [
    json.dumps({"conv_id": 1, "turns": 5, "turns[].role": "x", "turns[].text": "y"}),
    json.dumps({"conv_id": 1, "turns": [3, None, {"role": "user", "text": "hi"}]}),
    json.dumps({"conv_id": True, "prompt": "a", "response": "b"}),
    json.dumps({"conv_id": 2**70, "prompt": "a", "response": "b"}),
    '{"conv_id": 3, "prompt": "\\ud800", "response": {"a": [1]}}',
    "[" * 100_000,
    '{"a":' * 3000 + "1" + "}" * 3000,
    json.dumps({"conv_id": 4, "prompt": "long " * 300_000, "response": "x"}),
]


def test_odd_records(spark):
    got = chat.format_records(spark.createDataFrame([(r,) for r in ODD_RECORDS], "record string")).collect()
    assert [len(chat.parse(x.formatted)) for x in got] == [0, 1, 2, 2, 2, 0, 0, 2]
    assert [x.conv_id for x in got] == [None, 1, None, None, 3, None, None, 4]
    assert chat.parse(got[4].formatted) == [("user", "�"), ("assistant", '{"a": [1]}')]
    assert chat.digests(chat.format_records(spark.createDataFrame([(r,) for r in ODD_RECORDS], "record string"))).count() == len(ODD_RECORDS)


def test_layouts_are_remembered_within_a_bound(monkeypatch):
    monkeypatch.setattr(chat, "LAYOUTS", 50)
    known = chat.Layouts()
    for k in range(500):
        assert known.of({"prompt", "response", f"x{k}"})[1].name == "prompt_only"
    assert len(known.known) <= 50


def test_packet_times():
    media = ogg.write(bytes(192 * 2 * 4 * 5))  # five data packets a stream
    for found in ogg.packets_of(media)[0].values():
        assert [t for _, t in found] == pytest.approx([0.0, *(0.096 * k for k in range(1, 6))])


def plain_ogg(media):
    """Payload, pages and packets by a reading of its own."""
    at, streams, pages = 0, {}, 0
    while at < len(media):
        serial, segments = struct.unpack_from("<I", media, at + 14)[0], media[at + 26]
        lacing = media[at + 27 : at + 27 + segments]
        body = at + 27 + segments
        for n in lacing:
            held = streams.setdefault(serial, [b""])
            held[-1] += media[body : body + n]
            body += n
            if n < 255:
                held.append(b"")
        at, pages = body, pages + 1
    data = [b"".join(p[1:]) for p in streams.values()]
    blocks = [[d[i : i + 192] for i in range(0, len(d), 192)] for d in data]
    out = b"".join(b for k in range(len(blocks[0])) for b in (blocks[0][k], blocks[1][k] if k < len(blocks[1]) else b""))
    return out, pages, sum(len(p) - 1 for p in streams.values()), max(len(d) for d in data) / 8000


def test_features_and_digests_are_those_of_a_plain_reading(spark):
    texts = ["", "é" * 3000, "x" * 100_000, "low \x00\x01" * 50]
    for x in ogg.digests(ogg.encode(spark.createDataFrame(list(enumerate(texts)), SCHEMA))).collect():
        media = ogg.write(ogg.padded(texts[x.doc_id].encode()))
        payload, pages, packets, seconds = plain_ogg(media)
        assert payload == ogg.padded(texts[x.doc_id].encode())
        signed = [b - 128 for b in payload]
        changes = sum((a < 0) != (b < 0) for a, b in zip(signed, signed[1:], strict=False))
        assert x.feature == f"streams=2;pages={pages};packets={packets};seconds={seconds:.6f};sum={sum(signed)};squares={sum(v * v for v in signed)};sign_changes={changes}"
        assert (x.media_bytes, x.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_records_are_fetched_by_the_index(spark):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * (i + 1)) for i in range(40)], "page_id long, url string, html string")
    stored = warc.archive(pages, archive_bytes=3000)
    index = warc.index(stored)
    assert index.columns == ["archive", "offset", "length", "record_id", "record_type"] and index.count() == 40
    (record,) = warc.fetch(stored, index.where(F.col("record_id") == warc.record_id(17))).collect()
    assert bytes(record.record).endswith(b"<p>17</p>" * 18 + b"\r\n\r\n")


def test_many_equal_pages(spark):
    pages = spark.createDataFrame([(i, "u", "" if i % 10 else f"p{i}") for i in range(300)], "page_id long, url string, html string")
    got = {x.page_id: x for x in warc.read(warc.archive(pages)).collect()}
    assert len(got) == 300 and got[1].record_type == "response" and got[299].refers_to == 1
    assert got[2].payload_digest == base64.b32encode(hashlib.sha1(b"").digest()).decode()


def test_scores_are_those_of_a_plain_forward_pass():
    net = quality.Net(quality.Shape(width=5, stride=3, half=4, embedding=3, filters=6), seed=3)
    s, p = net.shape, {k: v.astype(float) for k, v in net.p.items()}
    texts = [b"", b"a", b"hello world, this is a text", bytes(range(256)) * 3, b"x" * 47]
    for text, got in zip(texts, net.score(texts), strict=True):
        steps = max(1, -(-max(0, len(text) - s.width) // s.stride) + 1)
        halves = max(2, -(-steps // s.half))
        codes = [*text, *[quality.PAD] * (halves * s.half * s.stride + s.width - len(text))]
        answers = []
        for k in range(halves * s.half):
            window = codes[k * s.stride : k * s.stride + s.width]
            total = sum(p["embed"][c] @ p["filter"][j] for j, c in enumerate(window)) + p["bias"]
            answers.append(np.maximum(total, 0))
        chunks = [np.max(answers[h * s.half : (h + 2) * s.half], axis=0) for h in range(halves - 1)]
        z = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0)]) @ p["out"] + p["out_bias"][0]
        assert got == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)


@pytest.mark.parametrize("windows", [1_000_000, 20])
def test_one_giant_item_is_dealt_over_blocks(spark, windows):
    words = [f"w{i}" for i in range(300)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "short item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a " + " ".join(words[100:140]) + " b"), (2, " ".join(words)), (3, "the short item here")], SCHEMA)
    got = {x.doc_id: (x.n_hit, x.n_items) for x in decontaminate.scan(docs, items, max_windows=windows).collect()}
    assert got == {1: (40, 1), 2: (300, 1), 3: (2, 1)}
    assert {x.doc_id: x.text for x in decontaminate.remove_spans(docs, items, max_windows=windows).collect()} == {1: "a  b", 2: "", 3: "the  here"}
    parts, blocks = decontaminate.blocks(items, 10, windows)
    assert parts.groupBy("block").agg(F.sum("windows").alias("n")).agg(F.max("n")).first()[0] <= windows and (blocks > 1) == (windows == 20)


def test_many_null_ids_stay_apart(spark):
    """Texts of rows without an id are told apart by more than 32 bits."""
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    docs = docs.union(spark.createDataFrame([(1, passage), (2, "x " + passage + " y")], SCHEMA))
    assert suffix_dedup.digests(docs).where("n_removed > 0").select("doc_id").collect()[0].doc_id == 2
    assert window_dedup.remove(docs).where("n_removed > 0").count() == 1
    assert suffix_dedup.remove(docs).where("doc_id IS NULL").count() == 20_000
    near = simhash.keep_one(docs.limit(300))
    assert near.count() == 300


CLASHES = ["did", "tag", "spans", "copies", "fp", "node", "text_tag", "shard", "bucket", "blob", "held_out", "score", "ids", "rows", "hit", "refs", "key", "media"]


@pytest.fixture(scope="module")
def odd_docs(spark):
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(50))
    long_text = " ".join(f"w{r.randrange(5000)}" for _ in range(200_000))
    rows = [(1, long_text + " " + passage), (2, passage), (3, None), (4, ""), (4, ""), (5, " \t\n"), (None, passage), (None, None), (6, "a" * 50_000), (6, passage), (7, long_text)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES)), rows


def test_operators_stand_odd_tables(spark, odd_docs):
    docs, rows = odd_docs
    items = spark.createDataFrame([(1, " ".join(f"p{i}" for i in range(50)))], "item_id long, text string").withColumn("windows", F.lit("clash"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    by_row = {
        "suffix": suffix_dedup.digests(docs), "window": window_dedup.remove(docs), "lm": lm.scores(docs), "pieces": pieces.digests(docs), "ogg": ogg.digests(ogg.encode(docs)),
        "quality": quality.predictions(docs, labels), "scan": decontaminate.scan(docs, items), "simhash": simhash.groups(docs),
    }
    for name, df in by_row.items():
        assert sorted(str(x.doc_id) for x in df.select("doc_id").collect()) == sorted(str(d) for d, _ in rows), name
    removed = {(x.doc_id, x.n_bytes): x.n_removed for x in by_row["suffix"].collect()}
    whole = len(rows[0][1])
    assert removed[1, whole] == len(rows[6][1]) and removed[7, len(rows[10][1])] == len(rows[10][1])
    for f in (suffix_dedup.remove, simhash.keep_one, lambda d: decontaminate.remove_spans(d, items), lambda d: quality.keep(d, labels)):
        out = f(docs)
        assert out.columns == docs.columns and {x.did for x in out.select("did").collect()} == {"clash"}


def test_roles_of_the_turn_table_stay(spark):
    rows = [(1, 0, "human", "hi"), (1, 1, "gpt", "yes"), (2, 0, "user", "a"), (2, 1, "assistant", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.conv_id: x for x in chat.digests(chat.format_records(chat.records(turns))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"human\nhi\ngpt\nyes\n").hexdigest() and (got[1].loss_chars, got[2].loss_chars) == (0, 1)
    foreign = spark.createDataFrame([(json.dumps({"id": 3, "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yes"}]}),)], "record string")
    assert chat.parse(chat.format_records(foreign).first().formatted) == [("user", "hi"), ("assistant", "yes")]


@pytest.mark.parametrize("windows", [20, 1_000_000])
def test_repeated_items_count_once(spark, windows):
    words = " ".join(f"w{i}" for i in range(10))
    items = spark.createDataFrame([(1, words)] * 30 + [(2, "other " + words)], "item_id long, text string")
    assert decontaminate.blocks(items, 10, 20)[1] <= 2
    docs = spark.createDataFrame([(1, f"a {words} b"), (2, "clean")], SCHEMA)
    assert {x.doc_id: (x.n_hit, x.n_items) for x in decontaminate.scan(docs, items, max_windows=windows).collect()} == {1: (10, 2), 2: (0, 0)}


def test_repeated_labelled_rows_leave_both_classes(spark):
    ids = [i for i in range(1, 40) if __import__("zlib").crc32(str(i).encode()) % 4 != 2][:4]
    rows = [(ids[0], "good words here")] * 6 + [(ids[1], "good again")] + [(ids[2], "### bad"), (ids[3], "### worse")]
    labels = spark.createDataFrame([(ids[0], 1), (ids[1], 1), (ids[2], 0), (ids[3], 0)], "doc_id long, quality int")
    net = quality.train(spark.createDataFrame(rows, SCHEMA), labels, per_class=2, epochs=1)
    assert net.constant is None


@pytest.mark.parametrize("longest", [62, 63, 64, 65, 66, 100])
def test_pieces_as_long_as_the_window(longest):
    r = random.Random(longest)
    found = {b"a" * longest: (256, -3.0), b"ab": (257, -5.0), b"a" * 7: (258, -4.0), b"ba": (259, -4.5)}
    v = pieces.Vocabulary(found, list(range(256)), prefix=False)
    texts = [("a" * r.randrange(1, 3 * longest) + r.choice(["b", "", "ba"])) * r.randrange(1, 4) for _ in range(60)]
    for text, ids in zip(texts, pieces.encode([t.encode() for t in texts], v), strict=True):
        assert ids.tolist() == list(pieces.stream(text.encode(), v))
