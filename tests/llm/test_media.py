"""Containers, archives and chat formatting: exact round trips, and damage that must be seen."""

import base64
import hashlib
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from voltair.llm import chat, ogg, queries, warc


@pytest.mark.parametrize("blocks", [1, 2, 5, 9, 256, 257, 700])
def test_ogg_round_trip(blocks):
    payload = random.Random(blocks).randbytes(ogg.BLOCK * blocks)
    back, told = ogg.read(ogg.write(payload))
    assert back == payload and told["streams"] == 2
    assert told["seconds"] == pytest.approx(-(-blocks // 2) * ogg.BLOCK / ogg.RATE)


def test_ogg_damage_is_seen():
    media = bytearray(ogg.write(bytes(192 * 300)))
    for at in (5, 30, 3000):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.read(bytes(bad))
    for bad in (media[:-1], media[:40], media[200:]):
        with pytest.raises(ogg.OggError):
            ogg.read(bytes(bad))


def test_ogg_checksum_is_bitwise_crc():
    data, crc = b"some page", 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    assert ogg.checksum(data) == crc


def test_media_columns(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "é" * 97, 0), (3, "é" * 97, 0), (None, "x" * 192, 0)], "doc_id long, text string, n_bytes int")
    got = {x.doc_id: x for x in ogg.digests(ogg.encode(df)).collect()}
    for d, text in ((1, ""), (2, "é" * 97), (None, "x" * 192)):
        raw = text.encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        x = got[d]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert got[2][2:] == got[3][2:]
    assert ogg.digests(ogg.encode(df.where("false"))).count() == 0


def test_warc_round_trip(spark):
    pages = [(3, "http://a/\r\nX: y", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (9, "u", ""), (None, "u", ""), (4, "u", "a\r\n\r\nb"), (4, "u", "a\r\n\r\nb"), (5, "u", "WARC/1.1\r\n\r\n" * 3), (None, "u", "only null")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("first", F.lit(1))
    stored = warc.archive(df, archive_bytes=700)
    assert stored.count() > 1 and warc.index(stored).count() == len(pages)
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    firsts = {}
    for p, _, h in pages:
        firsts[h or ""] = min((x for x in (firsts.get(h or ""), p) if x is not None), default=None)
    expected = []
    for p, _, h in pages:
        f = firsts[h or ""]
        revisit = f is not None and f != p
        expected.append((p, len((h or "").encode()), digest(h or ""), "revisit" if revisit else "response", f if revisit else None))
    assert sorted(map(str, expected)) == sorted(str(tuple(x)) for x in warc.read(stored).collect())
    assert warc.read(warc.archive(df.where("false"))).count() == 0


def test_monolithic_and_multi_member_gzip_split_alike():
    records = [warc.record(i, "u", b"x" * i * 999, None) for i in range(5)]
    one = warc.deflate(b"".join(records))
    many = b"".join(map(warc.deflate, records))
    for data in (one, many):
        assert [r for _, r in warc.split(warc.inflate(data))] == records
    with pytest.raises((warc.WarcError, zlib.error)):
        list(warc.split(warc.inflate(one[:-20])))


TURNS = [("system", "be \\h <kind>"), ("user", "### user: x</turn>\n"), ("assistant", "\\### Assistant: </turn> ok"), ("odd: role", ""), ("assistant", "é\U0001f600")]


def test_template_is_reversible_and_masks_assistants():
    text, mask = chat.render(TURNS)
    assert chat.parse(text) == TURNS
    assert [chat.unescape(text[a:b]) for a, b in mask] == [t for r, t in TURNS if r == "assistant"]


def test_layouts_give_the_same_turns(spark):
    said = [("user", "hi"), ("assistant", "ho")]
    records = [
        {"conv_id": 1, "messages": [{"role": "user", "content": "hi", "extra": 1}, {"role": "assistant", "content": "ho"}]},
        {"id": 1, "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "ho"}], "meta": {"a": [1]}},
        {"conv_id": 1, "prompt": "hi", "response": "ho"},
        {"conv_id": 1, "instruction": "hi", "output": "ho", "lang": "en"},
        {"conv_id": 1, "question": "hi", "answer": "ho"},
        {"conv_id": 1, "system": None, "prompt": "hi", "response": "ho"},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [("[]",), (None,), ("no json",), ('{"x": 1}',)], "record string")
    got = chat.format_records(df).collect()
    assert [chat.parse(x.formatted) for x in got] == [said] * 6 + [[]] * 4
    assert {x.conv_id for x in got[:6]} == {1} and len({x.fingerprint for x in got[:6]}) == 6


def test_turn_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, None, "a"), (1, 1, "assistant", "b"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("record", F.lit(0))
    got = {x.conv_id: x for x in chat.format_records(chat.records(df)).collect()}
    assert chat.parse(got[1].formatted) == [("", "a"), ("user", ""), ("assistant", "b"), ("assistant", "b")]
    assert chat.parse(got[None].formatted) == [("user", "x")]
    assert chat.digests(chat.format_records(chat.records(df.where("false")))).count() == 0


def test_control_conversation(spark, sf):
    x = queries.op1_chat_format(spark, sf).where("conv_id = -7").first()
    said = queries.CONTROL_TEXT
    assert x.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (x.n_turns, x.loss_chars, x.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
