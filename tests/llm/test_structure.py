"""Secret scans, the prefix trie and the repair of conversations: brute force and odd cases."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from voltair.llm import queries, repair, secret_scan, trie

TURNS = "conv_id long, turn long, role string, text string"
SECRET = "Zq8vT1xLw3Kp9RbN5mYc2HsD7fGj4Ae6Uo0"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_secret_scan", "op12_prefix_trie", "op13_structure_repair"])
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got, expected = queries.QUERIES[name](spark, sf), con.sql(queries.SQL[name])
    at = [expected.columns.index(c) for c in got.columns]
    assert Counter(map(tuple, got.collect())) == Counter(tuple(r[i] for i in at) for r in expected.fetchall())


# ---------------------------------------------------------------- secrets

PLAIN = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def plain_spans(text):
    base = [(m.start(), k, m.end()) for k, (p, keep) in PLAIN.items() for m in re.finditer(p, text, re.ASCII) if keep(m)]
    more = []
    for c in secret_scan.CLASSES:
        for m in re.finditer(c.pattern, text):
            if any(re.search(p, m[0]) for p in secret_scan.ALLOWED):
                continue
            word, spans = m[0].lower() if c.fold else m[0], []
            for i in range(len(word) - c.window + 1):
                n = Counter(word[i : i + c.window])
                if sum(c.table[x] for x in n.values()) <= c.most:
                    bits = -sum(x / c.window * math.log2(x / c.window) for x in n.values())
                    assert bits > c.bits - 1e-4
                    if spans and spans[-1][1] >= i:
                        spans[-1][1] = i + c.window
                    else:
                        spans.append([i, i + c.window])
            more += [(m.start() + a, c.kind, m.start() + z) for a, z in spans]
    rank = secret_scan.KINDS.index
    order = lambda s: (s[0], rank(s[1]), s[2])
    more = [s for s in more if not any(b[0] <= s[0] and s[2] <= b[2] for b in base)]
    return sorted(base, key=order), sorted(base + more, key=order)


def listed(spans):
    return ",".join(f"{k}:{a}:{z}" for a, k, z in spans)


def secret_texts():
    r = random.Random(5)
    texts = [
        None, "", f"x {SECRET} y", f"é😀 token = \"{SECRET}\" 😀 AKIA{'Q7' * 8} end", "token=secret:abcdefghijklmnop", "token=password=abcdefghijklmnop", "PassWord : 'short'", "api_key==aaaaaaaaaaaa APIKEY=bbbbbbbbbbbbbb",
        "AKIA" + "A" * 13, "AKIA" + "A" * 14, "paſſword=abcdefghijklmnop toKen=abcdefghijklmnop", "deadbeef" * 4, "0123456789" * 4, "DEADBEEF12345678CAFEBABE90", "some_long_identifier_name_of_a_thing_in_code", "123e4567-e89b-12d3-a456-426614174000",
        "da39a3ee5e6b4b0d3255bfef95601890afd80709", "x" * 5000, "ab" * 3000 + SECRET, SECRET * 60 + "-" * 40 + SECRET, " ".join([SECRET, "token: abcdefghijklm"] * 200),
    ]
    for _ in range(150):
        texts.append("".join(r.choice([r.choice("abcdef0123456789"), r.choice("ghXYZ+/=_- .:'\""), "token", "AKIA", "é", "secret=", SECRET[: r.randrange(35)]]) for _ in range(r.randrange(120))))
    return texts


def test_secrets_are_those_of_a_plain_scan(spark):
    texts = secret_texts()
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, base string, spans string")
    for x in secret_scan.digests(docs).collect():
        base, spans = plain_spans(texts[x.doc_id] or "")
        assert x.spans == listed(spans), texts[x.doc_id]
        assert x.base_sha256 == sha(listed(base))
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in PLAIN)


def test_secret_scan_is_native_and_stands_odd_rows(spark):
    docs = spark.createDataFrame([(None, f"a {SECRET}"), (1, "x"), (1, "x")], "doc_id long, text string")
    plan = secret_scan.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    assert secret_scan.digests(docs).count() == 3 and secret_scan.digests(docs.where("false")).count() == 0
    assert secret_scan.find(docs, allowed=("Zq8",)).where("size(spans) > 0").count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, f"é token = {SECRET} and {SECRET}"), (2, None), (3, "clean")], "doc_id long, text string")
    assert {x.doc_id: x.text for x in secret_scan.redact(docs).collect()} == {1: "é [secret] and [secret]", 2: None, 3: "clean"}


# ---------------------------------------------------------------- trie


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = Counter(k[:-1] for k in members if k)
    out = {}
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(k)))
        out[min(m), len(k)] = (min(members[k[:-1]]) if k else None, len(m), kids[k], sum(not kids[x] for x in below), saved, sha(ends))
    return out


def trie_rows(seed):
    r = random.Random(seed)
    rows = []
    for c in range(75):
        n = r.choice([0, 1, 2, 3, 4, 6, 9]) if c % 20 else r.choice([0, 2, 5])
        for t in range(n):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a", "b c", "", None, "hello wide world"])))
    rows += [(90, None, "user", "first"), (90, 1, "user", "b"), (90, 1, "user", "a"), (90, 1, "user", "a"), (None, 0, "user", "lost"), (2000, 0, "user", "a\x00b"), (2001, 0, "usera", "\x00b")]
    rows += [(c, t, "user", "same") for c in range(100, 140) for t in range(5)] + [(141, t, "user", f"turn {t} " * 50) for t in range(600)] + [(161, t, "user", f"turn {t} " * 50) for t in range(590)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_that_of_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(trie, "BLOCK", 3)
    rows = trie_rows(seed)
    short = [x for x in rows if x[0] not in (141, 161)] if seed == 1 else rows[:-1100] + [x for x in rows[-1190:] if x[1] < 40]
    df = spark.createDataFrame(short, TURNS).withColumns({c: F.lit("clash") for c in ("depth", "digest", "words", "pos")})
    got = {(x.conv_id, x.depth): (x.parent_conv_id, x.n_convs, x.n_children, x.n_leaves, x.saved_tokens, x.ends_sha256) for x in trie.trie(df).collect()}
    assert got == plain_trie(short)


def test_trie_of_an_empty_table_and_of_long_conversations(spark):
    assert trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    rows = [(141, t, "user", f"turn {t}") for t in range(600)] + [(161, t, "user", f"turn {t}" if t < 590 else "other") for t in range(595)]
    got = trie.trie(spark.createDataFrame(rows, TURNS))
    built = plain_trie(rows)
    assert {(x.conv_id, x.depth): (x.parent_conv_id, x.n_convs, x.n_children, x.n_leaves, x.saved_tokens, x.ends_sha256) for x in got.collect()} == built


# ---------------------------------------------------------------- repair


def plain_repair(rows):
    """Rows (turn, role, text) after damage, in order: cost, audit, repaired and faults, by trying all edits."""
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None)
        seen.add((role, text))
    best = None
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        if 3 * sum(inserts) > 4 * len(rows):  # deleting all is cheaper
            continue
        for letters in itertools.product("DKR", repeat=len(rows)):
            cost, audit, out, ok = 3 * sum(inserts), "", [], True

            def put(kind, row, out=out):
                led = bool(out) and out[0][0][:1] == "s"
                return ("user", "assistant")[(len(out) - led) % 2], "" if kind == "I" else row[2]

            for i in range(len(rows) + 1):
                for _ in range(inserts[i]):
                    out.append(put("I", None))
                audit += "I" * inserts[i]
                if i == len(rows):
                    break
                audit += letters[i]
                cost += {"K": 0, "R": 3, "D": 4}[letters[i]] + (3 if letters[i] != "D" and faults[i] == "truncated" else 0)
                ok &= letters[i] == "D" or faults[i] not in ("blank", "duplicate")
                if letters[i] == "K":
                    out.append((rows[i][1], rows[i][2]))
                elif letters[i] == "R":
                    out.append(put("R", rows[i]))
            if ok and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    return *best, faults


def test_repair_is_the_cheapest_of_all(spark):
    r = random.Random(11)
    rows, expected = [], {}
    for c in range(120):
        turns = [(t, r.choice(["user", "user", "assistant", "assistant", "system", "tool", ""]), r.choice(["One.", "Two!", "three", " ", "", "Four? ", "Five.", "Six.\n"])) for t in range(r.randrange(5))]
        turns = [(r.choice([t, t, t + 1]), role, text) for t, role, text in turns]
        turns.sort()
        rows += [(c, *x, 0) for x in turns]
        if turns:
            expected[c] = plain_repair(turns)
    got = {x.conv_id: x for x in repair.repair(spark.createDataFrame(rows, TURNS + ", copy int")).collect()}
    assert set(got) == set(expected)
    for c, (cost, audit, text, faults) in expected.items():
        x = got[c]
        assert (x.way.cost, x.way.audit, "\n".join(x.repaired)) == (cost, audit, text), c
        assert [t.fault for t in x.turns] == faults


def damage(c, turn, role, text):
    part = lambda v: " " if v is None else str(v)
    code = zlib.crc32(f"{part(c)}:{part(turn)}".encode()) % 20
    role, text = "user" if code == 4 else part(role), "" if code == 1 else re.sub("[.!?]", "", part(text)) if code == 2 else part(text)
    return [] if code == 0 else [(turn, role, text)] * (2 if code == 3 else 1)


def test_reports_of_odd_conversations(spark):
    rows = [(c, t, role, text) for c in range(60) for t, role, text in ((None, "user", "Hi."), (0, None, None), (3, "assistant", "Yes."), (3, "assistant", "No"))] + [(None, 1, "user", "A."), (None, None, "user", "B.")]
    by = defaultdict(list)
    for c, *x in rows:
        by[c] += damage(c, *x)
    got = {x.conv_id: x for x in repair.report(spark.createDataFrame(rows, TURNS).withColumn("fault", F.lit("clash")).withColumn("copy", F.lit(7))).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, *t[1:]))
        cost, audit, text, faults = plain_repair(turns)
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        firsts = [role[:1] for _, role, _ in turns]
        illegal = sum((a, b) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(firsts, firsts[1:], strict=False))
        x = got[c]
        assert (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, x.repaired_sha256) == (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha(text))
    assert repair.report(spark.createDataFrame([], TURNS)).count() == 0


def test_conversations_without_rows_and_very_long_ones(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi.")] + [(5000, t, "user" if t % 2 == 0 else "assistant", f"Turn {t} " + "word " * 200 + ".") for t in range(400)]
    got = {x.conv_id: x for x in repair.report(spark.createDataFrame(rows, TURNS)).collect()}
    assert (got[gone].audit, got[gone].cost, got[gone].gaps, got[gone].repaired_sha256) == ("", 0, 0, sha(""))
    assert len(got[5000].audit) >= 360 and got[5000].duplicate > 0
