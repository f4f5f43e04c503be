"""Secret scans by patterns and by sliding-window entropy, in Spark's own functions only.

Three base patterns find assignments, access keys and hex strings. Besides, maximal runs
of the characters of a class (candidates) are swept by a window: counts of the window's
characters are kept up to date as one character enters and one leaves, and with them the
sum of c * log2(c), from which the window's Shannon entropy follows. Windows at or over
the class's threshold are merged into spans, unless the candidate is on the allow list.
Sums are whole numbers (millionths of a bit), so results don't depend on rounding order.

Positions count code points, ends are exclusive; the span of an assignment is the whole
match. Null text: empty. Null ids, repeated rows and clashing names pass through, each row
by itself; empty tables give empty results. A very long text is handled within its row:
regular expressions run over it a fixed number of times, and entropy only over candidates.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: The base patterns, and what a match needs to be kept.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
SHORTEST = {"assign": 12, "access": 18, "hex": 16}
#: The order of kinds that start together.
KINDS = ("assign", "access", "hex", "entropy16", "entropy64")
SPANS = "array<struct<kind:string,start:int,stop:int>>"
UNIT = 1_000_000


@dataclass(frozen=True)
class CharacterClass:
    """Candidates are runs of at least `window` characters of `alphabet` (letters folded if `fold`); windows of `bits` of entropy and more are secret."""

    kind: str
    pattern: str
    alphabet: str
    window: int
    bits: float
    fold: bool = False

    @property
    def table(self) -> list[int]:
        """c * log2(c) for each count c, in millionths."""
        return [round(UNIT * c * math.log2(c)) if c else 0 for c in range(self.window + 1)]

    @property
    def most(self) -> int:
        """The largest sum of c * log2(c) that has the threshold's entropy."""
        return math.floor(UNIT * self.window * (math.log2(self.window) - self.bits))


CLASSES = (
    CharacterClass("entropy16", "[0-9A-Fa-f]{20,}", "0123456789abcdef", 20, 3.0, True),
    CharacterClass("entropy64", "[A-Za-z0-9+/_-]{24,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 24, 4.0),
)
#: Candidates that hold one of these are no secrets: numbers, words of one case (joined by signs), UUIDs, stand-ins, alphabets, digests of the empty string.
ALLOWED = (
    r"^[0-9+/_-]+$",
    r"^[+/_-]*([A-Z]?[a-z]+|[A-Z]+)([+/_-]+([A-Z]?[a-z]+|[A-Z]+))*[+/_-]*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Dd][Uu][Mm][Mm][Yy]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Cc][Hh][Aa][Nn][Gg][Ee][Mm][Ee]",
    r"0123456789|abcdefghij|ABCDEFGHIJ",
    r"^(d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)$",
)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, found>> of leftmost matches: lengths of the pieces between them and of their own, summed up."""
    pieces = F.split(text, pattern)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.arrays_zip(pieces.alias("piece"), found.alias("found")), lambda p: p["found"].isNotNull())
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,found:string>>").alias("out"))

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["piece"])
        stop = start + F.length(p["found"])
        one = F.struct(start.alias("start"), stop.alias("stop"), p["found"].alias("found"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(pairs, empty, add, lambda acc: acc["out"])).otherwise(empty["out"])


def of_kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"))).cast(SPANS)


def base(text: Column) -> Column:
    """Spans of the three base patterns."""
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= SHORTEST["assign"])
    # a run that is long enough is a whole match, so the length goes into these two patterns
    access = matches(text, ACCESS[:-1] + "{%d,}" % (SHORTEST["access"] - 4))
    hexes = matches(text, HEX[:-1] + "{%d,}" % SHORTEST["hex"])
    return F.concat(of_kind(assign, "assign"), of_kind(access, "access"), of_kind(hexes, "hex"))


def windows(candidate: Column, c: CharacterClass) -> Column:
    """array<struct<start, stop>> in a candidate: merged windows whose entropy reaches the threshold.

    counts: of each character of the class in the window; mass: the sum of n * log2(n) over
    them. Both change by what enters (code `new`) and leaves (`old`, 0 before the window is full).
    """
    letters = F.split(F.lower(candidate) if c.fold else candidate, "")
    codes = F.transform(letters, lambda x: F.position(x, F.lit(c.alphabet)))
    before = F.concat(F.array_repeat(F.lit(0), c.window), codes)
    steps = F.slice(F.arrays_zip(codes.alias("new"), before.alias("old")), F.lit(1), F.length(candidate))
    table = F.array(*[F.lit(x).cast("long") for x in c.table])
    zero = F.struct(
        F.array_repeat(F.lit(0), len(c.alphabet)).alias("counts"), F.lit(0).cast("long").alias("mass"), F.lit(0).alias("n"), F.array().cast("array<struct<start:int,stop:int>>").alias("out")
    )

    def step(acc: Column, x: Column) -> Column:
        gone = F.when(x["old"] > 0, F.get(acc["counts"], x["old"] - 1)).otherwise(0)  # of the leaving character, itself included
        there = F.get(acc["counts"], x["new"] - 1) - (x["old"] == x["new"]).cast("int")  # of the entering one, without what leaves
        mass = acc["mass"] + F.get(table, there + 1) - F.get(table, there) + F.when(gone > 0, F.get(table, gone - 1) - F.get(table, gone)).otherwise(0)
        counts = F.transform(acc["counts"], lambda n, k: n + (k + 1 == x["new"]).cast("int") - (k + 1 == x["old"]).cast("int"))
        n = acc["n"] + 1
        start, last = n - c.window, F.element_at(acc["out"], -1)
        joined = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.struct(last["start"].alias("start"), n.alias("stop"))))
        added = F.concat(acc["out"], F.array(F.struct(start.alias("start"), n.alias("stop"))))
        high = (start >= 0) & (mass <= c.most)
        out = F.when(~high, acc["out"]).when((F.size(acc["out"]) > 0) & (F.get(acc["out"], F.size(acc["out"]) - 1)["stop"] >= start), joined).otherwise(added)
        return F.struct(counts.alias("counts"), mass.alias("mass"), n.alias("n"), out.alias("out"))

    return F.aggregate(steps, zero, step, lambda acc: acc["out"])


def entropic(text: Column, c: CharacterClass, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Spans of high entropy in the candidates that aren't allowed."""
    suspect = matches(text, c.pattern)
    if allowed:
        suspect = F.filter(suspect, lambda m: ~reduce(operator.or_, [m["found"].rlike(p) for p in allowed]))

    def spans(m: Column) -> Column:
        return F.transform(windows(m["found"], c), lambda w: F.struct(F.lit(c.kind).alias("kind"), (m["start"] + w["start"]).alias("start"), (m["start"] + w["stop"]).alias("stop")))

    return F.flatten(F.transform(suspect, spans)).cast(SPANS)


def in_order(spans: Column) -> Column:
    """By start, then by the order of kinds."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(names, s["kind"]).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).cast(SPANS)


def find(docs: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with `base` and `spans` (SPANS): those of the patterns, and those with the spans of entropy that no base span holds. Columns of these names are replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("base", "spans")])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    added = [entropic(text, c, allowed) for c in classes]
    name = fresh(docs.columns, "added")
    both = docs.select("*", in_order(base(text)).alias("base"), F.concat(F.array().cast(SPANS), *added).alias(name))
    outside = F.filter(name, lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["stop"] <= b["stop"])))
    return both.withColumn("spans", in_order(F.concat("base", outside))).drop(name)


def redact(docs: DataFrame, mark: str = "[secret]", **options) -> DataFrame:
    """docs with each stretch of secret spans in `text` replaced by a mark; null texts stay null."""
    found = find(docs.select(*[c for c in docs.columns if c.lower() not in ("base", "spans")]), **options)
    whole = F.col("text").cast("string")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        parts = F.when(s["start"] < acc["at"], F.array().cast("array<string>")).otherwise(F.array(F.substr(whole, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], parts).alias("out"))

    done = F.aggregate("spans", zero, cut, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(whole, acc["at"] + 1, F.length(whole))))
    return found.withColumn("text", F.when(F.size("spans") > 0, done).otherwise(whole)).drop("base", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans per row."""
    found = find(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *map(count, SHORTEST), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
