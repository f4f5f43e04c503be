"""Repair of the turn structure of conversations, by one fold over each conversation's turns.

Window functions flag each turn's first fault (blank, duplicate, truncated); the turns are
collected in order, and aggregate() carries the cheapest way, a struct (cost, audit), into
each of four states: nothing said yet, after a system turn, after a user's, after an
assistant's. A turn is kept (K), given another role (R) or deleted (D), and empty turns
are inserted (I), so that the initials of the roles read `(s?(ua)+)?`. Of the ways that
cost the same the one whose audit comes first in ASCII order is taken. The audit alone
determines the repaired turns, which a second fold spells out.

Null role, text, turn or conv_id: one space where a text is needed (a null turn sorts
first); all rows of null ids are one conversation. Turns that tie are ordered by role and
text. Repeated rows are duplicates. A conversation is one record, held by one task: the
method collects it. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What edits cost, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
#: More than any way costs.
NEVER = 1 << 40
STATES = ("none", "s", "u", "a")
_SPACES = r"\x20\x09-\x0D"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy): rows with the planted damage; copy is null for a dropped row, and 0, 1 for those that stay."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat_ws(":", part("conv_id"), part("turn"))) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    copies = F.when(code == 0, F.array(F.lit(None).cast("int"))).when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(code == 4, "user").otherwise(part("role"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def flagged(rows: DataFrame) -> DataFrame:
    """rows with `fault`: blank, duplicate, truncated or null, the first that holds."""
    rows = rows.repartition("conv_id")  # one shuffle: the window and the collection are by conversation
    alike = Window.partitionBy("conv_id", "role", "text", F.col("copy").isNull()).orderBy(F.asc_nulls_first("turn"), "copy")
    seen = F.row_number().over(alike) > 1
    fault = F.when(~F.col("text").rlike(f"[^{_SPACES}]"), "blank").when(seen, "duplicate").when(~F.col("text").rlike(f"[.!?][{_SPACES}]*\\z"), "truncated")
    return rows.withColumn("fault", fault)


def initial(role: Column) -> Column:
    return F.left(role, F.lit(1))


def way(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def then(before: Column, cost: Column | int, letter: str) -> Column:
    return way(before["cost"] + cost, F.concat(before["audit"], F.lit(letter)))


def with_inserts(w: dict[str, Column]) -> Column:
    """The four ways with what inserted turns add: into `u` from all others, then from `u` into `a`."""
    u = F.least(w["u"], *[then(w[q], INSERT, "I") for q in ("none", "s", "a")])
    return F.struct(w["none"].alias("none"), w["s"].alias("s"), u.alias("u"), F.least(w["a"], then(u, INSERT, "I")).alias("a"))


def cheapest(turns: Column) -> Column:
    """The cheapest way (cost, audit) from turns array<struct<.., role, fault>>."""
    never = way(F.lit(NEVER), F.lit(""))
    zero = with_inserts({"none": way(F.lit(0), F.lit("")), "s": never, "u": never, "a": never})

    def step(acc: Column, t: Column) -> Column:
        stay = F.when(t["fault"].isin("blank", "duplicate"), NEVER).when(t["fault"] == "truncated", CUT_SHORT).otherwise(0)
        keep = lambda q, c: then(acc[q], stay + F.when(initial(t["role"]) == c, 0).otherwise(NEVER), "K")
        move = lambda q: then(acc[q], stay + REROLE, "R")
        gone = {q: then(acc[q], DELETE, "D") for q in STATES}
        into_u = [f for q in ("none", "s", "a") for f in (keep(q, "u"), move(q))]
        return with_inserts({"none": gone["none"], "s": F.least(gone["s"], keep("none", "s")), "u": F.least(gone["u"], *into_u), "a": F.least(gone["a"], keep("u", "a"), move("u"))})

    return F.aggregate(turns, zero, step, lambda acc: F.least(acc["none"], acc["a"]))


def spelled(turns: Column, audit: Column) -> Column:
    """array<string> of the repaired turns as `role:text`.

    Inserts stand before the letter of their turn; three characters a turn say which roles
    are inserted before it (at most two) and which it gets itself; the last three say what follows all.
    """
    letters = F.filter(F.split(F.regexp_replace(audit, "I", ""), ""), lambda x: x != "")
    before = F.transform(F.split(audit, "[KRD]"), F.length)
    pairs = F.arrays_zip(before.alias("inserts"), letters.alias("letter"), F.transform(turns, lambda t: initial(t["role"])).alias("own"))
    other = lambda c: F.when(c == "u", "a").otherwise("u")

    def step(acc: Column, p: Column) -> Column:
        one = F.when(p["inserts"] > 0, other(acc["last"])).otherwise("-")
        two = F.when(p["inserts"] > 1, other(one)).otherwise("-")
        now = F.when(two != "-", two).when(one != "-", one).otherwise(acc["last"])
        mine = F.when(p["letter"] == "K", p["own"]).when(p["letter"] == "R", other(now)).otherwise("-")
        return F.struct(F.when(mine != "-", mine).otherwise(now).alias("last"), F.concat(acc["out"], one, two, mine).alias("out"))

    plan = F.aggregate(pairs, F.struct(F.lit("").alias("last"), F.lit("").alias("out")), step, lambda acc: acc["out"])
    name = lambda c: F.when(c == "u", "user").otherwise("assistant")
    rows = F.arrays_zip(F.regexp_extract_all(plan, F.lit("..."), F.lit(0)).alias("plan"), turns.alias("turn"), letters.alias("letter"))

    def lines(r: Column) -> Column:
        inserted = F.transform(F.filter(F.array(F.substr(r["plan"], F.lit(1), F.lit(1)), F.substr(r["plan"], F.lit(2), F.lit(1))), lambda c: c != "-"), lambda c: F.concat(name(c), F.lit(":")))
        role = F.when(r["letter"] == "K", r["turn"]["role"]).otherwise(name(F.substr(r["plan"], F.lit(3), F.lit(1))))
        own = F.when(r["letter"].isin("K", "R"), F.array(F.concat(role, F.lit(":"), r["turn"]["text"]))).otherwise(F.array().cast("array<string>"))
        return F.concat(inserted, own)

    return F.flatten(F.transform(rows, lines))


def repair(conversations: DataFrame) -> DataFrame:
    """One row a conversation of rows (conv_id, turn, role, text, copy): conv_id, turns (in order, with faults), way (cost, audit), repaired array<string>."""
    turn = F.struct("turn", "role", "text", "copy", "fault")
    whole = flagged(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("copy").isNotNull(), turn))).alias("turns"))
    best = whole.withColumn("way", cheapest(F.col("turns")))
    return best.withColumn("repaired", spelled(F.col("turns"), F.col("way.audit")))


def report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after its damage."""
    found = repair(damaged(conversations))
    times = F.array_compact(F.transform("turns", lambda t: t["turn"]))
    gaps = F.when(F.size(times) > 0, F.array_max(times) - F.array_min(times) + 1 - F.size(F.array_distinct(times))).otherwise(0)
    count = lambda kind: F.size(F.filter("turns", lambda t: t["fault"] == kind)).cast("long").alias(kind)
    faults = [count(k) for k in ("blank", "duplicate", "truncated")]
    initials = F.transform("turns", lambda t: initial(t["role"]))
    pairs = F.zip_with(F.slice(initials, F.lit(1), F.greatest(F.size("turns") - 1, F.lit(0))), F.slice(initials, F.lit(2), F.greatest(F.size("turns") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("|"), b))
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin("s|u", "u|a", "a|u"))).cast("long")
    return found.select("conv_id", gaps.cast("long").alias("gaps"), *faults, illegal.alias("illegal"), F.col("way.cost").alias("cost"), F.col("way.audit").alias("audit"), F.sha2(F.array_join("repaired", "\n").cast("binary"), 256).alias("repaired_sha256"))
