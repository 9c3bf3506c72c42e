"""Operator 12: repair of conversations' turn order by a fold in DataFrame functions.

Rows of a conversation are put together in runs of RUN turns. In a run a fold carries, for each of four states (nothing yet, behind a
system, a user, an assistant turn), the cheapest edits as a struct (cost, audit); ``least`` takes the cheaper, of equals the
ASCII-least audit. A run is a map from state to state and maps compose, so a conversation of any length is folded
in pieces; each piece then writes its own repaired lines. Rows that are alike go through the fold once, with their number.

Edits: Keep costs 0, Rerole to user or assistant 3, Delete 4 (a must for blank rows and duplicates), Insert 3; a truncated row that
stays adds 3. What stays reads ``(s?(ua)+)?`` by the initials of its roles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RUN = 64
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: A run before all others, for null turns.
NONE = -(1 << 62)
SPACE = "\\x20\\x09-\\x0D"
BEST = "struct<cost: bigint, audit: string>"
STATES = ("start", "s", "u", "a")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n, how many rows are alike: by crc32 of ``conv_id:turn`` mod 20, a row goes (0; its
    conversation keeps a row with n = 0), loses its text (1), its stops (2), comes twice (3) or becomes the user's (4).
    Null roles and texts are one space; a null conv_id or turn is a space in the text that is hashed."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    role, text, turn = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" ")), F.col("turn").cast("long")
    rows = turns.select(
        "conv_id",
        F.when(kind != 0, turn).alias("turn"),
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )
    return counted(rows)


def counted(rows: DataFrame) -> DataFrame:
    """Rows that are alike as one with their number; the sums begin before the shuffle, so many copies are few rows."""
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def flagged(rows: DataFrame) -> DataFrame:
    """One row for each run: its rows in order (turn, null first, then role and text) with flags of their faults.

    A duplicate is a row whose role and text come earlier. Within a run a window finds it. Across runs a second window goes over
    (role, hash of text) of each run's first rows only, so it sees one row a run at most, and its finds join by run."""
    same = lambda text: F.sha2(text, 256)
    rows = rows.withColumn("run", F.coalesce(F.floor(F.col("turn") / RUN), F.lit(NONE))).repartition("conv_id", "run")
    first = F.row_number().over(W.partitionBy("conv_id", "run", "role", "text").orderBy("turn"))
    rows = rows.withColumn("again", first > 1)
    heads = rows.where("n > 0 and not again").select("conv_id", "run", "role", same(F.col("text")).alias("hash"))
    later = heads.withColumn("place", F.row_number().over(W.partitionBy("conv_id", "role", "hash").orderBy("run"))).where("place > 1")
    seen = later.groupBy(F.col("conv_id").alias("seen_id"), F.col("run").alias("seen_run")).agg(F.collect_list(F.concat("role", F.lit("\n"), "hash")).alias("seen"))
    one = F.struct("turn", "role", "text", "n", "again")
    runs = rows.groupBy("conv_id", "run").agg(F.array_sort(F.collect_list(F.when(F.col("n") > 0, one))).alias("rows"))
    runs = runs.join(seen, F.col("conv_id").eqNullSafe(F.col("seen_id")) & (F.col("run") == F.col("seen_run")), "left")

    def flags(r: Column) -> Column:
        blank = ~r["text"].rlike(f"[^{SPACE}]")
        again = ~blank & (r["again"] | F.coalesce(F.array_contains("seen", F.concat(r["role"], F.lit("\n"), same(r["text"]))), F.lit(False)))
        cut = ~blank & ~again & ~r["text"].rlike(f"[.!?][{SPACE}]*\\z")
        return F.struct(*[r[c].alias(c) for c in ("turn", "role", "text", "n")], F.substring(r["role"], 1, 1).alias("initial"), blank.alias("blank"), again.alias("again"), cut.alias("cut"))

    return runs.select("conv_id", "run", F.transform("rows", flags).alias("rows"))


def _add(best: Column, cost: Column | int, letter: str) -> Column:
    """``best`` with one more edit; a state that cannot be reached stays null."""
    return F.when(best.isNotNull(), F.struct((best["cost"] + cost).cast("long").alias("cost"), F.concat(best["audit"], F.lit(letter)).alias("audit")))


def inserted(v: Column) -> Column:
    """The four states with inserts before the next row: a user from all but user, then an assistant from user."""
    user = F.least(v["u"], *[_add(v[s], INSERT, "I") for s in ("start", "s", "a")])
    with_user = F.struct(v["start"].alias("start"), v["s"].alias("s"), user.alias("u"), v["a"].alias("a"))
    return with_user.withField("a", F.least(v["a"], _add(user, INSERT, "I")))


def stepped(v: Column, r: Column) -> Column:
    """The four states behind a row, given those before it with inserts. Its copies are deleted right behind it."""
    stays = ~r["blank"] & ~r["again"]
    copies = (r["n"] - 1) * DELETE
    fine = F.when(r["cut"], CUT).otherwise(0) + copies

    def kept(initial: str, *before: str) -> list[Column]:
        keep = [F.when(stays & (r["initial"] == initial), _add(v[s], fine, "K")) for s in before]
        return keep + ([F.when(stays, _add(v[s], fine + REROLE, "R")) for s in before] if initial != "s" else [])

    gone = {s: _add(v[s], copies + DELETE, "D") for s in STATES}
    new = {"start": gone["start"], "s": F.least(gone["s"], *kept("s", "start")), "u": F.least(gone["u"], *kept("u", "start", "s", "a")), "a": F.least(gone["a"], *kept("a", "u"))}
    return F.struct(*[x.cast(BEST).alias(s) for s, x in new.items()])


VECTOR = "struct<" + ", ".join(f"{s}: {BEST}" for s in STATES) + ">"


def _from(state: str) -> Column:
    """Nothing done yet, in one state."""
    zero = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    return F.struct(*[(zero if s == state else F.lit(None)).cast(BEST).alias(s) for s in STATES]).cast(VECTOR)


def mapped(runs: DataFrame) -> DataFrame:
    """Each run with its map: what the fold makes of it from every state before."""
    maps = F.struct(*[F.aggregate("rows", _from(s), lambda v, r: F.transform(F.array(inserted(v)), lambda w: stepped(w, r))[0]).alias(s) for s in STATES])
    return runs.withColumn("map", maps)


def _joined(v: Column, m: Column) -> Column:
    """The four states behind a run; the state's number closes the run's part of the audit. Equal audits have equal states, so
    these marks never decide between audits."""

    def to(k: int, s: str) -> Column:
        ways = [F.when(v[b].isNotNull() & m[b][s].isNotNull(), F.struct((v[b]["cost"] + m[b][s]["cost"]).alias("cost"), F.concat(v[b]["audit"], m[b][s]["audit"], F.lit(str(k))).alias("audit"))) for b in STATES]
        return F.least(*ways).cast(BEST).alias(s)

    return F.struct(*[to(k, s) for k, s in enumerate(STATES)])


def _lines(rows: Column, edits: Column, state: Column) -> Column:
    """What a run's edits make: the audit with its copies' deletes, and the repaired lines."""
    none = F.struct(F.lit(0).alias("at"), state.cast("int").alias("state"), F.lit("").alias("audit"), F.array().cast("array<string>").alias("lines"))

    def edit(a: Column, e: Column) -> Column:
        r = F.get(rows, a["at"])
        says = F.when(a["state"] == 2, "assistant").otherwise("user")  # the only role that may follow
        role = F.when(e == "K", r["role"]).otherwise(says)
        line = F.concat(role, F.lit(":"), F.when(e == "I", "").otherwise(r["text"]))
        after = F.when(e == "D", a["state"]).when((e == "K") & (r["initial"] == "s"), 1).otherwise(F.when(a["state"] == 2, 3).otherwise(2))
        copies = F.when(e == "I", "").otherwise(F.repeat(F.lit("D"), (r["n"] - 1).cast("int")))
        return F.struct((a["at"] + F.when(e == "I", 0).otherwise(1)).alias("at"), after.alias("state"), F.concat(a["audit"], e, copies).alias("audit"), F.when(e == "D", a["lines"]).otherwise(F.array_append(a["lines"], line)).alias("lines"))

    return F.aggregate(F.filter(F.split(edits, ""), lambda e: e != ""), none, edit, lambda a: F.struct(a["audit"], a["lines"]))


def repair(rows: DataFrame) -> DataFrame:
    """Per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, and repaired, an array of ``role:text`` lines.

    ``rows`` has conv_id, turn, role, text and n (0: the conversation is there, the row is not). Rows of equal turn stand by role and
    text. A null conv_id is a conversation of its own. A role without a character has no initial and cannot be kept.
    A conversation's repaired lines are one value, as its audit is; before that, tasks hold runs of RUN turns (and the
    distinct rows of one turn, or those without a turn)."""
    legal = ("su", "ua", "au")
    pair = lambda a, b: F.when(F.concat(a, b).isin(*legal), 0).otherwise(1)
    count = lambda f: F.aggregate("rows", F.lit(0).cast("long"), lambda t, r: t + f(r))
    beside = F.transform(F.sequence(F.lit(1), F.size("rows") - 1), lambda k: pair(F.get("rows", k - 1)["initial"], F.get("rows", k)["initial"]))
    own = mapped(flagged(rows)).select(
        "conv_id", "run", "rows", "map",
        F.array_min(F.transform("rows", lambda r: r["turn"])).alias("low"), F.array_max(F.transform("rows", lambda r: r["turn"])).alias("high"),
        F.size(F.filter(F.array_distinct(F.transform("rows", lambda r: r["turn"])), lambda t: t.isNotNull())).cast("long").alias("places"),
        count(lambda r: F.when(r["blank"], r["n"]).otherwise(0)).alias("blank"),
        count(lambda r: F.when(r["again"], r["n"]).when(r["blank"], 0).otherwise(r["n"] - 1)).alias("duplicate"),
        count(lambda r: F.when(r["cut"], 1).otherwise(0)).alias("truncated"),
        (count(lambda r: r["n"] - 1) + F.when(F.size("rows") > 1, F.aggregate(beside, F.lit(0).cast("long"), lambda t, x: t + x)).otherwise(0)).alias("illegal"),
    )
    run = F.when(F.size("rows") > 0, F.struct("run", "rows", "map"))
    whole = own.groupBy("conv_id").agg(
        F.collect_list(run).alias("runs"), (F.max("high") - F.min("low") + 1 - F.sum("places")).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
    )
    by_run = F.array_sort("runs", lambda x, y: F.when(x["run"] < y["run"], -1).when(x["run"] > y["run"], 1).otherwise(0))
    whole = whole.withColumn("runs", by_run)
    borders = F.when(F.size("runs") > 1, F.aggregate(F.transform(F.sequence(F.lit(1), F.size("runs") - 1), lambda k: pair(F.element_at(F.get("runs", k - 1)["rows"], -1)["initial"], F.get("runs", k)["rows"][0]["initial"])), F.lit(0).cast("long"), lambda t, x: t + x)).otherwise(0)
    last = lambda v: F.transform(F.array(inserted(v)), lambda w: F.least(w["start"], w["a"]))[0]
    best = F.aggregate("runs", _from("start"), lambda v, x: _joined(v, x["map"]), last)
    whole = whole.select("*", (F.col("illegal") + borders).alias("unlike"), best.alias("best"))
    parts = F.split(F.col("best.audit"), "[0-3]")  # a part for each run, then what is put behind the last
    marks = F.concat(F.array(F.lit("0")), F.filter(F.split(F.regexp_replace("best.audit", "[^0-3]", ""), ""), lambda m: m != ""))
    whole = whole.select("*", parts.alias("parts"), marks.alias("marks"))
    pieces = F.transform("runs", lambda x, k: _lines(x["rows"], F.get("parts", k), F.get("marks", k)))
    tail = _lines(F.array().cast("array<struct<turn: bigint, role: string, text: string, n: bigint, initial: string>>"), F.element_at("parts", -1), F.element_at("marks", -1))
    whole = whole.withColumn("pieces", F.concat(pieces, F.array(tail)))
    return whole.select(
        "conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", F.col("unlike").cast("long").alias("illegal"), F.col("best.cost").alias("cost"),
        F.array_join(F.transform("pieces", lambda p: p["audit"]), "").alias("audit"), F.flatten(F.transform("pieces", lambda p: p["lines"])).alias("repaired"),
    )


def repair_digests(turns: DataFrame) -> DataFrame:
    """The repaired conversations of a table that was damaged on purpose, lines as a digest. Other columns are ignored; an empty table gives no rows."""
    made = repair(damaged(turns))
    return made.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join("repaired", "\n"), 256).alias("repaired_sha256"))
