"""Operator 1: chat formatting with DataFrame functions only.

A template declares the marks of a turn, which roles bear loss, and a finite-state machine over roles. Turns
are rendered row by row; a conversation is put together in two steps, runs of CHUNK turns and then the
runs, so the work before the last step is spread even for one very long conversation. The machine's
transitions are joined in as data; a run of turns is a map from state to state, and maps compose.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 64
SEGMENTS = "array<struct<text: string, loss: boolean>>"


@dataclass(frozen=True)
class Template:
    """Marks around a turn's role and text; ``moves`` lists (state, role, next state), from ``start``."""

    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>"
    between: str = "\n"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: tuple[tuple[str, str, str], ...] = field(default=(("start", "system", "system"), ("start", "user", "user"), ("system", "user", "user"), ("user", "assistant", "assistant"), ("assistant", "user", "user")))

    @property
    def states(self) -> list[str]:
        return sorted({self.start, *(x for a, _, b in self.moves for x in (a, b))})


def escaped(text: Column, t: Template) -> Column:
    """``text`` without any mark: the escape character is doubled and put behind each mark's first character.

    A mark's first character is always followed by the escape, so no mark occurs, and unescaping is exact.
    """
    e, first = t.escape, t.begin[0]
    return F.replace(F.replace(text, F.lit(e), F.lit(e + e)), F.lit(first), F.lit(first + e + "."))


def unescaped(text: Column, t: Template) -> Column:
    """Exact inverse of ``escaped``: an escape goes with the character behind it, read from the left."""
    e, first = t.escape, t.begin[0]
    parts = F.split(text, "\\Q" + e + e + "\\E", -1)  # doubled escapes apart; what is left of an escape follows a first character
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit(first + e + "."), F.lit(first)), F.lit(e + "n"), F.lit(t.after_role))), e)


def rendered(turns: DataFrame, t: Template) -> DataFrame:
    """conv_id, turn, role and the turn's segments with loss flags. Null role and text count as empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.replace(escaped(role, t), F.lit(t.after_role), F.lit(t.escape + "n"))  # a role's own line feeds
    head = F.concat(F.lit(t.begin), named, F.lit(t.after_role))
    loss = role.isin(*t.loss_roles)
    parts = F.array(
        F.struct(head.alias("text"), F.lit(False).alias("loss")),
        F.struct(escaped(text, t).alias("text"), loss.alias("loss")),
        F.struct(F.lit(t.end).alias("text"), loss.alias("loss")),
        F.struct(F.lit(t.between).alias("text"), F.lit(False).alias("loss")),
    )
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), parts.alias("parts"))


def format_chats(turns: DataFrame, template: Template = Template(), chunk: int = CHUNK) -> DataFrame:
    """Per conversation: conv_id, n_turns, segments (text, loss), formatted (their concatenation), valid.

    Turns are put in order by turn (null first), then role and text, so ties and repeated rows have a defined order
    and stay. Null conv_id is a conversation of its own. ``valid`` tells whether the roles follow the machine; roles it
    does not know make a conversation invalid, and it is formatted all the same. Other columns are ignored.
    """
    t = template
    if t.begin[0] != t.end[0] or t.escape in (t.begin + t.end) or t.begin[0] == t.escape or t.begin[1:2] in (t.escape, ""):
        raise ValueError("marks must begin with the same character and must not hold the escape")
    rows = rendered(turns, t).withColumn("run", F.floor(F.col("turn") / chunk))
    rows = rows.withColumn("one", F.struct("turn", "role", "text", "parts"))
    grouped = rows.groupBy("conv_id", "run").agg(F.array_sort(F.collect_list("one")).alias("rows"))  # some chunk turns, or the ties at one place
    names = t.states
    nexts = F.create_map(*[F.lit(x) for a, r, b in t.moves for x in (f"{a}\n{r}", b)])
    step = lambda s, r: nexts[F.concat(s, F.lit("\n"), r["role"])]
    maps = F.create_map(*[x for a in names for x in (F.lit(a), F.aggregate("rows", F.lit(a).cast("string"), step))])
    runs = grouped.select("conv_id", "run", F.size("rows").alias("n"), F.flatten(F.transform("rows", lambda r: r["parts"])).alias("parts"), maps.alias("map"))
    whole = runs.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.array_sort(F.collect_list(F.struct("run", "n", "parts"))).alias("runs"), F.array_sort(F.collect_list(F.struct("run", F.map_entries("map").alias("map")))).alias("maps"))
    state = F.aggregate("maps", F.lit(t.start).cast("string"), lambda s, m: F.map_from_entries(m["map"])[s])
    segments = F.flatten(F.transform("runs", lambda r: r["parts"]))
    made = whole.select("conv_id", "n_turns", segments.alias("segments"), state.isNotNull().alias("valid"))
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """``chats`` with turns (role, text) parsed from ``formatted``, and loss_text from the segments under loss."""
    t = template
    body = F.split("formatted", "\\Q" + t.end + t.between + "\\E", -1)
    pieces = F.filter(body, lambda p: p != "")
    strip = len(t.begin)

    def turn(p: Column) -> Column:
        rest = F.substr(p, F.lit(strip + 1))
        at = F.locate(t.after_role, rest)
        return F.struct(unescaped(F.substr(rest, F.lit(1), at - 1), t).alias("role"), unescaped(F.substr(rest, at + len(t.after_role)), t).alias("text"))

    under = F.filter("segments", lambda s: s["loss"] & (s["text"] != t.end))
    return chats.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", F.array_join(F.transform(under, lambda s: unescaped(s["text"], t)), ""))


def chat_digests(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """The formatted conversations' digests, read back from the output."""
    made = read_back(format_chats(turns, template), template)
    line = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
