r"""Chat formatting by budgeted windows, in DataFrame functions only.

Turns become ``<|role|>\ntext<|end|>\n``. Inside roles and texts a backslash is put behind every backslash,
``<`` and ``[``, so no control string of this template (or of the usual bracketed ones) can occur there, and
dropping each such backslash gives the text back.

A span is a run of turns: running sums of turn tokens fill it until the next turn does not fit, and that turn starts the
next span. A window is the retained system turn, some history repeated from just before the span, and the span; all
three count against the budget, and history that would crowd out the span's first turn is left out. Only assistant turns of
the span itself are loss targets: targets repeated as history are masked, so each is trained on once.

Texts move once. A conversation is dealt out in parts, the blocks of ``block_turns`` turn numbers; (conversation, block)
sizes are counted first, and a block of more than ``most_turns`` rows or ``most_bytes`` is cut further by prefix sums over
its sorted turns. So a part is bounded, whatever the conversation, and a part's windows are formed inside its row. To
a conversation of several parts, and to no other, go a few rows more: the number of the part, the system turn, and the last turns
of the part before. A span does not run over a part's end.

Defined results: a null text or role is empty; turns are ordered by (turn, role, text), nulls first, equal rows
are kept each; a null conv_id is a conversation of its own; a turn longer than the budget stands alone in an over-long
window (nothing is cut); history comes from the same part or the one before; an empty table gives no windows; extra
columns are ignored. ``read_back`` gathers what a conversation of several parts said in one row, as a digest of it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, fixed

MARK = "<|end|>\n"
#: kinds of rows of a part, in the order in which they are sorted
NUMBER, SYSTEM, TAIL, OWN = range(4)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", r"$1")


def turn_tokens(text: Column) -> Column:
    """An estimate on the high side: a token for every three code points, one for each byte beyond a code point's first, and the marks."""
    return F.ceil(F.length(text) / 3) + F.octet_length(text) - F.length(text) + F.lit(6)


def bounded(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def dealt(turns: DataFrame, block_turns: int, most_turns: int, most_bytes: int, tail: int, broadcast_rows: int = 10_000) -> DataFrame:
    """conv_id, part struct<block,sub>, kind, turn, role, text: every turn in its part, and what parts need of each other."""
    scratch = Scratch(turns.sparkSession, "chat")
    turns = turns.withColumn("block", F.floor(F.col("turn") / block_turns))
    sizes = turns.groupBy("conv_id", "block").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    sizes = scratch.write(sizes, "sizes")
    heavy = sizes.filter((F.col("rows") > most_turns) | (F.col("bytes") > most_bytes)).select(F.col("conv_id").alias("c"), F.col("block").alias("b"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b"))
    parts = sizes.select("conv_id", F.struct("block", F.lit(0).cast("long").alias("sub")).alias("part"))
    out = turns.withColumn("part", F.struct("block", F.lit(0).cast("long").alias("sub")))
    if heavy.limit(1).count():
        few = F.broadcast(heavy) if bounded(heavy, broadcast_rows) else heavy
        upto = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
        cut = turns.join(few, same).drop("c", "b").withColumn("sub", F.greatest(F.floor(F.count("*").over(upto) / most_turns), F.floor(F.sum(F.octet_length("text").cast("long")).over(upto) / most_bytes)) + 1)
        cut = scratch.write(cut.withColumn("part", F.struct("block", "sub")).drop("sub"), "cut")
        out = turns.join(few, same, "left_anti").withColumn("part", F.struct("block", F.lit(0).cast("long").alias("sub"))).unionByName(cut)
        parts = parts.join(heavy, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("part.block").eqNullSafe(F.col("b")), "left_anti").unionByName(cut.select("conv_id", "part").distinct())
    own = out.select("conv_id", "part", F.lit(OWN).alias("kind"), "turn", "role", "text")

    # conversations of several parts; there parts are numbered, and know the one before
    several = parts.groupBy("conv_id").agg(F.count("*").alias("parts")).filter("parts > 1").select(F.col("conv_id").alias("c"))
    if not several.limit(1).count():
        return own
    order = Window.partitionBy("conv_id").orderBy("part")
    parts = parts.join(several, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    parts = scratch.write(parts.select("conv_id", "part", (F.row_number().over(order) - 1).cast("long").alias("number"), F.lead("part").over(order).alias("next")), "parts")
    numbers = parts.select("conv_id", "part", F.lit(NUMBER).alias("kind"), F.col("number").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))
    few = F.broadcast(parts) if bounded(parts, broadcast_rows) else parts
    few = few.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "number", "next")
    inside = own.join(few, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    place = Window.partitionBy("conv_id", "part")
    names = ["turn", "role", "text"]
    last = inside.filter("next is not null").withColumn("r", F.row_number().over(place.orderBy(*[F.desc(c) for c in names]))).filter(F.col("r") <= tail)
    last = last.select("conv_id", F.col("next").alias("part"), F.lit(TAIL).alias("kind"), *names)
    first = inside.filter("number = 0").withColumn("r", F.row_number().over(place.orderBy(*names))).filter("r = 1 and role = 'system'")
    system = first.select(F.col("conv_id").alias("c"), *names).join(parts.filter("number > 0").select("conv_id", "part"), F.col("conv_id").eqNullSafe(F.col("c")))
    return own.unionByName(numbers).unionByName(last).unionByName(system.select("conv_id", "part", F.lit(SYSTEM).alias("kind"), *names))


def budgeted_windows(
    conversations: DataFrame,
    budget: int = 1024,
    history_tokens: int = 192,
    history_turns: int = 2,
    tokens=turn_tokens,
    target_role: str = "assistant",
    block_turns: int = 512,
    most_turns: int = 4096,
    most_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per window: conv_id, window long, formatted string, n_tokens long, n_repeated int, loss array<struct<at,length>>.

    ``n_repeated`` leading turns are retained or repeated; ``loss`` has code-point spans (from 0) of ``formatted``. Windows
    ascend along a conversation, without gaps within a part; the part's number stands above bit 32. ``part`` and ``several``
    (does the conversation have more than one part) follow.
    """
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = dealt(turns, block_turns, most_turns, most_bytes, history_turns)
    grouped = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("kind", "turn", "role", "text"))).alias("all"))

    def piece(t: Column) -> Column:
        body = escape(t["text"])
        return F.struct(t["kind"].alias("kind"), F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>\n")).alias("head"), body.alias("body"), tokens(body).cast("long").alias("n"), t["role"].alias("role"))

    grouped = grouped.select(
        "conv_id",
        "part",
        F.get(F.filter("all", lambda t: t["kind"] == NUMBER), F.lit(0))["turn"].alias("number"),
        F.transform(F.filter("all", lambda t: t["kind"] != NUMBER), piece).alias("pieces"),
    )
    # the retained system turn, and the rest in order: last turns of the part before, then the part's own
    led = F.get("pieces", F.lit(0))
    opens = F.coalesce(F.col("number"), F.lit(0)) == 0
    grouped = grouped.withColumn("system", F.when((led["kind"] == SYSTEM) | opens & (led["role"] == "system"), led))
    grouped = grouped.withColumn("row", F.filter("pieces", lambda t: t["kind"] != SYSTEM))
    row = fixed(grouped.select("conv_id", "part", F.col("number").isNotNull().alias("several"), F.coalesce("number", F.lit(0)).alias("number"), "system", "row"), "x", F.struct("system", "row", F.transform("row", lambda t: t["n"]).alias("ns"))).drop("system", "row")
    row = fixed(
        row,
        "y",
        F.struct(
            F.size(F.filter("x.row", lambda t: t["kind"] == TAIL)).alias("tail"),
            F.coalesce("x.system.n", F.lit(0)).alias("system_n"),
            # the first of a row that may be repeated: not the system turn itself, which is retained
            F.when(F.col("x.system.kind") == OWN, 1).otherwise(0).alias("lowest"),
        ),
    )

    def history(i: Column, own: Column) -> Column:
        """Turns, and their tokens, to repeat before the turn at ``i``: the nearest ones within the bounds."""
        step = lambda a, j: F.when(
            a["open"] & (i - j >= F.col("y.lowest")) & (a["n"] + F.get("x.ns", i - j) <= F.least(F.lit(history_tokens), budget - F.col("y.system_n") - own)),
            F.struct((a["turns"] + 1).alias("turns"), (a["n"] + F.get("x.ns", i - j)).alias("n"), F.lit(True).alias("open")),
        ).otherwise(F.struct(a["turns"].alias("turns"), a["n"].alias("n"), F.lit(False).alias("open")))
        start = F.struct(F.lit(0).alias("turns"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("open"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(history_turns)), start, step) if history_turns else start

    def fill(acc: Column, i: Column) -> Column:
        own = F.get("x.ns", i)
        fits = (acc["used"] + own <= budget) & (F.size(acc["spans"]) > 0)
        # the system turn is a turn of the first span itself, and is retained by those after it
        retained = F.when((F.col("y.lowest") == 1) & (i == 0), F.lit(0)).otherwise(F.col("y.system_n"))
        fresh = F.transform(F.array(history(i, own)), lambda h: F.struct(F.concat(acc["spans"], F.array(F.struct(i.alias("from"), h["turns"].alias("history")))).alias("spans"), (retained + h["n"] + own).cast("long").alias("used")))
        return F.when(fits, F.struct(acc["spans"].alias("spans"), (acc["used"] + own).cast("long").alias("used"))).otherwise(F.get(fresh, F.lit(0)))

    none = F.struct(F.expr("cast(array() as array<struct<`from`:int,history:int>>)").alias("spans"), F.lit(0).cast("long").alias("used"))
    all_own = F.when(F.size("x.row") > F.col("y.tail"), F.sequence(F.col("y.tail"), F.size("x.row") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    row = fixed(row, "spans", F.aggregate(all_own, none, fill, lambda acc: acc["spans"]))

    def window(s: Column, k: Column) -> Column:
        to = F.coalesce(F.get("spans", k + 1)["from"], F.size("x.row"))
        system = F.when(F.col("x.system").isNotNull() & ((F.col("y.lowest") == 0) | (s["from"] > 0)), F.array("x.system")).otherwise(F.slice("x.row", 1, 0))
        before = F.concat(system, F.slice("x.row", s["from"] - s["history"] + 1, s["history"]))
        return F.struct((F.shiftleft("number", 32) + k).alias("window"), before.alias("before"), F.slice("x.row", s["from"] + 1, to - s["from"]).alias("own"))

    each = row.select("conv_id", "part", "several", F.inline(F.transform("spans", window)))
    shown = F.concat("before", "own")
    each = fixed(each, "shown", shown)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<at:bigint,length:bigint>>)").alias("loss"))

    def lose(acc: Column, p: Column) -> Column:
        body = (acc["at"] + F.length(p["head"])).cast("long")
        found = F.when(p["role"] == target_role, F.concat(acc["loss"], F.array(F.struct(body.alias("at"), F.length(p["body"]).cast("long").alias("length"))))).otherwise(acc["loss"])
        return F.struct((body + F.length(p["body"]) + len(MARK)).cast("long").alias("at"), found.alias("loss"))

    lead = F.aggregate("before", F.lit(0).cast("long"), lambda a, p: a + F.length(p["head"]) + F.length(p["body"]) + len(MARK))
    return each.select(
        "conv_id",
        "window",
        F.array_join(F.transform("shown", lambda p: F.concat(p["head"], p["body"], F.lit(MARK))), "").alias("formatted"),
        F.aggregate("shown", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n_tokens"),
        F.size("before").alias("n_repeated"),
        F.aggregate("own", F.struct(lead.alias("at"), start["loss"].alias("loss")), lose, lambda acc: acc["loss"]).alias("loss"),
        "part",
        "several",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Turns and targets out of ``formatted``, ``n_repeated`` and ``loss`` alone; one row per conversation.

    A conversation of one part is digested where its windows are; what longer ones said is brought together by part.
    """
    turns = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda s: s != "")
    own = F.slice(turns, F.col("n_repeated") + 1, F.size(turns))
    role = lambda s: unescape(F.substring_index(F.substring(s, 3, 1 << 30), "|>\n", 1))
    text = lambda s: unescape(F.regexp_replace(s, r"^<\|[^|]*(?:\|(?!>\n)[^|]*)*\|>\n", ""))
    lost = F.array_join(F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), (x["at"] + 1).cast("int"), x["length"].cast("int")))), "")
    parts = fixed(windows, "own", own).select(
        "conv_id",
        "part",
        "several",
        "window",
        F.size("own").cast("long").alias("n"),
        F.array_join(F.transform("own", lambda s: F.concat(role(s), F.lit("\n"), text(s), F.lit("\n"))), "").alias("said"),
        lost.alias("lost"),
        F.length("formatted").cast("long").alias("chars"),
    )
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    whole = parts.groupBy("conv_id", "part").agg(
        F.first("several").alias("several"),
        F.sum("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("window", "said", "lost"))).alias("w"),
        F.sum("chars").alias("chars"),
    )
    whole = fixed(whole.select("conv_id", "part", "several", "n", "chars", joined("said").alias("said"), joined("lost").alias("lost")), "d", F.when(~F.col("several"), F.struct(digest(F.col("said")).alias("said"), digest(F.col("lost")).alias("lost"), F.length("lost").cast("long").alias("chars"))))
    more = lambda name: F.when(F.col("several"), F.col(name)).alias(name)
    out = whole.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.first("d", ignorenulls=True).alias("d"),
        F.array_sort(F.collect_list(F.when(F.col("several"), F.struct("part", more("said"), more("lost"))))).alias("w"),
        F.sum("chars").alias("formatted_chars"),
    )
    return out.select(
        "conv_id",
        "n_turns",
        F.coalesce("d.said", digest(joined("said"))).alias("turns_sha256"),
        F.coalesce("d.chars", F.length(joined("lost")).cast("long")).alias("loss_chars"),
        F.coalesce("d.lost", digest(joined("lost"))).alias("loss_sha256"),
        "formatted_chars",
    )
