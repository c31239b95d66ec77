"""Chat formatting in budgeted windows, in DataFrame functions alone.

Prefix sums of a conversation's turn tokens choose the windows: the token
axis is cut into cells of what the budget leaves beside the system turn and
the history; turns within one cell share a window, a turn that crosses a
cell's end has its own. So windows hold whole turns and follow from prefix
sums without a sequential pass. Every window repeats the conversation's
first system turn and up to two turns before it; repeated turns are masked,
so every assistant text is a target once.

With the system turn and what is repeated, a window has BUDGET tokens at
most, unless one turn and the system turn alone have more. History gets what
is left of the budget, HISTORY_BUDGET at most; a long system turn takes from
the cells only once the cells would be smaller than the history.

A turn reads ``<s><|role|>text</s>``, a user's text between ``[INST] `` and
`` [/INST]``. Control strings inside texts get a backslash after their first
character (one more where there are some already), which reading back takes
away again; in roles ``%``, ``|`` and ``<`` are percent-encoded.

Defined cases: null text and null role are empty. Rows of one conversation
are ordered by turn, role and text, null turns first; repeated rows are
turns of their own. Rows with a null conv_id form one conversation. Very
long texts stay whole. Empty input gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUDGET, HISTORY_BUDGET = 512, 128
#: Tokens of a turn: runs of letters or digits, other characters one by one, and the markers.
TOKEN, MARKERS = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]", 4
_CONTROL = r"(/?(?:s>|INST\])|\|)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C")), F.lit("<"), F.lit("%3C"))


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%7C"), F.lit("|")), F.lit("%25"), F.lit("%"))


def windows(conversations: DataFrame) -> DataFrame:
    """conv_id, window, formatted, n_repeated (leading turns that repeat), loss (start and length of targets, in code points)."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)) + MARKERS)
    every = Window.partitionBy("conv_id")
    order = every.orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "*",
        F.row_number().over(order).alias("seq"),
        ((F.col("role") == "system") & (F.sum((F.col("role") == "system").cast("int")).over(upto) == 1)).alias("is_system"),
    )
    turn = F.struct("seq", "role", "text", "tokens", "is_system")
    cost = F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))
    rows = rows.select(
        "*",
        (F.sum(cost).over(upto) - cost).alias("before"),
        cost.alias("cost"),
        F.first(F.when(F.col("is_system"), turn), ignorenulls=True).over(upto).alias("system"),
        F.lag(turn, 1).over(order).alias("h1"),
        F.lag(turn, 2).over(order).alias("h2"),
        F.max(F.when(F.col("is_system"), F.col("tokens"))).over(every).alias("system_tokens"),
    )
    room = BUDGET - F.coalesce("system_tokens", F.lit(0))
    cell = F.greatest(F.lit(1), F.when(room >= 2 * HISTORY_BUDGET, room - HISTORY_BUDGET).otherwise(room))
    first, last = F.floor(F.col("before") / cell), F.floor((F.col("before") + F.greatest("cost", F.lit(1)) - 1) / cell)
    rows = rows.withColumn("window", 2 * first + (first != last).cast("int"))
    grouped = rows.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("seq", "role", "text"))).alias("own"),
        F.min_by(F.struct("seq", "system", "h1", "h2"), "seq").alias("at"),
        F.sum("tokens").alias("own_tokens"),
    )

    def repeated(source: Column, wanted: Column) -> Column:
        return F.when(wanted, F.array(F.struct(source["seq"].alias("seq"), source["role"].alias("role"), source["text"].alias("text")))).otherwise(
            F.array().cast("array<struct<seq:int,role:string,text:string>>")
        )

    h1, h2, system = F.col("at.h1"), F.col("at.h2"), F.col("at.system")
    again = F.coalesce(system["seq"] < F.col("at.seq"), F.lit(False))
    left = F.least(F.lit(HISTORY_BUDGET), BUDGET - F.col("own_tokens") - F.when(again, system["tokens"]).otherwise(0))
    near = h1.isNotNull() & ~h1["is_system"] & (h1["tokens"] <= left)
    far = near & h2.isNotNull() & ~h2["is_system"] & (h1["tokens"] + h2["tokens"] <= left)
    kept = F.concat(
        repeated(system, again),
        repeated(h2, F.coalesce(far, F.lit(False))),
        repeated(h1, F.coalesce(near, F.lit(False))),
    )
    parts = grouped.select("conv_id", "window", "own", kept.alias("kept")).select(
        "conv_id", "window", F.size("kept").alias("n_repeated"), F.concat("kept", "own").alias("parts")
    )

    def piece(p: Column) -> Column:
        user = p["role"] == "user"
        head = F.concat(F.lit("<s><|"), _role_in(p["role"]), F.lit("|>"), F.when(user, F.lit("[INST] ")).otherwise(F.lit("")))
        body = escape(p["text"])
        tail = F.when(user, F.lit(" [/INST]</s>")).otherwise(F.lit("</s>"))
        return F.struct(p["role"].alias("role"), F.char_length(head).alias("skip"), F.char_length(body).alias("length"), F.concat(head, body, tail).alias("piece"))

    pieces = parts.select("conv_id", "window", "n_repeated", F.transform("parts", piece).alias("pieces"))
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int,role:string>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.char_length(p["piece"])).alias("at"),
            F.concat(a["spans"], F.array(F.struct((a["at"] + p["skip"]).alias("start"), p["length"].alias("length"), p["role"].alias("role")))).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    fresh = F.slice(spans, F.col("n_repeated") + 1, F.greatest(F.size("pieces"), F.lit(1)))
    loss = F.transform(F.filter(fresh, lambda s: s["role"] == "assistant"), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return pieces.select(
        "conv_id", "window", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "n_repeated", loss.alias("loss")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, window, turns (role and text of the turns that are not repeated), targets (texts under the loss mask), from the windows alone."""
    pattern = r"(?s)<s><\|(.*?)\|>(.*?)</s>"
    both = F.arrays_zip(
        F.regexp_extract_all("formatted", F.lit(pattern), F.lit(1)).alias("role"), F.regexp_extract_all("formatted", F.lit(pattern), F.lit(2)).alias("body")
    )
    fresh = F.slice(both, F.col("n_repeated") + 1, F.greatest(F.size(both), F.lit(1)))

    def plain(t: Column) -> Column:
        inner = F.when(t["role"] == "user", F.substr(t["body"], F.lit(8), F.char_length(t["body"]) - 15)).otherwise(t["body"])
        return F.struct(_role_out(t["role"]).alias("role"), unescape(inner).alias("text"))

    targets = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "window", F.transform(fresh, plain).alias("turns"), targets.alias("targets"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation."""
    sized = formatted.withColumn("window", F.struct("window", F.char_length("formatted").alias("chars")))
    rows = read_back(sized)
    rows = rows.select(
        "conv_id",
        F.col("window.window").alias("window"),
        F.col("window.chars").alias("chars"),
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("targets", "").alias("loss"),
    )
    whole = rows.groupBy("conv_id").agg(
        F.sum("n").cast("bigint").alias("n_turns"),
        F.sum("chars").cast("bigint").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("parts"),
    )
    text = lambda field: F.array_join(F.transform("parts", lambda p: p[field]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(text("turns"), 256).alias("turns_sha256"),
        F.char_length(text("loss")).cast("bigint").alias("loss_chars"),
        F.sha2(text("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
