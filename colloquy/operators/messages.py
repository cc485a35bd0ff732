"""Conversations as arrays of messages, and projections of them.

`messages` is array<struct<role:string, content:string>>, in turn order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import strip, text_of

MESSAGES = "array<struct<role:string,content:string>>"


def from_turns(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, messages) from one row a turn. Turns go by number, then role and text; order never rests on arrival."""
    own = F.sort_array(F.collect_list(F.struct(F.col("turn"), text_of(F.col("role")).alias("role"), text_of(F.col("text")).alias("content"))))
    spark = turns.sparkSession
    # a number of its own, so that small tables are not dealt to one task, which then scores them all
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return turns.repartition(parts, id_col).groupBy(id_col).agg(F.transform(own, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def with_role(messages: Column, role: str) -> Column:
    return F.filter(messages, lambda m: m["role"] == role)


def contents(messages: Column, role: str | None = None) -> Column:
    return F.transform(messages if role is None else with_role(messages, role), lambda m: m["content"])


def role_text(messages: Column, role: str) -> Column:
    return F.array_join(contents(messages, role), "\n")


def dialogue(messages: Column) -> Column:
    """Without system messages and other roles."""
    return F.filter(messages, lambda m: m["role"].isin("user", "assistant"))


def conversation_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def to_sharegpt(messages: Column) -> Column:
    """array<struct<from, value>>; user becomes human and assistant gpt."""
    name = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    return F.transform(messages, lambda m: F.struct(name(m["role"]).alias("from"), m["content"].alias("value")))


def from_sharegpt(conversations: Column) -> Column:
    return F.transform(conversations, lambda m: F.struct(chat_role(m["from"]).alias("role"), m["value"].alias("content")))


def chat_role(role: Column) -> Column:
    return F.when(role == "human", "user").when(role.isin("gpt", "bot"), "assistant").otherwise(role)


def normalize(raw: Column, system: str = "You are a helpful assistant.") -> Column:
    """Messages from JSON in any of the usual dialects: other roles and blank texts go, a system message comes first."""
    item = "struct<role:string,from:string,content:string,value:string>"
    data = F.from_json(raw, f"struct<messages:array<{item}>,conversation:array<{item}>,conversations:array<{item}>>")
    items = F.coalesce(data["messages"], data["conversation"], data["conversations"])
    own = F.transform(items, lambda m: F.struct(chat_role(F.coalesce(m["role"], m["from"])).alias("role"), strip(F.coalesce(m["content"], m["value"])).alias("content")))
    kept = F.filter(own, lambda m: m["role"].isin("system", "user", "assistant") & (m["content"] != ""))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return F.when(F.size(kept) > 0, F.when(kept[0]["role"] == "system", kept).otherwise(F.concat(first, kept)))


def preview(messages: Column, each: int = 80, most: int = 220) -> Column:
    said = F.filter(messages, lambda m: m["role"] != "system")
    return F.substr(F.array_join(F.transform(said, lambda m: F.substr(m["content"], F.lit(1), F.lit(each))), " / "), F.lit(1), F.lit(most))


def _with_turn(messages: Column) -> Column:
    """Each message with the number of user messages up to it."""
    users = F.transform(messages, lambda m: F.coalesce((m["role"] == "user").cast("int"), F.lit(0)))
    upto = F.slice(F.aggregate(users, F.array(F.lit(0)), lambda k, u: F.concat(k, F.array(F.element_at(k, -1) + u))), 2, F.greatest(F.size(messages), F.lit(1)))
    return F.zip_with(messages, upto, lambda m, k: F.struct(m["role"].alias("role"), m["content"].alias("content"), k.alias("k")))


def numbered_transcript(messages: Column) -> Column:
    """Lines `[user#k] text`; other roles name the user turn that they follow."""
    line = lambda m: F.when(m["role"] == "user", F.concat(F.lit("[user#"), m["k"].cast("string"), F.lit("] "), m["content"])).otherwise(F.concat(F.lit("["), m["role"], F.lit("<-#"), m["k"].cast("string"), F.lit("] "), m["content"]))
    return F.array_join(F.transform(_with_turn(dialogue(messages)), line), "\n")


def one_line_transcript(messages: Column) -> Column:
    return F.array_join(F.transform(_with_turn(dialogue(messages)), lambda m: F.concat(F.lit("["), m["role"], F.lit("#"), m["k"].cast("string"), F.lit("] "), F.replace(m["content"], F.lit("\n"), F.lit(" ")))), "\n")


def tail_transcript(messages: Column, last: int | None = None, names: tuple[str, str] = ("Human", "Friend")) -> Column:
    """The last messages under speaker names between <transcript> marks; a mark alone where there is none."""
    own = dialogue(messages)
    own = own if last is None else F.slice(own, F.greatest(F.lit(1), F.size(own) - (last - 1)), last)
    lines = F.transform(own, lambda m: F.concat(F.when(m["role"] == "user", names[0]).otherwise(names[1]), F.lit(": "), m["content"]))
    return F.when(F.size(own) == 0, "<transcript/>").otherwise(F.concat(F.lit("<transcript>\n"), F.array_join(lines, "\n"), F.lit("\n</transcript>")))


def keep_last(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - (n - 1)), n)


def trim_at_user_turn(messages: Column, k: int | Column) -> Column:
    """The first k user turns and their answers, ending with an answer; answers before the first user turn go."""
    kept = F.filter(_with_turn(messages), lambda m: (m["role"] == "system") | m["role"].isin("user", "assistant") & (m["k"] >= 1))
    # nothing after the user turn k + 1, system messages included
    within = F.filter(kept, lambda m: m["k"] <= k)
    last = F.array_max(F.transform(within, lambda m, i: F.when(m["role"] == "assistant", i + 1).otherwise(0)))
    return F.transform(F.slice(within, 1, F.coalesce(last, F.lit(0))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))


def adjacent_pairs(messages: Column, step: int = 1) -> Column:
    """array<struct<user, assistant>>: answers right after a user message; step 2 looks at even places only."""
    own = dialogue(messages)
    pairs = F.zip_with(own, F.slice(own, 2, F.greatest(F.size(own), F.lit(1))), lambda a, b: F.struct(a["role"].alias("r1"), b["role"].alias("r2"), a["content"].alias("user"), b["content"].alias("assistant")))
    pairs = F.filter(pairs, lambda p, i: (p["r1"] == "user") & (p["r2"] == "assistant") & (i % step == 0))
    return F.transform(pairs, lambda p: F.struct(p["user"].alias("user"), p["assistant"].alias("assistant")))


def positional_pairs(a: Column, b: Column) -> Column:
    """Inner zip of two message arrays, as long as the shorter."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias("source"), y.alias("target")))


def hard_wall(messages: Column) -> Column:
    """Why messages cannot be used at all, or null: empty, malformed."""
    blank = F.exists(messages, lambda m: m["role"].isNull() | m["content"].isNull())
    return F.when(messages.isNull() | (F.size(messages) == 0), "empty").when(blank, "malformed")


def context_messages(messages: Column, mode: str = "drop", system: str = "", nudge: Column | None = None, severity: Column | None = None) -> Column:
    """What a source model is shown: the dialogue, after a system message if mode is `replace`, before a nudge if severity is 1.5 or more."""
    message = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))
    out = dialogue(messages)
    out = F.concat(message("system", F.lit(system)), out) if mode == "replace" else out
    return out if nudge is None or severity is None else F.when(severity >= 1.5, F.concat(out, message("user", nudge))).otherwise(out)


def validated(messages: Column) -> Column:
    """Known roles only, stripped, without blanks."""
    own = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), strip(m["content"]).alias("content")))
    return F.filter(own, lambda m: m["role"].isin("system", "user", "assistant") & (m["content"] != ""))
