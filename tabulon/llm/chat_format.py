"""Conversations as one marked text each, with a mask of what is trained on, and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The strings that mark turns. Inside a text each gets a backslash before it, so an unescaped one is always the template's.
CONTROL = r"\[/?(?:INST|OUT|ROLE|TEXT|NEXT)\]|</?s>"
USER, ASSISTANT = "user", "assistant"
NEXT, TEXT = " [NEXT] ", " [TEXT] "
OPENS = {USER: "[INST] ", ASSISTANT: "[OUT] ", None: "[ROLE] "}
ENDS = {USER: " [/INST]\n", ASSISTANT: " </s>\n", None: " [/ROLE]\n"}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"({CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _by_role(role: Column, of: dict[str | None, str]) -> Column:
    return F.when(role == USER, of[USER]).when(role == ASSISTANT, of[ASSISTANT]).otherwise(of[None])


def _totals(sizes: Column) -> Column:
    """Of each place, the sum of the sizes before it. Done in about the square root of n runs, as a fold copies its array at each step."""

    def run(part: Column) -> Column:
        return F.slice(F.aggregate(part, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))), 1, F.size(part))

    def both(all_: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(all_))).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), width)
        parts = F.transform(starts, lambda s: F.slice(all_, s, width))
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x))
        return F.flatten(F.zip_with(parts, run(sums), lambda p, before: F.transform(run(p), lambda x: x + before)))

    return _with(sizes, both)


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans): each conversation's text, and where what the assistant says lies in it, as (start, length) in bytes of UTF-8.

    A conversation's turns are gathered and sorted; neighbours of one role become one block: `[INST] text [/INST]` of a user,
    `[OUT] text </s>` of an assistant, `[ROLE] name [TEXT] text [/ROLE]` of anyone else, with ` [NEXT] ` between texts that were merged.
    Each assistant text has a span of its own, without marks. Built-in functions only.

    Turns of one number are sorted by role and text; a null turn comes first. A null text, or role, is empty. Rows that repeat are
    turns of their own. Rows without a conv_id are one conversation, without id. An empty table gives no rows; other columns are
    ignored. A conversation is one value, so it has to fit in a row.
    """
    said = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(said)).alias("turns"))

    def pieces(turns: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            opens = ~F.get(turns, i - 1)["role"].eqNullSafe(t["role"])
            ends = ~F.get(turns, i + 1)["role"].eqNullSafe(t["role"])
            name = F.when(t["role"].isin(USER, ASSISTANT), "").otherwise(F.concat(escape(t["role"]), F.lit(TEXT)))
            head = F.when(opens, F.concat(_by_role(t["role"], OPENS), name)).otherwise(NEXT)
            return F.struct(head.alias("head"), escape(t["text"]).alias("body"), F.when(ends, _by_role(t["role"], ENDS)).otherwise("").alias("tail"), (t["role"] == ASSISTANT).alias("loss"))

        return F.transform(turns, one)

    rows = rows.select("conv_id", _with(F.col("turns"), pieces).alias("pieces"))
    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    before = _totals(F.transform("pieces", lambda p: (F.octet_length(p["head"]) + F.octet_length(p["body"]) + F.octet_length(p["tail"])).cast("long")))
    spans = F.zip_with("pieces", before, lambda p, n: F.struct((n + F.octet_length(p["head"])).alias("start"), F.octet_length(p["body"]).cast("long").alias("length"), p["loss"].alias("loss")))
    spans = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["length"]))
    return rows.select("conv_id", whole.alias("formatted"), spans.alias("loss_spans"))


def turns_in(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    ends = "|".join(rf"\Q{e}\E" for e in ENDS.values())
    blocks = F.split(formatted, f"(?:{ends})")

    def turns(block: Column) -> Column:
        rest = F.substr(block, F.lit(len(OPENS[None]) + 1))
        named = F.substring_index(rest, TEXT, 1)
        other = F.struct(unescape(named).alias("role"), F.substr(rest, F.length(named) + len(TEXT) + 1).alias("body"))
        known = lambda role: F.struct(F.lit(role).alias("role"), F.substr(block, F.lit(len(OPENS[role]) + 1)).alias("body"))
        parsed = F.when(block.startswith(OPENS[USER]), known(USER)).when(block.startswith(OPENS[ASSISTANT]), known(ASSISTANT)).otherwise(other)
        return _with(parsed, lambda b: F.transform(F.split(b["body"], rf"\Q{NEXT}\E"), lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text"))))

    return F.flatten(F.transform(F.filter(blocks, lambda b: b != ""), turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """What lies under the mask, unescaped, with nothing between the spans."""
    cut = lambda raw: F.transform(spans, lambda s: unescape(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string")))
    return F.array_join(_with(formatted.cast("binary"), cut), "")


def digests(chats: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = chats.select("conv_id", turns_in(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def oracle() -> str:
    """The same for DuckDB; the length of the formatted text from what the template adds."""
    n = {k: len(OPENS[k]) + len(ENDS[k]) for k in OPENS}
    control = CONTROL.replace("?:", "")
    escapes = lambda c: f"length({c}) + len(regexp_extract_all({c}, '{control}'))"
    return f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, turn, role, '</s>[INST] ok [/INST]' from (values (0, '{USER}'), (1, '{ASSISTANT}')) v(turn, role)),
t as (select *, lag(role) over (partition by conv_id order by turn, role, text) is distinct from role as opens from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = '{ASSISTANT}'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = '{ASSISTANT}'), '')) as loss_sha256,
  sum({escapes("text")} + case when not opens then {len(NEXT)} when role = '{USER}' then {n[USER]} when role = '{ASSISTANT}' then {n[ASSISTANT]}
    else {n[None] + len(TEXT)} + {escapes("role")} end)::bigint as formatted_chars
from t group by conv_id"""
