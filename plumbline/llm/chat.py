"""Chat formatting: turns of conversations to segments of text with a loss flag each, by a declarative template.

Everything is built-in DataFrame functions. A conversation's turns are first put together in blocks of
``BLOCK`` turns, formatted and run through the role machine there; a block's effect on the machine is a table
from each state before to the state after, and such tables compose, so a conversation that holds a third of all
rows is formatted by many tasks and only its finished blocks meet, in the one row that it must become.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 256
START, SYSTEM, USER, ASSISTANT, REJECTED = range(5)


@dataclass(frozen=True)
class Template:
    """How a turn is written, and which orders of roles are valid.

    A turn is ``head label sep text tail``. ``controls`` are the strings that no text may contain as they stand: in
    a text, ``escape`` is put after the first character of each, and before each ``escape`` itself, so that reading
    back is a single rule: drop an ``escape`` and keep what follows. ``head`` and ``tail`` begin with or hold a
    control. A role without a label is written as ``=`` and the hex digits of its UTF-8 bytes.
    """

    head: str = "### "
    sep: str = ": "
    tail: str = "</turn>\n"
    escape: str = "\\"
    controls: tuple[str, ...] = ("###", "</turn>")
    labels: tuple[tuple[str, str], ...] = (("system", "System"), ("user", "User"), ("assistant", "Assistant"))
    learned: tuple[str, ...] = ("assistant",)
    #: (state, role, next state); any pair that is not here rejects the conversation.
    moves: tuple[tuple[int, str, int], ...] = (
        (START, "system", SYSTEM), (START, "user", USER), (SYSTEM, "user", USER), (USER, "assistant", ASSISTANT), (ASSISTANT, "user", USER),
    )
    final: tuple[int, ...] = (ASSISTANT,)

    def __post_init__(self):
        for c in self.controls:
            if len(c) < 2 or self.escape in c:
                raise ValueError(f"a control has two characters at least and not the escape: {c!r}")


def _quote(s: str) -> str:
    return f"\\Q{s}\\E"


def escaped(text: Column, t: Template) -> Column:
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    for c in t.controls:
        out = F.regexp_replace(out, f"{_quote(c[0])}(?={_quote(c[1:])})", (c[0] + t.escape).replace("\\", "\\\\").replace("$", "\\$"))
    return out


def unescaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, f"(?s){_quote(t.escape)}(.)", "$1")


def _label(role: Column, t: Template) -> Column:
    out = F.concat(F.lit("="), F.hex(F.encode(role, "UTF-8")))
    for name, label in t.labels:
        out = F.when(role == name, F.lit(label)).otherwise(out)
    return out


def _role(label: Column, t: Template) -> Column:
    out = F.decode(F.unhex(F.substr(label, F.lit(2))), "UTF-8")
    for name, shown in t.labels:
        out = F.when(label == shown, F.lit(name)).otherwise(out)
    return out


def format_conversations(rows: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv, segments array<struct<text, loss>>, formatted, state, valid, first_invalid.

    The texts of segments, one after the other, are ``formatted``. ``first_invalid`` is the ordinal, from 0, of the turn
    that the role machine rejects; a conversation that is only unfinished is not valid and has none. Invalid ones are
    formatted all the same.

    Turns go by turn, null first; rows of the same turn by role, then text. A null role or text is an empty one. Rows whose
    conv is null are a conversation of their own. Repeated rows are turns like others. Other columns are not read, whatever
    their names. No rows give no rows. A conversation must fit in one row (2 GB of text).
    """
    t = template
    names = [n for n, _ in t.labels]
    goto = {(s, r): n for s, r, n in t.moves}
    states = range(REJECTED + 1)
    table = F.array(*[F.lit(goto.get((s, r), REJECTED)) for s in states for r in [*names, None]])
    width = len(names) + 1

    def index(r: Column) -> Column:
        out = F.lit(width)
        for i, n in enumerate(names):
            out = F.when(r == n, F.lit(i + 1)).otherwise(out)
        return out

    def step(acc: Column, x: Column) -> Column:
        after = F.transform(acc["at"], lambda s: F.element_at(table, s * width + index(x["role"])))
        bad = F.zip_with(after, acc["bad"], lambda s, b: F.when(b.isNull() & (s == REJECTED), acc["n"]).otherwise(b))
        return F.struct(after.alias("at"), bad.alias("bad"), (acc["n"] + 1).alias("n"))

    def segments(x: Column) -> Column:
        seg = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
        return F.array(
            seg(F.concat(F.lit(t.head), _label(x["role"], t), F.lit(t.sep)), F.lit(False)),
            seg(escaped(x["text"], t), x["role"].isin(*t.learned)),
            seg(F.lit(t.tail), F.lit(False)),
        )

    none = F.lit(None).cast("int")
    one = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    one = one.withColumn("block", F.floor(F.col("turn") / BLOCK))
    block = one.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    block = block.select(
        "conv",
        "block",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        F.aggregate("turns", F.struct(F.array(*[F.lit(s) for s in states]).alias("at"), F.array(*[none for _ in states]).alias("bad"), F.lit(0).alias("n")), step).alias("fold"),
    )
    whole = block.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "segments", "fold"))).alias("blocks"))
    end = F.aggregate(
        "blocks",
        F.struct(F.lit(START).alias("at"), none.alias("bad"), F.lit(0).alias("n")),
        lambda acc, b: F.struct(
            F.element_at(b["fold"]["at"], acc["at"] + 1).alias("at"),
            F.coalesce(acc["bad"], acc["n"] + F.element_at(b["fold"]["bad"], acc["at"] + 1)).alias("bad"),
            (acc["n"] + b["fold"]["n"]).alias("n"),
        ),
    )
    out = whole.select("conv", F.flatten(F.transform("blocks", lambda b: b["segments"])).alias("segments"), end.alias("end"))
    return out.select(
        F.col("conv").alias(conv),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("end.at").alias("state"),
        F.col("end.at").isin(*t.final).alias("valid"),
        F.col("end.bad").alias("first_invalid"),
    )


def parse_formatted(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>>: the turns, as they were before formatting."""
    t = template
    pieces = F.split(formatted, _quote(t.tail), -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def read(p: Column) -> Column:
        label = F.substring_index(F.substr(p, F.lit(len(t.head) + 1)), t.sep, 1)
        text = F.substr(p, F.length(label) + len(t.head) + len(t.sep) + 1)
        return F.struct(_role(label, t).alias("role"), unescaped(text, t).alias("text"))

    return F.transform(pieces, read)


def learned_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")


def digest(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What reading the output of format_conversations back gives, as lengths and hashes."""
    back = formatted.withColumn("turns", parse_formatted(F.col("formatted"), template)).withColumn("learned", learned_text(F.col("segments"), template))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("first_invalid").cast("long").alias("first_invalid"),
    )


PROBE = r"\### Assistant: </turn> ok"


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(PROBE).alias("text")
    )
    return digest(format_conversations(rows.unionByName(probe)))


#: first_invalid and valid come from the machine's rules said once more: which turns may follow which.
OP1_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) AS v(conv_id, turn, role, text)
), o AS (
  SELECT *, row_number() OVER w - 1 AS i, lag(role) OVER w AS before, count(*) OVER (PARTITION BY conv_id) AS n
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), j AS (
  SELECT *, NOT CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user' AND i = 1
    WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END AS bad
  FROM o
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(4 + 2 + 8 + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 ELSE 1 + 2 * octet_length(encode(role)) END
    + length(text) + length(text) - length(replace(text, '\', ''))
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
    + (length(text) - length(replace(text, '</turn>', ''))) // 7)::BIGINT AS formatted_chars,
  NOT bool_or(bad) AND max(role) FILTER (WHERE i = n - 1) = 'assistant' AS valid,
  min(i) FILTER (WHERE bad) AS first_invalid
FROM j GROUP BY conv_id
"""
