"""Operator 1, chat formatting by a grammar round trip (native: only DataFrame functions).

The template marks turns with control strings::

    user        <s>[INST]TEXT[/INST]</s>
    assistant   <s>TEXT</s>
    other role  <s>[ROLE]NAME[TEXT]TEXT[/ROLE]</s>

A parser reads the rendered text back: every turn runs from ``<s>`` to the next ``</s>``, and its
first control string tells its form. Texts go in as they are; a turn that does not come back
identical is escaped (the first character of each control string, and the escape character itself,
are replaced by two-character codes, which the parser always undoes). The whole conversation is then
parsed again; should it still differ, all its turns are escaped. An escaped text has no control
string and no free escape character, so the last level always comes back identical.

Defined cases: a null text or role is empty, and the empty role is an "other role"; turns are
ordered by (turn, role, text), nulls first; repeated rows are repeated turns; a null conv_id is a
conversation of its own; an empty table gives no row; other columns are ignored. A conversation is
one output string, so its turns meet in one task: its length is bounded by a string's 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Control strings of the template.
OPEN, CLOSE = "<s>", "</s>"
INST, INST_END = "[INST]", "[/INST]"
ROLE, TEXT, ROLE_END = "[ROLE]", "[TEXT]", "[/ROLE]"

#: A control string without its first character, after that character.
_ANGLE = r"<(/?s>)"
_SQUARE = r"\[(/?INST\]|/?ROLE\]|TEXT\])"
#: One turn, as the parser takes it from the rendered text.
_TURN = r"(?s)<s>.*?</s>"

TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    r"""``\`` to ``\e``; then ``<`` and ``[`` before the rest of a control string to ``\o`` and ``\q``."""
    text = F.replace(text, F.lit("\\"), F.lit("\\e"))
    text = F.regexp_replace(text, _ANGLE, r"\\o$1")
    return F.regexp_replace(text, _SQUARE, r"\\q$1")


def unescape(text: Column) -> Column:
    r"""Undo :func:`escape`: ``\o`` and ``\q`` first, ``\e`` last, so that nothing is read twice."""
    text = F.replace(text, F.lit("\\o"), F.lit("<"))
    text = F.replace(text, F.lit("\\q"), F.lit("["))
    return F.replace(text, F.lit("\\e"), F.lit("\\"))


def render_turn(role: Column, text: Column) -> Column:
    """One turn in the template; role and text are already escaped where that is wanted."""
    return (
        F.when(role == "user", F.concat(F.lit(OPEN + INST), text, F.lit(INST_END + CLOSE)))
        .when(role == "assistant", F.concat(F.lit(OPEN), text, F.lit(CLOSE)))
        .otherwise(F.concat(F.lit(OPEN + ROLE), role, F.lit(TEXT), text, F.lit(ROLE_END + CLOSE)))
    )


def _inside(turn: Column, before: int, after: int) -> Column:
    return F.substring(turn, F.lit(before + 1), F.char_length(turn) - (before + after))


def parse_turn(turn: Column) -> Column:
    """A matched turn to its role and text, unescaped."""
    user = F.startswith(turn, F.lit(OPEN + INST)) & F.endswith(turn, F.lit(INST_END + CLOSE))
    other = F.startswith(turn, F.lit(OPEN + ROLE)) & F.endswith(turn, F.lit(ROLE_END + CLOSE))
    body = _inside(turn, len(OPEN + ROLE), len(ROLE_END + CLOSE))
    split = F.instr(body, TEXT)
    named = F.struct(
        unescape(F.substring(body, F.lit(1), split - 1)).alias("role"),
        unescape(F.substring(body, split + len(TEXT), F.char_length(body))).alias("text"),
    )
    plain = lambda role, before, after: F.struct(
        F.lit(role).alias("role"), unescape(_inside(turn, before, after)).alias("text")
    )
    return (
        F.when(user, plain("user", len(OPEN + INST), len(INST_END + CLOSE)))
        .when(other & (split > 0), named)
        .otherwise(plain("assistant", len(OPEN), len(CLOSE)))
    )


def parse(rendered: Column) -> Column:
    """All turns of a rendered conversation, as an array of (role, text).

    Whatever stands between two turns would be lost silently, so the parser compares the turns it
    found, put together, with its input and gives null when they differ.
    """
    found = F.regexp_extract_all(rendered, F.lit(_TURN), F.lit(0))
    return F.when(F.array_join(found, "") == rendered, F.transform(found, parse_turn))


def format_conversations(rows: DataFrame) -> DataFrame:
    """Format rows (conv_id, turn, role, text) into one row per conversation.

    Returns conv_id, formatted, turns (read back), loss_spans (start and end, in code points, of
    each assistant text as it stands in ``formatted``), loss_text (what stands under these spans,
    unescaped), escape_level (0 none, 1 the turns that need it, 2 all) and round_trip (true: what is
    read back equals the source).
    """
    source = rows.select(
        "conv_id",
        F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("said"),
    )
    grouped = source.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    grouped = grouped.select("conv_id", F.transform("said", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"))
    full = lambda x: render_turn(F.when(x["role"].isin("user", "assistant"), x["role"]).otherwise(escape(x["role"])), escape(x["text"]))
    bare = lambda x: render_turn(x["role"], x["text"])
    safe = lambda x: F.coalesce(parse(bare(x)) == F.array(x), F.lit(False))
    pieces = grouped.withColumn("safe", F.transform("source", safe)).select(
        "conv_id",
        "source",
        F.array_join(F.zip_with("source", "safe", lambda x, ok: F.when(ok, bare(x)).otherwise(full(x))), "").alias("mixed"),
        F.exists("safe", lambda ok: ~ok).alias("some"),
    )
    # The conversation as a whole: identical, or escaped throughout.
    first = pieces.withColumn("fits", F.coalesce(parse(F.col("mixed")) == F.col("source"), F.lit(False)))
    chosen = first.select(
        "conv_id",
        "source",
        F.when(F.col("fits"), F.col("mixed")).otherwise(F.array_join(F.transform("source", full), "")).alias("formatted"),
        F.when(F.col("fits"), F.col("some").cast("int")).otherwise(F.lit(2)).alias("escape_level"),
    )
    return _masked(chosen.select("conv_id", "formatted", "escape_level", F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False)).alias("round_trip")))


def _masked(formatted: DataFrame) -> DataFrame:
    """Add turns, loss_spans and loss_text to formatted conversations.

    A turn becomes a row, so that a running sum of lengths gives its place, and the rows meet again:
    all by conv_id, as the conversations are already dealt. The mask covers an assistant's turn but
    for the control strings at its ends; the text under it is cut out of the turn by the mask's offsets.
    """
    pieces = F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(0))
    turns = formatted.select("conv_id", "escape_level", "round_trip", F.posexplode(pieces).alias("k", "piece"))
    order = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    length = F.char_length("piece").cast("long")
    loss = ~F.startswith("piece", F.lit(OPEN + INST)) & ~F.startswith("piece", F.lit(OPEN + ROLE))
    begun = turns.withColumn("begin", F.sum(length).over(order) - length)
    begun = begun.withColumn("start", F.when(loss, F.col("begin") + len(OPEN))).withColumn("end", F.when(loss, F.col("begin") + length - len(CLOSE)))
    under = F.substring("piece", (F.col("start") - F.col("begin") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    rows = begun.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("k", "piece", "start", "end", under.alias("under")))).alias("t"),
        F.first("escape_level").alias("escape_level"),
        F.first("round_trip").alias("round_trip"),
    )
    masked = F.filter("t", lambda x: x["start"].isNotNull())
    return rows.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("t", lambda x: parse_turn(x["piece"])).alias("turns"),
        F.transform(masked, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss_spans"),
        F.array_join(F.transform(masked, lambda x: unescape(x["under"])), "").alias("loss_text"),
        "escape_level",
        "round_trip",
    )


def loss_spans(formatted: DataFrame) -> DataFrame:
    """The loss mask of formatted conversations as rows (conv_id, start, end), ends exclusive, in code points of ``formatted``."""
    return formatted.select("conv_id", F.inline("loss_spans"))


def _hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns: of the turns as the parser read them back, and of the text under the loss mask."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _hex(whole).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        _hex(F.col("loss_text")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "escape_level",
        "round_trip",
    )


#: The conversation of the contract, which says the template's own control strings.
CONFLICT = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # range() and not createDataFrame(): a local list would come in through Python.
    own = spark.range(2, numPartitions=1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(CONFLICT).alias("text"),
    )
    return digests(format_conversations(rows.unionByName(own)))


QUERIES = {"op1_chat_formatting": op1_chat_formatting}

#: formatted_chars: 16 and 7 characters of control strings around a user's and an assistant's text, 26 and the name for others.
ORACLE_SQL = {
    "op1_chat_formatting": r"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (
  SELECT *, replace(text, '\', '\e') AS t1 FROM src),
esc2 AS (
  SELECT *, regexp_replace(regexp_replace(t1, '<(/?s>)', '\\o\1', 'g'), '\[(/?INST\]|/?ROLE\]|TEXT\])', '\\q\1', 'g') AS escaped,
    regexp_matches(text, '</?s>|\[/?INST\]|\[/?ROLE\]|\[TEXT\]|\\[oqe]') AS clash FROM esc)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE role WHEN 'user' THEN 20 WHEN 'assistant' THEN 7 ELSE 26 + length(role) END
    + length(CASE WHEN clash THEN escaped ELSE text END)) AS BIGINT) AS formatted_chars,
  CAST(max(CASE WHEN clash THEN 1 ELSE 0 END) AS INTEGER) AS escape_level,
  true AS round_trip
FROM esc2 GROUP BY conv_id
"""
}
