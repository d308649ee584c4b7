"""Chat formatting in budgeted windows.

Turns are marked as ``[INST]role\ntext[/INST]``, assistant turns as ``<s>role\ntext</s>``. In
roles and texts each control string gets a backslash after its first character (one more where
there are some), which is undone exactly when read back. Prefix sums of turn tokens deal a
conversation into cells of ``CELL`` budgets; in each, spans are filled with turns up to the budget less
the history and the system turn. A span's window starts with the conversation's first system turn, if
that came before, repeats the turns that lie within ``history`` tokens before the span, as far as the
budget leaves room, then gives the span. The loss mask has the assistant texts of the span itself;
repeated ones are masked out.

Null texts and roles count as empty. Turns are ordered by turn, then role, then text, so ties
and repeated rows have one order; each row is a turn of its own. A null conv_id is a
conversation like any other. A turn is never cut, so no window is longer than the budget, unless the system turn
and a single turn are: that turn then has a window of its own, with nothing repeated but the system turn. An
empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chaptermill.llm.common import GAP, written

BUDGET, HISTORY = 512, 128
#: Budgets of tokens whose turns are dealt into spans together; a span ends with its cell.
CELL = 8
#: Turn numbers that one task sorts together.
STRETCH = 1024
#: Windows of a conversation that one task gives the system turn to.
BLOCK = 256
CONTROL = r"(INST\]|/INST\]|s>|/s>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\(\\*)" + CONTROL, r"$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Undo :func:`escape_role`: pairs of backslashes first, by a mark that no text holds alone."""
    plain = unescape(role)
    pieces = F.split(plain, r"\\\\")
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def tokens(text: Column) -> Column:
    """What a turn counts in the budget: its words and two for its marks."""
    return F.size(F.filter(F.split(text, GAP), lambda w: w != "")) + 2


def in_order(turns: DataFrame) -> DataFrame:
    """The turns with their conversation's key, pos (from 1), begin and end (prefix sums of tokens), target, header
    (the first system turn), and its header_pos and header_size (0 without one). Turns are sorted in stretches of turn numbers; only one row a stretch goes
    through the window of the whole conversation."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = turns.select(
        key.alias("conv"), "conv_id", F.coalesce(F.expr(f"turn div {STRETCH}"), F.lit(-(1 << 63))).alias("stretch"), "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), tokens(text).cast("long").alias("size")
    )
    is_system = F.col("role") == "system"
    own = Window.partitionBy("conv", "stretch").orderBy("turn", "role", "text")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    near = cut.select("*", F.row_number().over(own).alias("row"), F.sum("size").over(upto).alias("upto"), F.sum(is_system.cast("int")).over(upto).alias("systems"))
    first = F.when(is_system & (F.col("systems") == 1), F.struct("row", "size"))
    facts = near.groupBy("conv", "stretch").agg(F.count("*").alias("n"), F.sum("size").alias("sum"), F.max(first).alias("system"))
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    told = facts.select(
        "conv",
        "stretch",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum_before"),
        F.col("system"),
    )
    placed = F.when(F.col("system").isNotNull(), F.struct((F.col("rows_before") + F.col("system.row")).alias("pos"), F.col("system.size").alias("size")))
    told = told.withColumn("found", F.min(placed).over(Window.partitionBy("conv"))).drop("system")
    end = F.col("sum_before") + F.col("upto")
    pos = F.col("rows_before") + F.col("row")
    return near.join(told, ["conv", "stretch"]).select(
        "conv", "conv_id", "role", "text", pos.alias("pos"), (end - F.col("size")).alias("begin"), end.alias("end"), (F.col("role") == "assistant").alias("target"),
        F.coalesce(pos == F.col("found.pos"), F.lit(False)).alias("header"), F.coalesce("found.pos", F.lit(0)).alias("header_pos"), F.coalesce("found.size", F.lit(0)).alias("header_size"),
    )


def cuts(placed: DataFrame, budget: int, history: int) -> DataFrame:
    """conv, cell and opens: the pos of every turn that opens a span in a cell. A cell has a bounded number of tokens, so of turns."""
    room = budget - history
    turns = F.sort_array(F.collect_list(F.struct("pos", (F.col("end") - F.col("begin")).alias("size"), "header_pos", "header_size")))
    zero = F.struct(F.lit(0).cast("long").alias("fill"), F.array().cast("array<long>").alias("opens"))

    def step(acc: Column, t: Column) -> Column:
        fresh = (F.size(acc["opens"]) == 0) | (acc["fill"] + t["size"] > room)
        before = F.when(~_behind_header(t), 0).otherwise(t["header_size"])
        fill = F.when(fresh, before + t["size"]).otherwise(acc["fill"] + t["size"])
        return F.struct(fill.cast("long").alias("fill"), F.when(fresh, F.array_append(acc["opens"], t["pos"].cast("long"))).otherwise(acc["opens"]).alias("opens"))

    return placed.groupBy("conv", "cell").agg(F.aggregate(turns, zero, step)["opens"].alias("opens"))


def _behind_header(t) -> Column:
    return (t["header_pos"] > 0) & (t["pos"] > t["header_pos"])


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row a window: conv_id, window (rising along the conversation), formatted, repeated (pieces repeated at the start) and mask,
    an array of (start, length) in code points of ``formatted`` where the loss holds."""
    placed = in_order(turns).withColumn("cell", F.expr(f"begin div {CELL * budget}"))
    placed = placed.join(cuts(placed, budget, history), ["conv", "cell"])
    body = F.concat(escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")))
    piece = F.when(F.col("target"), F.concat(F.lit("<s>"), body, F.lit("</s>"))).otherwise(F.concat(F.lit("[INST]"), body, F.lit("[/INST]")))
    spans = placed.select(
        "conv", "conv_id", "pos", "target", "header", "begin", "end", piece.alias("piece"), F.length(escape(F.col("text"))).alias("text_chars"),
        F.array_max(F.filter("opens", lambda at: at <= F.col("pos"))).alias("window"), "header_pos", "header_size",
    )
    spans = written(spans, "chat-spans")  # read four times, each time other columns
    # A window is numbered by the turn that opens its span. What the span and the system turn leave is for history.
    spent = F.max("end") - F.min("begin") + F.max(F.when((F.col("header_pos") > 0) & (F.col("window") > F.col("header_pos")), F.col("header_size")).otherwise(0))
    starts = spans.groupBy("conv", "window").agg(F.min("begin").alias("start"), F.greatest(F.lit(0), F.least(F.lit(history), budget - spent)).alias("left"))
    own = spans.select("conv_id", "window", "pos", "piece", "target", "text_chars", F.lit(2).alias("part"))
    # A turn is repeated where a span starts at its end or later, at most ``history`` after its start.
    near = spans.filter(f"NOT header AND end - begin <= {history}")
    near = near.withColumn("cell", F.explode(F.sequence(F.expr(f"end div {budget}"), F.expr(f"(begin + {history}) div {budget}"))))
    repeated = (
        near.alias("t")
        .join(starts.withColumn("cell", F.expr(f"start div {budget}")).alias("s"), ["conv", "cell"])
        .filter(F.col("start").between(F.col("t.end"), F.col("t.begin") + F.col("left")))
        .select("t.conv_id", "s.window", "pos", "piece", F.lit(False).alias("target"), "text_chars", F.lit(1).alias("part"))
    )
    # The system turn meets the windows in blocks, so a long conversation is spread over tasks.
    blocks = starts.groupBy("conv").agg(F.expr(f"max(window) div {BLOCK}").alias("last"))
    headers = spans.filter("header").join(blocks, "conv").withColumn("block", F.explode(F.sequence(F.expr(f"window div {BLOCK}"), "last")))
    system = (
        headers.alias("t")
        .join(starts.withColumn("block", F.expr(f"window div {BLOCK}")).alias("s"), ["conv", "block"])
        .filter(F.col("t.window") < F.col("s.window"))
        .select("t.conv_id", "s.window", "pos", "piece", F.lit(False).alias("target"), "text_chars", F.lit(0).alias("part"))
    )
    parts = own.unionByName(repeated).unionByName(system)
    gathered = parts.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("part", "pos", "piece", "target", "text_chars"))).alias("parts"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))

    def masked(acc: Column, p: Column) -> Column:
        # The text ends where the piece's closing mark of four characters starts.
        span = F.struct((acc["at"] + F.length(p["piece"]) - 4 - p["text_chars"]).alias("start"), p["text_chars"].alias("length"))
        return F.struct((acc["at"] + F.length(p["piece"])).alias("at"), F.when(p["target"], F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"]).alias("mask"))

    return gathered.select(
        "conv_id",
        "window",
        F.array_join(F.col("parts.piece"), "").alias("formatted"),
        F.size(F.filter("parts", lambda p: p["part"] < 2)).alias("repeated"),
        F.aggregate("parts", zero, masked)["mask"].alias("mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """From windows: conv_id, window, turns (role and text, each once) and loss_texts, both unescaped."""
    pieces = F.regexp_extract_all("formatted", F.lit(r"(?s)(?:\[INST\]|<s>)(.*?)(?:\[/INST\]|</s>)"), F.lit(1))
    own = F.slice(pieces, F.col("repeated") + 1, F.greatest(F.size(pieces) - F.col("repeated"), F.lit(0)))
    turn = lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text"),
    )
    return formatted.select(
        "conv_id",
        "window",
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.transform(own, turn).alias("turns"),
        F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"]))).alias("loss_texts"),
    )


def digests(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Per conversation what :func:`read_back` gives, as digests. A digest covers a whole conversation,
    so one row holds its text here, and here only."""
    windowed = read_back(windows(turns, budget, history)).select(
        "conv_id",
        "window",
        "formatted_chars",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("loss_texts", "").alias("loss"),
    )
    rows = F.sort_array(F.collect_list(F.struct("window", "turns", "loss")))
    joined = windowed.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sum("formatted_chars").cast("long").alias("formatted_chars"),
        rows.alias("rows"),
    )
    loss = F.array_join("rows.loss", "")
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join("rows.turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts hold control strings."""
    probe = conversations.sparkSession.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 2 AS size,
    length(regexp_replace(role || chr(10) || text, '([\[<])(\\*)(INST\]|/INST\]|s>|/s>)', '\1\\\2\3', 'g'))
      + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END AS chars
  FROM c
), h AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY pos) AS tail,
    coalesce(min(CASE WHEN role = 'system' THEN pos END) OVER (PARTITION BY conv_id), 9000000000) AS hp FROM t
), e AS (
  SELECT *, pos = hp AS header, coalesce(max(CASE WHEN pos = hp THEN size END) OVER (PARTITION BY conv_id), 0) AS hs, (tail - size) // 4096 AS cell FROM h
), walk AS (
  SELECT conv_id, pos, cell, size AS fill, pos AS win FROM e WHERE pos = 1
  UNION ALL
  SELECT e.conv_id, e.pos, e.cell, CASE WHEN e.cell <> w.cell OR w.fill + e.size > 384 THEN CASE WHEN e.pos > hp THEN hs ELSE 0 END + e.size ELSE w.fill + e.size END,
    CASE WHEN e.cell <> w.cell OR w.fill + e.size > 384 THEN e.pos ELSE w.win END
  FROM walk w JOIN e ON e.conv_id = w.conv_id AND e.pos = w.pos + 1
), s AS (SELECT e.*, win FROM e JOIN walk w ON w.conv_id = e.conv_id AND w.pos = e.pos),
starts AS (
  SELECT conv_id, win, min(tail - size) AS start, greatest(0, least(128, 512 - (max(tail) - min(tail - size)) - max(CASE WHEN win > hp THEN hs ELSE 0 END))) AS room FROM s GROUP BY ALL
), again AS (
  SELECT s.conv_id, sum(chars) AS more FROM s JOIN starts w ON w.conv_id = s.conv_id AND w.win > s.win
  WHERE header OR start - (tail - size) <= room GROUP BY s.conv_id
)
SELECT s.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
  CAST(sum(chars) + coalesce(any_value(more), 0) AS BIGINT) AS formatted_chars
FROM s LEFT JOIN again ON again.conv_id = s.conv_id GROUP BY s.conv_id
"""
