r"""Chat formatting in budgeted windows (operator 8), in DataFrame functions only.

A turn is written as ``### <role>: <text></turn>\n``. Inside a text a backslash is doubled, ``##`` becomes ``#\#`` and
``</turn>`` becomes ``<\/turn>``, so neither mark can appear in it; a role has ``%``, ``:``, ``<`` and ``#`` as
%25, %3A, %3C and %23. Both can be undone exactly.

Prefix sums of turn tokens, the system turn's left out, give each turn its offset in the conversation. What the system turn and
the history leave of the budget is the room for new turns. Cells of a stride of tokens cut the offsets: the stride is the room less
the longest turn, half the room at least. The turns that begin in a cell make a window, so spans are turn-aligned, no turn waits for
another one's decision, and even with the last turn's crossing of the cell's end they fit the room. A turn of over half the room, where the stride is half of it,
is a window alone; it is always the last that begins in its cell. A window repeats the turns before its first new one as far as they
fit both the history and what the budget still has, and starts with the conversation's system turn. So no window
exceeds the budget but one whose single new turn does so together with the system turn. What is repeated is never under the loss mask, so
each assistant text is a target once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes a token, and tokens of the marks around a turn.
TOKEN_BYTES, TURN_TOKENS = 4, 8
#: Tokens of a window, and those of them that repeated turns may take.
BUDGET, HISTORY = 512, 128
END = "</turn>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.regexp_replace(text, "#(?=#)", r"#\\"), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def escape_role(role: Column) -> Column:
    for mark, code in (("%", "%25"), (":", "%3A"), ("<", "%3C"), ("#", "%23")):
        role = F.replace(role, F.lit(mark), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for mark, code in (("#", "%23"), ("<", "%3C"), (":", "%3A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(mark))
    return role


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, repeated, tokens, formatted and mask of each window of each conversation in turns.

    repeated is how many of its first turns are repeated ones, the system turn with them; tokens is what all its turns take;
    mask is an array of (start, length) in code points of formatted, one for each assistant turn that is new there. Window numbers
    rise along the conversation, with gaps. Turns are in the order of turn, then role,
    then text. Defined results: a null role or text is an empty one; repeated rows are turns of their own; null turns
    come first; null conv_ids make one conversation; other columns aren't looked at; no rows, no windows; without history nothing
    but the system turn is repeated.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", F.ceil((F.octet_length("text") + F.octet_length("role")) / F.lit(TOKEN_BYTES)) + TURN_TOKENS)
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("place", F.row_number().over(order)).withColumn("system", (F.col("place") == 1) & (F.col("role") == "system"))
    t = t.withColumn("own", F.when(F.col("system"), 0).otherwise(F.col("tokens")))
    t = t.withColumns({
        "offset": F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("own"),
        "longest": F.max("own").over(whole), "head": F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(whole),
    })
    t = t.withColumn("room", F.greatest(F.lit(budget - history) - F.col("head"), F.lit(2)))
    t = t.withColumn("stride", F.greatest(F.col("room") - F.col("longest"), F.expr("room - room div 2")))
    t = t.withColumn("window", F.expr("2 * (offset div stride) + int(own > room - stride)"))
    t = t.withColumn("window", F.when(F.col("system"), F.coalesce(F.min(F.when(~F.col("system"), F.col("window"))).over(whole), F.lit(0))).otherwise(F.col("window")))
    span = Window.partitionBy("conv_id", "window")
    t = t.withColumns({"new": F.sum("own").over(span), "first": F.min("place").over(span)})
    line = F.concat(F.lit("### "), escape_role(F.col("role")), F.lit(": "))
    t = t.withColumn("turn_text", F.concat(line, escape(F.col("text")), F.lit(END)))
    loss = F.when(F.col("role") == "assistant", F.struct(F.char_length(line).alias("skip"), (F.char_length("turn_text") - F.char_length(line) - len(END)).alias("length")))
    t = t.select("conv_id", "window", "offset", "place", "system", "head", "new", "first", "tokens", "turn_text", loss.alias("loss"))
    new = t.select("conv_id", "window", F.lit(False).alias("again"), "place", "tokens", "turn_text", "loss")
    # what may be repeated begins less than history tokens before a window: both meet on the piece of that many tokens which it begins in
    piece = F.floor(F.col("offset") / max(history, 1))
    asks = t.where((F.col("place") == F.col("first")) & (F.col("window") > 0)).select(
        F.col("conv_id").alias("__conv"), F.col("window").alias("__window"), F.col("offset").alias("__offset"), F.explode(F.array(piece - 1, piece)).alias("__piece"),
        F.least(F.lit(history), F.lit(budget) - F.col("head") - F.col("new")).alias("__spare"))
    meets = F.col("conv_id").eqNullSafe(F.col("__conv")) & (piece == F.col("__piece")) & (F.col("offset") < F.col("__offset")) & (F.col("__offset") - F.col("offset") <= F.col("__spare"))
    tail = t.where(~F.col("system")).join(asks, meets)
    tail = tail.select("conv_id", F.col("__window"), F.lit(True), "place", "tokens", "turn_text", F.lit(None).cast(new.schema["loss"].dataType))
    group = new.unionAll(tail).groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("place", "again", "tokens", "turn_text", "loss"))).alias("turns"))
    systems = t.where("system").select(F.col("conv_id").alias("__conv"), F.struct("place", F.lit(True).alias("again"), "tokens", "turn_text", F.lit(None).cast(new.schema["loss"].dataType).alias("loss")).alias("head"))
    group = group.join(systems, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    group = group.withColumn("turns", F.when(F.col("head").isNotNull() & (F.col("turns")[0]["place"] != F.col("head")["place"]), F.concat(F.array("head"), "turns")).otherwise(F.col("turns")))
    mask = F.expr(
        "filter(aggregate(turns, named_struct('at', 0, 'mask', array(named_struct('start', -1, 'length', 0))), "
        "(s, x) -> named_struct('at', s.at + char_length(x.turn_text), 'mask', if(x.loss is null, s.mask, "
        "concat(s.mask, array(named_struct('start', s.at + x.loss.skip, 'length', x.loss.length))))), s -> s.mask), m -> m.start >= 0)"
    )
    return group.select("conv_id", "window", F.expr("size(filter(turns, x -> x.again))").alias("repeated"), F.expr("aggregate(turns, 0L, (s, x) -> s + x.tokens)").alias("tokens"), F.expr("concat_ws('', transform(turns, x -> x.turn_text))").alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The conversations that windows hold, each turn once, and the texts under their masks; all taken from the formatted text.

    conv_id, turns (array of role and text), targets (array of texts) and formatted_chars.
    """
    raw = F.expr(f"slice(split(formatted, '{END}', -1), repeated + 1, greatest(size(split(formatted, '{END}', -1)) - 1 - repeated, 0))".replace("\n", "\\n"))
    role, text = F.expr("transform(raw, x -> substring_index(substr(x, 5), ': ', 1))"), F.expr("transform(raw, x -> substr(x, locate(': ', x) + 2))")
    w = formatted.withColumn("raw", raw).withColumns({"role": role, "text": text})
    w = w.withColumn("turns", F.transform(F.arrays_zip("role", "text"), lambda x: F.struct(unescape_role(x.role).alias("role"), unescape(x.text).alias("text"))))
    w = w.withColumn("targets", F.transform(F.expr("transform(mask, m -> substr(formatted, m.start + 1, m.length))"), unescape))
    whole = w.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("all"), F.sum(F.char_length("formatted")).alias("formatted_chars"))
    return whole.select("conv_id", F.flatten(F.expr("transform(all, x -> x.turns)")).alias("turns"), F.flatten(F.expr("transform(all, x -> x.targets)")).alias("targets"), "formatted_chars")


def digests(conversations: DataFrame) -> DataFrame:
    """What read_back gives, as counts and hashes: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = F.expr(r"concat_ws('', transform(turns, x -> concat(x.role, '\n', x.text, '\n')))")
    loss = F.concat_ws("", "targets")
    return conversations.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars")
    )


#: The same digests from the table itself; formatted_chars from the rule for windows at the default budget and history.
SQL = r"""
WITH extra(conv_id, turn, role, text) AS (VALUES
  (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
      (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM extra)),
o AS (SELECT *, row_number() OVER w AS place, row_number() OVER w = 1 AND role = 'system' AS sys FROM
      (SELECT *, cast(ceil((strlen(text) + strlen(role)) / 4.0) AS BIGINT) + 8 AS tokens,
         length(role) + 2 * (length(role) - length(translate(role, '%:<#', '')))
         + 2 * length(text) - length(replace(text, '\', ''))
         + length(text) - length(replace(text, '#', '')) - len(regexp_extract_all(text, '#+'))
         + (length(text) - length(replace(text, '</turn>', ''))) // 7 + 14 AS chars FROM t)
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, CASE WHEN sys THEN 0 ELSE tokens END AS own FROM o),
q AS (SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY place) - own AS start,
        max(CASE WHEN sys THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS head,
        max(CASE WHEN sys THEN chars ELSE 0 END) OVER (PARTITION BY conv_id) AS head_chars,
        max(own) OVER (PARTITION BY conv_id) AS longest FROM p),
r AS (SELECT *, greatest(512 - 128 - head, 2) AS room FROM q),
s AS (SELECT *, greatest(room - longest, room - room // 2) AS stride FROM r),
v AS (SELECT *, 2 * (start // stride) + CASE WHEN own > room - stride THEN 1 ELSE 0 END AS cell FROM s),
k AS (SELECT *, CASE WHEN sys THEN coalesce(min(cell) FILTER (WHERE NOT sys) OVER (PARTITION BY conv_id), 0) ELSE cell END AS win FROM v),
c AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
        sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        sum(chars) + (count(DISTINCT win) - 1) * max(head_chars) AS base FROM k GROUP BY conv_id),
w AS (SELECT conv_id, win, min(start) AS start, least(128, 512 - max(head) - sum(own)) AS spare FROM k GROUP BY conv_id, win),
h AS (SELECT k.conv_id, sum(chars) AS again FROM k JOIN w ON k.conv_id = w.conv_id AND NOT sys AND k.start < w.start
        AND w.start - k.start <= w.spare GROUP BY k.conv_id)
SELECT c.conv_id, cast(n_turns AS BIGINT) AS n_turns, turns_sha256, cast(loss_chars AS BIGINT) AS loss_chars, loss_sha256,
  cast(base + coalesce(again, 0) AS BIGINT) AS formatted_chars FROM c LEFT JOIN h ON c.conv_id = h.conv_id
"""
