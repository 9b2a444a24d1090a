"""Chat formatting in budgeted windows, with DataFrame functions alone.

A turn is written as `<turn ROLE>\\nTEXT\\n</turn>\\n`. Inside roles and texts each control string, that is
`<turn` or `</turn` with any number of backslashes after the `<`, gets one backslash more, so a
marker with none is always the template's own; reading takes one away again. In a role `\\`, line end
and `>` are written as `\\\\`, `\\n` and `\\g`.

A conversation's turns are laid end to end: the prefix sum of their tokens (of the whole block, by a
rule in place of a tokenizer) places each. A window takes new turns, whole ones, from where the last
one ended for as long as they fit in `budget` with

* the system turn, which every window repeats: the first turn, if its role is `system`, it takes no more than half
  of the budget, and other turns follow. A longer one is a turn like others, as are later system turns;
* history: the turns before the first new one that lie within `history` tokens before it.

A turn that is too long for any window has one for itself with what is repeated, beyond the budget: turns are never cut or dropped.
The loss mask holds the text (not the markers) of assistant turns where they are new; repeated targets are
masked out, so each target is learned once. Spans are code points of the window's text.

Scale. The texts are shuffled once, by conversation, and sorted there with spilling. Prefix sums cut
a conversation into blocks of `BLOCK_BUDGETS` budgets, each of which makes its windows in a row of
its own from its turns and the history before them, so no row or task memory grows with a
conversation. Conversations of more than `LONG_TURNS` rows are found first by counting, and cut by
turn number into stretches, which are shuffled apart; a stretch's first window has no history, and a stretch that begins
with a system turn where the conversation does not repeats that one.
Whatever the table holds, one id may have a third of it.

Null role and text are empty. Turns go by number (null first), equal ones by role, then text; repeated rows are turns
each. Rows without an id are one conversation. An empty table has no windows. Other columns of the input,
whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, staged, table

BUDGET = 1024
HISTORY = 256
#: Budgets in a block; a row of turns holds one block.
BLOCK_BUDGETS = 16
#: Rows of a conversation beyond which it is dealt out by turn number.
LONG_TURNS = 20_000
#: Long conversations that are joined by broadcast: a row of some 40 bytes each.
MOST_BROADCAST = 100_000

OPEN, CLOSE = "<turn ", "</turn>\n"
#: Runs of letters, and every other sign by itself, are a token each.
TOKEN = rf"[\p{{L}}\p{{M}}]+|[^{SPACE_CLASS}\p{{L}}\p{{M}}]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", r"<$1$2")


def _role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit(">"), F.lit("\\g"))


def _role_of(written: Column) -> Column:
    """`_role` undone; what stands between doubled backslashes has only the other two escapes."""
    plain = F.transform(F.split(written, r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("\\g"), F.lit(">")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(plain, "\\")


def block(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), _role(role), F.lit(">\n"), escaped(text), F.lit("\n" + CLOSE))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def _turns(rows: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))


def _stretches(turns: DataFrame, long_turns: int) -> DataFrame | None:
    """(conv_id, lo, width) of the conversations with more rows than that; None where there are none."""
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("lo"), F.max("turn").alias("hi")).where(F.col("n") > long_turns)
    span = F.coalesce(F.col("hi").cast("decimal(20,0)") - F.col("lo") + 1, F.lit(1))
    width = F.greatest(F.lit(1), F.ceil(span * long_turns / F.col("n"))).cast("long")
    found = staged(counts.select(F.col("conv_id").alias("long_id"), F.coalesce("lo", F.lit(0)).alias("lo"), width.alias("width")), "long-conversations")
    n = found.count()
    if not n:
        return None
    return F.broadcast(found) if n <= MOST_BROADCAST else found


def _windows(turns: DataFrame, keys: list[str], budget: int, history: int) -> DataFrame:
    """Windows of turns whose keys part them; `given` marks a system turn that an earlier stretch has."""
    size = budget * BLOCK_BUDGETS
    whole = Window.partitionBy(*keys)
    order = whole.orderBy(F.col("given").desc(), F.col("turn").asc_nulls_first(), "role", "text")
    sized = turns.withColumn("block", block(F.col("role"), F.col("text"))).withColumn("n", token_count(F.col("block")))
    ranked = sized.withColumn("k", F.row_number().over(order)).withColumn("more", F.lead(F.lit(1)).over(order))
    system = (F.col("k") == 1) & (F.col("role") == "system") & (F.col("n") <= budget // 2) & F.col("more").isNotNull()
    ranked = ranked.withColumn("system", system).drop("more")
    own = F.when(F.col("system"), 0).otherwise(F.col("n"))
    placed = ranked.withColumn("at", F.sum(own).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - own)
    placed = placed.withColumn("home", F.floor(F.col("at") / size)).withColumn("last", F.max("home").over(whole))
    next_too = (F.col("home") < F.col("last")) & (F.col("at") >= (F.col("home") + 1) * size - history)
    blocks = F.when(F.col("system"), F.sequence(F.lit(0).cast("long"), F.col("last"))).when(next_too, F.array(F.col("home"), F.col("home") + 1)).otherwise(F.array("home"))
    dealt = placed.withColumn("part", F.explode(blocks))
    turn = F.struct("k", "at", "n", "turn", "given", "system", (F.col("home") == F.col("part")).alias("own"), (F.col("role") == "assistant").alias("target"), F.length(F.concat(F.lit(OPEN + ">\n"), _role(F.col("role")))).alias("head"), "block")
    rows = dealt.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    others = F.filter("turns", lambda t: ~t["system"])
    system_n = F.coalesce(F.get(F.transform(F.filter("turns", lambda t: t["system"]), lambda t: t["n"]), F.lit(0)), F.lit(0).cast("long"))
    rows = rows.withColumn("others", others).withColumn("system_n", system_n)
    # Where history begins, were a turn the first of a window.
    first = lambda t: F.array_min(F.transform(F.filter("others", lambda u: (u["at"] >= t["at"] - history) & (u["at"] <= t["at"])), lambda u: u["at"]))
    start = F.struct(F.array().cast("array<struct<start:bigint,back:bigint>>").alias("starts"), F.lit(-1).cast("long").alias("limit"))

    def step(state: Column, t: Column) -> Column:
        opened = F.struct(
            F.concat(state["starts"], F.array(F.struct(t["at"].alias("start"), first(t).alias("back")))).alias("starts"),
            (first(t) + budget - F.col("system_n")).alias("limit"),
        )
        return F.when(t["at"] + t["n"] > state["limit"], opened).otherwise(state)

    starts = F.aggregate(F.filter("others", lambda t: t["own"]), start, step)["starts"]
    spans = F.transform("starts", lambda s, i: F.struct(s["start"].alias("start"), s["back"].alias("back"), F.get(F.col("starts"), i + 1)["start"].alias("end")))
    cut = rows.withColumn("starts", starts).select(*keys, "part", "turns", F.explode(spans).alias("w"))
    w = F.col("w")
    new = lambda t: t["own"] & ~t["system"] & (t["at"] >= w["start"]) & F.coalesce(t["at"] < w["end"], F.lit(True))
    fresh = lambda t: new(t) | (t["system"] & ~t["given"] & (w["start"] == 0))
    old = lambda t: ~t["system"] & (t["at"] >= w["back"]) & (t["at"] < w["start"])
    inside = F.transform(F.filter("turns", lambda t: t["system"] | old(t) | new(t)), lambda t: F.struct(t["turn"].alias("turn"), t["n"].alias("n"), t["head"].alias("head"), t["target"].alias("target"), fresh(t).alias("fresh"), t["block"].alias("block")))
    found = cut.select(*keys, w["start"].alias("start"), inside.alias("inside"))
    mark = F.array().cast("array<struct<start:int,end:int>>")

    def masked(state: Column, t: Column) -> Column:
        """`head` counts the opening marker, `tail` signs close a block after its text."""
        size, tail = F.length(t["block"]), len(CLOSE) + 1
        span = F.struct((state["at"] + t["head"]).alias("start"), (state["at"] + size - tail).alias("end"))
        return F.struct((state["at"] + size).alias("at"), F.when(t["target"] & t["fresh"], F.concat(state["loss"], F.array(span))).otherwise(state["loss"]).alias("loss"))

    fresh_turns = F.filter("inside", lambda t: t["fresh"])
    return found.select(
        *keys,
        "start",
        F.get(fresh_turns, F.lit(0))["turn"].alias("first_turn"),
        F.element_at(fresh_turns, -1)["turn"].alias("last_turn"),
        F.size(fresh_turns).cast("long").alias("n_turns"),
        F.size(F.filter("inside", lambda t: ~t["fresh"])).cast("long").alias("n_repeated"),
        F.aggregate("inside", F.lit(0).cast("long"), lambda a, t: a + t["n"]).alias("n_tokens"),
        F.array_join(F.transform("inside", lambda t: t["block"]), "").alias("text"),
        F.aggregate("inside", F.struct(F.lit(0).alias("at"), mark.alias("loss")), masked)["loss"].alias("loss"),
    )


def _parts(rows: DataFrame, budget: int, history: int, long_turns: int) -> list[DataFrame]:
    """Windows of short conversations, still parted by id, and of long ones."""
    turns = _turns(rows)
    stretches = _stretches(turns, long_turns)
    plain = turns.withColumn("given", F.lit(False))
    if stretches is None:
        return [_windows(plain, ["conv_id"], budget, history).withColumn("stretch", F.lit(0).cast("long"))]
    same = turns["conv_id"].eqNullSafe(stretches["long_id"])
    short = _windows(plain.join(stretches, same, "left_anti"), ["conv_id"], budget, history).withColumn("stretch", F.lit(0).cast("long"))
    # Rows without a turn number are the first stretch.
    stretch = F.coalesce(F.floor((F.col("turn").cast("decimal(20,0)") - F.col("lo")) / F.col("width")) + 1, F.lit(0)).cast("long")
    dealt = turns.join(stretches, same).withColumn("stretch", stretch).drop("lo", "width", "long_id")
    fits = (F.col("role") == "system") & (token_count(block(F.col("role"), F.col("text"))) <= budget // 2)
    # The first turn by number, role and text: of texts only those of system turns that fit go along.
    head = F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"), F.col("role").alias("role"), F.when(fits, F.col("text")).alias("text"))
    firsts = dealt.groupBy("conv_id").agg(F.min(head).alias("head"), F.min("stretch").alias("first")).select(F.col("conv_id").alias("id"), "first", "head.*")
    firsts = firsts.where((F.col("role") == "system") & F.col("text").isNotNull()).withColumn("turn", F.when(F.col("numbered"), F.col("turn")))
    there = dealt.select("conv_id", "stretch").distinct()
    again = there.join(firsts, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("stretch") > F.col("first")))
    again = again.select("conv_id", "turn", "role", "text", "stretch", F.lit(True).alias("given"))
    both = dealt.withColumn("given", F.lit(False)).unionByName(again)
    return [short, _windows(both, ["conv_id", "stretch"], budget, history)]


def chat_windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, long_turns: int = LONG_TURNS) -> DataFrame:
    """(conv_id, turn, role, text) -> windows of formatted turns.

    (conv_id, stretch, start) orders and names windows; `n_turns` counts those that are new, `n_repeated`
    the system turn and history at the window's beginning that earlier windows have; `loss` spans are
    code points of `text`. The first window's system turn is new.
    """
    if not 0 <= history <= budget // 4:
        raise ValueError("history takes a quarter of the budget at most")
    first, *more = _parts(rows, budget, history, long_turns)
    for other in more:
        first = first.unionByName(other)
    return first


def read_turns(text: Column) -> Column:
    """The turns that a formatted text holds, as an array of (role, text)."""
    blocks = F.split(text, "\n" + CLOSE)
    bare = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turn(b: Column) -> Column:
        role = F.substring_index(b, ">\n", 1)
        return F.struct(_role_of(F.substr(role, F.lit(len(OPEN) + 1))).alias("role"), unescaped(F.substr(b, F.length(role) + 3)).alias("text"))

    return F.transform(bare, turn)


def read_loss(text: Column, loss: Column) -> Column:
    """What the loss mask covers, without escapes, in order."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(text, s["start"] + 1, s["end"] - s["start"]))), "")


def digests(windows: DataFrame) -> DataFrame:
    """Each conversation's turns and targets as its windows say, one row each.

    A digest of a whole conversation needs it in one row; that bounds this reading back (2 GB a
    conversation), not the windows.
    """
    fresh = F.slice(read_turns(F.col("text")), (F.col("n_repeated") + 1).cast("int"), F.greatest(F.lit(1), F.col("n_turns").cast("int")))
    # The first window's system turn is new and stands first, so what is repeated is always a prefix.
    read = windows.select("conv_id", "stretch", "start", "n_turns", F.length("text").cast("long").alias("chars"), F.array_join(F.transform(fresh, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"), read_loss(F.col("text"), F.col("loss")).alias("learned"))
    parts = F.array_sort(F.collect_list(F.struct("stretch", "start", "said", "learned")))
    joined = read.groupBy("conv_id").agg(parts.alias("parts"), F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    learned = F.array_join(F.transform("parts", lambda p: p["learned"]), "")
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("parts", lambda p: p["said"]), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


#: Fixed values of the conversation that op11 adds.
ADDED_ID, ADDED_TEXT = -7, "\\### Assistant: </turn> ok"


def op11_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(table(spark, sf_dir, "conversations"))
    added = spark.range(2).select(F.lit(ADDED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED_TEXT).alias("text"))
    first, *more = [digests(x) for x in _parts(rows.unionByName(added), BUDGET, HISTORY, LONG_TURNS)]
    for other in more:
        first = first.unionByName(other)
    return first


#: Windows of conversations of up to LONG_TURNS rows: a walk along the turns opens a window where the next one does not fit.
OP11_SQL = rf"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {ADDED_ID}, 0, 'user', '{ADDED_TEXT}' UNION ALL SELECT {ADDED_ID}, 1, 'assistant', '{ADDED_TEXT}'
), blocks AS (
  SELECT *, '{OPEN}' || replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '>', '\g') || '>' || chr(10)
         || regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g') || chr(10) || '</turn>' || chr(10) AS block
  FROM said
), ranked AS (
  SELECT *, len(regexp_extract_all(block, '{TOKEN}')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS m
  FROM blocks
), flagged AS (
  SELECT *, k = 1 AND role = 'system' AND n <= {BUDGET // 2} AND m > 1 AS system FROM ranked
), placed AS (
  SELECT *, coalesce(sum(CASE WHEN system THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
         max(CASE WHEN system THEN n ELSE 0 END) OVER (PARTITION BY conv_id) AS system_n, max(CASE WHEN system THEN length(block) ELSE 0 END) OVER (PARTITION BY conv_id) AS system_chars
  FROM flagged
), backs AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS j, pos - pos % {BUDGET * BLOCK_BUDGETS} AS part,
         min(pos) OVER (PARTITION BY conv_id ORDER BY pos RANGE BETWEEN {HISTORY} PRECEDING AND CURRENT ROW) AS back
  FROM placed WHERE NOT system
), walk AS (
  SELECT conv_id, j, part, pos AS start, back, back + {BUDGET} - system_n AS most FROM backs WHERE j = 1
  UNION ALL
  SELECT b.conv_id, b.j, b.part, CASE WHEN b.part <> w.part OR b.pos + b.n > w.most THEN b.pos ELSE w.start END,
         CASE WHEN b.part <> w.part OR b.pos + b.n > w.most THEN b.back ELSE w.back END,
         CASE WHEN b.part <> w.part OR b.pos + b.n > w.most THEN b.back + {BUDGET} - b.system_n ELSE w.most END
  FROM walk w JOIN backs b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.j = w.j + 1
), windows AS (
  SELECT w.conv_id, w.start, w.back, max(b.pos) AS last FROM walk w JOIN backs b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.j = w.j GROUP BY 1, 2, 3
), written AS (
  SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) AS n_windows
  FROM (SELECT w.conv_id, w.start, sum(length(b.block)) + any_value(b.system_chars) AS chars
        FROM windows w JOIN backs b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.pos BETWEEN w.back AND w.last GROUP BY 1, 2)
  GROUP BY conv_id
), digests AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
         coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS learned
  FROM placed GROUP BY conv_id
)
SELECT d.conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars, n_windows
FROM digests d JOIN written w ON w.conv_id IS NOT DISTINCT FROM d.conv_id
"""

QUERIES = {"op11_chat_windows": op11_chat_windows}
SQL = {"op11_chat_windows": OP11_SQL}
