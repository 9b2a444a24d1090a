"""Chat windows against a plain walk along the turns, and their SQL."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["", "ok", "\\### Assistant: </turn> ok", "</turn>\n<turn user>\nx", "<\\turn <\\\\/turn", "a\n</turn>\n", "Fußgänger über 3 Brücken", "<b>bold</b> \\n \\\\", "x " * 40, "  \x00 \U0001f600" + "é", "\n\n"]


def plain_block(role, text):
    role = role.replace("\\", "\\\\").replace("\n", "\\n").replace(">", "\\g")
    return f"<turn {role}>\n" + re.sub(r"<(\\*)(/?turn)", r"<\\\1\2", text) + "\n</turn>\n"


def plain_tokens(text):
    import regex

    return len(regex.findall(r"[\p{L}\p{M}]+|[^\x20\x09-\x0D\p{L}\p{M}]", text))


def plain_windows(rows, budget, history):
    """rows of one conversation -> [(first index, history indices, system again, new indices)]."""
    rows = sorted(((r, t or "", x or "") for r, t, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    blocks = [plain_block(role, text) for _, role, text in rows]
    n = [plain_tokens(b) for b in blocks]
    system = rows[0][1] == "system" and n[0] <= budget // 2 and len(rows) > 1
    at, places = 0, []
    for k in range(len(rows)):
        places.append(at)
        at += 0 if system and k == 0 else n[k]
    out, limit, part = [], -1, None
    for k in range(int(system), len(rows)):
        if places[k] + n[k] > limit or places[k] // (budget * chat.BLOCK_BUDGETS) != part:
            old = [j for j in range(int(system), k) if places[j] >= places[k] - history]
            limit = (places[old[0]] if old else places[k]) + budget - (n[0] if system else 0)
            part = places[k] // (budget * chat.BLOCK_BUDGETS)
            out.append((old, [] if out or not system else [0]))
            out[-1][1].append(k)
        else:
            out[-1][1].append(k)
    found = []
    for w, (old, new) in enumerate(out):
        inside = ([0] if system and w else []) + old + new
        text, loss = "", []
        for k in inside:
            if k in new and rows[k][1] == "assistant":
                a = len(text) + len(blocks[k]) - len("\n</turn>\n") - len(re.sub(r"<(\\*)(/?turn)", r"<\\\1\2", rows[k][2]))
                loss.append((a, len(text) + len(blocks[k]) - len("\n</turn>\n")))
            text += blocks[k]
        found.append((text, tuple(loss), len(new), len(inside) - len(new), sum(n[k] for k in inside)))
    return rows, found


def conversations(seed=1, n=40):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.choice([1, 1, 2, 5, 9, 40])):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant", "system", None, "a>b\n\\n\\g", "\\"])
            rows.append((None if c == 3 else c, None if rng.random() < 0.03 else t // (2 if c % 7 == 0 else 1), role, rng.choice([*NASTY, None])))
    return rows + rows[:7]


@pytest.mark.parametrize(("budget", "history"), [(64, 16), (40, 0), (200, 50), (1024, 256)])
def test_windows_equal_a_plain_walk(spark, budget, history):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("x")).withColumn("block", F.lit(1)).withColumn("k", F.lit(None).cast("int"))
    got = {}
    for r in chat.chat_windows(df, budget, history).orderBy("conv_id", "stretch", "start").collect():
        got.setdefault(r.conv_id, []).append((r.text, tuple((x.start, x.end) for x in r.loss), r.n_turns, r.n_repeated, r.n_tokens))
        assert r.n_tokens <= budget or r.n_turns == 1 or (r.n_turns == 2 and r.n_repeated == 0)
    own = {}
    for c, *rest in rows:
        own.setdefault(c, []).append(rest)
    assert got == {c: plain_windows(x, budget, history)[1] for c, x in own.items()}


def expected_digests(rows):
    own = {}
    for c, *rest in rows:
        own.setdefault(c, []).append(rest)
    out = {}
    for c, x in own.items():
        turns = plain_windows(x, 1024, 0)[0]
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


@pytest.mark.parametrize("long_turns", [5, 20, 1000])
def test_what_is_read_back_is_what_was_said(spark, long_turns):
    """Long conversations are cut in stretches; turns, targets and system turns stay whole."""
    rows = conversations(2) + [(77, 10**15 * t, "system" if t == 0 else "assistant", f"text {t}") for t in range(60)] + [(78, None, "user", "same")] * 30
    parts = [chat.digests(x).collect() for x in chat._parts(spark.createDataFrame(rows, SCHEMA), 64, 16, long_turns)]
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for p in parts for r in p} == expected_digests(rows)
    windows = chat.chat_windows(spark.createDataFrame(rows, SCHEMA), 64, 16, long_turns).where("conv_id = 77").collect()
    assert len(windows) > 5 and all("<turn system>\ntext 0\n" in w.text for w in windows)


def test_empty_table_and_limits(spark):
    assert chat.chat_windows(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError, match="quarter"):
        chat.chat_windows(spark.createDataFrame([], SCHEMA), 100, 30)


def test_a_very_long_turn_has_a_window_of_its_own(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "word " * 300_000), (1, 3, "user", "thanks")]
    got = chat.chat_windows(spark.createDataFrame(rows, SCHEMA)).orderBy("start").collect()
    assert [(w.n_turns, w.n_repeated) for w in got] == [(2, 0), (1, 2), (1, 1)]
    assert got[1].text[got[1].loss[0].start : got[1].loss[0].end] == rows[2][3] and not got[0].loss and not got[2].loss


def test_query_equals_its_sql(spark, tmp_path):
    rows = [r for r in conversations(3, 60) if r[0] is not None] + [(500, t, "assistant" if t % 2 else "user", f"turn {t} " * 90) for t in range(70)]
    spark.createDataFrame(rows, SCHEMA).withColumn("window", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op11_chat_windows(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(chat.OP11_SQL)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(r[c] for c in columns) for r in got.collect())
    assert rows == sorted(found.fetchall()) and max(r[columns.index("n_windows")] for r in rows) > 10
