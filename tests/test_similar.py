"""Rewritings, splits and similar words against plain searches."""

import math
import random

import pytest

from quillspark.operators import lexicon, similar, suggest


def asked(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def lists(df):
    out = {}
    for r in df.orderBy("rank").collect():
        out.setdefault((r.word, r.dictionary), []).append(r.suggestion)
    return out


def test_rewritings(spark):
    rules = lexicon.parse_affixes("REP 5\nREP f ph\nREP ^alot$ a_lot\nREP en$ in\nREP ph f\nREP ei ie\nMAP 1\nMAP uü(ue)\n")
    words = ["phone", "a", "lot", "cabin", "fief", "uber", "über", "Muesli", "Müsli", "receive", "pheph"]
    lex = lexicon.from_words(spark, words, "d").unionByName(lexicon.from_words(spark, ["lot", "Fone"], "e"))
    got = lists(similar.rewritten(asked(spark, ["fone", "ALOT", "alota", "caben", "feif", "uEber", "musli", "pheph", "fefe", "", None, "phone"]), lex, rules))
    assert got == {
        ("fone", "d"): ["phone"], ("ALOT", "d"): ["A LOT"], ("caben", "d"): ["cabin"], ("feif", "d"): ["fief"], ("uEber", "d"): ["uber", "über"], ("musli", "d"): ["müsli", "muesli"], ("phone", "e"): ["fone"],
    }
    assert similar.rewritten(asked(spark, ["fone"]), lex, lexicon.AffixRules()).count() == 0


def test_splits(spark):
    lex = lexicon.from_words(spark, ["sun", "sunday", "day", "dayshine", "shine", "a"], "d").unionByName(lexicon.from_words(spark, ["day"], "e"))
    got = lists(similar.split_in_two(asked(spark, ["Sundayshine", "sunsun", "aday", "sun", "daysun", "x", "", None]), lex))
    assert got == {("Sundayshine", "d"): ["sunday shine", "sun dayshine"], ("sunsun", "d"): ["sun sun"], ("aday", "d"): ["a day"], ("daysun", "d"): ["day sun"]}


def plain_similar(words, known, least):
    def grams(w):
        t = f" {w.lower()} "
        return {t[k : k + 3] for k in range(len(t) - 2)}

    n = len(known)
    df = {}
    for k in known:
        for g in grams(k):
            df[g] = df.get(g, 0) + 1
    weight = lambda g: round(1000 * math.log(1 + n / df.get(g, 1)))
    out = {}
    for w in words:
        found = []
        for k in known:
            a, b = grams(w), grams(k)
            common = sum(map(weight, a & b))
            union = sum(map(weight, a | b))
            if w.lower() != k and common * 100 >= union * least:
                found.append((-common / union, k))
        if found:
            out[w, "d"] = [k for _, k in sorted(found)[:5]]
    return out


@pytest.mark.parametrize("least", [20, 40, 70])
def test_similar_words_equal_all_pairs(spark, least):
    rng = random.Random(least)
    word = lambda: "".join(rng.choice(["an", "be", "co", "di", "é", "s", "t"]) for _ in range(rng.randint(1, 6)))
    known = sorted({word() for _ in range(150)})
    words = sorted({word() for _ in range(60)})
    got = lists(similar.similar(asked(spark, [*words, "", None]), lexicon.from_words(spark, known, "d"), least))
    assert got == plain_similar(words, known, least) and got


def test_similar_words_over_parts_of_both_sides(spark, monkeypatch):
    monkeypatch.setattr(similar, "ASKED", 7)
    monkeypatch.setattr(similar, "GIVEN", 20)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "be", "é", "s"]) for _ in range(rng.randint(1, 6)))
    known, words = sorted({word() for _ in range(150)}), sorted({word() for _ in range(60)})
    two = lexicon.from_words(spark, known, "d").unionByName(lexicon.from_words(spark, known[::2], "e"))
    found = similar.similar(asked(spark, words), two)
    got = lists(found)
    assert {k: v for k, v in got.items() if k[1] == "d"} == plain_similar(words, known, similar.LEAST) and any(k[1] == "e" for k in got)
    # No row for each pair that shares a trigram: words meet in parts.
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "[gram" not in plan
    assert similar.similar(asked(spark, words), two.limit(0)).count() == 0 and similar.similar(asked(spark, []), two).count() == 0


def test_all_sources_together(spark):
    rules = lexicon.parse_affixes("REP 1\nREP f ph\n")
    lex = lexicon.from_words(spark, ["phone", "tone", "fine", "alpha", "beta", "correspondence"], "d").unionByName(lexicon.from_words(spark, ["bone", "corresponding"], "e"))
    got = {r.word: r.suggestions for r in suggest.suggestions(asked(spark, ["fone", "alphabeta", "corespondanse", "qqqqqq", "tone"]), lex, ["d", "e"], rules={"d": rules}).collect()}
    assert got["fone"] == ["phone", "bone", "fine", "tone"] and got["alphabeta"] == ["alpha beta"] and got["corespondanse"][0] == "corresponding"
    assert set(got) == {"fone", "alphabeta", "corespondanse"}
    empty = suggest.suggestions(asked(spark, []), lex, ["d", "e"], rules={"d": rules})
    assert empty.count() == 0


def plain_parts(words, known, rules):
    """(word) -> rewritten, split: the first five each, by trying all places."""
    made, cut = {}, {}
    for w in words:
        k, best = w.lower(), {}
        for place, (a, b, *_) in enumerate(rules):
            for at in range(len(k)):
                if k[at:].startswith(a):
                    new = k[:at] + b + k[at + len(a) :]
                    if set(new.split(" ")) <= known:
                        best[new] = min(best.get(new, (place, at)), (place, at))
        halves = [(abs(2 * at - len(k)), f"{k[:at]} {k[at:]}") for at in range(1, len(k)) if {k[:at], k[at:]} <= known]
        for out, found in ((made, sorted((v, x) for x, v in best.items())), (cut, sorted(halves))):
            if found:
                out[w, "d"] = [x for _, x in found[:5]]
    return made, cut


def test_rewritings_and_splits_are_dealt_by_the_letters_asked(spark, monkeypatch):
    monkeypatch.setattr(similar, "LETTERS", 100, raising=False)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["an", "be", "é", "s", "nd"]) for _ in range(rng.randint(1, 6)))
    # Very many words begin with one known word.
    known = {*(word() for _ in range(200)), "s"}
    words = sorted({*(word() for _ in range(150)), *("s" + word() for _ in range(150))} - known)
    rules = lexicon.parse_affixes("REP 4\nREP an ben\nREP nd d_s\nREP s an\nREP be s_s\nMAP 1\nMAP eé\n")
    lex = lexicon.from_words(spark, sorted(known), "d")
    made, cut = plain_parts(words, known, similar.replacements(rules))
    for rows, want in ((similar.rewritten(asked(spark, [*words, "", None]), lex, rules), made), (similar.split_in_two(asked(spark, [*words, "", None]), lex), cut)):
        # The session has 4 partitions and its rows are few, but no task holds more than its share.
        sizes = [len(x) for x in rows.rdd.glom().collect()]
        assert len(sizes) >= sum(map(len, words)) // 100 > 8 and max(sizes) <= sum(sizes) / 3
        assert lists(rows) == want and len(want) > 10
