"""Compound rules against a plain search over all ways to cut a word."""

import functools
import itertools
import random
import re

import pytest

from quillspark.operators import affix, compound_rules, lexicon

ORDINALS = "COMPOUNDMIN 1\nONLYINCOMPOUND c\nCOMPOUNDRULE 2\nCOMPOUNDRULE n*1t\nCOMPOUNDRULE n*mp\n"
NUMBERS = ["0/nm", "1/n1", "2/nm", "3/nm", "4/nm", "5/nm", "6/nm", "7/nm", "8/nm", "9/nm", "0th/pt", "1st/p", "1th/tc", "2nd/p", "2th/tc", "3rd/p", "3th/tc", "4th/pt", "5th/pt", "6th/pt", "7th/pt", "8th/pt", "9th/pt"]


def known(spark, aff, stems):
    rules = lexicon.parse_affixes(aff)
    return affix.read_stems(spark.createDataFrame([(s,) for s in stems], "value string"), rules, "x")


def run(spark, aff, stems, words):
    return {r.word for r in compound_rules.accepted(spark.createDataFrame([(w,) for w in words], "word string"), known(spark, aff, stems)).collect()}


def ordinal(n):
    return f"{n}{'th' if n % 100 in (11, 12, 13) else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


def test_ordinals(spark):
    words = [f"{n}{end}" for n in [*range(10, 131), 1000, 1011, 56714, 99999] for end in ("st", "nd", "rd", "th")]
    right = {ordinal(n) for n in [*range(10, 131), 1000, 1011, 56714, 99999]}
    assert run(spark, ORDINALS, NUMBERS, [*words, "1st", "12", "", None, "th", "22ND", "x22nd", "7" * 300 + "4th"]) == right | {"22ND", "7" * 300 + "4th"}


def plain(aff, stems, word):
    """All cuts of a word, with a regular expression for each rule."""
    rules = lexicon.parse_affixes(aff)
    parts = {}
    for s in stems:
        stem, _, flags = s.partition("/")
        if len(stem) >= rules.compound_min and "x" not in flags:
            parts.setdefault(stem.lower(), []).append(set(flags))
    if any("x" in s.partition("/")[2] and s.partition("/")[0].lower() == word.lower() for s in stems):
        return False
    patterns = [re.compile(r) for r in rules.compounds]

    @functools.cache
    def cuts(at):
        if at == len(word):
            return [()]
        return [((at, stop), *rest) for stop in range(at + 1, len(word) + 1) if word[at:stop].lower() in parts for rest in cuts(stop)]

    for cut in cuts(0):
        if len(cut) < 2 or (rules.most_parts and len(cut) > rules.most_parts):
            continue
        bad = False
        for (a, b), (_, c) in itertools.pairwise(cut):
            if "CHECKCOMPOUNDDUP" in rules.switches and word[a:b].lower() == word[b:c].lower():
                bad = True
            if "CHECKCOMPOUNDCASE" in rules.switches and (word[b - 1].isupper() or word[b].isupper()):
                bad = True
            three = [word[k : k + 3] for k in (b - 2, b - 1) if k >= 0]
            if "CHECKCOMPOUNDTRIPLE" in rules.switches and any(len(t) == 3 and len(set(t)) == 1 for t in three):
                bad = True
        if bad:
            continue
        for homonyms in itertools.product(*(parts[word[a:b].lower()] for a, b in cut)):
            met = any(
                left_part.endswith(e) and right_part.startswith(s) and (not ef or ef in left) and (not sf or sf in right)
                for (left, right, left_part, right_part) in ((homonyms[k], homonyms[k + 1], word[cut[k][0] : cut[k][1]].lower(), word[cut[k + 1][0] : cut[k + 1][1]].lower()) for k in range(len(cut) - 1))
                for e, ef, s, sf in rules.meetings
            )
            if not met and any(any(p.fullmatch("".join(x)) for p in patterns) for x in itertools.product(*homonyms)):
                return True
    return False


@pytest.mark.parametrize("seed", range(5))
def test_random_rules_equal_a_plain_matcher(spark, seed):
    rng = random.Random(seed)
    rule = lambda: "".join(rng.choice("abcd") + rng.choice(["", "", "*", "?"]) for _ in range(rng.randint(2, 4)))
    aff = f"COMPOUNDMIN {rng.choice([1, 1, 2])}\nFORBIDDENWORD x\nCOMPOUNDRULE 3\n" + "".join(f"COMPOUNDRULE {rule()}\n" for _ in range(3))
    aff += "".join(f"{s}\n" for s in lexicon.SWITCHES if rng.random() < 0.5)
    if rng.random() < 0.5:
        aff += f"COMPOUNDWORDMAX {rng.randint(2, 3)}\n"
    if rng.random() < 0.6:
        aff += f"CHECKCOMPOUNDPATTERN 2\nCHECKCOMPOUNDPATTERN u o/{rng.choice('abcd')}\nCHECKCOMPOUNDPATTERN o/{rng.choice('abcd')} uo\n"
    stems = ["".join(rng.choice("uo") for _ in range(rng.randint(1, 3))) + "/" + "".join(rng.sample("abcd", rng.randint(1, 2))) + "x" * (rng.random() < 0.1) for _ in range(7)]
    words = ["".join(x) for n in range(1, 8) for x in itertools.product("uo", repeat=n)] + ["uOu", "Uou", "ooU", "UUU", "uuUoo"]
    want = {w for w in words if plain(aff, stems, w)}
    assert run(spark, aff, stems, words) == want


def test_long_and_numeric_flags_and_no_rules(spark):
    assert run(spark, "FLAG long\nCOMPOUNDMIN 1\nCOMPOUNDRULE 1\nCOMPOUNDRULE (Aa)*(Bb)?(Cc)\n", ["x/Aa", "y/Bb", "z/Cc"], ["xxz", "xyz", "yz", "z", "xx", "zz", "xxyyz"]) == {"xxz", "xyz", "yz"}
    assert run(spark, "FLAG num\nCOMPOUNDMIN 1\nCOMPOUNDRULE 1\nCOMPOUNDRULE (12)(7)*\n", ["x/12", "y/7"], ["xy", "xyyy", "x", "yx"]) == {"xy", "xyyy"}
    assert run(spark, "COMPOUNDMIN 1\n", ["x/a"], ["xx"]) == set() and run(spark, ORDINALS, [], ["11th"]) == set()
    assert compound_rules.matches(compound_rules.automaton(lexicon.parse_affixes(ORDINALS)), [{"n", "1"}, {"t", "c"}])


def test_words_are_not_shuffled_with_their_parts(spark):
    words = spark.createDataFrame([(f"{n}th",) for n in range(40)], "word string")
    found = compound_rules.accepted(words, known(spark, ORDINALS, NUMBERS))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "Generate" not in plan


def test_more_parts_than_a_plan_holds_meet_in_a_join(spark, monkeypatch):
    words = [f"{n}{end}" for n in (11, 12, 21, 111, 122) for end in ("st", "nd", "rd", "th")]
    in_row = run(spark, ORDINALS, NUMBERS, words)
    monkeypatch.setattr(compound_rules, "IN_ROW", 3)
    assert run(spark, ORDINALS, NUMBERS, words) == in_row == {"11th", "12th", "21st", "111th", "122nd"}
