"""Compounds by rule: each `COMPOUNDRULE` an automaton over the flags of parts, run along a word's parts.

A rule such as `n*mp` is a chain of flags, each once, any number of times (`*`) or at most once (`?`); its
states are the flags that were matched last, so there is a step from one to each that may follow, over those that may be left out. The rules
of a dictionary are one automaton with a common start.

Distinct unknown words are cut at all places. Where there are IN_ROW parts or fewer, substrings of the lengths that parts have look them up by Arrow batches, and
what they meet stays in the word's row, so nothing but distinct words is shuffled; more parts meet the substrings in one equi-join. What a word met is folded from left to right in its own row: the state is an array of (place, automaton state, number of parts, what the
next part must know of this one), which a part that begins at the place carries on. A word is a
compound if an accepting state with two parts or more stands at its end. No compound is written out.

Of a boundary between two parts the switches ask: `CHECKCOMPOUNDDUP` no part twice in a row, `-CASE` no capital on
either side, `-TRIPLE` no letter three times in a row across it, `-PATTERN` not this end before that beginning (with flags, if given);
`COMPOUNDWORDMAX` limits the parts. Parts are stems of `COMPOUNDMIN` letters or more, without affixes; they may stand only inside
compounds. A forbidden stem is no compound. Null and empty words are none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import text as X
from .affix import BROADCAST, Affixed, fold
from .lexicon import AffixRules

#: Parts that are a constant of the plan, at most.
IN_ROW = 1024
FOUND = "array<struct<start:int,stop:int,part:int>>"


@dataclass(frozen=True)
class Automaton:
    """Steps (state, flag) -> states; 0 is the start. A part is in the accepting states at a word's end."""

    steps: dict[tuple[int, str], tuple[int, ...]]
    accepting: frozenset[int]

    @property
    def flags(self) -> list[str]:
        return sorted({f for _, f in self.steps})


def elements(rule: str, rules: AffixRules) -> list[tuple[str, str]]:
    """A rule's flags, each with `*`, `?` or nothing; long and numeric flags stand in brackets, and others may."""
    return [(a or b, sign) for a, b, sign in re.findall(r"(?:\(([^)]*)\)|([^*?()]))([*?]?)", rule)]


def automaton(rules: AffixRules) -> Automaton:
    steps: dict[tuple[int, str], set[int]] = {}
    accepting: set[int] = set()
    base = 1
    for rule in rules.compounds:
        chain = elements(rule, rules)
        for at in range(-1, len(chain)):
            state = 0 if at < 0 else base + at
            if at >= 0 and chain[at][1] == "*":
                steps.setdefault((state, chain[at][0]), set()).add(state)
            for to in range(at + 1, len(chain)):
                steps.setdefault((state, chain[to][0]), set()).add(base + to)
                if not chain[to][1]:
                    break
            else:
                if at >= 0:
                    accepting.add(state)
        base += len(chain)
    return Automaton({k: tuple(sorted(v)) for k, v in steps.items()}, frozenset(accepting))


def matches(found: Automaton, flags: list[set[str]], least: int = 2) -> bool:
    """Whether parts with these flags, in a row, make a compound; for a look at one word."""
    states = {0}
    for own in flags:
        states = {to for s in states for f in own for to in found.steps.get((s, f), ())}
    return len(flags) >= least and bool(states & found.accepting)


def _boundary(word: Column, at: Column, switches: set[str]) -> Column:
    """Whether parts may meet before letter `at` (from 1) of a word; its ends are no boundaries."""
    letter = lambda shift: F.substr(word, at + shift, F.lit(1))
    ok = F.lit(True)
    if "CHECKCOMPOUNDCASE" in switches:
        ok = ok & ~(letter(-1).rlike(r"\p{Lu}") | letter(0).rlike(r"\p{Lu}"))
    if "CHECKCOMPOUNDTRIPLE" in switches:
        before, after = F.when(at > 2, letter(-2)).otherwise(""), letter(1)
        ok = ok & ~((letter(-1) == letter(0)) & ((before == letter(0)) | (after == letter(0))))
    return ok | (at == 1) | (at > F.char_length(word))


def rule_parts(known: Affixed) -> DataFrame:
    """(part, flags, ends, begins) of the stems that a rule names: folded, with bits for the patterns that they end and begin."""
    rules = known.rules
    flags = automaton(rules).flags
    rows = known.stems.where(F.char_length("key") >= rules.compound_min)
    if rules.forbidden:
        rows = rows.where(~F.array_contains("flags", rules.forbidden))
    own = F.array_intersect("flags", F.array(*[F.lit(f) for f in flags]).cast("array<string>"))

    def bits(side: int) -> Column:
        total = F.lit(0).cast("long")
        for k, pattern in enumerate(rules.meetings[:63]):
            letters, flag = fold(pattern[side]), pattern[side + 1]
            hit = (F.col("key").endswith(letters) if side == 0 else F.col("key").startswith(letters)) if letters not in ("", "0") else F.lit(True)
            total = total + F.when(hit & (F.array_contains("flags", flag) if flag else F.lit(True)), 1 << k).otherwise(0)
        return total

    rows = rows.select(F.col("key").alias("part"), own.alias("flags"), bits(0).alias("ends"), bits(2).alias("begins"))
    return rows.where(F.size("flags") > 0).distinct()


def _steps_in_row(parts: list[Row], switches: set[str]) -> tuple[Column, Column]:
    """What is found in a row (key), and from that as `found` the steps of a row (shown), by their starts."""
    by_part: dict[str, list[Column]] = {}
    for r in parts:
        flags = F.array(*[F.lit(f) for f in r["flags"]])
        by_part.setdefault(r["part"], []).append(F.struct(flags.alias("flags"), F.lit(r["ends"]).cast("long").alias("ends"), F.lit(r["begins"]).cast("long").alias("begins")))
    names, lengths = list(by_part), sorted({len(x) for x in by_part})
    # All literals, so the optimizer makes it one.
    about = F.array(*[F.array(*own) for own in by_part.values()])

    @F.arrow_udf(FOUND)
    def found(keys: pa.Array) -> pa.Array:
        known, sizes = pa.array(names, pa.string()), pc.utf8_length(keys).to_numpy()
        hits = [np.zeros((0, 4), np.int64)]
        for start in range(int(sizes.max(initial=0))):
            own = np.flatnonzero(sizes >= start + lengths[0])
            texts = keys.take(pa.array(own))
            for n in lengths:
                part = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(texts, start, start + n), value_set=known), -1).to_numpy()
                at = np.flatnonzero((part >= 0) & (sizes[own] >= start + n))
                hits.append(np.stack([own[at], np.full(len(at), start + 1), np.full(len(at), start + n + 1), part[at]], 1))
        rows = np.concatenate(hits)
        rows = rows[np.argsort(rows[:, 0], kind="stable")].astype(np.int32)
        bounds = np.searchsorted(rows[:, 0], np.arange(len(keys) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([rows[:, k + 1] for k in range(3)], ["start", "stop", "part"]))

    def expanded(word: Column, s: Column) -> Column:
        may = _boundary(word, s["start"], switches) & _boundary(word, s["stop"], switches)
        step = lambda p: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), p["flags"].alias("flags"), p["ends"].alias("ends"), p["begins"].alias("begins"))
        return F.transform(F.filter(F.get(about, s["part"]), lambda p: may), step)

    steps = F.col("found")
    return found(F.col("key")), F.flatten(F.flatten(F.transform(F.array("shown"), lambda word: F.transform(steps, lambda s: expanded(word, s)))))


def accepted(words: DataFrame, known: Affixed, parts: DataFrame | None = None) -> DataFrame:
    """Of (word), the distinct words that the dictionary's rules make of its parts."""
    rules, found = known.rules, automaton(known.rules)
    asked = words.select("word").where("word <> ''").distinct().withColumn("key", X.fold_key(F.col("word")))
    parts = rule_parts(known) if parts is None else parts
    some = parts.limit(IN_ROW + 1).collect()
    if not some or not found.accepting:
        return asked.select("word").limit(0)
    if rules.forbidden:
        barred = known.stems.where(F.array_contains("flags", rules.forbidden)).select("key").distinct()
        asked = asked.join(F.broadcast(barred) if barred.limit(BROADCAST + 1).count() <= BROADCAST else barred, "key", "left_anti")
    in_row = len(some) <= IN_ROW
    lengths = [len(r["part"]) for r in some]
    shortest, longest = (min(lengths), max(lengths)) if in_row else parts.agg(F.min(F.char_length("part")), F.max(F.char_length("part"))).first()
    # Where folding changes the number of letters, boundaries are those of the folded word.
    shown = F.when(F.char_length("word") == F.char_length("key"), F.col("word")).otherwise(F.col("key"))
    asked = asked.withColumn("shown", shown).withColumn("size", F.char_length("key")).where(F.col("size") >= 2 * shortest)
    if in_row:
        found_in, steps = _steps_in_row(some, rules.switches)
        rows = asked.withColumn("found", found_in).where(F.exists("found", lambda s: s["start"] == 1) & F.exists("found", lambda s: s["stop"] == F.col("size") + 1))
        rows = rows.select("word", "key", "size", steps.alias("steps"))
    else:
        starts = asked.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("size") - shortest + 1))).where(_boundary(F.col("shown"), F.col("start"), rules.switches))
        most = F.least(F.lit(longest), F.col("size") - F.col("start") + 1)
        cut = starts.withColumn("rest", F.substr("key", F.col("start"), F.lit(longest))).withColumn("length", F.explode(F.sequence(F.lit(shortest), most)))
        cut = cut.withColumn("stop", F.col("start") + F.col("length")).where(_boundary(F.col("shown"), F.col("stop"), rules.switches)).withColumn("part", F.substr("rest", F.lit(1), F.col("length")))
        small = parts.limit(BROADCAST + 1).count() <= BROADCAST
        met = cut.join(F.broadcast(parts) if small else parts, "part").select("word", "key", "size", F.struct("start", "stop", "flags", "ends", "begins").alias("step"))
        rows = met.groupBy("word", "key", "size").agg(F.array_sort(F.collect_set("step")).alias("steps"))

    kinds: dict[str, int] = {f: k for k, f in enumerate(found.flags)}
    n = len(kinds)
    # Steps as an array: those of state s over flag f stand at s * n + f.
    states = 1 + max(to for tos in found.steps.values() for to in tos)
    to_states = [F.array(*[F.lit(t) for t in found.steps.get((s, f), ())]).cast("array<int>") for s in range(states) for f in kinds]
    flag_number = F.create_map(*[F.lit(x) for f, k in kinds.items() for x in (f, k)])
    # How far parts are counted: two make a compound; beyond, only a limit needs the number.
    cap = max(2, rules.most_parts + 1 if rules.most_parts else 2)
    dup = "CHECKCOMPOUNDDUP" in rules.switches
    state_type = "struct<at:int,state:int,n:int,ends:bigint,begun:int>"
    begin = F.array(F.struct(F.lit(1).alias("at"), F.lit(0).alias("state"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("ends"), F.lit(0).alias("begun"))).cast(f"array<{state_type}>")
    rows = rows.withColumn("table", F.array(*to_states))

    def carried(done: Column, step: Column) -> Column:
        """The states that a step adds to those that stand where it begins."""
        own = F.transform(step["flags"], lambda f: F.element_at(flag_number, f))

        def ok(r: Column) -> Column:
            may = (r["at"] == step["start"]) & (r["ends"].bitwiseAND(step["begins"]) == 0)
            if rules.most_parts:
                may = may & (r["n"] < rules.most_parts)
            if dup:
                size = r["at"] - r["begun"]
                same = (r["begun"] > 0) & (size == step["stop"] - step["start"]) & (F.substr("key", r["begun"], size) == F.substr("key", step["start"], size))
                may = may & ~same
            return may

        def after(r: Column) -> Column:
            states = F.flatten(F.transform(own, lambda f: F.get(F.col("table"), r["state"] * n + f)))
            return F.transform(states, lambda s: F.struct(step["stop"].alias("at"), s.alias("state"), F.least(r["n"] + 1, F.lit(cap)).alias("n"), step["ends"].alias("ends"), (step["start"] if dup else F.lit(0)).alias("begun")))

        return F.flatten(F.transform(F.filter(done, ok), after))

    # Steps come by their starts, so what stands before a step's is done with.
    ahead = lambda done, step: F.filter(done, lambda r: r["at"] >= step["start"])
    folded = F.aggregate("steps", begin, lambda done, step: F.array_union(ahead(done, step), carried(done, step).cast(f"array<{state_type}>")))
    last = F.exists(folded, lambda r: (r["at"] == F.col("size") + 1) & (r["n"] >= 2) & r["state"].isin(*found.accepting))
    return rows.where(last).select("word")
