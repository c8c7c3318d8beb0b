"""Decontamination against a plain template matcher, and on re-parameterised items."""

import random
import re

from lanternq.llm import decontamination as d
from lanternq.llm.common import written

from .test_edges import leaked, table

TOKENS = re.compile(r"[0-9]+(?:[.,:/][0-9]+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[%€$£°]|[.!?\n]+")


def tokens(text):
    found = [m[0] for m in TOKENS.finditer(text or "")]
    starts = [i == 0 or found[i - 1][0] in ".!?\n" for i in range(len(found))]
    kept = [(t, s) for t, s in zip(found, starts) if t[0] not in ".!?\n"]
    out = []
    for i, (t, s) in enumerate(kept):
        unit = i and kept[i - 1][0][0].isdigit() and t.lower() in d.UNITS
        form = d.NUMBER if t[0].isdigit() else d.NAME if t[0] != t[0].lower() else d.UNIT if unit else t.lower()
        out.append((t.lower(), form, s))
    return out


def consistent(slots):
    names = [x for x in slots if x[0] == d.NAME]
    return len({x[:2] for x in slots}) == len(slots) and len({x[2] for x in names}) == len(names)


def holds(theirs, ours):
    """Whether an item is found; both as tokens."""
    n, found = len(ours), []
    length = min(n, d.WINDOW)
    names = {t for t, f, s in ours if f == d.NAME and not s}
    for shift in range(1 - n, len(theirs)):
        pair = lambda b: (ours[b], theirs[b + shift])
        covered = set()
        for low in range(n - length + 1):
            span = range(low, low + length)
            if low + shift < 0 or low + length + shift > len(theirs):
                continue
            forms = [b for b in span if pair(b)[0][1] != pair(b)[1][1]]
            words = [b for b in span if pair(b)[0][0] != pair(b)[1][0]]
            plain = sum(not ours[b][1].startswith("\1") for b in span)
            fits = not forms and (plain >= d.LITERALS or not words)
            fits = fits or forms == [0] and not words
            fits = fits or forms == [0] and 0 not in words and sum(not ours[b][1].startswith("\1") for b in span if b) >= d.LITERALS
            start = lambda b: ours[b][2] and ours[b][1] == d.NAME and not theirs[b + shift][2] and ours[b][0] not in names
            if fits and not any(b in words and start(b) for b in span):
                covered.update(span)
        counts = lambda b: ours[b][1].startswith("\1") and (not ours[b][2] or ours[b][1] != d.NAME or ours[b][0] in names)
        slots = {(ours[b][1], ours[b][0], theirs[b + shift][0]) for b in covered if counts(b)}
        if covered and consistent(slots):
            found.append((-len(covered), shift, covered, slots))
    covered, slots = set(), set()
    for _, _, more, its in sorted(found, key=lambda x: x[:2]):
        if consistent(slots | its):
            covered, slots = covered | more, slots | its
    return len(covered) >= d.SHARE * n > 0


def other_values(text, seed):
    """Other numbers, and other names for capitalised words inside sentences."""
    dice, of = random.Random(seed), {}
    numbers = re.sub(r"\d+", lambda m: of.setdefault(m[0], str(dice.randrange(10_000, 99_999))), text)
    inside = {m[1] for m in re.finditer(r"(?<=[a-z,;:] )([A-ZÄÖÜ]\w+)", numbers)}
    return re.sub(r"\w+", lambda m: of.setdefault(m[0], f"Nm{len(of)}x") if m[0] in inside else m[0], numbers)


def test_on_whole_tables(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(1_000_000 + i, f"Before it all. {other_values(t, i)} And after.") for i, t in items]
    forms = [(i, tokens(t), {x[0] for x in tokens(t)}) for i, t in items]
    wanted = set()
    for doc_id, text in docs:
        theirs = tokens(text)
        words = {x[0] for x in theirs}
        # Without half of an item's plain words in it a text cannot hold it.
        wanted |= {(doc_id, i) for i, ours, own in forms if 2 * len(own & words) >= len(own) and holds(theirs, ours)}
    got = leaked(spark, docs, items)
    assert got == wanted and {(1_000_000 + i, i) for i, _ in items} <= got


ITEM = "Alice has 3 apples and gives Bob half of them. Carol eats 5 pears and Bob takes the rest to Alice"


def test_slots(spark):
    docs = [
        (1, "Dora has 7 apples and gives Emil half of them. Fritz eats 5 pears and Emil takes the rest to Dora"),
        (2, "Dora has 7 apples and gives Dora half of them. Fritz eats 5 pears and Dora takes the rest to Dora"),
        (3, "Dora has 7 apples and gives Emil half of them. Fritz eats 5 pears and Gerd takes the rest to Hans"),
        (4, "Dora has 7 apples and gives Emil half of them. Fritz eats 7 pears and Emil takes the rest to Dora"),
    ]
    got = leaked(spark, docs, [(1, ITEM)])
    assert got == {(i, 1) for i, t in docs if holds(tokens(t), tokens(ITEM))} == {(1, 1), (4, 1)}


def test_items_of_one_template_meet_a_text_once(spark, monkeypatch):
    rows = {}
    monkeypatch.setattr(d, "written", lambda df, name: (out := written(df, name), rows.__setitem__(name, out.count()))[0])
    items = [(i, f"the first of {i} trains leaves the old town and meets the other one near the bridge after a while") for i in range(40)]
    docs = table(spark, [(1, items[0][1].replace(" 0 ", " 777 "), 0)], "docs")
    bench = written(spark.createDataFrame(items, "item_id long, text string"), "bench")
    assert d.leaks(docs, bench).count() == 40 and rows["alignments"] == 1
