"""Benchmark items that are short or have few plain words are found where they are copied."""

from .test_edges import QUESTION, leaked

ITEMS = {
    1: "What is 12 plus 7",  # five tokens
    2: "Berlin Hamburg Bremen Kassel Leipzig Dresden Rostock Potsdam Erfurt Halle",  # names
    3: "12 7 15 33 8 21 40 2 19 76",  # numbers
    4: "The Quick Brown Fox Jumps Over A Lazy Dog Again",  # title case
    5: "Explain why the sky looks blue at noon",  # eight tokens, capitalised first
    6: "Der Hund und die Katze sehen das Haus am See",
    7: "Days pass when",
}


def test_copies_of_short_and_wordless_items_are_found(spark):
    docs = [(i, f"some words before and then {t} and some more after it") for i, t in ITEMS.items()]
    docs += [(100 + i, f"Some words before. {t}. And more after it") for i, t in ITEMS.items()]
    docs += [(207, "there were 5 Days pass when it rained")]
    wanted = {(i, i) for i in ITEMS} | {(100 + i, i) for i in ITEMS} | {(207, 7)}
    assert leaked(spark, docs, list(ITEMS.items())) == wanted


def test_other_values_are_no_copies_of_wordless_items(spark):
    docs = [
        (1, "so What is 13 plus 8 then"), (2, "Aachen Hamburg Bremen Essen Leipzig Dresden Celle Potsdam Bonn Halle"), (3, "13 8 16 34 9 22 41 3 20 77"),
        (5, "so Paris why the sky looks blue at noon"), (6, "sentences of plain words that hold none of the items"),
    ]
    assert leaked(spark, docs, [*ITEMS.items(), (9, QUESTION)]) == set()
