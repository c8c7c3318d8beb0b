"""Work grows with the length of a text, whatever its words look like."""

import random
import re
import time

import pytest

from lanternq.llm import pii, toxicity

N = 1_000_000
LONG = {
    "letters": "x" * N, "digits": "9" * N, "mixed": "x1" * (N // 2), "mails": "a@" * (N // 2), "written": "(at)" * (N // 4), "dots": "1." * (N // 2),
    "blanks": " " * N, "at words": "at x " * (N // 5), "dashes": "a" + "-" * N + "a", "open": "+1" + "(" * N, "plus": "+1" * (N // 2), "han": "漢" * N,
}


@pytest.mark.parametrize("name", LONG)
def test_a_megabyte_without_words(name):
    text, model = LONG[name], pii.SemiMarkov()
    t = time.process_time()
    list(pii.base_spans(text))
    for units, _, _ in list(pii.regions(text))[:50]:
        model.best(text, units)
    toxicity.features_of(text)
    assert time.process_time() - t < 2


def test_same_words_as_the_plain_patterns():
    plain_seed = re.compile(r"[^\s]*[0-9@][^\s]*|[(\[{]?(?:at|dot)[)\]}]|(?<!\S)at\s+[\w-]+(?:\s+dot\s+[\w-]+)+", re.I)
    plain_ip = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
    plain_edges = re.compile(r"^[^\w]+|[^\w]+$")
    rng = random.Random(3)
    pieces = ["a", "at", "dot", " ", "  ", "\n", "(", ")", "[", "]", "at)", "(dot)", "9", "@", "x", "-", ".", "1.2", "é", "_", " at x dot y"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        assert list(pii.seeds(text)) == [m.span() for m in plain_seed.finditer(text)]
        a, b = sorted((rng.randrange(len(text) + 1), rng.randrange(len(text) + 1)))
        assert list(pii.seeds(text, a, b)) == [m.span() for m in plain_seed.finditer(text, a, b)]
        assert toxicity.without_edges(text) == plain_edges.sub("", text)
        digits = "".join(rng.choice("19..") for _ in range(rng.randrange(25)))
        assert [m.span() for m in pii.IP.finditer(digits)] == [m.span() for m in plain_ip.finditer(digits)]
