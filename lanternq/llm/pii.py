"""Personal data by patterns and a semi-Markov conditional random field.

Base spans come from fixed patterns (kinds email, ip, card, phone).  The model
adds what they miss: written-out or bracketed addresses, numbers with other
separators, phones without a plus.  It works on regions, short runs of words
around digits and at-signs.  A segment of a region is one to ``LONGEST``
words with a kind, or one word outside any; features look at the segment as a
whole (digits, groups, separators, checksum, shape), and a dynamic programme
over (end, kind) finds the best segmentation, bounds and kinds jointly.

It is trained here by conditional likelihood (forward and backward sums over
segmentations) on a bounded sample of regions, labelled by the base patterns,
beside copies in which the labelled spans are rewritten in ways that the
patterns do not match.

Defined results: a null or empty text has no spans; rows that repeat are
treated alike; if no sampled text holds personal data, the model adds nothing;
an empty table gives an empty result.
"""

from __future__ import annotations

import ast
import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Fixed by the contract of the query.
EMAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match that cannot start at the beginning of a row of digits cannot start inside it.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: The model is fitted on the regions of at most so many different texts, and
#: on at most so many different regions.
SAMPLE_TEXTS, SAMPLE_REGIONS = 600, 1500
LONGEST = 7
#: A model keeps the scores of so many spans of so many characters at most.
KEPT_SPANS, KEPT_SPAN = 1 << 14, 64
OTHER = len(KINDS)
EPOCHS = 6


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int, int]]:
    """A name runs up to its at-sign, so each at-sign decides once."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in EMAIL_NAME:
            start -= 1
        host = EMAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            yield 0, start, host.end()
        free = host.end() if host else at + 1
        at = text.find("@", free)


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and int(digits) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = list(_emails(text))
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# -- regions --------------------------------------------------------------

WORD = re.compile(r"[^\s]+")
#: Words that may belong to an entity: with digits or an at-sign, written-out signs.
SIGN = re.compile(r"[0-9@]")
WRITTEN_SIGN = re.compile(r"[(\[{]?(?:at|dot)[)\]}]|(?<!\S)at\s+[\w-]+(?:\s+dot\s+[\w-]+)+", re.I)
REST_OF_WORD = re.compile(r"\S*")
GAP = 5


def seeds(text: str, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    """Bounds of these words of a stretch from left to right.  A digit or at-sign takes the
    word around it, as far as that has not been passed; each character is
    looked at a few times whatever the length of words."""
    start, fresh, end = 0, True, len(text) if end is None else end
    sign, written = SIGN.search(text, at, end), WRITTEN_SIGN.search(text, at, end)
    while sign or written:
        if sign and fresh:
            start = sign.start()
            while start > at and not text[start - 1].isspace():
                start -= 1
            fresh = False
        start = max(start, at)
        if sign and (not written or start <= written.start()):
            bounds = start, REST_OF_WORD.match(text, sign.start(), end).end()
        else:
            bounds = written.span()
        yield bounds
        at = bounds[1]
        if sign and sign.start() < at:
            sign, fresh = SIGN.search(text, at, end), True
        if written and written.start() < at:
            written = WRITTEN_SIGN.search(text, at, end)


def _units(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Words of a stretch without the punctuation at their edges."""
    out = []
    for m in WORD.finditer(text, start, end):
        a, b = m.span()
        while a < b and not (text[a].isalnum() or text[a] in "+(["):
            a += 1
        while a < b and not (text[b - 1].isalnum() or text[b - 1] in ")]"):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


#: A region is handled in stretches of so many seed words, which overlap by
#: more than an entity's length.
REGION_WORDS, OVERLAP = 40, LONGEST + 1


def regions(text: str) -> Iterator[tuple[list[tuple[int, int]], int, int]]:
    """Units (start, end) of each stretch of each region (seed words that lie
    close together and a few words on either side), and the places between
    which an entity of the stretch must start."""
    held: list[tuple[int, int]] = []
    for bounds in seeds(text):
        if held and bounds[0] - held[-1][1] > 24:
            yield from _stretches(text, held)
            held = []
        held.append(bounds)
    if held:
        yield from _stretches(text, held)


def _stretches(text: str, seeds: list[tuple[int, int]]) -> Iterator[tuple[list[tuple[int, int]], int, int]]:
    low = 0
    for i in range(0, len(seeds), REGION_WORDS):
        high = seeds[i + REGION_WORDS][0] if i + REGION_WORDS < len(seeds) else len(text)
        yield _around(text, seeds[max(0, i - OVERLAP) : i + REGION_WORDS + OVERLAP]), low, high
        low = high


def _around(text: str, seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    a, b = seeds[0][0], seeds[-1][1]
    left = text[max(0, a - 90) : a].split(" ")[-GAP - 1 :]
    right = text[b : b + 90].split(" ")[: GAP + 1]
    return _units(text, a - len(" ".join(left)), b + len(" ".join(right)))


# -- features -------------------------------------------------------------

AT = re.compile(r"@|[(\[{]\s*at\s*[)\]}]| at ", re.I)
DOT = re.compile(r"\.|[(\[{]\s*dot\s*[)\]}]| dot ", re.I)
WRITTEN_MAIL = re.compile(
    r"[\w.%+-]+\s*(?:@|[(\[{]\s*at\s*[)\]}]|\bat\b)\s*[\w-]+(?:\s*(?:\.|[(\[{]\s*dot\s*[)\]}]|\bdot\b)\s*[\w-]+)+", re.I | re.A
)
FOUR_GROUPS = re.compile(r"\d{1,3}(?:(?:\s*[(\[{]?(?:\.|dot)[)\]}]?\s*)\d{1,3}){3}", re.I)
NUMBER_LIKE = re.compile(r"[+(]?\d[\d\s().,/-]*\d")
SIGNS = re.compile(r"[^\w\s]")


def segment_features(span: str, words: int) -> list[str]:
    """Features of a whole candidate segment."""
    digits = _digits(span)
    letters = sum(c.isalpha() for c in span)
    n = len(digits)
    out = ["bias", f"words={min(words, 4)}", f"digits={n if n < 20 else 20}", f"letters={0 if not letters else 1 if letters < 4 else 2}"]
    if AT.search(span):
        out.append("at")
        out.append(f"dots-with-at={min(len(DOT.findall(span)), 3)}")
    if WRITTEN_MAIL.fullmatch(span):
        out.append("mail-shape")
    if FOUR_GROUPS.fullmatch(span):
        groups = re.findall(r"\d+", span)
        out.append("four-octets" if all(int(g) <= 255 for g in groups) else "four-groups")
    if NUMBER_LIKE.fullmatch(span):
        out.append("number-shape")
        out.append(f"number-digits={'0-6' if n < 7 else '7' if n < 8 else '8-15' if n < 16 else '16-19' if n < 20 else '20+'}")
        if 16 <= n <= 19:
            out.append("luhn" if luhn(digits) else "no-luhn")
        groups = [len(g) for g in re.findall(r"\d+", span)]
        out.append(f"groups={min(len(groups), 5)}")
        if len(groups) > 1:
            out.append("group-sizes=" + "-".join(map(str, groups[:5])))
        if span[0] == "+":
            out.append("plus")
        if "(" in span:
            out.append("bracket")
        out += sorted({f"sign={s}" for s in SIGNS.findall(span)})
    elif n and not letters:
        out.append("broken-number")
    if words > 1 and letters and not AT.search(span):
        out.append("several-words")
    return out


class SemiMarkov:
    """Weights for (kind, feature) and (kind before, kind)."""

    def __init__(self, weights: dict[tuple, float] | None = None):
        self.weights = weights or {}
        self.scored: dict[tuple[str, int], list[float]] = {}

    def scores(self, span: str, words: int) -> list[float]:
        """A segment's score as each kind; those of short spans are kept."""
        out = self.scored.get((span, words))
        if out is None:
            get, fs = self.weights.get, segment_features(span, words)
            out = [sum(get((kind, f), 0.0) for f in fs) for kind in range(OTHER + 1 if words == 1 else OTHER)]
            if len(span) <= KEPT_SPAN:
                if len(self.scored) >= KEPT_SPANS:
                    self.scored.clear()
                self.scored[span, words] = out
        return out

    def segments(self, text: str, units: list[tuple[int, int]]) -> Iterator[list[tuple[int, str, int]]]:
        """For each end: (start, span, words) of the segments."""
        for j in range(1, len(units) + 1):
            ending = []
            for i in range(max(0, j - LONGEST), j):
                span = text[units[i][0] : units[j - 1][1]]
                if i < j - 1 and not SIGN.search(span) and not AT.search(span):
                    continue  # only outside words have neither digit nor at-sign
                ending.append((i, span, j - i))
            yield ending

    def lattice(self, text: str, units: list[tuple[int, int]]) -> list[list[tuple[int, int, float, list[str]]]]:
        """For each end: (start, kind, score, features) of the segments."""
        get, out = self.weights.get, []
        for segments in self.segments(text, units):
            ending = []
            for i, span, words in segments:
                fs = segment_features(span, words)
                for kind in range(OTHER if words > 1 else OTHER + 1):
                    ending.append((i, kind, sum(get((kind, f), 0.0) for f in fs), fs))
            out.append(ending)
        return out

    def best(self, text: str, units: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(kind, start, end) in characters of the best segmentation's entities."""
        link = [[self.weights.get(("after", a, b), 0.0) for b in range(OTHER + 1)] for a in range(OTHER + 1)]
        states: list[dict[int, tuple[float, int, int]]] = [{OTHER: (0.0, -1, OTHER)}]
        for ending in self.segments(text, units):
            here: dict[int, tuple[float, int, int]] = {}
            for i, span, words in ending:
                for kind, score in enumerate(self.scores(span, words)):
                    for before, (value, _, _) in states[i].items():
                        total = value + score + link[before][kind]
                        if kind not in here or total > here[kind][0]:
                            here[kind] = (total, i, before)
            states.append(here)
        out, j = [], len(units)
        kind = max(states[j], key=lambda k: states[j][k][0])
        while j:
            _, i, before = states[j][kind]
            if kind != OTHER:
                out.append((kind, units[i][0], units[j - 1][1]))
            j, kind = i, before
        return out[::-1]

    def learn(self, text: str, units: list[tuple[int, int]], truth: list[tuple[int, int, int]], rate: float) -> None:
        """One step up the conditional likelihood of the labelled segmentation.

        truth: (first unit, unit after the last, kind) of each segment.
        """
        lattice, get = self.lattice(text, units), self.weights.get
        kinds = range(OTHER + 1)
        link = [[get(("after", a, b), 0.0) for b in kinds] for a in kinds]
        low = -1e30
        alpha = [[low] * (OTHER + 1) for _ in range(len(units) + 1)]
        alpha[0][OTHER] = 0.0

        def plus(x: float, y: float) -> float:
            return max(x, y) + math.log1p(math.exp(-abs(x - y))) if min(x, y) > low / 2 else max(x, y)

        for j, ending in enumerate(lattice, 1):
            for i, kind, score, _ in ending:
                for before in kinds:
                    if alpha[i][before] > low / 2:
                        alpha[j][kind] = plus(alpha[j][kind], alpha[i][before] + link[before][kind] + score)
        beta = [[low] * (OTHER + 1) for _ in range(len(units) + 1)]
        beta[-1] = [0.0] * (OTHER + 1)
        for j in range(len(units), 0, -1):
            for i, kind, score, _ in lattice[j - 1]:
                if beta[j][kind] > low / 2:
                    for before in kinds:
                        beta[i][before] = plus(beta[i][before], link[before][kind] + score + beta[j][kind])
        whole = low
        for kind in kinds:
            whole = plus(whole, alpha[-1][kind])
        change: dict[tuple, float] = {}

        def add(key: tuple, by: float) -> None:
            change[key] = change.get(key, 0.0) + by

        for j, ending in enumerate(lattice, 1):
            for i, kind, score, fs in ending:
                share = 0.0
                for before in kinds:
                    p = alpha[i][before] + link[before][kind] + score + beta[j][kind] - whole
                    if p > -20:
                        p = math.exp(p)
                        share += p
                        add(("after", before, kind), -p)
                if share:
                    for f in fs:
                        add((kind, f), -share)
        before = OTHER
        for i, j, kind in truth:
            add(("after", before, kind), 1.0)
            for f in segment_features(text[units[i][0] : units[j - 1][1]], j - i):
                add((kind, f), 1.0)
            before = kind
        self.scored.clear()
        for key, by in change.items():
            self.weights[key] = self.weights.get(key, 0.0) * (1 - rate * 0.002) + rate * by


def _truth(units: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]] | None:
    """The spans as segments of units; None if one does not fit."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        inside = [k for k, (x, y) in enumerate(units) if x < b and y > a]
        if not inside or units[inside[0]][0] != a or units[inside[-1]][1] != b or inside[0] < at or len(inside) > LONGEST:
            return None
        out += [(k, k + 1, OTHER) for k in range(at, inside[0])]
        at = inside[-1] + 1
        out.append((inside[0], at, kind))
    return out + [(k, k + 1, OTHER) for k in range(at, len(units))]


def _rewritten(kind: int, span: str, dice: random.Random) -> str:
    """The span in another form, which the base patterns do not match."""
    if kind == 0:
        at, dot = dice.choice(((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", ".")))
        name, _, host = span.partition("@")
        # Other names and hosts than the given ones: without digits, of two labels.
        name = dice.choice((name, "".join(c for c in name if c.isalpha()) or name))
        host = dice.choice((host, ".".join(host.split(".")[-2:])))
        return name + at + host.replace(".", dot)
    if kind == 1:
        return span.replace(".", dice.choice(("[.]", "(.)", "[dot]")))
    digits = _digits(span)
    if kind == 2:
        sign = dice.choice((".", "/", "  "))
        return sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    rest = digits[-10:]
    return dice.choice((f"({rest[:-7]}) {rest[-7:-4]}-{rest[-4:]}", f"{rest[:-7]}-{rest[-7:-4]}-{rest[-4:]}", f"{rest[:-7]}.{rest[-7:-4]}.{rest[-4:]}"))


def _spoiled(kind: int, span: str) -> str | None:
    """A span of the same look that is none: a card that fails its checksum, an address part above 255."""
    if kind == 2:
        return span[:-1] + str((int(span[-1]) + 1) % 10)
    if kind == 1:
        return f"{300 + len(span)}{span[span.index('.'):]}"
    return None


Example = tuple[str, list[tuple[int, int]], list[tuple[int, int, int]]]


def examples(text: str) -> Iterator[Example]:
    """Labelled regions (text, units, segments) of a text, and of the text with
    its spans rewritten."""

    def labelled(text: str, spans: list[tuple[int, int, int]]) -> Iterator[Example]:
        for units, _, _ in regions(text):
            if not units:
                continue
            a, b = units[0][0], units[-1][1]
            truth = _truth(units, [s for s in spans if s[1] < b and s[2] > a])
            if truth:
                yield text[a:b], [(x - a, y - a) for x, y in units], truth

    spans, last = [], -1
    for s in sorted(base_spans(text), key=lambda s: (s[1], -s[2])):
        if s[1] >= last:  # of overlapping ones the first
            spans.append(s)
            last = s[2]
    yield from labelled(text, spans)
    if not spans:
        return
    dice = random.Random(hashlib.sha256(text.encode()).digest())
    yield from labelled(*with_spans(text, spans, lambda kind, span: _rewritten(kind, span, dice)))
    if any(_spoiled(kind, text[a:b]) for kind, a, b in spans):
        spoiled, moved = with_spans(text, spans, lambda kind, span: _spoiled(kind, span) or span)
        yield from labelled(spoiled, [m for m in moved if _spoiled(m[0], spoiled[m[1] : m[2]]) is None])


def with_spans(text: str, spans: list[tuple[int, int, int]], new: Callable[[int, str], str]) -> tuple[str, list[tuple[int, int, int]]]:
    """text with each of the ordered spans replaced, and where they are then."""
    parts, moved, at, length = [], [], 0, 0
    for kind, a, b in spans:
        other = new(kind, text[a:b])
        parts += [text[at:a], other]
        length += a - at
        moved.append((kind, length, length + len(other)))
        length += len(other)
        at = b
    return "".join(parts) + text[at:], moved


def fit(known: list[Example]) -> SemiMarkov:
    if not any(kind != OTHER for _, _, truth in known for _, _, kind in truth):
        return SemiMarkov({(k, "bias"): -9.0 for k in range(OTHER)})
    model, dice, known = SemiMarkov(), random.Random(7), list(known)
    for epoch in range(EPOCHS):
        dice.shuffle(known)
        for text, units, truth in known:
            model.learn(text, units, truth, 0.3 / (1 + epoch))
    return model


def added_spans(model: SemiMarkov, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Entities of the model that overlap no base span."""
    out = []
    taken = sorted((a, b) for _, a, b in base)
    long = [t for t in taken if t[1] - t[0] > 400]
    for units, low, high in regions(text):
        inner = units
        if taken:
            near = taken[bisect_left(taken, (units[0][0] - 400, 0)) : bisect_left(taken, (units[-1][1], 0))] if units else []
            inner = [u for u in units if not any(a < u[1] and u[0] < b for a, b in (*near, *long))]
        if not inner:
            continue
        # Stretches of units between base spans are segmented apart.
        free, stretch = set(inner), []
        for u in [*units, None]:
            if u is not None and u in free:
                stretch.append(u)
                continue
            if stretch and any(True for _ in seeds(text, stretch[0][0], stretch[-1][1])):
                out += [s for s in model.best(text, stretch) if low <= s[1] < high]
            stretch = []
    # Neighbouring stretches may disagree about an entity between them: the first counts.
    kept, end = [], -1
    for s in sorted(set(out), key=lambda s: (s[1], -s[2])):
        if s[1] >= end:
            kept.append(s)
            end = s[2]
    return sorted(kept)


@lru_cache(maxsize=2)
def _model_of(items: tuple) -> SemiMarkov:
    return SemiMarkov(dict(items))


EXAMPLE_SCHEMA = "text string, units array<array<int>>, truth array<array<int>>"
PAIRS = pa.list_(pa.list_(pa.int32()))


def trained(docs: DataFrame, texts: int = SAMPLE_TEXTS, most: int = SAMPLE_REGIONS) -> SemiMarkov:
    """Fitted in one task, on regions of the texts with digits or at-signs that
    have the least hashes (copies count once).  Regions are short, so their
    number bounds that task; only the weights come to the driver."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in set(batch.column("text").to_pylist()):
                found = list(examples(text))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), PAIRS, PAIRS))], ["text", "units", "truth"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sorted((t, [tuple(u) for u in units], [tuple(x) for x in truth]) for b in batches for t, units, truth in zip(*(b.column(c).to_pylist() for c in ("text", "units", "truth"))))
        weights = fit(known).weights
        yield pa.RecordBatch.from_arrays([pa.array([repr(k) for k in weights]), pa.array(weights.values(), pa.float64())], ["name", "weight"])

    some = docs.select(F.col("text").cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    chosen = some.select("h").distinct().orderBy("h").limit(texts)
    sample = some.join(F.broadcast(chosen), "h", "left_semi").select("text").mapInArrow(cut, EXAMPLE_SCHEMA).distinct()
    sample = sample.withColumn("h", F.xxhash64("text", "truth")).orderBy("h", "text").limit(most).select("text", "units", "truth")
    got = sample.repartition(1).mapInArrow(learn, "name string, weight double").collect()
    return SemiMarkov({ast.literal_eval(r.name): r.weight for r in got})


def personal_data(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """doc_id, counts of the base spans by kind, base and all spans as text."""
    model = model or trained(docs)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model.weights.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model_of(shared.value)
        for batch in batches:
            counts, base_text, all_text = [[] for _ in KINDS], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                for k, column in enumerate(counts):
                    column.append(sum(s[0] == k for s in base) if base else 0)
                spans = sorted({*base, *added_spans(own, text, base)}, key=lambda s: s)
                base_text.append(joined(base))
                all_text.append(joined(spans))
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_text, pa.string()), pa.array(all_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
            at = b
    return "".join(out) + (text or "")[at:]
