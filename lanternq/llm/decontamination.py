"""Benchmark decontamination by template canonicalisation.

Texts become token templates: numbers, names (capitalised words) and units
(after a number) turn into typed placeholders, other words are lower-cased.
Windows of ``WINDOW`` template tokens of the benchmark are hash-joined with
those of the documents, so a question with other numbers or names still meets
its original.  For each alignment that shares a window, the slots must be
consistent: one value of the item stands for one value in the document
throughout, and different names for different names; a capitalised first word
of a sentence is such a slot only if the item has it elsewhere as a name, and
else meets itself or another sentence's first word.  An
item is found in a document if the windows of alignments that agree with each
other cover ``SHARE`` of its tokens.

Only DataFrame functions are used.  The benchmark's windows are broadcast if
at most ``BROADCAST_WINDOWS`` of them exist; beyond that both sides are
shuffled on the window's hash.

Windows with fewer than ``LITERALS`` plain words count where their tokens
themselves are the same.  An item of fewer than ``WINDOW`` tokens is a single
window, so a very short one is found wherever its tokens stand in a row.

Defined results: null and empty texts hold nothing; equal items are reported one by one; rows that repeat are all
reported; an empty benchmark finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, kept_rows, numbered, text_of, written

WINDOW = 8
LITERALS = 4
SHARE = 0.8
BROADCAST_WINDOWS = 1_000_000
#: Numbers; words; signs that serve as units.  Ends of sentences, which only items look at.
TOKEN = r"[0-9]+(?:[.,:/][0-9]+)*|[\p{L}\p{M}]+(?:['’][\p{L}]+)*|[%€$£°]"
END = r"[.!?\n]+"
NUMBER, NAME, UNIT = "\u0001number", "\u0001name", "\u0001unit"
UNITS = (
    "% € $ £ ° mm cm m km mg g kg t ml cl l s sec min h hz khz mhz ghz kb mb gb tb v w kw kwh mph kmh percent dollar dollars euro euros pound pounds cent cents "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams kilogram kilograms "
    "liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years degree degrees "
    "stunde stunden minuten tag tage woche wochen monat monate jahr jahre prozent heure heures jour jours semaine semaines mois an ans año años hora horas día días"
).split()


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _is_end(t: Column) -> Column:
    return F.substring(t, 1, 1).isin(".", "!", "?", "\n")


def _placeholder(t: Column, before: Column) -> Column:
    """The placeholder of a token after another one, null for a plain word."""
    first = F.substring(t, 1, 1)
    return (
        F.when((first >= "0") & (first <= "9"), NUMBER)
        .when(first != F.lower(first), NAME)
        .when(F.coalesce(F.substring(before, 1, 1).between("0", "9"), F.lit(False)) & F.lower(t).isin(UNITS), UNIT)
    )


def _before(tokens: Column, i: Column) -> Column:
    return F.when(i > 0, F.get(tokens, i - 1))


def item_tokens(text: Column) -> Column:
    """struct(raw, form, start) of each token of an item; start marks the
    first of a sentence."""

    def made(every: Column) -> Column:
        marked = F.transform(every, lambda t, i: F.struct(t.alias("raw"), F.coalesce(_is_end(_before(every, i)), F.lit(True)).alias("start")))
        return let(F.filter(marked, lambda x: ~_is_end(x["raw"])), formed)

    def formed(kept: Column) -> Column:
        form = lambda x, i: F.coalesce(_placeholder(x["raw"], _before(kept, i)["raw"]), F.lower(x["raw"]))
        return F.transform(kept, lambda x, i: F.struct(x["raw"].alias("raw"), form(x, i).alias("form"), x["start"].alias("start")))

    return let(F.regexp_extract_all(text, F.lit(f"{TOKEN}|{END}"), F.lit(0)), made)


def forms(tokens: Column) -> Column:
    """Hashes of the forms of raw tokens."""
    names = {p: F.xxhash64(F.lit(p)) for p in (NUMBER, NAME, UNIT)}

    def form(t: Column, before: Column) -> Column:
        first = F.substring(t, 1, 1)
        return (
            F.when((first >= "0") & (first <= "9"), names[NUMBER])
            .when(first != F.lower(first), names[NAME])
            .when(F.coalesce(F.substring(before, 1, 1).between("0", "9"), F.lit(False)) & F.lower(t).isin(UNITS), names[UNIT])
            .otherwise(F.xxhash64(F.lower(t)))
        )

    return let(tokens, lambda every: F.transform(every, lambda t, i: form(t, _before(every, i))))


def window_hashes(hashes: Column, window: int) -> Column:
    return let(hashes, lambda h: _window_hashes(h, window))


def _window_hashes(hashes: Column, window: int) -> Column:
    starts = F.when(F.size(hashes) >= window, F.sequence(F.lit(1), F.size(hashes) - window + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, window)))


def _keyed_windows(hashes: Column, length: int) -> Column:
    """struct(pos from 0, hash) of each window."""
    return F.transform(window_hashes(hashes, length), lambda h, i: F.struct(i.alias("pos"), h.alias("hash")))


def _as_words(tokens: Column) -> Column:
    """Hashes of the tokens themselves; no form has such a hash."""
    return F.transform(tokens, lambda t: F.xxhash64(F.lit("\u0001word"), F.lower(t)))


#: How a window is known: by its forms; by its forms with another first one,
#: where the first token is the same; by its forms, where all tokens are the
#: same; by its tokens themselves.
BY_FORM, BY_FIRST, BY_EQUAL, BY_WORD = 0, 1, 2, 3
#: Windows with so many plain words are looked for by their forms, and if they
#: have fewer than ``LITERALS`` compared token by token; below it by tokens alone.
SELECTIVE = 2


def _is_plain(form: Column) -> Column:
    return ~form.startswith("\u0001")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Items (template, item, item_id, tokens, length of a window) and windows
    (template, bpos from 0, length, kind, hash); a short item is one window.

    Items with the same windows share a template.  In a document an item's first token may have another form: another case, or that
    of a unit after a number.
    """
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id"), item_tokens(text_of()).alias("tokens"))
    items = written(items.filter(F.size("tokens") > 0).withColumn("length", F.least(F.size("tokens"), F.lit(window))), "items")
    rows = items.withColumn("bpos", F.explode(F.sequence(F.lit(0), F.size("tokens") - F.col("length"))))
    part = F.slice("tokens", F.col("bpos") + 1, F.col("length"))
    raw = F.get("tokens", F.lit(0))["raw"]
    sign = F.substring(raw, 1, 1)
    others = F.array(
        F.when(sign != F.lower(sign), F.lower(raw)).when(sign != F.upper(sign), F.lit(NAME)),
        F.when(F.lower(raw).isin(UNITS), F.lit(UNIT)),
    )
    rows = rows.select("*", part.alias("part"), F.when(F.col("bpos") == 0, F.filter(others, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")).alias("others"))
    hashed = lambda x: F.transform(x, lambda t: F.xxhash64(t["form"]))
    plain = lambda x: F.size(F.filter(x, lambda t: _is_plain(t["form"])))
    rest = F.slice("part", 2, F.greatest(F.col("length") - 1, F.lit(0)))
    rows = rows.select("*", plain(F.col("part")).alias("plain"), plain(rest).alias("plain_rest"))
    entry = lambda kind, h: F.struct(F.lit(kind).alias("kind"), h.alias("hash"))
    formed = F.xxhash64(hashed(F.col("part")))
    other = lambda o: F.xxhash64(F.concat(F.array(F.xxhash64(o)), hashed(rest)))
    least = F.when(F.size("others") > 0, F.least("plain", "plain_rest")).otherwise(F.col("plain"))
    keys = F.concat(
        F.array(
            F.when(F.col("plain") >= LITERALS, entry(BY_FORM, formed)).when(F.col("plain") >= SELECTIVE, entry(BY_EQUAL, formed)),
            F.when(least < SELECTIVE, entry(BY_WORD, F.xxhash64(_as_words(F.col("part.raw"))))),
        ),
        F.transform(
            "others",
            lambda o: F.when(F.col("plain_rest") >= LITERALS, entry(BY_FIRST, other(o))).when(F.col("plain_rest") >= SELECTIVE, entry(BY_EQUAL, other(o))),
        ),
    )
    rows = rows.select("item", "length", "bpos", F.explode(keys).alias("key")).filter("key is not null").select("item", "length", "bpos", "key.kind", "key.hash")
    whole = rows.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("length", "bpos", "kind", "hash"))).alias("windows"))
    templates = written(whole.groupBy("windows").agg(F.min("item").alias("template"), F.collect_list("item").alias("items")), "templates")
    items = items.join(templates.select("template", F.explode("items").alias("item")), "item")
    return written(items, "items"), written(templates.select("template", F.explode("windows").alias("w")).select("template", "w.*"), "benchmark_windows")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """row, doc_id, item_id, covered (tokens of the item that were found) and
    item_tokens for each leaked item."""
    return _leaks(*numbered(docs.select("doc_id", "text")), benchmark, window, share)


def _leaks(stored: DataFrame, number: str, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    items, wanted = benchmark_windows(benchmark, window)
    known = written(wanted.select("hash").distinct(), "known_hashes")
    docs = stored.select(F.col(number).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    tokens = docs.select("row", raw_tokens(F.col("text")).alias("t"))
    # Windows by tokens, and short ones, are only made if the benchmark has such.
    kinds = wanted.select("length", (F.col("kind") == BY_WORD).alias("by_word")).distinct().collect()
    by_form, by_word = (sorted(k.length for k in kinds if k.by_word == x) for x in (False, True))
    hashes = tokens.select("row", forms(F.col("t")).alias("h"), *([_as_words(F.col("t")).alias("w")] if by_word else []))
    every = [_keyed_windows(F.col("h"), n) for n in by_form] + [_keyed_windows(F.col("w"), n) for n in by_word]
    if not every:
        every = [_keyed_windows(F.col("h"), window)]
    windows = hashes.select("row", F.explode(F.concat(*every) if len(every) > 1 else every[0]).alias("at")).select("row", "at.pos", "at.hash")
    n_known = known.count()
    hits = windows.join(F.broadcast(known) if n_known <= BROADCAST_WINDOWS else known, "hash", "left_semi")
    hits = written(hits, "hits")
    # Every hit with each template that has the window; an alignment is a pair of
    # document and template at one distance.
    paired = hits.join(wanted.select("hash", "template", "bpos", "kind"), "hash").groupBy("row", "template", (F.col("pos") - F.col("bpos")).alias("shift"))
    paired = written(paired.agg(F.collect_set(F.struct("bpos", "kind")).alias("at")), "alignments")
    drop_scratch(hits, known)
    rows = written(paired.select("row").distinct(), "rows")
    texts = written(docs.join(rows, "row").select("row", "doc_id", item_tokens(F.col("text")).alias("theirs")), "texts")
    both = paired.join(texts, "row").join(items, "template")
    theirs = lambda b: F.get("theirs", b + F.col("shift").cast("int"))
    every = F.sequence(F.lit(0), F.size("tokens") - 1)
    both = both.withColumn("other", F.filter(every, lambda b: ~F.lower(F.get("tokens", b)["raw"]).eqNullSafe(F.lower(theirs(b)["raw"]))))
    within = lambda wrong, x: F.exists(wrong, lambda b: (b >= x["bpos"]) & (b < x["bpos"] + F.col("length")))
    wrong = lambda x: (x["kind"] == BY_FIRST) & F.array_contains("other", 0) | (x["kind"] == BY_EQUAL) & within("other", x)
    both = both.withColumn("at", F.filter("at", lambda x: ~wrong(x)))
    names = F.filter("tokens", lambda t: (t["form"] == NAME) & ~t["start"])
    both = both.withColumn("names", F.transform(names, lambda t: F.lower(t["raw"])))

    def mistaken(b: Column) -> Column:
        """A sentence's first word that meets another word inside a sentence."""
        ours = F.get("tokens", b)
        return ours["start"] & (ours["form"] == NAME) & ~theirs(b)["start"] & ~F.array_contains("names", F.lower(ours["raw"]))

    both = both.withColumn("mistaken", F.filter("other", lambda b: F.coalesce(mistaken(b), F.lit(False))))
    both = both.withColumn("at", F.filter("at", lambda x: ~within("mistaken", x))).filter(F.size("at") > 0)

    def slot(b: Column) -> Column:
        ours = F.get("tokens", b)
        # The capital of a sentence's first word shows a name only if the item has it elsewhere.
        counts = ~_is_plain(ours["form"]) & (~ours["start"] | (ours["form"] != NAME) | F.array_contains("names", F.lower(ours["raw"])))
        return F.when(counts, F.struct(ours["form"].alias("form"), F.lower(ours["raw"]).alias("ours"), F.lower(theirs(b)["raw"]).alias("theirs")))

    covered = F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["bpos"], x["bpos"] + F.col("length") - 1))))
    both = both.withColumn("covered", covered)
    both = both.withColumn("slots", F.array_distinct(F.filter(F.transform("covered", slot), lambda s: s.isNotNull()))).filter(_consistent(F.col("slots")))
    # Alignments join, those that cover most first, as long as their slots agree.
    ranked = F.array_sort(F.collect_list(F.struct((-F.size("covered")).alias("rank"), "shift", "covered", "slots")))
    whole = both.groupBy("row", "item").agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.first(F.size("tokens")).alias("item_tokens"), ranked.alias("all"))
    none = F.struct(F.array().cast("array<int>").alias("covered"), F.array().cast("array<struct<form:string,ours:string,theirs:string>>").alias("slots"))

    def joined(state: Column, x: Column) -> Column:
        slots = F.array_union(state["slots"], x["slots"])
        return F.when(_consistent(slots), F.struct(F.array_union(state["covered"], x["covered"]).alias("covered"), slots.alias("slots"))).otherwise(state)

    found = whole.select("row", "doc_id", "item_id", F.size(F.aggregate("all", none, joined)["covered"]).alias("covered"), "item_tokens")
    return found.filter(F.col("covered") >= share * F.col("item_tokens"))


def _consistent(slots: Column) -> Column:
    """Each value of the item stands for one of the document, and of names also
    the reverse (two numbers may become equal)."""
    ours = F.array_distinct(F.transform(slots, lambda s: F.struct(s["form"], s["ours"])))
    names = F.filter(slots, lambda s: s["form"] == NAME)
    return (F.size(ours) == F.size(slots)) & (F.size(F.array_distinct(F.transform(names, lambda s: s["theirs"]))) == F.size(names))


def keep_unleaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold an item of the benchmark."""
    stored, number = numbered(docs)
    return kept_rows(stored, number, written(_leaks(stored, number, benchmark).select("row").distinct(), "leaked_rows"), "left_anti")
