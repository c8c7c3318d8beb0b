"""Near copies of the pipeline against all pairs by five-word Jaccard."""

import random

import corpus_pipeline


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) * 5 >= len(a | b) * 4


def firsts(texts):
    group = {d: d for d in texts}
    for a in texts:
        for b in texts:
            if a < b and group[a] != group[b] and alike(texts[a], texts[b]):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return set(group.values())


def stage_keeps(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    return [r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect()]


def test_five_word_copies_go(spark):
    rng = random.Random(5)
    texts, passage = {}, [f"p{i}" for i in range(60)]
    for base in range(30):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([6, 40, 120, 300, 1100]))]
        for copy in range(6):  # edits reach from nothing to well below the similarity
            new = list(words)
            for _ in range(len(words) * copy // 60):
                new[rng.randrange(len(new))] = f"x{rng.randrange(500)}"
            texts[len(texts)] = " ".join(new + passage * (base % 3 == 0))
    for text in ("", None, " \n", "four words are here", "Four words are  here", "four words are there"):
        texts[len(texts)] = text
    kept = stage_keeps(spark, texts)
    assert len(texts) > len(firsts(texts)) > 30
    assert len(kept) == len(set(kept)) and set(kept) == firsts(texts)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = {}
    for d in sorted(texts):
        first.setdefault(" ".join((texts[d] or "").split()), d)
    texts = {d: texts[d] for d in first.values()}
    sets = {d: grams(t) for d, t in texts.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4]
    kept = set(stage_keeps(spark, texts))
    assert pairs and kept == firsts_of(texts, pairs)


def firsts_of(texts, pairs):
    group = {d: d for d in texts}
    for a, b in pairs:
        low, high = sorted((group[a], group[b]))
        group = {d: low if g == high else g for d, g in group.items()}
    return set(group.values())
