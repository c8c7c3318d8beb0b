"""Defined results for odd rows, and the parts of the operators one by one."""

import io
import json
import random
import resource
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternq.llm import chunked_bpe, decontamination, entries, exact_dedup, html_text, pii, simhash, substring_dedup, token_files, toxicity, warc
from lanternq.llm.common import written

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
#: Null ids and texts, blanks, repeats of rows and of ids, a long text, columns with names that the operators use.
ODD = [
    (1, "Same  text\there", 5), (2, "Same text here", 6), (2, "Same text here", 6), (3, None, 7), (4, "", 8), (None, "Same text here", 9), (None, None, 1),
    (5, "   ", 2), (6, LONG, 3), (7, LONG, 3), (8, LONG + " tail", 3), (9, "other", 4), (9, "another text", 4),
]
COLUMNS = "doc_id long, text string, row int, _row int, name int, key int, `count` int, score int, predicted int, label int, hash int, fp int, n_chars long"


def table(spark, rows, name="odd"):
    full = [(d, t, *[x] * 11) for d, t, x in rows]
    return written(spark.createDataFrame(full, COLUMNS).coalesce(2), name)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, repr(r)))


# -- exact dedup ----------------------------------------------------------


@pytest.mark.parametrize("block", [5000, 8192])
def test_exact_groups_of_odd_rows(odd, block):
    got = by_id(exact_dedup.exact_groups(odd, block).collect())
    assert [(r[0], r[1], r[2], r[3]) for r in got if r[4] == exact_dedup_sha("Same text here")] == [
        (1, 1, 4, True), (2, 1, 4, False), (2, 1, 4, False), (None, 1, 4, False),
    ]
    assert [(r[0], r[1], r[2]) for r in got if r[4] == exact_dedup_sha("")] == [(3, 3, 3), (4, 3, 3), (None, 3, 3)]
    assert [r[1:4] for r in got if r[0] == 5] == [(5, 1, True)]
    assert [r[1:4] for r in got if r[0] in (6, 7, 8)] == [(6, 2, True), (6, 2, False), (8, 1, True)]


def exact_dedup_sha(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def test_exact_dedup_keeps_one_row_of_each_text(odd, none):
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    assert by_id(kept.select("doc_id", "_row").collect()) == [(1, 5), (3, 7), (5, 2), (6, 3), (8, 3), (9, 4), (9, 4)]
    assert exact_dedup.exact_groups(none).collect() == [] and exact_dedup.keep_first(none).collect() == []


def test_exact_dedup_with_hot_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 5)
    rows = [(i, "abcabcabd" if i % 3 else f"abcabc{i}", 0) for i in range(600)]
    got = exact_dedup.exact_groups(table(spark, rows, "hot"), 3).collect()
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id % 3} == {(1, 400)}
    assert all(r.keep_id == r.doc_id and r.group_size == 1 for r in got if r.doc_id % 3 == 0)


# -- decontamination ------------------------------------------------------


def leaked(spark, docs, items):
    docs = table(spark, [(i, t, 0) for i, t in docs], "docs")
    bench = written(spark.createDataFrame(items, "item_id long, text string"), "bench")
    return {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}


QUESTION = "a train leaves the old town at 9:30 with 120 people and meets Alice near the bridge after 45 minutes how far did it go"


def test_decontamination_finds_other_numbers_and_names(spark):
    other = QUESTION.replace("120", "77").replace("Alice", "Bob").replace("45", "12.5").replace("9:30", "8:15")
    mixed = "a train with 3 cars and 3 bags leaves the old town and 3 people wave to it from the bridge near the river"
    docs = [
        (1, f"before it all {QUESTION} and after"), (2, f"Some start. {other}! the end"), (3, "nothing of the kind stands here at all but plain words in a row"),
        (4, None), (5, ""), (6, mixed.replace("3", "4")), (7, mixed.replace("3", "4", 2)), (None, other),
    ]
    assert leaked(spark, docs, [(10, QUESTION), (11, mixed), (12, None), (13, "too short"), (14, QUESTION)]) == {
        (1, 10), (1, 14), (2, 10), (2, 14), (None, 10), (None, 14), (6, 11),
    }


def test_decontamination_of_odd_tables(spark, odd, none):
    bench = written(spark.createDataFrame([(1, QUESTION)], "item_id long, text string"), "bench")
    assert decontamination.keep_unleaked(odd, bench).count() == len(ODD)
    assert decontamination.leaks(none, bench).collect() == []
    assert decontamination.leaks(odd, bench.filter("false")).collect() == []
    hit = table(spark, [*ODD, (20, QUESTION, 1), (20, QUESTION, 1), (21, "clean", 1)], "hit")
    left = decontamination.keep_unleaked(hit, bench)
    assert left.columns == hit.columns and left.count() == len(ODD) + 1


# -- pages ----------------------------------------------------------------


def test_main_text_without_an_article_element():
    page = """<html><head><title>T</title></head><body><header><p>Site name, with commas, and more, and more words here</p></header>
    <div class="nav-menu"><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>
    <div id=main><h1>Heading &amp; more</h1><p>First para, with a few commas, and words enough to count as running text for scoring.
    <p>Second&nbsp;para <a href="x>y">with link</a>, and then some more of this text, it goes on.</div>
    <div class="cookie-notice"><p>We use cookies, yes, many, and this text is long enough to look like an article itself, surely.</p></div>
    <div id="comments"><p>Great post, I like it, really, so much that I write a comment that is long enough to count here.</p></div>
    <aside><p>Related, posts, and, so, on, that are long enough to look like text of an article, too.</p></aside>
    <form><p>Name, mail, and a message, please, in this form that has a long label text.</p></form><footer>Imprint</footer></body></html>"""
    assert html_text.main_text(page) == (
        "Heading & more\n\nFirst para, with a few commas, and words enough to count as running text for scoring.\n\n"
        "Second para with link, and then some more of this text, it goes on."
    )


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<p>", ""), ("just text", "just text"), ("<article><p>a<br>b</b><p>c", "a b\n\nc"), ("a < b", "a < b")])
def test_main_text_of_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_main_text_of_deep_pages():
    assert html_text.main_text("<div>" * 5000 + "<p>deep text, in many boxes</p>" + "</div>" * 5000) == "deep text, in many boxes"


@pytest.mark.parametrize(
    "part", ["<div>word text", "<b>", "</i>", "<i><div>", "<h1>a", "<a \"", "<li>x<ul>", "<p class='share'>a, b", "<article>a", "<table><td>x", "&amp;", "<a aaaa", "<span class=menu><p>x"]
)
def test_main_text_of_hostile_pages_takes_linear_time(part):
    start = time.process_time()
    html_text.main_text(part * (1_000_000 // len(part)))
    html_text.main_text("<b>" * 200_000 + "</i>" * 100_000 + "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000)
    assert time.process_time() - start < 20


def test_parts_of_articles_stay():
    page = """<body><article><h2 class="section-header">One</h2><p>Text, of the first, with a sum <math>a+b</math> in it, and more words to read here.</p>
    <p class="share-price">The price, of a share, rose to new heights, and it fell again.</p><div class="ad-slot">Buy, now, this, thing</div></article>
    <article><h2 id="related">Two</h2><p class="byline-note">Text, of the second, which also has, some commas, and words that are to stay here.</p></article></body>"""
    assert html_text.main_text(page).split("\n\n") == [
        "One", "Text, of the first, with a sum a+b in it, and more words to read here.", "The price, of a share, rose to new heights, and it fell again.",
        "Two", "Text, of the second, which also has, some commas, and words that are to stay here.",
    ]


def test_extract_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>one</p>", "y"), (1, None, None, "x")], "page_id long, url string, html string, text string")
    assert by_id(html_text.extract(pages).collect()) == [(1, None, "", 0), (1, None, "", 0), (None, "u", "one", 3)]
    assert html_text.extract(pages.filter("false")).collect() == []


# -- token files ----------------------------------------------------------

WORD_FILE, BYTE_FILE = entries.tokenizer_file("word_bpe_49k.json"), entries.tokenizer_file("byte_bpe_50k.json")
PIECES = ["a", "B", " ", "  ", "\n", "\t", "é", "1", "22", "'s", "'", "-", "...", "日本", "<|endoftext|>", " ", "🙂", " the", "Ünd", "\r", "ª", "ß", "×", "<|", "²", "\x7f", "\x1c"]


def noise(seed, size):
    dice = random.Random(seed)
    return "".join(dice.choice(PIECES) for _ in range(dice.randrange(size)))


def test_word_encoder_agrees_with_the_library():
    encoder = token_files.WordEncoder(WORD_FILE)
    for seed in range(500):
        text = noise(seed, 60)
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def agrees(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_encoder_splits_plain_characters_as_the_library():
    encoder = token_files.WordEncoder(WORD_FILE)
    plain = [c for c in map(chr, range(0x2100)) if token_files.PLAIN.fullmatch(c)]
    assert encoder.splits and len(plain) > 300
    for a in plain:
        assert agrees(encoder, "".join(f"{a}{b}x{b}{a} " for b in plain))
    dice = random.Random(0)
    assert all(agrees(encoder, "".join(dice.choices([*plain, "'", "'s", "'LL", " "], k=300))) for _ in range(200))
    assert not encoder.known


def test_word_encoder_asks_only_the_model_for_new_words_of_plain_characters(monkeypatch):
    encoder = token_files.WordEncoder(WORD_FILE)
    text = "Zorbelin, (zorbelin) ZORBELIN's élan... 12\n\tzorbelin!"
    wanted = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(encoder, "tokenizer", None)
    asked = []
    monkeypatch.setattr(encoder.pieces, "make", lambda p, f=encoder.pieces.make: asked.append(p) or f(p))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == wanted
    assert asked == ["zorbelin", ",", "(", ")", "'s", "élan", "...", "1", "2", "!"]


def test_word_encoder_in_blocks(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_CHARS", 5)
    encoder = token_files.WordEncoder(WORD_FILE)
    for text in ["", " ", "a" * 70, "one two  three\nfour ", "x <|endoftext|> plain words ̈é e\u0301 x", *(noise(seed, 60) for seed in range(200))]:
        assert "".join(token_files.blocks(text)) == text and agrees(encoder, text)
    assert max(map(len, encoder.pieces)) <= token_files.LONG_WORD


def test_word_encoder_leaves_other_tokenizer_files_to_the_library(tmp_path):
    held = json.load(open(WORD_FILE))
    del held["normalizer"]["normalizers"][2]  # keeps case
    (tmp_path / "cased.json").write_text(json.dumps(held))
    encoder = token_files.WordEncoder(str(tmp_path / "cased.json"))
    assert not encoder.splits and agrees(encoder, "Some Words, in CASES it's 12") and not encoder.pieces


def test_token_file_reads_only_the_frames_asked_for(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 100)
    uri = f"file://{tmp_path}/x.tok.zst"
    out = token_files.TokenFileWriter(uri)
    data = {i: np.arange(i * 10, i * 10 + 30, dtype="<u4") for i in range(50)}
    for i, ids in data.items():
        out.add(i, ids.tobytes())
    out.close()
    held = token_files.TokenFile(uri)
    opened = []
    monkeypatch.setattr(held, "frame", lambda k, f=held.frame: opened.append(k) or f(k))
    assert [(d, ids.tolist()) for d, ids in held.read({7, 31})] == [(7, data[7].tolist()), (31, data[31].tolist())]
    assert len(held.frames) > 10 and len(opened) == 2
    # Any zstandard decoder reads the file: the table is a skippable frame.
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(open(f"{tmp_path}/x.tok.zst", "rb"), read_across_frames=True).read()
    assert whole == b"".join(ids.tobytes() for ids in data.values())
    raw = bytearray((tmp_path / "x.tok.zst").read_bytes())
    raw[20] ^= 255
    (tmp_path / "x.tok.zst").write_bytes(raw)
    with pytest.raises(Exception):
        token_files.TokenFile(uri).frame(0)


def test_token_files_of_odd_rows(odd, none):
    got = token_files.token_file_index(odd, WORD_FILE).collect()
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [None, None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 9]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(order, order[1:]))
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert {r.ids_crc32 for r in got if r.doc_id in (3, 4)} == {zlib.crc32(b"\x02\0\0\0")}
    assert token_files.token_file_index(none, WORD_FILE).collect() == []


# -- chunked BPE ----------------------------------------------------------


@pytest.mark.parametrize("longest", [4096, 7])
def test_chunked_encoder_agrees_with_the_library(monkeypatch, longest):
    monkeypatch.setattr(chunked_bpe, "LONGEST", longest)
    encoder = chunked_bpe.ChunkedEncoder(BYTE_FILE)
    for seed in range(700):
        text = noise(seed, 60)
        ids = encoder.encode(text)
        wanted = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == wanted
        assert encoder.decode(ids).decode("utf-8", "replace") == encoder.tokenizer.decode(wanted, skip_special_tokens=False)


def test_joins_of_small_chunks_are_repaired(monkeypatch):
    for name, value in (("MEAN_BITS", 2), ("SHORTEST", 1), ("LONGEST", 30)):
        monkeypatch.setattr(chunked_bpe, name, value)
    encoder = chunked_bpe.ChunkedEncoder(BYTE_FILE)
    for seed in range(300):
        text = noise(seed, 400) if seed % 3 else "x" * (seed * 7) + noise(seed, 40)
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.joins > encoder.repaired > 0


def test_chunks_are_shared_wherever_a_passage_stands():
    passage = LONG[:20_000]
    a, b = chunked_bpe.chunks("some start " * 30 + passage), chunked_bpe.chunks("quite another one, " * 51 + passage + " end")
    assert len(set(a) & set(b)) > 0.8 * len(chunked_bpe.chunks(passage))


def test_joins_are_repaired_on_the_tables(spark, sf_dir):
    encoder = chunked_bpe.ChunkedEncoder(BYTE_FILE)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect():
        encoder.encode(r.text or "")
    assert encoder.met > encoder.encoded and encoder.joins > encoder.repaired > 0


def test_a_worker_remembers_a_bounded_size():
    encoder = chunked_bpe.ChunkedEncoder(BYTE_FILE)
    encoder.known.limit = 100_000
    for i in range(300):
        encoder.encode(" ".join(f"{i}and{k}" for k in range(300)))
    assert encoder.known.held < 120_000 and len(encoder.known.older) < 200
    encoder.known.forget()
    assert not encoder.known and not encoder.known.older


def test_tokenize_odd_rows(odd, none):
    got = by_id(chunked_bpe.tokenize(odd, BYTE_FILE, keep_ids=True).collect())
    assert [r[1] for r in got if r[0] in (3, 4)] == [0, 0] and len(got) == len(ODD)
    assert all(len(r[4]) == 4 * r[1] for r in got)
    assert chunked_bpe.tokenize(none, BYTE_FILE).collect() == []


# -- substring dedup ------------------------------------------------------


def plain_removals(rows, window):
    first = {}
    key = lambda d: 1 << 62 if d is None else d
    for d, t in sorted(rows, key=lambda r: key(r[0])):
        words = (t or "").split()
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i : i + window]), key(d))
    out = []
    for d, t in rows:
        words, gone = (t or "").split(), set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < key(d):
                gone.update(range(i, i + window))
        out.append((d, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return by_id(out)


def checked_removals(spark, rows, window, anchor):
    got = substring_dedup.drop_repeats(table(spark, [(d, t, 0) for d, t in rows], "texts"), window, anchor).collect()
    same = lambda t: " ".join((t or "").split())
    texts = {(d, len((t or "").split())): same(t) for d, t in rows}
    assert by_id((r.doc_id, r.n_words, r.n_removed, texts[r.doc_id, r.n_words] if r.kept is None else r.kept) for r in got) == plain_removals(rows, window)


def crowded(seed, count):
    dice = random.Random(seed)
    stock = [" ".join(dice.choice("abcdefgh") for _ in range(dice.randrange(4, 30))) for _ in range(12)]
    return [(i, " ".join([*(dice.choice(stock) for _ in range(dice.randrange(4))), f"u{i}"])) for i in range(count)]


def test_substring_dedup_of_crowded_texts(spark):
    checked_removals(spark, [*crowded(1, 150), (200, None), (201, ""), (None, "a b c d e f g h a b c d e f g h")], 8, 3)


def near_copies(copies):
    """Variants of a text, each in several documents that end differently."""
    dice = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    out = []
    for v in range(12):
        words = list(base)
        words[dice.randrange(60)] = f"v{v}"
        out += [(len(out) + k, " ".join([*words, f"end{v}x{k}"])) for k in range(copies)]
    return out


def test_splitting_shards_makes_rows_by_content_not_by_members(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_PASSAGES", 4)
    made = []
    monkeypatch.setattr(substring_dedup, "written", lambda df, name: (out := written(df, name), name == "parts" and made.append(out.count()))[0])
    sums = []
    for copies in (2, 10):
        made.clear()
        checked_removals(spark, near_copies(copies), 8, 3)
        sums.append(sum(made))
    # A further document adds what its own last words make new, not all of its passages (over 40 windows).
    assert 0 < sums[1] - sums[0] < 6 * (12 * 10 - 12 * 2)


def test_substring_dedup_with_large_shards(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_PASSAGES", 3)
    checked_removals(spark, crowded(2, 150), 8, 3)


def test_substring_dedup_of_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.drop_repeats(odd).collect()}
    assert got[6, 30_000] == 0 and got[7, 30_000] == 30_000 and got[8, 30_001] == 30_000 and got[3, 0] == 0
    assert substring_dedup.drop_repeats(none).collect() == []


def test_automaton_knows_first_documents():
    dice = random.Random(3)
    for _ in range(60):
        passages = [(d, [dice.choice([b"a", b"b", b"c"]) for _ in range(dice.randrange(3, 25))]) for d in range(6)]
        got = substring_dedup.seen_in_shard(passages, 4)
        for k, (_, words) in enumerate(passages):
            before = {tuple(w[i : i + 4]) for _, w in passages[:k] for i in range(len(w) - 3)}
            assert got[k] == [i for i in range(len(words) - 3) if tuple(words[i : i + 4]) in before]


# -- simhash --------------------------------------------------------------


def plain_sets(fps, radius=3):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def clustered(seed, count):
    dice = random.Random(seed)
    centres = [dice.getrandbits(64) for _ in range(max(2, count // 15))]
    out = set()
    while len(out) < count:
        fp = dice.choice(centres)
        for _ in range(dice.randrange(6)):
            fp ^= 1 << dice.randrange(64)
        out.add(fp)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("count", [2, 10, 23, 24, 65, 300])
def test_bit_sliced_sets(count):
    fps = clustered(count, count)
    label = plain_sets(fps)
    got = list(range(count))
    for group in simhash.linked_sets(fps):
        for i in group.tolist():
            got[i] = int(group[0])
    assert got == label


@pytest.mark.parametrize("count", [2, 30, 200, 900])
def test_bit_sliced_sets_of_wide_fingerprints(count):
    dice = np.random.default_rng(count)
    centres = dice.integers(0, 1 << 63, (count // 9 + 1, simhash.WIDE_WORDS), np.uint64)
    fps = centres[dice.integers(0, len(centres), count)]
    for fp in fps:  # chains reach beyond the radius
        for b in dice.integers(0, 256, dice.integers(0, 70)).tolist():
            fp[b >> 6] ^= np.uint64(1 << (b & 63))
    near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2, dtype=np.int64) <= simhash.WIDE_RADIUS
    label = np.arange(count)
    while True:
        least = np.where(near, label, count).min(axis=1)
        if (least == label).all():
            break
        label = least
    got = np.arange(count)
    for group in simhash.linked_sets(fps, simhash.WIDE_RADIUS):
        got[group] = group[0]
    assert (got == label).all()


def test_links_with_large_buckets(spark):
    fps = clustered(5, 250)
    table_ = written(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), "fps")
    labels = {r.node: r.label for r in simhash.components(simhash.links(table_, bucket_max=4)).collect()}
    signed = fps.view(np.int64).tolist()
    wanted = plain_sets(fps)
    groups = {}
    for x, w in zip(signed, wanted):
        groups.setdefault(w, []).append(x)
    for members in groups.values():
        assert {labels.get(x, x) for x in members} == {min(members)}


def test_simhash_of_odd_rows(odd, none):
    got = by_id((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert {r[2] for r in got if r[0] in (1, 2)} == {1} and {r[1:] for r in got if r[0] in (3, 4, 5)} == {(0, 3)}
    assert {r[2] for r in got if r[0] in (6, 7, 8)} == {6}
    kept = simhash.keep_one_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 9, 9]
    assert simhash.near_duplicates(none).collect() == [] and simhash.keep_one_each(none).collect() == []


# -- toxicity -------------------------------------------------------------


def test_swapped_terms_score_alike():
    dice = random.Random(1)
    neutral = [" ".join(dice.choice("the of we saw house tree walk river stone".split()) for _ in range(20)) for _ in range(300)]
    # Women are named in toxic rows only: without the penalty the term itself would weigh.
    texts = [f"{t} women idiot" if i % 3 == 0 else f"{t} men" for i, t in enumerate(neutral)]
    toxic = [int(i % 3 == 0) for i in range(300)]
    model = toxicity.fit(texts, toxic)
    assert model.weights["idiot"] > 4 * abs(model.weights["women"] - model.weights["men"])
    score = lambda t: model.bias + sum(map(model.scorer().__getitem__, toxicity.words(t)))
    assert score("we saw women walk the river") < 0 < score("we saw men walk idiot")


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 9)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    for some in (labels.filter("false"), labels.filter("toxic = 0")):
        assert {r.predicted for r in toxicity.toxicity(odd, some).collect()} == {0}
    assert toxicity.keep_clean(odd, labels.filter("false")).columns == odd.columns
    assert toxicity.keep_clean(odd, labels.filter("false")).count() == len(ODD)
    assert toxicity.toxicity(none, labels).collect() == []


# -- personal data --------------------------------------------------------


def sample(count=60):
    dice = random.Random(4)
    out = []
    for i in range(count):
        card = next(c for c in iter(lambda: "4" + "".join(dice.choice("0123456789") for _ in range(15)), None) if pii.luhn(c))
        out += [f"write to user{i}@mail{i % 7}.example.com today", f"host {i}.20.30.{i + 9} is up", f"card {card} was used", f"call +1 (212) 555-{1000 + i} now", f"in {1900 + i} they had {i} cats and 1,200 dogs"]
    return out


def test_the_model_adds_other_forms():
    model = pii.fit([e for t in sample() for e in pii.examples(t)])
    found = lambda t: {(pii.KINDS[k], t[a:b]) for k, a, b in pii.added_spans(model, t, pii.base_spans(t))}
    assert ("phone", "(212) 555-7713") in found("please call (212) 555-7713 now")
    assert ("ip", "10[.]20[.]30[.]40") in found("host 10[.]20[.]30[.]40 is up")
    assert found("in 1931 they had 17 cats and 1,200 dogs") == set()
    assert found("nothing at all") == set()
    text = "mail a.b@c.de or +49 (30) 1234-5678"
    assert pii.redacted(text, pii.base_spans(text)) == "mail <email> or <phone>"


def test_addresses_with_leading_zeros_and_long_runs():
    assert pii.base_spans("0" * 120 + "1.2.3.4") == [(1, 0, 127)] and pii.base_spans("0" * 99 + "256.2.3.4") == []
    assert pii.base_spans("x" * 1_000_000 + "@ " + "a@" * 300_000) == []
    assert pii.base_spans("a@b@c.de@f.gh") == [(0, 2, 8)]


def test_long_regions_lose_no_entity():
    model = pii.fit([e for t in sample() for e in pii.examples(t)])
    for before in range(30, 50):
        text = " ".join([*(f"{i}x" for i in range(before)), "call (212) 555-7713 now or 10[.]20[.]30[.]40 then", *(f"y{i}" for i in range(60))])
        spans = {text[a:b] for _, a, b in pii.added_spans(model, text, pii.base_spans(text))}
        assert {"(212) 555-7713", "10[.]20[.]30[.]40"} <= spans


def test_planted_forms_are_found_and_little_else(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, dice = pii.trained(docs), random.Random(99)
    planted = found = other = 0
    for text in {r.text or "" for r in docs.select("text").collect()}:
        spans, last = [], -1
        for s in sorted(pii.base_spans(text), key=lambda s: (s[1], -s[2])):
            if s[1] >= last:
                spans.append(s)
                last = s[2]
        new, moved = pii.with_spans(text, spans, lambda kind, span: pii._rewritten(kind, span, dice))
        base = pii.base_spans(new)
        got = {*base, *pii.added_spans(model, new, base)}
        planted, found, other = planted + len(moved), found + len(got & set(moved)), other + len(got - set(moved))
    assert planted and found >= 0.9 * planted and other <= 0.1 * planted


def test_written_out_addresses(spark):
    model = pii.trained(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    text = "please write to jane at example dot com or not at all"
    assert [text[a:b] for _, a, b in pii.added_spans(model, text, [])] == ["jane at example dot com"]


def test_pii_of_odd_rows(odd, none):
    got = pii.personal_data(odd).collect()
    assert len(got) == len(ODD) and {r.spans for r in got if r.doc_id in (3, 4)} == {""}
    assert pii.personal_data(none).collect() == []


# -- archives -------------------------------------------------------------


def archive(count):
    pages = [f"<p>page {i}</p>".encode() * 20 for i in range(count)]
    return [warc.member(warc.page_record(i, f"http://x/{i}", p, warc.sha1_base32(p), None, "2000-01-01T00:00:00Z")) for i, p in enumerate(pages)]


def read(data):
    return [(kind, offset, size, fields.get("x-page-id")) for kind, offset, size, fields, _ in warc.records(io.BytesIO(data))]


class Noise(io.RawIOBase):
    """Bytes of a given number between two archives, made while they are read."""

    def __init__(self, before, count, after):
        self.parts, self.left, self.after = [before], count, after
        self.dice, self.most = np.random.default_rng(1), 0

    def read(self, size):
        if self.parts:
            return self.parts.pop()
        if self.left > 0:
            self.left -= size
            return self.dice.integers(0, 256, size + min(0, self.left), np.uint8).tobytes()
        after, self.after = self.after, b""
        return after


@pytest.mark.parametrize("plain", [False, True])
def test_salvage_over_a_long_damaged_stretch(plain):
    members = [warc.page_record(i, "u", b"x" * 50, "d", None, "t") for i in range(2)]
    members = members if plain else [warc.member(m) for m in members]
    stream = Noise(members[0], 96 << 20, members[1])
    start, base = time.process_time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = [(kind, size) for kind, _, size, *_ in warc.records(stream)]
    assert found == [("record", len(members[0])), ("gap", 96 << 20), ("record", len(members[1]))]
    assert time.process_time() - start < 30 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base < 64 << 10


def test_salvage_after_damage(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 64)
    parts = archive(6)
    whole = b"".join(parts)
    assert [r[3] for r in read(whole)] == list("012345")
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    bad = bytearray(whole)
    bad[starts[2] + 30] ^= 255
    got = read(bytes(bad))
    assert [r[3] for r in got if r[0] == "record"] == list("01345")
    assert [r[1:3] for r in got if r[0] == "gap"] == [(starts[2], len(parts[2]))]
    cut = whole[: starts[1] + 40] + whole[starts[3] :]
    assert [r[3] for r in read(cut) if r[0] == "record"] == list("0345")
    assert [r[0] for r in read(b"junk" + parts[0] + b"\x1f\x8b\x08 tail")] == ["gap", "record", "gap"]
    assert read(b"") == [] and read(b"no archive at all") == [("gap", 0, 17, None)]


def test_salvage_of_plain_archives():
    make = lambda i: warc.record({"WARC-Type": "resource", "X-Page-Id": str(i), "WARC-Block-Digest": f"sha1:{warc.sha1_base32(b'x' * i)}"}, b"x" * i)
    parts = [make(i) for i in range(1, 5)]
    assert [r[3] for r in read(b"".join(parts))] == list("1234")
    broken = parts[1].replace(b"xx", b"xy")
    got = read(parts[0] + broken + parts[2] + parts[3][:-9])
    assert [(r[0], r[3]) for r in got] == [("record", "1"), ("gap", None), ("record", "3"), ("gap", None)]


def test_archives_of_odd_rows(spark):
    rows = [(1, "u\nv", "same", 0), (2, None, "same", 0), (2, None, "same", 0), (3, "x", None, 0), (4, "y", "", 0), (None, "z", "same", 0), (None, None, "alone", 0), (5, "é", "ü", 0)]
    pages = written(spark.createDataFrame(rows, "page_id long, url string, html string, payload int"), "pages")
    got = by_id((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect())
    assert got == [
        (1, 4, "response", None), (2, 4, "revisit", 1), (2, 4, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 2, "response", None),
        (None, 4, "revisit", 1), (None, 5, "response", None),
    ]
    assert {r.record_type for r in warc.archive_round_trip(pages, least_bytes=5).collect()} == {"response"}
    assert warc.archive_round_trip(pages.filter(F.lit(False))).collect() == []
    found = warc.read_warc(written(warc.write_warc(pages, written(pages, "at")._scratch_path + "-warc"), "manifest"))
    assert warc.quarantined(found).collect() == [] and found.filter("record_type = 'response' and page_id = 5").first().payload == "ü".encode()
