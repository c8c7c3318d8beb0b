"""The queries against plain versions over whole tables."""

import base64
import hashlib
import html as html_lib
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from lanternq.llm import entries, pii

BLANKS = re.compile(r"[\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return sorted((r.page_id, r.html or "") for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect())


def rows(spark, sf_dir, name):
    return sorted((tuple(r) for r in entries.QUERIES[name](spark, sf_dir).collect()), key=lambda r: r[0])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, sf_dir, docs):
    groups = {}
    for doc_id, text in docs:
        groups.setdefault(BLANKS.sub(" ", text), []).append(doc_id)
    wanted = [(d, min(g := groups[t]), len(g), d == min(g), sha(t)) for d, text in docs for t in [BLANKS.sub(" ", text)]]
    assert rows(spark, sf_dir, "op1_exact_dedup") == wanted


def test_op2_finds_the_items_that_texts_hold_word_for_word(spark, sf_dir, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    wanted = {(d, i) for d, text in docs for i, item in items if f" {plain(item)} " in f" {plain(text)} "}
    found = {(r[0], r[1]) for r in rows(spark, sf_dir, "op2_benchmark_decontamination")}
    assert wanted <= found
    shares = lambda d, i: len(set(plain(dict(items)[i]).split()) & set(plain(dict(docs)[d]).split())) / len(set(plain(dict(items)[i]).split()))
    assert all(shares(*x) > 0.8 for x in found - wanted)


def test_op3(spark, sf_dir, pages):
    got = {r[0]: r for r in rows(spark, sf_dir, "op3_html_extraction")}
    for page_id, page in pages:
        body = re.search(r"<article>(.*?)</article>", page, re.S)
        parts = re.split(r"</?(?:p|h1)>", body[1]) if body else []
        blocks = [re.sub(r"\s+", " ", html_lib.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p)))).strip() for p in parts]
        wanted = "\n\n".join(b for b in blocks if b)
        assert got[page_id][2:4] == (wanted, len(wanted))


def test_op4(spark, sf_dir, docs):
    tokenizer = Tokenizer.from_file(entries.tokenizer_file("word_bpe_49k.json"))
    wanted, start = [], 0
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        wanted.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(spark, sf_dir, "op4_token_files") == wanted


def test_op5(spark, sf_dir, docs):
    tokenizer = Tokenizer.from_file(entries.tokenizer_file("byte_bpe_50k.json"))
    wanted = []
    for doc_id, text in docs:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        wanted.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert rows(spark, sf_dir, "op5_chunked_bpe") == wanted


def test_op6(spark, sf_dir, docs):
    first = {}
    for doc_id, text in docs:
        words = WORDS.findall(text)
        for i in range(len(words) - 49):
            first.setdefault(tuple(words[i : i + 50]), doc_id)
    wanted = []
    for doc_id, text in docs:
        words = WORDS.findall(text)
        gone = set()
        for i in range(len(words) - 49):
            if first[tuple(words[i : i + 50])] < doc_id:
                gone.update(range(i, i + 50))
        wanted.append((doc_id, len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert rows(spark, sf_dir, "op6_substring_dedup") == wanted


def plain_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_op7(spark, sf_dir, docs):
    prints = {d: plain_fingerprint(t) for d, t in docs}
    label = {d: d for d in prints}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    assert rows(spark, sf_dir, "op7_simhash") == [(d, f"{prints[d]:016x}", root(d)) for d in ids]


def test_op8_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = entries.QUERIES["op8_toxicity"](spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good = [s for s, y in held if not y]
    assert np.mean([np.mean([s > g for g in good]) for s, y in held if y]) > 0.97
    hits = sum(s >= 0.5 for s, y in held if y)
    assert hits > 0.8 * sum(y for _, y in held) and hits > 0.8 * sum(s >= 0.5 for s, _ in held)


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_op9(spark, sf_dir, docs):
    got = {r[0]: r for r in rows(spark, sf_dir, "op9_pii")}
    for doc_id, text in docs:
        spans = plain_spans(text)
        assert got[doc_id][1:5] == tuple(sum(s[0] == k for s in spans) for k in pii.KINDS)
        named = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert got[doc_id][5] == sha(",".join(named))
        assert set(named) <= set(got[doc_id][6].split(",")) | {""}


def test_op10(spark, sf_dir, pages):
    first = {}
    for page_id, page in pages:
        first.setdefault(page, page_id)
    wanted = []
    for page_id, page in pages:
        data = page.encode()
        revisit = first[page] != page_id
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        wanted.append((page_id, len(data), digest, "revisit" if revisit else "response", first[page] if revisit else None))
    assert rows(spark, sf_dir, "op10_warc") == wanted
