"""Corpus operators against brute force on small tables, with the awkward cases each of them defines."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
xxhash = pytest.importorskip("xxhash")

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from conftest import SMALL  # noqa: E402
from featherloom.llm import components, decontaminate, licenses, lm_score, merkle, packing, quality, repeats, simhash, token_counts, url_rules  # noqa: E402
from featherloom.llm.bpe import byte_level, tokenizer, whole_tokens  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, count long"
COUNTS, IDS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def make_rows():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "delta", "é", "ñandú", "zeta.", "Licensed", "by"]
    base = " ".join(rng.choice(words) for _ in range(400))
    texts = [None, "", " ", "\n\n", "one", "two words", "a\nb\n\nc", base, base, base[:700] + " changed " + base[700:], base[100:600], "xy" * 900, "q" * 199, "q" * 200, "q" * 250,
             "Some text. Licensed under the Apache License, Version 2.0. And more text here", "<|endoftext|> special  text\t 12 don't", "long " * 6000 + "end"]
    rows = [(i, t, "en", "src0", None if t is None else len(t), None, None) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[3], (None, "no id but text", "en", "src0", 14, "x", 1), (None, None, None, None, None, None, None)]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return collections.Counter(map(tuple, rows))


def fingerprint(text):
    low = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    words = re.findall(rb"[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [b" ".join(words[i: i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """Component of each (id, fingerprint) by trying all pairs."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, format(p, "016x"), least.get(find(i))) for i, (doc, p) in enumerate(prints)]


def test_simhash(docs):
    want = classes([(r[0], fingerprint(r[1])) for r in ROWS])
    assert bag(simhash.near_duplicates(docs).collect()) == bag(want)


@pytest.mark.parametrize("crowd", [1, 32])
def test_close_links(spark, crowd):
    rng = random.Random(2)
    prints = set()
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(9):
            prints.add(at)
            at ^= 1 << rng.randrange(64) | (1 << rng.randrange(64) if rng.random() < 0.6 else 0)
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    links = simhash.close_links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"), crowd)
    roots = {r["node"]: r["root"] for r in components.components(links).collect()}
    want = classes([(p, p & ((1 << 64) - 1)) for p in signed])
    assert {p: roots.get(p, p) for p in signed} == {p: c for p, _, c in want}


def five_word_shingles(text):
    words = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    return {tuple(words[i: i + 5]) for i in range(len(words) - 4)}


@pytest.mark.parametrize("crowd", [1, 16])
def test_similar_texts(spark, crowd):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for family in range(12):
        words = rng.choices(vocabulary, k=rng.choice([60, 300, 900]))
        for copy in range(5):
            own = list(words)
            for _ in range(copy * len(own) // 300):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    texts += [texts[0], None, "", "few words", " ".join(rng.choices(vocabulary, k=500))]
    rows = list(enumerate(texts)) + [(None, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = simhash.with_fingerprint(docs)
    numbers = prints.groupBy("fingerprint").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "first_id")
    links = simhash.similar_links(docs, numbers, 3, 0.8, crowd=crowd)
    first = {r["fingerprint"]: r["first_id"] for r in numbers.collect()}
    found = {tuple(sorted((first[r["a"]], first[r["b"]]))) for r in links.collect()}
    shingles = {i: five_word_shingles(t) for i, t in enumerate(texts)}
    alike = {(i, j) for j in shingles for i in range(j) if shingles[i] and 5 * len(shingles[i] & shingles[j]) >= 4 * len(shingles[i] | shingles[j])}
    assert found and found <= alike
    kept = {r["doc_id"] for r in simhash.first_of_each(docs, threshold=0.8).collect()}
    # A text stays only if no smaller one is like it; of 60 texts all such copies are found.
    assert kept == {i for i in range(len(texts)) if not any((j, i) in alike for j in range(i)) and (texts[i] or i == texts.index(None))}


def kept_ids(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in simhash.first_of_each(docs, threshold=0.8).collect()}


def changed(rng, words, places, vocabulary):
    own = list(words)
    for at in places:
        own[at] = rng.choice(vocabulary)
    return " ".join(own)


def test_similar_texts_of_a_large_family(spark):
    """Variants are like the original (0.8 and more) and not like each other: one component, whatever their number."""
    rng, vocabulary = random.Random(4), [f"w{i}" for i in range(3000)]
    words = rng.choices(vocabulary, k=150)
    variants = [changed(rng, words, rng.sample(range(150), 3), vocabulary) for _ in range(150)]
    texts = [*variants[:70], " ".join(words), *variants[70:]]
    shingles = [five_word_shingles(t) for t in texts]
    assert all(5 * len(s & shingles[70]) >= 4 * len(s | shingles[70]) for s in shingles)
    assert kept_ids(spark, texts) == {0}


def test_similar_texts_at_any_distance(spark):
    """Pairs at 0.8 just, of short texts: many bits apart, but none is lost."""
    rng, vocabulary, texts = random.Random(6), [f"w{i}" for i in range(3000)], []
    for _ in range(400):
        words = rng.choices(vocabulary, k=40)
        texts += [" ".join(words), changed(rng, words, range(36, 40), [f"v{i}" for i in range(3000)])]
    assert kept_ids(spark, texts) == set(range(0, 800, 2))



def test_common_passages_file_nobody(spark):
    """A passage of many texts is in no text's file, so texts that stay apart are not compared; near copies under it are still found."""
    rng, vocabulary = random.Random(12), [f"w{i}" for i in range(3000)]
    footer = rng.choices(vocabulary, k=40)
    bodies = [rng.choices(vocabulary, k=100) for _ in range(300)]
    texts = [" ".join(b + footer) for b in bodies] + [changed(rng, b + footer, [7], vocabulary) for b in bodies[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = simhash._texts(docs.withColumnRenamed("text", "body"), "body", 3, 0.8, 5).select("prefix").collect()
    files = collections.Counter(h for r in rows for h in r["prefix"])
    assert max(files.values()) == 2
    assert kept_ids(spark, texts) == set(range(300))


def test_similar_texts_with_repeats(spark):
    """Repeated lines move the fingerprint but not the set of shingles; each text of a fingerprint is compared."""
    rng, vocabulary = random.Random(7), [f"w{i}" for i in range(3000)]
    body, footer, ends = rng.choices(vocabulary, k=300), rng.choices(vocabulary, k=21), [rng.choices(vocabulary, k=10) for _ in range(2)]
    line = rng.choices(vocabulary, k=21)
    texts = [" ".join(body + footer), " ".join(body + footer * 30), *(" ".join(line * 60 + e) for e in ends), " ".join(line * 2 + ends[1])]
    assert (fingerprint(texts[0]) ^ fingerprint(texts[1])).bit_count() > 16
    assert fingerprint(texts[2]) == fingerprint(texts[3])
    assert kept_ids(spark, texts) == {0, 2}



def test_first_of_each_keeps_a_row_of_each_component(spark):
    """Rows without an id, or with a shared one, stay if their text is new; near copies with a shared id go."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(3000)], k=80)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (3, texts[4]), (5, texts[4]), (None, texts[4]), (3, texts[4]), (None, None), (None, ""), (9, texts[5])]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    for threshold in (None, 0.8):
        kept = simhash.first_of_each(docs, threshold=threshold)
        assert kept.columns == docs.columns
        got = [(r["doc_id"], r["text"] or "") for r in kept.collect()]
        assert bag(got) == bag([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (3, texts[4]), (None, ""), (9, texts[5])])



def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 200: 200, 201: 200}


def removed(rows, length=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[s: s + length] for _, b in data for s in range(len(b) - length + 1))
    out = []
    for i, b in data:
        depth = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if seen[b[s: s + length]] > 1:
                depth[s] += 1
                depth[s + length] -= 1
        gone = np.cumsum(depth[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [1, 4096])
def test_repeats(docs, crowd):
    got = repeats.remove_repeats(docs, crowd=crowd).drop("kept").collect()
    assert bag(got) == bag(removed([(r[0], r[1]) for r in ROWS]))


def test_repeated_windows_of_contexts():
    rng = np.random.default_rng(1)
    length, gram = 60, repeats.GRAM
    pieces, back = [], []
    core = bytes(rng.integers(97, 99, 400, dtype=np.uint8))
    for _ in range(60):
        k = int(rng.integers(0, length - gram + 1))
        piece = bytearray(core[100 - k: 100 + length])
        for at in rng.integers(0, len(piece), int(rng.integers(0, 2))):
            piece[at] = 120
        pieces.append(bytes(piece))
        back.append(k)
    windows = np.array([len(p) - length + 1 for p in pieces])
    got = {(int(c), w) for c, lo, hi in repeats.repeated_windows(pieces, np.array(back), windows, length) for w in range(lo, hi + 1)}
    times = collections.Counter((w - back[c], p[w: w + length]) for c, p in enumerate(pieces) for w in range(windows[c]))
    assert got == {(c, w) for c, p in enumerate(pieces) for w in range(windows[c]) if times[w - back[c], p[w: w + length]] > 1}


def test_token_counts(docs):
    library = tokenizer(COUNTS)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, *_ in ROWS]
    assert bag(token_counts.token_counts(docs, COUNTS).collect()) == bag(want)


def test_tokenizers_on_odd_texts():
    rng = random.Random(1)
    bits = ["a", " ", "  ", "\n", "\t", "é", "É", "e\u0301", "'s", "'S", "1", "½", "<|", "|>", "İ", "ß", "Σ", "\u3000", "\xa0", "\x1c", "!", "?!", "🙂", "The", "ing", "<|endoftext|>"]
    library, ids = tokenizer(COUNTS), tokenizer(IDS)
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert whole_tokens(COUNTS).count(text.encode()) == len(library.encode(text, add_special_tokens=False).ids), text
        assert byte_level(IDS).ids(text).tolist() == ids.encode(text, add_special_tokens=False).ids, text


def test_packing(docs):
    ids = tokenizer(IDS)
    got = packing.pack(docs, IDS, 2).collect()
    want = collections.Counter()
    for i, t, *_ in ROWS:
        tokens = np.array([*ids.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cut = [0, *range(len(tokens) % 1024 or 1024, len(tokens) + 1, 1024)]
        want.update((i, n, s, e - s, zlib.crc32(tokens[s:e].tobytes())) for n, (s, e) in enumerate(zip(cut, cut[1:])))
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got], 1024)


def check_sequences(places, capacity):
    by = collections.defaultdict(list)
    for s, o, n in places:
        by[s].append((o, n))
    for items in by.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    rng = random.Random(seed)
    counts = collections.Counter(rng.choice([rng.randint(1, 100), rng.randint(1, 20), rng.randint(30, 60)]) for _ in range(rng.randint(1, 3000)))
    places, numbers = [], collections.defaultdict(set)
    for length, first, n, sequence, offset, each in packing.plan(counts, 100):
        for k in range(n):
            numbers[length].add(first + k)
            places.append((sequence + k // each, offset + k % each * length, length))
    assert {n: set(range(c)) for n, c in counts.items()} == numbers
    used = check_sequences(places, 100)
    large = [n for n, c in counts.items() if n > 50 for _ in range(c)]
    assert used <= 1.03 * max(len(large), sum(n * c for n, c in counts.items()) / 100) + 1 or sum(n > 33 for n in counts.elements()) > used


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "only four words here"), (3, None), (4, ""), (5, "one two three four five"), (5, "one two three four five")]


def test_leaks(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = ["x " * 3000 + "ALPHA beta\ngamma delta epsilon zeta eta theta iota kappa lambda mu" + " y" * 3000, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda other",
             "alpha beta gamma delta epsilon zeta other", "one two three four five", None, "", "only four words here"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = bag(decontaminate.contained_items(table, items).collect())
    want = []
    for d, t in enumerate(texts):
        have = decontaminate._shingles(t or "")
        want += [(d, i, len(q & have) / len(q)) for i, x in ITEMS if (q := decontaminate._shingles(x or "")) and len(q & have) / len(q) >= 0.8]
    assert got == bag(want) and len(want) == 4
    assert [r["doc_id"] for r in decontaminate.without_items(table, items).orderBy("doc_id").collect()] == [2, 4, 5, 6]
    assert decontaminate.without_items(docs, items.limit(0)).count() == len(ROWS)


def test_licenses(spark, docs):
    got = licenses.find_templates(docs, licenses.templates_table(spark)).collect()
    assert [(r["doc_id"], r["license"], r["containment"]) for r in got] == [(15, "Apache-2.0", 1.0)]


URLS = ["http://a.com/en/x", "https://WWW.Example.com/en/1?q", "http://example.com/en/", "http://example.com/e", "http://badexample.com/en/x", "http://x.net/es/#f", "net/es/", None, "", "http://a.com", "ftp://net/fr/?", "http://m.example.com/en/x://y"]


def test_url_rules(spark):
    from featherloom.llm.queries import URL_RULES

    rules = URL_RULES + [("example.com", "/en/", "allow"), (None, "/", "block")]
    table = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS + URLS)], "page_id long, url string, rule string")
    got = url_rules.match_rules(table.drop("rule"), spark.createDataFrame(rules, url_rules.RULES), keep=("page_id",)).collect()
    want = []
    for i, u in enumerate(URLS + URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.lower()
        fit = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        want.append((i, host, path, best[1], best[2]))
    assert bag(got) == bag(want)


def test_fingerprints(docs):
    got = merkle.fingerprint_edits(docs).collect()
    order = sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    assert len(got) == len(ROWS)
    unique = {r[0] for r in ROWS if sum(x[0] == r[0] for x in ROWS) == 1 and r[0] is not None}
    texts = {}
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        texts[r[0]] = (len(text), hashlib.sha256((text[: len(text) - len(text) // 2] + after[: len(text) // 2]).encode()).hexdigest())
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (r["near_edited"] == 1)
        if r["doc_id"] in unique - {0}:
            assert (r["n_chars"], r["edited_sha256"]) == texts[r["doc_id"]]
    same = collections.defaultdict(set)
    for r in got:
        same[r["doc_id"]].add(r["fingerprint"])
    assert same[7] == same[8] and len(same[7]) == 1


def next_by_hand(table):
    """(doc_id, text, next text) of each row, by the order of ``with_next``."""
    order = table.withColumn("h", F.xxhash64("text")).collect()
    order.sort(key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))
    return [(r["doc_id"], r["text"], order[(k + 1) % len(order)]["text"]) for k, r in enumerate(order)]


def test_next_with_many_partitions(spark):
    """The plan stays as deep as it is, and ends, with any number of shuffle partitions."""
    table = spark.createDataFrame([(7 * k - 3000, f"text {k % 50} of {k}") for k in range(1000)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        got = merkle.with_next(table).select("doc_id", "text", "next_text").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert bag(got) == bag(next_by_hand(table))


@pytest.mark.parametrize("copies", [1, 30])
def test_next_cuts_rows_that_share_an_id(spark, monkeypatch, copies):
    """Rows without an id, or with one id, are cut into groups by bytes; rows alike in all are one row of a window."""
    for name, value in (("LEAST_BYTES", 1), ("MOST_BYTES", 1500)):
        monkeypatch.setattr(merkle, name, value)
    rows = [(k % 3 or None if k < 200 else 5 if k < 400 else -k, f"text {k} " + "x" * (k % 7)) for k in range(500)] + [(2**63 - 1, "a"), (-(2**63), "b"), (0, "")]
    table = spark.createDataFrame(rows + rows[:2] * (copies - 1), "doc_id long, text string")
    given = []
    got = merkle.with_next(table, prepare=lambda df: given.append(df) or df).select("doc_id", "text", "next_text").collect()
    assert bag(got) == bag(next_by_hand(table))
    sizes = [r["size"] for r in given[0].groupBy("group").agg(F.sum(F.octet_length("text") + merkle.ROW_BYTES).alias("size")).collect()]
    assert len(sizes) > 30 and max(sizes) < 2000 and ("alike" in given[0].columns) == (copies > 1)


def test_quality(spark, docs, empty):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    machine = quality.train(table, labels)
    scored = quality.score(table, machine).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r["score"] for r in scored if r["quality"] == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    odd = quality.score(docs, machine).collect()
    assert len(odd) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in odd)
    assert quality.accepted(docs, machine).count() == sum(r["predicted"] for r in odd)
    assert quality.train(table, labels.limit(0)) is None and quality.accepted(docs, None).count() == len(ROWS)


def test_linear_time_pairs():
    rng = np.random.default_rng(0)
    size = quality.BUCKETS + quality.RANGES * (quality.STATISTICS + 1)
    m = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, 4)))
    bounds, number, x = np.array([0, 3, 5]), np.array([5, 9, 700, 1, 2]), rng.normal(size=5)
    for k in range(2):
        i, v = number[bounds[k]: bounds[k + 1]], x[bounds[k]: bounds[k + 1]]
        want = 0.3 + (m.w[i] * v).sum() + sum(m.v[i[a]] @ m.v[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert np.isclose(m.logits(bounds, number, x)[k], want)


def test_pseudo_likelihood(spark, docs):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    words, network = lm_score.train(table)
    means = [[r["mean_logprob"] for r in lm_score.score(table, words, n).collect() if r["mean_logprob"] is not None] for n in (network, lm_score.Network.new())]
    assert np.mean(means[0]) > np.mean(means[1]) + 0.3
    context = np.random.default_rng(0).integers(0, lm_score.TOKENS, (1, 2 * lm_score.SIDE))
    every = np.arange(lm_score.TOKENS)
    assert np.isclose(np.exp(network.log_probabilities(np.repeat(context, len(every), axis=0), every)).sum(), 1, atol=1e-3)
    odd = lm_score.score(docs, words, network).collect()
    assert len(odd) == len(ROWS) and all((r["mean_logprob"] is None) == (r["n_words"] == 0) for r in odd)


def test_pseudo_likelihood_learns_from_every_position(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PACK", 16)
    texts = [" ".join(f"w{(7 * k + j) % 50}" for j in range(k)) for k in (0, 1, 2, 5, 40, 90)] + [None, "  ", "w1 w2 w3"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = lm_score.vocabulary(table)
    packs = lm_score.training_packs(table, words).collect()
    stream, places = lm_score._places([bytes(r["tokens"]) for r in packs])
    assert len(places) == sum(r["n"] for r in packs) == 141 and {r["turn"] for r in packs} <= set(range(lm_score.ROUNDS))
    token = lm_score.Tokens(words)
    want = []
    for t in texts:
        h = lm_score._word_hashes(next(lm_score.blocks(pa.RecordBatch.from_pydict({"text": pa.array([t], pa.string())}), "text")))[0]
        own = [lm_score.EDGE] * 3 + token(h).tolist() + [lm_score.EDGE] * 3
        want += [own[k: k + 7] for k in range(len(h))]
    assert sorted(stream[p - 3: p + 4].tolist() for p in places) == sorted(want)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert quality.train(empty, labels) is None
    words, network = lm_score.train(empty)
    for df in (
        quality.score(empty, None), lm_score.score(empty, words, network), simhash.near_duplicates(empty), simhash.first_of_each(empty), token_counts.token_counts(empty, COUNTS),
        packing.pack(empty, IDS, 2), repeats.remove_repeats(empty), decontaminate.contained_items(empty, items), decontaminate.without_items(empty, items),
        licenses.find_templates(empty, licenses.templates_table(spark)), merkle.fingerprint_edits(empty),
        url_rules.match_rules(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], url_rules.RULES), keep=("page_id",)),
    ):
        assert df.collect() == []


def test_pipeline_stages(spark, docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert name == "packed" or out.columns == columns
        assert out.count() >= 0
    near = corpus_pipeline.without_near_copies(spark, docs, SMALL).collect()
    keep = {c for _, _, c in classes([(r[0], fingerprint(r[1])) for r in ROWS])}
    assert sorted(r["doc_id"] for r in near if r["doc_id"] is not None) == sorted(c for c in keep if c is not None)
    kept = {r["doc_id"]: r for r in corpus_pipeline.without_repeats(spark, docs, SMALL).collect()}
    assert kept[7]["text"] == "" and kept[12]["text"] == "q" * 199 and kept[15]["text"] == ROWS[15][1]


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if re.match(r"op\d+_|pipeline", n)))
def test_registered(spark, duck, name):
    from test_registered import same

    if name in entry.oracle_sql():
        same(spark, duck, name)
    else:
        assert entry.queries()[name](spark, SMALL).count() > 0


def test_pseudo_likelihood_batches(monkeypatch):
    """A batch moves the network by the gradient of its windows, tokens together or one by one, however often a token occurs."""
    rng = np.random.default_rng(3)
    edge, side = lm_score.EDGE, lm_score.SIDE
    texts = [rng.zipf(1.3, n) % lm_score.TOKENS for n in (1, 700, 2, 300, 90)]
    stream = np.concatenate([[edge] * side, *(np.append(t, [edge] * side) for t in texts)]).astype("<u2")
    places = np.flatnonzero(stream != edge)
    around = np.delete(np.arange(-side, side + 1), side)
    context, token = stream[places[:, None] + around].astype(int), stream[places].astype(int)
    assert np.bincount(token).max() > 2 * lm_score._FEW
    for large in (lm_score.LARGE, 0.0):
        monkeypatch.setattr(lm_score, "LARGE", large)
        net, want = lm_score.Network.new(), lm_score.Network.new()
        net.learn(stream, places, 0.15)  # fewer windows than a batch has
        h = want.hidden(context)
        group, place = token // lm_score.GROUP, token % lm_score.GROUP
        parts = [h @ want.out[:, : lm_score.GROUPS] + want.group_bias, h @ want.out[:, lm_score.GROUPS:] + want.place_bias[group]]
        for z, own in zip(parts, (group, place)):
            z[:] = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            z[np.arange(len(z)), own] -= 1
            z /= len(z)
        z = np.concatenate(parts, axis=1)
        dh = (z @ want.out.T) * (1 - h * h)
        gradients = [np.zeros_like(p) for p in want.parts()]
        for k in range(2 * side):
            np.add.at(gradients[0][k], context[:, k], dh)
        gradients[1:4] = [dh.sum(axis=0), h.T @ z, parts[0].sum(axis=0)]
        np.add.at(gradients[4], group, parts[1])
        for new, old, g in zip(net.parts(), want.parts(), gradients):
            assert np.allclose(new, old - 0.15 * g / np.sqrt(1e-2 + g * g), atol=1e-5)
        assert np.allclose(net.stream_log_probabilities(net.wide(), stream), net.log_probabilities(context, token), atol=1e-5)


def test_tokens_of_words_that_share_leading_bits():
    words = np.array([5, 7, 1 << 63, (1 << 63) + 9, 1 << 40], np.uint64)
    token = lm_score.Tokens(words)
    assert token(words).tolist() == [0, 1, 2, 3, 4]
    assert (token(np.array([0, 6, 8, (1 << 63) + 1, (1 << 64) - 1], np.uint64)) >= lm_score.TOKENS - lm_score.RARE).all()


def test_pseudo_likelihood_learns_in_cheap_batches():
    """Windows are learnt from in well under the time of one lookup, sort and sum per window and position."""
    rng = np.random.default_rng(3)
    stream = np.append(rng.zipf(1.3, 60_000) % lm_score.TOKENS, [lm_score.EDGE] * 3).astype("<u2")
    seen = []
    network = lm_score.Network.new()
    network._rows = lambda table, seen_rows, rows, *rest: seen.append(rows.size)
    places = np.arange(3, 60_000)
    network.learn(stream, places, 0.15)
    assert sum(seen) < 1.2 * len(places)  # rows sorted and summed; six for each window before
