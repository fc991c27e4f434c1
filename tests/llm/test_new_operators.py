"""Mixing, token alignment and spelling variants against brute force, with the awkward cases each of them defines."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import __spark_entry__ as entry  # noqa: E402
from conftest import SMALL  # noqa: E402
from featherloom.llm import alignment, mixing, repeats, variants  # noqa: E402
from featherloom.session import BROADCAST_ROWS, GROUP_ROWS  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, cell string, size long, count long"
PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def full(rows):
    """(doc_id, text, source) with columns whose names the operators use themselves."""
    return [(i, t, "en", s, None, "x", "0", 7, 1) for i, t, s in rows]


def small_documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]


# Mixing


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shared_out(sizes, repeat=3):
    """Targets by sharing the excess again until none is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] >= repeat * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: float(repeat * sizes[s]) for s in above}
        rest -= sum(repeat * sizes[s] for s in above)
        open_ -= above
    return target


def highest_quotients(parts, wanted):
    """Sainte-Laguë one seat at a time: {part: (votes, cap)}."""
    seats = dict.fromkeys(parts, 0)
    for _ in range(wanted):
        open_ = [p for p, (votes, cap) in parts.items() if seats[p] < cap and votes > 0]
        if not open_:
            break
        best = min(open_, key=lambda p: (-parts[p][0] / (2 * seats[p] + 1), p))
        seats[best] += 1
    return seats


@pytest.mark.parametrize("seed", range(3))
def test_apportion(spark, seed):
    rng = random.Random(seed)
    groups = {}
    for g in range(8):
        parts = {p: (rng.choice([0, 1, 5, 5, 40, 1000, rng.randrange(1, 10**6)]), rng.choice([1, 3, 50, 10**6])) for p in range(rng.choice([1, 2, 9, 40]))}
        groups[g] = (parts, rng.choice([0, 1, 7, 60, 400]))
    rows = [(g, p, float(v), c, wanted) for g, (parts, wanted) in groups.items() for p, (v, c) in parts.items()]
    got = mixing.apportion(spark.createDataFrame(rows, "g int, part int, votes double, cap long, wanted long"), ["g"], "part").collect()
    want = {(g, p): n for g, (parts, wanted) in groups.items() for p, n in highest_quotients(parts, wanted).items()}
    assert {(r["g"], r["part"]): r["seats"] for r in got} == want


MIX_TEXTS = [None, "", " \n", "one", "two words"] + [f"w{i} " * (5 + 13 * i) for i in range(60)]


def mix_rows():
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["a", "b", "B", "é", None, "tiny-never"][:5])) for i, t in enumerate(MIX_TEXTS * 6)]
    rows += [(None, "no id but text " * 40, "a")] * 30 + [(1, "shared id", "b"), (1, "shared id", "b"), (5000, "small source of nine words in all its text", "tiny"), (5001, None, "empty source")]
    return rows


@pytest.mark.parametrize("large", [False, True])
def test_mix(spark, large):
    rows = mix_rows()
    docs = spark.createDataFrame(full(rows), SCHEMA)
    if large:
        spark.conf.set(GROUP_ROWS[0], "40")
        spark.conf.set(BROADCAST_ROWS[0], "1")
    try:
        got = mixing.mix(docs, shard_words=600).collect()
    finally:
        spark.conf.unset(GROUP_ROWS[0])
        spark.conf.unset(BROADCAST_ROWS[0])
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words_of(t))
    want = shared_out(sizes)
    assert collections.Counter((r["doc_id"], r["source"], r["size"], r["source_size"]) for r in got) == collections.Counter((i, s, len(words_of(t)), sizes[s]) for i, t, s in rows)
    taken = collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        # Half a block of the quota, and the short last block of each shard.
        assert abs(taken[s] - t) <= 16 + 3 * 16 * (1 + sizes[s] / 300), s
    again = mixing.mix(docs.repartition(5), shard_words=600).collect()
    assert large or collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, got))


def test_mixed_texts(spark):
    rows = mix_rows()
    docs = spark.createDataFrame(full(rows), SCHEMA)
    parts = mixing.mixed_texts(docs, shard_words=600).collect()
    taken = collections.Counter()
    texts = collections.defaultdict(set)
    for i, t, s in rows:
        texts[i, s].add(tuple(words_of(t)))
    for r in parts:
        taken[r["doc_id"], r["source"]] += r["n_words"] * r["copies"]
        own = tuple(r["text"].split(" "))
        assert len(own) == r["n_words"] and any(t[r["first_word"]: r["first_word"] + r["n_words"]] == own for t in texts[r["doc_id"], r["source"]])
    want = collections.Counter()
    for r in mixing.mix(docs, shard_words=600).collect():
        want[r["doc_id"], r["source"]] += r["taken"]
    assert +taken == +want


def test_mix_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    none = mixing.mix(spark.createDataFrame(full([(1, None, "a"), (2, "", None)]), SCHEMA)).collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in none) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


# Alignment


def library_tokens(text, a, b, letters):
    """(id, first byte, end) of both sides, nothing where joined bytes differ."""
    if not text:
        return [], []
    e = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(letters[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (left, right)):
        return [], []
    out = []
    for side in (left, right):
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out[0], out[1]


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    letters = alignment._byte_letters()
    found, held = [], collections.Counter()
    for t in texts:
        left, right = library_tokens(t, a, b, letters)
        links = [(i, k) for i, s, e in left for k, s2, e2 in right if s < e2 and s2 < e] if len(left) * len(right) < 4_000_000 else None
        if links is None:
            links, j = [], 0
            for i, s, e in left:
                while right[j][2] <= s:
                    j += 1
                m = j
                while m < len(right) and right[m][1] < e:
                    links.append((i, right[m][0]))
                    m += 1
        groups, x, y = [], [], []
        both = {e for *_, e in left} & {e for *_, e in right}
        merged = sorted([(e, 0, i) for i, _, e in left] + [(e, 1, i) for i, _, e in right])
        for n, (e, side, i) in enumerate(merged):
            (y if side else x).append(str(i))
            if e in both and (n + 1 == len(merged) or merged[n + 1][0] != e):
                groups.append(",".join(x) + "|" + ",".join(y))
                x, y = [], []
        found.append((len(left), len(right), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""))
        held.update(set(links))
    most = collections.defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return [(*f[:3], len(f[3]), sum(held[p] == most[p[0]] for p in f[3]), sum(held[p] for p in f[3]), f[4]) for f in found]


ODD_TEXTS = [None, "", " ", "  a", "a  ", "\n\n", "😀é①ﬁ", "a▁b", "x　y 日本語 テスト", "<|endoftext|> <s> </s> <unk>", "don't  stop\t\tnow", "a" * 300, "é" * 70 + " " + "ñ" * 5,
             "\x00 \x1c a", "①②③ ①", "👩‍👩‍👧 family ﷽ ", "one two\n three " * 400, "x" * 5000 + " tail", " nb sp ​zero"]


@pytest.mark.parametrize("frequent", [1 << 18, 60, 0])
def test_aligned_corpus(spark, frequent):
    rows = small_documents(spark)[:60] + [(10_000 + i, t, "s") for i, t in enumerate(ODD_TEXTS)] + [(None, "no id", None), (10_000, "same id twice", "s"), (10_003, "  a", "s")]
    docs = spark.createDataFrame(full(rows), SCHEMA)
    got = alignment.align_corpus(docs, PATH_A, PATH_B, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute_alignment([t for _, t, _ in rows])
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter((i, *w) for (i, _, _), w in zip(rows, want))
    assert alignment.align_corpus(spark.createDataFrame([], SCHEMA), PATH_A, PATH_B).collect() == []


def test_alignment_in_stretches_and_with_little_memory(monkeypatch):
    rng = random.Random(3)
    words = ["plain", "é😀", "①", "naïve", "x" * 90, "日本", "don't", "\t", ""] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=2000)) for _ in range(6)]
    whole = alignment._aligned(texts, alignment.Units(alignment.Aligner(PATH_A, PATH_B)))
    monkeypatch.setattr(alignment, "STRETCH", 700)
    small = alignment.Units(alignment.Aligner(PATH_A, PATH_B), memory=20_000)
    for text, want in zip(texts, whole):
        (cut,) = alignment._aligned([text], small)
        assert cut[:5] == want[:5] and all(np.array_equal(x, y) for x, y in zip(cut[5:], want[5:]))
    assert small.size < 200_000


def test_spans_and_refinement():
    found = alignment.Aligner(PATH_A, PATH_B).align("é😀 ①")
    assert found.a.ends.tolist()[-1] == found.b.ends.tolist()[-1] == len(" é😀 ①".encode())
    data = " é😀 ①".encode()
    inside = [e for e in found.a.ends.tolist() + found.b.ends.tolist() if e < len(data) and data[e] & 0xC0 == 0x80]
    assert inside  # some tokens end inside a character
    assert set(found.cuts.tolist()) == set(found.a.ends.tolist()) & set(found.b.ends.tolist())


# Spelling variants


def brute_variants(rows, at_least=3):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    n = collections.Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= at_least}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    by_length = collections.defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    near = {w: [x for d in (-1, 0, 1) for x in by_length[len(w) + d] if x != w and one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), None if form[w] is None else n[form[w]]) for w in n}


def variant_rows(seed=8):
    rng = random.Random(seed)
    base = ["colour", "neighbour", "aaaaa", "aaaaaa", "aaaaaaa", "abcde", "edcba", "éàüñç", "straße", "×÷×÷×"] + ["".join(rng.choices("abcdeé", k=rng.randrange(5, 9))) for _ in range(150)]
    words = list(base)
    for w in base:
        for _ in range(3):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abcdez") + w[i:], w[:i] + rng.choice("abcdez") + w[i + 1:], w[:i] + w[i:i + 2][::-1] + w[i + 2:]]))
    rows = []
    for d in range(120):
        picked = rng.choices(words, [1 / (1 + i % 37) for i in range(len(words))], k=60)
        rows.append((d if d % 9 else None, "Ünlikely-MIXED ".join(w.upper() if rng.random() < 0.1 else w for w in picked) + " " + " ".join(picked) + "\n1,2 x"))
    return rows + [(500, None), (501, ""), (502, "b" * 30_000), (502, "b" * 30_000), (503, "b" * 30_000), (503, "b" * 29_999 + "c " + "b" * 29_999 + "c b"), (504, "b" * 29_999 + "c")]


@pytest.mark.parametrize("box", [20_000, 25])
def test_spelling_variants(spark, box, monkeypatch):
    rows = variant_rows()
    docs = spark.createDataFrame(full([(i, t, "s") for i, t in rows]), SCHEMA)
    got = variants.spelling_variants(docs, box)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == brute_variants(rows)
    assert variants.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tree_with_small_leaves(monkeypatch):
    monkeypatch.setattr(variants, "LEAF", 2)
    monkeypatch.setattr(variants, "PAIRS", 128)
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abcaé", k=6)) for _ in range(700)})
    longer = sorted({w[:i] + rng.choice("abz") + w[i:] for w in words[:200] for i in (0, 3, 6)})
    tree = variants.Tree(words, np.ones(len(words)))
    found = {(words[i], words[k]) for a, b in tree.near(words, False) for i, k in zip(a, b)}
    assert {frozenset(p) for p in found} == {frozenset((a, b)) for a in words for b in words if sum(x != y for x, y in zip(a, b)) == 1}
    assert len(found) * 2 == len({*found, *((b, a) for a, b in found)})
    tree = variants.Tree(longer, np.ones(len(longer)))
    found = {(words[i], longer[k]) for a, b in tree.near(words, True) for i, k in zip(a, b)}
    assert found == {(a, b) for b in longer for i in range(7) for a in [b[:i] + b[i + 1:]] if a in set(words)}


@pytest.mark.parametrize("name", ["op11_source_mix", "op12_aligned_tokens", "op13_spelling_variants"])
def test_registered(spark, name):
    rows = small_documents(spark)
    got = entry.queries()[name](spark, SMALL)
    if name == "op13_spelling_variants":
        assert {tuple(r) for r in got.collect()} == brute_variants([(i, t) for i, t, _ in rows])
    else:
        assert collections.Counter(r["doc_id"] for r in got.collect()) == collections.Counter(i for i, _, _ in rows)


# Faults found in earlier operators


def test_repeats_of_rows_without_id_and_equal_hash(spark):
    """Two texts without an id whose 32-bit hashes are equal; one of them has a copy, the other is unique."""
    from pyspark.sql import functions as F

    from featherloom.llm import repeats

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.md5(F.concat_ws("-", "id", i))), "")
    made = spark.range(200_000).select(text.alias("text"))
    pair = made.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("texts")).filter("size(texts) > 1").first()["texts"]
    docs = spark.createDataFrame([(None, pair[0]), (None, pair[1]), (5, pair[0])], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in repeats.remove_repeats(docs).collect())
    none = hashlib.sha256(b"").hexdigest()
    assert got == {(None, 320, 320, none): 1, (5, 320, 320, none): 1, (None, 320, 0, hashlib.sha256(pair[1].encode()).hexdigest()): 1}


def test_columns_with_names_of_helpers_stay(spark):
    from featherloom.llm import quality, simhash

    rows = [(1, "a text of a few words here", 3, 4, 5, 6), (2, "quite another text with other words", 7, 8, 9, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `rank` int, _rank int, given int, _given int")
    kept = simhash.first_of_each(docs, threshold=0.8)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == rows
    kept = quality.accepted(docs, None)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == rows


def test_contexts_are_found_in_little_memory():
    """About thirty times the bytes of a block of 256 KB, whatever a batch of texts has."""
    rng = np.random.default_rng(0)
    texts = pa.array(["".join(map(chr, rng.integers(97, 123, 4000))) for _ in range(1000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))] * 2 + [texts], ["id", "part", "text"])

    class Texts:
        def mapInArrow(self, run, schema):
            return run(iter([batch]))

    sum(b.num_rows for b in repeats._find_contexts(Texts(), 200))
    tracemalloc.start()
    assert sum(b.num_rows for b in repeats._find_contexts(Texts(), 200)) > 1000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20
