"""Operators 11, 12 and 13."""

import collections
import hashlib
import random
import re

import pytest
from llm_fixtures import CLASHING, documents, odd_rows
from pyspark.sql import functions as F

from seqdrift.llm import bpe, divergence, middle

tokenizers = pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def hexes(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Fill in the middle.


def plain_middle(doc_id, text):
    text = text or ""
    h = [int(hexes(f"1:{'' if doc_id is None else doc_id}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, mid, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{mid}"


def test_fill_in_middle(spark):
    rng = random.Random(4)
    letters = "ab<>PSM \n\r é́\U0001f600‍\x00\x1c"
    rows = [(100 + i, "".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 2, 63, 64, 65, 127, 128, 129, 300))))) for i in range(400)]
    rows += [(1000 + i, "<" * i + "S>P>") for i in range(20)] + [(2000, "x" * 200_000), (2001, "a<M>b")] + odd_rows()
    made = middle.fill_in_middle(documents(spark, rows)).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    got = collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made)
    assert got == collections.Counter((i, *plain_middle(i, t), t or "") for i, t in rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(documents(spark, [])).count() == 0


def test_units_by_block():
    text = "".join(chr(0x61 + i % 26) + ("́" if i % 7 == 0 else "") + ("\n" if i % 11 == 0 else "") for i in range(500))
    for block in (1, 2, 64, 10_000):
        units = middle.Units(block)
        n, blocks = units.of(text)
        assert n == len(text)
        assert [units.offset(blocks, n, k) for k in range(n + 1)] == list(range(n + 1))


# Byte-level BPE.


def test_words_are_encoded_alike_alone_and_in_place():
    rng = random.Random(5)
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    pieces = [" ", "  ", "\n", "\r\n", "\t", " ", " ", "\x1c", "\x85", "\x0b", "​", "᠎", "a", "B", "é", "日本", "7", "½", "'s", "'ll", "'", ".", "!?", "_", "<|endoftext|>", "<|", "|>", "\U0001f600", "́"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        words = bpe.split_words(text)
        assert "".join(words) == text
        assert [i for w in words for i in tokenizer.encode(w, add_special_tokens=False).ids] == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


#: Many chunks, buckets of few words, forgotten words, small slices.
SMALL = {"chunk_chars": 300, "bucket_words": 3, "known_words": 2, "slice_words": 5}


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_bpe_round_trip(spark, sizes):
    rng = random.Random(6)
    rows = [(100 + i, " ".join(rng.choice(("the", "tree's", "house,", "\n\nnew", "x1y2", "naïve", "<|endoftext|>", "")) for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [(500 + i, "the same text over and over") for i in range(50)] + [(600, "�\x00퟿ \U0010ffff")] + odd_rows()
    docs = documents(spark, rows)
    ids = bpe.encode_documents(docs, PATH, **sizes)
    out = bpe.decode_ids(ids.drop("decoded").withColumns({"row": F.col("doc_id"), "pos": F.size("ids"), "ids": F.col("ids")}), PATH).select("row.*", "decoded")
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    expected = []
    for i, text in rows:
        tokens = tokenizer.encode(text or "", add_special_tokens=False).ids
        expected.append((i, i, len(tokens), tokenizer.decode(tokens, skip_special_tokens=False)))
    assert collections.Counter((r.doc_id, r.row, r.pos, r.decoded) for r in out.collect()) == collections.Counter(expected)
    plain = collections.Counter((i, tuple(e := tokenizer.encode(t or "", add_special_tokens=False).ids), tokenizer.decode(e, skip_special_tokens=False)) for i, t in rows)
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in ids.collect()) == plain


def test_each_distinct_word_is_encoded_once(spark):
    import pyarrow as pa

    calls = collections.Counter()

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch(self, words, **more):
            calls.update(words)
            return self.inner.encode_batch(words, **more)

    sizes, data = zip(bpe.packed_words(["a", "b"]), bpe.packed_words(["b", "a"]), strict=True)
    rows = pa.RecordBatch.from_pydict({"bucket": [0, 0], "chunk": [1, 2], "at": [bpe.packed(bpe.np.array([0, 1]))] * 2, "word_sizes": sizes, "words": data})
    inner = bpe._tokenizer(PATH)
    kept, bpe._tokenizer = bpe._tokenizer, lambda path: Counting(inner)
    try:
        list(bpe._encode(PATH)(iter([rows, rows])))
    finally:
        bpe._tokenizer = kept
    assert calls == {"a": 1, "b": 1}


def test_decode_odd_ids(spark):
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    cases = {1: [], 2: None, 3: [50256, 10, 50256], 4: [255, 254, 253, 0], 5: [99_999, 64], 6: list(range(188, 256)), 7: [64] * 30_000}
    df = spark.createDataFrame(list(cases.items()), "k int, ids array<int>")
    got = {r.row.k: r.decoded for r in bpe.decode_ids(df, PATH).collect()}
    assert got == {k: tokenizer.decode(v or [], skip_special_tokens=False) for k, v in cases.items()}
    assert bpe.encode_documents(documents(spark, []), PATH).count() == 0


# Divergence of sources.


def plain_divergence(rows, min_docs, top):
    rows = [((t or ""), (lang or ""), (s or "")) for t, lang, s in rows]
    split = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        terms = split.findall(text.translate(fold))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    gap = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in {r[1] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = {s: c for (g, s), c in counts.items() if g == lang}

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(sum(groups.values(), collections.Counter()))
        for s in groups:
            pair = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            term = [(gap(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(found, 1) if part == "pair" or r <= top]
    return collections.Counter(out)


def table_of(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(3) for c in (*CLASHING, "term", "docs", "g", "p", "a", "b", "part", "value", "kept")})


@pytest.mark.parametrize("tile", [(4096, 64), (3, 4)])
def test_divergence(spark, tile):
    rng = random.Random(7)
    rows = []
    for i in range(700):
        lang, source = rng.choice("xyz"), f"s{min(rng.randrange(30), rng.randrange(30))}"
        rare = [f"rare{chr(97 + rng.randrange(9))}{source}", f"pair{chr(97 + int(source[1:]) % 7)}"]
        words = [rng.choice(("The", "OF", "été", "ÉTÉ", "and")) for _ in range(rng.randrange(9))] + rare * rng.randrange(3)
        rows.append((rng.choice(" -1_\n").join(words), lang, source))
    rows += [("the the", None, None), (None, "x", "s1"), (None, "empty", "a"), ("", "empty", "b"), ("one", "lone", "a"), ("the " * 5000, "x", "s2"), ("� \U0001f600 é", "x", "\U0001f600")]
    rows += [("the of", "x", "hot")] * 300
    got = divergence.source_divergence(table_of(spark, rows), 4, 3, *tile)
    assert collections.Counter(tuple(r) for r in got.collect()) == plain_divergence(rows, 4, 3)
    assert divergence.source_divergence(table_of(spark, [])).count() == 0


def test_both_kinds_of_terms_matter(spark, monkeypatch):
    """Each partial sum has a share in the result: a language with terms that all, few or single groups have."""
    rows = [(f"all{'' if g % 2 else ' all'} some{'abc'[g % 3]} own{chr(97 + g)} " * (g + 1), "x", f"s{g}") for g in range(20) for _ in range(3)]
    expected = plain_divergence(rows, 3, 5)
    assert collections.Counter(tuple(r) for r in divergence.source_divergence(table_of(spark, rows), 3, 5).collect()) == expected
    nothing = lambda key, terms, constants: divergence.pd.DataFrame({"lang": [], "a": [], "b": [], "part": []}).astype({"lang": object, "a": "int64", "b": "int64", "part": "int64"})
    monkeypatch.setattr(divergence, "_dense", lambda groups: nothing)
    assert collections.Counter(tuple(r) for r in divergence.source_divergence(table_of(spark, rows), 3, 5).collect()) != expected


def test_shares_of_large_counts(spark):
    big = 7 * 10**15
    row = spark.range(1).select(divergence.share(F.lit(big), F.lit(3 * big), F.lit(10**9)).alias("p"), divergence.share(0, F.lit(0), F.lit(0)).alias("none")).first()
    assert row.p == 1 + 10**9 * (big + 2) // (3 * big + 2 * 10**9) and row.none == 1
