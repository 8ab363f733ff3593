"""Operators 1, 3, 4, 8 and 10 against plain restatements."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from llm_fixtures import documents, odd_rows, words
from pyspark.sql.functions import lit

from seqdrift.llm.decontaminate import find_leaks
from seqdrift.llm.jaccard import jaccard_components
from seqdrift.llm.linedup import drop_repeated_lines
from seqdrift.llm.merkle import fingerprint_documents
from seqdrift.llm.rlz import remove_duplicate_substrings
from seqdrift.llm.sharding import shard_by_bytes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut_words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def brute_substrings(rows, width):
    split = [cut_words(t) for _, t in rows]
    count = collections.Counter(tuple(w[p : p + width]) for w in split for p in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if count[tuple(w[p : p + width])] > 1:
                gone[p : p + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def planted_rows(seed, n=60):
    rng = random.Random(seed)
    passages = [words(rng, rng.randrange(8, 60)) for _ in range(4)]
    rows = []
    for i in range(n):
        body = words(rng, rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = rng.choice(passages)
        if rows and rng.random() < 0.3:
            body = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(3)):
                if body:
                    body[rng.randrange(len(body))] = "Edited"
        rows.append((i, rng.choice([" ", "\n", "  "]).join(body)))
    return rows


def collected(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


@pytest.mark.parametrize("rows", [planted_rows(1), planted_rows(2), odd_rows()], ids=["planted", "planted2", "odd"])
def test_substrings(spark, rows):
    got = remove_duplicate_substrings(documents(spark, rows), width=12, gram=4)
    assert collected(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(map(repr, brute_substrings(rows, 12)))


def test_factors_against_a_plain_greedy_parser(spark):
    """Factor lengths and sources, from the phrases' cuts and a plain index of each phrase's first and last place."""
    import pyarrow as pa

    from seqdrift.llm import rlz
    from seqdrift.llm.text import words_of

    width, gram = 12, 4
    rows = planted_rows(7, 80)
    split = {i: cut_words(t) for i, t in rows}
    hashes = {r.doc_id: r.h & -(1 << 24) for r in documents(spark, rows).selectExpr("doc_id", "xxhash64(doc_id, xxhash64(text)) AS h").collect()}
    cut, places = {}, collections.defaultdict(list)
    for i, t in rows:
        w = next(words_of(pa.array([t])), None)
        cut[i] = [(int(lo), int(hi)) for _, lo, hi, _, _ in zip(*rlz.phrases(w, width, gram), strict=True)] if w else []
        for lo, hi in cut[i]:
            places[tuple(split[i][lo : hi + width])].append((hashes[i] | lo, i, lo))

    def others(i, p):
        lo, hi = p
        own = sorted(places[tuple(split[i][lo : hi + width])])
        return [x[1:] for x in (own[0], own[-1]) if x[1:] != (i, lo)] if len(own) > 1 else []

    def grow(i, at, place):
        """Phrases from number ``at`` on that have a place side by side with ``place``."""
        size = 1
        while at + size < len(cut[i]) and cut[i][at + size][0] == cut[i][at + size - 1][1] + 1 and (place[0], place[1] + cut[i][at + size][0] - cut[i][at][0]) in others(i, cut[i][at + size]):
            size += 1
        return size

    want = {}
    for i in split:
        at, want[i] = 0, []
        while at < len(cut[i]):
            found = max(((grow(i, at, p), -c, p) for c, p in enumerate(others(i, cut[i][at]))), default=None, key=lambda x: x[:2])
            if found:
                want[i].append((cut[i][at][0], cut[i][at + found[0] - 1][1] + width - cut[i][at][0], *found[2]))
            at += found[0] if found else 1
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in rlz.remove_duplicate_substrings(documents(spark, rows), width, gram).collect()}
    assert got == want and sum(map(len, got.values())) > 20
    assert max(n for fs in got.values() for _, n, _, _ in fs) > 2 * width
    for i, fs in got.items():
        for start, n, s, q in fs:
            assert n >= width and split[i][start : start + n] == split[s][q : q + n]


def thue_morse(letters, swap=False):
    bits = "0"
    while len(bits) < letters:
        bits += bits.translate(str.maketrans("01", "10"))
    return bits.translate(str.maketrans("01", "ba" if swap else "ab"))


@pytest.mark.parametrize("letters", [1024, 2048])
def test_long_words_of_repeated_patterns(spark, letters):
    """Words that meet under every polynomial hash modulo 2^64 are told apart."""
    rows = [(i, " ".join([thue_morse(letters, i % 2)] * 14)) for i in range(2)] + [(i + 2, thue_morse(letters, i % 2)) for i in range(2)]
    got = remove_duplicate_substrings(documents(spark, rows), width=12, gram=4)
    assert collected(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(map(repr, brute_substrings(rows, 12)))
    got = jaccard_components(documents(spark, rows), shingle=3, percent=90)
    assert collected(got, "doc_id", "n_shingles", "component_id", "n_links") == sorted(map(repr, brute_jaccard(rows, 3, 90)))
    benchmark = spark.createDataFrame([(1, rows[0][1]), (2, rows[3][1])], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(documents(spark, rows), benchmark).collect()) == [(0, 1), (1, 2), (3, 2)]


def brute_jaccard(rows, size, percent):
    sets = []
    for i, t in rows:
        w = cut_words((t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[top(a)] = top(b)
                links[a] += 1
                links[b] += 1
    least = collections.defaultdict(list)
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[top(a)].append(i)
    return [(i, len(s), (min(least[top(a)]) if least[top(a)] else None) if s else i, links[a]) for a, (i, s) in enumerate(sets)]


@pytest.mark.parametrize("rows", [planted_rows(3), planted_rows(4, 150), odd_rows()], ids=["planted", "many", "odd"])
@pytest.mark.parametrize("percent", [60, 90])
def test_jaccard(spark, rows, percent):
    got = jaccard_components(documents(spark, rows), shingle=3, percent=percent)
    assert collected(got, "doc_id", "n_shingles", "component_id", "n_links") == sorted(map(repr, brute_jaccard(rows, 3, percent)))


def test_jaccard_blocks(spark, monkeypatch):
    """A large group of near copies is cut into many block pairs and loses no link."""
    from seqdrift.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 300)
    rng = random.Random(5)
    base = words(rng, 60, 5000)
    rows = []
    for i in range(90):
        body = list(base)
        for _ in range(rng.randrange(4)):
            body[rng.randrange(60)] = f"e{rng.randrange(9)}"
        rows.append((i, " ".join(body)))
    got = jaccard.jaccard_components(documents(spark, rows), shingle=3, percent=90)
    assert collected(got, "doc_id", "n_shingles", "component_id", "n_links") == sorted(map(repr, brute_jaccard(rows, 3, 90)))


def join_rows(spark, after):
    """The most rows that a join has made in the executions after the first ``after``."""
    store = spark._jsparkSession.sharedState().statusStore()
    executions, most = store.executionsList(), 0
    for i in range(after, executions.size()):
        number = executions.apply(i).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            metrics = [node.metrics().apply(j) for j in range(node.metrics().size())]
            for m in metrics:
                if "Join" in node.name() and m.name() == "number of output rows" and (found := values.get(m.accumulatorId())).isDefined():
                    most = max(most, int(found.get().replace(",", "")))
    return most


def test_jaccard_hot_tokens(spark, monkeypatch):
    """Classes that share many hot tokens over many blocks: each two with a common token meet once, and no join makes a
    row for each token and block."""
    from seqdrift.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 8)
    rng = random.Random(8)
    # One in four lacks the hottest tokens and lives elsewhere; pairs share a rare token across cells and blocks.
    prefixes = [(i, 50, [*range(1 if i % 4 else 7, 13), 100 + rng.randrange(150)]) for i in range(400)]
    prefixes += [(i, 50, [100 + rng.randrange(150), 300 + i % 5, 500 + i]) for i in range(400, 440)]
    df = spark.createDataFrame(prefixes, "node long, n int, prefix array<long>")
    before = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    units = collections.defaultdict(lambda: ([], []))
    for r in jaccard._units(df).collect():
        units[r.cell, r.sub, r.part][r.visits].append(r.node)
    assert join_rows(spark, before) < 3 * sum(len(p) for _, _, p in prefixes)
    met = collections.Counter()
    for (_, _, part), (stay, visit) in units.items():
        assert len(stay) <= 40 and len(visit) <= 40
        met.update(tuple(sorted((a, b))) for a in stay for b in visit)
        if part == 0:
            met.update((a, b) for a in stay for b in stay if a < b)
    sets = {i: set(p) for i, _, p in prefixes}
    assert max(met.values()) == 1
    assert all((a, b) in met for a in sets for b in sets if a < b and sets[a] & sets[b])


@pytest.mark.parametrize("rows", [odd_rows(), [(i, "x" * (i * 37 % 91)) for i in range(300)]], ids=["odd", "many"])
def test_shards(spark, rows):
    got = shard_by_bytes(documents(spark, rows), n_shards=7).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append((r.slot, -1 if r.doc_id is None else r.doc_id, r.size))
    last = -1
    for shard in sorted(slots):
        own = sorted(slots[shard])
        assert [s for s, _, _ in own] == list(range(len(own)))
        ids = [i for _, i, _ in own]
        assert ids == sorted(ids) and ids[0] >= last
        last = ids[-1]
    total, biggest = sum(r.size for r in got), max(r.size for r in got)
    for own in slots.values():
        assert abs(sum(s for _, _, s in own) - total / 7) <= biggest or len(slots) < 7


def test_shards_are_prefix_sums(spark, monkeypatch):
    """Shard and slot against a plain running sum; equal rows are many, and are written out in blocks."""
    from seqdrift.llm import common

    monkeypatch.setattr(common, "COPIES", 4)
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(40)]), rng.choice(["", "é" * 9, "abc", None, "z" * 70])) for _ in range(400)]
    got = shard_by_bytes(documents(spark, rows), n_shards=7)
    sized = sorted(((i is not None, i or 0), len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), i) for i, t in rows)
    total, at, want, slots = sum(s for _, s, _, _ in sized), 0, [], collections.Counter()
    for _, size, crc, i in sized:
        shard = min(6, (2 * at + size) * 7 // (2 * total))
        want.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
        at += size
    assert collected(got, "doc_id", "size", "text_crc32", "shard", "slot") == sorted(map(repr, want))


@pytest.mark.parametrize("rows", [[(3, "abcdef" * 30), (1, "ghi\njkl\n\nmno"), (9, ""), (5, "é" * 100)], [(4, "alone with words")]], ids=["few", "one"])
def test_merkle(spark, rows):
    got = {r.doc_id: r for r in fingerprint_documents(documents(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    for at, (i, t) in enumerate(order):
        nxt = order[(at + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (edited == t)
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1


def plain_fingerprint(text):
    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    leaves, sections = [], []
    for section in text.split("\n\n"):
        paragraphs = []
        for line in section.split("\n"):
            own = [sha(line[i : i + 32]) for i in range(0, len(line), 32)]
            leaves += [x[:8] for x in own]
            paragraphs.append(sha(",".join(own)))
        sections.append(sha(",".join(paragraphs)))
    return f"{sha(','.join(sections))}/{','.join(x[:16] for x in sections)}/{'.'.join(leaves)}", set(leaves)


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    return 2 * len(a[1] & b[1]) / (len(a[1]) + len(b[1])) if a[1] or b[1] else 0.0


def test_merkle_against_a_plain_tree(spark):
    """Every column, with repeated rows and ranges of a few rows."""
    rng = random.Random(8)
    rows = [(i * 3, "\n".join(" ".join(words(rng, 9)) for _ in range(rng.randrange(6)))) for i in range(80)]
    rows += [(300, "a\n\nb\n" + "😀é" * 40), (301, rows[5][1]), (302, ""), (303, None), (None, "no id"), (303, None), (304, "same"), (304, "same")]
    got = fingerprint_documents(documents(spark, rows)).collect()
    order = sorted({(i is not None, i or 0, t or "") for i, t in rows}, reverse=True)
    want = []
    for at, (known, i, t) in enumerate(order):
        nxt = order[(at + 1) % len(order)][2]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        a, b, c = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(nxt)
        row = (i if known else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), a[0], b[0], plain_likeness(a, b), plain_likeness(a, c))
        want += [row] * sum((j is not None, j or 0, u or "") == (known, i, t) for j, u in rows)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(r.near_edited for r in got) > 2 * sum(r.near_next for r in got)


def test_merkle_odd(spark):
    got = fingerprint_documents(documents(spark, odd_rows())).collect()
    assert len(got) == len(odd_rows())
    assert len({r.fingerprint for r in got if r.n_chars == 0}) == 1


def brute_lines(rows, k):
    distinct = sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0]))
    seen, gone = set(), collections.defaultdict(set)
    for i, t in distinct:
        lines = t.split("\n")
        for p in range(len(lines) - k + 1):
            run = tuple(lines[p : p + k])
            if run in seen:
                gone[i, t] |= set(range(p, p + k))
            seen.add(run)
    return [(i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i, t])) for i, t in rows]


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_lines(spark, k):
    rng = random.Random(k)
    rows = [(i, "\n".join(f"line {rng.randrange(6)}" for _ in range(rng.randrange(9)))) for i in range(40)]
    got = drop_repeated_lines(documents(spark, rows), min_lines=k)
    assert collected(got, "doc_id", "text") == sorted(map(repr, brute_lines(rows, k)))
    assert set(got.columns) >= {"k", "h", "source", "n_lines", "n_removed"}


def test_long_single_lines(spark, tmp_path):
    """A repeated line of over 50 words goes whatever stands beside it; one of 50 words needs a repeated neighbour."""
    import corpus_pipeline

    long, short = " ".join(f"w{i}" for i in range(51)), "  ".join(f"v{i}" for i in range(50))
    rows = [(1, f"a\n{long}\nb\n{short}"), (2, f"c\n{long}\nd"), (3, f"{short}\ne"), (4, long), (5, f"{long}\n{long}\nf"), (None, f"{short}\ng"), (6, f"a\n{long}\nh")]
    want = [(None, f"{short}\ng"), (1, f"a\n{long}\nb\n{short}"), (2, "c\nd"), (3, f"{short}\ne"), (4, ""), (5, "f"), (6, "h")]
    assert collected(drop_repeated_lines(documents(spark, rows)), "doc_id", "text") == sorted(map(repr, want))
    staged = corpus_pipeline.lines(spark, documents(spark, rows, extra=False), str(tmp_path))
    assert collected(staged, "doc_id", "text", "n_chars") == sorted(repr((i, t, len(t))) for i, t in want if t)


def test_line_runs_are_maximal(spark):
    """Every run equals its source; the longest of a document is over half of what a plain search finds, or all of it."""
    from seqdrift.llm.linedup import later_runs

    rng = random.Random(11)
    block = [f"b{i}" for i in range(23)]
    texts = [[f"l{rng.randrange(8)}" for _ in range(rng.randrange(12))] for _ in range(15)]
    texts += [[*texts[3], *block, "x"], ["y", *block[2:], "z"], [*block, *block], ["same"] * 40]
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    of = {i: t.split("\n") for i, t in rows}
    runs = [(r.k, r.pos, r.size, r.source.k, r.source.pos) for r in later_runs(documents(spark, rows), 2).collect()]
    covered = collections.defaultdict(set)
    for d, p, n, s, q in runs:
        assert (s, q) < (d, p) and n >= 2 and of[d][p : p + n] == of[s][q : q + n]
        covered[d] |= set(range(p, p + n))
    longest = {}
    for d in of:
        for p in range(len(of[d])):
            for s in range(d + 1):
                for q in range(len(of[s]) if s < d else p):
                    n = 0
                    while p + n < len(of[d]) and q + n < len(of[s]) and of[d][p + n] == of[s][q + n]:
                        n += 1
                    longest[d] = max(longest.get(d, 0), n if n >= 2 else 0)
    for d, n in longest.items():
        mine = [r[2] for r in runs if r[0] == d]
        assert max(mine, default=0) == n or 2 * max(mine, default=0) > n, d
    assert max(n for d, _, n, _, _ in runs if d == 16) == 21


def test_lines_clashing_names(spark):
    docs = documents(spark, [(1, "a\nb"), (2, "a\nb\nc")], extra=False)
    docs = docs.select("*", *[lit(7).alias(c) for c in ("_bits", "_k", "_h", "_gone", "n_lines", "n_removed", "row")])
    got = drop_repeated_lines(docs)
    assert got.columns == [*docs.columns, "n_lines_", "n_removed_", "longest_run"]
    assert [tuple(r) for r in got.select("text", "n_lines", "_gone", "row", "n_removed_", "longest_run").orderBy("doc_id").collect()] == [("a\nb", 7, 7, 7, 0, 0), ("c", 7, 7, 7, 2, 2)]


def test_lines_odd(spark):
    rows = [(1, None), (2, ""), (3, "a\nb"), (3, "a\nb"), (4, "a\nb"), (5, "\n\n"), (None, "a\nb"), (6, "\n".join(map(str, range(30_000))))]
    got = sorted(((r.doc_id, r.text) for r in drop_repeated_lines(documents(spark, rows)).collect()), key=repr)
    assert (None, "a\nb") in got and got.count((3, "")) == 2 and (4, "") in got and (1, None) in got and (2, "") in got and len(got) == len(rows)


@pytest.mark.parametrize("operator", [remove_duplicate_substrings, jaccard_components, shard_by_bytes, fingerprint_documents, drop_repeated_lines])
def test_empty_tables(spark, operator):
    assert operator(documents(spark, [])).collect() == []
