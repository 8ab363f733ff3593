"""Operators 2, 5, 6, 7 and 9, and the pipeline."""

import collections
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import documents, odd_rows, words
from pyspark.sql import functions as F

from seqdrift.llm import decontaminate, hyperlang, packing, pii, toolchat

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")

# Personal data.

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [("email", *m.span()) for m in _EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_fuzz():
    rng = random.Random(1)
    pieces = ["a@b.c", "@", ".", "12", "+1", "4111 1111-1111 1111", " ", "1.2.3.4", "-", "(5)", "x", "300.1.1.1", "%", "é"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert pii.base_spans(text) == plain_spans(text), text


def _crf_texts(copies):
    """Marked mentions, each given again in every fourth text if ``copies``; card numbers and numbers that are no card."""
    rng, texts = random.Random(3), []

    def digits(k):
        return "".join(rng.choice("0123456789") for _ in range(k))

    for i in range(400):
        number = f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        long = digits(15)
        card = next(long + c for c in "0123456789" if pii.luhn(long + c) == (i % 2 == 0))
        token = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        own = [f"+1 {number}", f"10.0.{rng.randrange(255)}.1", f"{('mail', 'see')[i % 2]} a{i}.b@mail.example.com", card, digits(10), f'token = "{token}"']
        own += own if copies and i % 4 == 0 else []
        rng.shuffle(own)
        texts.append(" one two three four ".join(own))
    return texts


def _fitted(texts):
    counts = collections.Counter()
    for text in texts:
        counts.update(pii.count_evidence(text))
    return pii.SkipChain(counts)


@pytest.fixture(scope="module")
def crf():
    return _fitted(_crf_texts(True))


def test_skip_edges_carry_labels(crf):
    base, added = crf.label("Call +1 (864) 555-2588 now. Later (864) 555-2588 again, or 864-555-2588.")
    assert base == [("phone", 5, 22)] and [k for k, _, _ in added] == ["phone", "phone"]
    base, added = crf.label("mail a.bc@mail.example.com; write a.bc at mail dot example dot com")
    assert base == [("email", 5, 26)] and added == [("email", 34, 66)]
    assert crf.label("nothing here but 2024-05-06 and 12:30 and 1,000,000") == ([], [])


def test_learned_without_the_mark(crf):
    """Texts in which no exact pattern matches anything."""
    token = "186661156f3f9905942d70850a01cbf23a20abcd"
    assert crf.label(f'x {token} y token = "{token}"')[1] == [("secret", 2, 42), ("secret", 54, 94)]
    assert crf.label("write jane (at) example (dot) org today")[1] == [("email", 6, 33)]
    assert [k for k, _, _ in crf.label("ring (864) 555-2588 today")[1]] == ["phone"]
    assert crf.label("order 1234567890 and 9876543210 shipped") == ([], [])


def test_skip_factor_is_learned(crf):
    """Agreement is likelier than disagreement for every label, from real copies only: texts that repeat nothing teach
    nothing, so a mention paired with itself would fail here."""
    for label in ("none", "email", "ip", "card", "phone"):
        i = pii.LABELS.index(label)
        assert crf.pairs["skip"][i, i] > 0.5 > max(crf.pairs["skip"][i, j] for j in range(len(pii.LABELS)) if j != i)
    assert np.allclose(_fitted(_crf_texts(False)).pairs["skip"], 0)
    flat = pii.SkipChain({})
    assert np.allclose(flat.pairs["skip"], 0) and np.allclose(flat.pairs["chain"], 0)


def test_masked_copies_need_their_edges(crf):
    """A card number in dots is no exact match: with its marked copy in the text it is labelled, by the edge alone."""
    import copy

    blind = copy.copy(crf)
    blind.pairs = {k: np.zeros_like(v) for k, v in crf.pairs.items()}
    seen = {"with": 0, "without": 0}
    rng = random.Random(5)
    for _ in range(50):
        long = "".join(rng.choice("0123456789") for _ in range(15))
        card = next(long + c for c in "0123456789" if pii.luhn(long + c))
        text = f"first {card} then {'.'.join(card[k : k + 4] for k in range(0, 16, 4))} again"
        for name, model in (("with", crf), ("without", blind)):
            base, added = model.label(text)
            assert base == [("card", 6, 22)]
            seen[name] += [k for k, _, _ in added] == ["card"]
    assert seen == {"with": 50, "without": 0}


def test_loopy_marginals_with_skip_edges(crf):
    """Close to all labelings summed, on small graphs with loops, and a label travels however far apart its copies are."""
    import itertools

    texts = ["call +1 (864) 555-2588 or 9123456789 or (864) 555-2588", "ids 1234567890 and 10.0.0.999 and 1234567890 or +1 (212) 555-0100", "a (864) 555-2588 and 1234567 and (864) 555-2588"]
    n = len(pii.LABELS)
    for text in texts:
        _, nodes = pii.mentions(text)
        found = [pii.keys(text[s:e]) for s, e, _ in nodes]
        skips, copies = pii.skip_edges(found), collections.Counter(k[0] for k in found)
        assert skips and len(nodes) >= 3
        total = np.zeros((len(nodes), n))
        own = [np.where(np.arange(n) == y, 0.0, -50.0) if y else crf.potential(text, s, e, copies[k[0]]) for (s, e, y), k in zip(nodes, found, strict=True)]
        for ys in itertools.product(range(n), repeat=len(nodes)):
            w = sum(own[i][y] for i, y in enumerate(ys)) + sum(crf.pairs["chain"][ys[i], ys[j]] for i, j in pii.chain_edges(found)) + sum(crf.pairs["skip"][ys[i], ys[j]] for i, j in skips)
            for i, y in enumerate(ys):
                total[i, y] += np.exp(w)
        exact = total / total.sum(axis=1, keepdims=True)
        got = crf.marginals(text, nodes)
        assert np.abs(got - exact).max() < 0.1 and (got.argmax(axis=1) == exact.argmax(axis=1)).all()
    far = "+1 (864) 555-2588" + " word 8645552588" * 300
    base, added = crf.label(far)
    assert len(base) == 1 and len(added) == 300 and {k for k, _, _ in added} == {"phone"}


def test_exact_inference_on_a_tree(crf):
    """Without loops, belief propagation is exact: compare with all labelings."""
    text = "ab 864 555 2588 cd 10.0.0.999 ef 1234567 gh"
    _, nodes = pii.mentions(text)
    assert len(nodes) == 3 and not pii.skip_edges([pii.keys(text[s:e]) for s, e, _ in nodes])
    n = len(pii.LABELS)
    total = np.zeros((3, n))
    unary = [crf.potential(text, s, e) for s, e, _ in nodes]
    for a in range(n):
        for b in range(n):
            for c in range(n):
                w = np.exp(unary[0][a] + unary[1][b] + unary[2][c] + crf.pairs["chain"][a, b] + crf.pairs["chain"][b, c])
                total[0, a] += w
                total[1, b] += w
                total[2, c] += w
    assert np.allclose(crf.marginals(text, nodes), total / total.sum(axis=1, keepdims=True), atol=1e-4)


def test_personal_data_rows(spark):
    rows = [(1, "write x@y.org or call +1 (212) 555-0100"), *odd_rows(), (20, "tel (212) 555-0100 " * 3000)]
    docs = documents(spark, rows)
    got = pii.find_personal_data(docs, pii.train(docs)).collect()
    assert len(got) == len(rows)
    first = next(r for r in got if r.n_email)
    assert (first.n_email, first.n_ip, first.n_card, first.n_phone) == (1, 0, 0, 1) and first.spans.startswith("email:6:13,phone:22:")
    assert pii.find_personal_data(documents(spark, []), pii.train(documents(spark, []))).collect() == []


# Language.


def _language_rows(n, seed):
    rng = random.Random(seed)
    parts = {"aa": ["ka", "mo", "tu", "ri"], "bb": ["she", "ffle", "wig", "orn"], "cc": ["żo", "łą", "ści", "rze"]}
    return [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30)) + ".", lang) for i in range(n) for lang in [rng.choice(sorted(parts))]]


def test_language_held_out_accuracy(spark):
    docs = documents(spark, _language_rows(300, 1)).withColumn("held_out", hyperlang.held_out())
    prototypes = hyperlang.learn_prototypes(docs)
    got = hyperlang.identify(docs, prototypes, ("doc_id", "held_out", "lang")).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark):
    docs = documents(spark, odd_rows() + [(30, "123 !!"), (31, None, None)])
    got = hyperlang.identify(docs, hyperlang.learn_prototypes(docs)).collect()
    assert len(got) == len(odd_rows()) + 2
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3, 30, 31))
    assert hyperlang.learn_prototypes(documents(spark, [])) == {}
    assert {r.lang_pred for r in hyperlang.identify(docs, {}).collect()} == {"und"}


def test_foreign_texts_are_dropped(spark):
    """A longer text that is like none of the learned languages goes; a short one and clashing columns stay."""
    rows = [*_language_rows(200, 3), (900, "пдв фбю " * 30, None), (901, "пдв", None), (902, None, "aa"), (903, "12 34", "aa")]
    docs = documents(spark, rows)
    kept = hyperlang.drop_undetermined(docs, hyperlang.learn_prototypes(docs))
    assert {r.doc_id for r in kept.collect()} == {*range(200), 901} and kept.columns == docs.columns


def test_rare_language_keeps_a_prototype(spark):
    rows = [*_language_rows(300, 4), *[(1000 + i, "zyx wvu zyx", "rare") for i in range(6)]]
    assert set(hyperlang.learn_prototypes(documents(spark, rows), max_documents=40)) == {"aa", "bb", "cc", "rare"}


def test_prediction_is_the_nearest_prototype(spark):
    """Prototypes, cosines and ties, restated with plain sums."""
    rows = [*_language_rows(60, 5), (70, "shekamo", None)]
    docs = documents(spark, rows)
    signs = {i: np.sign(next(hyperlang.bundle([t]))[1][0]) for i, t, _ in rows}
    learned = {lang: sum(signs[i] for i, _, own in rows if own == lang and zlib.crc32(str(i).encode()) % 3 != 1) for lang in ("aa", "bb", "cc")}
    for r in hyperlang.identify(docs, hyperlang.learn_prototypes(docs)).collect():
        own = next(hyperlang.bundle([next(t for i, t, _ in rows if i == r.doc_id)]))[1][0]
        cosine = {lang: own @ v / np.linalg.norm(own) / np.linalg.norm(v) for lang, v in learned.items()}
        assert r.lang_pred == max(sorted(cosine), key=cosine.get) and abs(r.score - max(0, cosine[r.lang_pred])) < 1e-5
    same = {"b": np.ones(hyperlang.DIMENSIONS), "a": np.ones(hyperlang.DIMENSIONS)}
    assert {r.lang_pred for r in hyperlang.identify(docs, same).collect()} == {"a"}


def test_bundle_of_many_letters():
    text = "".join(chr(0x4E00 + i) for i in range(20_000))
    whole = next(hyperlang.bundle([text], 64))[1]
    vectors = hyperlang.letter_vectors(np.array([32, *map(ord, text), 32], np.uint32), 64).astype(np.int64)
    assert np.array_equal(whole[0], (np.roll(vectors[:-2], 2, 1) * np.roll(vectors[1:-1], 1, 1) * vectors[2:]).sum(0))


def test_bundle_is_a_sum_of_bound_ngrams():
    got = next(hyperlang.bundle(["ab!c", ""], 128))[1]
    vectors = {c: hyperlang.letter_vectors(np.array([ord(c)], np.uint32), 128)[0].astype(int) for c in " abc"}
    text = " ab c "
    want = sum(np.roll(vectors[text[i]], 2) * np.roll(vectors[text[i + 1]], 1) * vectors[text[i + 2]] for i in range(len(text) - 2))
    assert np.array_equal(got[0], want) and not got[1].any()


# Packing.


def test_encoding_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(2)
    letters = "abcXYZéßÀñ.,;:!?'-12 \n\t\x1c#<|>żΣİ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["<|endoftext|>", "x" * 500, "it's don't", "a <|endoftext|> b", "no<|endoftext|>gap <|endoftext|>. é<|endoftext|>"]
    texts += ["".join(rng.choice(["<|endoftext|>", " ", "ab", ".", "\n", "<|", "[UNK]", "<pad>", "</s>", "<s>", "Ü"]) for _ in range(8)) for _ in range(500)]
    for text in texts:
        assert packing.encode_text(text, TOKENIZER) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_square_sums_choice():
    rng = random.Random(4)
    bins = packing.SquareSums(20)
    levels = collections.Counter()
    for _ in range(500):
        size = rng.randrange(1, 21)
        costs = {}
        for h in [0, *[h for h in levels if levels[h]]]:
            if h + size <= 20:
                after = levels.copy()
                if h:
                    after[h] -= 1
                if h + size < 20:
                    after[h + size] += 1
                costs[h] = sum(v * v for v in after.values())
        _, offset = bins.place(size)
        assert costs[offset] == min(costs.values())
        if offset:
            levels[offset] -= 1
        if offset + size < 20:
            levels[offset + size] += 1


def test_packing_round_trip(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 900)))) for i in range(60)] + odd_rows()
    got = packing.pack_documents(documents(spark, rows), TOKENIZER, window=256, group_pieces=50).collect()
    filled = collections.defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    want = collections.Counter()
    for i, t in rows:
        ids = packing.encode_text(t, TOKENIZER) + (1).to_bytes(4, "little")
        for start in range(0, len(ids) // 4, 256):
            part = ids[4 * start : 4 * start + 1024]
            want[i, start, len(part) // 4, zlib.crc32(part), len(ids) // 4] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert packing.pack_documents(documents(spark, []), TOKENIZER).collect() == []


# Chat.


def test_tool_calls(spark):
    call = {"tool_calls": [{"id": "c1", "name": "search", "arguments": {"query": "x", "limit": 3}}, {"id": "c2", "name": "search", "arguments": {"limit": "three"}, "depends_on": ["c1"]}, {"id": "c3", "name": "nope", "arguments": {}}]}
    rows = [
        (1, 0, "user", "find x"),
        (1, 1, "tool", json.dumps({"tool_call_id": "c1", "z": 1, "a": [1, 2]})),
        (1, 2, "assistant", json.dumps(call)),
        (1, 3, "tool", json.dumps({"tool_call_id": "c2"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "c9"})),
        (1, 5, "tool", json.dumps({"tool_call_id": "c3"})),
        (2, 0, "assistant", "{broken"),
        (2, 1, "assistant", None),
        (None, None, None, None),
        (2, 2, "user", '{"tool_call_id": "c1"}'),
        (2, 2, "user", '{"tool_call_id": "c1"}'),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"answers": F.lit(1), "depth": F.lit(2), "line": F.lit(3)})
    got = toolchat.link_tool_calls(table).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn, r.role): r for r in got}
    assert by[1, 2, "assistant"].status == "call" and by[1, 2, "assistant"].n_calls == 3
    assert json.loads(by[1, 2, "assistant"].line)["checks"] == ["ok", "missing query", "unknown tool"]
    assert by[1, 1, "tool"].status == "result: ok" and by[1, 1, "tool"].order_turn == 2
    assert by[1, 3, "tool"].status == "result: missing query" and by[1, 3, "tool"].order_step > by[1, 1, "tool"].order_step
    assert by[1, 4, "tool"].status == "orphan" and by[1, 5, "tool"].status == "result: unknown tool"
    assert by[2, 0, "assistant"].status == "plain" and by[2, 2, "user"].status == "plain"
    assert json.loads(by[1, 1, "tool"].line)["content"] == '{"a":[1,2],"tool_call_id":"c1","z":1}'
    ordered = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.order_turn, r.order_step))
    assert [r.turn for r in ordered].index(2) < [r.turn for r in ordered].index(1)
    assert toolchat.link_tool_calls(table.limit(0)).collect() == []


def test_dependency_cycle(spark):
    calls = {"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "x"}, "depends_on": ["b"]}, {"id": "b", "name": "search", "arguments": {"query": "x"}, "depends_on": ["a"]}]}
    rows = [(1, 0, "assistant", json.dumps(calls)), (1, 1, "tool", json.dumps({"tool_call_id": "a"}))]
    got = toolchat.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), rounds=6).collect()
    assert {r.status for r in got} == {"call", "cycle"}


def chat(spark, rows):
    def message(conv, turn, *calls):
        made = [{"id": i, "name": "search", "arguments": {"query": "x"}, "depends_on": on} for i, on in calls]
        return (conv, turn, "assistant", json.dumps({"tool_calls": made}))

    full = [message(*r) if len(r) > 2 and isinstance(r[2], tuple) else (r[0], r[1], "tool", json.dumps({"tool_call_id": r[2]})) for r in rows]
    return spark.createDataFrame(full, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("limit", [2000, 10])
def test_long_dependency_chain(spark, monkeypatch, limit):
    """A chain beyond ``rounds`` keeps its order, finished in one task or by rounds; cycles are told from it."""
    monkeypatch.setattr(toolchat, "LOCAL_EDGES", limit)
    n = 200 if limit > 100 else 9
    ids = [f"c{i}" for i in range(n)]
    rows = [(1, 0, (c, [ids[i - 1]] if i else [])) for i, c in enumerate(ids)] + [(1, 1, c) for c in ids]
    rows += [(2, 0, ("a", ["b"])), (2, 0, ("b", ["a"])), (2, 0, ("d", ["b"])), (2, 0, ("e", [])), (2, 1, "a"), (2, 1, "d"), (2, 1, "e")]
    got = toolchat.link_tool_calls(chat(spark, rows).repartition(3), rounds=3).collect()
    assert len(got) == len(rows)
    assert all(r.status in ("call", "result: ok") for r in got if r.conv_id == 1)
    assert sorted(r.status for r in got if r.conv_id == 2 and r.role == "tool") == ["cycle", "cycle", "result: ok"]

    def of(r):
        return (r.order_turn, r.order_step)

    steps = {("answers" in json.loads(r.line)) * "r" + (json.loads(r.line).get("answers") or json.loads(json.loads(r.line)["content"])["tool_calls"][0]["id"]): of(r) for r in got if r.conv_id == 1}
    for i, c in enumerate(ids):
        assert steps[c] < steps["r" + c]
        if i:
            assert steps[ids[i - 1]] < steps[c] and steps["r" + ids[i - 1]] < steps["r" + c]


@pytest.mark.parametrize("local", [2000, 0])
def test_levels_of_random_graphs(spark, monkeypatch, local):
    """Longest chains, latest turns and cycles against a plain depth-first search; in one row each, and by rounds."""
    monkeypatch.setattr(toolchat, "LOCAL_EDGES", local)
    rng = random.Random(11)
    edges, want = [], {}
    for conv in range(25):
        size = rng.randrange(2, 14)
        turn = {v: rng.randrange(9) for v in range(size)}
        on = {v: {u for u in range(size) if u != v and rng.random() < 0.15 and (conv % 2 or u < v)} for v in range(size)}
        edges += [(conv, str(v), str(u), turn[v], turn[u]) for v in on for u in on[v]]

        def walk(v, path=(), on=on, turn=turn):
            if v in path:
                return None
            below = [walk(u, (*path, v)) for u in on[v]]
            if None in below:
                return None
            return max((x + 1 for x, _ in below), default=0), max([turn[v], *(t for _, t in below)])

        for v in on:
            if on[v]:
                want[conv, str(v)] = walk(v) or (-1, None)
    table = spark.createDataFrame(edges, "conv_id long, node string, on string, turn long, on_turn long")
    got = {(r.conv_id, r.node): (r.level, r.turn if r.level >= 0 else None) for r in toolchat._levels(table, 0).collect()}
    assert got == want and {-1, 1, 2, 3} <= {level for level, _ in want.values()}


def test_cycle_of_three_with_a_tail(spark):
    """What is on or behind the cycle is a cycle's; what the cycle depends on is not."""
    rows = [(1, 0, ("a", ["c", "base"])), (1, 1, ("b", ["a"])), (1, 2, ("c", ["b"])), (1, 3, ("tail", ["b"])), (1, 4, ("base", []))]
    rows += [(1, 5, x) for x in ("a", "b", "c", "tail", "base")]
    for rounds in (1, 6):
        got = toolchat.link_tool_calls(chat(spark, rows), rounds=rounds).collect()
        status = {json.loads(r.line)["answers"]: r.status for r in got if r.role == "tool"}
        assert status == {"a": "cycle", "b": "cycle", "c": "cycle", "tail": "cycle", "base": "result: ok"}
        assert all(r.order_turn == r.turn for r in got)


def test_calls_after_their_dependencies(spark):
    """Messages of one turn, calls inside a message, and a call that needs one of a later turn."""
    rows = [(1, 0, ("z", ["y"]), ("y", [])), (1, 0, ("x", ["z", "gone"])), (1, 0, "z"), (2, 0, ("p", ["q"])), (2, 5, ("q", [])), (2, 1, "p"), (3, 0, ("s", []), ("t", [])), (4, 0, "none"), (5, None, ("v", ["u"])), (5, None, ("u", [])), (5, 3, "v")]
    got = {(r.conv_id, (json.loads(r.line).get("answers") or json.loads(json.loads(r.line)["content"])["tool_calls"][0]["id"]), r.role): r for r in toolchat.link_tool_calls(chat(spark, rows), rounds=1).collect()}
    at = {k: (r.order_turn, r.order_step) for k, r in got.items()}
    assert at[1, "z", "assistant"] < at[1, "z", "tool"] and at[1, "z", "assistant"] < at[1, "x", "assistant"]
    assert json.loads(got[1, "z", "assistant"].line)["order"] == ["y", "z"]
    assert at[2, "q", "assistant"] < at[2, "p", "assistant"] < at[2, "p", "tool"]
    assert at[5, "v", "tool"][0] == 3 and at[5, "v", "assistant"][0] is None and at[5, "u", "assistant"][1] < at[5, "v", "assistant"][1]
    assert "order" not in json.loads(got[3, "s", "assistant"].line) and at[4, "none", "tool"] == (0, 2)


# Decontamination.


def _edited(rng, tokens, n):
    tokens = list(tokens)
    for _ in range(n):
        at = rng.randrange(len(tokens))
        tokens[at : at + 1] = rng.choice([["zz"], [], [tokens[at], "yy"]])
    return tokens


def brute_leaks(rows, items, similarity=0.8):
    split = [next(decontaminate.words_of(pa.array([t or ""]), lower=True, drop=decontaminate._MARKS)).hash for _, t in rows]
    out = {}
    for item, text in items:
        goal = next(decontaminate.words_of(pa.array([text or ""]), lower=True, drop=decontaminate._MARKS)).hash
        for (doc, _), w in zip(rows, split, strict=True):
            if len(goal) >= 5 and len(w):
                distance, _ = decontaminate.edit_distance_within(goal, w)
                if distance <= int(len(goal) * (1 - similarity) + 1e-9):
                    out[doc, item] = distance
    return out


def test_edit_distance():
    rng = random.Random(9)
    for _ in range(200):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randrange(1, 9))], np.uint64) for _ in range(2))
        best = len(a)
        for i in range(len(b) + 1):
            row = list(range(len(a) + 1))
            for j in range(i, len(b)):
                new = [0] * (len(a) + 1)
                new[0] = row[0] + 1
                for k in range(1, len(a) + 1):
                    new[k] = min(row[k - 1] + (a[k - 1] != b[j]), row[k] + 1, new[k - 1] + 1)
                row = new
                best = min(best, row[-1])
        assert decontaminate.edit_distance_within(a, b)[0] == best


def test_leaks_recall_and_precision(spark):
    rng = random.Random(12)
    items = [(i, " ".join(words(rng, rng.randrange(5, 60), 4000))) for i in range(80)]
    rows = []
    for i in range(400):
        body = words(rng, rng.randrange(0, 200), 4000)
        if i % 2:
            tokens = rng.choice(items)[1].split()
            at = rng.randrange(len(body) + 1)
            body[at:at] = _edited(rng, tokens, rng.randrange(int(len(tokens) * 0.2) + 1))
        rows.append((i, ", ".join(body).capitalize()))
    benchmark = spark.createDataFrame(items + [(900, None), (901, "too short"), (None, "null id here for five")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(documents(spark, rows), benchmark).collect()}
    want = brute_leaks(rows, items)
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)
    exact = {k for k, d in want.items() if d == 0}
    assert exact <= set(got) and all(got[k] == 0 for k in exact)


def test_leaks_short_items_and_passes(spark, monkeypatch):
    """Items of one to four words are found as they stand; a benchmark beyond one pass gives the same rows."""
    items = [(1, "alpha"), (2, "Beta gamma"), (3, "one two three four"), (4, ""), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (6, "alpha")]
    docs = documents(spark, [(1, "an ALPHA, and beta gamma"), (2, "one two three"), (3, "one, two; three four alpha beta"), (4, "w1 w2 w3 w4 xx w6 w7 w8 w9 w10 alpha alpha"), (5, None)])
    want = {(1, 1), (1, 2), (1, 6), (3, 1), (3, 3), (3, 6), (4, 1), (4, 5), (4, 6)}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark).collect()} == want
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 2)
    got = [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r.doc_id for r in decontaminate.drop_leaking(docs, benchmark).collect()} == {2, 5}


def test_leaks_common_opening(spark):
    """Many items with one opening: a text of that opening is in no item, and one whole item is found."""
    rng = random.Random(31)
    opening = words(rng, 10, 9000)
    items = [(i, " ".join(opening + words(rng, 25, 9000))) for i in range(300)]
    docs = documents(spark, [(1, " ".join(opening * 60)), (2, " ".join(opening * 5) + " " + items[7][1])])
    got = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.distance) for r in got] == [(2, 7, 0)]


def test_leaks_odd_rows(spark):
    benchmark = spark.createDataFrame([(1, "w1x w2x w3x w4x w5x w6x")], "item_id long, text string")
    docs = documents(spark, [*odd_rows(), (50, "w1x w2x w3x w4x w5x w6x"), (50, "w1x w2x w3x w4x w5x w6x"), (None, "W1x, W2x; w3x w4x w5x w6x!")])
    assert sorted(repr(r.doc_id) for r in decontaminate.find_leaks(docs, benchmark).collect()) == ["50", "50", "None"]
    kept = decontaminate.drop_leaking(docs, benchmark)
    assert kept.count() == len(odd_rows()) and kept.columns == docs.columns
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).collect() == []
    assert decontaminate.find_leaks(docs.limit(0), benchmark).collect() == []


# The pipeline, each stage on what the one before has kept.


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    base = [f"{' '.join(words(rng, 40, 3000))}.\n{' '.join(words(rng, 40, 3000))}." for _ in range(12)]
    item = " ".join(words(rng, 20, 3000))
    edited = base[0].split(" ")
    edited[5] = "changed"
    rows = [(i, t) for i, t in enumerate(base)] + [(20, base[3]), (21, " ".join(edited)), (22, "123 456"), (23, None), (24, "clean start here " + item + " and more words after it")]
    documents(spark, rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        sizes.append({r.doc_id for r in docs.select("doc_id").collect()})
    every = {i for i, _ in rows}
    assert every - sizes[0] == {22, 23}
    assert sizes[0] - sizes[1] == {20}
    assert sizes[1] - sizes[2] == {21}
    assert sizes[2] - sizes[3] == {24}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(range(12))


def test_pipeline_empty_table_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(22)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ("k", "h", "row", "gone", "n_lines", "n_removed", "_bits", "_word", "_k", "_h", "_gone", "node", "head", "k.h", "copy")
    rows = [(i, "\n".join(" ".join(words(rng, 9)) for _ in range(4))) for i in range(5)]
    docs = documents(spark, [*rows, (9, rows[1][1])], extra=False).withColumns({c: F.lit(f"own {c}") for c in names if c != "k.h"}).withColumn("k.h", F.lit(1))
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, table, str(tmp_path))
            assert kept.schema.names == table.schema.names
            for r in kept.collect():
                assert all(r[c] == f"own {c}" for c in names if c != "k.h")
        assert {r.doc_id for r in kept.collect()} == (set() if table is not docs else {0, 1, 2, 3, 4, 9})
    documents(spark, [], extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_odd_rows(spark, tmp_path):
    import corpus_pipeline

    documents(spark, odd_rows(), extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} >= {4, 6, 8}
