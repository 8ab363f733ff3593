"""Personal data: exact patterns, and a skip-chain CRF that carries their labels to weaker mentions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqdrift.llm.common import small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
#: What the CRF labels; secrets have no exact pattern.
KINDS = (*BASE_KINDS, "secret")
LABELS = ("none", *KINDS)
MAX_TRAINING_DOCUMENTS = 20_000
#: Messages settle long before: every mention is at most two edges away from any other of its group.
ROUNDS = 200
DAMPING = 0.5
ACCEPT = 0.8
#: Log potential of what a clamped mention is not: no number of copies outweighs it.
_NEVER = -1e9

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits either matches from its first digit or not at all, so starts inside a run are skipped.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Weaker mentions, which the CRF labels: numbers in groups, addresses with spelt-out or spaced signs, and long runs of
# letters and digits.
_NUMBER = re.compile(r"(?<![\w+@.-])\(?[0-9]++(?:[)][ ]?|[ .-])?(?:[(]?[0-9]++(?:[)][ ]?|[ .-](?=[(0-9]))?)*(?![\w@])")
_SPELT = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\bdot\b) ?[A-Za-z0-9-]{2,63}){1,8}")
_SIGNS = re.compile(r"@|\(at\)|\[at\]|\(dot\)|\[dot\]|\bdot\b")
_RUN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+")
#: The mark that training takes for a secret: a name and an assignment right before it.
_ASSIGNED = re.compile(r"(?i)(?:token|secret|key|password|passwd|pwd|bearer)\w*[\"']?\s*[:=]\s*[\"']?$")
#: A text without any of these has no mention.
_ANY = re.compile(r"[@0-9]|\((?:at|dot)\)|\[(?:at|dot)\]|\bdot\b")
_CUES = {
    "email": ("mail", "email", "e-mail", "correo", "courriel", "contact", "kontakt"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "secret": ("token", "secret", "key", "password", "passwd", "pwd", "bearer", "api_key"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "téléphone", "teléfono"),
}


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The exact patterns' spans, by kind, then start."""
    spans, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                spans.append(("email", start, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(map(_at_most_255, m.group().split("."))):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def weak_spans(text: str) -> list[tuple[int, int]]:
    """Mentions that might be personal data: numbers of 7 to 19 digits, spelt-out addresses, and runs of 20 or more
    letters and digits."""
    found = [m.span() for m in _NUMBER.finditer(text) if m.end() - m.start() >= 7 and 7 <= len(_digits(m.group())) <= 19]
    if "@" in text or "at" in text:
        found += [m.span() for m in _SPELT.finditer(text) if _SIGNS.search(m.group())]
    found += [m.span() for m in _RUN.finditer(text) if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group())]
    return found


def unmarked(mention: str, kind: str) -> str:
    """A mention without the mark that its exact pattern insists on, as training shows it to the model."""
    if kind == "email":
        return mention.replace("@", " at ")
    return mention.lstrip("+").removeprefix("1 ") if kind == "phone" else mention


def shape(mention: str) -> str:
    """What a mention looks like, whatever its sign or check digit says."""
    if _SIGNS.search(mention) or " at " in mention:
        return "address"
    if re.search("[A-Za-z]", mention):
        kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", mention) else "run"
        return f"{kind} of {min(len(mention) // 8 * 8, 64)}"
    groups = re.findall("[0-9]+", mention)
    if mention.count(".") == 3 and len(groups) == 4:
        return "quad" if all(map(_at_most_255, groups)) else "quad over"
    total = sum(map(len, groups))
    if len(groups) >= 3 and [len(g) for g in groups[-2:]] == [3, 4]:
        return "3-4 groups"
    if total >= 13:
        return "long"
    return f"{len(groups)} groups of {total}" if len(groups) <= 4 else "many groups"


def cue(text: str, start: int) -> str:
    """The kind that one of the three words before a mention speaks of."""
    words = [w.strip(".,;:!?()=\"'").lower() for w in text[max(0, start - 60) : start].split()[-3:]]
    return next((kind for kind in KINDS if any(w in _CUES[kind] for w in words)), "none")


def keys(mention: str) -> tuple[str, ...]:
    """Mentions with a key in common are joined by a skip edge: equal or similar tokens."""
    if re.fullmatch("[A-Za-z0-9_+/=-]{20,}", mention):
        return (f"s:{mention}",)
    if re.search("[A-Za-z]", mention):
        plain = re.sub(r" ?(?:\(at\)|\[at\]|\bat\b) ?", "@", mention.lower())
        plain = re.sub(r" ?(?:\(dot\)|\[dot\]|\bdot\b) ?", ".", plain).replace(" ", "")
        return (f"a:{plain}", f"l:{plain.partition('@')[0]}")
    digits = _digits(mention)
    return (f"d:{digits}", f"e:{digits[-10:]}") if len(digits) >= 10 else (f"d:{digits}", f"e:{digits}")


def mentions(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, int]]]:
    """(base spans, nodes): a node is (start, end, label); label 0 is open, others are clamped to a base span's kind."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    nodes = [(s, e, LABELS.index(kind)) for kind, s, e in base]
    free, k = [], 0
    for s, e in sorted(weak_spans(text)):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if k == len(taken) or taken[k][0] >= e:
            if not free or free[-1][1] <= s:
                free.append((s, e))
    return base, sorted(nodes + [(s, e, 0) for s, e in free])


def skip_edges(found: list[tuple[str, ...]]) -> list[tuple[int, int]]:
    """The first mention with a key to every later one with it: a star over each group, not all its pairs, so no two
    mentions of a group are further apart than two edges."""
    first: dict[str, int] = {}
    edges = set()
    for i, own in enumerate(found):
        for key in own:
            if first.setdefault(key, i) != i:
                edges.add((first[key], i))
    return sorted(edges)


def chain_edges(found: list[tuple[str, ...]]) -> list[tuple[int, int]]:
    """Neighbours, but for those of one group, whose likeness the skip factor speaks for."""
    return [(i, i + 1) for i in range(len(found) - 1) if not set(found[i]) & set(found[i + 1])]


def count_evidence(text: str) -> Counter:
    """Observations of one text for training by pseudo-likelihood: ((shape, cue, copies, chain, skip), label) by number.

    Labels come from the exact patterns and, for secrets, from assignments; other mentions are none. An open copy of a
    labelled mention, and an unassigned run behind a word for secrets, have no known label and are left out. A mention is
    shown without the mark that gave it its label (a secret without its cue), once with its shape and once without, as a
    copy in another form; ``chain`` and ``skip`` count its neighbours' labels. Only edges between two mentions count.
    """
    out: Counter = Counter()
    if not _ANY.search(text):
        return out
    _, nodes = mentions(text)
    found = [keys(text[s:e]) for s, e, _ in nodes]
    labels: list[int | None] = []
    for s, e, label in nodes:
        if not label and _RUN.fullmatch(text[s:e]) and _ASSIGNED.search(text[max(0, s - 40) : s]):
            label = LABELS.index("secret")
        labels.append(label)
    marked = {key for own, label in zip(found, labels, strict=True) if label for key in own}
    for i, (s, e, _) in enumerate(nodes):
        if labels[i] == 0 and (marked.intersection(found[i]) or (_RUN.fullmatch(text[s:e]) and cue(text, s) == "secret")):
            labels[i] = None
    around = {"chain": [Counter() for _ in nodes], "skip": [Counter() for _ in nodes]}
    for what, edges in (("chain", chain_edges(found)), ("skip", skip_edges(found))):
        for i, j in edges:
            if labels[i] is not None and labels[j] is not None:
                around[what][i][labels[j]] += 1
                around[what][j][labels[i]] += 1
    copies = Counter(own[0] for own in found)
    for i, (s, e, _) in enumerate(nodes):
        label = labels[i]
        if label is None:
            continue
        near = "none" if LABELS[label] == "secret" else cue(text, s)
        sides = [" ".join(str(around[what][i][y]) for y in range(len(LABELS))) for what in ("chain", "skip")]
        for form in (shape(unmarked(text[s:e], LABELS[label])), ""):
            out["|".join((form, near, str(copies[found[i][0]]), *sides)), label] += 1
    return out


class SkipChain:
    """Log potentials of shapes, cues, neighbours and copies, fitted together by penalised pseudo-likelihood.

    Each observation is a mention's label given its own features and its neighbours' labels, so an edge gets the weight
    that explains what shape and cue leave open; what was never seen has weight 0.
    """

    def __init__(self, counts: dict[tuple[str, int], int], penalty: float = 0.1, steps: int = 800) -> None:
        n = len(LABELS)
        rows = sorted(counts.items())
        parts = [value.split("|") for (value, _), _ in rows]
        shapes, cues = sorted({x[0] for x in parts} - {""}), sorted({x[1] for x in parts})
        form = np.array([shapes.index(x[0]) + 1 if x[0] else 0 for x in parts], np.int64)
        near = np.array([cues.index(x[1]) for x in parts], np.int64)
        share = 1 / np.array([int(x[2]) for x in parts], float)[:, None]
        chain, skip = (np.array([x[k].split() for x in parts], float).reshape(-1, n) for k in (3, 4))
        label = np.array([y for (_, y), _ in rows], np.int64)
        times = np.array([t for _, t in rows], float)[:, None]
        truth = np.eye(n)[label]
        # A label without an example is never given.
        self.unseen = np.where(np.bincount(label, minlength=n) > 0, 0.0, -50.0) if rows else np.where(np.arange(n) == 0, 0.0, -50.0)
        # Row 0 of the first is what all shapes have in common.
        weights = [np.zeros((len(shapes) + 1, n)), np.zeros((len(cues), n)), np.zeros((n, n)), np.zeros((n, n))]
        speed, size = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step in range(steps if rows else 0):
            common, by_cue, c, s = weights
            own = (common[0] + np.where(form[:, None] > 0, common[form], 0)) * share
            logits = own + by_cue[near] + np.einsum("ij,jk->ik", chain, c) + np.einsum("ij,jk->ik", skip, s) + self.unseen
            left = times * (truth - _normal(logits))
            shaped = np.stack([np.bincount(form, left[:, y] * share[:, 0], len(shapes) + 1) for y in range(n)], axis=1)
            shaped[0] = (left * share).sum(axis=0)
            cued = np.stack([np.bincount(near, left[:, y], len(cues)) for y in range(n)], axis=1)
            pairs = [np.einsum("ij,ik->jk", side, left) for side in (chain, skip)]
            uphill = [shaped, cued, *(g + g.T for g in pairs)]
            for k, w in enumerate(weights):  # Adam, with steps that shrink to nothing
                g = uphill[k] - penalty * w
                speed[k] = 0.9 * speed[k] + 0.1 * g
                size[k] = 0.999 * size[k] + 0.001 * g * g
                w += 0.1 * (1 - step / steps) * (speed[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(size[k] / (1 - 0.999 ** (step + 1))) + 1e-9)
        self.common, self.shape = weights[0][0], dict(zip(shapes, weights[0][1:], strict=True))
        self.cue = dict(zip(cues, weights[1], strict=True))
        self.pairs = {"chain": weights[2], "skip": weights[3]}

    def potential(self, text: str, s: int, e: int, copies: int = 1) -> np.ndarray:
        """Log potential of a mention; ``copies`` equal mentions share the potential of their common shape."""
        return (self.common + self.shape.get(shape(text[s:e]), 0.0)) / copies + self.cue.get(cue(text, s), 0.0) + self.unseen

    def marginals(self, text: str, nodes: list[tuple[int, int, int]]) -> np.ndarray:
        """Loopy sum-product with damped messages over neighbours and over equal or similar mentions."""
        found = [keys(text[s:e]) for s, e, _ in nodes]
        copies = Counter(own[0] for own in found)
        own = [np.where(np.arange(len(LABELS)) == label, 0.0, _NEVER) if label else self.potential(text, s, e, copies[k[0]]) for (s, e, label), k in zip(nodes, found, strict=True)]
        own, skips = np.stack(own), skip_edges(found)
        chain = chain_edges(found)
        edges = np.array([*chain, *skips], np.int64).reshape(-1, 2)
        if not len(edges):
            return _normal(own)
        factor = np.stack([self.pairs["chain"]] * len(chain) + [self.pairs["skip"]] * len(skips))
        source, target = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
        factor = np.concatenate((factor, factor.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
        messages = np.zeros((len(source), len(LABELS)))
        belief = own
        for _ in range(ROUNDS):
            before = belief[source] - messages[back]
            joint = before[:, :, None] + factor
            top = joint.max(axis=1)
            new = top + np.log(np.exp(joint - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            moved = DAMPING * messages + (1 - DAMPING) * new
            settled = np.abs(moved - messages).max() < 1e-6
            messages = moved
            belief = own.copy()
            np.add.at(belief, target, messages)
            if settled:
                break
        return _normal(belief)

    def label(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(base spans, added spans)."""
        if not _ANY.search(text):
            return [], []
        base, nodes = mentions(text)
        open_nodes = [i for i, x in enumerate(nodes) if x[2] == 0]
        if not open_nodes:
            return base, []
        chance = self.marginals(text, nodes)
        added = []
        for i in open_nodes:
            best = int(chance[i].argmax())
            if best and chance[i, best] >= ACCEPT:
                added.append((LABELS[best], nodes[i][0], nodes[i][1]))
        return base, added


def _normal(logs: np.ndarray) -> np.ndarray:
    chance = np.exp(logs - logs.max(axis=1, keepdims=True))
    return chance / chance.sum(axis=1, keepdims=True)


def train(docs: DataFrame, max_documents: int = MAX_TRAINING_DOCUMENTS) -> SkipChain:
    """Fit the potentials on the exact patterns' labels in at most about ``max_documents`` texts with digits or signs,
    chosen by a hash of doc_id and text. Only counts by features and label reach the driver, some thousand rows."""
    small_batches(docs.sparkSession)
    useful = docs.where(F.col("text").rlike("[0-9@]")).select("doc_id", "text")
    rows = useful.count()
    if rows > max_documents:
        useful = useful.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * max_documents / rows))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                total.update(count_evidence(text.as_py()))
        value, label = (list(x) for x in zip(*total, strict=True)) if total else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(value, pa.string()), pa.array(label, pa.int32()), pa.array(list(total.values()), pa.int64())], names=["value", "label", "times"])

    counts = useful.select("text").mapInArrow(tally, "value string, label int, times long").groupBy("value", "label").agg(F.sum("times").alias("times"))
    return SkipChain({(r["value"], r["label"]): r["times"] for r in counts.collect()})


def find_personal_data(docs: DataFrame, model: SkipChain) -> DataFrame:
    """A row per document: doc_id, the exact patterns' counts and digest, and all spans with what the CRF adds.

    Spans are ``kind:start:end`` in code points, end exclusive, by kind, then start; the kind ``secret`` comes from the CRF
    alone. Counts and digest are of the exact patterns; ``n_added`` counts what the CRF adds. Null text is empty and has none;
    repeated rows get equal results; an empty table gives no rows; other columns are ignored.
    """

    def joined(spans: list[tuple[str, int, int]]) -> str:
        return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, shown, extra = [[] for _ in BASE_KINDS], [], [], []
            for text in batch.column("text"):
                base, added = model.label(text.as_py() or "")
                for column, kind in zip(counts, BASE_KINDS, strict=True):
                    column.append(sum(k == kind for k, _, _ in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                shown.append(joined(base + added))
                extra.append(len(added))
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(shown, pa.string()), pa.array(extra, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"])

    small_batches(docs.sparkSession)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
