"""Language identification with hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqdrift.llm.common import keyed_texts, settle, small_batches, without
from seqdrift.llm.text import mix

DIMENSIONS = 1024
GRAM = 3
MAX_LANGUAGES = 4096
UNDETERMINED = "und"
_GAP = 32
_BLOCK = 1024
_CHUNK_CHARS = 1 << 18
_ROWS = 256
#: A text of this many characters whose nearest prototype is less alike than this is in none of the learned languages:
#: unrelated vectors have cosines around 0, with a deviation of 1 / sqrt(DIMENSIONS).
MIN_SCORE = 0.05
ENOUGH_CHARS = 64
#: Prototypes of fewer documents know too little of their languages to reject a text.
ENOUGH_DOCUMENTS = 64
_ALPHA: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _ALPHA


def letter_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The +1/-1 vector of each code point, drawn by a hash of code point and dimension."""
    words = mix(codes.astype(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(dimensions // 64, dtype=np.uint64)[None, :], 11)
    bits = np.unpackbits(words.view(np.uint8), axis=1)
    return (bits.astype(np.int8) << 1) - np.int8(1)


def bundle(texts: list[str | None], dimensions: int = DIMENSIONS) -> Iterator[tuple[int, np.ndarray]]:
    """(first index, float32 matrix): each text's sum of n-gram vectors, in chunks of about a million characters.

    Letters are lower-cased; each run of other characters, and each end of the text, is one gap symbol. An n-gram's
    vector is the product of its letters' vectors, rotated by their distance from the end. A text without letters
    bundles to zeros.
    """
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or "") <= _CHUNK_CHARS):
            size += len(texts[last] or "")
            last += 1
        yield first, _bundle_chunk([f" {(t or '').lower()} " for t in texts[first:last]], dimensions)
        first = last


def _bundle_chunk(texts: list[str], dimensions: int) -> np.ndarray:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    alpha = _letters()[codes]
    codes[~alpha] = _GAP
    keep = np.ones(len(codes), bool)
    keep[1:] = alpha[1:] | alpha[:-1] | (doc[1:] != doc[:-1])
    codes, doc = codes[keep], doc[keep]
    out = np.zeros((len(texts), dimensions), np.float32)
    if len(codes) < GRAM:
        return out
    symbols, ids = _distinct(codes)
    whole = doc[GRAM - 1 :] == doc[: -(GRAM - 1)]
    n = len(symbols)
    grams = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    grams, doc = grams[whole], doc[: -(GRAM - 1)][whole]
    if not len(grams):
        return out
    if n <= 128:
        seen = np.flatnonzero(np.bincount(grams, minlength=n**3))
        place = np.zeros(n**3, np.int64)
        place[seen] = np.arange(len(seen))
        at = place[grams]
    else:
        seen, at = np.unique(grams, return_inverse=True)
    # A text may hold any number of different letters: vectors are drawn for one block of n-grams at a time.
    for low in range(0, len(seen), _BLOCK):
        block = seen[low : low + _BLOCK]
        vectors = None
        for k, place in enumerate((block // (n * n), block // n % n, block % n)):
            own, back = np.unique(place, return_inverse=True)
            turned = np.roll(letter_vectors(symbols[own], dimensions), GRAM - 1 - k, axis=1)[back]
            vectors = turned if vectors is None else vectors * turned
        inside = (at >= low) & (at < low + _BLOCK) if len(seen) > _BLOCK else slice(None)
        width = len(block)
        counts = np.bincount(doc[inside] * width + (at[inside] - low), minlength=len(texts) * width)
        out += counts.reshape(len(texts), width).astype(np.float32) @ vectors.astype(np.float32)
    return out


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = int(codes.max()) + 1
    there = np.zeros(top, bool)
    there[codes] = True
    symbols = np.flatnonzero(there)
    place = np.zeros(top, np.int64)
    place[symbols] = np.arange(len(symbols))
    return symbols.astype(np.uint32), place[codes]


def has_letter(texts: list[str | None]) -> list[bool]:
    return [t is not None and any(map(str.isalpha, t)) for t in texts]


def held_out() -> Column:
    """Held-out documents: CRC-32 of the doc_id's digits leaves 1 modulo 3; a null doc_id counts as no bytes."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


class Prototypes(dict):
    """Vector by language, and about how many documents they were learned from."""

    documents = 0


def learn_prototypes(docs: DataFrame, max_documents: int = 20_000, dimensions: int = DIMENSIONS) -> Prototypes:
    """Bundle each language's documents into an integer prototype.

    At most about ``max_documents`` labelled rows that are not held out are used: each language's are chosen by a hash of
    doc_id and text, up to an equal share each, so a rare language keeps its prototype however large the table is. Each
    document is reduced to the signs of its bundle, so prototypes are exact integer sums in whatever order rows come.
    What reaches the driver is one vector a language, at most ``MAX_LANGUAGES``.
    """
    small_batches(docs.sparkSession)
    eligible = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in eligible.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = max_documents // max(1, len(sizes))
    if any(n > share for n in sizes.values()):
        limits = docs.sparkSession.createDataFrame([(lang, int((1 << 30) * min(1.0, share / n))) for lang, n in sizes.items()], "lang string, below long")
        eligible = eligible.join(F.broadcast(limits), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("below"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, _ROWS):
                part = batch.slice(low, _ROWS)
                langs = part.column("lang").to_pylist()
                for first, vectors in bundle(part.column("text").to_pylist(), dimensions):
                    signs = np.sign(vectors).astype(np.int64)
                    for lang in set(langs[first : first + len(signs)]):
                        mine = [i for i in range(len(signs)) if langs[first + i] == lang]
                        totals[lang] = totals.get(lang, 0) + signs[mine].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([v.tolist() for v in totals.values()], pa.list_(pa.int64()))], names=["lang", "sums"])

    parts = eligible.select("text", "lang").mapInArrow(sums, "lang string, sums array<bigint>")
    each = parts.select("lang", F.posexplode("sums").alias("dim", "value")).groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    whole = each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v")).select("lang", F.col("v.value").alias("v"))
    found = Prototypes({r["lang"]: np.array(r["v"], np.float64) for r in whole.collect()})
    found.documents = sum(min(n, share) for n in sizes.values())
    return found


class Classifier:
    """Language prototypes as unit rows."""

    def __init__(self, prototypes: dict[str, np.ndarray]) -> None:
        self.names = sorted(prototypes)
        self.matrix = np.stack([prototypes[n] / max(1e-12, np.linalg.norm(prototypes[n])) for n in self.names]).astype(np.float32) if prototypes else None

    def predict(self, column: pa.Array) -> tuple[list[str], list[float]]:
        lang, score = [UNDETERMINED] * len(column), [0.0] * len(column)
        if self.matrix is None:
            return lang, score
        for low in range(0, len(column), _ROWS):  # a few texts at a time become Python strings
            texts = column.slice(low, _ROWS).to_pylist()
            lettered = has_letter(texts)
            for first, vectors in bundle(texts, self.matrix.shape[1]):
                cosine = vectors @ self.matrix.T / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
                for i, k in enumerate(cosine.argmax(axis=1)):
                    if lettered[first + i]:
                        lang[low + first + i], score[low + first + i] = self.names[k], float(min(1.0, max(0.0, cosine[i, k])))
        return lang, score


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add lang_pred and score (cosine with the nearest prototype, 0 to 1) to the ``carry`` columns.

    A null text, one without a letter, or an empty set of prototypes gives ``und`` with score 0; equal cosines go to the
    first language by name. Whole texts are read. Rows stay as they are, repeated ones included.
    """
    classifier = Classifier(prototypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = classifier.predict(batch.column(batch.num_columns - 1))
            kept = [batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    source = docs.select(*carry, F.col("text").alias("text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{schema}, lang_pred string, score double")


def drop_undetermined(docs: DataFrame, prototypes: Prototypes, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents, all columns, that are in a learned language.

    Those that ``identify`` calls ``und`` go, and those of ``ENOUGH_CHARS`` characters or more whose score is below
    ``min_score``: a shorter text says too little to be rejected on, and so do prototypes of fewer than
    ``ENOUGH_DOCUMENTS``. Rows equal in doc_id and text share their fate.
    """
    small_batches(docs.sparkSession)
    texts = keyed_texts(docs).withColumn("enough", F.char_length("text") >= ENOUGH_CHARS)
    named = identify(texts, prototypes, ("k", "h", "enough"))
    foreign = F.col("lang_pred") == UNDETERMINED
    if prototypes.documents >= ENOUGH_DOCUMENTS:
        foreign |= F.col("enough") & (F.col("score") < min_score)
    return without(docs, settle(named.where(foreign).select("k", "h").distinct()))
