"""Fill-in-the-middle: documents cut into prefix, middle and suffix, written in another order between marks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqdrift.llm.common import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of one coarse unit.
BLOCK = 64


class Units:
    """The code points of a text, by the offsets that the Split pre-tokenizer gives for isolated matches.

    A match for each code point costs over a microsecond, so the text is split twice: into matches of ``block`` code
    points, and, only where a unit is asked for, into matches of one. The coarse offsets are the ranks of every
    ``block``-th unit; a unit is its rank within the block counted on from there.
    """

    def __init__(self, block: int = BLOCK) -> None:
        from tokenizers import Regex, pre_tokenizers

        self.block = block
        self.coarse, self.fine = (pre_tokenizers.Split(Regex(p), "isolated") for p in (f"(?m:.{{1,{block}}})", "(?m:.)"))

    def of(self, text: str) -> tuple[int, list]:
        """(number of units, coarse matches)."""
        blocks = self.coarse.pre_tokenize_str(text) if text else []
        return (self.block * (len(blocks) - 1) + len(self.fine.pre_tokenize_str(blocks[-1][0])) if blocks else 0), blocks

    def offset(self, blocks: list, n: int, rank: int) -> int:
        """Where unit ``rank`` starts; the text's end for rank ``n``."""
        if rank == n:
            return blocks[-1][1][1] if blocks else 0
        piece, (start, _) = blocks[rank // self.block]
        return start + self.fine.pre_tokenize_str(piece)[rank % self.block][1][0]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    units = Units()
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text, h1, h2, form in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "h1", "h2", "form")), strict=True):
            n, blocks = units.of(text)
            if form == "plain":
                rows.append((doc_id, n, form, None, None, text))
                continue
            a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
            i, j = units.offset(blocks, n, a), units.offset(blocks, n, b)
            prefix, suffix = PREFIX + text[:i], SUFFIX + text[j:]
            rows.append((doc_id, n, form, a, b - a, (prefix + suffix if form == "psm" else suffix + prefix) + MIDDLE + text[i:j]))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    The cuts and the form come from the sha256 of ``1:`` and the doc_id, so a row's result depends on it alone. A text
    that is empty, holds a mark, or whose third number modulo 100 is ``plain_from`` or more stays plain; of the others
    those whose fourth is below ``spm_below`` put the suffix first. No shuffle.

    A null text is empty; a null doc_id counts as an empty one in the hash; repeated rows come as often as they are there;
    an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (h3 % 100 >= plain_from), "plain").when(h4 % 100 < spm_below, "spm").otherwise("psm")
    chosen = docs.select(doc_id.alias("doc_id"), text.alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    return chosen.mapInArrow(_cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A mark starts with ``<`` and ends with ``>``, so parts without a mark never
    make one with the mark beside them."""
    parts = F.split(output, "<[PSM]>", -1)  # nothing, first part, second part, middle
    first, second, middle = parts[1], parts[2], parts[3]
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))
