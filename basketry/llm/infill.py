"""Fill-in-the-middle training texts: units as Arrow lists, cut by ordinal and joined in another order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.shared import map_batches, portions

#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# A unit is a word with the white space before it, or white space at the end of a text. The bytes of
# characters beyond ASCII are no blanks, so the pattern finds the same units in UTF-8.
_UNIT = rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

# A byte that UTF-8 never holds; it stands between units until they are split.
_BETWEEN = b"\xff"

# Bytes of text that are cut at a time, but for a single longer text.
_BYTES = 32 << 20


def unit_lists(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Units of all texts as a list array of bytes, each list with an empty one at its end, and their number."""
    marked = pc.replace_substring_regex(texts.cast(pa.large_binary()), pattern=_UNIT, replacement=b"\\0" + _BETWEEN)
    units = pc.split_pattern(marked, pattern=_BETWEEN)
    return units, pc.subtract(pc.list_value_length(units), 1)


def _modulo(value: pa.Array, by: pa.Array) -> pa.Array:
    return pc.subtract(value, pc.multiply(pc.divide(value, by), by))


def _pieces(units: pa.Array, n: pa.Array, low: pa.Array, high: pa.Array) -> list[pa.Array]:
    """The units before ``low``, from there to ``high``, and the others, joined per text."""
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    lengths = pc.list_value_length(units)
    first = pc.subtract(pc.cumulative_sum(lengths), lengths)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(first, parent))
    after_low = pc.greater_equal(ordinal, pc.take(low, parent))
    after_high = pc.greater_equal(ordinal, pc.take(high, parent))
    roles = [pc.invert(after_low), pc.and_not(after_low, after_high), after_high]
    # The empty unit at the end of each list is one of the suffix.
    counts = [low, pc.subtract(high, low), pc.add(pc.subtract(n, high), 1)]
    joined = []
    for role, count in zip(roles, counts, strict=True):
        ends = np.concatenate([[0], pc.cumulative_sum(count).to_numpy(zero_copy_only=False)])
        rebuilt = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pc.filter(flat, role))
        joined.append(pc.binary_join(rebuilt, pa.scalar(b"", pa.large_binary())))
    return joined


def _transformed(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = pc.fill_null(batch.column("text"), "")
    units, n = unit_lists(texts)
    n = n.cast(pa.int64())
    cuts = [_modulo(batch.column(h), pc.add(n, 1)) for h in ("_cut1", "_cut2")]
    low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    prefix, middle, suffix = _pieces(units, n, low, high)
    wanted = batch.column("_form")
    unfit = pc.equal(n, 0)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        unfit = pc.or_(unfit, pc.match_substring(texts, mark))
    form = pc.if_else(unfit, "plain", wanted)
    marks = [pa.scalar(m.encode(), pa.large_binary()) for m in (PREFIX, SUFFIX, MIDDLE)]
    nothing = pa.scalar(b"", pa.large_binary())
    psm = pc.binary_join_element_wise(marks[0], prefix, marks[1], suffix, marks[2], middle, nothing)
    spm = pc.binary_join_element_wise(marks[1], suffix, marks[0], prefix, marks[2], middle, nothing)
    plain = pc.equal(form, "plain")
    output = pc.if_else(plain, texts.cast(pa.large_binary()), pc.if_else(pc.equal(form, "spm"), spm, psm))

    def characters(piece: pa.Array) -> pa.Array:
        size = pc.utf8_length(piece.cast(pa.large_string())).cast(pa.int64())
        return pc.if_else(plain, pa.scalar(None, pa.int64()), size)

    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), n, form, characters(prefix), characters(middle), output.cast(pa.large_string()).cast(pa.string())],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def fill_in_middle(docs: DataFrame, seed: int | str = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """Every text cut into prefix, middle and suffix, and put together with marks in another order.

    A keyed hash of ``doc_id`` decides: ``rate`` of 100 texts are changed, ``spm`` of 100 of these to
    the form ``spm`` (suffix, prefix, middle), the others to ``psm`` (prefix, suffix, middle). Two
    further parts of the hash are the cuts, at any units. Batches of texts pass through Arrow kernels
    only: split into lists of units, flattened with their parents, filtered by ordinal, rebuilt and
    joined. Rows stay in their partition; nothing is shuffled.

    Returns doc_id, ``n`` (units), ``form``, ``prefix_chars`` and ``middle_chars`` (null in the form
    ``plain``) and ``output``. A null text is empty; an empty text and one that holds a mark stay plain.
    A text of white space is one unit. A null doc_id is hashed as an empty string; rows with equal
    doc_ids get equal forms. Long texts are cut whole, at most 32 MB of text at a time or one row. Other
    columns, whatever their names, are not read; an empty table gives an empty result.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)

    def part(k: int) -> Column:
        return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")

    form = F.when(part(3) % 100 >= rate, "plain").when(part(4) % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", part(1).alias("_cut1"), part(2).alias("_cut2"), form.alias("_form")
    )

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for portion in portions(batch, _BYTES):
                yield _transformed(portion)

    return map_batches(
        rows, transform, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: Column, form: Column) -> Column:
    """The original text. No mark can arise where pieces meet, so every mark of an output is one that was put in."""
    middle = F.substring_index(output, MIDDLE, -1)
    rest = F.substring_index(output, MIDDLE, 1)
    behind = len(PREFIX) + 1  # marks have the same length

    def halves(between: str) -> tuple[Column, Column]:
        first = F.substring_index(rest, between, 1)
        return first.substr(F.lit(behind), F.length(first)), F.substring_index(rest, between, -1)

    prefix, suffix = halves(SUFFIX)
    suffix_first, prefix_last = halves(PREFIX)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(prefix_last, middle, suffix_first))
        .otherwise(output)
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents transformed, with digests of the outputs and of the texts rebuilt from them."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), parts AS (
  SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS k FROM units
), cuts AS (
  SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS low, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k[3] % 100 >= 50
              THEN 'plain' WHEN k[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM parts
), pieces AS (
  SELECT *, array_to_string(u[1:low], '') AS prefix, array_to_string(u[low + 1:high], '') AS middle,
         array_to_string(u[high + 1:n], '') AS suffix
  FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces
"""
