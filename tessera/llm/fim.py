"""Fill-in-the-middle transformation of whole texts.

A text is cut into units by a ``Split`` pre-tokenizer whose pattern's matches are isolated, so that every
character lies in one unit; nothing is trained and no vocabulary is read. The pre-tokenizer gives the
code-point offsets of the units: the length of the offset array is n, and the offsets at two ranks,
drawn from a hash of the document's id, are the bounds of prefix, middle and suffix. The output puts the
parts behind marks, in the order prefix, suffix, middle (``psm``) or suffix, prefix, middle (``spm``), or
leaves the text as it is (``plain``). ``restored`` turns output and form back into the text.

One pass without a shuffle; a document's result depends on nothing but its id and text, so a task that is
run again gives the same rows. A text is pre-tokenized in stretches of ``STRETCH`` characters that end
where a run of letters does, so the pre-tokenizer's lists are bounded by it (or by one run of letters);
of the rest a document holds 8 bytes a unit, its text and its output.

Defined cases: a null text is an empty one, n = 0 and plain; a text that holds a mark is plain; a null id
is hashed as the empty string; repeated rows and rows with the same id are transformed each on its own;
other columns, whatever their names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import batch, text_rows

UNITS = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Hundredths of the documents that are transformed, and of these that put the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
STRETCH = 1 << 16
#: Characters of output a batch.
OUTPUT = 1 << 23

_LETTERS = re.compile("[A-Za-z]*")


def stretches(text: str, size: int = STRETCH) -> Iterator[tuple[int, str]]:
    """(start, part) of consecutive parts of the text, none of which ends within a run of letters."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if _LETTERS.match(text, end - 1).end() >= end:
            end = _LETTERS.match(text, end).end()
        yield start, text[start:end]
        start = end


def unit_starts(text: str, cut) -> np.ndarray:
    """The offset of every unit's first code point; ``cut`` is the pre-tokenizer."""
    found = [start + np.array([a for _, (a, _) in cut.pre_tokenize_str(part)], np.int64) for start, part in stretches(text)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


_ROWS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])
ROWS = "id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transformer(transformed: int, suffix_first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Regex, pre_tokenizers

        cut = pre_tokenizers.Split(Regex(UNITS), behavior="isolated")
        for rows in batches:
            out, size = [], 0
            hashes = np.stack([rows.column(2 + k).to_numpy() for k in range(4)], axis=1)
            for k in range(rows.num_rows):
                id_, text = rows.column(0)[k].as_py(), rows.column(1)[k].as_py() or ""
                starts = unit_starts(text, cut)
                n = len(starts)
                h1, h2, h3, h4 = hashes[k].tolist()
                if not text or h3 % 100 >= transformed or any(m in text for m in MARKS):
                    out.append((id_, n, "plain", None, None, text))
                else:
                    a, b = (int(starts[r]) if r < n else len(text) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
                    prefix, middle, suffix = text[:a], text[a:b], text[b:]
                    if h4 % 100 < suffix_first:
                        out.append((id_, n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"))
                    else:
                        out.append((id_, n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"))
                size += len(text)
                if size >= OUTPUT:
                    yield batch(_ROWS, *zip(*out))
                    out, size = [], 0
            if out:
                yield batch(_ROWS, *zip(*out))

    return run


def transformed(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: str = "1", percent: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row a document: (id, n, form, prefix_chars, middle_chars, output)."""
    rows = text_rows(documents, id_column, text_column)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    hashes = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    return rows.select("id", "text", *hashes).mapInArrow(transformer(percent, suffix_first), ROWS)


def restored(form: Column, output: Column) -> Column:
    """The text of an output. No mark overlaps another or itself, so the first of each kind is the one that was put there."""
    middle = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring_index(F.substring_index(head, PREFIX, -1), SUFFIX, 1), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, F.substring_index(F.substring_index(head, SUFFIX, -1), PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
