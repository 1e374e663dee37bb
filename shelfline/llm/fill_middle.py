"""Fill-in-the-middle transformation: cuts found by Fenwick trees over fixed blocks of a text.

A unit is a run of white space with the run of other characters after it, or the white space at a
text's end (the fixed pattern UNIT). Two seeded draws choose after how many units the prefix and the
middle end; a third chooses whether the text is transformed at all, a fourth between the two forms:

- ``psm``: <P> prefix <S> suffix <M> middle
- ``spm``: <S> suffix <P> prefix <M> middle
- ``plain``: the text as it is; also for empty texts and those that hold a sentinel.

A text is laid out in blocks of BLOCK bytes of its UTF-8 form. A Fenwick tree over the blocks stores
how many units end and how many code points start in each. Descending the tree by halving steps finds
the block in which the wanted unit ends, with the units and code points before it; the boundary itself
is then located in that block alone. All white space is ASCII, so no boundary splits a code point.

Draws come from the hex SHA-256 of "<seed>:<doc_id>", so any task gives the same result for a row.
``transform`` keeps the columns of its input and adds the output and the parts; ``restored`` rebuilds
the exact text from output and form alone.

Cases: null text counts as empty; a null doc_id draws as the text "null"; rows that share a doc_id
draw alike, each on its own text; an empty table gives no rows; columns that clash with added ones are
replaced; others stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfline.llm.common import in_batches, portions, table, utf8

#: Sentinels and the unit pattern.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SEED = 42
#: Percent of texts transformed, and of those in suffix-first form.
RATE, SUFFIX_FIRST = 50, 80
#: Bytes of a block.
BLOCK = 512
PLAIN, PSM, SPM = "plain", "psm", "spm"
ADDED = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"
#: Bytes that are white space.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Whether a unit of the text ends behind each byte."""
    space = SPACES[data]
    ends = ~space
    ends[:-1] &= space[1:]
    if len(ends):
        ends[-1] = True
    return ends


class Blocks:
    """A text's blocks with a Fenwick tree of (unit ends, code points)."""

    def __init__(self, text: bytes) -> None:
        data = np.frombuffer(text, np.uint8)
        self.ends = unit_ends(data)
        self.heads = (data & 0xC0) != 0x80
        at = np.arange(0, len(data), BLOCK)
        counts = [np.add.reduceat(x, at, dtype=np.int64).tolist() if len(data) else [] for x in (self.ends, self.heads)]
        self.units, self.points = [0, *counts[0]], [0, *counts[1]]
        self.n, self.n_points = sum(counts[0]), sum(counts[1])
        self.size = len(at)
        for i in range(1, self.size + 1):
            above = i + (i & -i)
            if above <= self.size:
                self.units[above] += self.units[i]
                self.points[above] += self.points[i]

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) of the first k units."""
        if k <= 0:
            return 0, 0
        block, left, points = 0, k, 0
        step = 1 << self.size.bit_length() >> 1
        while step:
            below = block + step
            if below <= self.size and self.units[below] < left:
                block, left, points = below, left - self.units[below], points + self.points[below]
            step >>= 1
        start = block * BLOCK
        within = int(np.flatnonzero(self.ends[start : start + BLOCK])[left - 1]) + 1
        return start + within, points + int(np.count_nonzero(self.heads[start : start + within]))


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def chosen_form(text: bytes, h3: int, h4: int, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> str:
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return PLAIN
    return SPM if h4 % 100 < suffix_first else PSM


def assembled(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == PSM:
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def restored(output: bytes, form: str) -> bytes:
    """The text that was transformed, from output and form alone.

    No sentinel has a `<` behind its first byte, so none can begin in a part and end in a sentinel.
    """
    if form == PLAIN:
        return output
    first, second = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    head, middle = output[len(first) :].split(MIDDLE)
    one, two = head.split(second)
    prefix, suffix = (one, two) if form == PSM else (two, one)
    return prefix + middle + suffix


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars, the output, and both digests of output and restored text."""
    added = StructType.fromDDL(ADDED).names
    kept = docs.drop(*added)
    shape = StructType([*kept.schema.fields, *StructType.fromDDL(ADDED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), utf8(part.column("text"))):
                text = text or b""
                blocks = Blocks(text)
                h1, h2, h3, h4 = draws(doc_id, seed)
                form, output, sizes = chosen_form(text, h3, h4, rate, suffix_first), text, (None, None)
                if form != PLAIN:
                    (a, before), (b, upto) = (blocks.cut(k) for k in sorted((h1 % (blocks.n + 1), h2 % (blocks.n + 1))))
                    output, sizes = assembled(form, text[:a], text[a:b], text[b:]), (before, upto - before)
                digests = [hashlib.sha256(x).hexdigest() for x in (output, restored(output, form))]
                rows.append((blocks.n, form, *sizes, output, *digests))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            arrays[4] = arrays[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, *added])

    return in_batches(kept, run, shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


#: Lists of units in place of trees; the draws are those of the contract.
CHECK = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units
  FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS k1,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS k2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT doc_id, text, n, form,
    coalesce(array_to_string(units[1:least(k1, k2)], ''), '') AS p,
    coalesce(array_to_string(units[least(k1, k2) + 1:greatest(k1, k2)], ''), '') AS m,
    coalesce(array_to_string(units[greatest(k1, k2) + 1:], ''), '') AS s
  FROM drawn
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
