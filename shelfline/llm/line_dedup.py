"""Fuzzy line deduplication: keys of n-gram minima of normalised lines, verified edit similarity.

A line is normalised to its words in lower case with digits as 0; lines without a word are left alone.
Two normalised lines are linked if they are equal, or if their edit similarity,
1 - distance / longer length, is at least SIMILAR. Of each connected group the first occurrence stays,
by (doc_id, text, line number); all others are removed, everything else of a document stays as it is.

Cuts of one SimHash cannot find such lines: an edit similarity of 0.9 moves so many of its bits that
blocks which still agree are too short to tell lines apart. Lines therefore meet under BANDS keys, each
of a few minima of their hashed character n-grams; the README has the recall of both. What follows is
the usual way: join on the keys, verify the edit similarity, keep one line of each connected group.

- Only distinct lines are keyed. Keys move packed by bucket; those of a single line end in the task that sorts them.
- Every line of a key is paired with the key's least line. These pairs are made distinct over all keys,
  joined with their texts once and verified: first by counts of letter pairs, then by edit distance.
- That settles keys of two lines, and keys whose lines are connected by now. Lines of the others are
  compared among themselves in cells of at most CELL_BYTES of text on a side, so no key is a single
  task's work; only pairs that are not yet connected are looked at, each under the least key it shares, and
  links are as many as joined groups.

A pair that shares no key is missed unless other lines connect it; the README states how many are.

Cases: null text stays null and has no lines; empty lines stay; rows without doc_id take part and come
after all others; rows that share a doc_id are told apart by their texts, rows alike in both are one
document and keep the same lines; an empty table gives no rows; other columns stay, and n_chars, where
there is one, becomes the length of the new text.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import components, in_batches, portions, table, written

WORD = re.compile(r"\w+")
DIGIT = re.compile(r"\d")
APART = re.compile(r"[^\w\n]")
SIMILAR = 0.9
#: Keys of a line and, for lines of at least 0.9 * BRIEF characters, n-gram length and minima in a key.
BANDS, GRAM, BAND_ROWS = 12, 8, 3
#: The same for lines of up to BRIEF characters; lines of about BRIEF have both, so any two similar lines have one sort alike.
BRIEF, BRIEF_GRAM, BRIEF_ROWS = 60, 3, 4
#: Lines a task remembers to have sent already; it only saves work.
REMEMBERED = 500_000
#: Bytes of text on one side of a cell.
CELL_BYTES = 1 << 19
#: Counters of letter pairs by which dissimilar texts of a list are told apart before any is compared.
COUNTERS = 256
#: The same where many pairs are compared together, and how far each counts.
MARKS, LEVELS = 512, 2
#: Characters and lines of the cells that are worked through together.
GROUP_BYTES, GROUP_LINES = 4 << 20, 1 << 15
#: Pairs that are compared together, lines on a side of a block of pairs of a larger cell than SMALL.
PAIRS, BLOCK, SMALL = 4096, 1024, 128
#: Bytes of the tables of letters of pairs that are compared together, characters looked at together for a common start or end.
TABLES, STEP = 32 << 20, 32
#: Columns of the bands that are worked through before pairs that are settled leave.
COLUMNS = 32
#: Letters told apart, the fewest pairs for which comparing them together pays unless texts are longer than so many characters, pairs of any length that go together.
LETTERS, FEW, LENGTHY, MANY = 128, 3, 1000, 256
#: Bytes of text whose keys are found at once, keys that are packed at once, and the buckets they are packed by.
KEY_BYTES, PACKED, BUCKETS = 1 << 18, 1 << 20, 4096
#: Bits of the filter of lines that share a key.
FILTER_BITS = 1 << 23


def normal_words(line: str) -> list[str]:
    return WORD.findall(DIGIT.sub("0", line.lower()))


@cache
def plain_codes(size: int) -> np.ndarray:
    """What each of the first characters becomes: digits 0, what is neither of a word nor an end of line a space."""
    every = "".join(map(chr, range(size)))
    return np.frombuffer(DIGIT.sub("0", APART.sub(" ", every)).encode("utf-32-le", "surrogatepass"), np.uint32)


@cache
def plain_bytes() -> bytes:
    return plain_codes(256).astype(np.uint8).tobytes()


def normal_lines(text: str) -> list[str]:
    """The words of each line, joined by a space, as `normal_words` finds them."""
    lower = text.lower()
    if lower.isascii():
        plain = lower.encode().translate(plain_bytes()).decode()
    else:
        codes = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = plain_codes(1 << 16 if codes.max() < 1 << 16 else sys.maxunicode + 1)[codes]
        plain = codes.tobytes().decode("utf-32-le", "surrogatepass")
    while "  " in plain:
        plain = plain.replace("  ", " ")
    return [line.strip(" ") for line in plain.split("\n")]


def line_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, pos, line, check, norm) of the lines that have a word.

    `line` and `check` are the halves of a 128-bit hash of the normalised line; `norm` is that line, or
    null where this task has sent it before.
    """
    sent: set[bytes] = set()
    for part in portions(batches, "text"):
        if len(sent) > REMEMBERED:
            sent.clear()
        ids, rows, places, hashes, norms = [], [], [], [], []
        for doc_id, row, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "row", "text"))):
            for pos, norm in enumerate(normal_lines(text)):
                if not norm:
                    continue
                code = xxhash.xxh3_128_digest(norm.encode("utf-8", "surrogatepass"))
                ids.append(doc_id)
                rows.append(row)
                places.append(pos)
                hashes.append(code)
                norms.append(None if code in sent else norm)
                sent.add(code)
        halves = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)[:, ::-1]
        arrays = [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(places, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(norms, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "pos", "line", "check", "norm"])


def gram_minima(texts: list[str], n: int, bins: int, memory: list[np.ndarray]) -> np.ndarray:
    """Least hash of a text's n-grams in each of so many bins; an empty bin takes the next one's.

    `memory` holds what the next call writes to again: fresh memory costs more than the arithmetic.
    """
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    flat = np.frombuffer("".join(f"\n{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size, total = len(flat), len(flat) + 2 * n
    if not memory or memory[0].shape[1] < total:
        memory[:] = [np.empty((5, total), np.uint64)]
    run, other, grams, spare, owner = memory[0][:, :total]
    run[:size], run[size:] = flat, 0
    run += np.uint64(1)
    grams[:] = 0
    # Runs of 2, 4, 8 ... characters from two of half their length each; n is made up of these.
    place, step, left_over, power = 0, 1, n, 0x100000001B3
    while True:
        if left_over & 1:
            grams[:size] *= np.uint64(power)
            grams[:size] += run[place : place + size]
            place += step
        left_over >>= 1
        if not left_over:
            break
        np.multiply(run, np.uint64(power), out=other)
        other[:-step] += run[step:]
        run, other = other, run
        step, power = 2 * step, power * power % (1 << 64)
    grams, spare = grams[:size], spare[:size]
    for shift, mix in ((29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB), (31, 1)):
        np.right_shift(grams, np.uint64(shift), out=spare)
        grams ^= spare
        if mix > 1:
            grams *= np.uint64(mix)
    np.floor_divide(grams, np.uint64(bins), out=spare)
    spare *= np.uint64(bins)
    np.subtract(grams, spare, out=spare)
    # The last n - 1 places start no gram. Texts too short for one have no similar text but their equals.
    ends = np.cumsum(sizes)
    owner = owner[:size]
    owner[:] = 0
    owner[ends[:-1]] = bins
    spare += np.cumsum(owner, out=owner)
    for k in range(1, n):
        grams[(ends - k)[sizes > k]] = np.iinfo(np.uint64).max
    least = np.full(len(texts) * bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, spare.view(np.int64), grams)
    least = least.reshape(-1, bins)
    empty = least == np.iinfo(np.uint64).max
    at = np.where(empty, 2 * bins, np.arange(bins))
    following = np.minimum.accumulate(np.concatenate((at, at + bins), axis=1)[:, ::-1], axis=1)[:, ::-1][:, :bins] % bins
    # A minimum that was taken over tells how far it came, else one gram would count as many.
    away = (following - np.arange(bins)) % bins
    return np.take_along_axis(least, following, axis=1) + away.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, keys) of each line; lines of about BRIEF characters have two rows."""
    memory: list[np.ndarray] = []
    for part in portions(batches, "norm", KEY_BYTES):
        ids, texts = part.column("line").to_numpy(), part.column("norm").to_pylist()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        for n, width, chosen in ((GRAM, BAND_ROWS, sizes >= int(SIMILAR * BRIEF)), (BRIEF_GRAM, BRIEF_ROWS, sizes <= BRIEF)):
            at = np.flatnonzero(chosen)
            if not len(at):
                continue
            # A key's bins lie far apart, as neighbours of a short text may have taken over one minimum.
            minima = gram_minima([texts[i] for i in at.tolist()], n, BANDS * width, memory).reshape(len(at), width, BANDS)
            values = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(BANDS * n), (len(at), BANDS)).copy()
            for k in range(width):
                values = (values ^ minima[:, k]) * np.uint64(0x9E3779B97F4A7C15)
                values ^= values >> np.uint64(32)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), keys], ["line", "keys"])


def packed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, packed): the keys of many lines, each followed by its line, by bucket."""
    held: list[np.ndarray] = []
    for part in line_keys(batches):
        keys, line = part.column("keys"), part.column("line").to_numpy()
        held.append(np.stack((keys.flatten().to_numpy(), np.repeat(line, np.diff(keys.offsets.to_numpy()))), axis=1))
        if sum(map(len, held)) >= PACKED:
            yield in_buckets(np.concatenate(held))
            held = []
    if held:
        yield in_buckets(np.concatenate(held))


def in_buckets(rows: np.ndarray) -> pa.RecordBatch:
    bucket = (rows[:, 0].view(np.uint64) % np.uint64(BUCKETS)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    known, starts = np.unique(bucket[order], return_index=True)
    packed, cuts = rows[order].tobytes(), [*(16 * starts).tolist(), 16 * len(rows)]
    return pa.RecordBatch.from_arrays([pa.array(known, pa.int32()), pa.array([packed[i:j] for i, j in zip(cuts, cuts[1:])], pa.binary())], ["bucket", "packed"])


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, line, least, n, lot) of the keys that several lines share, of rows (bucket, packed).

    `least` is the least line of the key, n counts its lines, and keys with the same lines have one lot.
    """
    rows = [np.frombuffer(b"".join(b.column("packed").to_pylist()), np.int64).reshape(-1, 2) for b in batches]
    if not sum(map(len, rows)):
        return
    value, line = np.concatenate(rows).T.copy()
    rows.clear()
    order = np.argsort(value)
    value, line = value[order], line[order]
    edge = value[1:] != value[:-1]
    alone = np.concatenate(([True], edge)) & np.concatenate((edge, [True]))
    value, line = value[~alone], line[~alone]
    order = np.lexsort((line, value))
    value, line = value[order], line[order]
    # Several tasks may send a line.
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (line[1:] != line[:-1])))[: len(value)]
    value, line = value[new], line[new]
    if not len(value):
        return
    starts = np.concatenate(([0], np.flatnonzero(value[1:] != value[:-1]) + 1))
    sizes = np.diff(np.concatenate((starts, [len(value)])))
    mixed = line.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    lot = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), starts).view(np.int64)
    kept = np.repeat(sizes > 1, sizes)
    found = (value, line, np.repeat(line[starts], sizes), np.repeat(sizes, sizes), np.repeat(lot, sizes))
    yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in found], ["value", "line", "least", "n", "lot"])


def pair_counts(texts: list[str], counters: int = COUNTERS) -> np.ndarray:
    """Counts of letter pairs of each text; a single edit changes at most four of them by one."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    own = np.repeat(np.arange(len(texts)), sizes)
    inside = own[1:] == own[:-1]
    cells = own[:-1] * counters + (flat[:-1] * 1009 + flat[1:]) % counters
    return np.bincount(cells[inside], minlength=len(texts) * counters).reshape(-1, counters).astype(np.int32)


class Likely:
    """Which texts of a list may be similar to one: by length and by letter pairs, never wrongly not."""

    def __init__(self, texts: list[str]) -> None:
        self.counts, self.lengths = pair_counts(texts), np.array([len(t) for t in texts], np.int64)

    def to(self, i: int, at: np.ndarray) -> np.ndarray:
        """Whether the texts at these places may be similar to text i."""
        most = ((1 - SIMILAR) * np.maximum(self.lengths[at], self.lengths[i]) + 1e-9).astype(np.int64)
        found = np.abs(self.lengths[at] - self.lengths[i]) <= most
        held = at[found]
        if len(held):
            found[found] = np.abs(self.counts[held] - self.counts[i]).sum(axis=1) <= 4 * most[found]
        return found


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, by bit-parallel columns over whole numbers; most + 1 if it is above most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, distance = every, 0, len(a)
    for left_over, c in zip(range(len(b) - 1, -1, -1), b):
        equal = at.get(c, 0)
        diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
        right = minus | (every & ~(diagonal | plus))
        left = plus & diagonal
        distance += bool(right & top) - bool(left & top)
        # Each column behind this one takes off one at most.
        if distance - left_over > most:
            return most + 1
        right = (right << 1 | 1) & every
        plus = ((left << 1) & every) | (every & ~(diagonal | right))
        minus = right & diagonal
    return distance


class Texts:
    """Texts of which many pairs are compared at once, by columns of all pairs' edit tables."""

    def __init__(self, texts: list[str]) -> None:
        self.texts, self.lengths = texts, np.fromiter(map(len, texts), np.int64, len(texts))
        self.flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        # A count as that many ones, up to LEVELS: texts differ in no more places than their counts do in sum.
        self.marks = np.zeros((len(texts), MARKS * LEVELS), np.uint8)
        for k in range(0, len(texts), BLOCK):
            counts = pair_counts(texts[k : k + BLOCK], MARKS)
            self.marks[k : k + BLOCK] = np.concatenate([counts > level for level in range(LEVELS)], axis=1)
        self.total = self.marks.sum(axis=1, dtype=np.int64)
        found = np.zeros(int(self.flat.max(initial=0)) + 1, bool)
        found[self.flat] = True
        # Rarer characters than the first so many share a number; pairs of texts with such ones are compared once more.
        known = np.flatnonzero(found)
        self.letters = min(len(known), LETTERS)
        number = np.zeros(len(found), np.int64)
        often = np.argsort(-np.bincount(self.flat, minlength=len(found))[known], kind="stable") if len(known) > LETTERS else slice(None)
        number[known[often]] = np.minimum(np.arange(len(known)), LETTERS - 1)
        self.codes = number[self.flat]
        self.shared = np.zeros(len(texts), bool)
        if len(known) > LETTERS:
            self.shared[np.repeat(np.arange(len(texts)), self.lengths)[self.codes == LETTERS - 1]] = True

    def most(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return ((1 - SIMILAR) * np.maximum(self.lengths[one], self.lengths[two]) + 1e-9).astype(np.int64)

    def likely(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether pairs of texts may be similar: by length and by letter pairs, never wrongly not."""
        most = self.most(one, two)
        found = np.abs(self.lengths[one] - self.lengths[two]) <= most
        at = np.flatnonzero(found)
        for k in range(0, len(at), PAIRS):
            some = at[k : k + PAIRS]
            found[some] = (self.marks[one[some]] ^ self.marks[two[some]]).sum(axis=1, dtype=np.int64) <= 4 * most[some]
        return found

    def may(self, starts: np.ndarray, apart: np.ndarray, label: np.ndarray, joined: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of texts of a cell that may be similar, of different labels as joined by then.

        Texts of one cell with the same `apart` are not compared, unless that is -1.
        """

        def open_pairs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
            return (joined[label[one]] != joined[label[two]]) & ((apart[one] != apart[two]) | (apart[one] < 0))

        sizes, small = np.diff(starts), []
        for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
            i, j = np.triu_indices(size, 1)
            cells = starts[:-1][sizes == size]
            step = max(1, 64 * PAIRS // len(i))
            for k in range(0, len(cells), step):
                one, two = (np.add.outer(cells[k : k + step], x).ravel() for x in (i, j))
                new = open_pairs(one, two)
                one, two = one[new], two[new]
                new = self.likely(one, two)
                small.append((one[new], two[new]))
        if small:
            yield tuple(np.concatenate(side) for side in zip(*small))
        for start, size in zip(starts[:-1][sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            for i in range(start, start + size, BLOCK):
                rows = np.arange(i, min(i + BLOCK, start + size))
                marks = self.marks[rows].astype(np.float32)
                for j in range(i, start + size, BLOCK):
                    columns = np.arange(j, min(j + BLOCK, start + size))
                    both = marks @ self.marks[columns].T.astype(np.float32)
                    longer = np.maximum.outer(self.lengths[rows], self.lengths[columns])
                    near = self.total[rows][:, None] + self.total[columns] - 2 * both <= 4 * ((1 - SIMILAR) * longer + 1e-9).astype(np.int64)
                    one, two = np.nonzero(np.triu(near, 1) if i == j else near)
                    one, two = rows[one], columns[two]
                    new = open_pairs(one, two) & (np.abs(self.lengths[one] - self.lengths[two]) <= self.most(one, two))
                    yield one[new], two[new]

    def similar(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether the texts of each pair are similar."""
        swap = self.lengths[one] > self.lengths[two]
        short, long = np.where(swap, two, one), np.where(swap, one, two)
        most, found = self.most(one, two), np.zeros(len(one), bool)
        # What both begin or end with leaves the distance as it is.
        ahead = self.alike(short, long, 0)
        behind = self.alike(short, long, ahead, -1)
        starts, short_left, long_left = (np.stack(x) for x in ((self.starts[short] + ahead, self.starts[long] + ahead), (self.lengths[short], self.lengths[short] - ahead - behind), (self.lengths[long], self.lengths[long] - ahead - behind)))
        short_left, long_left = short_left[1], long_left[1]
        found[:] = long_left <= most
        # A shorter text of up to 64 characters is one word; for others a band of so many words around the diagonal is
        # enough: whoever leaves it for the farther side and comes back takes 64 * words - difference steps.
        words = np.where(short_left <= 64, 0, (most + long_left - short_left) // 64 + 1)
        whole = (words > 0) & (long_left < 32 * words)
        starts[:, whole] = self.starts[short[whole]], self.starts[long[whole]]
        short_left[whole], long_left[whole] = self.lengths[short[whole]], self.lengths[long[whole]]
        open_pairs = ~found
        # Most distances are much smaller than they may be: a narrow band proves them whatever the length.
        width, most_words = 0, int(words[open_pairs].max(initial=-1))
        while width <= most_words:
            wider = 4 * width or 1
            last = open_pairs & (words >= width) & (words < wider)
            tries = [(last & (words == w), w, True) for w in np.unique(words[last]).tolist()]
            if wider < most_words:
                tries.append((open_pairs & (words > wider) & (long_left - short_left < 32 * wider) & (long_left >= 32 * wider), wider, False))
            for chosen, w, sure in tries:
                for some in self.together(np.flatnonzero(chosen), long_left, w):
                    if len(some) >= FEW or long_left[some[-1]] > LENGTHY:
                        spans = starts[0, some], short_left[some], starts[1, some], long_left[some], most[some]
                        found[some] = self.in_band(*spans, w) if w else self.close(*spans)
                    elif sure:
                        self.one_by_one(some, short, long, most, found)
            open_pairs &= ~found & ~last
            width = wider
        # Characters that share a number look alike.
        self.one_by_one(np.flatnonzero(found & self.shared[short] & self.shared[long]), short, long, most, found)
        return found

    def one_by_one(self, at: np.ndarray, short: np.ndarray, long: np.ndarray, most: np.ndarray, found: np.ndarray) -> None:
        for p in at.tolist():
            found[p] = edit_distance(self.texts[short[p]], self.texts[long[p]], int(most[p])) <= most[p]

    def alike(self, short: np.ndarray, long: np.ndarray, taken: np.ndarray | int, way: int = 1) -> np.ndarray:
        """How many characters both texts of each pair begin with, or, the other way, end with behind those taken."""
        left_over = self.lengths[short] - taken
        count, at = np.zeros(len(short), np.int64), np.flatnonzero(left_over > 0)
        one, two = (self.starts[x] if way > 0 else self.starts[x] + self.lengths[x] - 1 for x in (short, long))
        step = np.arange(STEP)
        while len(at):
            inside = step < (left_over[at] - count[at])[:, None]
            same = [self.flat.take((x[at] + way * count[at])[:, None] + way * step, mode="clip") for x in (one, two)]
            same = (same[0] == same[1]) & inside
            run = np.where(same.all(axis=1), STEP, same.argmin(axis=1))
            count[at] += run
            at = at[run == STEP]
        return count

    def together(self, at: np.ndarray, long: np.ndarray, width: int) -> Iterator[np.ndarray]:
        """The pairs at these places by length, as many at once as keep their tables of letters small."""
        at = at[np.argsort(long[at], kind="stable")]
        sizes = 8 * self.letters * (long[at] // 64 + 2 * width + 2 if width else np.ones(len(at), np.int64))
        while len(at):
            step = int(np.searchsorted(sizes * np.arange(1, len(at) + 1), TABLES, "right"))
            # Texts of about one length turn from the diagonal together; few pairs are better not cut up.
            alike = int(np.searchsorted(long[at], 1.25 * long[at[0]] + 32, "right"))
            step = min(PAIRS, max(1, min(step, max(alike, MANY))))
            yield at[:step]
            at, sizes = at[step:], sizes[step:]

    def letter_bits(self, starts: np.ndarray, m: np.ndarray, width: int, shift: int = 0) -> np.ndarray:
        """For each word, text and letter a bit for every place of the letter, `shift` bits up; texts start there and are so long."""
        owner = np.repeat(np.arange(len(m)), m)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
        letter = self.codes[np.repeat(starts, m) + within]
        within = within + shift
        bits = np.zeros((width, len(m) * self.letters), np.uint64)
        place = (within >> 6) * (len(m) * self.letters) + owner * self.letters + letter
        np.add.at(bits.reshape(-1), place, np.uint64(1) << (within & 63).astype(np.uint64))
        return bits

    def close(self, short: np.ndarray, m: np.ndarray, long: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether each pair is within its distance, by the columns of `edit_distance`; the shorter texts have 64 characters at most."""
        order = np.argsort(-n, kind="stable")
        starts, m, n = long[order], m[order], n[order]
        bits = self.letter_bits(short[order], m, 1)[0]
        base, top = np.arange(len(m)) * self.letters, np.uint64(1) << (np.maximum(m, 1) - 1).astype(np.uint64)
        plus, minus, score, one = np.full(len(m), (1 << 64) - 1, np.uint64), np.zeros(len(m), np.uint64), m.copy(), np.uint64(1)
        for column in range(int(n[0])):
            live = int(np.searchsorted(-n, -column, "left"))
            p, q = plus[:live], minus[:live]
            eq = bits.take(base[:live] + self.codes[starts[:live] + column])
            diagonal = (((eq & p) + p) ^ p) | eq | q
            right, left = q | ~(diagonal | p), p & diagonal
            score[:live] += ((right & top[:live]) != 0).view(np.int8) - ((left & top[:live]) != 0).view(np.int8)
            right = (right << one) | one
            plus[:live], minus[:live] = (left << one) | ~(diagonal | right), right & diagonal
        result = np.zeros(len(order), bool)
        # A text without characters is as far as the other is long.
        result[order] = np.where(m > 0, score, n) <= most[order]
        return result

    def in_band(self, short: np.ndarray, n: np.ndarray, long: np.ndarray, m: np.ndarray, most: np.ndarray, words: int) -> np.ndarray:
        """Whether each pair is within its distance by steps of less than 32 * words from the diagonal.

        A yes always holds, a no if distance and difference in length make up less than 64 * words at most.
        The shorter texts have more than 64 characters.

        Hyyro's band of 64 * words diagonals: first the distance along the lowest, then along the last row.
        All pairs' bands lie side by side in one whole number, each with a free byte that takes its carry.
        """
        band, wide, order = 32 * words - 1, 8 * words + 1, np.argsort(-n, kind="stable")
        result = np.zeros(len(order), bool)
        most, starts, n, m = most[order], short[order], n[order], m[order]
        bits = self.letter_bits(long[order], m, int(m.max()) // 64 + 2 * words + 2, 32 * words)
        base, score, turn = np.arange(len(m)) * self.letters, np.full(len(m), band, np.int64), m - band
        field = (1 << 64 * words) - 1
        plus, minus = np.tile(bytes_of([field ^ (field >> band + 1)], wide), (len(m), 1)), np.zeros((len(m), wide), np.uint8)
        for begin in range(0, int(n[0]), COLUMNS):
            columns = np.arange(begin, begin + COLUMNS)[:, None]
            at = base + self.codes.take(starts + columns, mode="clip")
            low, high = (columns & 63).astype(np.uint64), begin >> 6
            held = bits[high : high + words + 1].take(at, axis=1)
            eq = held[:-1] >> low
            eq |= held[1:] << (np.uint64(63) - low) << np.uint64(1)
            eqs = np.zeros((COLUMNS, len(n), wide), np.uint8)
            eqs[:, :, :-1] = np.ascontiguousarray(eq.transpose(1, 2, 0)).view(np.uint8)
            every = int.from_bytes(bytes_of([field], wide).tobytes() * len(n), "little")
            ones = int.from_bytes(bytes_of([1], wide).tobytes() * len(n), "little")
            row, marked = 0, self.places(columns, turn, n, words, wide) if begin + COLUMNS > np.minimum(turn, n).min() else ()
            p, q = (int.from_bytes(x.tobytes(), "little") for x in (plus, minus))
            level = up = down = 0
            for k in range(min(COLUMNS, int(n[0]) - begin)):
                if marked:
                    ones, row = (int.from_bytes(x[k].tobytes(), "little") for x in marked)
                eq = int.from_bytes(eqs[k].tobytes(), "little")
                diagonal = ((((eq & p) + p) ^ p) | eq | q) & every
                right = q | (every ^ (diagonal | p))
                left = p & diagonal
                level += (diagonal >> 64 * words - 1) & ones
                if row:
                    # The place is another one in each column.
                    up |= right & row
                    down |= left & row
                diagonal = (diagonal >> 1) & every
                p = left | (every ^ (diagonal | right))
                q = diagonal & right
            plus, minus, level, up, down = (np.frombuffer(x.to_bytes(wide * len(n), "little"), np.uint8).reshape(-1, wide) for x in (p, q, level, up, down))
            done = np.clip(np.minimum(turn, n) - begin, 0, COLUMNS)
            score = score + done - level[:, 0] + np.bitwise_count(up).sum(axis=1, dtype=np.int64) - np.bitwise_count(down).sum(axis=1, dtype=np.int64)
            ended = n <= begin + COLUMNS
            result[order[ended]] = score[ended] <= most[ended]
            # Along the diagonal the distance never falls, behind it by one a column at most.
            keep = ~ended & (score - (n - np.maximum(begin + COLUMNS, turn)) <= most)
            if not keep.any():
                break
            order, m, n, most, base, starts, score, turn, plus, minus = (v[keep] for v in (order, m, n, most, base, starts, score, turn, plus, minus))
        return result

    def places(self, columns: np.ndarray, turn: np.ndarray, n: np.ndarray, words: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """For each column the lowest bit of the pairs before their turn, and for those behind it the last row's place."""
        ones, row = np.zeros((2, len(columns), len(n), wide), np.uint8)
        ones[:, :, 0] = columns < np.minimum(turn, n)
        at, behind = np.nonzero((columns >= turn) & (columns < n))
        # It falls by one a column.
        place = 64 * words - 2 - (columns[at, 0] - turn[behind])
        row[at, behind, place >> 3] = 1 << (place & 7)
        return ones, row


def bytes_of(numbers: list[int], wide: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_bytes(wide, "little") for x in numbers), np.uint8)


def cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between lines of a cell that have different roots, as few as connect what is similar.

    Rows come sorted by cell (value, x, y). A cell holds one part of a key's lines, or two whose lines
    are compared across only. Lines that share several keys are compared under the least of them. Many
    small cells are worked through together.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cells = [batch.column(c).to_numpy() for c in ("value", "x", "y")]
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cells], axis=0)) + 1
        # The last cell of a batch may go on in the next one.
        if held and tuple(c[0] for c in cells) != tuple(held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in ("value", "x", "y")):
            yield from whole_cells(held)
            held = []
        if len(edges):
            yield from whole_cells([*held, batch.slice(0, edges[-1])])
            held = []
        held.append(batch.slice(edges[-1] if len(edges) else 0))
    if held:
        yield from whole_cells(held)


def top_of(joined: np.ndarray, label: int) -> int:
    while joined[label] != label:
        label = joined[label]
    return label


def whole_cells(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches)
    value, x, y, ids, part, roots = (rows.column(c).to_numpy() for c in ("value", "x", "y", "line", "part", "root"))
    texts, keys = rows.column("norm").to_pylist(), [set(k) for k in rows.column("keys").to_pylist()]
    starts = np.concatenate(([0], np.flatnonzero((value[1:] != value[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1, [len(ids)])).tolist()
    ends, links, group = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))), [], 0
    known, label = np.unique(roots, return_inverse=True)
    joined = np.arange(len(known))
    while group + 1 < len(starts):
        # As many cells as hold some text together, or one: many pairs are compared together.
        first, taken = starts[group], group + 1
        while taken + 1 < len(starts) and starts[taken + 1] - first <= GROUP_LINES and ends[starts[taken + 1]] - ends[first] <= GROUP_BYTES:
            taken += 1
        held, stop = Texts(texts[first : starts[taken]]), starts[taken]
        apart = np.where(x != y, part, -1)[first:stop]
        for one, two in held.may(np.array(starts[group : taken + 1]) - first, apart, label[first:stop], joined):
            here = [min(keys[i] & keys[j]) == v for i, j, v in zip((one + first).tolist(), (two + first).tolist(), value[one + first].tolist())]
            one, two = one[here], two[here]
            for at in range(0, len(one), PAIRS):
                a, b = one[at : at + PAIRS], two[at : at + PAIRS]
                # What an earlier pair connected is left out.
                while (joined != joined[joined]).any():
                    joined[:] = joined[joined]
                new = joined[label[first + a]] != joined[label[first + b]]
                a, b = a[new], b[new]
                near = held.similar(a, b)
                for i, j in zip((a[near] + first).tolist(), (b[near] + first).tolist()):
                    low, high = top_of(joined, label[i]), top_of(joined, label[j])
                    if low != high:
                        links.append((ids[j], ids[i]))
                        joined[high] = low
        group = taken
    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (a, b, a_norm, b_norm) whose texts are similar."""
    for part in portions(portions(batches, "a_norm", 4 << 20), "b_norm", 4 << 20):
        n = part.num_rows
        held = Texts([*part.column("a_norm").to_pylist(), *part.column("b_norm").to_pylist()])
        one = np.arange(n)
        one = one[held.likely(one, one + n)]
        kept = one[held.similar(one, one + n)]
        yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(kept, pa.int64())) for c in "ab"], ["a", "b"])


def near_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    one, two = (texts.select(F.col("line").alias(f"{k}_line"), F.col("norm").alias(f"{k}_norm")) for k in "ab")
    both = pairs.join(one, F.col("a") == F.col("a_line")).join(two, F.col("b") == F.col("b_line"))
    longer, shorter = (f(F.char_length("a_norm"), F.char_length("b_norm")) for f in (F.greatest, F.least))
    both = both.where(longer - shorter <= (1 - SIMILAR) * longer + 1e-9)
    return in_batches(both.select("a", "b", "a_norm", "b_norm"), verified, "a long, b long")


def perhaps(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose line may be among `wanted` (asked), by one bit for each; it only keeps others from moving.

    The bits are FILTER_BITS / 64 rows at most, whatever the input: safe to broadcast.
    """
    word, bit = (lambda c: F.shiftright(F.pmod(c, F.lit(FILTER_BITS)), 6)), (lambda c: F.expr(f"shiftleft(1L, cast({c} & 63 as int))"))
    bits = wanted.groupBy(word(F.col("asked")).alias("word")).agg(F.bit_or(bit("asked")).alias("bits"))
    held = rows.join(F.broadcast(bits), word(F.col("line")) == F.col("word"))
    return held.where(F.col("bits").bitwiseAND(bit("line")) != 0).select(*rows.columns)


def in_cells(runs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) among the lines of each key; runs are rows (value, line, root)."""
    own = runs.groupBy("line").agg(F.collect_list("value").alias("keys"), F.min("root").alias("root"))
    members = own.join(texts.withColumnRenamed("line", "of_line"), F.col("line") == F.col("of_line"))
    members = members.select(F.explode("keys").alias("value"), "line", "root", "norm", "keys")
    sizes = members.groupBy(F.col("value").alias("of_value")).agg(F.ceil(F.sum(F.octet_length("norm")) / CELL_BYTES).alias("k"))
    dealt = members.join(sizes, F.col("value") == F.col("of_value")).withColumn("part", F.pmod(F.xxhash64("line", "value"), F.col("k")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
    dealt = dealt.select("value", "line", "root", "norm", "keys", "part", other.alias("other"))
    dealt = dealt.select("value", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "line", "root", "norm", "keys", "part")
    dealt = dealt.repartition("value", "x", "y").sortWithinPartitions("value", "x", "y", "line")
    return in_batches(dealt, cell_links, "a long, b long")


def line_links(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Links (a, b) that connect similar lines of rows (line, norm); a line may have several rows."""
    keyed = in_batches(lines.select("line", "norm"), packed_keys, "bucket int, packed binary")
    shape = "value long, line long, least long, n long, lot long"
    runs = written(spark, in_batches(keyed.repartition("bucket"), shared_keys, shape), "shared-keys")
    asked = runs.select(F.col("line").alias("asked")).distinct()
    # No semi join: Spark would move it below the filter.
    texts = perhaps(lines, asked).join(asked, F.col("line") == F.col("asked"))
    texts = written(spark, texts.groupBy("line").agg(F.min("norm").alias("norm")), "line-texts")
    pairs = runs.where("line <> least").select(F.col("least").alias("a"), F.col("line").alias("b")).distinct()
    found = written(spark, near_pairs(pairs, texts), "near-lines")
    roots = components(spark, found)
    larger = runs.where("n > 2").join(roots, F.col("line") == F.col("node"), "left").withColumn("root", F.coalesce("root", "line"))
    larger = larger.select("value", "line", "lot", "root")
    open_keys = larger.groupBy("lot").agg(F.min("value").alias("of_value"), F.min("root").alias("low"), F.max("root").alias("high"))
    open_keys = open_keys.where("low <> high").select("of_value")
    rest = larger.join(open_keys, F.col("value") == F.col("of_value"), "left_semi").select("value", "line", "root")
    return found.unionAll(in_cells(rest, texts))


def duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(of_doc, of_row, pos): the lines to remove from each document; of_row is row_key() of it."""
    chosen = docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), F.col("text").cast("string")).where("text is not null")
    marked = written(spark, in_batches(chosen, line_marks, "doc_id long, row long, pos int, line long, check long, norm string"), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "pos")
    lines = marked.groupBy("line", "check").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    roots = components(spark, line_links(spark, marked.where("norm is not null").select("line", "norm")))
    rooted = lines.join(roots, F.col("line") == F.col("node"), "left").select("line", "check", "first", "n", "root")
    rooted = written(spark, rooted.where("n > 1 or root is not null"), "repeated-lines")
    best = rooted.where("root is not null").groupBy("root").agg(F.min("first").alias("kept")).withColumnRenamed("root", "of_root")
    keepers = rooted.join(best, F.col("root") == F.col("of_root"), "left")
    keepers = keepers.select(F.col("line").alias("of_line"), F.col("check").alias("of_check"), F.coalesce("kept", "first").alias("kept"))
    found = perhaps(marked.drop("norm"), rooted.select(F.col("line").alias("asked")))
    found = found.join(keepers, (F.col("line") == F.col("of_line")) & (F.col("check") == F.col("of_check")))
    return found.where(place != F.col("kept")).select(F.col("doc_id").alias("of_doc"), F.col("row").alias("of_row"), "pos")


def row_key() -> F.Column:
    """Tells rows apart that share a doc_id or have none."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def without_repeats(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with repeated lines removed, and the name of an added column that counts them."""
    removed = duplicates(spark, docs).groupBy("of_row", "of_doc").agg(F.collect_set("pos").alias("gone_pos"))
    names = list(docs.columns)
    own, row, gone, count = (free_name(n, names) for n in ("of_doc", "of_row", "gone_pos", "n_removed"))
    removed = removed.select(F.col("of_doc").alias(own), F.col("of_row").alias(row), F.col("gone_pos").alias(gone))
    # Few rows of numbers beside the documents: these need not be sorted.
    joined = docs.join(removed.hint("shuffle_hash"), (row_key() == F.col(row)) & F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left")
    cut = F.split(F.col("text"), "\n", -1)
    kept = F.filter(F.transform(cut, lambda x, i: F.struct(x.alias("line"), i.alias("pos"))), lambda x: ~F.array_contains(F.col(gone), x["pos"]))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    changed = {}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)
    counted = F.coalesce(F.array_size(gone), F.lit(0)).alias(count)
    # The text first, as its length is taken from it.
    joined = joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in names], F.col(gone), counted)
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in names], count), count


def free_name(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def keep_first_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with the columns they have, every repeated line removed but for its first occurrence."""
    result, count = without_repeats(spark, docs)
    return result.drop(count)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, count = without_repeats(spark, table(spark, sf_dir, "documents"))
    return result.select("doc_id", "text", "n_chars", F.col(count).alias("n_removed"))
