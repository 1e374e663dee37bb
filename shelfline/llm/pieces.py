"""SentencePiece encoding and decoding by a forward pass that words with a common prefix share.

Spaces become the mark U+2581 and one more mark opens the text. A marked word is a run of marks with
what follows up to the next mark; no piece reaches over its end, so words are encoded one by one.
The distinct marked words of a portion of texts are sorted, which walks their trie depth-first: the
forward table of a word keeps the entries of the prefix it shares with the word before.

The vocabulary given is one of merges, so a sum of piece scores would not give its encoding. The
forward entry of a prefix is therefore the last piece of its encoding: the one piece that ends there
and that the merges leave apart from the last piece before it. Every prefix of an encoding is the
encoding of its own text, so following the entries back from the end of the word gives exactly what
merging the word gives. Whether two pieces stay apart is found by merging them, once for each pair.
A character without a piece is written as the pieces of its UTF-8 bytes.

Cases: null and empty text have no ids and decode to an empty text; the mark itself in a text reads
as a space; null ids and repeated rows give a row each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import in_batches, portions, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*")
#: Encoded words and judged pairs a worker remembers before it starts anew; it only saves work.
REMEMBERED, REMEMBERED_PAIRS = 400_000, 500_000
START = ""
PAIR = (2,)


class Vocabulary:
    """Pieces and merge scores of a model file, in plain containers that can be sent to tasks."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.output: list[bytes] = []
        self.encoder: Encoder | None = None
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.output.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.output.append(b"")
            else:
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.output.append(piece.replace(MARK, " ").encode())


    def shared_encoder(self) -> Encoder:
        """One encoder for all tasks of a worker, which keeps the broadcast vocabulary between them."""
        if self.encoder is None:
            self.encoder = Encoder(self)
        return self.encoder


class Encoder:
    """Encodes sorted words; keeps the forward table of the last word, and words and pairs met so far."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.apart: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        # Lengths of the pieces that end in three given characters, longest first; elsewhere only
        # a piece of two characters can end.
        lengths: dict[str, set[int]] = {}
        for piece in vocabulary.ids:
            if len(piece) > 2:
                found = lengths.setdefault(piece[-3:], set())
                found.add(len(piece))
                if piece[-2:] in vocabulary.ids:
                    found.add(2)
        self.lengths = {end: tuple(sorted(found, reverse=True)) for end, found in lengths.items()}
        self.word, self.last = "", [START]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: the best pair merges first, the leftmost of equals."""
        scores, parts = self.vocabulary.scores, list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stay_apart(self, left: str, right: str) -> bool:
        wanted = [right] if left == START else [left, right]
        found = self.apart[left, right] = self.merged(left + right) == wanted
        return found

    def encode(self, word: str) -> tuple[int, ...]:
        """Ids of a word; cheapest when words come in sorted order."""
        last, before, ids, lengths, apart = self.last, self.word, self.vocabulary.ids, self.lengths, self.apart
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del last[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            for n in lengths.get(word[end - 3 : end], PAIR) if end > 2 else PAIR:
                if n > end:
                    continue
                piece = word[end - n : end]
                if piece in ids:
                    left = last[end - n]
                    found = apart.get((left, piece))
                    if found is None:
                        found = self.stay_apart(left, piece)
                    if found:
                        last.append(piece)
                        break
            else:
                last.append(word[end - 1])
        self.word = word
        end, found = len(word), []
        while end:
            piece = last[end]
            known = ids.get(piece)
            found += [known] if known is not None else [self.vocabulary.byte_ids[b] for b in reversed(piece.encode("utf-8", "surrogatepass"))]
            end -= len(piece)
        return tuple(reversed(found))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(MARK + text.replace(" ", MARK)) if text else []


def encode_texts(texts: list[str | None], encoder: Encoder) -> list[list[int]]:
    known = encoder.known
    if len(known) > REMEMBERED:
        known.clear()
    if len(encoder.apart) > REMEMBERED_PAIRS:
        encoder.apart.clear()
    cut = [words_of(t) for t in texts]
    for word in sorted({w for words in cut for w in words if w not in known}):
        known[word] = encoder.encode(word)
    return [[i for w in words for i in known[w]] for words in cut]


def decode(ids: list[int], output: list[bytes]) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(output.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode(spark: SparkSession, docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, token_ids, n_tokens, decoded) for every row of docs.

    The vocabulary is broadcast; its size is that of the model file, whatever the documents.
    """
    vocabulary = spark.sparkContext.broadcast(Vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.value.shared_encoder()
        for part in portions(batches, "text"):
            found = encode_texts(part.column("text").to_pylist(), encoder)
            decoded = [decode(ids, vocabulary.value.output) for ids in found]
            arrays = [part.column("doc_id"), pa.array(found, pa.list_(pa.int32())), pa.array([len(x) for x in found], pa.int32()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "token_ids", "n_tokens", "decoded"])

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_batches(chosen, run, "doc_id long, token_ids array<int>, n_tokens int, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark, table(spark, sf_dir, "documents"))
