"""SentencePiece BPE encoding and decoding over a public model file.

Encoding keeps, for each prefix of a word, the last token of that prefix's encoding. It is the one token among those an
automaton finds to end there that can follow the last token of the prefix before it: two tokens can stand side by side if no
merge across their border comes before the merges that make them. The ids are then read off backwards from the
whole word. The work grows with the length of the word, however long it is.

Pieces hold the space sign only in front, so words with the spaces before them are encoded apart. A bounded memo in each
worker keeps the ids of words it has met.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.arrow import map_arrow, small_slices

SPACE = "▁"
_MEMO_ENTRIES = 300_000
_PAIR_ENTRIES = 1_000_000
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
_UNKNOWN = " ⁇ "  # what an unknown id decodes to


class Vocabulary:
    """What is read from a model: the normal pieces with their ranks (a smaller one merges first), the byte pieces, and the
    bytes each id decodes to."""

    def __init__(self, model_path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.vocab_size()
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        special = {i for i in range(n) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i)}
        self.ids = {model.id_to_piece(i): i for i in range(n) if i not in special and not model.is_unused(i)}
        self.rank = {p: -model.get_score(i) for p, i in self.ids.items()}
        inner = [p for p in self.ids if SPACE in p.lstrip(SPACE)]
        if len(self.bytes) < 256 or inner or model.normalize("ﬁ  Ａ ") != f"{SPACE}ﬁ{SPACE * 2}Ａ{SPACE}":
            raise ValueError("needs byte pieces, a space before the text, no other normalisation, and spaces in front of pieces")
        spelled = {i: b for b, i in self.bytes.items()}
        self.spelled = [
            bytes([spelled[i]]) if i in spelled
            else b"" if model.is_control(i)
            else _UNKNOWN.encode() if model.is_unknown(i)
            else model.id_to_piece(i).replace(SPACE, " ").encode()
            for i in range(n)
        ]
        self.led = [not model.is_unknown(i) and model.id_to_piece(i).startswith(SPACE) for i in range(n)]
        self.silent = [model.is_control(i) for i in range(n)]


def merged(text: str, rank: dict[str, float]) -> list[tuple]:
    """The merge trees of ``text``: best rank first, leftmost on a tie. A tree is (piece, left tree, right tree)."""
    trees = [(c, None, None) for c in text]
    while len(trees) > 1:
        best = min((rank.get(a[0] + b[0], np.inf), i) for i, (a, b) in enumerate(zip(trees, trees[1:])))
        if best[0] == np.inf:
            break
        i = best[1]
        trees[i : i + 2] = [(trees[i][0] + trees[i + 1][0], trees[i], trees[i + 1])]
    return trees


def _edge(tree: tuple, side: int) -> tuple[str, ...]:
    """Pieces at one edge of a tree, from the letter to the whole."""
    out = []
    while tree:
        out.append(tree[0])
        tree = tree[side]
    return tuple(reversed(out))


class Codec:
    """Encodes and decodes. Built once on the driver and sent to the tasks: its size is the vocabulary's."""

    def __init__(self, model_path: str):
        vocabulary = self._known = Vocabulary(model_path)
        self._left_edge: dict[int, tuple[str, ...]] = {}
        self._right_edge: dict[int, tuple[str, ...]] = {}
        for piece, number in vocabulary.ids.items():
            trees = merged(piece, vocabulary.rank)
            if len(trees) == 1:  # others are never made by merges
                self._left_edge[number], self._right_edge[number] = _edge(trees[0], 1), _edge(trees[0], 2)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("_known", "_left_edge", "_right_edge")}

    @cached_property
    def _matches(self):
        found = ahocorasick.Automaton()
        for piece, number in self._known.ids.items():
            if number in self._left_edge:
                found.add_word(piece, (number, len(piece)))
        found.make_automaton()
        return found.iter

    @cached_property
    def _pairs(self) -> dict[int, bool]:
        return {}

    @cached_property
    def _memo(self) -> _Memo:
        return _Memo(self)

    def side_by_side(self, one: int, two: int) -> bool:
        """Whether the text of both tokens is encoded as these two. Follows the pieces at their border in the order in which
        merges replace them; a merge across the border that comes first ends it. On equal ranks the left one comes first."""
        ours, theirs, rank = self._right_edge[one], self._left_edge[two], self._known.rank
        a = b = 0
        while True:
            across = rank.get(ours[a] + theirs[b], np.inf)
            left = rank[ours[a + 1]] if a + 1 < len(ours) else np.inf
            right = rank[theirs[b + 1]] if b + 1 < len(theirs) else np.inf
            if across < left and across <= right:
                return False
            if left == right == np.inf:
                return True
            if left <= right:
                a += 1
            else:
                b += 1

    def piece(self, word: str) -> list[int]:
        """Ids of a text without anything put before it."""
        last, pairs = [-1] * (len(word) + 1), self._pairs  # -1: ends in a letter that is no piece
        for end, (token, length) in self._matches(word):
            if last[end + 1] >= 0:
                continue
            before = last[end + 1 - length] if length <= end else -1
            if before >= 0:
                pair = before << 32 | token
                fits = pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = self.side_by_side(before, token)
                if not fits:
                    continue
            last[end + 1] = token
        if len(pairs) > _PAIR_ENTRIES:
            pairs.clear()
        out, end, spelled = [], len(word), self._sizes
        while end:
            token = last[end]
            if token >= 0:
                out.append(token)
                end -= spelled[token]
            else:
                out += [self._known.bytes[b] for b in reversed(word[end - 1].encode())]
                end -= 1
        return out[::-1]

    @cached_property
    def _sizes(self) -> dict[int, int]:
        return {number: len(piece) for piece, number in self._known.ids.items()}

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if not text:
            return b""
        memo = self._memo
        text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = _WORDS(SPACE + text.replace(" ", SPACE))
        else:
            words = (SPACE + text.replace(" ", " " + SPACE)).split(" ")
        out = b"".join(map(memo.__getitem__, words))
        if len(memo) > _MEMO_ENTRIES:
            memo.clear()
        return out

    @cached_property
    def _spelling(self) -> tuple[np.ndarray, ...]:
        spelled = self._known.spelled
        sizes = np.array([len(s) for s in spelled], np.int64)
        is_byte = np.zeros(len(spelled), bool)
        is_byte[list(self._known.bytes.values())] = True
        return (
            np.frombuffer(b"".join(spelled), np.uint8),
            np.cumsum(sizes) - sizes,
            sizes,
            np.array(self._known.led),
            np.array(self._known.silent),
            is_byte,
        )

    def decode_all(self, ids: np.ndarray, borders: np.ndarray) -> list[str]:
        """Texts of several id lists, laid end to end in ``ids``."""
        data, starts, sizes, led, silent, is_byte = self._spelling
        size = sizes[ids]
        ends = np.append(0, np.cumsum(size))
        raw = data[np.repeat(starts[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        out = []
        for first, end in zip(borders[:-1].tolist(), borders[1:].tolist()):
            while first < end and silent[ids[first]]:
                first += 1
            skip = 1 if first < end and led[ids[first]] else 0  # the space that was put before the text
            body = raw[ends[first] + skip : ends[end]] if first < end else b""
            try:
                out.append(body.decode())
            except UnicodeDecodeError:
                out.append(self._mended(ids[first:end].tolist(), is_byte)[skip:])
        return out

    def _mended(self, ids: list[int], is_byte: np.ndarray) -> str:
        """Runs of byte pieces that are no characters give a replacement sign for each byte that begins none."""
        out, run = [], b""
        for number in [*ids, None]:
            if number is not None and is_byte[number]:
                run += self._known.spelled[number]
                continue
            while run:
                try:
                    out.append(run.decode())
                    run = b""
                except UnicodeDecodeError as error:
                    out.append(run[: error.start].decode() + "�")
                    run = run[error.start + 1 :]
            if number is not None:
                out.append(self._known.spelled[number].decode())
        return "".join(out)


class _Memo(dict):
    """Word -> its ids as bytes, filled when asked."""

    def __init__(self, codec: Codec):
        super().__init__()
        self._codec = codec

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = np.array(self._codec.piece(word), "<i4").tobytes()
        return ids


def encode(docs: DataFrame, codec: Codec) -> DataFrame:
    """doc_id and ids (array<int>) of every row's whole text, without begin and end ids.

    A null or empty text has no ids. Columns besides doc_id and text are ignored; repeated rows and null ids of
    documents are encoded row by row; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = shared.value.encode
        for part in small_slices(batches):
            made = [to_ids(text or "") for text in part["text"].to_pylist()]
            ends = np.append(0, np.cumsum([len(ids) // 4 for ids in made])).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), "<i4")))
            yield pa.RecordBatch.from_arrays([part["doc_id"], ids], names=["doc_id", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, codec: Codec) -> DataFrame:
    """Adds ``decoded`` (string) to the rows of `encode`. Null ids decode to an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches):
            lists = part["ids"]
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            texts = shared.value.decode_all(ids, np.append(0, np.cumsum(sizes)))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"]
            )

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, decoded string")
