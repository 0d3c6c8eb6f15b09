"""SentencePiece encoding and decoding: a Viterbi pass along a trie of distinct words, whose common prefixes share their forward states."""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.shared import small_batches, tidy

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Characters of text whose words are taken together, and words kept for the next texts of a task.
TOGETHER, KEPT = 2_000_000, 600_000
#: Token pairs of which it is remembered whether they can stand together.
PAIRS = 1_000_000
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM, BYTE_PAIR = 1, 2
#: How far the score of an unknown character is below the least score of a unigram model.
PENALTY = 10.0


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: number, and integer or bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class Model:
    """A model file: its pieces, and exact encoding and decoding.

    In a unigram model a word's pieces are those with the largest sum of scores; the forward
    pass keeps for each prefix the best sum and the last piece. In a byte-pair model a word's pieces are those that merges in the order of their scores
    leave, which need not have the largest sum of scores. What the forward pass keeps for
    each prefix of a word is therefore not a best sum but the last piece of the prefix's
    encoding: the one piece that ends there and can stand beside the last piece of the
    prefix before it, that is, merges of the two alone leave both as they are.
    """

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.unknown, prefix, kind, escape, surplus = 0, 1, 1, 1, 1
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                piece, sort, i = own[1].decode(), own.get(3, NORMAL), len(self.pieces)
                self.pieces.append(piece)
                if sort == NORMAL:
                    self.ids[piece], self.scores[piece] = i, struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                elif sort == BYTE:
                    self.bytes[int(piece[3:5], 16)] = i
                elif sort == UNKNOWN:
                    self.unknown = i
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                own = dict(_fields(value))
                prefix, surplus, escape = own.get(3, 1), own.get(4, 1), own.get(5, 1)
                if own.get(2):
                    raise ValueError("a model with a character map is not supported")
        if kind not in (UNIGRAM, BYTE_PAIR) or surplus or not escape or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("only unigram and byte-pair models that keep white space, whose pieces have marks at their beginning, are supported")
        self.unigram = kind == UNIGRAM
        self.longest = max(map(len, self.ids), default=1)
        self.unlikely = min(self.scores.values(), default=0.0) - PENALTY
        self.prefix = bool(prefix)
        # for three characters the longest piece that ends with them, if any does
        self.reach: dict[str, int] = {}
        for piece in self.ids:
            if len(piece) > 2:
                self.reach[piece[-3:]] = max(len(piece), self.reach.get(piece[-3:], 0))
        byte = {i: b for b, i in self.bytes.items()}
        self.encoded = [bytes([byte[i]]) if i in byte else p.encode() for i, p in enumerate(self.pieces)]
        self.beside: dict[int, bool] = {}

    def merged(self, word: str) -> list[str]:
        """The pieces that merges leave: the best score first, the leftmost of equals."""
        parts = list(word)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _heap_merged(self, word: str) -> list[str]:
        """``merged`` by a queue, in time that grows little faster than the word."""
        parts, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        queue: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(parts)
            if i >= 0 and j < len(parts) and (score := self.scores.get(parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-score, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def _numbers(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "replace")]
            else:
                out.append(self.unknown)
        return out

    def _can_stand(self, a: int, b: int) -> bool:
        """Whether merges of two pieces leave both; ``a`` is -1 at a beginning."""
        if len(self.beside) >= PAIRS:
            self.beside.clear()
        parts = ([self.pieces[a]] if a >= 0 else []) + [self.pieces[b]]
        found = self.beside[(a + 1) << 20 | b] = self.merged("".join(parts)) == parts
        return found

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, as little-endian 32-bit integers."""
        return self._best_sums(words) if self.unigram else self._merged_words(words)

    def _best_sums(self, words: list[str]) -> dict[str, bytes]:
        """By unigram scores, in sorted order: a depth-first walk through the words' trie.

        For a prefix of i characters ``best[i]`` is its largest sum of scores, ``start[i]`` where
        the last piece begins, the earliest of equals, and ``number[i]`` the piece's id; words with a
        common prefix share these. A character that is no piece is one unknown, or its bytes.
        """
        out: dict[str, bytes] = {}
        best, start, number, before = [0.0], [0], [-1], ""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], start[shared + 1 :], number[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                own = (float("-inf"), end - 1, -1)
                for at in range(max(0, end - self.longest), end):
                    piece = word[at:end]
                    if (i := self.ids.get(piece)) is not None and best[at] + self.scores[piece] > own[0]:
                        own = best[at] + self.scores[piece], at, i
                if word[end - 1] not in self.ids and best[end - 1] + self.unlikely > own[0]:
                    own = best[end - 1] + self.unlikely, end - 1, -1
                best.append(own[0])
                start.append(own[1])
                number.append(own[2])
            before, end, parts = word, len(word), []
            while end:
                parts.append((start[end], end, number[end]))
                end = start[end]
            ids: list[int] = []
            unknown = False
            for a, b, i in reversed(parts):
                if i >= 0:
                    ids.append(i)
                elif self.bytes:
                    ids += self._numbers([word[a:b]])
                elif not unknown:  # unknown characters in a row are one
                    ids.append(self.unknown)
                unknown = i < 0
            out[word] = struct.pack(f"<{len(ids)}i", *ids)
        return out

    def _merged_words(self, words: list[str]) -> dict[str, bytes]:
        """By merges, in sorted order: a depth-first walk through the words' trie.

        For a prefix of i characters ``start[i]`` is where the last piece of its encoding
        begins, and ``number[i]`` its id; words with a common prefix share these. A
        character that is no piece stands alone (as bytes, id -1) and nothing merges across it.
        """
        out: dict[str, bytes] = {}
        ids, beside, can, reach = self.ids, self.beside, self._can_stand, self.reach
        start, number = [0], [-1]
        before = ""
        for word in sorted(words):
            if word.startswith(MARK * 2):  # pieces of marks alone have equal scores, so their order matters
                own = self._numbers(self._heap_merged(word))
                out[word] = struct.pack(f"<{len(own)}i", *own)
                continue
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del start[shared + 1 :], number[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                if word[end - 1] not in ids:
                    start.append(end - 1)
                    number.append(-1)
                    continue
                at = end - reach.get(word[end - 3 : end], 2) if end > 2 else 0
                at = at if at > 0 else 0
                while at < end:
                    piece = ids.get(word[at:end])
                    if piece is not None:
                        left = number[at]
                        ok = beside.get((left + 1) << 20 | piece)
                        if ok is None:
                            ok = can(left, piece)
                        if ok:
                            break
                    at += 1
                else:
                    raise AssertionError(f"no encoding of {word[:end]!r}")
                start.append(at)
                number.append(piece)
            before, end, own = word, len(word), []
            while end:
                if (piece := number[end]) >= 0:
                    own.append(piece)
                else:
                    own += self._numbers([word[end - 1]])[::-1]
                end = start[end]
            own.reverse()
            out[word] = struct.pack(f"<{len(own)}i", *own)
        return out

    def words(self, text: str) -> list[str]:
        """The marked words of a text, in order."""
        text = text.replace(" ", MARK)
        return WORD.findall(MARK + text if self.prefix and text else text)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, byte pieces as UTF-8, marks as spaces, without the space of the first word."""
        text = b"".join(map(self.encoded.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def model(name: str) -> Model:
    """The model of a file: a name of the public tokenizers or a path."""
    import public_tokenizers

    with open(name if "/" in name else public_tokenizers.path(name), "rb") as file:
        return Model(file.read())


class Encoder:
    """Encodes texts of one task; words once encoded are kept for its next texts, up to ``KEPT`` of them."""

    def __init__(self, name: str = MODEL):
        self.model, self.known = model(name), {}

    def texts(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of the texts, in order; null counts as empty and has none."""
        at = 0
        while at < len(texts):
            size, group = 0, []
            while at < len(texts) and (not group or size + len(texts[at] or "") <= TOGETHER):
                group.append(self.model.words(texts[at] or ""))
                size += len(texts[at] or "")
                at += 1
            new = set().union(*group) - self.known.keys()
            if len(self.known) + len(new) > KEPT:
                self.known, new = {}, set().union(*group)
            self.known |= self.model.encode_words(list(new))
            for words in group:
                yield np.frombuffer(b"".join([self.known[w] for w in words]), "<i4")


def encode_texts(texts: list[str | None], name: str = MODEL) -> Iterator[np.ndarray]:
    """Ids of the texts, in order; null counts as empty and has none."""
    return Encoder(name).texts(texts)


def encode(df: DataFrame, text_col: str = "text", name: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text as ``array<int>``.

    A null or empty text has no ids; repeated rows get the same; a column of the new name
    is replaced. Tasks encode distinct words of some millions of characters at a time, so
    memory follows one text at most; nothing is shuffled.
    """

    small_batches(df.sparkSession)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Encoder(name)
        for texts in batches:
            yield pd.Series(list(own.texts(list(texts))), dtype=object)

    return df.withColumn(ids_col, run(F.col(text_col)))


def decode(df: DataFrame, ids_col: str = "ids", name: str = MODEL, text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of ids; null ids give null, no ids an empty text."""

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else model(name).decode(np.asarray(i).tolist()) for i in ids], dtype=object)

    return df.withColumn(text_col, run(F.col(ids_col)))


def encoded_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = MODEL) -> DataFrame:
    """``(id_col, n_tokens, ids, ids_crc32, decoded_sha256, round_trip)``: each text encoded and decoded again.

    ``round_trip`` says whether the decoded text is the text, null counting as empty; it
    is false only for a text with the mark itself, which decodes as a space. Null and
    repeated ids are rows like any other; an empty table gives an empty result; other
    columns are not read.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Encoder(name)
        for b in batches:
            out = []
            for key, text, ids in zip(b["id"], b["text"], own.texts(list(b["text"]))):
                decoded = own.model.decode(ids.tolist())
                out.append((key, len(ids), ids, zlib.crc32(ids.tobytes()), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest(), decoded == (text or "")))
                if len(out) >= 500:
                    yield pd.DataFrame(out, columns=["id", "n_tokens", "ids", "ids_crc32", "decoded_sha256", "round_trip"])
                    out = []
            yield pd.DataFrame(out, columns=["id", "n_tokens", "ids", "ids_crc32", "decoded_sha256", "round_trip"])

    out = rows.mapInPandas(tidy(run), "id string, n_tokens long, ids array<int>, ids_crc32 long, decoded_sha256 string, round_trip boolean")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
