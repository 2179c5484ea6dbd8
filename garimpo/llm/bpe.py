"""Byte-level BPE by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary lists the tokens that start at each byte of a piece.
The encoder takes the longest, goes on behind it, and steps back to the next shorter token when a
pair is not compatible or a place was already found to lead nowhere. A pair of tokens is compatible
when merging their joined bytes gives back just these two; compatibility of all neighbours is what
the exact merge order produces, so the result equals applying the merges one by one. Every place is
ruled out at most once, so the work is linear in the length of a piece.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from garimpo.llm.common import MEMO_ENTRIES, RARE_SPACE, WORD_AND_MARKS, Memo, documents, small_batches, texts_of
from garimpo.llm.registry import query

#: A chunk is white space and what follows it; no piece of the pre-tokenizer spans two chunks.
CHUNK = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, by the public rule:
    printable bytes stand for themselves, the others take the letters from 256 on in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges, the automaton and the tables of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.letters = byte_letters()
        vocab = told["model"]["vocab"]
        self.tokens = {i: self.bytes_of(t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.ids = {b: i for i, b in self.tokens.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        #: pair of ids -> (rank, merged id), and merged id -> the pair it was made of
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.made_of: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self.merge.setdefault(pair, (rank, made))
            self.made_of.setdefault(made, pair)
        self.automaton = ahocorasick.Automaton()
        for i, b in self.tokens.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.compatible = Memo(self._compatible)
        self.piece_ids = Memo(self._piece, 2 * MEMO_ENTRIES)
        self.chunk_ids = Memo(self._chunk, 2 * MEMO_ENTRIES)
        table = self.tokens | {i: t.encode() for t, i in self.special.items()}
        size = max(table, default=-1) + 1
        self.offsets = np.zeros(size + 1, np.int64)
        for i in range(size):
            self.offsets[i + 1] = self.offsets[i] + len(table.get(i, b""))
        self.blob = np.frombuffer(b"".join(table.get(i, b"") for i in range(size)), np.uint8)
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def bytes_of(self, letters: str) -> bytes:
        return bytes(self.letters[c] for c in letters)

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Would the merges leave the border between these two tokens alone?

        Undo merges from the latest on both sides; if at some moment the two tokens at the border
        had an earlier merge with each other, it would have been taken.
        """
        left, right = pair
        limit = len(self.merge)
        while True:
            found = self.merge.get((left, right))
            if found is not None and found[0] < limit:
                return False
            # undo the later of the two merges that made left and right: on the left side the
            # second half touches the border, on the right side the first
            a, b = self.made_of.get(left), self.made_of.get(right)
            rank_a = self.merge[a][0] if a else -1
            rank_b = self.merge[b][0] if b else -1
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                limit, left = rank_a, a[1]
            else:
                # of equal merges the leftmost goes first, so one over the border precedes right's
                limit, right = rank_b + 1, b[0]

    def _piece(self, piece: bytes) -> bytes:
        """Ids of one piece of the pre-tokenizer, as little-endian unsigned 32-bit numbers."""
        whole = self.ids.get(piece)
        n = len(piece)
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            starts[end - length + 1].append(token)  # shorter tokens come first
        if whole is not None and n == 1:
            return np.array([whole], "<u4").tobytes()
        dead = bytearray(n + 1)
        ids: list[int] = []
        choice: list[int] = []  # index into starts of each chosen token
        at, pick = 0, len(starts[0]) - 1
        while at < n:
            tokens = starts[at]
            while pick >= 0:
                token = tokens[pick]
                end = at + len(self.tokens[token])
                if not dead[end] and (not ids or self.compatible[ids[-1], token]):
                    break
                pick -= 1
            if pick >= 0:
                ids.append(token)
                choice.append(pick)
                at = end
                pick = len(starts[at]) - 1 if at < n else 0
            else:
                dead[at] = 1
                last = ids.pop()
                at -= len(self.tokens[last])
                pick = choice.pop() - 1
        return np.array(ids, "<u4").tobytes()

    def _chunk(self, text: str) -> bytes:
        if m := WORD_AND_MARKS.fullmatch(text):
            word, marks = m.groups()
            return self.piece_ids[word.encode()] + (self.piece_ids[marks.encode()] if marks else b"")
        pieces = self.library.pre_tokenizer.pre_tokenize_str(text)
        return b"".join(self.piece_ids[self.bytes_of(p)] for p, _ in pieces)

    def encode(self, text: str) -> bytes:
        """Ids of a text; special tokens in it are recognised as the library does."""
        parts = self.special_cut.split(text) if self.special_cut and "<" in text else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif RARE_SPACE.search(part):  # such texts are not cut into chunks
                out.append(self._chunk(part))
            else:
                out.append(b"".join(map(self.chunk_ids.__getitem__, CHUNK.findall(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the ids by the offset table."""
        ids = np.frombuffer(ids, "<u4")
        begin = self.offsets[ids]
        sizes = self.offsets[ids + 1] - begin
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.arange(total) + np.repeat(begin - ends + sizes, sizes)].tobytes()


VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in VOCABULARIES:
        VOCABULARIES[path] = Vocabulary(path)
    return VOCABULARIES[path]


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids`` (array of long) of every text; a null or empty text has no ids.

    Rows are independent: repeated rows, null ids and further columns change nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(tokenizer)
        for batch in small_batches(batches):
            ids = [np.frombuffer(words.encode(t), "<u4").astype(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int64()))})

    return texts_of(docs).mapInArrow(run, "doc_id bigint, ids array<bigint>")


def decode_documents(rows: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; bytes that are no UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(tokenizer)
        for batch in small_batches(batches):
            texts = [
                words.decode(np.array(ids or [], "<u4").tobytes()).decode("utf-8", "replace")
                for ids in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Number of tokens and digests of ids and of the decoded text, encoding and decoding in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(tokenizer)
        sha = hashlib.sha256
        for batch in small_batches(batches):
            ids = [words.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([sha(x).hexdigest() for x in ids]),
                    "decoded_sha256": pa.array(
                        [sha(words.decode(x).decode("utf-8", "replace").encode()).hexdigest() for x in ids]
                    ),
                }
            )

    return texts_of(docs).mapInArrow(run, DIGESTS)


@query("op8_bpe_round_trip")
def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
