"""BPE encoding and decoding with the vocabulary of a public tokenizer file.

Encoding backtracks: at each place it takes the longest token (found for all places at once by an Aho-Corasick
automaton over the reversed tokens) that is compatible with the token before it, and goes back to shorter ones
where nothing fits. Two tokens are compatible if BPE keeps exactly these two for their joined text; a sequence
in which all neighbours are compatible is the one that merging would give. Since a text's prefix has one
encoding only, a place that failed once is never tried again, so the work is linear in the text. Decoding
copies slices of one blob by an offset table.

The file's own normalizer and pre-tokenizer split a text into pieces. Neither looks across white space, so
words are encoded one by one and remembered up to a fixed number of characters.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters that are white space for the tokenizer's patterns.
WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: How the file splits words, and the same for words (which hold no white space) of printable ASCII
#: characters in lower case: these are their own bytes in the alphabet of the pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: The last symbol of a piece is another symbol than the same character elsewhere: it is moved up by this.
LAST = 0x1000
#: Pieces and pairs of tokens that are remembered, at most.
MOST_KEPT = 300_000


class Codec:
    """The tokenizer of a tokenizers JSON file whose model is BPE with a suffix at the end of words."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.spec = json.loads(spec)
        model = self.spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError("this model is of another kind")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in self.spec["added_tokens"]):
            raise ValueError("added tokens of this kind are not supported")
        if self.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PATTERN:
            raise ValueError("this file splits words in another way")
        self.suffix = model["end_of_word_suffix"]
        self.ids = {self.inner(t): i for t, i in model["vocab"].items()}
        self.symbols = {i: t for t, i in self.ids.items()}
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((self.inner(a), self.inner(b)), rank)
        added = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.added = added
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        small = Tokenizer.from_str(json.dumps(self.spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []}))
        self.normalizer, self.pre_tokenizer = small.normalizer, small.pre_tokenizer
        self.compatible: dict[int, bool] = {}
        #: Ids are kept as the bytes of an array of the smallest type that holds them.
        self.code = "H" if max(self.symbols, default=0) < 1 << 16 else "I"
        self.pieces: dict[str, bytes] = {}
        self.automaton = self.build()
        self.table = OffsetTable({i: t for t, i in model["vocab"].items()} | {i: t for t, i in added.items()})

    def inner(self, token: str) -> str:
        """A token as a string with one character for each symbol."""
        body = token.removesuffix(self.suffix)
        return token if body == token or not body else body[:-1] + chr(ord(body[-1]) + LAST)

    def merged(self, text: str) -> list[str]:
        """BPE as it is defined: merge the first pair of the lowest rank until none is left."""
        parts, none = list(text), 1 << 30
        ranks = [self.ranks.get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (rank := min(ranks)) < none:
            at = ranks.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = self.ranks.get((parts[at - 1], parts[at]), none)
            if at < len(ranks):
                ranks[at] = self.ranks.get((parts[at], parts[at + 1]), none)
        return parts

    def build(self):  # noqa: ANN201
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for text, i in self.ids.items():
            if len(text) == 1 or self.merged(text) == [text]:  # others never come out of merging
                automaton.add_word(text[::-1], (i, len(text)))
        automaton.make_automaton()
        return automaton

    def fits(self, a: int, b: int) -> bool:
        key = a << 24 | b
        known = self.compatible.get(key)
        if known is None:
            pair = (self.symbols[a], self.symbols[b])
            known = pair not in self.ranks and tuple(self.merged(pair[0] + pair[1])) == pair
            if len(self.compatible) >= MOST_KEPT:
                self.compatible.clear()
            self.compatible[key] = known
        return known

    def known_piece(self, piece: str) -> bytes:
        """Ids of a piece. Many words share a piece, so these are remembered too."""
        ids = self.pieces.get(piece)
        if ids is None:
            ids = array(self.code, self.encode_piece(piece)).tobytes()
            if len(self.pieces) >= MOST_KEPT:
                self.pieces.clear()
            if len(piece) <= 100:
                self.pieces[piece] = ids
        return ids

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a piece in the pre-tokenizer's alphabet."""
        text = piece[:-1] + chr(ord(piece[-1]) + LAST)
        n = len(text)
        found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(text[::-1]):
            found[n - 1 - end].append(token)  # the longest first
        out: list[int] = []
        starts = [0]
        tried = [0]
        dead = bytearray(n + 1)
        while starts[-1] < n:
            at = starts[-1]
            options = found[at]
            k = tried[-1]
            while k < len(options):
                token, length = options[k]
                k += 1
                if not dead[at + length] and (not out or self.fits(out[-1], token)):
                    tried[-1] = k
                    out.append(token)
                    starts.append(at + length)
                    tried.append(0)
                    break
            else:
                if not out:
                    raise ValueError(f"no encoding of {piece!r}")
                dead[at] = 1
                starts.pop()
                tried.pop()
                out.pop()
        return out

    def encode_word(self, word: str) -> bytes:
        """Ids of a run without white space."""
        ids: list[bytes] = []
        parts = self.split_added.split(word) if self.split_added and "<" in word else [word]
        for part in parts:
            if part in self.added:
                ids.append(array(self.code, [self.added[part]]).tobytes())
            elif part.isascii() and part.isprintable():
                ids += map(self.known_piece, ASCII_PIECE.findall(part.lower()))
            elif part:
                ids += (self.known_piece(piece) for piece, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part)))
        return b"".join(ids)


@lru_cache(maxsize=1)
def codec_of(spec: str) -> Codec:
    """The codec of a tokenizer file's text, with what it remembers of pieces: tasks of a Python process share it."""
    return Codec(spec)


class OffsetTable:
    """Token strings in one blob; token i is blob[offsets[i] : offsets[i + 1]]."""

    def __init__(self, tokens: dict[int, str]) -> None:
        strings = [tokens.get(i, "").encode() for i in range(max(tokens, default=-1) + 1)]
        self.blob = b"".join(strings)
        self.offsets = array("L", [0])
        for s in strings:
            self.offsets.append(self.offsets[-1] + len(s))
        self.slices = [self.blob[a:b] for a, b in zip(self.offsets, self.offsets[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens with a blank between them: the file names no decoder."""
        return b" ".join(map(self.slices.__getitem__, ids.tolist()))


class Words(dict):
    """Ids by word, filled on demand; emptied when the words have more than max_chars characters together."""

    def __init__(self, codec: Codec, max_chars: int = 6_000_000) -> None:
        self.codec, self.max_chars, self.chars = codec, max_chars, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.codec.encode_word(word)
        if len(word) <= 200:
            self[word] = ids
            self.chars += len(word)
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if self.chars > self.max_chars:
            self.clear()
            self.chars = 0
        data = b"".join(map(self.__getitem__, WORD.findall(text))) if text else b""
        return np.frombuffer(data, self.codec.code).astype("<u4")


def encode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, ids (array of int) and decoded (string) for each row of docs.

    spec is the text of the tokenizer's JSON file: its size bounds what is broadcast. Null and empty texts have
    no ids and decode to an empty text. Repeated rows stay; other columns of docs are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(codec_of(shared.value))  # a task's own: its memory is free again after the task
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                ids = [words.encode(t) for t in batch.column(1).slice(k, 200).to_pylist()]
                decoded = pa.array([words.codec.table.decode(x).decode() for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 200), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), decoded], ["id", "ids", "decoded"])

    return _rows(docs, id_col, text_col, run, "ids array<int>, decoded string")


def digests(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """As encode(), with n_tokens, ids_sha256 and decoded_sha256 in place of the decoded text, and of the ids unless with_ids.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the decoded text in UTF-8.
    They are taken where the ids are made, so that these need not travel.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(codec_of(shared.value))  # a task's own: its memory is free again after the task
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                counts, a, b, every = [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = words.encode(text)
                    counts.append(len(ids))
                    a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    b.append(hashlib.sha256(words.codec.table.decode(ids)).hexdigest())
                    every.append(ids.astype(np.int32) if with_ids else None)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(every, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return _rows(docs, id_col, text_col, run, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def _rows(docs: DataFrame, id_col: str, text_col: str, run, columns: str) -> DataFrame:  # noqa: ANN001
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {columns}").withColumnRenamed("id", id_col)
