"""Token counts: unigram segmentation over a trie of the distinct pre-tokens.

A text's pre-tokens are runs of blanks with the word that follows them, and line feeds by themselves. No piece
of the vocabulary crosses such a border (checked when the vocabulary is loaded), so the best segmentation of a
text is that of its pre-tokens, one after another. Forward scores of a prefix do not depend on what follows:
they are kept at the trie node of the prefix and computed once for all pre-tokens that share it. The node of a
whole pre-token keeps the number of pieces of its best segmentation.

Every task builds tries of its own and needs no shuffle. A trie holds the new pre-tokens of one batch, known
counts are remembered up to a fixed number, and both are dropped when full, which changes no result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: How the model file writes a blank.
BLANK = "▁"
#: Characters of texts whose new pre-tokens share a trie.
BATCH_CHARS = 4_000_000
PRE_TOKEN = re.compile(r"\x20*[^\x20\n]+|\x20+|\n")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with integer scores (millionths of a natural logarithm), and the score of a byte of an unknown character."""

    pieces: dict[str, int]
    byte_score: int

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        """Reads a sentencepiece model. Its pieces are ordered by rank; a piece of rank r scores as -ln(r + 2.7), the Zipf-Mandelbrot law, less the logarithm of the sum."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        total = math.log(sum(1 / (r + 2.7) for r in range(len(plain))))
        pieces = {sp.id_to_piece(i): round(-1e6 * (math.log(r + 2.7) + total)) for r, i in enumerate(plain)}
        return cls.of(pieces)

    @classmethod
    def of(cls, pieces: dict[str, int]) -> Vocabulary:
        for p in pieces:
            if "\n" in p or BLANK in p.lstrip(BLANK):
                raise ValueError(f"the piece {p!r} crosses a border of pre-tokens")
        return cls(pieces, min(pieces.values(), default=0) - 10_000_000)


class Counter:
    """Counts the pieces of pre-tokens. At most max_chars characters of pre-tokens are remembered between batches."""

    def __init__(self, vocabulary: Vocabulary, max_chars: int = 8_000_000) -> None:
        self.score = {p.replace(BLANK, " "): s for p, s in vocabulary.pieces.items()}
        self.byte_score = vocabulary.byte_score
        self.endings = {p[i:] for p in self.score for i in range(len(p))}
        self.max_chars, self.chars = max_chars, 0
        self.known: dict[str, int] = {}

    def node(self, word: str, i: int, best: list[int], count: list[int]) -> tuple[int, int]:
        """Forward score and number of pieces at the node of word[: i + 1], from those on the path to it. Of equal scores, the fewest pieces count."""
        score, endings = self.score, self.endings
        single = score.get(word[i])
        if single is not None:
            top, pieces = best[i] + single, count[i] + 1
        else:
            n = len(word[i].encode("utf-8", "surrogatepass"))
            top, pieces = best[i] + n * self.byte_score, count[i] + n
        j = i - 1
        while j >= 0 and (part := word[j : i + 1]) in endings:
            s = score.get(part)
            if s is not None:
                t = best[j] + s
                if t > top or t == top and count[j] < pieces - 1:
                    top, pieces = t, count[j] + 1
            j -= 1
        return top, pieces

    def learn(self, words: Iterable[str]) -> None:
        """Inserts the words into a trie and remembers the count at the node of each.

        In sorted order, each node's words follow each other. So only the path to the latest word is kept: a
        node that is left is never met again.
        """
        best, count, last = [0], [0], ""
        for word in sorted(words):
            depth, most = 0, min(len(word), len(last))
            while depth < most and word[depth] == last[depth]:
                depth += 1
            del best[depth + 1 :], count[depth + 1 :]
            for i in range(depth, len(word)):
                top, pieces = self.node(word, i, best, count)
                best.append(top)
                count.append(pieces)
            self.known[word] = count[-1]
            self.chars += len(word)
            last = word

    def counts(self, texts: Iterable[str | None]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of each text; a null or empty text has none."""
        split = [PRE_TOKEN.findall(" " + t.replace(BLANK, " ")) if t else [] for t in texts]
        if self.chars > self.max_chars:
            self.known.clear()
            self.chars = 0
        known = self.known
        self.learn({w for words in split for w in words if w not in known})
        return [(sum(map(known.__getitem__, words)), len(words)) for words in split]


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_tokens and n_pretokens (long) for each row of docs, repeated rows and null ids included.

    Null and empty texts count 0. Other columns of docs are not read, so their names may be any.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            found: list[tuple[int, int]] = []
            texts: list[str | None] = []
            size = 0
            for value in batch.column(1):
                texts.append(value.as_py())
                size += len(texts[-1] or "")
                if size > BATCH_CHARS:
                    found += counter.counts(texts)
                    texts, size = [], 0
            found += counter.counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["id", "n_tokens", "n_pretokens"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_pretokens long").withColumnRenamed("id", id_col)
