"""LM scoring with a probabilistic suffix tree over tokens, whose root spells unknown words by one over bytes.

1. Documents are cut into chunks inside the tasks. A chunk is one row: its list of words and its documents as packed
   places in that list, so that a word, or an n-gram (a token and one to TOKENS tokens before it), is counted,
   shuffled and looked up once a chunk instead of once a token. Before a text stand ends.
2. N-grams go by a hash key, cut to key_bits(), in packed lists by bucket, words as they are. Each bucket adds up the
   training counts of its keys and hands them back to the chunks. A key stands once in a chunk's list, so that a
   common one does not make a bucket large.
3. A context is the one to TOKENS tokens before a token. It is retained if training has it LEAST_CONTEXT times or
   more and its next tokens gain LEAST_GAIN nats from it against the context one token shorter, over all of its
   occurrences, each scored by the counts of the others. That is the divergence between the two distributions, left
   one out; without that, a context whose next tokens never repeat would always diverge. Chunks add up the
   gains of their own occurrences, buckets those of the chunks, by the place that a context has in the bucket.
   Terms are rounded to 1 / UNIT nats, so that sums do not depend on how the documents were cut.
4. A token's state is the longest retained suffix of what stands before it. Its distribution is smoothed by
   the next shorter one with the weight of PRIOR occurrences: (c + PRIOR * p) / (n + PRIOR). At the root, a token has
   its share c / (N + V), and V / (N + V) (Witten-Bell) goes to words that training does not have.
5. These are spelled by a suffix tree over bytes, from the distinct training words: contexts of up to DEPTH bytes
   inside a word, before which stands a blank, and which ends with one (an end is a line feed). A context is kept if it
   occurs LEAST_COUNT times or more and its next bytes gain LEAST_BYTE_GAIN nats against the context one byte
   shorter; the distributions are smoothed by Witten-Bell, at the root evenly over all bytes. Contexts that share
   their last two bytes are handled together, so the tree is dealt out, whatever its size.

Contexts, counts and thresholds are absolute: what is gathered grows with the corpus, and nothing of it is collected.
The spelling of known words is not excluded, so that a state's probabilities add up to one or a little less.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import stored

#: Tokens of the longest context, the training occurrences that a context needs, the nats that it must gain, and the weight of what a context backs off to, by length.
TOKENS, LEAST_CONTEXT, LEAST_GAIN, PRIOR = 2, 2, 2.0, (100.0, 10.0)
UNIT = 16
#: The same for the tree over bytes.
DEPTH, LEAST_COUNT, LEAST_BYTE_GAIN = 5, 10, 3.0
CHUNK_BYTES = 4_000_000
#: Unknown words that are spelled together, and distinct strings of bytes of a group.
BLOCK_WORDS, GROUP_CODES = 100_000, 200_000
#: The end of a text as a word; no real word is empty.
END = b""
#: A hash key's bits above those that number the input's bytes: of 65,536 n-grams, one at most is taken for another.
SPARE_BITS = 16


def held_out(doc_id) -> bool:  # noqa: ANN001
    """Whether a document is kept from training, by its id's text; a null id is an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, held_out (boolean), n_tokens, n_known, train_tokens (long), base_score and score (double).

    Tokens are words (A-Z in lower case) and one end. base_score is the sum over tokens of
    log10((c + 0.1) / (N + 0.1 * (V + 1))) from the training documents; n_known counts tokens with c > 0; score is
    the model's log10 probability of the tokens. Null and empty texts are one end. Without any training
    document N and V are 0 and every word is spelled by even bytes. Repeated rows count and come out as often as
    they go in; other columns are not read.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sizes = Sizes.of(docs)
    # Chunks are rows of some MB; small row groups keep those in memory few.
    made = rows.mapInArrow(_chunks, f"chunk long, ids array<{kind}>, held binary, lengths binary, places binary, words binary, trained binary")
    chunks = stored(made, "chunks", **{"parquet.block.size": str(1 << 24), "parquet.enable.dictionary": "false"})

    asked = chunks.select("chunk", "held", "lengths", "places", "words", "trained").mapInArrow(sizes.lists, LISTS)
    counted = asked.groupBy("place").applyInArrow(_summed, "chunk long, place int, packed binary, contexts binary, unknown array<binary>, vocabulary binary, n long, v long")
    counts = stored(counted, "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    answers = counts.where("chunk is not null").select(F.col("chunk").alias("to"), F.lit(0).alias("row"), "place", "packed", *_nulls("word binary", "tree double"))
    own = chunks.drop("ids").groupBy("chunk")
    gains = own.cogroup(answers.groupBy("to")).applyInArrow(lambda chunk, found: sizes.gains(chunk, found, total, distinct), "chunk long, place int, numbers binary")
    contexts = counts.where("contexts is not null").select(F.col("chunk").alias("of"), F.col("place").alias("bucket"), "contexts")
    kept = stored(gains.groupBy("place").cogroup(contexts.groupBy("bucket")).applyInArrow(_retained, "chunk long, place int, packed binary"), "kept")

    unknown = counts.where("chunk is not null").select(F.col("chunk").alias("to"), F.explode("unknown").alias("word"))
    vocabulary = counts.where("vocabulary is not null").select("vocabulary").mapInArrow(_split, "word binary")
    spelled = unknown.join(spelling(vocabulary, unknown.select("word").distinct()), "word").select("to", F.lit(2).alias("row"), *_nulls("place int", "packed binary"), "word", "tree")
    flags = kept.select(F.col("chunk").alias("to"), F.lit(1).alias("row"), "place", "packed", *_nulls("word binary", "tree double"))
    found = answers.unionByName(flags).unionByName(spelled)
    out = chunks.groupBy("chunk").cogroup(found.groupBy("to")).applyInArrow(lambda chunk, found: sizes.scores(chunk, found, total, distinct), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


#: Packed lists of keys by bucket, with a number for each key.
LISTS = "chunk long, place int, keys binary, numbers binary"


def _nulls(*columns: str) -> list[Column]:
    return [F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in columns)]


def _compressed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _plain(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _packed(values: np.ndarray) -> bytes:
    return _compressed(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    """What _packed() took: the first bytes of all values stand together, then the second ones."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_plain(data), np.uint8).reshape(width, -1).T).view(kind).ravel()


def _joined(words: list[bytes]) -> bytes:
    return _compressed(b" ".join(words))


def _words(data: bytes) -> list[bytes]:
    """What _joined() took, at least one word; none has a blank in it."""
    return _plain(data).split(b" ")


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and for each key its place among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1]) if len(keys) else np.zeros(0, bool)
    of = np.empty(len(keys), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], of


def _added(of: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by place; exact, as none reaches 2**53."""
    return np.rint(np.bincount(of, numbers, n)).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _before(values: np.ndarray, starts: np.ndarray, first: float) -> np.ndarray:
    """For each token the value of the one before it, and first at the start of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = first
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, text) as chunks of CHUNK_BYTES of text or a little more; the end is the first word of each."""
    from pyspark import TaskContext

    number, size = TaskContext.get().partitionId() << 24, 0
    places: dict[bytes, int] = defaultdict(count().__next__)
    texts: list[np.ndarray] = []
    ids: list = []
    id_type = None

    def chunk() -> pa.RecordBatch:
        held = np.array([held_out(i) for i in ids], np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        whole = np.concatenate(texts)
        trained = np.bincount(whole[np.repeat(held, lengths) == 0], minlength=len(places))
        blobs = [_packed(held), _packed(lengths), _packed(whole), _joined(list(places)), _packed(trained)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(id_type)), *(pa.array([b], pa.binary()) for b in blobs)], ["chunk", "ids", "held", "lengths", "places", "words", "trained"])

    for batch in batches:
        id_type = batch.schema.field(0).type
        for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not texts:
                places[END]  # noqa: B018
            text = value.as_py() or b""
            tokens = text.lower().split()  # of bytes: A-Z only, ASCII white space only
            tokens.append(END)
            texts.append(np.fromiter(map(places.__getitem__, tokens), np.uint32, len(tokens)))
            ids.append(doc_id)
            size += len(text)
            if size > CHUNK_BYTES:
                yield chunk()
                number, size, places, texts, ids = number + 1, 0, defaultdict(count().__next__), [], []
    if texts:
        yield chunk()
    pa.default_memory_pool().release_unused()


@dataclass
class Chunk:
    """A chunk's tokens, as places in its list of words, which is in the order of their keys."""

    number: int
    starts: np.ndarray
    lengths: np.ndarray
    held: np.ndarray
    trained: np.ndarray
    words: list[bytes]
    hashes: np.ndarray
    places: np.ndarray
    end: int

    @classmethod
    def read(cls, row: dict) -> Chunk:
        import xxhash

        words = _words(row["words"])
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        lengths, held = _unpacked(row["lengths"], np.int64), _unpacked(row["held"], np.uint8)
        return cls(row["chunk"], np.cumsum(lengths) - lengths, lengths, held, np.repeat(held, lengths) == 0, [words[i] for i in order], hashes[order], rank[_unpacked(row["places"], np.uint32)], int(rank[0]))

    def grams(self, key_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """From words on, by the tokens before: the distinct keys in order, and for each token the place of its own."""
        cut = np.uint64(64 - key_bits)
        yield self.hashes >> cut, self.places
        out = shifted = self.hashes[self.places]
        for _ in range(TOKENS):
            shifted = _before(shifted, self.starts, self.hashes[self.end])
            out = _mixed(out + np.uint64(0x9E3779B97F4A7C15)) + shifted
            yield _grouped(_mixed(out) >> cut)

    def contexts(self, key_bits: int, answers: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By length: the keys that contexts can have and how often training has them; for each token the place of its context among them, how often training has that (0 where it would begin before a text's start, but for the end that stands there), and the token with it."""
        shorter = None
        for d, (keys, of) in enumerate(self.grams(key_bits)):
            counts = answers[d]
            if shorter:
                n = (before := shorter[1])[places := _before(shorter[2], self.starts, self.end if d == 1 else 0)]
                if d > 1:
                    n[self.starts] = 0
                yield shorter[0], before, places, n, counts[of]
            shorter = keys, counts, of


@dataclass(frozen=True)
class Sizes:
    """The bits of a hash key, and its leading ones that name its bucket."""

    key_bits: int
    bucket_bits: int

    @classmethod
    def of(cls, docs: DataFrame) -> Sizes:
        """A bucket for about 4 MB of input, between 16 and a million."""
        size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return cls(min(64, size.bit_length() + SPARE_BITS), min(20, max(4, (size // 4_000_000).bit_length())))

    def cuts(self, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bucket, from, to) of sorted keys."""
        at = np.searchsorted(keys, np.arange(1, 1 << self.bucket_bits, dtype=np.uint64) << np.uint64(self.key_bits - self.bucket_bits))
        at = np.concatenate([[0], at, [len(keys)]])
        return ((int(b), int(at[b]), int(at[b + 1])) for b in np.flatnonzero(at[1:] > at[:-1]))

    def lists(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's words and n-grams with their counts in its training documents, in lists by bucket; words as they are, keys as differences."""
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk.read({c: batch.column(c)[i].as_py() for c in batch.schema.names})
                for d, (keys, of) in enumerate(chunk.grams(self.key_bits)):
                    numbers, cuts = np.bincount(of[chunk.trained], minlength=len(keys)), list(self.cuts(keys))
                    lists = [_packed(np.diff(keys[a:b], prepend=np.uint64(0))) if d else _joined(chunk.words[a:b]) for _, a, b in cuts]
                    columns = [pa.array([chunk.number] * len(cuts), pa.int64()), pa.array([d << 24 | c[0] for c in cuts], pa.int32()), pa.array(lists, pa.binary()), pa.array([_packed(numbers[a:b]) for _, a, b in cuts], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["chunk", "place", "keys", "numbers"])

    @staticmethod
    def answered(found: pa.Table, row: int, kind: type) -> dict[int, np.ndarray]:
        """By depth, the buckets' answers to a chunk's lists, in their order."""
        rows = found.filter(pc.equal(found.column("row"), row)).sort_by("place")
        out: dict[int, list[np.ndarray]] = {d: [np.zeros(0, kind)] for d in range(TOKENS + 1)}
        for place, packed in zip(rows.column("place").to_pylist(), rows.column("packed"), strict=True):
            out[place >> 24].append(_unpacked(packed.as_py(), kind))
        return {d: np.concatenate(parts) for d, parts in out.items()}

    def gains(self, chunks: pa.Table, found: pa.Table, total: int, distinct: int) -> pa.Table:
        """What the chunk's own training tokens gain from each of its contexts, in lists by bucket and in the order of its keys; 0 from a context of held-out documents only."""
        chunk = Chunk.read(chunks.to_pylist()[0])
        answers = self.answered(found, 0, np.int64)
        own, out = chunk.trained, []
        p = answers[0][chunk.places[own]] / max(total + distinct, 1)
        for d, (keys, times, places, n, c) in enumerate(chunk.contexts(self.key_bits, answers), 1):
            n, c = n[own], c[own]
            left = (c - 1 + PRIOR[d - 1] * p) / (np.maximum(n - 1, 0) + PRIOR[d - 1])
            gain = np.where(n >= LEAST_CONTEXT, np.rint(UNIT * np.log(left / p)), 0)
            asked = times >= LEAST_CONTEXT
            gained = _added(places[own], gain, len(keys))[asked]
            for bucket, a, b in self.cuts(keys[asked]):
                out.append((chunk.number, d - 1 << 24 | bucket, _packed(gained[a:b])))
            p = np.where(n >= LEAST_CONTEXT, left, p)
        columns = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "place", "numbers"])

    def scores(self, chunks: pa.Table, found: pa.Table, total: int, distinct: int) -> pa.Table:
        chunk = Chunk.read(chunks.drop_columns(["ids"]).to_pylist()[0])
        answers, flags = self.answered(found, 0, np.int64), self.answered(found, 1, np.uint8)
        c = answers[0]
        # Natural logarithms: a long word's probability can be too small for a float.
        root = np.log(c / max(total + distinct, 1), out=np.full(len(c), np.nan), where=c > 0)
        spelled = found.filter(pc.equal(found.column("row"), 2))
        trees = dict(zip(spelled.column("word").to_pylist(), spelled.column("tree").to_pylist(), strict=True))
        unseen = np.flatnonzero(c == 0)
        root[unseen] = np.fromiter((trees[chunk.words[i]] for i in unseen), float, len(unseen)) + (np.log(distinct / (total + distinct)) if total else 0.0)
        score = p = root[chunk.places]
        for d, (_, times, places, n, own) in enumerate(chunk.contexts(self.key_bits, answers), 1):
            kept = np.zeros(len(times), bool)
            kept[times >= LEAST_CONTEXT] = flags[d - 1] > 0
            is_context = n >= LEAST_CONTEXT
            logs = np.log(own, out=np.full(len(own), -np.inf), where=own > 0)
            p = np.where(is_context, np.logaddexp(logs, p + np.log(PRIOR[d - 1])) - np.log(n + PRIOR[d - 1]), p)
            score = np.where(is_context & kept[places], p, score)
        base = np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
        sums = [np.add.reduceat(x, chunk.starts) for x in ((c > 0)[chunk.places].astype(np.int64), base[chunk.places], score)]
        size = len(chunk.starts)
        columns = [chunks.column("ids").combine_chunks().flatten(), pa.array(chunk.held == 1), pa.array(chunk.lengths), pa.array(sums[0]), pa.array([total] * size, pa.int64()), pa.array(sums[1]), pa.array(sums[2] / np.log(10))]
        return pa.table(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _summed(table: pa.Table) -> pa.Table:
    """For each list of a bucket the counts of its keys over all chunks, in the same order, and of those that can be contexts their places among all in the bucket. Of words, also those of the list that training does not have, and a row with the bucket's vocabulary."""
    depth = table.column("place")[0].as_py() >> 24
    lists = [_unpacked(x.as_py(), np.int64) for x in table.column("numbers")]
    ends = np.cumsum([0, *map(len, lists)])
    numbers = np.concatenate(lists)
    del lists
    vocabulary: list[bytes] = []
    unknown: list[list[bytes] | None] = [None] * table.num_rows
    if depth == 0:
        words = [w for x in table.column("keys") for w in _words(x.as_py())]
        coded = pa.array(words, pa.binary()).dictionary_encode()
        of = coded.indices.to_numpy()
        sums = _added(of, numbers, len(coded.dictionary))
        unknown = [[words[i] for i in range(a, b) if sums[of[i]] == 0] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        vocabulary = coded.dictionary.filter(pa.array(sums > 0)).to_pylist()
    else:
        distinct, of = _grouped(np.concatenate([np.cumsum(_unpacked(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("keys")]))
        sums = _added(of, numbers, len(distinct))
    found = sums[of]
    is_context = sums >= LEAST_CONTEXT
    number = np.cumsum(is_context) - 1
    contexts = [_packed(np.diff(number[of[a:b]][found[a:b] >= LEAST_CONTEXT], prepend=0)) for a, b in zip(ends[:-1], ends[1:], strict=True)] if depth < TOKENS else [None] * table.num_rows
    rows = {
        "chunk": table.column("chunk").to_pylist(),
        "place": table.column("place").to_pylist(),
        "packed": [_packed(found[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)],
        "contexts": contexts,
        "unknown": unknown,
        "vocabulary": [None] * table.num_rows,
        "n": [None] * table.num_rows,
        "v": [None] * table.num_rows,
    }
    if vocabulary:
        for name, value in zip(rows, (None, None, None, None, None, _joined(vocabulary), int(sums.sum()), len(vocabulary)), strict=True):
            rows[name].append(value)
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))


def _retained(gains: pa.Table, contexts: pa.Table) -> pa.Table:
    """For each list of gains in a bucket, which of its contexts gain enough over all chunks."""
    places = dict(zip(contexts.column("of").to_pylist(), contexts.column("contexts"), strict=True))
    of = [np.cumsum(_unpacked(places[chunk].as_py(), np.int64)) for chunk in gains.column("chunk").to_pylist()]
    if not of:
        return pa.table([gains.column("chunk"), gains.column("place"), pa.array([], pa.binary())], names=["chunk", "place", "packed"])
    numbers = np.concatenate([_unpacked(x.as_py(), np.int64) for x in gains.column("numbers")])
    ends = np.cumsum([0, *map(len, of)])
    every = np.concatenate(of)
    kept = (_added(every, numbers, int(every.max()) + 1) >= UNIT * LEAST_GAIN)[every].astype(np.uint8)
    return pa.table([gains.column("chunk"), gains.column("place"), pa.array([_packed(kept[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["chunk", "place", "packed"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(_words(data.as_py()), pa.binary())], ["word"])


def windows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each word, the DEPTH bytes before it and itself as one number, and the word's place. Before the word stand a blank and zeros."""
    pad = b"\0" * (DEPTH - 1) + b" "
    joined = np.frombuffer(b"".join(pad + (w + b" " if w else b"\n") for w in words) or b"", np.uint8)
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    starts = np.cumsum(lengths + DEPTH) - lengths
    of = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    code = np.zeros(len(of), np.int64)
    for j in range(DEPTH, -1, -1):
        code = code << 8 | joined[at - j]
    return code, of


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The codes of words with their occurrences, added up as far as memory allows."""
    codes, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], ["code", "c"])

    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK_WORDS):
            code, _ = windows(batch.column(0).slice(k, BLOCK_WORDS).to_pylist())
            every, of = _grouped(np.append(codes, code))
            codes, sums = every, _added(of, np.append(sums, np.ones(len(code), np.int64)), len(every))
            if len(codes) > 2_000_000:
                yield out()
                codes, sums = codes[:0], sums[:0]
    yield out()


@dataclass
class Level:
    """Contexts of one length, in order, with their occurrences n, different next bytes d and whether they are kept; grams are contexts with the next byte, with their occurrences c and share of the context."""

    grams: np.ndarray
    c: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    n: np.ndarray
    d: np.ndarray
    kept: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, times: np.ndarray, length: int, shorter: Level | None) -> Level:
        grams, of = _grouped(codes & ((1 << 8 * (length + 1)) - 1))
        c = _added(of, times, len(grams))
        contexts, of = _grouped(grams >> 8)
        n, d = _added(of, c, len(contexts)), np.bincount(of, minlength=len(contexts))
        share = c / n[of]
        if shorter is None:
            return cls(grams, c, share, contexts, n, d, np.ones(len(contexts), bool))
        parent = shorter.share[np.searchsorted(shorter.grams, grams & ((1 << 8 * length) - 1))]
        gain = np.bincount(of, c * np.log(share / parent), len(contexts))
        return cls(grams, c, share, contexts, n, d, (n >= LEAST_COUNT) & (gain >= LEAST_BYTE_GAIN))

    def smoothed(self, codes: np.ndarray, length: int, p: np.ndarray) -> np.ndarray:
        """Probabilities of the last byte of codes by this length's contexts, p being those by shorter ones."""
        if not len(self.grams):
            return p
        wanted = codes & ((1 << 8 * (length + 1)) - 1)
        at = np.minimum(np.searchsorted(self.contexts, wanted >> 8), len(self.contexts) - 1)
        is_kept = (self.contexts[at] == wanted >> 8) & self.kept[at]
        gram = np.minimum(np.searchsorted(self.grams, wanted), len(self.grams) - 1)
        c = np.where(self.grams[gram] == wanted, self.c[gram], 0)
        return np.where(is_kept, (c + self.d[at] * p) / (self.n[at] + self.d[at]), p)


def spelling(vocabulary: DataFrame, asked: DataFrame) -> DataFrame:
    """(word, tree): for each of asked (word binary) the natural logarithm of its probability by the bytes of vocabulary (word binary, each once)."""
    codes = stored(vocabulary.mapInArrow(_codes, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")), "codes")
    # Pairs of bytes: 65,536 rows at most. The rest of the tree is below one pair of context bytes each.
    pairs = codes.groupBy(F.col("code").bitwiseAND(0xFFFF).alias("code")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow()
    code, c = (pairs.column(k).to_numpy().astype(np.int64) for k in ("code", "c"))
    root = Level.of(code, c, 0, None)
    first = Level.of(code, c, 1, root)
    groups = max(1, int(pc.sum(pairs.column("n")).as_py() or 0) // GROUP_CODES)
    group = F.pmod(F.xxhash64(F.shiftright("code", 8).bitwiseAND(0xFFFF)), F.lit(groups))

    def evaluated(trained: pa.Table, wanted: pa.Table) -> pa.Table:
        codes, times = (trained.column(k).to_numpy() for k in ("code", "c"))
        asked = wanted.column("code").to_numpy()
        levels = [root, first]
        # A group has all codes of its pairs: counts of contexts of two bytes and more are whole.
        p = np.full(len(asked), 1 / 256)
        for length in range(DEPTH + 1):
            if length > 1:
                levels.append(Level.of(codes, times, length, levels[-1]))
            p = levels[length].smoothed(asked, length, p)
        return pa.table([wanted.column("block"), wanted.column("code"), pa.array(np.log(p))], names=["block", "code", "p"])

    blocks = stored(asked.mapInArrow(_blocks, "block long, word binary, code long"), "blocks")
    wanted = blocks.where("code is not null").select("block", "code")
    valued = codes.groupBy(group).cogroup(wanted.groupBy(group)).applyInArrow(evaluated, "block long, code long, p double")

    def summed(words: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("code").to_numpy())
        known, logs = found.column("code").to_numpy()[order], found.column("p").to_numpy()[order]
        code, of = windows(words.column("word").to_pylist())
        at = np.searchsorted(known, code)
        assert (known[at] == code).all()
        return pa.table([words.column("word"), pa.array(np.bincount(of, logs[at], words.num_rows))], names=["word", "tree"])

    words = blocks.where("word is not null").select(F.col("block").alias("of_block"), "word")
    return words.groupBy("of_block").cogroup(valued.groupBy("block")).applyInArrow(summed, "word binary, tree double")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words in blocks, and after each block its different codes."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 24
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK_WORDS):
            words = batch.column(0).slice(k, BLOCK_WORDS)
            codes = np.unique(windows(words.to_pylist())[0])
            for n, word, code in ((len(words), words, None), (len(codes), None, codes)):
                yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), pa.nulls(n, pa.binary()) if word is None else word, pa.nulls(n, pa.int64()) if code is None else pa.array(code)], ["block", "word", "code"])
            number += 1
