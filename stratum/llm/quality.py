"""Quality rules: repetition and length counts, and the divergence of a document from references of its language.

All of it is built-in column functions. A document's histograms of character classes and of its language's common
words, which are counted over all of the language's documents, are compared to the language's reference by the
Jensen-Shannon distance (base 2, between 0 and 1). The reference is the median over all documents of the language, class by class, in thousandths, so that it does not
depend on the junk that the rules are to find, as long as that is not most of the language. Distances of short
documents are mostly noise: each has a least length from which on it counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import SPACE, stored

#: A language's common words are the N_COMMON most frequent of those that make up 1 / COMMON_PART of its words or more, of which there are COMMON_PART at most.
N_COMMON, COMMON_PART = 8, 500
SYMBOLS = "#*$%&|<>"
#: Words of a window, and the shares at which the base rules reject.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Distances from which on a document is rejected, and the least characters and words at which they count.
MOST_CHAR_DISTANCE, LEAST_CHARS = 0.20, 200
MOST_WORD_DISTANCE, LEAST_COMPARED_WORDS = 0.24, 80
#: The weight, in documents, of what the references of few documents are drawn to.
PRIOR_DOCS = 20
#: References are broadcast up to so many languages.
BROADCAST_LANGUAGES = 10_000


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once: a name inside a lambda would be computed for every element."""
    return F.transform(F.array(value), then)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of WINDOW words that the text has twice or more, the first included."""

    def covered(windows: Column) -> Column:
        # Equal windows stand together once sorted; their places then cover WINDOW words each, less the overlap.
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda p: p.isNotNull())
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(F.array_sort(let(pairs, again)), start, step, lambda acc: acc["n"])

    def joined(codes: Column, by: int) -> Column:
        """Codes of runs twice as long: each code with the one that stands by places further."""
        return let(codes, lambda h: F.zip_with(h, F.slice(h, 1 + by, F.size(h)), lambda x, y: F.xxhash64(x, y)))

    codes = F.transform(words, lambda w: F.xxhash64(w))
    for by in (1, 2, 4):
        codes = joined(codes, by)
    # The last codes stand for runs that the text's end cuts off.
    windows = F.slice(codes, 1, F.size(words) - (WINDOW - 1))
    count = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))
    return F.when(F.size(words) > WINDOW, count).otherwise(F.lit(0).cast("long"))


def char_classes(text: Column, word_chars: Column) -> Column:
    """Characters that are lower-case letters, capitals, digits, white space, SYMBOLS and others."""
    n = F.length(text)
    only = lambda kind: F.length(F.regexp_replace(text, f"[^{kind}]+", ""))
    lower = n - F.length(F.regexp_replace(text, r"\p{Ll}+", ""))
    return let(F.array(lower, only(r"\p{Lu}"), only(r"\p{Nd}"), n - word_chars, only(SYMBOLS)), lambda c: F.concat(c, F.array(n - F.aggregate(c, F.lit(0), lambda s, v: s + v))))


def common_counts(words: Column, common: Column) -> Column:
    """How often each of the common words stands in words, and the number of other words; null where there are none."""
    n = F.size(words)
    counts = F.transform(common, lambda c: n - F.size(F.array_remove(words, c)))
    return let(counts, lambda c: F.concat(c, F.array(n - F.aggregate(c, F.lit(0), lambda s, v: s + v))))


def thousandths(histogram: Column) -> Column:
    """Shares of a histogram, rounded; null if it is empty."""
    shares = lambda h: let(F.aggregate(h, F.lit(0).cast("long"), lambda s, v: s + v), lambda t: F.when(t > 0, F.transform(h, lambda c: F.round(1000 * c / t).cast("int"))))
    return let(histogram, shares)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms; null where one is null or empty."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, v: s + v)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    share = lambda h: let(h, lambda h: let(total(h), lambda t: F.when(t > 0, F.transform(h, lambda v: v / t))))
    terms = F.zip_with(share(p), share(q), lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return let(total(terms), lambda d: F.when(d.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), d))))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES else df


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(of_lang, common): each language's common words in lower case, which have a letter, the most frequent first, ties by code points. A null lang is a language of its own."""
    words = docs.select(docs[lang_col].cast("string").alias("of_lang"), F.explode(words_of(F.lower(docs[text_col].cast("string")))).alias("word"))
    counts = stored(words.groupBy("of_lang", "word").agg(F.count("*").alias("c")), "words")
    total = counts.groupBy(F.col("of_lang").alias("t_lang")).agg(F.sum("c").alias("total"))
    frequent = counts.join(_small(stored(total, "totals")), F.col("of_lang").eqNullSafe(F.col("t_lang"))).where((COMMON_PART * F.col("c") >= F.col("total")) & F.col("word").rlike(r"\p{L}"))
    # A language has COMMON_PART such words at most.
    ranked = frequent.groupBy("of_lang").agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "word"))).alias("all"))
    return ranked.select("of_lang", F.slice(F.transform("all", lambda x: x["word"]), 1, N_COMMON).alias("common"))


def references(measured: DataFrame) -> DataFrame:
    """(ref_lang, ref_chars, ref_words, trust): each language's median shares of the character classes and common words, over all its documents with text.

    Few documents tell little of their language. So ref_chars is drawn to the medians of all languages with the weight
    of PRIOR_DOCS documents, and trust is m / (m + PRIOR_DOCS), m being the documents behind ref_words.
    """
    shares = measured.select(F.col("lang").alias("ref_lang"), thousandths(F.col("classes")).alias("c"), thousandths(F.col("hits")).alias("w"))
    chars, words = [f"c{i}" for i in range(6)], [f"w{i}" for i in range(N_COMMON + 1)]
    flat = shares.select("ref_lang", *(F.get("c", F.lit(i)).alias(c) for i, c in enumerate(chars)), *(F.get("w", F.lit(i)).alias(w) for i, w in enumerate(words)))
    medians = flat.groupBy("ref_lang").agg(F.count("c0").alias("n"), F.count("w0").alias("m"), *(F.median(c).alias(c) for c in chars + words))
    every = flat.agg(*(F.median(c).alias(f"all_{c}") for c in chars))
    drawn = lambda c: (F.col("n") * F.coalesce(c, F.lit(0.0)) + PRIOR_DOCS * F.col(f"all_{c}")) / (F.col("n") + PRIOR_DOCS)
    # every is one row.
    return medians.crossJoin(F.broadcast(every)).select("ref_lang", F.array(*(drawn(c) for c in chars)).alias("ref_chars"), F.filter(F.array(*words), lambda v: v.isNotNull()).alias("ref_words"), (F.col("m") / (F.col("m") + PRIOR_DOCS)).alias("trust"))


def judged(docs: DataFrame, columns: Sequence[str] | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(row, quality): a struct of the columns of docs (all, if none are given), and what with_quality() says of it.

    Texts are read twice: for the common words, and for a table of counts and histograms from which references and
    verdicts are made.
    """
    # The row's own columns go together, so that their names cannot clash with these.
    row = F.struct(*(docs[c] for c in columns or docs.columns)).alias("row")
    text = F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    lang = docs[lang_col].cast("string").alias("lang")
    common = _small(stored(common_words(docs, text_col, lang_col), "common"))
    joined = docs.select(row, text, lang).join(common, F.col("lang").eqNullSafe(F.col("of_lang")), "left")
    text, long = F.col("text"), lambda c: c.cast("long")
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: long(F.size(x) - F.size(F.array_distinct(x))))
    counts = let(words_of(text), lambda w: F.struct(long(F.size(w)).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    hits = let(words_of(F.lower(text)), lambda w: F.when(F.size(w) >= LEAST_COMPARED_WORDS, common_counts(w, F.col("common"))))
    classes = char_classes(text, F.length(F.regexp_replace(text, SPACE, "")))
    # In two steps: names inside lambdas must not be taken for those of the unpacked row.
    measured = stored(joined.select("row", "lang", F.length(text).alias("chars"), counts.alias("counts"), classes.alias("classes"), hits.alias("hits"), lines.alias("lines")), "measured")
    refs = _small(stored(references(measured), "references"))
    found = measured.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    double = lambda h: h.cast("array<double>")
    failed = (F.col("counts.n_words") < LEAST_WORDS) | (100 * F.col("counts.n_repeat_words") > MOST_REPEATED * F.col("counts.n_words"))
    char_distance = F.when(F.col("chars") >= LEAST_CHARS, distance(double(F.col("classes")), F.col("ref_chars")))
    word_distance = F.col("trust") * distance(double(F.col("hits")), F.col("ref_words"))
    class_of = lambda i: F.get("classes", F.lit(i))
    found = found.select("row", F.struct(
        F.col("counts.n_words").alias("n_words"), long(F.col("chars") - class_of(3)).alias("word_chars"), long(class_of(4)).alias("n_symbols"), F.col("lines").alias("n_dup_lines"), F.col("counts.n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"), char_distance.alias("char_distance"), word_distance.alias("word_distance"),
    ).alias("q"))
    near = (F.coalesce("q.char_distance", F.lit(0.0)) <= MOST_CHAR_DISTANCE) & (F.coalesce("q.word_distance", F.lit(0.0)) <= MOST_WORD_DISTANCE)
    return found.select("row", F.col("q").withField("kept", ~F.col("q.base_failed") & near).alias("quality"))


def with_quality(docs: DataFrame, columns: Sequence[str] | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The columns of docs (all, if none are given) with one more, quality, a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed (boolean), char_distance, word_distance (double; null where it does not count) and kept.

    Null text is empty: no words, base_failed. A null lang is a language of its own. Rows come out as often as they
    go in, and no rows give none. A column of docs that is named quality is replaced; kept_documents() keeps it.
    """
    return judged(docs, columns, text_col, lang_col).select(*(F.col("row")[c].alias(c) for c in columns or docs.columns if c != "quality"), "quality")


def kept_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, with their own columns, whatever their names."""
    return judged(docs, None, text_col, lang_col).where("quality.kept").select("row.*")
