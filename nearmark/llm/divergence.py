"""Operator 4: quality rules, with the divergence of a document from its language.

Two histograms of a document are held against those of its language: character classes, and the ``COMMON`` commonest words
of the language with one bin for all others. The distance is the square root of the Jensen-Shannon divergence (base 2, so
0 to 1). A document goes if a distance is above its threshold and the document is long enough for that histogram to mean
something. Before that the base rules hold: too few words, or too many words in repeated 3-word windows.

References come from all documents: one pass counts short lower-case words by language and keeps the commonest, a second
makes the histograms, which are summed twice, the second time without the documents that stand apart from the first sums. Every language has a reference, however many there are: the table of them (``COMMON`` words and
some sums a language) is written and joined by language, and Spark chooses the join by its size. Rows with null lang, and those of a language of
which every row stands apart from the first sums, get their distance from the characters of all documents, which is only told
and rejects nothing.

DataFrame functions only. Null text: no words, fails the base rules. A table without words has no reference; then the
distances are null and reject nothing. Every row is judged by itself, so repeated rows agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearmark.session import scratch_path

COMMON = 24
WORD_LETTERS = 8
MIN_WORDS, REPEAT_PERCENT = 50, 50
MIN_CHARS_JS, MAX_CHARS_JS = 200, 0.18
MIN_WORDS_JS, MAX_WORDS_JS = 80, 0.3
WHITE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
LOWER = r"^[\p{L}\p{M}&&[^\p{Lu}\p{Lt}]]+$"  # letters without case count as lower case
# The classes of characters, as patterns of a run; what is in none is the last class.
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", rf"{WHITE}+", r"[.,;:'\"()-]+", rf"{SYMBOLS}+", "[^\\x00-\\x7F]+")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{WHITE}+"), "")


def with_words(docs: DataFrame) -> DataFrame:
    """The columns text and lang as _t and _l, and the words."""
    return docs.withColumn("_t", F.coalesce(F.col("text"), F.lit(""))).withColumn("_l", F.col("lang").cast("string")) \
        .withColumn("_w", words_of(F.col("_t")))


def repeated_words(df: DataFrame) -> DataFrame:
    """Adds _rep: how many of the words _w stand in a 3-word window that the text has twice or more.

    Hashes of the windows tell which texts repeat none; the others sort the hashes, and neighbours with one hash are compared
    as windows. (Two windows of one text with the same 64-bit hash could hide a repeat between them.)
    """
    n = F.size("_w")
    df = df.withColumn("_z", F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", 2, F.greatest(n, F.lit(1))).alias("b"),
                                          F.slice("_w", 3, F.greatest(n, F.lit(1))).alias("c")))
    df = df.withColumn("_z", F.slice("_z", 1, F.greatest(n - 2, F.lit(0))))
    df = df.withColumn("_h", F.transform("_z", lambda x: F.xxhash64(x)))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"),
                                    F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (F.get("_z", x["i"]) == F.get("_z", y["i"])), F.lit(False))
    df = df.withColumn("_p", F.transform(
        F.filter("_s", lambda x, k: same(x, F.get("_s", k - 1)) | same(x, F.get("_s", k + 1))), lambda x: x["i"]))
    return df.withColumn("_rep", F.coalesce(F.when(F.col("_p").isNotNull(), F.size(F.array_distinct(
        F.flatten(F.transform("_p", lambda i: F.array(i, i + 1, i + 2)))))), F.lit(0)).cast("long"))


def class_counts(df: DataFrame) -> DataFrame:
    """Adds _c, the characters of _t by class. Each class is deleted from what the ones before have left."""
    left = "_t"
    for i, pattern in enumerate(CLASSES):
        df = df.withColumn(f"_c{i}", F.regexp_replace(left, pattern, ""))
        left = f"_c{i}"
    lengths = [F.length("_t"), *[F.length(f"_c{i}") for i in range(len(CLASSES))], F.lit(0)]
    df = df.withColumn("_c", F.array(*[(x - y).cast("long") for x, y in zip(lengths, lengths[1:], strict=False)]))
    return df.drop(*[f"_c{i}" for i in range(len(CLASSES))])


def histograms(df: DataFrame) -> DataFrame:
    """Adds _c and _f, the class and word histograms, and _n, the characters in words, to rows with _t, _w, common and longest."""
    def times(w):
        mark = F.concat(F.lit(" "), w, F.lit(" "))
        return ((F.length("_j") - F.length(F.replace(F.col("_j"), mark, F.lit("")))) / F.length(mark)).cast("long")

    df = class_counts(df).withColumn("_j", F.array_join(F.filter("_w", lambda w: F.length(w) <= F.col("longest")), "  "))
    df = df.withColumn("_j", F.concat(F.lit(" "), "_j", F.lit(" "))).withColumn("_m", F.transform("common", times))
    found = F.aggregate("_m", F.lit(0).cast("long"), lambda x, y: x + y)
    return df.withColumn("_f", F.concat("_m", F.array(F.size("_w") - found))).withColumn("_n", F.length("_t") - F.col("_c")[3]).drop("_j", "_m")


def common_words(docs: DataFrame) -> DataFrame:
    """(lang, common, longest) of each language that has any: its commonest short words without upper case, ties by the word."""
    words = with_words(docs.select("text", "lang")).where("_l is not null").select("_l", F.explode("_w").alias("word"))
    each = words.where(F.length("word") <= WORD_LETTERS).groupBy("_l", "word").agg(F.count(F.lit(1)).alias("n"))
    each = each.where(F.col("word").rlike(LOWER) & (F.col("n") > 0))  # with n, so that it stays behind the sum
    top = each.withColumn("rank", F.row_number().over(Window.partitionBy("_l").orderBy(F.desc("n"), "word")))
    return top.where(F.col("rank") <= COMMON).groupBy(F.col("_l").alias("lang")).agg(
        F.array_sort(F.collect_list("word")).alias("common"), F.max(F.length("word")).alias("longest"))


def with_language(df: DataFrame, refs: DataFrame, *cols: str) -> DataFrame:
    """Adds columns of the row's language, null without a reference."""
    return df.join(refs.select(F.col("lang").alias("_l"), *cols), "_l", "left")


def written(df: DataFrame, name: str) -> DataFrame:
    """df from files, whose size Spark knows when it plans a join (that of a checkpoint it guesses from what made it)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def distances(df: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds chars_js, words_js and _own (whether chars_js is from the row's language) to rows with _l, _c and _f. refs has lang
    null for the one over all documents."""
    whole = refs.where("lang is null").select(F.col("chars").alias("_all"))
    df = with_language(df, refs.where("lang is not null"), "chars", "words").join(F.broadcast(whole), how="left")
    return df.withColumn("_own", F.col("chars").isNotNull()).withColumn("chars_js", js_distance(F.col("_c"), F.coalesce("chars", "_all"))) \
        .withColumn("words_js", js_distance(F.col("_f"), F.col("words"))).drop("chars", "words", "_all")


def odd(max_chars_js: float, max_words_js: float) -> Column:
    """Whether a row stands apart from its language; short rows and those whose language has no reference never do."""
    return F.coalesce((F.col("_own") & (F.col("_n") >= MIN_CHARS_JS) & (F.col("chars_js") > max_chars_js))
                      | ((F.col("_nw") >= MIN_WORDS_JS) & (F.col("words_js") > max_words_js)), F.lit(False))


def references(each: DataFrame, max_chars_js: float, max_words_js: float) -> DataFrame:
    """(lang, common, longest, chars, words): histograms and common words (null and [] where there are none) of each language, and
    with lang null those of all documents together (characters only). ``each`` has the histograms of every document.

    The first sums are over all documents; the second leave out those that stand apart from the first, so that junk does not
    make its own reference.
    """

    def sums(rows: DataFrame) -> DataFrame:
        own = rows.where("_l is not null").groupBy(F.col("_l").alias("lang"), "common", "longest").agg(
            F.array(*[F.sum(F.col("_c")[i]) for i in range(len(CLASSES) + 1)]).alias("chars"),
            F.filter(F.array(*[F.sum(F.get("_f", F.lit(i))) for i in range(COMMON + 1)]), lambda x: x.isNotNull()).alias("words"))
        none = F.lit(None)
        whole = rows.agg(F.array(*[F.sum(F.col("_c")[i]) for i in range(len(CLASSES) + 1)]).alias("chars"))
        return own.unionByName(whole.select(none.cast("string").alias("lang"), none.cast("array<string>").alias("common"), none.cast("int").alias("longest"), "chars",
                                            none.cast("array<bigint>").alias("words")))

    first = written(sums(each), "quality-first")
    return written(sums(distances(each, first).where(~odd(max_chars_js, max_words_js))), "quality-refs")


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two histograms with as many bins; null if one is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def distance(of):
        terms = F.zip_with(a, b, lambda x, y: F.struct((x / of["a"]).alias("p"), (y / of["b"]).alias("q")))
        half = F.transform(terms, lambda t: part(t["p"], (t["p"] + t["q"]) / 2) + part(t["q"], (t["p"] + t["q"]) / 2))
        return F.when((of["a"] > 0) & (of["b"] > 0), F.sqrt(F.greatest(total(half) / 2, F.lit(0.0))))

    # the totals are bound as the one element of an array, so that they are made once and not for each bin
    return F.transform(F.array(F.struct(total(a).alias("a"), total(b).alias("b"))), distance)[0]


def with_histograms(docs: DataFrame, common: DataFrame) -> DataFrame:
    """docs with _w, _t, _l, the language's common words, _nw (how many words), _n, _c and _f."""
    rows = with_language(with_words(docs), common, "common", "longest")
    return histograms(rows).withColumn("_nw", F.size("_w").cast("long"))


def with_base(rows: DataFrame) -> DataFrame:
    """Adds _rep and _dup, the words in repeated windows and the repeated lines."""
    rows = repeated_words(rows).withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return rows.withColumn("_dup", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))


def verdict(max_chars_js: float, max_words_js: float) -> Column:
    """The struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, chars_js and words_js."""
    failed = (F.col("_nw") < MIN_WORDS) | (100 * F.col("_rep") > REPEAT_PERCENT * F.col("_nw"))
    return F.struct(F.col("_nw").alias("n_words"), F.col("_n").cast("long").alias("word_chars"), F.col("_c")[5].alias("n_symbols"),
                    F.col("_dup").alias("n_dup_lines"), F.col("_rep").alias("n_repeat_words"), failed.alias("base_failed"),
                    (~failed & ~odd(max_chars_js, max_words_js)).alias("kept"), "chars_js", "words_js")


def judge(docs: DataFrame, max_chars_js: float = MAX_CHARS_JS, max_words_js: float = MAX_WORDS_JS) -> DataFrame:
    """doc_id and the verdict's fields for each row of docs. The measures are made in one pass and written; no text is."""
    d = docs.select("doc_id", "text", "lang")
    each = with_base(with_histograms(d, written(common_words(d), "quality-common")))
    each = each.select("doc_id", "_l", "common", "longest", "_nw", "_n", "_c", "_f", "_rep", "_dup").checkpoint()
    return distances(each, references(each, max_chars_js, max_words_js)).select("doc_id", verdict(max_chars_js, max_words_js).alias("_q")) \
        .select("doc_id", "_q.*")


def keep(docs: DataFrame, max_chars_js: float = MAX_CHARS_JS, max_words_js: float = MAX_WORDS_JS) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. The texts are read twice rather than written."""
    common = written(common_words(docs.select("text", "lang")), "quality-common")
    each = with_histograms(docs.select("text", "lang"), common).select("_l", "common", "longest", "_nw", "_n", "_c", "_f").checkpoint()
    refs = references(each, max_chars_js, max_words_js)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text", "lang")
    rows = with_base(with_histograms(rows, common)).drop("text", "lang")
    rows = distances(rows, refs).withColumn("_kept", verdict(max_chars_js, max_words_js)["kept"])
    # a filter would be pushed through all these columns and make them again inside each other; it stops at a row number
    return rows.withColumn("_at", F.monotonically_increasing_id()).where("_kept and _at >= 0").select("_row.*")


def digest(docs: DataFrame) -> DataFrame:
    return judge(docs)
