"""Operator 11: quality rules by divergence from language references, in DataFrame functions alone.

A language's reference has two histograms, of the characters of all its documents by class (CLASSES and the rest), and of their
words: those that make SHARE of the language's words or more, which are 1 / SHARE at most, and the rest. A document is compared
with the reference of its own language by the Jensen-Shannon distance (the root of the divergence in bits: 0 alike, 1 disjoint).
A short text strays from its language by chance alone, by about the root of bins / words. So it fails where its classes are
farther than BASE + CLASS_SLACK / sqrt(words), or its words than BASE + WORD_SLACK * sqrt(bins / words). Class histograms are
judged from LEAST_CHARS code points on, word histograms from LEAST_WORDS words on.

Before that come the base rules: too few words, or too many words within windows of three words that the text holds
twice or more. Windows are told apart by 64-bit hashes within a document.

A null text has no words and fails the base rules, as an empty one does. A null language is a language of its own. Very long texts are
judged whole, within their row: no text is shuffled. Repeated rows each count in the reference and get the same verdict. An empty
table gives an empty result. Extra columns, whatever their names, are kept in a struct or ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import BLANKS, saved

#: Fixed values of the base rules.
SYMBOLS = r"[#*$%&|<>]"
FEWEST_WORDS, MOST_REPEATED = 50, 50
#: Classes of characters, the largest first; what none holds is the last class. They have no character in common.
CLASSES = [r"[a-z]", r"[\x20\x09-\x0D]", r"[A-Z]", r"[!\x22'()+,\-./:;=?@\[\\\]^_`{}~]", SYMBOLS, r"[0-9]"]
AT_BLANK, AT_SYMBOL = 1, 4
#: The least share of a language's words that makes a word common.
SHARE = 0.005
#: Of the largest distances, and the guards.
BASE, CLASS_SLACK, WORD_SLACK = 0.16, 1.2, 0.32
#: So many windows that come again are looked up one by one.
FEW = 16
LEAST_CHARS, LEAST_WORDS = 200, 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def windows_of(words: Column) -> Column:
    """A hash of each window of three words."""
    hashed = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    return let(words, lambda w: F.when(F.size(w) < 4, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: hashed(w, i))))


def repeated_words(windows: Column) -> Column:
    """How many words lie in a window of three words that occurs twice or more, its first place included."""

    def covered(p: Column) -> Column:
        each = F.transform(p, lambda at, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - at, F.lit(3))))
        return F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x)

    def sorted_places(s: Column) -> Column:
        alike = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        return F.sort_array(F.array_compact(F.transform(s, lambda x, i: F.when(F.coalesce(alike(x, i), F.lit(False)), x["at"]))))

    # the windows' hashes in order show which come again; few are looked up at each place, many are sorted with their places
    again = let(F.sort_array(windows), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1) == x, F.lit(False)))))
    few = lambda d: F.array_compact(F.transform(windows, lambda x, i: F.when(F.array_contains(d, x), i)))
    many = let(F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("at")))), sorted_places)
    return let(again, lambda d: F.when(F.size(d) == 0, F.lit(0).cast("long")).when(F.size(d) <= FEW, let(few(d), covered)).otherwise(let(many, covered)))


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def class_counts(text: Column) -> Column:
    """An array of the code points of each class, and of none. Each class is taken out of what is left of the text, which shrinks."""

    def without(rest: Column, classes: list[str], counts: list[Column]) -> Column:
        if not classes:
            return F.array(*counts, F.length(rest))
        left = F.regexp_replace(rest, f"{classes[0]}+", "")
        return let(left, lambda x: without(x, classes[1:], [*counts, F.length(rest) - F.length(x)]))

    return let(F.coalesce(text, F.lit("")), lambda t: without(t, CLASSES, []))


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: F.when(total > 0, c / total.cast("double")).otherwise(F.lit(0.0)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: (half(a, b) + half(b, a)) / 2)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def references(docs: DataFrame, text: str = "text", lang: str = "lang", share: float = SHARE) -> DataFrame:
    """Per language (of): words, the common ones; word_shares, theirs and that of the rest; class_shares. Worked out from all documents."""
    rows = docs.select(F.col(lang).alias("of"), F.col(text).alias("text"))
    rows_of = rows.select("of", F.size(words_of(F.col("text"))).alias("n"), class_counts(F.col("text")).alias("chars"))
    sums = rows_of.groupBy("of").agg(F.sum("n").alias("n"), *[F.sum(F.get("chars", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES) + 1)])
    chars = F.array(*[F.col(f"c{k}") for k in range(len(CLASSES) + 1)])
    totals = saved(sums.select("of", "n", _shares(chars, F.aggregate(chars, F.lit(0).cast("long"), lambda s, x: s + x)).alias("class_shares")), "languages")
    counted = rows.select("of", F.explode(words_of(F.col("text"))).alias("word")).groupBy("of", "word").agg(F.count(F.lit(1)).alias("times"))
    met = counted.join(totals.select(F.col("of").alias("l"), "n"), F.col("of").eqNullSafe(F.col("l"))).where(F.col("times") >= share * F.col("n"))
    listed = met.groupBy(F.col("of").alias("l")).agg(F.sort_array(F.collect_list(F.struct("word", "times"))).alias("common"))  # 1 / share at most
    found = totals.join(listed, F.col("of").eqNullSafe(F.col("l")), "left")
    common = F.coalesce("common", F.array().cast("array<struct<word:string,times:bigint>>"))
    rest = F.col("n") - F.aggregate(common["times"], F.lit(0).cast("long"), lambda s, x: s + x)
    return saved(found.select("of", "class_shares", common["word"].alias("words"), _shares(F.concat(common["times"], F.array(rest)), F.col("n")).alias("word_shares")), "references")


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", share: float = SHARE, base: float = BASE) -> DataFrame:
    """Per row: its columns in a struct named row, the base counts, base_failed, class_distance, word_distance (null where not judged), kept."""
    known = references(docs, text, lang, share)
    rows = docs.select(F.struct("*").alias("row"), F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = F.col("text")
    rows = rows.join(known, F.col("lang").eqNullSafe(F.col("of")))  # Spark broadcasts the references if they are small, and splits languages if not
    rows = rows.withColumn("ws", words_of(t)).withColumns({"chars": class_counts(t), "windows": windows_of(F.col("ws"))})

    def histogram(ws: Column) -> Column:
        hits = F.filter(ws, lambda w: F.array_contains("words", w))
        counts = let(hits, lambda h: F.concat(F.transform("words", lambda c: F.size(F.filter(h, lambda x: x == c))), F.array(F.size(ws) - F.size(h))))
        return _shares(counts, F.size(ws))

    n_words = F.size("ws").cast("long")
    facts = rows.select(
        "row", n_words.alias("n_words"),
        (F.length(t) - F.get("chars", F.lit(AT_BLANK))).cast("long").alias("word_chars"), F.get("chars", F.lit(AT_SYMBOL)).cast("long").alias("n_symbols"),
        repeated_lines(t).alias("n_dup_lines"), repeated_words(F.col("windows")).alias("n_repeat_words"),
        F.when(F.length(t) >= LEAST_CHARS, distance(_shares(F.col("chars"), F.length(t)), F.col("class_shares"))).alias("class_distance"),
        F.when(F.size("ws") >= LEAST_WORDS, distance(let(F.col("ws"), histogram), F.col("word_shares"))).alias("word_distance"), F.size("word_shares").alias("bins"),
    )
    # null without words, where the base rules have failed
    most_class = F.lit(base) + F.try_divide(F.lit(CLASS_SLACK), F.sqrt("n_words"))
    most_word = F.lit(base) + F.lit(WORD_SLACK) * F.sqrt(F.try_divide("bins", "n_words"))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    strays = F.coalesce(F.col("class_distance") > most_class, F.lit(False)) | F.coalesce(F.col("word_distance") > most_word, F.lit(False))
    return facts.withColumn("base_failed", failed).withColumn("kept", ~failed & ~strays).drop("bins")


def quality_report(docs: DataFrame, key: str = "doc_id", **how: str) -> DataFrame:
    """Per row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return judged(docs, **how).select(F.col("row").getField(key).alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def good_documents(docs: DataFrame, **how: str) -> DataFrame:
    """The rows of docs that pass all rules."""
    return judged(docs, **how).where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
