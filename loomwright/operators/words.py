"""Indexes of words: which words hold a term, and which are within some edits of it, by equi-joins on pieces and then a check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a piece.
PIECE = 3


def pieces(word: Column) -> Column:
    """The distinct runs of PIECE letters of a word, none if it is shorter."""
    places = F.when(F.length(word) >= PIECE, F.sequence(F.lit(1), F.length(word) - (PIECE - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda k: F.substring(word, k, F.lit(PIECE))))


def holding(terms: DataFrame, words: DataFrame) -> DataFrame:
    """terms: term, of PIECE letters and more. words: word. Every pair (term, word) where the word holds the term.

    A term is looked up by its piece that the fewest words have; a term with a piece that no word has is in none. Only pieces that are asked for are counted.
    """
    asked = terms.select("term").distinct().select("term", F.explode(pieces(F.col("term"))).alias("piece"))
    postings = words.select("word").distinct().select("word", F.explode(pieces(F.col("word"))).alias("piece")).join(asked.select("piece").distinct(), "piece", "left_semi")
    sizes = postings.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(sizes, "piece", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("p"))
    met = rarest.where("p.n > 0").select("term", F.col("p.piece").alias("piece")).join(postings, "piece")
    return met.where(F.contains("word", "term")).select("term", "word")


def _cuts(length: Column, i: Column, d: Column) -> tuple[Column, Column]:
    """Where part i of d + 1 parts of a word of a length begins, and how long it is."""
    at = lambda k: F.floor(k * length / (d + 1)).cast("int")
    return at(i), at(i + 1) - at(i)


def within_edits(terms: DataFrame, words: DataFrame, limit: Callable[[Column], Column], most: int = 3) -> DataFrame:
    """terms: term. words: word. Every pair (term, word, distance) within limit(term) edits, which is 1 to `most`.

    A word cut into d + 1 parts keeps one of them whole through d edits, moved by d places at most: so words are indexed by the edits allowed, their length and each
    part, and a term looks up its own pieces for each length that is near enough. A word of d letters or fewer has empty parts, so it is compared by its length.
    """
    d = F.explode(F.sequence(F.lit(1), F.lit(most)))
    held = words.select("word").distinct().withColumn("d", d).withColumn("size", F.length("word"))
    parts = F.transform(F.sequence(F.lit(0), F.col("d")), lambda i: _part(F.col("word"), F.col("size"), i, F.col("d"), F.lit(0)))
    short = F.col("size") <= F.col("d")
    index = held.withColumn("p", F.explode(F.when(short, F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("part")))).otherwise(parts))).select("word", "d", "size", "p.i", "p.part")

    asked = terms.select("term").distinct().withColumn("d", limit(F.col("term"))).withColumn("n", F.length("term"))
    sizes = F.sequence(F.greatest(F.lit(0), F.col("n") - F.col("d")), F.col("n") + F.col("d"))

    def of_size(size: Column) -> Column:
        moved = lambda i: F.transform(F.sequence(-F.col("d"), F.col("d")), lambda by: _part(F.col("term"), size, i, F.col("d"), by))
        probes = F.flatten(F.transform(F.sequence(F.lit(0), F.col("d")), moved))
        probes = F.when(size <= F.col("d"), F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("part")))).otherwise(probes)
        return F.transform(F.array_distinct(probes), lambda p: F.struct(size.alias("size"), p["i"].alias("i"), p["part"].alias("part")))

    asked = asked.withColumn("p", F.explode(F.flatten(F.transform(sizes, of_size)))).where("p.part IS NOT NULL").select("term", "d", "p.size", "p.i", "p.part")
    met = asked.join(index, ["d", "size", "i", "part"]).select("term", "word", "d").distinct()
    return met.withColumn("distance", F.levenshtein("term", "word")).where(F.col("distance") <= F.col("d")).select("term", "word", F.col("distance").cast("long").alias("distance"))


def _part(text: Column, size: Column, i: Column, d: Column, by: Column) -> Column:
    """(i, part): what stands in text where part i of a word of a size would, moved by some places; part is null beyond the text's ends."""
    at, long = _cuts(size, i, d)
    inside = (at + by >= 0) & (at + by + long <= F.length(text))
    return F.struct(i.cast("int").alias("i"), F.when(inside, F.substring(text, at + by + 1, long)).alias("part"))
