"""A frequency dictionary and the terms in it that are a few edits from a token.

Candidates come from an equi-join on shared deletions of the first characters
(prefix_length of them), the distance is measured afterwards, and the best few
are ranked per token. Every step works on distinct tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelight.config import CorrectionSettings
from pagelight.functions.chars import fold_text, strip_ws
from pagelight.functions.distance import osa_distance


def _folded(column: Column) -> Column:
    """Full case folding, which for ASCII is lower case."""
    return fold_text(column, form="", casefold=True)


def frequency_table(terms: DataFrame, term: str = "term", frequency: str = "frequency", settings: CorrectionSettings = CorrectionSettings()) -> DataFrame:
    """(term, frequency): stripped and lowered terms, the counts of a term's rows added up.

    Null and blank terms and null counts go; so do terms with white space
    inside, and terms below count_threshold in all.
    """
    rows = terms.select(strip_ws(_folded(F.col(term))).alias("term"), F.col(frequency).cast("long").alias("frequency"))
    rows = rows.where(r"term <> '' and frequency is not null and not term rlike '\\s'")
    return rows.groupBy("term").agg(F.sum("frequency").alias("frequency")).where(F.col("frequency") >= settings.count_threshold)


def add_words(vocabulary: DataFrame, words: DataFrame) -> DataFrame:
    """The vocabulary with (term, frequency) added: counts of terms that it has grow."""
    more = words.select(_folded(strip_ws(F.col("term"))).alias("term"), F.greatest(F.col("frequency").cast("long"), F.lit(1)).alias("frequency"))
    return vocabulary.select("term", "frequency").unionByName(more).groupBy("term").agg(F.sum("frequency").alias("frequency"))


def contains(tokens: DataFrame, vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """(token, frequency, present) of each distinct token; frequency is 0 for an absent one."""
    asked = tokens.select(token).where(F.col(token).isNotNull()).distinct().withColumn("term", _folded(F.col(token)))
    found = asked.join(vocabulary, "term", "left")
    return found.select(token, F.coalesce("frequency", F.lit(0)).alias("frequency"), F.col("frequency").isNotNull().alias("present"))


def _deletions(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def delete_keys(word: Column, settings: CorrectionSettings = CorrectionSettings()) -> Column:
    """The word's first characters and all that is left of them after up to max_dictionary_edit_distance deletions."""
    start = F.substring(word, 1, settings.prefix_length)
    keys = layer = F.array(start)
    for _ in range(settings.max_dictionary_edit_distance):
        layer = F.array_distinct(F.flatten(F.transform(layer, lambda w: F.when(F.length(w) > 0, _deletions(w)).otherwise(F.array().cast("array<string>")))))
        keys = F.array_union(keys, layer)
    return keys


def suggest(tokens: DataFrame, vocabulary: DataFrame, settings: CorrectionSettings = CorrectionSettings(), token: str = "token", most: Column | None = None) -> DataFrame:
    """(token, term, distance, frequency, place): of each distinct token the best max_suggestions terms.

    include_unknown: a token without any is given itself, of a distance one
    beyond the greatest and of frequency 0.

    Order: distance, then the higher frequency, then the term. `most` is a
    column expression over the token for its greatest distance (by default the
    settings' lookup distance). Tokens are compared case-folded; a token of the
    vocabulary is its own best suggestion. Blank tokens and those beyond
    max_token_length have none.
    """
    limit = F.lit(settings.max_lookup_edit_distance) if most is None else most
    asked = tokens.select(token).where(F.col(token).isNotNull()).distinct()
    asked = asked.withColumn("word", _folded(strip_ws(F.col(token)))).where((F.length("word") > 0) & (F.length("word") <= settings.max_token_length))
    near = asked.select("word").distinct().select("word", F.explode(delete_keys(F.col("word"), settings)).alias("key"))
    terms = vocabulary.where(F.col("frequency") >= settings.min_candidate_frequency)
    goal = terms.select("term", F.explode(delete_keys(F.col("term"), settings)).alias("key"))
    pairs = near.join(goal, "key").where(F.abs(F.length("word") - F.length("term")) <= settings.max_lookup_edit_distance).select("word", "term").distinct()
    pairs = pairs.withColumn("distance", osa_distance(F.col("word"), F.col("term"), settings.max_lookup_edit_distance)).where("distance is not null")
    found = pairs.join(terms, "term").join(asked, "word").where(F.col("distance") <= limit)
    place = F.row_number().over(Window.partitionBy(token).orderBy("distance", F.desc("frequency"), "term"))
    out = found.withColumn("place", place).where(F.col("place") <= settings.max_suggestions).select(token, "term", "distance", "frequency", "place")
    if not settings.include_unknown:
        return out
    rest = asked.join(out.select(token).distinct(), token, "left_anti")
    return out.unionByName(rest.select(token, F.col("word").alias("term"), (limit + 1).cast("int").alias("distance"), F.lit(0).cast("long").alias("frequency"), F.lit(1).alias("place")))
