"""Correction of misrecognised words: skip rules, exact and fuzzy lookup, selection, and the rebuilt text.

What a token becomes depends on the token alone, but for the rule on names at
the begin of a sentence; so lookups run once for each distinct token, and the
text is rebuilt from the tokens that changed.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelight.config import CorrectionSettings
from pagelight.functions.chars import ASCII_TOKEN
from pagelight.operators.joins import bounded_rows, lookup_join
from pagelight.operators.vocabulary import suggest
from pagelight.session import pinned, spread

SHORT = 4
#: A short token is corrected only if the best term is this many times as frequent as the next.
CLEAR = 2

_TOKEN = re.compile(ASCII_TOKEN)
_TITLE = re.compile("[A-Z][a-z]*$")


def correction_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, token, start_char, end_char, opens): the ASCII tokens; opens: a sentence may begin here.

    A sentence begins at the text's begin and behind . ! or ? and white space;
    a line's end alone begins none. Null texts and texts with NUL have none.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                at, idx, token, start, end, opens = [], [], [], [], [], []
                for i, value in enumerate(some.column(1).to_pylist()):
                    for n, (m, first) in enumerate(_openings(value)):
                        at.append(i)
                        idx.append(n)
                        token.append(m[0])
                        start.append(m.start())
                        end.append(m.end())
                        opens.append(first)
                columns = [pa.array(idx, pa.int32()), pa.array(token, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(opens, pa.bool_())]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at, pa.int64())), *columns], [key, "idx", "token", "start_char", "end_char", "opens"])

    good = F.col(text).isNotNull() & (F.instr(text, "\0") == 0)
    return spread(df.select(key, text).where(good)).mapInArrow(run, f"`{key}` {kind}, idx int, token string, start_char int, end_char int, opens boolean")


def skip_reason(token: Column, opens: Column, settings: CorrectionSettings = CorrectionSettings()) -> Column:
    """Why a token is not looked up, by the first rule that holds; null for a token to look up."""
    upper, lower = token.rlike("[A-Z]"), token.rlike("[a-z]")
    title = token.rlike("^[A-Z][a-z]*$")
    return (
        F.when(F.length(token) < settings.min_token_length, "token_too_short")
        .when(F.length(token) > settings.max_token_length, "token_too_long")
        .when(token.rlike("['’]"), "token_contains_apostrophe")
        .when(F.contains(token, F.lit("-")), "token_contains_hyphen")
        .when(token.rlike(r"(?i)^(https?://|www\.)"), "token_is_url")
        .when(token.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "token_is_email")
        .when(upper & ~lower & (F.length(token) >= 2), "token_is_acronym")
        .when(upper & lower & ~title, "token_has_mixed_case")
        .when(title & ~opens, "token_may_be_proper_name")
    )


def correct_tokens(words: DataFrame, vocabulary: DataFrame, settings: CorrectionSettings = CorrectionSettings(), token: str = "token") -> DataFrame:
    """(token, corrected, changed, distance, frequency, reason) of each distinct token that no rule skips.

    Of the suggestions (at most max_suggestions) those at the least distance
    count. A token of more than four letters gets the most frequent of them; a
    shorter one only if it is the only one or clearly the most frequent.
    """
    asked = words.select(token).distinct().withColumn("term", F.lower(F.col(token)))
    known = asked.join(vocabulary.select("term", F.lit(True).alias("present")), "term", "left")
    absent = known.where("present is null").select(token)
    short = F.length(F.col(token)) <= SHORT
    reach = F.when(short, min(1, settings.max_lookup_edit_distance)).otherwise(settings.max_lookup_edit_distance)
    found = suggest(absent, vocabulary, settings, token, reach)
    per = Window.partitionBy(token)
    near = found.withColumn("least", F.min("distance").over(per)).where("distance = least")
    order = per.orderBy(F.desc("frequency"), "term")
    ranked = near.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("frequency").over(order)).where("rank = 1")
    clear = ~short | F.col("next").isNull() | (F.col("frequency") >= CLEAR * F.col("next"))
    cased = F.when(F.col(token).rlike("^[A-Z]") & F.lit(settings.transfer_casing), F.initcap("term")).otherwise(F.col("term"))
    chosen = ranked.select(token, F.when(clear, cased).alias("chosen"), F.when(clear, F.col("distance")).alias("distance"), F.when(clear, F.col("frequency")).alias("frequency"))
    joined = known.join(chosen, token, "left").join(near.select(token, F.lit(True).alias("any")).distinct(), token, "left")
    same = F.lower("chosen") == F.col("term")
    reason = (
        F.when(F.col("present").isNotNull(), "token_exists_in_dictionary")
        .when(F.col("any").isNull(), "no_candidate_found")
        .when(F.col("chosen").isNull(), "candidate_is_ambiguous")
        .when(same, "candidate_matches_original")
        .otherwise("non_word_corrected")
    )
    rows = joined.withColumn("reason", reason).withColumn("changed", F.col("reason") == "non_word_corrected")
    return rows.select(
        token,
        F.when(F.col("changed"), F.col("chosen")).otherwise(F.col(token)).alias("corrected"),
        "changed",
        F.when(F.col("changed"), F.col("distance")).alias("distance"),
        F.when(F.col("changed"), F.col("frequency")).alias("frequency"),
        "reason",
    )


def correct(df: DataFrame, key: str, text: str, vocabulary: DataFrame, settings: CorrectionSettings = CorrectionSettings()) -> DataFrame:
    """(key, token_no, original, corrected, start_char, end_char, changed, distance, frequency, reason): each token's correction."""
    tokens = correction_tokens(df, key, text).withColumn("skipped", skip_reason(F.col("token"), F.col("opens"), settings))
    # Measured before it is joined: written once, not computed twice.
    fixed = pinned(correct_tokens(tokens.where("skipped is null"), vocabulary, settings))
    rows = lookup_join(tokens, fixed.withColumnRenamed("reason", "found"), ["token"])
    changed = F.col("skipped").isNull() & F.coalesce("changed", F.lit(False))
    return rows.select(
        key,
        F.col("idx").alias("token_no"),
        F.col("token").alias("original"),
        F.when(changed, F.col("corrected")).otherwise(F.col("token")).alias("corrected"),
        "start_char",
        "end_char",
        changed.alias("changed"),
        F.when(changed, F.col("distance")).alias("distance"),
        F.when(changed, F.col("frequency")).alias("frequency"),
        F.coalesce("skipped", "found").alias("reason"),
    )


def apply_corrections(df: DataFrame, key: str, text: str, corrections: DataFrame) -> DataFrame:
    """(key, corrected_text): the texts with the changed tokens put in; the key must be unique in df.

    Only changed tokens are gathered, in one array for each text.
    """
    changed = corrections.where("changed").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "corrected"))).alias("changes"))
    rows = df.select(key, F.col(text).alias("_text")).join(changed, key, "left")
    parts = F.transform(
        F.sequence(F.lit(0), F.size("changes") - 1),
        lambda i: F.concat(
            _gap(i),
            F.element_at("changes", i + 1)["corrected"],
        ),
    )
    tail = F.substring(F.col("_text"), F.element_at("changes", -1)["end_char"] + 1, F.length("_text"))
    return rows.select(key, F.when(F.col("changes").isNull(), F.col("_text")).otherwise(F.concat(F.array_join(parts, ""), tail)).alias("corrected_text"))


def _gap(i: Column) -> Column:
    """The text between the change before and change i."""
    begin = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at("changes", i)["end_char"])
    return F.substring(F.col("_text"), begin + 1, F.element_at("changes", i + 1)["start_char"] - begin)


def _openings(value: str):
    """(match, opens) of a text's tokens."""
    last = 0
    for m in _TOKEN.finditer(value):
        before = value[last : m.start()].rstrip()
        # Blank up to the token before (a letter), or up to the text's begin.
        yield m, before[-1] in ".!?" if before else last == 0
        last = m.end()


def _distinct_tokens(df: DataFrame, text: str) -> DataFrame:
    """(token, opens) of the texts, once for each batch of texts."""
    good = F.col(text).isNotNull() & (F.instr(text, "\0") == 0)

    def run(batches):
        for batch in batches:
            found = {(m[0], opens) for value in batch.column(0).to_pylist() for m, opens in _openings(value)}
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.bool_())], ["token", "opens"])

    return spread(df.select(text).where(good)).mapInArrow(run, "token string, opens boolean")


def correct_texts(df: DataFrame, key: str, text: str, vocabulary: DataFrame, settings: CorrectionSettings = CorrectionSettings()) -> DataFrame:
    """(key, corrected_text): null texts and texts with NUL stay as they are.

    The distinct tokens are corrected first. If few of them change (see
    joins.BROADCAST_ROWS) those are sent to the tasks and the texts rewritten
    in place, without any exchange of texts; else the changes are joined and
    gathered by key, which must be unique then.
    """
    tokens = _distinct_tokens(df, text).distinct()
    asked = tokens.where(skip_reason(F.col("token"), F.col("opens"), settings).isNull())
    changed = bounded_rows(correct_tokens(asked, vocabulary, settings).where("changed").select("token", "corrected"))
    if changed is None:
        return apply_corrections(df, key, text, correct(df, key, text, vocabulary, settings))
    table = df.sparkSession.sparkContext.broadcast({r["token"]: r["corrected"] for r in changed})
    kind = df.schema[key].dataType.simpleString()

    def rewrite(value: str | None) -> str | None:
        if value is None or "\0" in value:
            return value
        out, last = [], 0
        for m, opens in _openings(value):
            # All rules for skipping but that on names look at the token alone, so a skipped one isn't in the table.
            new = table.value.get(m[0])
            if new is not None and (opens or not _TITLE.match(m[0])):
                out += [value[last : m.start()], new]
                last = m.end()
        return "".join([*out, value[last:]]) if out else value

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(rewrite, batch.column(1).to_pylist()), pa.string())], [key, "corrected_text"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, corrected_text string")
