import random

import pytest
from pyspark.sql import functions as F

from pagelight.config import CorrectionSettings
from pagelight.functions.distance import osa, osa_distance
from pagelight.operators import correction, vocabulary

TEXTS = [
    "A grccn lantcrn hung ovcr the harbcur.",
    "They wcre late; McGrath's old-fashioned CLOCK stopped.",
    "Near Dover, eBay sellers met.",
    "fine\nTitle here",
]
FREQUENCIES = {"green": 100, "lantern": 60, "hung": 50, "over": 500, "oven": 90, "the": 900, "they": 200, "harbour": 40, "were": 300, "where": 100, "late": 80, "stopped": 30, "near": 70, "met": 50, "fine": 20, "here": 90}


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame(list(FREQUENCIES.items()), "term string, frequency long")


def corrected(spark, words, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return df, {(r.id, r.original): r for r in correction.correct(df, "id", "text", words).collect()}


def test_reasons(spark, words):
    _, out = corrected(spark, words, TEXTS)
    assert out[0, "A"].reason == "token_too_short"
    assert out[0, "lantcrn"].corrected == "lantern" and out[0, "lantcrn"].distance == 1
    assert out[0, "grccn"].corrected == "green" and out[0, "grccn"].distance == 2
    assert out[0, "harbcur"].corrected == "harbour"
    assert out[0, "the"].reason == "token_exists_in_dictionary"
    assert out[1, "wcre"].corrected == "were"
    assert out[1, "McGrath's"].reason == "token_contains_apostrophe"
    assert out[1, "old-fashioned"].reason == "token_contains_hyphen"
    assert out[1, "CLOCK"].reason == "token_is_acronym"
    assert out[2, "Near"].reason == "token_exists_in_dictionary"
    assert out[2, "Dover"].reason == "token_may_be_proper_name"
    assert out[2, "eBay"].reason == "token_has_mixed_case"
    assert out[2, "sellers"].reason == "no_candidate_found"
    assert out[3, "Title"].reason == "token_may_be_proper_name"


def test_texts_are_rebuilt(spark, words):
    texts = [*TEXTS, "", None, "no change", "hte hte", "Lantcrn. LANTCRN"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = {r.id: r.corrected_text for r in correction.correct_texts(df, "id", "text", words).collect()}
    assert out[0] == "A green lantern hung over the harbour."
    assert out[1] == "They were late; McGrath's old-fashioned CLOCK stopped."
    assert out[2] == TEXTS[2] and out[3] == TEXTS[3]
    assert out[4] == "" and out[5] is None and out[6] == "no change"
    assert out[7] == "the the"
    assert out[8] == "Lantern. LANTCRN"


def test_short_tokens_need_a_clear_winner(spark):
    def outcome(frequencies, token):
        table = spark.createDataFrame(list(frequencies.items()), "term string, frequency long")
        row = correction.correct_tokens(spark.createDataFrame([(token,)], "token string"), table).first()
        return row.corrected, row.reason

    assert outcome({"boat": 100, "beat": 60}, "bxat") == ("bxat", "candidate_is_ambiguous")
    assert outcome({"boat": 100, "beat": 50}, "bxat") == ("boat", "non_word_corrected")
    assert outcome({"boat": 100}, "bxat") == ("boat", "non_word_corrected")
    assert outcome({"ladlet": 5, "ladles": 9}, "ladlex") == ("ladles", "non_word_corrected")
    assert outcome({"ladles": 9, "ladlet": 9}, "ladlex") == ("ladles", "non_word_corrected")
    assert outcome({"boat": 1}, "zzzzz") == ("zzzzz", "no_candidate_found")


def test_suggestions_equal_brute_force(spark):
    rng = random.Random(5)
    terms = {"".join(rng.choice("abcd") for _ in range(rng.randint(2, 9))): rng.randint(1, 50) for _ in range(150)}
    asked = ["".join(rng.choice("abcd") for _ in range(rng.randint(2, 9))) for _ in range(60)] + ["", None, "x" * 70]
    table = spark.createDataFrame(list(terms.items()), "term string, frequency long")
    out = {}
    for r in vocabulary.suggest(spark.createDataFrame([(a,) for a in asked], "token string"), table).collect():
        out.setdefault(r.token, []).append((r.place, r.distance, -r.frequency, r.term))
    for token in {a for a in asked if a and len(a) <= 64}:
        due = sorted((osa(token, t), -n, t) for t, n in terms.items() if osa(token, t) <= 2)[:5]
        assert [x[1:] for x in sorted(out.get(token, []))] == due


def test_distance(spark):
    pairs = [("hte", "the", 1), ("ca", "abc", None), ("", "ab", 2), ("abc", "abc", 0), ("abcd", "badc", 2), ("abc", "xyz", None)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    assert [r.d for r in rows.select(osa_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [d for _, _, d in pairs]


def test_frequency_table(spark):
    rows = [("The ", 5), ("the", 7), (None, 1), (" ", 2), ("x", None), ("two words", 3)]
    table = vocabulary.frequency_table(spark.createDataFrame(rows, "term string, frequency long"))
    assert [(r.term, r.frequency) for r in table.collect()] == [("the", 12)]
    more = vocabulary.add_words(table, spark.createDataFrame([("THE", 0), ("new", 4)], "term string, frequency long"))
    assert {r.term: r.frequency for r in more.collect()} == {"the": 13, "new": 4}


def test_settings_are_checked():
    with pytest.raises(ValueError):
        CorrectionSettings(max_lookup_edit_distance=3)
    with pytest.raises(ValueError):
        CorrectionSettings(term_index=1)
