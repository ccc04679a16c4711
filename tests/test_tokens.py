import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pagelight.config import TranslationSettings
from pagelight.operators import tokens

CASES = {
    "don’t state-of-the-art": ["don’t", "state-of-the-art"],
    "R2D2 a_b": ["R", "2", "D", "2", "a", "b"],
    "10:30 2026-08-01 1,000.5!": ["10:30", "2026-08-01", "1,000.5"],
    "foo—bar": ["foo—bar"],
    "é": ["e"],
    "😀 word": ["word"],
    "": [],
    "!!! ...": [],
}


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert [t[0] for t in tokens.tokens_of(text)] == CASES[text]


def test_normal_forms():
    assert tokens.normalize_token("don’t") == "don't"
    assert tokens.normalize_token("foo—bar") == "foo-bar"
    assert tokens.normalize_token("x‑y") == "x-y"
    assert tokens.normalize_token("x‑y", TranslationSettings(unicode_normalization="NFC")) == "x‑y"
    assert tokens.normalize_token("Straße") == "strasse"
    assert tokens.normalize_token("x½") == "x1⁄2"


def test_offsets_are_code_points_and_indexes_dense():
    found = tokens.tokens_of("😀 word " + "a" * 129 + " end")
    assert [(t[0], t[2], t[3]) for t in found] == [("word", 2, 6), ("end", 137, 140)]


def test_settings_drop():
    settings = TranslationSettings(include_numbers=False, include_single_character_words=False)
    assert [t[0] for t in tokens.tokens_of("a 12 word", settings)] == ["word"]


def test_dataframe(spark):
    rows = [(1, "Two words", 0), (2, None, 0), (3, "", 0), (4, "nul\0", 0), (5, "x " * 6000, 0), (1, "Two words", 0)]
    df = spark.createDataFrame(rows, "id long, text string, idx int")
    out = tokens.tokenize(df, "id", "text").collect()
    assert sorted((r.id, r.idx, r.text, r.start_char) for r in out) == [(1, 0, "Two", 0), (1, 0, "Two", 0), (1, 1, "words", 4), (1, 1, "words", 4)]
    errors = {r.id: r.error for r in df.select("id", tokens.text_error(F.col("text"), 10_000).alias("error")).collect()}
    assert errors == {1: None, 2: "null_text", 3: None, 4: "nul_character", 5: "too_long"}
    assert tokens.tokenize(df.limit(0), "id", "text").count() == 0
    assert tokens.tokenize(df, "id", "text", limited=False).where("id = 5").count() == 6000


def test_jvm_tokens_equal_python(spark):
    rng = random.Random(3)
    letters = "abÀéßж中ไ12½'’-–._ \n,é"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    mine = {r.id: r.t for r in df.select("id", tokens.token_texts(F.col("text")).alias("t")).collect()}
    for i, text in enumerate(texts):
        found = tokens.tokens_of(text)
        assert mine[i] == [t[0] for t in found]
        assert all(text[a:b] == t for t, _, a, b, _ in found)


def test_lemmas(spark):
    df = spark.createDataFrame([(1, "Days 10")], "id long, text string")
    lemmas = spark.createDataFrame([("days", "day"), ("10", "ten"), (None, "x")], "form string, lemma string")
    assert [r.normalized for r in tokens.tokenize(df, "id", "text", lemmas=lemmas).orderBy("idx").collect()] == ["day", "10"]


def test_ascii_tokens(spark):
    df = spark.createDataFrame([(1, "café don't R2")], "id long, text string")
    assert [(r.text, r.start_char) for r in tokens.ascii_tokens(df, "id", "text").orderBy("idx").collect()] == [("caf", 0), ("don't", 5), ("R", 11)]


def test_python_class_is_what_the_pattern_lists():
    word = re.compile(r"[^\W\d_]")
    assert all(bool(word.match(chr(c))) == (unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "No")) for c in range(0x3000))
