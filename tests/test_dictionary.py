import pytest

from pagelight.config import TranslationSettings
from pagelight.operators import joins, lexicon, phrases, tokens, translation

WORDS = [
    ("sailor", "thủy thủ"),
    ("mend", "vá"),
    ("net", "lưới"),
    ("storm", "cơn bão"),
    ("before", "trước"),
    ("old", "già"),
    ("bring", "mang"),
    ("in", "trong"),
    ("goose", "con ngỗng"),
    ("our", "của chúng tôi"),
    ("set", "đặt"),
    ("sail", "cánh buồm"),
    ("fish", "cá"),
]
PHRASES = [("set sail", "ra khơi"), ("bring in", "kéo vào"), ("fishing net", "lưới đánh cá")]
LEMMAS = [("sailors", "sailor"), ("mended", "mend"), ("nets", "net"), ("brought", "bring"), ("geese", "goose"), ("storms", "storm"), ("sets", "set")]
SENTENCES = {
    "Old sailors mended 3 fishing nets before our storms.": "già thủy thủ vá 3 lưới đánh cá trước của chúng tôi cơn bão",
    "Sets sail, brought in geese; brought nets in Qarth.": "ra khơi kéo vào con ngỗng mang lưới trong Qarth",
    "The harbour fish": "The harbour cá",
}


@pytest.fixture(scope="module")
def tables(spark):
    lemmas = spark.createDataFrame(LEMMAS, "form string, lemma string")
    words = spark.createDataFrame([(i, a, [b], False) for i, (a, b) in enumerate(WORDS)], "ord long, word string, translations array<string>, replace boolean")
    many = spark.createDataFrame([(i, a, [b], False) for i, (a, b) in enumerate(PHRASES)], "ord long, phrase string, translations array<string>, replace boolean")
    return lexicon.word_lexicon(words, lemmas=lemmas).cache(), lexicon.phrase_lexicon(many, lemmas=lemmas).cache(), lemmas


@pytest.mark.parametrize("joined", [False, True])
def test_sentences(spark, tables, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(translation, "bounded_rows", lambda *a: None)
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    words, many, lemmas = tables
    df = spark.createDataFrame(list(enumerate(SENTENCES)), "id long, text string")
    items = translation.translation_items(df, "id", "text", words, many, lemmas=lemmas).cache()
    out = {r.id: r.literal_translation for r in translation.literal_translation(items, "id").collect()}
    assert [out[i] for i in range(3)] == list(SENTENCES.values())
    spans = [(r.item_type[0], r.start_token_index, r.end_token_index, r.start_char, r.end_char) for r in items.where("id = 1").orderBy("start_token_index").collect()]
    assert spans == [("p", 0, 2, 0, 9), ("p", 2, 4, 11, 21), ("w", 4, 5, 22, 27), ("w", 5, 6, 29, 36), ("w", 6, 7, 37, 41), ("w", 7, 8, 42, 44), ("u", 8, 9, 45, 50)]
    first = items.where("id = 0 and item_type = 'phrase'").first()
    assert (first.source_text, first.normalized_tokens, first.translations) == ("fishing nets", ["fishing", "net"], ["lưới đánh cá"])
    items.unpersist()


def test_upsert(spark):
    rows = [(1, "Sail", ["buồm"], False), (2, "sail", [" chèo ", "buồm", "", None], False), (5, "two words", ["x"], False), (6, "42", ["x"], False), (7, "none", [" "], False), (8, None, ["x"], None)]
    schema = "ord long, word string, translations array<string>, replace boolean"
    first = lexicon.word_lexicon(spark.createDataFrame(rows, schema)).collect()
    assert [(r.normalized, r.word, r.translations) for r in first] == [("sail", "Sail", ["buồm", "chèo"])]
    more = rows + [(3, "SAIL", ["lướt"], True), (4, "sail", ["buồm"], False)]
    after = lexicon.word_lexicon(spark.createDataFrame(more, schema)).collect()
    assert [(r.word, r.translations) for r in after] == [("SAIL", ["lướt", "buồm"])]
    keyed = lexicon.word_errors(lexicon.keyed_entries(spark.createDataFrame(rows, schema), "word"), "word")
    assert {r.ord: r.error for r in keyed.collect()} == {1: None, 2: None, 5: "not_one_word", 6: "not_one_word", 7: "no_translation", 8: "empty_word"}


def test_longest_and_shortest(spark):
    df = spark.createDataFrame([(1, "we sat by Cold Iron Bridge"), (2, "bring. In"), (3, ""), (4, None)], "id long, text string")
    many = spark.createDataFrame([(["cold", "iron"], ["a"]), (["cold", "iron", "bridge"], ["b"]), (["bring", "in"], ["c"])], "normalized_tokens array<string>, translations array<string>")
    token_rows = tokens.normalized_tokens(df, "id", "text")
    long = phrases.find_phrases(token_rows, many, "id").collect()
    assert sorted((r.id, r.start_idx, r.end_idx) for r in long) == [(1, 3, 6), (2, 0, 2)]
    short = phrases.find_phrases(token_rows, many, "id", TranslationSettings(longest_match_first=False)).collect()
    assert sorted((r.id, r.start_idx, r.end_idx) for r in short) == [(1, 3, 5), (2, 0, 2)]
    assert phrases.find_phrases(token_rows, many.limit(0), "id").count() == 0
    table = phrases.PhraseTable(many.collect(), TranslationSettings())
    assert [s[:2] for s in table.spans(["a", "cold", "iron", "bridge", "cold", "iron"])] == [(1, 4), (4, 6)]


def test_single_words(spark, tables):
    words = tables[0]
    df = spark.createDataFrame([(1, "storm"), (2, "12"), (3, "two words"), (4, " storm"), (5, "zzz"), (6, None)], "id long, text string")
    out = {r.id: (r.item_type, r.error) for r in translation.translate_words(df, "id", "text", words).collect()}
    assert out == {1: ("word", None), 2: ("number", None), 3: (None, "not_one_token"), 4: (None, "not_one_token"), 5: ("unknown", None), 6: (None, "not_one_token")}
    found = lexicon.contains_words(spark.createDataFrame([("Storm",), ("zzz",), (None,)], "word string"), words).collect()
    assert {r.word: r.present for r in found} == {"Storm": True, "zzz": False}


def test_lookup_join_with_hot_key(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else str(i)) for i in range(300)], "id long, k string")
    table = spark.createDataFrame([("hot", 1), ("3", 2)], "k string, v int")
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    out = joins.lookup_join(rows, table, ["k"])
    assert out.count() == 300 and out.where("v is not null").count() == 201


@pytest.mark.parametrize("few", [0, 1000])
def test_once_each(spark, monkeypatch, tmp_path, few):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", few)
    rows = [(i % 40 or None, f"text {i % 40}") for i in range(100)]
    spark.createDataFrame(rows, "id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    out = joins.once_each(spark.read.parquet(str(tmp_path / "t")).select("id", "text"), "id").collect()
    assert sorted(r.id for r in out if r.id is not None) == list(range(1, 40)) and sum(r.id is None for r in out) == 3
    assert all(r.text == f"text {r.id or 0}" for r in out)
