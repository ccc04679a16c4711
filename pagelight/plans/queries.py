"""The operators as queries over a data directory, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelight.config import RAW_LABELS, CorrectionSettings, LayoutSettings, NeuralSettings, RecognitionSettings, TranslationSettings
from pagelight.operators import correction, layout, lexicon, neural, phrases, recognition, tokens, translation, vocabulary
from pagelight.session import pinned, spread, table

Query = Callable[[SparkSession, str], DataFrame]
SETTINGS = TranslationSettings()


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logged dictionary items as entries in the order of item_id; repeated rows once."""
    rows = table(spark, sf_dir, "dictionary_items").select("item_id", "source_text", "translations").dropDuplicates(["item_id"])
    return rows.where("item_id is not null").select(F.col("item_id").alias("ord"), "source_text", "translations", F.lit(False).alias("replace"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.word_lexicon(_items(spark, sf_dir), SETTINGS, source="source_text")


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.phrase_lexicon(_items(spark, sf_dir), SETTINGS, source="source_text")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ocr_results").select("result_id", "original_text").dropDuplicates(["result_id"])


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.frequency_table(table(spark, sf_dir, "frequency_terms"))


def tok_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every document with its offsets."""
    rows = tokens.tokenize(table(spark, sf_dir, "documents"), "doc_id", "text", SETTINGS, limited=False)
    return rows.select("doc_id", "idx", "text", "start_char", "end_char", "token_type")


def tok_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each normal form occurs in the documents."""
    rows = tokens.token_counts(table(spark, sf_dir, "documents"), "text", SETTINGS, limited=False)
    return rows.groupBy("normalized", "token_type").agg(F.sum("n").alias("n"))


def tok_drop_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens each rule for dropping them would take; in the JVM alone."""
    one = table(spark, sf_dir, "documents").select(F.explode(tokens.token_texts(F.col("text"))).alias("token"))
    number = tokens.token_type(F.col("token")) == "number"
    rule = F.when(F.char_length("token") > SETTINGS.max_token_characters, "too_long").when(number, "number").when(F.char_length("token") == 1, "single_character_word").otherwise("kept")
    return one.groupBy(rule.alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def ocr_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrector's tokens of the scanned pages."""
    return tokens.ascii_tokens(_pages(spark, sf_dir), "result_id", "original_text")


def dict_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word dictionary that the logged items add up to."""
    return _words(spark, sf_dir)


def dict_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrase dictionary that the logged items add up to."""
    return _phrases(spark, sf_dir).withColumn("normalized_tokens", F.array_join("normalized_tokens", " "))


def _document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.normalized_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", SETTINGS, limited=False)


def phrase_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place in the documents where a phrase of the dictionary stands."""
    found = phrases.phrase_candidates(_document_tokens(spark, sf_dir), pinned(_phrases(spark, sf_dir)), "doc_id", SETTINGS)
    return found.select("doc_id", "start_idx", "n")


def phrase_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest phrase at each place."""
    return phrases.match_at(phrase_candidates(spark, sf_dir), "doc_id", SETTINGS)


def phrase_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest phrase at each place."""
    return phrases.match_at(phrase_candidates(spark, sf_dir), "doc_id", TranslationSettings(longest_match_first=False))


def phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leftmost longest phrases that don't overlap."""
    found = phrases.find_in_texts(table(spark, sf_dir, "documents"), "doc_id", "text", pinned(_phrases(spark, sf_dir)), SETTINGS, limited=False)
    return found.select("doc_id", "start_idx", "end_idx", "start_char", "end_char")


def _document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, many = pinned(_words(spark, sf_dir)), pinned(_phrases(spark, sf_dir))
    return translation.translation_items(table(spark, sf_dir, "documents"), "doc_id", "text", words, many, SETTINGS, limited=False)


def dict_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' translation items: how many of each type, how many of them with a translation."""
    rows = _document_items(spark, sf_dir)
    return rows.groupBy("item_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.size("translations") > 0).cast("long")).alias("translated"))


def dict_unknown_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens without an entry, with their number."""
    rows = _document_items(spark, sf_dir).where("item_type = 'unknown'")
    return rows.select(F.col("normalized_tokens")[0].alias("normalized")).groupBy("normalized").agg(F.count(F.lit(1)).alias("n"))


def dict_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' literal translations."""
    words, many = pinned(_words(spark, sf_dir)), pinned(_phrases(spark, sf_dir))
    return translation.translate_texts(table(spark, sf_dir, "documents"), "doc_id", "text", words, many, SETTINGS, limited=False)


def correct_skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens of the scanned pages each rule skips."""
    rows = correction.correction_tokens(_pages(spark, sf_dir), "result_id", "original_text")
    reason = F.coalesce(correction.skip_reason(F.col("token"), F.col("opens")), F.lit("looked_up"))
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def vocab_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrector's vocabulary."""
    return _vocabulary(spark, sf_dir)


def vocab_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which distinct tokens of the scanned pages the vocabulary has."""
    rows = ocr_tokens(spark, sf_dir).select(F.col("text").alias("token"))
    return vocabulary.contains(rows, _vocabulary(spark, sf_dir))


def suggest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best terms for each token of the scanned pages that the vocabulary lacks."""
    words = _vocabulary(spark, sf_dir)
    rows = ocr_tokens(spark, sf_dir).select(F.col("text").alias("token"))
    absent = vocabulary.contains(rows, words).where("not present and length(token) between 2 and 64").select("token")
    return vocabulary.suggest(absent, words)


def correct_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each distinct token that no rule skips becomes, and why."""
    rows = correction.correction_tokens(_pages(spark, sf_dir), "result_id", "original_text")
    asked = rows.where(correction.skip_reason(F.col("token"), F.col("opens")).isNull())
    return correction.correct_tokens(asked, _vocabulary(spark, sf_dir))


def correct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of the scanned pages with its correction."""
    rows = correction.correct(_pages(spark, sf_dir), "result_id", "original_text", _vocabulary(spark, sf_dir))
    return rows.select("result_id", "token_no", "original", "corrected", "changed", "distance", "reason")


def correct_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned pages' corrected texts."""
    return correction.correct_texts(_pages(spark, sf_dir), "result_id", "original_text", _vocabulary(spark, sf_dir), CorrectionSettings())


def _raw_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made from order lines; the raw labels and one unknown come in turn."""
    names = F.array(*[F.lit(x) for x in (*RAW_LABELS, "Mystery Box")])
    rows = spread(table(spark, sf_dir, "lineitem"))
    x1, y1 = F.col("l_quantity") * 30 - 100, F.col("l_partkey") % 900 - 40.5
    return rows.select(
        F.col("l_orderkey").alias("page_id"),
        F.col("l_linenumber").alias("box_no"),
        F.element_at(names, (F.col("l_partkey") % 24 + 1).cast("int")).alias("raw"),
        F.col("l_suppkey").cast("string").alias("cls"),
        (F.col("l_discount") * 10).alias("score"),
        x1.alias("a1"),
        y1.alias("b1"),
        (x1 + (F.col("l_suppkey") % 40) * 7.25 - 60).alias("a2"),
        (y1 + F.col("l_tax") * 1500).alias("b2"),
        F.lit(1280).alias("image_width"),
        F.lit(720).alias("image_height"),
    )


def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes as regions."""
    rows = layout.normalize_boxes(_raw_boxes(spark, sf_dir), "raw", "cls", "score", ["a1", "b1", "a2", "b2"], "image_width", "image_height", LayoutSettings())
    return rows.select("page_id", "box_no", "x1", "y1", "x2", "y2", "label", "raw_label", "class_id", "confidence")


def layout_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and their area by label."""
    rows = layout.with_sizes(layout_regions(spark, sf_dir))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"), F.max("width").alias("widest"), F.max("height").alias("highest"))


def layout_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions of each page in reading order."""
    rows = layout.reading_order(layout_regions(spark, sf_dir), "page_id", "x2", "y2", "raw_label", "class_id", "box_no")
    return rows.select("page_id", "pos", "x1", "y1", "x2", "y2", "label", "confidence")


def layout_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored regions' raw labels brought to simple ones, repeated rows once."""
    rows = table(spark, sf_dir, "layout_regions").select("region_id", "raw_label", "x1", "y1", "x2", "y2").dropDuplicates(["region_id"])
    named = layout.with_sizes(rows.withColumn("label", layout.normalize_label(F.col("raw_label"))))
    return named.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))


def layout_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored regions as detector payloads, decoded and made regions again: regions by label."""
    rows = table(spark, sf_dir, "layout_regions").select("region_id", "raw_label", "class_id", "confidence", "x1", "y1", "x2", "y2").dropDuplicates(["region_id"])
    box = F.struct(F.col("raw_label").alias("label"), F.col("class_id").alias("cls_id"), F.col("confidence").alias("score"), F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias("coordinate"))
    # One payload for each region: a page's regions may be any number.
    sent = rows.select("region_id", F.to_json(F.struct(F.struct(F.array(box).alias("boxes")).alias("res"))).alias("payload"))
    boxes = layout.decode_boxes(sent, "region_id", "payload")
    boxes = boxes.select("region_id", "label", "cls_id", "score", *[F.get("coordinate", F.lit(i)).alias(f"c{i}") for i in range(4)])
    settings = LayoutSettings(clip_boxes_to_image=False)
    out = layout.normalize_boxes(boxes, "label", "cls_id", "score", ["c0", "c1", "c2", "c3"], "", "", settings)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def nmt_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the neural model would be given, and why not where it isn't."""
    rows = table(spark, sf_dir, "translation_results").select("translation_id", "source_text").dropDuplicates(["translation_id"])
    return neural.prepared(rows, "translation_id", "source_text", NeuralSettings())


def nmt_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored translations as they are cleaned."""
    rows = table(spark, sf_dir, "translation_results").select("translation_id", "translated_text").dropDuplicates(["translation_id"])
    return rows.select("translation_id", neural.clean_output(F.col("translated_text")).alias("translated_text"))


def input_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents break which rule of the dictionary translator."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(tokens.text_error(F.col("text"), SETTINGS.max_input_characters), F.lit("ok")).alias("error"))


def image_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many page images break which rule of the quality recognition."""
    rows = table(spark, sf_dir, "layout_pages").select("page_id", "image_width", "image_height").dropDuplicates(["page_id"])
    settings = RecognitionSettings.quality(min_image_width=1000, max_image_pixels=2_100_000)
    error = recognition.image_error(F.col("image_width"), F.col("image_height"), F.lit(3), F.lit(recognition.CV_8UC3), settings)
    return rows.groupBy(F.coalesce(error, F.lit("ok")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def ocr_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts as recognition payloads, flattened to lines again; scores are known of the first three lines."""
    lines = F.split("original_text", "\n")
    payload = F.to_json(F.struct(F.struct(lines.alias("rec_texts"), F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75)).alias("rec_scores")).alias("res")))
    rows = _pages(spark, sf_dir).where("original_text is not null").select("result_id", payload.alias("payload"))
    return recognition.flatten_lines(rows, "result_id", "payload").select("result_id", "line_no", "text", "score")


def screen_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned pages corrected, then translated literally."""
    fixed = correct_text(spark, sf_dir)
    words, many = pinned(_words(spark, sf_dir)), pinned(_phrases(spark, sf_dir))
    return translation.translate_texts(fixed, "result_id", "corrected_text", words, many, SETTINGS, limited=False)


def dict_item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every translation item of the documents, all columns."""
    rows = _document_items(spark, sf_dir)
    return rows.withColumns({"normalized_tokens": F.array_join("normalized_tokens", " "), "translations": F.array_join("translations", "|")})


def dict_words_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word dictionary if entries that are written with a capital replace what came before them."""
    entries = _items(spark, sf_dir).withColumn("replace", F.coalesce(F.col("source_text").rlike(r"^\s*[A-Z]"), F.lit(False)))
    return lexicon.word_lexicon(entries, SETTINGS, source="source_text")


def _logged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dictionary_items").select("item_id", "source_text").where("item_id is not null").dropDuplicates(["item_id"])


def word_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logged items' texts, each looked up as a single word."""
    rows = translation.translate_words(_logged_texts(spark, sf_dir), "item_id", "source_text", pinned(_words(spark, sf_dir)), SETTINGS)
    return rows.withColumn("translations", F.array_join("translations", "|"))


def phrase_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which logged texts are phrases of the dictionary."""
    asked = _logged_texts(spark, sf_dir).select(F.col("source_text").alias("phrase"))
    return lexicon.get_phrases(asked, pinned(_phrases(spark, sf_dir))).withColumn("translations", F.array_join("translations", "|"))


#: Forms of the test texts and what they are forms of.
FORMS = (("was", "be"), ("were", "be"), ("is", "be"), ("children", "child"), ("has", "have"), ("had", "have"), ("books", "book"), ("made", "make"), ("found", "find"), ("saw", "see"))


def tok_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each normal form occurs once some words are lemmatized."""
    lemmas = spark.createDataFrame(list(FORMS), "form string, lemma string")
    rows = tokens.tokenize(table(spark, sf_dir, "documents"), "doc_id", "text", SETTINGS, lemmas, limited=False)
    return rows.groupBy("normalized").agg(F.count(F.lit(1)).alias("n"))


def tok_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms by NFC with case kept and without numbers and single characters."""
    settings = TranslationSettings(unicode_normalization="NFC", case_sensitive=True, include_numbers=False, include_single_character_words=False)
    return tokens.token_counts(table(spark, sf_dir, "documents"), "text", settings, limited=False).groupBy("normalized").agg(F.sum("n").alias("n"))


#: Single tokens, each with whether a sentence may begin there.
TOKENS = (
    ("I", True), ("x" * 65, True), ("x" * 64, True), ("don't", False), ("don’t", False), ("well-known", True), ("http://a.b", True), ("HTTPS://A.B", False), ("www.a.b", False),
    ("me@a.b", True), ("me@a", True), ("USA", True), ("eBay", True), ("McX", False), ("Title", True), ("Title", False), ("plain", False), ("AB", False),
)


def skip_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that skips each of some tokens, given one by one."""
    rows = spark.createDataFrame(list(TOKENS), "token string, opens boolean")
    return rows.select("token", "opens", correction.skip_reason(F.col("token"), F.col("opens")).alias("reason"))


#: Single tokens for the rules on them.
RULED = ("", "word", "two words", "tab\there", "x" * 129, "x" * 128, "no-break\u00a0space", None)


def token_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each of some tokens breaks."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(RULED)], "place int, token string")
    return rows.select("place", tokens.token_error(F.col("token")).alias("error"))


def layout_image_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many page images break which rule of the layout detection, which tests the width first."""
    rows = table(spark, sf_dir, "layout_pages").select("page_id", "image_width", "image_height").dropDuplicates(["page_id"])
    settings = LayoutSettings(min_image_width=1300, min_image_height=1000, max_image_pixels=2_500_000)
    error = recognition.image_error(F.col("image_width"), F.col("image_height"), F.lit(3), F.lit(recognition.CV_8UC3), settings)
    return rows.groupBy(F.coalesce(error, F.lit("ok")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    every = (
        tok_tokens, tok_normalized, tok_drop_rules, ocr_tokens, dict_words, dict_phrases, phrase_candidates, phrase_longest, phrase_shortest, phrase_matches,
        dict_items, dict_unknown_items, dict_translate, correct_skip_reason, vocab_frequency, vocab_contains, suggest_topk, correct_select, correct_tokens, correct_text,
        layout_regions, layout_label_counts, layout_reading_order, layout_stored, layout_decode, nmt_prepare, nmt_clean, input_validation, image_validation, ocr_flatten, screen_pipeline,
        dict_item_rows, dict_words_replaced, word_lookup, phrase_lookup, tok_lemmas, tok_nfc, skip_rules, token_rules, layout_image_rules,
    )
    return {f.__name__: f for f in every}
