"""The pN_ queries over a data directory, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelight.functions.chars import fold_text, strip_ws
from pagelight.llm import encoding, frequency, leakage, pairs, percentiles, scans, sentences, splitting, subjects
from pagelight.operators.joins import once_each
from pagelight.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct term of the three columns with its counts and mark."""
    items, corrections = table(spark, sf_dir, "dictionary_items"), table(spark, sf_dir, "token_corrections")
    return frequency.term_frequencies(
        [
            frequency.TermField(items, "normalized_tokens", "text_id", "normalized_tokens", is_array=True, key=("item_id",)),
            frequency.TermField(items, "item_type", "text_id", "item_type", key=("item_id",)),
            frequency.TermField(corrections, "corrected", "result_id", "corrected", key=("token_no",)),
        ]
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_terms(spark, sf_dir).where("mark is not null").select("field_name", "term", "mark")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [table(spark, sf_dir, x) for x in ("ocr_results", "layout_pages", "layout_regions", "frequency_terms")]
    return scans.places(*tables)


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The books' continuous text."""
    tables = [table(spark, sf_dir, x) for x in ("ocr_results", "layout_pages", "layout_regions", "frequency_terms")]
    return scans.paragraphs(*tables)


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered pieces of every source_text."""
    rows = once_each(table(spark, sf_dir, "translation_results").select("translation_id", "source_text"), "translation_id")
    return splitting.split_texts(rows, "translation_id", "source_text")


def p3_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every source_text whether its pieces hold it whole, none beyond the limit, each but the first with an overlap of at most 200 characters."""
    order = Window.partitionBy("translation_id").orderBy("piece_no")
    pieces = p3_pieces(spark, sf_dir).withColumn("shared", F.lag("end_char").over(order) - F.col("start_char"))
    texts = once_each(table(spark, sf_dir, "translation_results").select("translation_id", "source_text"), "translation_id")
    found = pieces.groupBy("translation_id").agg(
        F.max("end_char").cast("long").alias("n_chars"),
        (F.min("start_char") == 0).alias("from_begin"),
        (F.max(F.col("end_char") - F.col("start_char")) <= splitting.LIMIT).alias("within_limit"),
        F.coalesce(F.min("shared") >= 0, F.lit(True)).alias("no_gap"),
        F.coalesce(F.max("shared") <= 200, F.lit(True)).alias("overlap_bound"),
        F.sum(F.length("piece") - F.coalesce(F.greatest("shared", F.lit(0)), F.lit(0))).cast("long").alias("chars_once"),
    )
    return texts.where("source_text is not null").select("translation_id").join(found, "translation_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records whose text had to be cut."""
    rows = table(spark, sf_dir, "translation_results")
    return splitting.split_texts(rows, "translation_id", "source_text").where("n_pieces > 1").select("translation_id").distinct()


def _day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, day, bucket, n) over the regions, repeated rows once.

    The bucket is computed before the exchange that drops repeated rows, and
    labels are brought to one spelling after the counting, so that only the
    distinct spellings pass through it.
    """
    regions = table(spark, sf_dir, "layout_regions").where("confidence >= 0 and confidence <= 1 and not isnan(confidence)")
    regions = regions.select("region_id", "label", F.date_format("seen_at", "yyyy-MM-dd").alias("day"), percentiles.bucket(F.col("confidence")).alias("bucket"))
    counts = regions.dropDuplicates(["region_id"]).groupBy("label", "day", "bucket").agg(F.count(F.lit(1)).alias("n"))
    label = F.regexp_replace(strip_ws(fold_text(F.col("label"))), r"[\s\-]+", "_")
    return percentiles.merge_counts(counts.withColumn("label", label), ["label", "day"])


def _rounded(rows: DataFrame) -> DataFrame:
    """The last digits of a power differ between engines."""
    return rows.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes])


def p4_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days' results themselves: bucket counts per label and day, which add up over any set of days."""
    return _day_counts(spark, sf_dir)


def p4_day_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of confidence per label and day of seen_at."""
    return _rounded(percentiles.percentiles(_day_counts(spark, sf_dir), ["label", "day"]))


def p4_label_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per label over all days, from the days' counts."""
    return _rounded(percentiles.percentiles(percentiles.merge_counts(_day_counts(spark, sf_dir), ["label"]), ["label"]))


def p5_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every source_text in order."""
    rows = once_each(table(spark, sf_dir, "translation_results").select("translation_id", "source_text"), "translation_id")
    return sentences.split_sentences(rows, "translation_id", "source_text")


def p5_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every processed_text in order."""
    rows = once_each(table(spark, sf_dir, "translation_results").select("translation_id", "processed_text"), "translation_id")
    return sentences.split_sentences(rows, "translation_id", "processed_text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "translation_results")
    return sentences.split_sentences(rows, "translation_id", "source_text", with_text=False).select("translation_id", "end_char").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "translation_results")
    return pairs.find_defects(rows, "translation_id", "source_text", "translated_text").distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.select("doc_id", "eval_id").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = subjects.mine_rules(documents, table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"))
    return subjects.find_subjects(documents, rules).distinct()


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each subject: the corpus composition."""
    return p9_found(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_terms, p1_found, p2_found, p2_paragraphs, p3_pieces, p3_found, p3_cover, p4_day_counts, p4_day_percentiles, p4_label_percentiles, p5_sentences, p5_processed, p5_found, p6_found, p7_ids, p8_found, p9_found, p9_composition)}


_REGION_SQL = """
            SELECT DISTINCT region_id, CASE WHEN label IS NULL THEN NULL ELSE
                regexp_replace(lower(regexp_replace(label, '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g')), '[ -]+', '_', 'g') END AS label,
                strftime(seen_at, '%Y-%m-%d') AS day, confidence
            FROM layout_regions WHERE confidence >= 0 AND confidence <= 1 AND NOT isnan(confidence)"""


def _day_count_sql() -> str:
    e = percentiles.RELATIVE_ERROR
    place = f"CASE WHEN confidence < 1e-12 THEN 0 ELSE CAST(ceil(ln(confidence) / ln({(1 + e) / (1 - e)!r})) AS INTEGER) + {percentiles.SHIFT} END"
    return f"SELECT label, day, {place} AS bucket, count(*) AS n FROM ({_REGION_SQL}) GROUP BY ALL"


def _percentile_sql(groups: str) -> str:
    e = percentiles.RELATIVE_ERROR
    growth = (1 + e) / (1 - e)
    found = ", ".join(f"round(coalesce(min(CASE WHEN upto * 10000 >= alln * {q * 100} THEN place END), 0), 9) AS {percentiles._name(q)}" for q in percentiles.PERCENTILES)
    return f"""
        WITH regions AS ({_REGION_SQL}),
        placed AS (
            SELECT {groups}, CASE WHEN confidence < 1e-12 THEN 0.0 ELSE
                pow({growth!r}, ceil(ln(confidence) / ln({growth!r}))) * {2 / (growth + 1)!r} END AS place, count(*) AS n
            FROM regions GROUP BY ALL),
        ranked AS (
            SELECT {groups}, place, sum(n) OVER (PARTITION BY {groups} ORDER BY place) AS upto, sum(n) OVER (PARTITION BY {groups}) AS alln FROM placed)
        SELECT {groups}, CAST(max(alln) AS BIGINT) AS n, {found}, CAST({e} AS DOUBLE) AS rel_error FROM ranked GROUP BY {groups}"""


def _term_sql() -> str:
    """Lower case and the listed forms stand for compatibility forms and case folding, of which the tables hold no others."""
    wide = "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26)) + "".join(chr(0xFF10 + i) for i in range(10)) + "\u3000\u00a0"
    plain = "abcdefghijklmnopqrstuvwxyz" * 2 + "0123456789" + "  "
    term = f"translate(lower(raw), '{wide}', '{plain}')"
    for read, meant in (("ß", "ss"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("½", "1⁄2"), ("…", "...")):
        term = f"replace({term}, '{read}', '{meant}')"
    blank = r"[\s\x{1C}-\x{1F}\x{85}\x{0B}]"
    return f"""
        WITH items AS (SELECT DISTINCT item_id, text_id, normalized_tokens, item_type FROM dictionary_items),
        corrections AS (SELECT DISTINCT result_id, token_no, corrected FROM token_corrections),
        found AS (
            SELECT 'normalized_tokens' AS field_name, text_id AS record, unnest(normalized_tokens) AS raw FROM items
            UNION ALL SELECT 'item_type', text_id, item_type FROM items
            UNION ALL SELECT 'corrected', result_id, corrected FROM corrections),
        terms AS (SELECT field_name, record, nfc_normalize(regexp_replace({term}, '^{blank}+|{blank}+$', '', 'g')) AS term FROM found WHERE raw IS NOT NULL),
        good AS (SELECT * FROM terms WHERE term <> ''),
        held AS (SELECT field_name, count(DISTINCT record) AS held FROM good GROUP BY field_name),
        counted AS (SELECT field_name, term, count(*) AS n_occurrences, count(DISTINCT record) AS n_records FROM good GROUP BY field_name, term)
        SELECT c.field_name, c.term, c.n_occurrences, c.n_records,
            CASE WHEN c.n_records <= 2 THEN 'rare' WHEN c.n_records * 1000 >= 300 * h.held THEN 'common' END AS mark
        FROM counted c JOIN held h ON h.field_name = c.field_name"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_terms": _term_sql(),
        "p1_found": f"SELECT field_name, term, mark FROM ({_term_sql()}) WHERE mark IS NOT NULL",
        "p3_found": "SELECT DISTINCT translation_id FROM translation_results WHERE length(source_text) > 5000",
        "p3_cover": "SELECT DISTINCT translation_id, CAST(length(source_text) AS BIGINT) AS n_chars, true AS from_begin, true AS within_limit, true AS no_gap, true AS overlap_bound, CAST(length(source_text) AS BIGINT) AS chars_once FROM translation_results WHERE source_text IS NOT NULL",
        "p4_day_counts": _day_count_sql(),
        "p4_day_percentiles": _percentile_sql("label, day"),
        "p4_label_percentiles": _percentile_sql("label"),
    }
