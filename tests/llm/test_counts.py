import math
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelight.llm import encoding, frequency, percentiles, splitting
from pagelight.operators import joins

RAW = ["Word", " word ", "ＷＯＲＤ", "word ", "straße", "STRASSE", "ﬁne", "", "  ", None, "x", "İ", "a\tb"]


def normal(value):
    return unicodedata.normalize("NFKC", value).strip().casefold()


@pytest.mark.parametrize("hot, broadcast", [(10**6, 10**5), (20, 10**5), (10**6, 0)])
def test_terms_equal_brute_force(spark, monkeypatch, hot, broadcast):
    monkeypatch.setattr(frequency, "HOT_ROWS", hot)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast)
    rng = random.Random(1)
    lists = [(i, i // 2, [rng.choice(RAW) for _ in range(rng.randint(0, 6))] if i % 7 else None) for i in range(400)]
    plain = [(i % 50 or None, "hot" if i % 3 else rng.choice(RAW)) for i in range(900)]
    # Some rows are stored again.
    a = spark.createDataFrame(lists + lists[::9], "item long, record long, terms array<string>").withColumn("field_name", F.lit("clash")).withColumn("id", F.lit(1))
    b = spark.createDataFrame(plain, "record long, term string")
    fields = [frequency.TermField(a, "terms", "record", "many", is_array=True, key=("item",)), frequency.TermField(b, "term", "record", "one")]
    out = frequency.term_frequencies(fields)
    got = {(r.field_name, r.term): (r.n_occurrences, r.n_records, r.mark) for r in out.collect()}
    rows = [("many", r, t) for _, r, ts in lists for t in ts or []] + [("one", r, t) for r, t in plain]
    occurs, records, held = Counter(), defaultdict(set), defaultdict(set)
    for field, record, value in rows:
        if value is not None and normal(value):
            occurs[field, normal(value)] += 1
            records[field, normal(value)].add(record)
            held[field].add(record)
    due = {}
    for key, n in occurs.items():
        k = len(records[key])
        due[key] = (n, k, "rare" if k <= 2 else "common" if 10 * k >= 3 * len(held[key[0]]) else None)
    assert got == due
    ids = frequency.dictionary(fields)[0]
    assert sorted(r.id for r in ids.collect()) == list(range(ids.count()))


def test_no_terms(spark):
    empty = spark.createDataFrame([(1, None), (2, " ")], "record long, term string")
    assert frequency.term_frequencies([frequency.TermField(empty, "term", "record", "one")]).count() == 0


def test_percentiles_keep_the_bound_and_merge(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i % 5, rng.choice([0.0, 1.0, rng.random(), -rng.random() * 1e3, rng.random() * 1e6])) for i in range(3000)]
    rows += [("a", 1, None), ("a", 1, float("nan")), ("a", 1, float("inf")), (None, 2, 0.5)]
    df = spark.createDataFrame(rows, "label string, day int, value double")
    days = percentiles.log_counts(df, ["label", "day"], "value")
    once = percentiles.percentiles(percentiles.log_counts(df, ["label"], "value"), ["label"])
    merged = percentiles.percentiles(percentiles.merge_counts(days, ["label"]), ["label"])
    assert sorted(map(str, once.collect())) == sorted(map(str, merged.collect()))
    for row in merged.collect():
        values = sorted(v for a, _, v in rows if a == row.label and v is not None and math.isfinite(v))
        assert row.n == len(values)
        for q in percentiles.PERCENTILES:
            exact = values[math.ceil(q / 100 * len(values)) - 1]
            assert abs(row[f"p{q:02d}"] - exact) <= percentiles.RELATIVE_ERROR * abs(exact) + 1e-12
    assert percentiles.percentiles(percentiles.log_counts(df.limit(0), ["label"], "value"), ["label"]).count() == 0


def test_pieces():
    rng = random.Random(3)
    texts = ["", "short", "x" * 40_000, " " * 12_000, "é́" * 9_000, "e" + "́" * 15_000]
    for _ in range(30):
        texts.append("".join(rng.choice(["word ", "long" * rng.randint(1, 900), ". ", "\n\n", "。", "ไทย ", "! "]) for _ in range(rng.randint(1, 900))))
    found = splitting.split_batch(texts)
    for text, pieces in zip(texts, found):
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert all(b - a <= splitting.LIMIT for a, b in pieces)
        for (_, before), (begin, end) in zip(pieces, pieces[1:]):
            assert before - splitting.OVERLAP <= begin <= before < end
        assert (len(pieces) > 1) == (len(text) > splitting.LIMIT)
    assert [splitting.split_batch([t])[0] for t in texts] == found
    prose = "This is a sentence of words. " * 1000
    assert all(prose[:b].rstrip().endswith(".") for _, b in splitting.split_batch([prose])[0])


def test_pieces_follow_the_greedy_walk():
    """Pointer doubling gives the cuts that a walk from the begin gives."""
    text = "abc def. " * 3000
    pieces = splitting.split_batch([text], 1000, 100)[0]
    at = [0]
    while at[-1] < len(text):
        begin = 0 if at[-1] == 0 else min(x for x in range(at[-1] - 100, at[-1] + 1) if text[x - 1] == " ")
        at.append(len(text) if begin + 1000 >= len(text) else max(x for x in range(at[-1] + 1, begin + 1001) if text[x - 2 : x] == ". "))
    assert [b for _, b in pieces] == at[1:]


def test_pieces_of_rows(spark):
    rows = [(1, "a " * 4000, 9), (1, "a " * 4000, 9), (2, None, 9), (3, "", 9)]
    out = splitting.split_texts(spark.createDataFrame(rows, "id long, text string, piece_no int"), "id", "text").collect()
    assert sorted((r.id, r.piece_no, r.n_pieces) for r in out) == [(1, 0, 2), (1, 0, 2), (1, 1, 2), (1, 1, 2), (3, 0, 1)]


def test_ids_equal_whole_text_encoding(spark):
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(encoding.DEFAULT_RANKS.replace(".tiktoken", ".json"))
    tokenizer.encode_special_tokens = True
    rng = random.Random(4)
    letters = "ab'sre .,!?\n\t 　é中ไ1½́zq-_<|>\x85\r\xa0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(800)]
    texts += [None, "", "<|endoftext|>", "?!'s", "  x  y \n\n z", "a" * 3000, " " * 300, "word " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = {r.doc_id: r.ids for r in encoding.encode(df).collect()}
    due = [x.ids for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert out == dict(enumerate(due))
    assert encoding.encode(df.limit(0)).count() == 0


def test_certain_cuts_stand_in_no_entry():
    ranks = encoding.read_ranks()
    cut = encoding.certain_cuts(ranks)
    assert cut.any()
    for entry in list(ranks)[::97]:
        pairs = np.frombuffer(entry, np.uint8)
        assert not cut[pairs[:-1], pairs[1:]].any()
