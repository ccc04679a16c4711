import pytest

from pagelight.llm import leakage, pairs, scans, sentences, subjects

UNITS = [
    ["Dr. Smith paid approx. 3.5 marks.", "He left at 5 p.m. on Monday.", "3. Take the boat."],
    ["The sailor said: “Wait. The boat is old!” and left.", "“The door is red.”", "(See Fig. 1.2 and pp. 3-4.)"],
    ["Is it new?", "“Is it old?” asked the teacher.", "Who knows?!"],
    ["Die Fähre wiegt ca. 8,3 kg, z. B. am Abend.", "Am 25. Mai kam sie.", "„Sie ist alt!“, sagte er."],
    ["« La rue est calme ! » dit la dame.", "M. Petit est là."],
    ["El Sr. Gallis vio la puerta.", "¡Qué roja es!", "¿Dónde está?"],
    ["डॉ. वेलमार ने पुल रंगा।", "क्या मकान भारी है?"],
    ["أصلح د. فلمار الطريق أمس.", "ما أجمل المصباح!"],
    ["The road... well, it is long.", "eSpool 8 is new!", "J. B. Hall left."],
]
DENSE = [
    ["「山は赤い？」と農夫は言った。", "列車は25.9キロだ。", "「道は壊れた。」", "橋だ。"],
    ["“市场宽吗？”农民昨天问。", "这门太有名的了！", "工人……移动了信。"],
]


@pytest.mark.parametrize("units, gap", [(u, " ") for u in UNITS] + [(u, "") for u in DENSE])
def test_sentences(units, gap):
    text = gap.join(units)
    assert [text[a:b] for a, b in sentences.sentences(text)] == units


def test_sentence_layout():
    text = "A heading\n\nOne line\nbreaks. That went.Three follows.\n\nno end mark"
    assert [text[a:b] for a, b in sentences.sentences(text)] == ["A heading", "One line\nbreaks.", "That went.", "Three follows.", "no end mark"]
    assert len(sentences.sentences("บ้านเก่ามากครับ ครูลืมสวน 36 อันแล้วค่ะ\nเรือพังมากค่ะ")) == 3
    assert sentences.sentences(" \n　") == [] and sentences.sentences("") == []
    assert len(sentences.sentences("“" * 50 + "Ab cd. " * 2000)) > 1000


def test_blocks_without_quotation_are_scored_alike():
    for tail in ("", " (So it was)"):
        text = "42! Then we left." + tail
        assert [text[a:b] for a, b in sentences.sentences(text)][0] == "42! Then we left."
    text = "The old boat is red. The new boat is not. It is 3 p.m. now"
    assert len(sentences.sentences(text)) == 3


@pytest.mark.parametrize("many", [1, 2, 4, 5, 8, 30, 100])
@pytest.mark.parametrize("marks", ["“”", "„“", "()", "«»", "「」"])
def test_quoted_speech_of_any_length_is_in_its_sentence(many, marks):
    speech = " ".join(f"The boat number {i} is old." for i in range(many))
    units = ["We met.", f"He said: {marks[0]}{speech}{marks[1]} and left again.", "Then it rained."]
    text = " ".join(units)
    assert [text[a:b] for a, b in sentences.sentences(text)] == units


def test_marks_without_a_partner_hold_nothing():
    text = "The “old boat is red. A (new one is not. It sank."
    assert len(sentences.sentences(text)) == 3
    text = "(" + "z. B. ca. 3 m, " * 60 + "so) it is. We left."
    assert [text[a:b] for a, b in sentences.sentences(text)] == [text[:-9], "We left."]
    assert len(sentences.sentences("z. B. vgl. " * 4000)) == 1
    assert len(sentences.sentences("(" + "เรือพังมากค่ะ " * 20_000 + ") ok. " + "So it is. " * 3)) == 4


def test_program_equals_all_segmentations():
    """The best of all ways to cut short texts, scored span by span, with and without quotations."""
    import random

    rng = random.Random(8)
    parts = ["The boat is red", "he left", "z", " (", ") ", " “", "” ", ". ", "! ", "? ", "… ", "Dr. ", "5 ", "3.", "ครับ ", "。", "\n", "why", " and so on it goes without an end in sight of anyone", '"']
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(2, 14)))
        low, high = 0, len(text)
        nodes, worth = sentences._nodes(text, low, high)
        inner = range(1, len(nodes) - 1)
        if len(inner) > 9:
            continue

        def total(cuts):
            spans = list(zip([0, *cuts], [*cuts, len(nodes) - 1]))
            return sum(worth[j] - sentences._length_cost(nodes[j] - nodes[i]) - sentences.EMPTY * sentences._empty(text, nodes[i], nodes[j]) for i, j in spans)

        every = [[k for n, k in enumerate(inner) if bits >> n & 1] for bits in range(1 << len(inner))]
        got = [nodes.index(e) for e in sentences._segment_block(text, low, high)][:-1]
        assert total(got) == pytest.approx(max(map(total, every)))


def test_sentences_of_rows(spark):
    df = spark.createDataFrame([(1, "Ab. Cd."), (2, None), (3, ""), (1, "Ab. Cd.")], "id long, text string")
    out = sentences.split_sentences(df, "id", "text").collect()
    assert sorted((r.id, r.sentence_no, r.end_char, r.sentence) for r in out) == [(1, 0, 3, "Ab."), (1, 0, 3, "Ab."), (1, 1, 7, "Cd."), (1, 1, 7, "Cd.")]


def test_fit_takes_whole_texts():
    import pandas as pd

    frame = pd.DataFrame({"prompt": ["ab " * 900 + "zq"], "response": ["ab " * 900 + "4; zq"]})
    out = pd.concat(pairs._count([frame]))
    size = len("ab " * 900 + "4; zq")
    assert [out[out["kind"] == f"inside1{n}"]["n"].sum() for n in range(3)] == [size - 1, size - 2, size - 3]
    assert set(pairs.Texts.of(["zq"]).grams) <= set(out[out["kind"] == "prompt"]["bucket"])


GOOD = [("The old boat is red.", "Con thuyền cũ thì đỏ."), ("Our teacher sold the house yesterday.", "Cô giáo đã bán ngôi nhà hôm qua."), ("Who found the new map?", "Ai đã tìm thấy tấm bản đồ mới?")]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, *GOOD[i % 3]) for i in range(300)]
    return pairs.fit(spark.createDataFrame(rows, "id long, a string, b string"), "id", "a", "b")


CASES = [
    (*GOOD[0], None),
    (GOOD[0][0], None, "empty"),
    (GOOD[0][0], " … ", "empty"),
    (GOOD[0][0], "I'm sorry, but I can't translate this text.", "refusal"),
    (GOOD[0][0], "Tôi  không  được  phép  dịch  đoạn  văn  này.", "refusal"),
    ("I'm sorry, I can't help you with the boat.", "Xin lỗi, tôi không thể giúp bạn với con thuyền.", None),
    (GOOD[0][0], "THE OLD BOAT IS RED", "copied"),
    (GOOD[0][0], "Bản dịch: The old boat is red.", "copied"),
    (GOOD[0][0], "The old boat is red. The old boat is red.", "copied"),
    ("桥重25.7公斤。", "桥重25.7公斤。", "copied"),
    ("R3-62B", "R3-62B", None),
    ("Pellhab Hallis", "Pellhab Hallis", None),
    ("12:30", "12:30", None),
    (GOOD[0][0], "Who sold the new house yesterday?", "wrong_language"),
    (GOOD[1][0], "Cô giáo đã bán ngôi", "truncated"),
    ("The teacher sold the", "Cô giáo đã bán", None),
    ("The boat is red. Who found the map? Our teacher sold the house. The boat is old.", "Con thuyền thì đỏ.", "truncated"),
    (None, None, None),
    ("  ", "", None),
]


@pytest.mark.parametrize("prompt, response, due", CASES)
def test_defects(model, prompt, response, due):
    assert pairs.defect(model, prompt, response) == due


def test_fit_takes_all_rows(spark):
    """Of 25,000 pairs each has its part in the model, and so has a language of a few of them."""
    import numpy as np

    n = 25_000
    rows = spark.range(n).selectExpr("id", "CASE WHEN id % 2500 = 0 THEN 'ωψ ωψ.' ELSE 'ab cd.' END AS a", "concat('xy ', id % 10, ' zq.') AS b")
    model = pairs.fit(rows, "id", "a", "b")
    # Places of a text but its last one.
    assert [model.ends[side, 1, 0].sum() for side in (0, 1)] == [n * (len("ab cd.") - 1), n * (len("xy 0 zq.") - 1)]
    assert model.last[0].sum() == model.last[1].sum() == model.last[2].sum() == n
    few, many = (np.unique(pairs.Texts.of([x]).grams) for x in ("ωψ ωψ.", "ab cd."))
    share = np.exp(model.logs[1]) - pairs.FLAT / pairs.BUCKETS
    assert share[few].sum() / share[[*few, *many]].sum() == pytest.approx(10 / n, rel=0.01)


def test_excuses_are_found_by_their_stems():
    """What is looked for first leaves nothing out that the pattern finds."""
    import random

    rng = random.Random(6)
    words = "sorry,apologize,apologise,regret,unfortunately,unable,cannot,can't,can’t,won't,won’t,not able,not allowed,refuse,decline,as an AI,as a language model,as an assistant,xin lỗi,rất tiếc,đáng tiếc,không thể,không được phép,từ chối,là một trợ lý,là một mô hình,vi phạm,thông cảm,nằm ngoài khả năng,không dịch được,désolé,désolée,je ne peux pas,leider,tut mir leid,kann nicht,kann ich nicht,lo siento,no puedo".split(",")
    for word in words:
        assert pairs._excuses(word) and pairs._EXCUSE.search(word)
        for _ in range(40):
            text = "".join(rng.choice([c, c.upper(), c.lower(), {"s": "ſ", "i": "ıİ"[rng.random() < 0.5], "k": "\u212a"}.get(c, c)]) for c in word)
            text = rng.choice(["", "x", "The ", "đ ", "ß."]) + text + rng.choice(["", "s", " boat", "."])
            assert pairs._excuses(text) == (pairs._EXCUSE.search(text) is not None), text


@pytest.mark.parametrize("kept", [1, 4])
def test_languages_of_neither_side_are_foreign(spark, kept):
    """However few responses there are for the prompts."""
    rows = [(i, GOOD[i % 3][0], GOOD[i % 3][1] if i % kept == 0 else GOOD[i % 3][1][:9]) for i in range(240)]
    model = pairs.fit(spark.createDataFrame(rows, "id long, a string, b string"), "id", "a", "b")
    for foreign in ("Старая лодка была красной вчера вечером.", "古い船は赤いです。", "배가 빨갛습니다 그리고 오래되었습니다."):
        assert pairs.defect(model, GOOD[0][0], foreign) == "wrong_language"
    for asked, given in GOOD:
        assert pairs.defect(model, asked, given) != "wrong_language"


def test_bounds_of_sentence_counts_change_nothing():
    """Where the end marks settle the count the sentences would have said the same."""
    import random

    rng = random.Random(5)
    parts = ["The boat is red. ", "Dr. Hall left at 5 p.m. today. ", "He said: “Wait. It is old!” and went. ", "“Is it?” ", "Why? ", "So it is… ", "(See p. 3.) ", "e.g. this one, ", "\n\n", "Thuyền đỏ. ", "Ông nói: “Khoan. Đợi đã!” rồi đi. "]
    for _ in range(1500):
        a, b = ("".join(rng.choice(parts) for _ in range(rng.randint(1, n))) for n in (9, 7))
        asked, given = len(sentences.sentences(a)), len(sentences.sentences(b))
        if b.strip():
            assert pairs._omits(a, b) == (asked > 1 and 2 * given <= asked), (a, b, asked, given)


def test_defects_of_rows(spark, model):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(CASES)] + [(99, GOOD[0][0], None)] * 2, "id long, a string, b string")
    out = pairs.find_defects(df, "id", "a", "b", model).collect()
    assert sorted((r.id, r.defect) for r in out) == sorted([(i, d) for i, (_, _, d) in enumerate(CASES) if d] + [(99, "empty")] * 2)
    assert pairs.find_defects(df.limit(0), "id", "a", "b").count() == 0


BODY = ["the harbour raised a small boat and the teacher left-", "hand the old map to the sailor before the winter came", "again. Every nobody knows the rea-", "son for the storm that the sailor saw in the har-"]


@pytest.fixture(scope="module")
def book(spark):
    texts = []
    for page in range(1, 9):
        number = str(page + 4) if page != 5 else "g"
        last = "bour of the old teacher who saw the winter and th" + ("c boat." if page == 3 else "e boat.")
        texts.append((page, page, "\n".join([f"The Old Harbour of Fenno — Part {'ABC'[page // 3]}", "", *BODY, last, f"   [{number}]"])))
    texts += [texts[0], (20, 99, "a page of no book"), (21, 98, None), (22, 97, " ")]
    ocr = spark.createDataFrame(texts, "result_id long, page_id long, original_text string")
    pages = spark.createDataFrame([(i, 1, i) for i in range(1, 9)] * 2 + [(50, None, None)], "page_id long, book_id long, page_no int")
    regions = spark.createDataFrame([(1, 1, "Header", 0, 0), (2, None, None, None, None)], "region_id long, page_id long, label string, first_line int, last_line int")
    words = "the harbour raised small boat and teacher left hand old map to sailor before winter came again reason storm that saw in of who nobody knows for every".split()
    terms = spark.createDataFrame([(w, 100) for w in words] + [(None, 1), (" ", None)], "term string, frequency long")
    return ocr, pages, regions, terms


def test_places(spark, book):
    out = {}
    for r in scans.places(*book).collect():
        out.setdefault(r.kind, set()).add((r.result_id, r.line_no))
    assert out["running_text"] == {(p, 0) for p in range(1, 9)}
    assert out["page_number"] == {(p, 7) for p in range(1, 9)}
    assert {(p, n) for p in range(1, 9) for n in (4, 5)} <= out["hyphen_break"]
    assert out["misread"] == {(3, 6)}


def test_own_hyphens_stay(spark, book):
    ocr, pages, regions, terms = book
    more = spark.createDataFrame([(30 + i, 60, "a left-hand turn and a left-hand door") for i in range(3)], "result_id long, page_id long, original_text string")
    out = scans.places(ocr.unionByName(more), pages, regions, terms)
    assert out.where("kind = 'hyphen_break' and line_no = 2").count() == 0


def test_paragraphs(spark, book):
    rows = scans.paragraphs(*book).where("book_id = 1").collect()
    text = " ".join(r.text for r in sorted(rows, key=lambda r: (r.result_id, r.line_no)))
    assert "Fenno" not in text and "[" not in text and "thc" not in text
    assert "the reason for the storm" in text and "harbour of the old teacher" in text


@pytest.mark.parametrize("chunk", [4, 32, 1000])
def test_paragraphs_over_stretches(spark, book, monkeypatch, chunk):
    """The same rows for stretches of any length, each character once."""
    monkeypatch.setattr(scans, "CHUNK", chunk)
    *_, terms = book
    texts, due = [], []
    words = "map boat hand winter sailor old small harbour teacher left".split()
    for page in range(1, 101):
        begin, end = f"the {words[page % 10]} of the {words[page // 10 % 10]}", f"who saw the {words[page % 7]} and the har-"
        # A new paragraph begins within a page, but for those of 40 to 69.
        middle = [f"   Nobody knows the {words[page % 9]}"] if not 40 <= page < 70 else []
        texts.append((page, page, "\n".join([f"bour {begin}", *middle, end])))
        due = due or [""]
        due[-1] += f"bour {begin}"
        if middle:
            due.append(middle[0].strip())
        due[-1] += f" {end[:-1]}"
    ocr = spark.createDataFrame(texts, "result_id long, page_id long, original_text string")
    pages = spark.createDataFrame([(i, 1, i) for i in range(1, 101)], "page_id long, book_id long, page_no int")
    regions = spark.createDataFrame([], "region_id long, page_id long, label string, first_line int, last_line int")
    rows = sorted(scans.paragraphs(ocr, pages, regions, terms).collect(), key=lambda r: (r.result_id, r.line_no))
    # A book's last word has nothing to go on with.
    assert [r.text.rstrip("-") for r in rows] == due
    assert [(r.result_id, r.line_no) for r in rows] == [(1, 0)] + [(p, 1) for p in range(1, 101) if not 40 <= p < 70]


def test_long_words_are_misread_too(spark):
    for good in ("donau" * 8 + "kapitän", "q" * 4 + "donau" * 7 + "z"):
        bad = [good.replace("a", "e", 1), good[1:], good + "x", good.replace("n", "h", 1)]
        words = spark.createDataFrame([("the", 900, 0, True), ("thc", 1, 0, False), (good, 900, 0, True), *((x, 1, 0, False) for x in bad)], "token string, n long, named long, listed boolean")
        assert {(r.token, r.printed) for r in scans.misreadings(words).collect()} == {("thc", "the"), *((x, good) for x in bad)}


def test_no_pages(spark, book):
    ocr, pages, regions, terms = book
    assert scans.places(ocr.limit(0), pages, regions, terms).count() == 0


PASSAGE = "On closer view the useful package noted the algorithm along with the smooth variable. Lunhab shaped the final compiler thanks to the garden and required every sturdy base. The bytecode carried a heavy evening but the precise answer confirmed the debugger."
OTHER = "When the museum closed its seasonal affidavit the charge was broad and annual. The plaintiff started a vague litigation while the costly engine crossed the defendant, at least on paper and without delay."


def test_leaks(spark):
    words = PASSAGE.split()
    cues = "\n\n2\n00:00:03,000 --> 00:00:04,000\n".join(PASSAGE.split(". "))
    docs = [
        (1, "x y z. " + PASSAGE + " and more"),
        (2, " ".join(w if i % 11 else "changed" for i, w in enumerate(words)).upper()),
        (3, " ".join(words[: len(words) * 2 // 3])),
        (4, " ".join(words[:8]) + " something else entirely"),
        (5, None),
        (6, ""),
        (7, OTHER * 3),
        (8, "1\n00:00:01,000 --> 00:00:02,000\n" + cues),
        (9, " ".join(words[:20]) + " " + "filler " * 300 + " ".join(words[20:])),
        (10, " ".join(reversed(words))),
        (1, PASSAGE),
    ]
    items = [(1, "e", "Read the passage below. " + PASSAGE + " Question: which one is meant?"), (2, "e", None), (3, "e", "")]
    items += [(10 + i, "e", f"Read the passage below. Item {i} tells of thing {i * 7} and of matter {i * 13} only, nothing more. Question: which {i} is meant?") for i in range(6)]
    asked = spark.createDataFrame(items + items[:1], "eval_id long, eval_name string, text string")
    out = leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), asked)
    assert sorted((r.doc_id, r.eval_id) for r in out.collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (8, 1), (9, 1)]
    assert {r.eval_id: r.passage.strip() for r in leakage.passages(asked).collect()}[1] == PASSAGE


@pytest.mark.parametrize("others", [[PASSAGE], []])
@pytest.mark.parametrize("part", [slice(0, 0.56), slice(0.44, 1), slice(0.22, 0.78)])
def test_leaks_of_one_part(spark, part, others):
    words = leakage.words_of(PASSAGE + " " + OTHER)
    half = " ".join(words[int(part.start * len(words)) : int(part.stop * len(words))])
    rows = [*(x + " " + OTHER for x in others), *[f"number {i} then {half} and number {i}" for i in range(20)], "of no passage"]
    documents = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "e", PASSAGE + " " + OTHER)], "eval_id long, eval_name string, text string")
    assert sorted(r.doc_id for r in leakage.find_leaks(documents, items).collect()) == list(range(len(rows) - 1))


def _brute(passage, text):
    """The same alignment, cell by cell, keeping (score, pairs, equal)."""
    best = [[(0, 0, 0)] * (len(text) + 1) for _ in range(len(passage) + 1)]
    before = [x[:] for x in best]
    for i, a in enumerate(passage, 1):
        for j, b in enumerate(text, 1):
            step = leakage.MATCH if a == b else leakage.MISMATCH
            ways = [(x[0] + step - cost, x[1] + 1, x[2] + (a == b)) for x, cost in ((best[i - 1][j - 1], 0), (before[i - 1][j - 1], leakage.JUMP))]
            ways += [(x[0] + leakage.GAP, *x[1:]) for x in (best[i - 1][j], best[i][j - 1])]
            best[i][j] = max((0, 0, 0), *ways)
            before[i][j] = max(best[i][j], before[i - 1][j], before[i][j - 1])
    return before[-1][-1][1:]


def test_alignment_equals_brute_force():
    import random

    import numpy as np

    rng = random.Random(4)
    pairs = []
    for _ in range(60):
        passage = [rng.randint(0, 12) for _ in range(rng.randint(1, 25))]
        text = [rng.randint(0, 12) for _ in range(rng.randint(0, 9))] + [x for x in passage if rng.random() > 0.2] + [rng.randint(0, 12) for _ in range(rng.randint(0, 30))]
        pairs.append((passage, text))
    got = leakage.aligned_words([np.array(a) for a, _ in pairs], [np.array(b) for _, b in pairs])
    assert list(zip(*(x.tolist() for x in got))) == [_brute(a, b) for a, b in pairs]
    assert leakage.aligned_words([], [])[0].tolist() == []


def test_recall_by_rate_of_edits():
    """Found are whole copies with every third word changed or up to 30 % of the words at random places, copies of 75 % up to 20 % and of 60 % up to 10 %."""
    import random

    import numpy as np

    rng = random.Random(6)
    known = [f"w{i}" for i in range(900)]

    def text(n):
        return [known[min(int(rng.expovariate(1 / 120)), 899)] for _ in range(n)]

    items = [text(rng.randint(60, 140)) for _ in range(40)]
    block = leakage.item_block([{"eval_id": i, "passage": " ".join(x)} for i, x in enumerate(items)])
    cases = {}
    for name, change, part in [("third", None, 1), ("10", 0.1, 1), ("20", 0.2, 1), ("30", 0.3, 1), ("60, 10", 0.1, 0.6), ("75, 20", 0.2, 0.75)]:
        for i, words in enumerate(items):
            words = words[: int(part * len(words)) + 1]
            edited = [f"x{k}" if (k % 3 == 2 if change is None else rng.random() < change) else w for k, w in enumerate(words)]
            cases[name, i] = " ".join(text(80) + edited + text(80))
    others = [" ".join(text(300)) for _ in range(200)]
    frequency = np.zeros(len(block.grams), np.int64)
    every = [*cases.values(), *others]
    for x in every:
        frequency[np.unique(block.hits([x])[4])] += 1
    leakage.choose_seeds(block, frequency, len(every))
    found = {(number, item) for number, item, _ in leakage._search(block, every)}
    for name in ("third", "10", "20", "30", "60, 10", "75, 20"):
        mine = [n for n, key in enumerate(cases) if key[0] == name]
        assert sum((n, list(cases)[n][1]) in found for n in mine) >= 0.9 * len(mine), name
    assert not [x for x in found if x[0] >= len(cases)]


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, PASSAGE), (2, OTHER)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a", PASSAGE), (2, "b", OTHER), (3, "c", "one two three four five six seven")], "eval_id long, eval_name string, text string")
    monkeypatch.setattr(leakage, "WORDS", 1)
    assert sorted((r.doc_id, r.eval_id) for r in leakage.find_leaks(docs, items).collect()) == [(1, 1), (2, 2)]
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0


def test_subjects(spark):
    topics = {"law": "court judge verdict", "sport": "goal referee match"}
    docs, labels = [], []
    for i in range(120):
        name = ("law", "sport")[i % 2]
        word = topics[name].split()[i % 3]
        docs.append((i, f"The {word} stood near the old house today. A {word} was seen by the river again."))
        labels.append((i, [name, " " + name.upper()][i % 5 == 0]))
    docs += [(200, "The judge met the court. The referee saw the goal here."), (201, "The river ran by the old house today."), (202, None), (203, ""), (204, "The judge met the court. " + "The river ran by the house. " * 9)]
    labels += [(1, None), (None, "law"), (2, "unknown subject")]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    areas = spark.createDataFrame([("law", "x"), ("sport", "y")], "subject string, about string")
    rules = subjects.mine_rules(documents, spark.createDataFrame(labels, "doc_id long, subject string"), areas)
    out = {}
    for r in subjects.find_subjects(documents, rules).collect():
        out.setdefault(r.doc_id, set()).add(r.subject)
    assert all(out[i] == {("law", "sport")[i % 2]} for i in range(120))
    assert out[200] == {"law", "sport"} and not {201, 202, 203, 204} & set(out)
    none = subjects.mine_rules(documents, spark.createDataFrame([], "doc_id long, subject string"), areas)
    assert subjects.find_subjects(documents, none).count() == 0


def test_calibration_of_evidence(spark):
    import numpy as np

    x = np.repeat(np.arange(12) * 0.5, 2)
    y = np.tile([0.0, 1.0], 12)
    chance = 1 / (1 + np.exp(-(1.5 * x - 2.0)))
    n = 10_000 * np.where(y == 1, chance, 1 - chance)
    slope, offset = subjects.logistic(x, y, n)
    assert slope == pytest.approx(1.5, abs=0.01) and offset == pytest.approx(-2.0, abs=0.02)
    # A word that is as often wrong as right on held-out documents tells nothing by itself.
    rules = subjects.Rules(("law", "sport"), {"court": (0, 1.0), "judge": (0, 4.0)}, {})
    rows = [("law", ["judge"], True)] * 60 + [("sport", ["court"], True)] * 40 + [("law", ["court"], True)] * 25
    fitted = subjects.calibrated(rules, spark.createDataFrame(rows, "subject string, words array<string>, held_out boolean"))
    assert fitted.subject(["court"]) is None and fitted.subject(["judge"]) == 0
    assert subjects.calibrated(rules, spark.createDataFrame(rows[:0], "subject string, words array<string>, held_out boolean")) == rules
