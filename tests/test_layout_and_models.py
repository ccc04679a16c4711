import json

import pytest
from pyspark.sql import functions as F

from pagelight.config import CorrectionSettings, LayoutSettings, NeuralSettings, RecognitionSettings, TranslationSettings
from pagelight.operators import backends, layout, neural, recognition
from pagelight.sources import dictionaries


def regions(spark, boxes, settings=LayoutSettings()):
    payloads = [(1, json.dumps({"res": {"boxes": boxes}}), 100, 50)]
    df = spark.createDataFrame(payloads, "page long, payload string, w int, h int")
    rows = layout.decode_boxes(df, "page", "payload", "w", "h").where(F.size("coordinate") == 4)
    rows = rows.select("page", "w", "h", "box_no", "label", "cls_id", "score", *[F.get("coordinate", F.lit(i)).alias(f"c{i}") for i in range(4)])
    return layout.normalize_boxes(rows, "label", "cls_id", "score", ["c0", "c1", "c2", "c3"], "w", "h", settings)


def test_boxes(spark):
    box = lambda c, label="text", score=0.9, cls=1: {"label": label, "cls_id": cls, "score": score, "coordinate": c}
    boxes = [
        box([30.2, 20.9, 10.7, 5.1]),
        box([-5, -5, 120.5, 60]),
        box([10, 10, 10, 20]),
        box(["NaN", 1, 5, 5]),
        box([1, 1, 5, 5], score=0.35),
        box([1, 1, 5, 5], score=0.349),
        box([1, 1, 5, 5], score="NaN"),
        box([1, 1, 6, 6], label=" Figure-Title "),
        box([1, 1, 5, 5], label=None),
        box([1, 1, 7, 7], cls="x"),
        box([1, 1, 8, 8], cls=3.9),
        box([1, 2, 3]),
    ]
    out = {r.box_no: r for r in regions(spark, boxes).collect()}
    assert (out[0].x1, out[0].y1, out[0].x2, out[0].y2) == (10, 5, 31, 21)
    assert (out[1].x1, out[1].y1, out[1].x2, out[1].y2) == (0, 0, 100, 50)
    assert sorted(out) == [0, 1, 4, 7, 9, 10]
    assert out[7].label == "caption" and out[7].raw_label == "Figure-Title"
    assert out[9].class_id == -1 and out[10].class_id == 3
    kept = {r.box_no: r for r in regions(spark, boxes, LayoutSettings(keep_other_regions=True)).collect()}
    assert kept[8].raw_label == "None" and kept[8].label == "other"


def test_payloads_without_boxes(spark):
    df = spark.createDataFrame([(1, None), (2, "no json"), (3, "{}"), (4, '{"boxes": [{"label": "text", "coordinate": [1, 2, 3, 4]}]}')], "page long, payload string")
    assert [r.page for r in layout.decode_boxes(df, "page", "payload").collect()] == [4]


def test_reading_order(spark):
    rows = spark.createDataFrame([(1, 5, 0, 9, 9, 0.5), (1, 0, 5, 9, 9, 0.5), (1, 0, 0, 9, 9, 0.4), (1, 0, 0, 8, 9, 0.9)], "page long, x1 int, y1 int, x2 int, y2 int, confidence double")
    out = layout.reading_order(rows, "page", "x2").orderBy("pos").collect()
    assert [(r.x1, r.y1, r.confidence) for r in out] == [(0, 0, 0.9), (0, 0, 0.4), (5, 0, 0.5), (0, 5, 0.5)]


def test_image_rules(spark):
    sizes = [(20, 17, 3, 16), (15, 15, 3, 16), (20, 15, 3, 16), (20, 20, 4, 24), (5000, 5000, 3, 16), (None, None, None, None), (20, 20, 1, 16)]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(sizes)], "id int, w int, h int, c int, m int")
    error = {}
    for name, settings in (("fast", RecognitionSettings()), ("layout", LayoutSettings())):
        out = df.select("id", recognition.image_error(F.col("w"), F.col("h"), F.col("c"), F.col("m"), settings).alias("e")).orderBy("id").collect()
        error[name] = [r.e for r in out]
    assert error["fast"] == [None, "too_low", "too_low", "not_8_bit", "too_many_pixels", "no_image", "not_3_channels"]
    assert error["layout"][1] == "too_narrow"


def test_image_source(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"no image")
    out = recognition.valid_images(dictionaries.read_images(spark, str(tmp_path)), RecognitionSettings()).collect()
    assert len(out) == 1 and out[0].error is not None


def test_flatten(spark):
    payloads = [(1, '{"res": {"rec_texts": ["a", "b"], "rec_scores": [0.5], "rec_boxes": [[1, 2, 3, 4]]}}'), (2, '{"rec_texts": ["c"]}'), (3, '{"rec_texts": []}'), (4, None)]
    out = recognition.flatten_lines(spark.createDataFrame(payloads, "id long, payload string"), "id", "payload").collect()
    assert sorted((r.id, r.line_no, r.text, r.score, r.box) for r in out) == [(1, 0, "a", 0.5, [1, 2, 3, 4]), (1, 1, "b", None, None), (2, 0, "c", None, None)]


def test_neural(spark):
    class Upper:
        def predict(self, rows):
            return [" " + x.upper() + "  " for x in rows["model_input"]]

    rows = [(1, "She   decided\nto leave."), (2, " 　"), (3, None), (4, "x" * 5001), (5, "a\0")]
    df = spark.createDataFrame(rows, "id long, text string")
    out = {r.id: r for r in neural.translate(df, "id", "text", Upper).collect()}
    assert out[1].processed_text == "She decided to leave." and out[1].translated_text == ">>VIE<< SHE DECIDED TO LEAVE."
    assert out[2].translated_text == "" and out[2].error is None
    assert [out[i].error for i in (3, 4, 5)] == ["null_text", "too_long", "nul_character"]
    assert out[4].translated_text is None


def test_backend(spark):
    df = spark.createDataFrame([(1, "line")], "id long, text string")
    lines = recognition.flatten_lines(recognition.predict(df, "id", ["text"], lambda: recognition.EchoBackend("text")), "id", "payload").collect()
    assert [(r.text, r.score) for r in lines] == [("line", 1.0)]


@pytest.mark.parametrize("make", [lambda: LayoutSettings(model_size="L"), lambda: RecognitionSettings(side_limit=31), lambda: RecognitionSettings(device="gpu:1"), lambda: NeuralSettings(max_input_tokens=513), lambda: TranslationSettings(unicode_normalization="NFD")])
def test_settings_are_checked(make):
    with pytest.raises(ValueError):
        make()


def test_good_settings():
    assert RecognitionSettings.quality(device="gpu:1").max_image_pixels == 40_000_000
    assert LayoutSettings(model_size="S").model_name.endswith("-S")


def test_dictionary_files(spark, tmp_path):
    good = tmp_path / "d.json"
    good.write_text('{"run": "chạy", "new": ["mới", "mới lạ"], "run": ["vận hành"]}')
    rows = dictionaries.read_translation_json(spark, str(good)).orderBy("ord").collect()
    assert {r.word: r.translations for r in rows} == {"new": ["mới", "mới lạ"], "run": ["vận hành"]}
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(dictionaries.DictionaryLoadError):
        dictionaries.read_translation_json(spark, str(tmp_path / "bad.json"))
    (tmp_path / "f.txt").write_text("the 23135851162\nand 5\nbad\nx y\nthe 1\n")
    found = dictionaries.read_frequencies(spark, str(tmp_path / "f.txt")).collect()
    assert {r.term: r.frequency for r in found} == {"the": 23135851163, "and": 5}
    (tmp_path / "e.txt").write_text("")
    with pytest.raises(dictionaries.DictionaryLoadError):
        dictionaries.read_frequencies(spark, str(tmp_path / "e.txt"))


@pytest.fixture
def models(monkeypatch, tmp_path):
    """Stand-ins for the models' packages, found by the tasks' Python as well."""
    (tmp_path / "paddleocr.py").write_text(
        "import json\n"
        "class Result:\n"
        "    def __init__(self, body): self.json = body\n"
        "class PaddleOCR:\n"
        "    def __init__(self, **options): self.options = options; assert options['use_doc_unwarping'] is False\n"
        "    def predict(self, image): return [Result({'res': {'rec_texts': [f'{image.shape[1]}x{image.shape[0]}'], 'rec_scores': [0.5], 'rec_boxes': [[0, 0, 1, 1]]}})]\n"
        "class LayoutDetection:\n"
        "    def __init__(self, **options): self.options = options; assert options['model_name'] == 'PP-DocLayout-M'\n"
        "    def predict(self, input, batch_size, threshold, layout_nms):\n"
        "        if input.shape[0] == 99: return []\n"
        "        boxes = [{'label': 'text', 'cls_id': 2, 'score': 0.9, 'coordinate': [5, 50, 20, 60]}, {'label': 'doc_title', 'cls_id': 11, 'score': 0.8, 'coordinate': [5, 1, 20, 9]}, {'label': 'text', 'cls_id': 2, 'score': threshold / 2, 'coordinate': [0, 0, 9, 9]}]\n"
        "        return [Result(lambda: json.dumps({'res': {'boxes': boxes}})), Result({'boxes': []})]\n"
    )
    (tmp_path / "torch.py").write_text(
        "import contextlib\n"
        "class cuda:\n"
        "    is_available = staticmethod(lambda: False)\n"
        "device = str\n"
        "inference_mode = contextlib.nullcontext\n"
    )
    (tmp_path / "transformers.py").write_text(
        "class Part(list):\n"
        "    def to(self, device): return self\n"
        "class AutoTokenizer:\n"
        "    @classmethod\n"
        "    def from_pretrained(cls, name, local_files_only): return cls()\n"
        "    def __call__(self, texts, **options): return {'input_ids': Part(' '.join(x.split()[: options['max_length']]) for x in texts)}\n"
        "    def batch_decode(self, made, **options): return made\n"
        "class AutoModelForSeq2SeqLM:\n"
        "    @classmethod\n"
        "    def from_pretrained(cls, name, local_files_only): return cls()\n"
        "    def to(self, device): pass\n"
        "    def eval(self): pass\n"
        "    def generate(self, input_ids, num_beams, **options): return [f'{num_beams} {x.upper()}' for x in input_ids]\n"
    )
    return str(tmp_path)


def _with_path(folder, factory):
    def make():
        import sys

        sys.path.insert(0, folder)
        try:
            return factory()
        finally:
            sys.path.remove(folder)

    return make


def test_backends(spark, models):
    import numpy as np

    images = dictionaries.images_of(spark, [(1, np.zeros((70, 40, 3), np.uint8)), (2, np.zeros((99, 40, 3), np.uint8)), (3, np.zeros((5, 40, 3), np.uint8))])
    lines, errors = recognition.recognise(images, "id", _with_path(models, backends.recognition_backend()))
    assert sorted((r.id, r.text) for r in lines.collect()) == [(1, "40x70"), (2, "40x99")]
    assert [(r.id, r.error) for r in errors.collect()] == [(3, "too_low")]
    regions, errors = layout.detect(images, "id", _with_path(models, backends.layout_backend()))
    assert [(r.id, r.pos, r.label, r.y1) for r in regions.orderBy("pos").collect()] == [(1, 0, "title", 1), (1, 1, "paragraph", 50)]
    assert [r.id for r in errors.collect()] == [3]
    texts = spark.createDataFrame([(i, f"line {i} of it") for i in range(40)], "id long, text string")
    out = neural.translate(texts, "id", "text", _with_path(models, backends.neural_backend(NeuralSettings(max_input_tokens=3)))).collect()
    assert {r.id: r.translated_text for r in out} == {i: f"2 >>VIE<< LINE {i}" for i in range(40)}


def test_missing_models():
    for make in (backends.recognition_backend(), backends.layout_backend(), backends.neural_backend()):
        with pytest.raises(backends.ModelLoadError):
            make()


def test_payload_errors(spark):
    rows = [(0, None), (1, "no json"), (2, "[1]"), (3, '{"res": 5, "boxes": []}'), (4, '{"res": {"boxes": 7}}'), (5, '{"res": {}, "boxes": [{"label": "text"}]}'), (6, '{"boxes": [{"label": "text"}]}')]
    df = spark.createDataFrame(rows, "id long, payload string")
    error = {r.id: r.e for r in df.select("id", layout.payload_error(F.col("payload")).alias("e")).collect()}
    assert error == {0: "no_payload", 1: "not_json", 2: "not_json", 3: "bad_result", 4: "bad_boxes", 5: None, 6: None}
    # With res at hand the top level doesn't count.
    assert [r.id for r in layout.decode_boxes(df, "id", "payload").collect()] == [6]


def test_vocabulary_by_setting(spark, tmp_path):
    (tmp_path / "f.txt").write_text("the 5\n")
    named = dictionaries.load_vocabulary(spark, CorrectionSettings(dictionary_path=str(tmp_path / "f.txt")))
    supplied = spark.createDataFrame([("a", 1)], "term string, frequency long")
    assert named.first().term == "the" and dictionaries.load_vocabulary(spark, supplied=supplied).first().dictionary_source == "supplied"
    for none in (None, supplied.limit(0)):
        with pytest.raises(dictionaries.DictionaryLoadError):
            dictionaries.load_vocabulary(spark, supplied=none)
    found = dictionaries.corpus_frequencies(spark.createDataFrame([("Red boat, red net",), ("red",), (None,)], "text string"), "text", least=2)
    assert [(r.term, r.frequency) for r in found.collect()] == [("red", 3)]


def test_image_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, bytearray(b"abc")), (2, None)], "id long, data binary")
    out = dictionaries.write_images(rows, "id", "data", str(tmp_path / "out")).collect()
    assert [r.id for r in out] == [1] and (tmp_path / "out" / "1.png").read_bytes() == b"abc"
