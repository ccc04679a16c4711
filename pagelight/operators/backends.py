"""Model backends: made once in each task, given batches of rows, giving text back.

The models' packages are looked for only when a task starts; tests put
stand-ins in their place.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

import numpy as np
import pandas as pd

from pagelight.config import LayoutSettings, NeuralSettings, RecognitionSettings


class ModelLoadError(RuntimeError):
    """A model can't be loaded."""


class ModelOutputError(RuntimeError):
    """A model failed on its input, or its output can't be read."""


def image_array(image: Mapping | Any) -> np.ndarray:
    """Height x width x 3 bytes of a row of Spark's image source."""
    get = image.__getitem__ if isinstance(image, Mapping) else lambda name: getattr(image, name)
    return np.frombuffer(get("data"), np.uint8).reshape(get("height"), get("width"), get("nChannels"))


def payload_of(result: Any) -> str:
    """The JSON text of a model's result object, which has it as text, as a mapping or behind a call."""
    found = getattr(result, "json", None)
    found = found() if callable(found) else found
    if isinstance(found, str):
        try:
            found = json.loads(found)
        except json.JSONDecodeError as error:
            raise ModelOutputError("the model's result is no JSON") from error
    if not isinstance(found, Mapping):
        raise ModelOutputError("the model's result has no JSON object")
    return json.dumps(found, default=lambda x: x.tolist() if hasattr(x, "tolist") else str(x))


def device_of(device: str) -> str | None:
    """auto leaves the choice to the model's package."""
    return None if device == "auto" else device


class RecognitionBackend:
    """Text recognition; one payload for each image, null where the model finds no page."""

    def __init__(self, settings: RecognitionSettings, image: str = "image"):
        self.image = image
        try:
            from paddleocr import PaddleOCR

            self.model = PaddleOCR(
                text_detection_model_name=settings.detection_model,
                text_recognition_model_name=settings.recognition_model,
                device=device_of(settings.device),
                engine=settings.engine,
                enable_mkldnn=settings.enable_mkldnn,
                cpu_threads=settings.cpu_threads,
                text_det_limit_side_len=settings.side_limit,
                text_det_limit_type=settings.limit_type,
                text_det_thresh=settings.detection_threshold,
                text_det_box_thresh=settings.box_threshold,
                text_det_unclip_ratio=settings.unclip_ratio,
                text_recognition_batch_size=settings.recognition_batch_size,
                text_rec_score_thresh=settings.recognition_score_threshold,
                **dict.fromkeys(("use_doc_orientation_classify", "use_doc_unwarping", "use_textline_orientation"), False),
            )
        except Exception as error:
            raise ModelLoadError("the recognition models can't be loaded") from error

    def predict(self, rows: pd.DataFrame) -> list[str | None]:
        out = []
        for image in rows[self.image]:
            try:
                pages = list(self.model.predict(image_array(image)))
            except Exception as error:
                raise ModelOutputError("the recognition failed on an image") from error
            out.append(payload_of(pages[0]) if pages else None)
        return out


class LayoutBackend:
    """Layout detection; of an image's results the first counts, and none is an empty list of boxes."""

    def __init__(self, settings: LayoutSettings, image: str = "image"):
        self.image, self.settings = image, settings
        try:
            from paddleocr import LayoutDetection

            self.model = LayoutDetection(model_name=settings.model_name, device=device_of(settings.device), engine=settings.engine, enable_mkldnn=settings.enable_mkldnn, cpu_threads=settings.cpu_threads)
        except Exception as error:
            raise ModelLoadError(f"the layout model {settings.model_name} can't be loaded") from error

    def predict(self, rows: pd.DataFrame) -> list[str | None]:
        out = []
        for image in rows[self.image]:
            try:
                found = list(self.model.predict(input=image_array(image), batch_size=self.settings.batch_size, threshold=self.settings.confidence_threshold, layout_nms=self.settings.layout_nms))
            except Exception as error:
                raise ModelOutputError("the layout detection failed on an image") from error
            out.append(payload_of(found[0]) if found else '{"boxes": []}')
        return out


class NeuralBackend:
    """Neural translation of a batch of model inputs; inputs are cut at max_input_tokens."""

    def __init__(self, settings: NeuralSettings, text: str = "model_input"):
        self.text, self.settings = text, settings
        try:
            import torch
            from transformers import AutoModelForSeq2SeqLM, AutoTokenizer

            self.torch = torch
            gpu = settings.device == "gpu" or settings.device == "auto" and torch.cuda.is_available()
            self.device = torch.device("cuda" if gpu else "cpu")
            self.tokenizer = AutoTokenizer.from_pretrained(settings.model_name, local_files_only=settings.local_files_only)
            self.model = AutoModelForSeq2SeqLM.from_pretrained(settings.model_name, local_files_only=settings.local_files_only)
            self.model.to(self.device)
            if gpu and settings.use_fp16:
                self.model.half()
            self.model.eval()
        except Exception as error:
            raise ModelLoadError(f"the translation model {settings.model_name} can't be loaded") from error

    def predict(self, rows: pd.DataFrame) -> list[str | None]:
        s, out = self.settings, []
        texts = rows[self.text].tolist()
        for low in range(0, len(texts), s.batch_texts):
            try:
                given = self.tokenizer(texts[low : low + s.batch_texts], return_tensors="pt", truncation=True, max_length=s.max_input_tokens, padding=True)
                given = {name: part.to(self.device) for name, part in given.items()}
                with self.torch.inference_mode():
                    made = self.model.generate(**given, max_new_tokens=s.max_new_tokens, num_beams=s.num_beams, length_penalty=s.length_penalty, early_stopping=s.early_stopping, do_sample=False)
                out += self.tokenizer.batch_decode(made, skip_special_tokens=True, clean_up_tokenization_spaces=True)
            except Exception as error:
                raise ModelOutputError("the translation failed") from error
        return out


def recognition_backend(settings: RecognitionSettings = RecognitionSettings(), image: str = "image") -> Callable[[], RecognitionBackend]:
    return lambda: RecognitionBackend(settings, image)


def layout_backend(settings: LayoutSettings = LayoutSettings(), image: str = "image") -> Callable[[], LayoutBackend]:
    return lambda: LayoutBackend(settings, image)


def neural_backend(settings: NeuralSettings = NeuralSettings(), text: str = "model_input") -> Callable[[], NeuralBackend]:
    return lambda: NeuralBackend(settings, text)
