"""Settings of the operators; each is frozen and checked when it is made.

The names' defaults are fixed values that the results depend on.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field


def _check(good: bool, message: str) -> None:
    if not good:
        raise ValueError(message)


def _threads() -> int:
    return max(1, min(8, os.cpu_count() or 4))


@dataclass(frozen=True)
class TranslationSettings:
    """Dictionary translation: tokens, phrases and limits."""

    case_sensitive: bool = False
    unicode_normalization: str = "NFKC"
    normalize_apostrophes: bool = True
    normalize_hyphens: bool = True
    include_numbers: bool = True
    include_single_character_words: bool = True
    max_phrase_tokens: int = 5
    longest_match_first: bool = True
    max_input_characters: int = 10_000
    max_token_characters: int = 128
    lemmatize_words: bool = True
    lemmatizer_language: str = "en"

    def __post_init__(self) -> None:
        _check(self.unicode_normalization in ("NFC", "NFKC"), "unicode_normalization must be NFC or NFKC")
        for name in ("max_phrase_tokens", "max_input_characters", "max_token_characters"):
            _check(getattr(self, name) >= 1, f"{name} must be at least 1")


@dataclass(frozen=True)
class CorrectionSettings:
    """Spelling correction of recognised text and its frequency dictionary."""

    dictionary_path: str | None = None
    term_index: int = 0
    count_index: int = 1
    separator: str = " "
    encoding: str = "utf-8"
    count_threshold: int = 1
    max_dictionary_edit_distance: int = 2
    prefix_length: int = 7
    max_lookup_edit_distance: int = 2
    max_suggestions: int = 5
    #: Tokens without any candidate are suggested as they are, behind the greatest distance.
    include_unknown: bool = False
    transfer_casing: bool = True
    min_candidate_frequency: int = 1
    min_token_length: int = 2
    max_token_length: int = 64

    def __post_init__(self) -> None:
        _check(self.term_index >= 0 and self.count_index >= 0, "column indexes must not be negative")
        _check(self.term_index != self.count_index, "term_index and count_index must differ")
        _check(bool(self.separator), "separator must not be empty")
        _check(bool(self.encoding.strip()), "encoding must not be blank")
        _check(self.count_threshold >= 0, "count_threshold must not be negative")
        _check(self.max_dictionary_edit_distance >= 0 and self.max_lookup_edit_distance >= 0, "distances must not be negative")
        _check(self.prefix_length >= 1 and self.prefix_length > self.max_dictionary_edit_distance, "prefix_length must exceed the dictionary's distance")
        _check(self.max_lookup_edit_distance <= self.max_dictionary_edit_distance, "lookup distance exceeds the dictionary's")
        for name in ("max_suggestions", "min_candidate_frequency", "min_token_length"):
            _check(getattr(self, name) >= 1, f"{name} must be at least 1")
        _check(self.max_token_length >= self.min_token_length, "max_token_length is below min_token_length")


# The kinds of region that models report.
RAW_LABELS = (
    "paragraph_title", "image", "text", "number", "abstract", "content", "figure_title", "formula", "table", "table_title", "reference", "doc_title",
    "footnote", "header", "algorithm", "footer", "seal", "chart_title", "chart", "formula_number", "header_image", "footer_image", "aside_text",
)
# The kinds of region reported to users.
LABELS = ("title", "paragraph", "caption", "table", "image", "chart", "formula", "header", "footer", "page_number", "other")
# Which raw kinds make up each kind.
LABEL_MAP = {
    "doc_title": "title", "paragraph_title": "title",
    "text": "paragraph", "abstract": "paragraph", "content": "paragraph", "reference": "paragraph", "footnote": "paragraph", "algorithm": "paragraph", "aside_text": "paragraph",
    "figure_title": "caption", "table_title": "caption", "chart_title": "caption",
    "table": "table", "image": "image", "chart": "chart",
    "formula": "formula", "formula_number": "formula",
    "header": "header", "header_image": "header", "footer": "footer", "footer_image": "footer",
    "number": "page_number", "seal": "other",
}


@dataclass(frozen=True)
class LayoutSettings:
    """Layout detection and what is done with its boxes."""

    model_size: str = "M"
    device: str = "auto"
    engine: str = "paddle_static"
    enable_mkldnn: bool = False
    cpu_threads: int = field(default_factory=_threads)
    confidence_threshold: float = 0.35
    layout_nms: bool = True
    batch_size: int = 1
    label_mapping: dict[str, str] = field(default_factory=lambda: dict(LABEL_MAP))
    keep_other_regions: bool = False
    clip_boxes_to_image: bool = True
    sort_regions_by_position: bool = True
    min_image_width: int = 16
    min_image_height: int = 16
    max_image_pixels: int = 20_000_000

    def __post_init__(self) -> None:
        _check(self.model_size in ("S", "M"), "model_size must be S or M")
        _check(self.device in ("auto", "cpu", "gpu"), "device must be auto, cpu or gpu")
        _check(self.engine == "paddle_static", "unknown engine")
        _check(0 <= self.confidence_threshold <= 1, "confidence_threshold must lie in [0, 1]")
        for name in ("cpu_threads", "batch_size", "min_image_width", "min_image_height", "max_image_pixels"):
            _check(getattr(self, name) >= 1, f"{name} must be at least 1")
        _check(set(self.label_mapping.values()) <= set(LABELS), "label_mapping names unknown labels")

    @property
    def model_name(self) -> str:
        return f"PP-DocLayout-{self.model_size}"


@dataclass(frozen=True)
class RecognitionSettings:
    """Text recognition; the defaults are those of the fast pipeline."""

    detection_model: str = "PP-OCRv5_mobile_det"
    recognition_model: str = "en_PP-OCRv5_mobile_rec"
    device: str = "auto"
    engine: str = "paddle_static"
    enable_mkldnn: bool = False
    cpu_threads: int = field(default_factory=_threads)
    side_limit: int = 640
    limit_type: str = "max"
    detection_threshold: float = 0.30
    box_threshold: float = 0.60
    unclip_ratio: float = 1.50
    recognition_batch_size: int = 1
    recognition_score_threshold: float = 0.05
    min_image_width: int = 16
    min_image_height: int = 16
    max_image_pixels: int = 20_000_000
    gpu_numbers: bool = False

    def __post_init__(self) -> None:
        _check(bool(self.detection_model.strip()) and bool(self.recognition_model.strip()), "model names must not be blank")
        numbered = self.gpu_numbers and re.fullmatch(r"gpu:\d+", self.device)
        _check(self.device in ("auto", "cpu", "gpu") or bool(numbered), "unknown device")
        _check(self.side_limit >= 32, "side_limit must be at least 32")
        _check(self.limit_type in ("max", "min"), "limit_type must be max or min")
        for name in ("detection_threshold", "box_threshold", "recognition_score_threshold"):
            _check(0 <= getattr(self, name) <= 1, f"{name} must lie in [0, 1]")
        _check(self.unclip_ratio > 0, "unclip_ratio must be positive")
        for name in ("cpu_threads", "recognition_batch_size", "min_image_width", "min_image_height"):
            _check(getattr(self, name) >= 1, f"{name} must be at least 1")
        _check(self.max_image_pixels >= self.min_image_width * self.min_image_height, "max_image_pixels is too small")

    @classmethod
    def quality(cls, **changes) -> RecognitionSettings:
        """The settings of the slower, more exact pipeline."""
        return cls(
            **{
                "detection_model": "PP-OCRv6_medium_det", "recognition_model": "PP-OCRv6_medium_rec", "side_limit": 1280, "detection_threshold": 0.25,
                "box_threshold": 0.50, "recognition_batch_size": 4, "max_image_pixels": 40_000_000, "gpu_numbers": True,
            } | changes
        )


@dataclass(frozen=True)
class NeuralSettings:
    """Neural translation: preparation, limits and generation."""

    model_name: str = "Helsinki-NLP/opus-mt-en-vi"
    target_language_token: str = ">>vie<<"
    device: str = "auto"
    use_fp16: bool = True
    max_input_tokens: int = 256
    max_input_characters: int = 5_000
    normalize_whitespace: bool = True
    max_new_tokens: int = 256
    num_beams: int = 2
    length_penalty: float = 1.0
    early_stopping: bool = True
    local_files_only: bool = False
    #: Texts that the model is given at once.
    batch_texts: int = 16

    def __post_init__(self) -> None:
        _check(bool(self.model_name.strip()), "model_name must not be blank")
        _check(self.device in ("auto", "cpu", "gpu"), "device must be auto, cpu or gpu")
        _check(1 <= self.max_input_tokens <= 512, "max_input_tokens must lie in 1..512")
        for name in ("max_input_characters", "max_new_tokens", "num_beams", "batch_texts"):
            _check(getattr(self, name) >= 1, f"{name} must be at least 1")
        _check(self.length_penalty > 0, "length_penalty must be positive")
