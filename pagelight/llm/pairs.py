"""Broken prompt and response pairs.

Method: a naive Bayes model over hashed character n-grams gives the posteriors
of the response language, of the prompts' languages and of one that neither
side has; those of prompt and response are compared. The likelihood of a text's
last characters as an end of text, against that inside a text, says for prompt
and response whether each is complete; a response that isn't, to a prompt that
is, is truncated. Everything is fitted here on the pairs themselves, all of
them, in two passes: in the second each text counts for the class that the
first model gives it, so that copies and answers in another language don't blur
the classes.

Texts are handled a batch at a time, as one array of characters; sentences are
cut only where counting end marks leaves doubt.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.functions.chars import WS_CHARS
from pagelight.llm.sentences import _BLANK, GOES_ON, MAY_END, sentences
from pagelight.session import spread

BUCKETS = 1 << 16
SIZES, TAIL = 4, 4
#: Share of an n-gram's probability that is the same for all n-grams: n-grams unseen on both sides favour neither, however large each side is.
FLAT = 0.05
#: Weight of an ending's shorter form; log odds from which a prompt is complete, and below which a text's language is in doubt.
BACK_OFF, SURE, DOUBT = 4.0, 2.0, 3.0
#: Share of the texts' ends from which a last character is usual; weight of a last character's share for all prompts, beside that for prompts of one last character.
USUAL, PRIOR = 0.01, 50.0
#: Texts of one array.
TEXTS = 256

_END = "\U0010ffff"
_ENDED = re.compile(r"[.!?…。！？｡।॥؟۔][\s\"'”’“‘»›」』）)\]}】》]*$")
_LABEL = re.compile(r"^\s*(?:[^\s\w]{1,3}\w+[^\s\w]{1,3}|[^\W\d_]+(?:\s+[^\W\d_]+){0,3}\s*[:：])\s*")
_MARKS = ".!?…。！？｡।॥؟۔᙮።၊။។\n"
_UPPER = "".join(c for c in map(chr, range(0x1F00)) if c.isupper())
_LOWER = "".join(c for c in map(chr, range(0x1F00)) if c.islower())
# Where a sentence may end: no mark that a word, or behind a gap one of lower case, goes on behind.
_ANY_MARK = re.compile(rf"[.!?…]+[\"'”’»)\]]*(?![^\W_]|[.!?…\"'”’»)\]]|\s+[{_LOWER}])|[.!?]+(?=[^\W\d_{_LOWER}])|[。！？｡।॥؟۔᙮።၊။။]+|\n\s*\n|\u2029")
# What each of them begins with.
_FIRST_MARK = re.compile("[.!?…。！？｡।॥؟۔᙮។၊။\n\u2029]")
_LAST = WS_CHARS + _MARKS + "\"'”’“‘»›」』）)]}】》"
# Scripts whose sentences end at a space.
_BARE = re.compile("[\u0e00-\u0eff\u1780-\u17ff\u1000-\u109f]\\s+")
# Quoted speech, or a mark at which a sentence ends for sure unless the word is an abbreviation.
_SURE = re.compile(rf"“[^”]*”(?P<speech>(?<=[.!?…]”)(?=\s+[“(]*[{_UPPER}]))?|\"[^\"]*\"|«[^»]*»|\([^()]*\)|(?<![^\W\d_])(?P<word>[^\W\d_]{{2,}}+)[.!?…](?=\s+[“(]*[{_UPPER}])")

# Words by which an assistant excuses itself (sorry, refuse, policy).
_EXCUSE = re.compile(
    r"\b(?:sorry|apologi[sz]e|regret|unfortunately|unable|cannot|can't|can’t|won't|won’t|not able|not allowed|refuse|decline|as an? (?:ai|language model|assistant)"
    r"|xin lỗi|rất tiếc|đáng tiếc|không thể|không được phép|từ chối|là một (?:trợ lý|mô hình)|vi phạm|thông cảm|nằm ngoài khả năng|không dịch được"
    r"|désolée?|je ne peux pas|leider|tut mir leid|kann (?:ich )?nicht|lo siento|no puedo)\b",
    re.I,
)
# One of these, case-folded, is in each of them: they are looked for first.
_STEMS = (
    "sorry", "apologi", "regret", "unfortunately", "unable", "cannot", "can't", "can’t", "won't", "won’t", "not able", "not allowed", "refuse", "decline", "as a",
    "xin lỗi", "rất tiếc", "đáng tiếc", "không thể", "không được phép", "từ chối", "là một ", "vi phạm", "thông cảm", "nằm ngoài khả năng", "không dịch được",
    "désolé", "je ne peux pas", "leider", "tut mir leid", "kann ", "lo siento", "no puedo",
)
# What such an excuse is about: the task and not a thing of the text.
_TASK = re.compile(
    r"\b(?:translat\w*|request\w*|assist with (?:this|that)|help (?:you )?with (?:this|that)|process\w*|content|passage|policy|policies|language model|an? ai|this text|provide (?:a|another|the))\b"
    r"|\b(?:dịch|bản dịch|yêu cầu|nội dung|đoạn văn|văn bản|chính sách|trợ lý|mô hình|hỗ trợ|thực hiện)\b"
    r"|\b(?:tradui\w*|requête|demande|übersetz\w*|anfrage|traduc\w*|solicitud)\b",
    re.I,
)


WORD, ALNUM, DENSE, MARK, DIGIT, CLOSE, BLANK = 1, 2, 4, 8, 16, 32, 64
_kinds = np.full(0x110000, 255, np.uint8)


def _kind(c: str) -> int:
    """WORD: letters and the marks that combine with them; CLOSE: white space, closing quotes and brackets, and what is not seen."""
    category = unicodedata.category(c)
    letter = c.isalpha() or category[0] == "M"
    closing = category in ("Pe", "Pf", "Pi", "Cf") or c in "\"'" or c.isspace()
    dense = "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff"
    return WORD * letter | ALNUM * c.isalnum() | DENSE * dense | MARK * (c in _MARKS or c == _END) | DIGIT * c.isdigit() | CLOSE * closing | BLANK * (c in WS_CHARS)


def kinds_of(codes: np.ndarray) -> np.ndarray:
    found = _kinds[codes]
    if (found == 255).any():
        for code in np.unique(codes[found == 255]):
            _kinds[code] = _kind(chr(code))
        found = _kinds[codes]
    return found


@dataclass
class Texts:
    """Many texts as one array of case-folded characters, _END behind each."""

    codes: np.ndarray
    kinds: np.ndarray
    ends: np.ndarray
    #: Which n-grams there are, the segment (a stretch between end marks) of each, and the segments' texts and letters.
    grams: np.ndarray = field(default=None)
    segment: np.ndarray = field(default=None)
    owner: np.ndarray = field(default=None)
    letters: np.ndarray = field(default=None)
    _flattened: tuple[np.ndarray, np.ndarray] | None = None
    _tails: np.ndarray | None = None

    @classmethod
    def of(cls, texts: Sequence[str]) -> Texts:
        joined = _END.join(x.replace(_END, " ") if _END in x else x for x in texts) + _END
        codes = np.frombuffer(joined.casefold().encode("utf-32-le"), np.uint32)
        out = cls(codes, kinds_of(codes), np.flatnonzero(codes == ord(_END)))
        out._cut()
        return out

    def _cut(self) -> None:
        codes, kinds = self.codes, self.kinds
        # Codes and addresses are in no language: ASCII runs with a digit, and long ones.
        ascii_ = (codes >= 33) & (codes <= 126)
        run = np.cumsum(ascii_ & ~np.append(False, ascii_[:-1])) * ascii_
        bad = (np.bincount(run, weights=kinds & DIGIT) > 0) | (np.bincount(run) >= 30)
        bad[0] = False
        word = (kinds & WORD > 0) & ~bad[run]
        symbol = np.where(word, codes, 32).astype(np.uint64)
        keep = word | np.append(True, word[:-1])
        # A run of other characters is one space; it parts segments if an end mark or a text's end is in it.
        part = np.cumsum(keep)
        mark = np.bincount(part, weights=(kinds & MARK > 0) & ~word, minlength=part[-1] + 1)[1:] > 0
        stream = symbol[keep]
        wide = np.concatenate([[32], stream]).astype(np.uint64)
        stop = np.concatenate([[True], mark & (stream == 32)])
        number = np.cumsum(stop)
        # Of an n-gram's first character; a stop is of the segment behind it.
        of = number.copy()
        of[:-1] += stop[:-1] & stop[1:]
        grams, segment = [], []
        value = np.zeros(len(wide), np.uint64)
        for n in range(1, SIZES + 1):
            if len(wide) < n:
                break
            value = value[: len(wide) - n + 1] * np.uint64(0x9E3779B97F4A7C15)
            value += wide[n - 1 :]
            value += np.uint64(n)
            # No n-gram goes over a stop.
            good = np.flatnonzero(number[n - 2 : len(wide) - 1] == of[: len(value)] if n > 1 else wide != 32)
            found = value[good]
            found ^= found >> np.uint64(29)
            found *= np.uint64(0xBF58476D1CE4E5B9)
            found >>= np.uint64(48)
            grams.append(found.view(np.int64))
            segment.append((of if n > 1 else number)[good])
        self.grams, self.segment = np.concatenate(grams), np.concatenate(segment)
        # The text of a segment is that of its first character.
        place = np.flatnonzero(keep)
        owner = np.searchsorted(self.ends, place[np.minimum(np.flatnonzero(stop), len(place) - 1)])
        self.owner = np.append(-1, owner)
        weight = word + 2.0 * (word & (kinds & DENSE > 0))
        self.letters = np.bincount(number[1:], weights=weight[keep], minlength=len(self.owner))

    def tails(self) -> np.ndarray:
        """(texts, TAIL) hashed n-grams of sizes 1 to TAIL that end at each text's end; -1 for blank texts and beyond the begin."""
        if self._tails is None:
            codes, last = self._flat()
            self._tails = np.full((len(last), TAIL), -1, np.int64)
            good, value = np.ones(len(last), bool), np.zeros(len(last), np.uint64)
            for n in range(TAIL):
                place = last - n
                code = codes[np.maximum(place, 0)]
                good &= (place >= 0) & (code != ord(_END))
                value = _tail_value(value, code, n + 1)
                self._tails[good, n] = _tail_bucket(value[good])
        return self._tails

    def inside(self) -> list[np.ndarray]:
        """Of each size from 1 to TAIL the counts of hashed n-grams that end at any place of a text but its end."""
        codes = self._flat()[0]
        end = codes == ord(_END)
        out = []
        bad, value = np.zeros(len(codes), bool), np.zeros(len(codes), np.uint64)
        for n in range(min(TAIL, len(codes))):
            # From the last character back, so that a longer n-gram adds to the shorter one.
            size = len(codes) - n
            bad = bad[len(bad) - size :] | end[:size]
            value = _tail_value(value[len(value) - size :], codes[:size], n + 1)
            found = _tail_bucket(value)
            found[bad] = BUCKETS
            ends = self.tails()[:, n]
            out.append(np.bincount(found, minlength=BUCKETS + 1)[:BUCKETS] - np.bincount(ends[ends >= 0], minlength=BUCKETS))
        return out

    def _flat(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters, each run of white space a space, without a text's last CLOSE ones; the last place of each text."""
        if self._flattened is None:
            codes = self.codes
            end = codes == ord(_END)
            blank = self.kinds & BLANK > 0
            solid = (self.kinds & CLOSE == 0) | end
            # Nothing but CLOSE up to the text's end: the next solid one is that end.
            last = end[solid][np.cumsum(solid) - solid]
            last[self.ends] = False
            keep = ~last & ~(blank & np.append(blank[1:], True))
            codes = np.where(blank, 32, codes)[keep]
            self._flattened = codes, np.flatnonzero(codes == ord(_END)) - 1
        return self._flattened

    def plain(self) -> list[str]:
        """Letters and digits only, of each text."""
        good = self.kinds & ALNUM > 0
        text = self.codes[good].tobytes().decode("utf-32-le")
        upto = np.cumsum(good)[self.ends].tolist()
        return [text[a:b] for a, b in zip([0, *upto], upto)]


def _tail_value(value: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """An n-gram's value from that of its last n - 1 characters and the one before them."""
    return value * np.uint64(0x9E3779B97F4A7C15) + code + np.uint64(n)


def _tail_bucket(value: np.ndarray) -> np.ndarray:
    return ((value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).view(np.int64)


@dataclass(frozen=True)
class PairModel:
    """logs: log P(n-gram | response language) and (| a prompt language); for prompts and
    responses the counts of endings at a text's end and inside, by size and hash; counts of the
    last characters of prompts, of responses and of both together."""

    logs: np.ndarray
    ends: np.ndarray
    last: np.ndarray

    def posteriors(self, texts: Texts, of: np.ndarray, size: int) -> np.ndarray:
        """The log likelihoods of the response language, a prompt language and an unknown one; `of` says to which of `size` sums each n-gram adds."""
        known = [np.bincount(of, weights=log[texts.grams], minlength=size) for log in self.logs]
        return np.array([*known, -np.log(BUCKETS) * np.bincount(of, minlength=size)])

    def odds(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Of each segment the log odds of the response language against the better of a prompt
        language and an unknown one; and the same of each whole text."""
        three = self.posteriors(texts, texts.segment, len(texts.owner))
        many = len(texts.ends)
        total = [np.bincount(texts.owner[1:], weights=x[1:], minlength=many)[:many] for x in three]
        return three[0] - np.maximum(three[1], three[2]), total[0] - np.maximum(total[1], total[2])

    def foreign(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: are more of its letters in segments of another language than of the response language; its whole log odds."""
        here, whole = self.odds(texts)
        many = len(texts.ends)
        away = np.bincount(texts.owner[1:], weights=(texts.letters * np.where(here < 0, 1, -1))[1:], minlength=many)[:many]
        return away > 0, whole

    def complete(self, texts: Texts, side: int) -> np.ndarray:
        """Log odds that each text's last characters end a text: those of the last one alone and those of
        longer endings, as far as they are known, whichever are less."""
        tails = texts.tails()
        end, inside = self.ends[side]
        scale = end[0].sum() / max(1.0, inside[0].sum())
        share = first = np.full(len(tails), 0.5)
        for n in range(TAIL):
            at = np.maximum(tails[:, n], 0)
            e, i = end[n][at], inside[n][at] * scale
            share = np.where(tails[:, n] >= 0, (e + BACK_OFF * share) / (e + i + BACK_OFF), share)
            first = share if n == 0 else first
        share = np.minimum(share, first)
        return np.log(share / (1 - share))

    def cut(self, prompts: Texts, responses: Texts) -> np.ndarray:
        """Is each response cut, but its prompt complete?

        The likelihood of a last character at an end is that for prompts of the same last character.
        Cut texts may be dressed with a mark that is rare inside as well: a character that is rarely
        the last one, of responses and of prompts, ends nothing.
        """
        asked, given = (np.maximum(x.tails()[:, 0], 0) for x in (prompts, responses))
        asked_n, given_n, both = self.last
        share = given_n[given] / max(1.0, given_n.sum())
        among = (both[_both(asked, given)] + PRIOR * share) / (asked_n[asked] + PRIOR)
        odds = self.complete(responses, 1) + np.log(np.maximum(among, 1e-9) / np.maximum(share, 1e-9))
        rare = np.maximum(share, asked_n[given] / max(1.0, asked_n.sum())) < USUAL
        return (self.complete(prompts, 0) > SURE) & ((odds < 0) | rare)


def _both(asked: np.ndarray, given: np.ndarray) -> np.ndarray:
    return (asked * 40_503 + given) % BUCKETS


_COUNTED = "kind string, bucket int, n long"


def _rows(counts: dict[str, np.ndarray]) -> pd.DataFrame:
    some = [(kind, np.flatnonzero(n), n) for kind, n in counts.items()]
    return pd.concat([pd.DataFrame({"kind": kind, "bucket": at.astype(np.int32), "n": n[at].astype(np.int64)}) for kind, at, n in some])


def _count(parts, model: PairModel | None = None):
    """Counts of a fit: (kind, bucket, n). Without a model a text counts for its side; with one for
    the class that it has, and only complete prompts and the responses to them tell how a text ends."""
    total: dict[str, np.ndarray] = {}

    def add(kind: str, counts: np.ndarray) -> None:
        if kind in total:
            total[kind] += counts
        else:
            total[kind] = counts

    def of(found: np.ndarray) -> np.ndarray:
        return np.bincount(found, minlength=BUCKETS)

    for part in parts:
        part = part[part["prompt"].notna() & part["response"].notna()]
        for low in range(0, len(part), TEXTS):
            sides = [Texts.of(part[c].iloc[low : low + TEXTS].tolist()) for c in ("prompt", "response")]
            whole = None
            if model is not None:
                whole = model.complete(sides[0], 0) > SURE
            asked, given = (x.tails()[:, 0] for x in sides)
            known = (asked >= 0) & (given >= 0) & (True if whole is None else whole)
            for kind, found in (("last0", asked), ("last1", given), ("both", _both(asked, given))):
                add(kind, of(found[known]))
            for side, texts in enumerate(sides):
                if model is None:
                    add(("prompt", "response")[side], of(texts.grams))
                else:
                    # Class by the whole text: what is of an unknown language counts for neither.
                    owner = texts.owner[texts.segment]
                    best = model.posteriors(texts, owner, len(texts.ends)).argmax(axis=0)
                    if side == 0:
                        best = np.where(best == 2, 1, best)
                    each = np.bincount(texts.grams + (BUCKETS * best)[owner], minlength=3 * BUCKETS)
                    add("response", each[:BUCKETS])
                    add("prompt", each[BUCKETS : 2 * BUCKETS])
                ends = texts.tails() if whole is None else texts.tails()[whole]
                for n, inside in enumerate(texts.inside()):
                    add(f"end{side}{n}", of(ends[ends[:, n] >= 0, n]))
                    add(f"inside{side}{n}", inside)
    if total:
        yield _rows(total)


def fit(df: DataFrame, key: str, prompt: str, response: str) -> PairModel:
    """Fits the models on all rows, whole texts of them; `key` isn't read.

    What comes to the driver is at most one count per kind and bucket:
    21 x 65,536 numbers, twice.
    """
    some = spread(df.select(F.col(prompt).alias("prompt"), F.col(response).alias("response")))
    context = df.sparkSession.sparkContext
    model = None
    for _ in range(2):
        known = context.broadcast(model)
        counted = some.mapInPandas(lambda parts, known=known: _count(parts, known.value), _COUNTED).groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
        by: dict[str, np.ndarray] = {}
        for kind, part in counted.groupby("kind"):
            by[kind] = np.zeros(BUCKETS)
            by[kind][part["bucket"].to_numpy()] = part["n"].to_numpy()
        model = _model(by)
    return model


def _model(by: dict[str, np.ndarray]) -> PairModel:
    none = np.zeros(BUCKETS)

    def logs(counts):
        return np.log((1 - FLAT) * counts / max(1.0, counts.sum()) + FLAT / BUCKETS)

    ends = np.array([[[by.get(f"{kind}{side}{n}", none) for n in range(TAIL)] for kind in ("end", "inside")] for side in (0, 1)])
    return PairModel(np.array([logs(by.get(k, none)) for k in ("response", "prompt")]).astype(np.float32), ends.astype(np.float32), np.array([by.get(k, none) for k in ("last0", "last1", "both")]))


def to_translate(text: str) -> bool:
    """Is there more in it than numbers, codes and names?"""
    for word in re.findall(r"[^\s]+", text):
        bare = word.strip(".,;:!?…\"'“”‘’()[]«»„-–—/%")
        letters = re.sub(r"[\W\d_]", "", bare)
        if not letters:
            continue
        if any(c.isalpha() and not c.isupper() and not c.islower() for c in bare):
            return True  # a script without case writes no codes
        if any(c.isdigit() for c in bare) or (re.search(r"[._@/:]", bare) and bare.isascii()):
            continue
        if bare.isascii() and bare.isupper() and len(text.split()) < 3:
            continue
        if bare[0].isupper() and not bare[1:].isupper():
            continue
        return True
    words = [w for w in text.split() if w[:1].isalpha()]
    return len(words) > 3 or bool(_ENDED.search(text) and len(words) > 2)


def _copied(prompt: str, response: str, a: str, b: str) -> bool:
    """a, b: letters and digits of the two."""
    if not a or a not in b or not to_translate(prompt):
        return False
    if a == b:
        return True
    at = b.index(a)
    tail = b[at:]
    whole = tail == (a * (len(tail) // len(a) + 1))[: len(tail)] and len(tail) % len(a) == 0
    if at:
        label = _LABEL.match(response)
        within = "".join(c for c in response[: label.end()].casefold() if c.isalnum()) if label else ""
        if label and at % (len(a) + len(within)) == len(within) % (len(a) + len(within)):
            return whole or b.replace(a, "").replace(within, "") == ""
        # Words before it that are no label: the source is the greater part all the same.
        return whole and len(a) > at
    return whole or b.replace(a, "") == ""


def _excuses(text: str) -> bool:
    low = text.casefold()
    # The pattern takes these two for an i, case folding doesn't.
    return ("İ" in text or "ı" in text or any(stem in low for stem in _STEMS)) and _EXCUSE.search(text) is not None


def _refused(prompt: str, response: str) -> bool:
    """It excuses itself, of the task, in place of a translation."""
    flat = " ".join(response.split())
    if not _excuses(flat):
        return False
    said = _excuses(prompt)
    # A source that says so itself: only an excuse of the task is none of its own.
    if said and (_TASK.search(prompt) or not _TASK.search(flat)):
        return False
    units = [" ".join(response[a:b].split()) for a, b in sentences(response)]
    excuses = [u for u in units if _excuses(u)]
    if not excuses:
        return False
    about_task = [u for u in excuses if _TASK.search(u)]
    if about_task:
        rest = sum(len(u) for u in units if u not in excuses and not _TASK.search(u))
        return rest <= 0.5 * sum(map(len, units))
    return not said and len(units) <= 3 and units[0] in excuses and len(excuses) * 2 >= len(units)


def _omits(prompt: str, response: str) -> bool:
    """Does the response hold at most half as many sentences as the prompt?

    The end marks bound the prompt's sentences from above and the response's
    from below; only where that leaves doubt both are cut into sentences.
    """
    # What ends the text parts nothing.
    body = prompt.rstrip(_LAST)
    most, begin = 1, 0
    while first := _FIRST_MARK.search(body, begin):
        at = first.start()
        m = _ANY_MARK.match(body, at)
        begin = m.end() if m else at + 1
        if not m:
            continue
        low = at
        while low > max(0, at - 12) and body[low - 1].isalnum():
            low -= 1
        if low < at and m[0] == ".":
            # "Dr.", "J."; behind "p.m." a sentence may end.
            word = body[low:at]
            alone = len(word) == 1 and word.isalpha() and body[at - 2 : at - 1] != "."
            most += not alone and word.casefold() not in GOES_ON
        else:
            most += 1
    if not prompt.isascii():
        most += len(_BARE.findall(body))
    if most < 2:
        return False
    least = 0
    for block in _BLANK.split(response):
        if block.strip():
            least += 1
            for m in _SURE.finditer(block):
                word = m["word"]
                least += word.casefold() not in GOES_ON and word.casefold() not in MAY_END if word else m["speech"] is not None
            if 2 * least > most:
                return False
    asked = len(sentences(prompt))
    return asked > 1 and 2 * len(sentences(response)) <= asked


def defects(model: PairModel, prompts: Sequence[str | None], responses: Sequence[str | None]) -> list[str | None]:
    """Of each pair the first defect that applies; None for a usable pair or a blank prompt."""
    out: list[str | None] = [None] * len(prompts)
    rest = []
    for i, (a, b) in enumerate(zip(prompts, responses)):
        if a is None or not a.strip():
            continue
        if b is None or not any(map(str.isalnum, b)):
            out[i] = "empty"
        else:
            rest.append(i)
    if not rest:
        return out
    asked, given = Texts.of([prompts[i] for i in rest]), Texts.of([responses[i] for i in rest])
    away, given_odds = model.foreign(given)
    asked_odds = model.foreign(asked)[1]
    # Where a response's language is in doubt it is foreign only if the prompt is as likely in the response language.
    away &= (np.abs(given_odds) >= DOUBT) | (given_odds <= asked_odds)
    cut = model.cut(asked, given)
    for i, a, b, foreign, stopped in zip(rest, asked.plain(), given.plain(), away.tolist(), cut.tolist()):
        prompt, response = prompts[i], responses[i]
        if _refused(prompt, response):
            out[i] = "refusal"
        elif a in b and _copied(prompt, response, a, b):
            out[i] = "copied"
        elif foreign and to_translate(prompt):
            out[i] = "wrong_language"
        elif (stopped or _omits(prompt, response)) and to_translate(prompt):
            out[i] = "truncated"
    return out


def defect(model: PairModel, prompt: str | None, response: str | None) -> str | None:
    return defects(model, [prompt], [response])[0]


def find_defects(df: DataFrame, key: str, prompt: str, response: str, model: PairModel | None = None) -> DataFrame:
    """(key, defect) of each defective pair.

    Null and blank prompts give no row; a null response is `empty`. Repeated
    rows give repeated results. Only the three named columns are read; texts
    are judged whole.
    """
    known = df.sparkSession.sparkContext.broadcast(model or fit(df, key, prompt, response))
    kind = df.schema[key].dataType.simpleString()

    def run(parts):
        for part in parts:
            prompts, responses = part.iloc[:, 1].tolist(), part.iloc[:, 2].tolist()
            found = []
            for low in range(0, len(part), TEXTS):
                found += defects(known.value, prompts[low : low + TEXTS], responses[low : low + TEXTS])
            out = pd.DataFrame({key: part.iloc[:, 0], "defect": found})
            yield out[out["defect"].notna()]

    return spread(df.select(key, prompt, response).where(F.col(prompt).isNotNull())).mapInPandas(run, f"`{key}` {kind}, defect string")
