"""Sentence boundaries across languages and scripts.

Method: a semi-Markov model. Every end mark (and, in scripts without them,
every space) is a candidate; dynamic programming then chooses whole spans
between candidates. A span's score is the sum of its closing word, mark and the
opening word of what follows (one joint log odds, see _odds), its length, and
its quotations: a span that begins or ends within a quotation or bracket is
unbalanced. Cutting there costs more than any mark is worth, so speech quoted
inside a sentence stays in it, however many sentences it has.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.session import spread

# Abbreviations after which a sentence goes on.
GOES_ON = frozenset(
    "mr mrs ms messrs dr prof rev hon gen col capt lt sgt mt mme mlle mgr me sr sra srta d dª hr fr frl dipl ing no nos nr núm num fig figs abb tab pp p pag pág vol vols ch chap sec art eq approx aprox env ca ungef z.b d.h u.a i.e e.g z.t s cf vgl viz vs v al bzw ggf ej p.ej esp est feat ed eds dept tel máx mín av bd blvd ave".split()
)
# Abbreviations that may also end a sentence.
MAY_END = frozenset("etc a.m p.m am pm inc ltd co corp usw jr u.s u.k u.n b.c a.d e.v sq ft in oz lb min std uhr s.a ee.uu".split())
# Months after a German or Nordic ordinal ("25. Mai").
MONTHS = frozenset("januar jänner februar feber märz april mai juni juli august september oktober november dezember maj marts januari februari oktober jan feb mrz apr jun jul aug sep sept okt nov dez".split())

# Scripts whose sentences end at a space: Thai, Lao, Khmer, Myanmar.
_BARE = "฀-๏๚-๿ກ-໏ក-៙က-ဿ"
_OPEN = "\"'“‘„‚«‹「『（(\\[{【《〈¿¡"
_CLOSE = "\"'”’»›」』）)\\]}】》〉"
# A German closing quote is an English opening one: it closes unless a word follows.
_MARK = re.compile(rf"(?P<mark>[.!?…]+|[。！？｡।॥؟۔᙮።၊။។]+)(?P<close>(?:[{_CLOSE}]|[“‘](?!\w)|[   ][»›])*)")
_BARE_SPACE = re.compile(rf"(?<=[{_BARE}])[^\S\n]*\s\s*(?=[{_BARE}{_OPEN}A-Za-z])")
_BLANK = re.compile(r"\n[^\S\n]*(?:\n\s*)+| \s*")
# Combining marks are no \w, so a word here is whatever is neither space nor punctuation.
_LEFT = re.compile(r"[^\W_][^\s!?…,;:()\[\]{}\"“”„«»।]*$")
_MIXED = re.compile(r"[^\W\d_]*[a-z][A-Z]")
_QUOTES = re.compile("[\"“”„‚«»‹›‘’'「」『』（）()\\[\\]{}【】《》]")
_WORD = re.compile(r"[^\W_]+")
_NUMBERED = re.compile(r"\d{1,3}[.)]\s+[^\W\d_a-z]")
_SPEECH = re.compile("[说問问道喊答叫]")

#: Cost of an end within a quotation (half of it to the span on either side; more than the odds of any mark and MOST together), and of a span without letters.
UNBALANCED, EMPTY = 6.0, 9.0
#: Usual length of a sentence; cost of other lengths, by the square of their logarithm; the most that a length can cost.
USUAL, LENGTH, MOST = 60, 0.08, 1.5
#: From this length on a span costs MOST.
FLAT = math.ceil(USUAL * math.exp(math.sqrt(MOST / LENGTH)))


def _quote_marks(text: str) -> list[tuple[int, int, int]]:
    """(place, kind, +1 or -1) of each opening and closing mark; apostrophes left out."""
    out = []
    low_open = 0
    straight = 0
    opened = set()
    for m in _QUOTES.finditer(text):
        c, at = m[0], m.start()
        before = text[at - 1] if at else " "
        after = text[at + 1] if at + 1 < len(text) else " "
        if c in "’'‘":
            if before.isalnum() and after.isalnum():
                continue
            if c == "’" and before.isalpha() and 1 not in opened:
                continue
            if c == "'":
                opening = not before.isalnum() and before not in ".!?,…" and after.isalnum()
                if not opening and 6 not in opened:
                    continue
                out.append((at, 6, 1 if opening else -1))
            else:
                out.append((at, 1, 1 if c == "‘" else -1))
            if out[-1][2] > 0:
                opened.add(out[-1][1])
        elif c == '"':
            straight ^= 1
            out.append((at, 5, 1 if straight else -1))
        elif c in "„‚":
            low_open += 1
            out.append((at, 0, 1))
        elif c == "“":
            if low_open:
                low_open -= 1
                out.append((at, 0, -1))
            else:
                out.append((at, 0, 1))
        elif c == "”":
            low_open = max(0, low_open - 1)
            out.append((at, 0, -1))
        elif c in "«»‹›":
            out.append((at, 2, 1 if c in "«‹" else -1))
        elif c in "「」『』《》":
            out.append((at, 3, 1 if c in "「『《" else -1))
        else:
            out.append((at, 4, 1 if c in "（([{【" else -1))
    return out


def _right(text: str, at: int, end: int) -> tuple[bool, str, str]:
    """What follows a candidate: is there a gap, the kind of what comes, the first character."""
    place = at
    while place < end and text[place].isspace():
        place += 1
    gap = place > at
    first = text[place] if place < end else ""
    while place < end and (text[place] in _OPEN or text[place] in "-–—•*·" or text[place].isspace()):
        place += 1
    c = text[place] if place < end else ""
    if not c:
        kind = "other"
    elif c.isdigit():
        kind = "upper" if _NUMBERED.match(text, place) else "digit"
    elif c.isupper() or c.istitle():
        kind = "upper"
    elif c.islower():
        kind = "upper" if _MIXED.match(text, place) else "lower"
    elif c.isalpha():
        kind = "caseless"
    else:
        kind = "other"
    return gap, kind, first


def _odds(text: str, low: int, high: int, m: re.Match) -> float | None:
    """Log odds that a sentence ends at this mark; None where no sentence can end."""
    mark, close, end = m["mark"], m["close"], m.end()
    gap, kind, first = _right(text, end, high)
    if mark[0] in "。！？｡":
        if not close:
            return 4.0
        if gap or first in "「『“‘《":
            return 3.0
        if mark[-1] in "！？":
            stop = re.search("[。！？]", text[end:high])
            clause = text[end : end + (stop.start() if stop else 40)]
            return -4.0 if first == "と" or _SPEECH.search(clause) or not first.isalpha() else 1.0
        return -4.0 if first in "と，、,っ" else 3.0
    if mark[0] in "।॥؟۔᙮።၊။។":
        return 4.0 if kind != "lower" else -2.0
    if mark[0] == "…" or mark.startswith("..."):
        if kind in ("lower",):
            return -4.0
        if kind == "caseless":
            return 1.5 if gap else -3.0
        return 3.0 if gap and kind == "upper" else (-1.0 if kind == "digit" else 1.0 if gap else None)
    after = {"upper": 4.0, "caseless": 3.5, "digit": 3.0, "other": 1.0, "lower": -4.0}[kind]
    if not gap:
        if kind in ("upper", "caseless") and (close or first.isalnum() or first in _OPEN):
            before = text[m.start() - 1] if m.start() > low else " "
            if kind == "caseless":
                return 3.0 if before.isalpha() and (mark[0] in "!?" or not before.isascii()) else None
            # "yesterday.Our", but not "U.S", "node.JS" or "www.Site": a word of lower case, then a capitalised word.
            nxt = re.match(rf"[{_OPEN}]*(\d{{1,2}}\.\s+[A-ZÀ-Þ]|[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’]+|[A-ZÀ-Þ]\b(?:(?!\.)|\.\s*[A-ZÀ-Þ]))", text[end : end + 30])
            left = _LEFT.search(text, max(low, m.start() - 30), m.start())
            if nxt and (mark[0] in "!?" or (left and "." not in left[0] and left[0][-1:].islower() and len(left[0]) > 1 and left[0].casefold() not in GOES_ON) or (left and left[0].isdigit())):
                return 2.5
        return None
    if mark[0] in "!?" or len(mark) > 1:
        return after
    left = _LEFT.search(text, max(low, m.start() - 24), m.start())
    token = left[0] if left else ""
    joined = False
    if "." in token:
        # "week.Dr. Halven", "marks.6. Take": the sentence before has no space behind it.
        head, _, tail = token.rpartition(".")
        before = head.rpartition(".")[2]
        if len(before) > 2 and before[-1].islower() and (tail[:1].isupper() or tail.isdigit()):
            token, joined = tail, True
    if close and not token:
        return after
    word = token.casefold().rstrip(".")
    if not close:
        if token.isdigit():
            before = text[low : m.start() - len(token)].rstrip()
            if joined or not before or before[-1] in ".!?…。！？।॥؟" or before[-1] in _CLOSE or text[low : m.start() - len(token)].endswith("\n") and kind == "upper" and len(token) < 3:
                return -5.0
            nxt = _WORD.search(text, end, min(high, end + 24))
            if nxt and nxt[0].casefold() in MONTHS and len(token) < 3:
                return -4.0
            return {"upper": 2.5, "caseless": 2.5, "digit": 1.0, "other": 1.0, "lower": -3.0}[kind]
        if word in GOES_ON:
            # "M." and "p." are also single letters; either way the sentence goes on.
            return -4.0
        if word in MAY_END:
            return {"upper": 1.5, "caseless": 0.5, "digit": -1.0, "other": 0.5, "lower": -4.0}[kind]
        last = token.rsplit(".", 1)[-1].rsplit("-", 1)[-1]
        if len(last) == 1 and last.isalpha():
            return 1.0 if last == "m" and kind != "lower" and text[low : m.start()].endswith(("sq. m", "cu. m")) else -3.0
        if last and "ऀ" <= last[0] <= "ॿ" and len(last) <= 3:
            return -3.0
    return after


def _quoted(text: str, nodes: list[int]) -> list[bool]:
    """Does each node lie within a quotation or bracket? Marks without a partner hold nothing."""
    edges = []
    opened: dict[int, list[int]] = {}
    for at, kind, step in _quote_marks(text[nodes[0] : nodes[-1]]) if _QUOTES.search(text, nodes[0], nodes[-1]) else ():
        if step > 0:
            opened.setdefault(kind, []).append(at)
        elif opened.get(kind):
            # Within: behind the opening mark and not behind the closing one.
            edges += [(nodes[0] + opened[kind].pop() + 1, 1), (nodes[0] + at + 1, -1)]
    edges.sort()
    out, depth, k = [], 0, 0
    for node in nodes:
        while k < len(edges) and edges[k][0] <= node:
            depth += edges[k][1]
            k += 1
        out.append(depth > 0)
    return out


def _length_cost(size: int) -> float:
    return min(MOST, LENGTH * math.log(size / USUAL) ** 2)


def _empty(text: str, begin: int, end: int) -> bool:
    return end - begin < 12 and not any(c.isalpha() for c in text[begin:end])


def _nodes(text: str, low: int, high: int) -> tuple[list[int], list[float]]:
    """The candidates of a stretch without blank lines, its begin and its end; what an end at each is worth."""
    found: dict[int, float] = {}
    for m in _MARK.finditer(text, low, high):
        if m.end() < high:
            score = _odds(text, low, high, m)
            if score is not None:
                found[m.end()] = score
    if not text.isascii():
        for m in _BARE_SPACE.finditer(text, low, high):
            found[m.start()] = 4.0
    places = sorted(found)
    nodes = [low, *places, high]
    worth = [0.0, *(found[p] for p in places), 0.0]
    if places:
        for k, inside in enumerate(_quoted(text, nodes)):
            worth[k] -= UNBALANCED * (inside and 0 < k < len(nodes) - 1)
    return nodes, worth


def _segment_block(text: str, low: int, high: int) -> list[int]:
    """Ends of the sentences of text[low:high], a stretch without blank lines.

    best[j]: the score of the best spans up to node j. No predecessor is left
    out: spans of FLAT and more cost the same, so that of their begins the one
    of the highest score is the best; of shorter ones the search ends where
    the highest score of all that are left can't do better.
    """
    nodes, worth = _nodes(text, low, high)
    n = len(nodes)
    if n == 2:
        return [high]
    best, back = [0.0] * n, [0] * n
    # The highest score up to each node, and the last node that has it.
    highest, of = [0.0] * n, [0] * n
    far = -1
    for j in range(1, n):
        end = nodes[j]
        while nodes[far + 1] <= end - FLAT:
            far += 1
        top, place = (highest[far] - MOST, of[far]) if far >= 0 else (-math.inf, 0)
        for i in range(j - 1, far, -1):
            size = end - nodes[i]
            # Another length can only cost more from USUAL on.
            if highest[i] - (_length_cost(size) if size > USUAL else 0.0) < top:
                break
            score = best[i] - _length_cost(size) - EMPTY * _empty(text, nodes[i], end)
            if score > top or score == top and i > place:
                top, place = score, i
        best[j], back[j] = top + worth[j], place
        highest[j], of[j] = (best[j], j) if best[j] >= highest[j - 1] else (highest[j - 1], of[j - 1])
    ends, j = [], n - 1
    while j:
        ends.append(nodes[j])
        j = back[j]
    return ends[::-1]


def sentence_ends(text: str) -> list[int]:
    """The offset behind the last character, white space left out, of each sentence in order."""
    ends = []
    begin = 0
    stops = [(m.start(), m.end()) for m in _BLANK.finditer(text)] + [(len(text), len(text))]
    for stop, after in stops:
        if stop > begin and not text[begin:stop].isspace():
            for end in _segment_block(text, begin, stop):
                while end > begin and text[end - 1].isspace():
                    end -= 1
                if end > begin and not text[begin:end].isspace():
                    ends.append(end)
                    begin = end
        begin = after
    return ends


def sentences(text: str) -> list[tuple[int, int]]:
    """(begin, end) of each sentence; together they hold all but white space."""
    out, begin = [], 0
    for end in sentence_ends(text):
        while text[begin].isspace():
            begin += 1
        out.append((begin, end))
        begin = end
    return out


def split_sentences(df: DataFrame, key: str, text: str, with_text: bool = True) -> DataFrame:
    """(key, sentence_no, start_char, end_char[, sentence]) of every row's text.

    Null, empty and blank texts have no sentence; every other text has at least
    one. Repeated rows give repeated sentences. Offsets are code points. Only
    the two named columns are read; texts are taken whole, whatever their length.
    """
    kind = df.schema[key].dataType.simpleString()
    columns = [key, "sentence_no", "start_char", "end_char"] + ["sentence"] * with_text

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                row, number, start, end, unit = [], [], [], [], []
                for i, x in enumerate(some.column(1).to_pylist()):
                    for n, (a, b) in enumerate(sentences(x)):
                        row.append(i)
                        number.append(n)
                        start.append(a)
                        end.append(b)
                        if with_text:
                            unit.append(x[a:b])
                arrays = [some.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int32()) for x in (number, start, end))]
                if with_text:
                    arrays.append(pa.array(unit, pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, columns)

    schema = f"`{key}` {kind}, sentence_no int, start_char int, end_char int" + ", sentence string" * with_text
    return spread(df.select(key, text).where(F.col(text).isNotNull())).mapInArrow(run, schema)
