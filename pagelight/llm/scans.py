"""Repair of text read from scanned pages.

Method: running headers and footers are found by fuzzy repetition of lines at
the page edges of a book, page numbers as a sequence that runs with the pages,
and words broken at line ends are joined by the corpus vocabulary: a break is
one unless the corpus writes the word with that very hyphen. Misread words are
those that the vocabulary lacks and that lie one edit, or one usual confusion
of shapes, from a word that is far more frequent.

Skew: a book may hold a third of all pages, so pages are grouped by stretches of
CHUNK pages of a book, with MARGIN pages of the neighbouring stretches; no group
is larger. Of paragraphs only the first and last piece of each stretch meet. Tokens meet
the misread ones by a broadcast of measured size, or by salted keys beyond it.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelight.functions.chars import fold_text, strip_ws
from pagelight.operators.joins import lookup_join
from pagelight.session import pinned

CHUNK, MARGIN = 32, 4
#: Longer join keys are digests; rows that a pass over tokens gives at once.
LONG, ROWS = 40, 10_000
#: Lines at either edge that may be running text or a page number.
EDGE = 3
#: Share of common letter triples from which two edge lines repeat each other.
ALIKE = 0.6
#: The same for a line beside the page's own number, which no prose has.
NUMBERED = 0.3
#: A word is misread only if the word it stands for is this many times as frequent.
RATIO = 10

HYPHENS = "-‐‑¬­"
# Shapes that scanning confuses, as (read, printed).
CONFUSED = (
    ("rn", "m"), ("m", "rn"), ("m", "in"), ("in", "m"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("cl", "d"), ("d", "cl"),
    ("vv", "w"), ("w", "vv"), ("li", "h"), ("h", "li"), ("nn", "m"), ("m", "nn"), ("fi", "h"), ("lc", "k"), ("k", "lc"), ("ni", "m"), ("m", "ni"), ("ui", "m"), ("tl", "d"), ("ci", "a"),
)
# Characters read in place of digits, and of letters.
AS_DIGIT = str.maketrans("OoQDlIi|!SsBZzGbqgTA", "00001111155822669974")
AS_LETTER = str.maketrans("015867|4$(", "olsbbtlasc")
# Characters of one shape, as (all, the one that stands for them).
SHAPES = ("ceéèêo0(aàliíj1|!tfhb6s5gq9rpuvy", "cccccccccciiiiiiittbbbssgggrruuu")
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}

# Words before a page's number.
PAGE_WORDS = ("p", "pg", "pag", "page", "seite", "s", "trang", "página", "pagina")
_NUMBER = re.compile(
    r"^(?P<open>[\[(<{\-–—·•*|~=. ]*)(?:(?P<word>[^\W_]{1,7}?)(?:\. ?| ))??(?P<core>[0-9OoQDlIi|!SsBZzGbqgTA]{1,6}|[ivxlcdmIVXLCDM1|!]{1,8})"
    r"(?P<total> ?(?:/|of|von|sur|de) ?[0-9OoQDlIi|!SsBZzGbqgTA]{1,6})?(?P<close>[\])>}\-–—·•*|~=. ]*)$",
    re.I,
)
_HEADING = re.compile(r"^\W*(?:chapter|part|section|book|kapitel|teil|chapitre|partie|capítulo|parte|chương|phần)\s+[\divxlc]+\W*$", re.I)
_SEPARATOR = re.compile(r"\s[|—–·•:/]\s")
_EDGE_NUMBER = re.compile(r"^(?P<a>\S(?:[^\n]{0,12}?\S)?)\s{2,}(?P<rest>\S.*)$|^(?P<rest2>.*\S)\s{2,}(?P<b>\S(?:[^\n]{0,12}?\S)?)$")


def _roman(text: str) -> int | None:
    total = last = 0
    for c in reversed(text.lower().replace("1", "i")):
        value = ROMAN.get(c)
        if value is None:
            return None
        total += value if value >= last else -value
        last = max(last, value)
    return total


def _page_word(word: str) -> bool:
    """Is it one of PAGE_WORDS, or one of the longer ones with a character misread?"""
    word = word.lower().translate(AS_LETTER)
    return word in PAGE_WORDS or any(len(w) == len(word) > 3 and sum(a != b for a, b in zip(w, word)) == 1 for w in PAGE_WORDS)


class _Mark:
    """A line read as a page number: its values and how it is dressed."""

    def __init__(self, text: str):
        m = _NUMBER.match(text.strip())
        self.good = bool(m)
        if m and m["word"] and not _page_word(m["word"]):
            self.good = False
        if not self.good:
            return
        self.core = m["core"]
        digits = self.core.translate(AS_DIGIT)
        self.digits = digits if digits.isdigit() else None
        self.clean = self.core.isdigit()
        self.value = int(digits) if digits.isdigit() else None
        self.roman = _roman(re.sub("[l1|!]", "i", self.core)) if not any(c.isdigit() and c != "1" for c in self.core) else None
        self.dress = (m["open"].strip()[:1], (m["word"] or "").lower()[:1], bool(m["total"]), m["close"].strip()[:1])
        self.dressed = any(self.dress)

    def is_page(self, page_no: int, offset: int | None, dresses: Counter, plain_place: bool) -> bool:
        if not self.good:
            return False
        usual = dresses[self.dress] >= 2
        if self.roman is not None and not self.clean and self.roman == page_no:
            return True
        if offset is None:
            return False
        due = str(page_no + offset)
        if self.value is not None and self.value == page_no + offset:
            return True
        if (usual and self.dressed or plain_place and not self.clean) and self.digits:
            if len(self.digits) == len(due):
                return sum(a != b for a, b in zip(self.digits, due)) <= 1 and (len(due) > 1 or self.dressed)
            return self.dressed and usual and abs(len(self.digits) - len(due)) == 1 and (self.digits in due or due in self.digits)
        return False


def _shape(text: str) -> str:
    return re.sub(r"[\W_]+", "", text.lower().translate(AS_LETTER))


def _triples(shape: str) -> frozenset[str]:
    padded = f"^{shape}$"
    return frozenset(padded[i : i + 3] for i in range(len(padded) - 2))


def _alike(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


class _Page:
    def __init__(self, row):
        self.row = row
        self.no = int(row.page_no) if row.page_no == row.page_no and row.page_no is not None else 0
        self.lines = (row.original_text or "").split("\n")
        self.full = [i for i, x in enumerate(self.lines) if x.strip()]
        self.kind = ["blank"] * len(self.lines)
        self.hints, self.has = {}, set()
        if row.hints is not None:
            for hint in row.hints:
                if hint["first_line"] < 0:
                    self.has.add(hint["label"])
                    continue
                for line in range(hint["first_line"], min(hint["last_line"], len(self.lines) - 1) + 1):
                    self.hints[line] = hint["label"]

    def edge(self, bottom: bool) -> list[int]:
        return self.full[::-1][:EDGE] if bottom else self.full[:EDGE]


def _bare(page: _Page, line: str, offset: int | None, dresses: Counter) -> tuple[str, bool]:
    """An edge line without the page's number beside it; whether there was one."""
    m = _EDGE_NUMBER.match(line.strip())
    for side, rest in (("a", "rest"), ("b", "rest2")) if m else ():
        if m[side] and _Mark(m[side]).is_page(page.no, offset, dresses, False):
            return m[rest].strip(), True
    m = re.match(r"^(?P<a>\S.{0,14}?)\s{2,}(?P<rest>\S.*)$", line.strip())
    if m and _Mark(m["a"]).is_page(page.no, offset, dresses, False):
        return m["rest"].strip(), True
    m = re.match(r"^(?P<rest>.*\S)\s{2,}(?P<a>\S.{0,14})$", line.strip())
    if m and _Mark(m["a"]).is_page(page.no, offset, dresses, False):
        return m["rest"].strip(), True
    return line.strip(), False


def _could_run(text: str) -> bool:
    """Has the form of running text: not in the middle of prose."""
    return not (text[:1].islower() or text[-1:] in ".,;?!:" or text[-1:] in HYPHENS or sum(map(str.isalpha, text)) < 3 or _HEADING.match(text))


def _titled(text: str) -> bool:
    """Are most of the longer words capitalised?"""
    words = [w for w in re.findall(r"[^\W_]+", text) if len(w) > 3 or len(w) > 1 and w.isupper()]
    return bool(words) and 2 * sum(w[0].isupper() or w[0].isdigit() for w in words) > len(words)


def label_pages(rows: pd.DataFrame) -> list[_Page]:
    """Sets the kind of every line of a stretch of a book: running_text, page_number, heading, table, prose or blank."""
    pages = [_Page(r) for r in rows.sort_values(["page_no", "result_id"]).itertuples(index=False)]
    # The sequence: number minus page is the same on all pages.
    offsets, dresses, plain = Counter(), Counter(), Counter()
    for page in pages:
        seen = set()
        for bottom in (False, True):
            for place, i in enumerate(page.edge(bottom)):
                texts = [page.lines[i]]
                parts = re.split(r"\s{2,}", page.lines[i].strip())
                if len(parts) == 2:
                    texts += parts
                for text in texts:
                    mark = _Mark(text)
                    if mark.good and mark.clean and mark.value is not None and (mark.value - page.no) not in seen:
                        seen.add(mark.value - page.no)
                        offsets[mark.value - page.no] += 1 + 0.5 * mark.dressed
    best = offsets.most_common(1)
    offset = best[0][0] if best and best[0][1] >= 2 else None
    for page in pages:
        for bottom in (False, True):
            for place, i in enumerate(page.edge(bottom)):
                mark = _Mark(page.lines[i])
                if mark.good and mark.value is not None and offset is not None and mark.value == page.no + offset:
                    dresses[mark.dress] += 1
                    plain[bottom, place] += not mark.dressed
                else:
                    for part in re.split(r"\s{2,}", page.lines[i].strip()):
                        mark = _Mark(part)
                        if mark.good and mark.value is not None and offset is not None and mark.value == page.no + offset:
                            dresses[mark.dress] += 1
    # Edge lines of all pages, for the fuzzy repetition.
    forms: list[tuple[int, bool, int, str, frozenset, str]] = []
    for p, page in enumerate(pages):
        for bottom in (False, True):
            for i in page.edge(bottom):
                bare, _ = _bare(page, page.lines[i], offset, dresses)
                if _could_run(bare):
                    parts = _SEPARATOR.split(bare)
                    shape = _shape(bare)
                    forms.append((p, bottom, i, bare, _triples(shape), _shape(parts[0]) if len(parts) > 1 else ""))
    # A chapter's title runs on over its pages, even if it does so only once.
    titles = set()
    for page in pages:
        for k, i in enumerate(page.full[1:], 1):
            if _HEADING.match(page.lines[page.full[k - 1]].strip()):
                titles.add(_triples(_shape(page.lines[i])))
    repeated: dict[tuple[int, int], float] = {}
    for p, bottom, i, text, triples, first in forms:
        best_alike = 0.0
        for q, bottom2, _, text2, triples2, first2 in forms:
            if p != q and bottom == bottom2:
                alike = _alike(triples, triples2)
                if first and first2 and alike < ALIKE and len(first) > 2 and (first == first2 or _alike(_triples(first), _triples(first2)) >= ALIKE):
                    alike = ALIKE
                best_alike = max(best_alike, alike)
        if not bottom:
            best_alike = max([best_alike, *(_alike(triples, x) for x in titles)])
        # A number that isn't the page's tells lines of text, tables and headings from running text.
        style = len(first) > 2 or _titled(text)
        if not first and any(map(str.isdigit, re.sub(r"[^\W\d_]+\d[^\W\d_]*|[^\W\d_]*\d[^\W\d_]+", "", text))) or not style and best_alike < 0.85:
            best_alike = 0.0
        repeated[p, i] = max(best_alike, repeated.get((p, i), 0.0))
    for p, page in enumerate(pages):
        for i in page.full:
            page.kind[i] = "prose"
        for bottom in (False, True):
            for place, i in enumerate(page.edge(bottom)):
                if page.kind[i] != "prose":
                    continue
                line = page.lines[i].strip()
                mark = _Mark(line)
                if mark.good and mark.is_page(page.no, offset, dresses, plain[bottom, place] >= 2):
                    page.kind[i] = "page_number"
                    continue
                bare, numbered = _bare(page, line, offset, dresses)
                hint = page.hints.get(i)
                alike = repeated.get((p, i), 0.0)
                k = page.full.index(i)
                after_heading = k > 0 and page.kind[page.full[k - 1]] == "prose" and _HEADING.match(page.lines[page.full[k - 1]].strip())
                if not after_heading and _could_run(bare) and (alike >= ALIKE or numbered and alike >= NUMBERED or hint in ("header", "footer") and alike >= 0.35 or ("footer" if bottom else "header") in page.has and alike >= 0.45):
                    page.kind[i] = "running_text"
                    continue
                break
        heading = False
        for n, i in enumerate(page.full):
            line = page.lines[i].strip()
            if page.kind[i] != "prose":
                continue
            if _HEADING.match(line):
                page.kind[i], heading = "heading", True
            elif heading and n and page.full[n - 1] == i - 1 and line[-1:] not in ".,;?!" and all(w[:1].isupper() or len(w) < 4 for w in line.split()):
                page.kind[i] = "heading"
            else:
                heading = False
                if not re.search(r"[^\W\d_]{2}", line) and re.search(r"\d", line) or len(re.findall(r"\S\s{3,}(?=\S)", line)) >= 2:
                    page.kind[i] = "table"
    return pages


def _first_token(line: str) -> str:
    m = re.match(r"\s*[\"'“‘(\[]*([^\s]+)", line)
    return m[1] if m else ""


_LINES = "book_id long, page_no int, result_id long, line_no int, kind string, text string, next_token string, broken_before boolean"


def _label_group(rows: pd.DataFrame) -> pd.DataFrame:
    pages = label_pages(rows)
    flow = [(p, i) for p, page in enumerate(pages) for i in page.full if page.kind[i] in ("prose", "heading", "table")]
    following = {a: b for a, b in zip(flow, flow[1:])}
    before = {b: a for a, b in zip(flow, flow[1:])}
    out = []
    for p, page in enumerate(pages):
        if not page.row.own:
            continue
        for i, kind in enumerate(page.kind):
            nxt = following.get((p, i))
            prev = before.get((p, i))
            # Only a neighbouring page goes on with a word.
            near = nxt is not None and (nxt[0] == p or pages[nxt[0]].no - page.no == 1)
            token = _first_token(pages[nxt[0]].lines[nxt[1]]) if near else None
            broken = prev is not None and pages[prev[0]].lines[prev[1]].rstrip()[-1:] in HYPHENS
            out.append((page.row.book_id, page.no, page.row.result_id, i, kind, page.lines[i], token, broken))
    return pd.DataFrame(out, columns=["book_id", "page_no", "result_id", "line_no", "kind", "text", "next_token", "broken_before"])


def label_lines(ocr: DataFrame, pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Every line of every page with its kind (see label_pages) and the first token of the text's next line.

    Repeated rows of the three tables count once. A page that is in no book is
    judged alone. Null texts have no lines; a blank text has blank lines.
    """
    text = ocr.select("result_id", "page_id", "original_text").where("original_text is not null").dropDuplicates(["result_id"])
    book = pages.select("page_id", "book_id", "page_no").where("book_id is not null").dropDuplicates(["page_id"])
    label = F.regexp_replace(strip_ws(fold_text(F.col("label"))), r"[\s\-]+", "_")
    # A region without known lines still tells that its page has running text.
    hints = regions.select("region_id", "page_id", label.alias("label"), F.coalesce("first_line", F.lit(-1)).alias("first_line"), F.coalesce("last_line", F.lit(-1)).alias("last_line"))
    hints = hints.where("label in ('header', 'footer', 'page_number') and page_id is not null").dropDuplicates(["region_id"])
    hints = hints.groupBy("page_id").agg(F.collect_list(F.struct("label", "first_line", "last_line")).alias("hints"))
    rows = text.join(book, "page_id", "left").join(hints, "page_id", "left")
    rows = rows.withColumn("book_id", F.coalesce("book_id", -F.col("result_id") - 1)).withColumn("page_no", F.coalesce("page_no", F.lit(0)))
    here = F.floor(F.col("page_no") / CHUNK).cast("int")
    spread = F.array_distinct(F.array(here, F.floor((F.col("page_no") - MARGIN) / CHUNK).cast("int"), F.floor((F.col("page_no") + MARGIN) / CHUNK).cast("int")))
    rows = rows.withColumn("chunk", F.explode(spread)).withColumn("own", F.col("chunk") == here)
    return rows.groupBy("book_id", "chunk").applyInPandas(_label_group, _LINES)


def tokens(lines: DataFrame) -> DataFrame:
    """(result_id, line_no, kind, place, last, token, cased) of every line but running text and page numbers."""
    parts = F.split(F.trim(F.regexp_replace("text", r"[\s ]+", " ")), " ")
    strip = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
    rows = lines.where("kind in ('prose', 'heading')").select("result_id", "line_no", "kind", "broken_before", F.size(parts).alias("count"), F.posexplode(parts).alias("place", "raw"))
    rows = rows.withColumn("cased", F.regexp_replace("raw", strip, "")).where("cased rlike '\\\\p{L}'")
    ends = (F.col("place") == F.col("count") - 1) & F.col("raw").rlike(f"[{HYPHENS}]$")
    return rows.select("result_id", "line_no", "kind", (F.col("place") == 0).alias("first"), ends.alias("broken"), "broken_before", F.lower("cased").alias("token"), "cased")


def vocabulary(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(token, n, named, listed): corpus frequency of every token that is no half of a broken word.

    named: how often it stands capitalised; listed: it is in the term list.
    """
    whole = words.where("not broken and not (first and broken_before)")
    counted = whole.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("cased") != F.col("token")).cast("long")).alias("named"))
    listed = terms.select(F.lower(F.trim("term")).alias("token")).where("token <> ''").distinct().withColumn("listed", F.lit(True))
    return counted.join(listed, "token", "full").select("token", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("named", F.lit(0)).alias("named"), F.coalesce("listed", F.lit(False)).alias("listed"))


def _keys(parts):
    """Join keys of a token: itself and, with one character left out, each shorter form; a digest for long forms."""
    for part in parts:
        token, key = [], []
        for word in part["token"]:
            for k in (word, *(word[:i] + word[i + 1 :] for i in range(len(word)) if not i or word[i] != word[i - 1])):
                token.append(word)
                key.append(k if len(k) <= LONG else blake2b(k.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
                if len(key) >= ROWS:
                    yield pd.DataFrame({"token": token, "key": key})
                    token, key = [], []
        if token:
            yield pd.DataFrame({"token": token, "key": key})


def _shapes(parts):
    """What a token was printed as if one confusion of shapes was made."""
    for part in parts:
        token, printed = [], []
        for word in part["token"]:
            for read, meant in CONFUSED:
                at = word.find(read)
                while at >= 0:
                    token.append(word)
                    printed.append(word[:at] + meant + word[at + len(read) :])
                    at = word.find(read, at + 1)
                    if len(token) >= ROWS:
                        yield pd.DataFrame({"token": token, "printed": printed})
                        token, printed = [], []
        if token:
            yield pd.DataFrame({"token": token, "printed": printed})


def misreadings(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(token, printed): tokens that stand for another, far more frequent one.

    words is a vocabulary. A listed word is never misread; neither is a word
    without a near neighbour (names, foreign and rare words).
    """
    doubtful = words.where("not listed and n > 0 and length(token) >= 2")
    known = words.where("listed or n >= 3")
    near = doubtful.select("token").mapInPandas(_keys, "token string, key string")
    goal = known.select("token").mapInPandas(_keys, "token string, key string").withColumnRenamed("token", "printed")
    pairs = near.join(goal, "key").where("token <> printed").select("token", "printed").distinct()
    swapped = F.expr("length(token) = length(printed) and array_join(array_sort(split(token, '')), '') = array_join(array_sort(split(printed, '')), '')")
    pairs = pairs.where((F.levenshtein("token", "printed", 2) == 1) | ((F.levenshtein("token", "printed", 2) == 2) & swapped))
    shaped = doubtful.select("token").mapInPandas(_shapes, "token string, printed string").join(known.select(F.col("token").alias("printed")), "printed").select("token", "printed")
    pairs = pairs.unionByName(shaped).distinct()
    mine = doubtful.select("token", "n", "named")
    theirs = words.select(F.col("token").alias("printed"), F.col("n").alias("m"), F.col("listed").alias("sure"))
    judged = pairs.join(mine, "token").join(theirs, "printed")
    odd = F.col("token").rlike(r"\p{L}[^\p{L}'’\-]+\p{L}|^[0-9|(]+\p{L}|\p{L}[0-9|(]+$")
    name = F.col("named") == F.col("n")
    # Words of two letters are near too many others.
    long = (F.length("token") > 2) | (F.length("token") == F.length("printed")) & ((F.translate("token", *SHAPES) == F.translate("printed", *SHAPES)) | swapped)
    # Two names may well differ by a letter: it must be one of the same shape, or none at all.
    same_shape = (F.translate("token", *SHAPES) == F.translate("printed", *SHAPES)) | (F.length("token") != F.length("printed")) | swapped
    enough = (
        F.when(odd, F.lit(True))
        # A name may resemble a word; only names far more frequent, or rare tokens, are put right.
        .when(F.col("sure"), F.when(name & (F.col("n") > 2), F.col("m") >= ratio * F.col("n")).otherwise((F.col("n") <= 2) | (F.col("m") >= 2 * F.col("n"))))
        .otherwise(same_shape & (F.col("m") >= ratio * F.col("n")))
    )
    ranked = judged.where(enough & long).groupBy("token").agg(F.max_by("printed", F.struct(F.col("sure").cast("int"), "m", "printed")).alias("printed"))
    return ranked


def line_breaks(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(result_id, line_no): lines that end within a word that goes on in the text's next line.

    The corpus decides: if it writes the two parts with a hyphen inside a line,
    at least as often as in one piece, the hyphen is the word's own.
    """
    parts = lines.where("kind = 'prose'").select(
        "result_id",
        "line_no",
        F.lower(F.regexp_extract("text", rf"([\p{{L}}\p{{M}}\p{{N}}|(\-]+)[{HYPHENS}][\s ]*$", 1)).alias("left"),
        F.lower(F.regexp_extract(F.coalesce("next_token", F.lit("")), r"^([\p{L}\p{M}\p{N}|(]+)", 1)).alias("right"),
        F.regexp_extract(F.coalesce("next_token", F.lit("")), r"^(\p{Lu})", 1).alias("upper"),
        F.col("next_token").isNull().alias("blind"),
    )
    # At the end of what is known of a book the word's begin alone must do: it breaks unless it is a word itself.
    alone = parts.where("blind and left <> ''").join(words.where("listed or n >= 3").select(F.col("token").alias("left")), "left", "left_anti").select("result_id", "line_no")
    parts = parts.where("not blind and left <> '' and right <> '' and upper = ''")
    parts = parts.withColumn("joined", F.concat("left", "right")).withColumn("hyphened", F.concat_ws("-", "left", "right"))
    # Distinct words are looked up, so that a frequent one is joined once.
    asked = parts.select("joined", "hyphened").distinct()
    found = asked.join(words.select(F.col("token").alias("joined"), "n", "listed"), "joined", "left")
    found = found.join(words.select(F.col("token").alias("hyphened"), F.col("n").alias("own"), F.col("listed").alias("own_listed")), "hyphened", "left")
    one_piece = F.coalesce("n", F.lit(0)) + F.when(F.coalesce("listed", F.lit(False)), 1).otherwise(0)
    with_hyphen = F.coalesce("own", F.lit(0)) + F.when(F.coalesce("own_listed", F.lit(False)), 1).otherwise(0)
    kept = found.where((with_hyphen > 0) & (with_hyphen >= one_piece)).select("hyphened").distinct()
    return parts.join(kept, "hyphened", "left_anti").select("result_id", "line_no").unionByName(alone)


def _repaired(text: str, fixes) -> str:
    """A line with its misread words put right, in their own case."""
    for fix in fixes if fixes is not None else ():

        def put(m, printed=fix["printed"]):
            seen = m[0]
            return printed.upper() if len(seen) > 1 and seen.isupper() else printed[:1].upper() + printed[1:] if seen[:1].isupper() else printed

        text = re.sub(rf"(?<!\w){re.escape(fix['token'])}(?!\w)", put, text, flags=re.I)
    return text


_PIECES = "book_id long, chunk int, piece int, edge boolean, joins boolean, glue boolean, result_id long, line_no int, kind string, text string"


def _paragraph_group(rows: pd.DataFrame) -> pd.DataFrame:
    """Headings, table lines and paragraphs of a stretch of a book.

    edge: the first and the last one, which may be parts of longer ones; joins:
    it goes on with what is before the stretch if that is prose; glue: its last
    word goes on.
    """
    rows = rows.sort_values(["page_no", "result_id", "line_no"])
    out: list[list] = []
    open_, page, blank, glue, body, joins = False, None, False, False, False, False
    for row in rows.itertuples(index=False):
        if row.result_id != page:
            # Blank lines around a page's running text part no paragraphs.
            page, blank, body = row.result_id, False, False
        if row.kind == "blank":
            blank = body
            continue
        if row.kind in ("running_text", "page_number"):
            continue
        text = _repaired(row.text, row.fixes).rstrip()
        indented = len(text) - len(text.lstrip()) >= 2
        text = " ".join(text.split())
        ended = not out or re.search(r"[.!?…][\"'”’»)\]]*$", out[-1][3]) is not None
        if not out:
            # No blank line of its own page is before the first one.
            joins = row.kind == "prose" and not indented
        if row.kind == "prose" and open_ and not indented and (glue or not blank or not ended):
            last = out[-1]
            last[3] += text if glue else " " + text
        else:
            out.append([row.result_id, row.line_no, row.kind, text])
        open_, glue, body = row.kind == "prose", False, True
        if open_ and out[-1][3][-1:] in HYPHENS:
            glue = True
            if row.broken:
                out[-1][3] = out[-1][3][:-1]
        blank = False
    last = len(out) - 1
    key = rows[["book_id", "chunk"]].iloc[0].tolist() if len(rows) else ()
    found = [(*key, i, i in (0, last), joins and i == 0, glue and i == last, *o) for i, o in enumerate(out)]
    return pd.DataFrame(found, columns=[x.split()[0] for x in _PIECES.split(", ")])


def paragraphs(ocr: DataFrame, pages: DataFrame, regions: DataFrame, terms: DataFrame) -> DataFrame:
    """(book_id, result_id, line_no, kind, text): headings, table lines and whole paragraphs of the books.

    A row stands at the page and line where it begins. Running text and page
    numbers are gone, broken words are joined, misread words put right and
    lines joined, over page ends too. A paragraph begins at an indented line or
    behind a blank one. It is one row, over however many pages it runs.
    """
    lines = pinned(label_lines(ocr, pages, regions))
    found = tokens(lines)
    words = pinned(vocabulary(found, terms))
    wrong = pinned(misreadings(words))
    fixes = lookup_join(_whole_words(found), wrong, ["token"], "inner").groupBy("result_id", "line_no").agg(F.array_sort(F.collect_set(F.struct("token", "printed"))).alias("fixes"))
    breaks = line_breaks(lines, words).distinct().withColumn("broken", F.lit(True))
    rows = lines.join(breaks, ["result_id", "line_no"], "left").join(fixes, ["result_id", "line_no"], "left").withColumn("broken", F.coalesce("broken", F.lit(False)))
    rows = rows.withColumn("chunk", F.floor(F.col("page_no") / CHUNK).cast("int"))
    rows = rows.select("book_id", "chunk", "page_no", "result_id", "line_no", "kind", "text", "broken", "fixes")
    pieces = pinned(rows.groupBy("book_id", "chunk").applyInPandas(_paragraph_group, _PIECES))
    # Two pieces at most of each stretch: the first goes on with the last one before it in the book.
    order = Window.partitionBy("book_id").orderBy("chunk", "piece")
    edges = pieces.where("edge").withColumn("opens", ~(F.col("joins") & F.coalesce(F.lag("kind").over(order) == "prose", F.lit(False))))
    edges = edges.withColumn("number", F.sum(F.col("opens").cast("long")).over(order))
    parts = edges.groupBy("book_id", "number").agg(F.array_sort(F.collect_list(F.struct("chunk", "piece", "result_id", "line_no", "kind", "text", "glue"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p, i: F.concat(p["text"], F.when(p["glue"] | (i == F.size("parts") - 1), "").otherwise(" "))), "")
    first = F.col("parts")[0]
    joined = parts.select("book_id", first["result_id"].alias("result_id"), first["line_no"].alias("line_no"), first["kind"].alias("kind"), text.alias("text"))
    return pieces.where("not edge").select(joined.columns).unionByName(joined)


def _whole_words(found: DataFrame) -> DataFrame:
    """(result_id, line_no, token) of prose, without halves of broken words."""
    return found.where("kind = 'prose' and not broken and not (first and broken_before)").select("result_id", "line_no", "token")


def places(ocr: DataFrame, pages: DataFrame, regions: DataFrame, terms: DataFrame) -> DataFrame:
    """(result_id, line_no, kind): running_text, page_number, hyphen_break and misread lines; distinct."""
    lines = pinned(label_lines(ocr, pages, regions))
    found = tokens(lines)
    words = pinned(vocabulary(found, terms))
    wrong = pinned(misreadings(words))
    misread = lookup_join(_whole_words(found), wrong.select("token"), ["token"], "inner").select("result_id", "line_no")
    edges = lines.where("kind in ('running_text', 'page_number')").select("result_id", "line_no", "kind")
    out = edges.unionByName(line_breaks(lines, words).withColumn("kind", F.lit("hyphen_break"))).unionByName(misread.withColumn("kind", F.lit("misread")))
    return out.distinct()
