"""Subject areas of documents.

Method: class-association rules (words of a sentence => subject) are mined with
parallel frequent-pattern growth from sentences of hand-labelled documents,
redundant rules are pruned, and every sentence of every document is scored by
the evidence of the rules that match it. Documents that are held out of the
mining calibrate the evidence: a logistic curve gives the probability that a
sentence of so much evidence is from a document of that subject, and a sentence
counts for a subject from an even chance on. A document is about the subjects
that enough of its sentences are about.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.operators.joins import bounded_rows
from pagelight.session import spread

#: Labelled documents that rules are mined from (about; all if there are fewer), chosen by a hash of the id.
FIT_DOCUMENTS = 4_000
#: A rule's words stand in this many sentences of the fit at least, together with its subject.
SUPPORT = 8
#: A rule's subject in this share of them; a longer rule must better its parts by GAIN.
CONFIDENCE, GAIN = 0.55, 0.03
#: Words whose subjects are spread as those of all words tell nothing: the least lift of a word.
LIFT = 1.5
LONGEST_RULE = 3
#: One in so many of those documents is held out for the calibration; evidence is counted in steps of STEP.
HELD_OUT, STEP = 5, 0.25
#: Patterns and subjects that come to the driver at most: the support grows until the former are so few, more of the latter are an error.
PATTERNS, SUBJECTS = 500_000, 10_000
#: Share of a document's sentences that must be about a subject.
SHARE = 0.25
#: Shorter lines (captions, buttons, numbers) are no sentences here.
LEAST_WORDS = 3

_CUT = re.compile(r"(?<=[.!?…])[\"”’»)\]]*\s+|(?<=[。！？])|\n\s*\n\s*|\n(?=\s*(?:[-•*]|\d+[.)])\s)")
_WORD = re.compile(r"[^\W\d_]+")
_BROKEN = re.compile(r"(?<=\w)[-‐¬­][ \t\r]*\n\s*(?=[^\W\d_])")
_TAG = re.compile(r"<[^<>\n]+>")


def sentence_words(text: str) -> list[list[str]]:
    """Case-folded words of each sentence or line of its own that has LEAST_WORDS of them."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    found = (_WORD.findall(x) for x in _CUT.split(text.casefold()))
    return [x for x in found if len(x) >= LEAST_WORDS]


@dataclass(frozen=True)
class Rules:
    """subjects: names; single: word -> (subject, evidence); longer: word -> [(all words, subject, evidence)];
    slope, offset: the log odds of a subject are slope * evidence + offset."""

    subjects: tuple[str, ...]
    single: dict[str, tuple[int, float]]
    longer: dict[str, list[tuple[frozenset, int, float]]]
    slope: float = 1.0
    offset: float = 0.0

    def subject(self, words: list[str]) -> int | None:
        """The subject that a sentence is about: its evidence is the most, and makes it at least as likely as not."""
        best, weight = self.evidence(words)
        return best if best is not None and self.slope * weight + self.offset >= 0 else None

    def evidence(self, words: list[str]) -> tuple[int | None, float]:
        """The subject that a sentence's matching rules give most evidence for, and how much.

        A rule whose words are all in a longer matching rule is left out.
        """
        found = set(words)
        known = [w for w in found if w in self.single or w in self.longer]
        if not known:
            return None, 0.0
        evidence: dict[int, float] = defaultdict(float)
        covered: set[str] = set()
        for word in known:
            for rule, subject, weight in self.longer.get(word, ()):
                if rule <= found:
                    evidence[subject] += weight
                    covered |= rule
        for word in known:
            if word in self.single and word not in covered:
                subject, weight = self.single[word]
                evidence[subject] += weight
        best = max(evidence, key=lambda k: (evidence[k], -k), default=None)
        return (best, evidence[best]) if best is not None and evidence[best] > 0 else (None, 0.0)

    def of_text(self, text: str | None) -> list[int]:
        """Subjects of at least SHARE of the text's sentences."""
        if not text:
            return []
        parts = sentence_words(text)
        count: dict[int, int] = defaultdict(int)
        for words in parts:
            subject = self.subject(words)
            if subject is not None:
                count[subject] += 1
        return sorted(k for k, n in count.items() if n >= SHARE * len(parts))


def _training(labels: DataFrame, names: list[str], rows: int) -> DataFrame:
    """(doc_id, subject): documents with one known label, at most about `rows` of them."""
    subject = F.lower(F.regexp_replace("subject", r"^[\s ]+|[\s ]+$", ""))
    known = labels.select("doc_id", subject.alias("subject")).where(F.col("subject").isin(names) & F.col("doc_id").isNotNull()).distinct()
    known = known.groupBy("doc_id").agg(F.min("subject").alias("subject"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    total = known.count()
    if total > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(rows / total * (1 << 20)))
    return known


def _sentence_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        subject, words, out = [], [], []
        for name, text, held_out in zip(part["subject"], part["text"], part["held_out"]):
            for found in sentence_words(text or ""):
                subject.append(name)
                words.append(sorted(set(found)))
                out.append(held_out)
        yield pd.DataFrame({"subject": subject, "words": words, "held_out": out})


def mine_rules(documents: DataFrame, labels: DataFrame, subjects: DataFrame, rows: int = FIT_DOCUMENTS) -> Rules:
    """Rules from the labelled documents.

    The labels used are at most about `rows` rows and may be broadcast for that;
    words and patterns that come to the driver are those of that sample.
    """
    from pyspark.ml.fpm import FPGrowth

    found = bounded_rows(subjects.where("subject is not null").select(F.lower(F.trim("subject")).alias("subject")).distinct(), SUBJECTS)
    if found is None:
        raise ValueError(f"more than {SUBJECTS} subjects")
    names = sorted(r[0] for r in found)
    sample = _training(labels, names, rows).withColumn("held_out", F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0)
    text = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    every = spread(text.select("subject", "text", "held_out")).mapInPandas(_sentence_rows, "subject string, words array<string>, held_out boolean").cache()
    lines = every.where("not held_out")
    by_word = lines.select("subject", F.explode("words").alias("word")).groupBy("word", "subject").agg(F.count(F.lit(1)).alias("n"))
    prior = {r[0]: r[1] for r in lines.groupBy("subject").count().collect()}
    total = sum(prior.values())
    telling = set()
    if total:
        share = F.create_map(*[F.lit(x) for k, v in prior.items() for x in (k, v / total)])
        ranked = by_word.withColumn("lift", F.col("n") / share[F.col("subject")])
        ranked = ranked.groupBy("word").agg(F.sum("n").alias("all"), F.max("lift").alias("most")).where((F.col("all") >= SUPPORT) & (F.col("most") >= LIFT * F.col("all")))
        telling = {r[0] for r in ranked.select("word").collect()}
    if not telling:
        every.unpersist()
        return Rules(tuple(names), {}, {})
    shared = documents.sparkSession.sparkContext.broadcast(frozenset(telling))

    def transactions(parts):
        for part in parts:
            items = [[w for w in words if w in shared.value] for words in part["words"]]
            out = pd.DataFrame({"items": [[*x, "=" + s] for x, s in zip(items, part["subject"]) if x]})
            yield out

    baskets = lines.mapInPandas(transactions, "items array<string>").cache()
    count, support, patterns = baskets.count(), SUPPORT, None
    while patterns is None:
        model = FPGrowth(itemsCol="items", minSupport=support / max(count, support), minConfidence=1.0).fit(baskets)
        patterns = bounded_rows(model.freqItemsets.where(F.size("items") <= LONGEST_RULE + 1), PATTERNS)
        support *= 2
    rules = prune({frozenset(r["items"]): r["freq"] for r in patterns}, names, {k: v / total for k, v in prior.items()})
    rules = calibrated(rules, every.where("held_out"))
    every.unpersist()
    baskets.unpersist()
    return rules


def calibrated(rules: Rules, held_out: DataFrame) -> Rules:
    """rules with the logistic curve that fits the held-out sentences: was the subject of most evidence the document's?

    What comes to the driver is two counts for each step of evidence. Without
    sentences of either outcome the curve stays as it is.
    """
    shared = held_out.sparkSession.sparkContext.broadcast(rules)

    def judge(parts):
        for part in parts:
            step, right = [], []
            for name, words in zip(part["subject"], part["words"]):
                best, weight = shared.value.evidence(list(words))
                if best is not None:
                    step.append(round(weight / STEP))
                    right.append(shared.value.subjects[best] == name)
            yield pd.DataFrame({"step": step, "right": right}).astype({"step": "int32", "right": bool})

    rows = held_out.mapInPandas(judge, "step int, right boolean").groupBy("step", "right").agg(F.count(F.lit(1)).alias("n")).toPandas()
    if rows["right"].nunique() < 2:
        return rules
    slope, offset = logistic(rows["step"].to_numpy() * STEP, rows["right"].to_numpy(dtype=float), rows["n"].to_numpy(dtype=float))
    return replace(rules, slope=slope, offset=offset) if slope > 0 else rules


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic curve of greatest likelihood, with a slight pull to (1, 0), by Newton's method."""
    at = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        share = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        gradient = design.T @ (n * (y - share)) - (at - [1.0, 0.0])
        step = np.linalg.solve((design * (n * share * (1 - share))[:, None]).T @ design + np.eye(2), gradient)
        at = at + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def prune(patterns: dict[frozenset, int], names: list[str], prior: dict[str, float]) -> Rules:
    """Rules worth keeping: confident, and better than each rule of fewer of their words.

    Evidence is the log odds of the smoothed confidence against the subject's
    prior, so that a frequent subject gains nothing by being frequent.
    """
    held: dict[frozenset, tuple[str, float, float]] = {}
    best: dict[frozenset, tuple[float, str, int]] = {}
    for items, n in patterns.items():
        marks = [x for x in items if x.startswith("=")]
        words = frozenset(x for x in items if not x.startswith("="))
        if len(marks) == 1 and words and words in patterns:
            share = (n + prior[marks[0][1:]]) / (patterns[words] + 1)
            best[words] = max(best.get(words, (0.0, "", 0)), (share, marks[0][1:], n))
    for words in sorted(best, key=lambda x: (len(x), sorted(x))):
        share, subject, n = best[words]
        if share < CONFIDENCE:
            continue
        parts = [held[words - {w}] for w in words if words - {w} in held]
        parts += [held[frozenset([w])] for w in words if len(words) > 1 and frozenset([w]) in held]
        if parts and all(p[0] == subject for p in parts) and share < max(p[1] for p in parts) + GAIN:
            continue
        odds = math.log(share / (1 - min(share, 0.999))) - math.log(prior[subject] / (1 - min(prior[subject], 0.999)))
        held[words] = (subject, share, max(odds, 0.0))
    place = {n: i for i, n in enumerate(names)}
    single, longer = {}, defaultdict(list)
    for words, (subject, _, odds) in held.items():
        if len(words) == 1:
            single[next(iter(words))] = (place[subject], odds)
        else:
            # Looked up by one of its words only: the one in the fewest rules so far.
            first = min(words, key=lambda w: (len(longer.get(w, ())), w))
            longer[first].append((words, place[subject], odds))
    return Rules(tuple(names), single, dict(longer))


def find_subjects(documents: DataFrame, rules: Rules, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, subject) of each document's subjects, none for null, empty and blank texts.

    Repeated rows give repeated results. Texts are read whole, only the two
    named columns are read, and documents are never shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(rules)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        rules = shared.value
        for batch in batches:
            row, subject = [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                for k in rules.of_text(x):
                    row.append(i)
                    subject.append(rules.subjects[k])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(subject, pa.string())], [key, "subject"])

    return spread(documents.select(key, text).where(F.col(text).isNotNull())).mapInArrow(run, f"`{key}` {kind}, subject string")
