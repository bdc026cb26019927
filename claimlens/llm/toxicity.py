"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as symbols (insult, threat, target, negation, report, word, end of clause). Three small weighted transducers are
composed into one machine: *report* softens what stands inside reported speech until the clause ends, *negation* softens what
stands within three words after a negation, *aim* strengthens what stands near a target and completes a threat only with
one. The machine reads each clause and adds up the weights of what it matched, times the matched words' own weights.
A document's figures (sum, best clause, sum for each 100 words) go through a logistic curve, fitted with the rarer label weighing more (by the root of its rarity).

The insult words are a few seeds and stems learned from training labels: words and word beginnings of 3 to 8
letters that at least ``LEAST_SHARE`` of the sampled toxic texts hold, that stand in toxic ones by a share of at least ``PURE`` of both rates, and too
many for chance (the odds of a word without meaning stay under exp(-``SURE``)), counted over texts that differ by their
smallest shingle hash, so copies do not vote twice. The sample has at most ``SAMPLE`` rows of each label value.

Documents are scored where they lie: one scan, no shuffle. Defined results: a null or empty text matches nothing and
gets the curve's lowest value. Without usable labels of both values the curve is a fixed one. Repeated rows and null ids are scored like any
other; a null id is not held out. Other columns are not read by ``scores``; ``kept`` returns them all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored
from .learning import held_out, labelled_texts, logistic

SAMPLE = 4_000
SHORTEST, LONGEST = 3, 8
LEAST, LEAST_SHARE, PURE, SURE = 4, 0.004, 0.98, 14.0
THRESHOLD = 0.5
FIXED_CURVE = np.array([2.0, 1.0, 0.5, -3.0])

SEEDS = {"idiot": 1.0, "moron": 1.0, "scum": 1.0, "loser": 0.8, "stupid": 0.8, "worthless": 0.8, "pathetic": 0.7, "disgusting": 0.7,
         "trash": 0.6, "garbage": 0.5, "imbecile": 1.0, "bastard": 1.0, "bitch": 1.0, "asshole": 1.0, "dumb": 0.7, "retard": 1.0, "vermin": 0.9}
THREATS = frozenset("kill hurt destroy murder beat stab shoot strangle burn punch crush".split())
TARGETS = frozenset("you your yours yourself he she they them him her his their these those tu vous toi du ihr euch dich usted ustedes te".split())
NEGATIONS = frozenset("not no never neither nor isn't aren't wasn't don't doesn't didn't won't cannot can't pas jamais nicht kein keine nunca tampoco".split())
REPORTS = frozenset("said says say called calls wrote writes claimed claims quoted quote reported reports accused alleged"
                    " dijo dice dit disait sagte sagt schrieb escribió".split())
CLAUSES = re.compile(r"[.!?;:\n\"“”«»]+")
WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")

INSULT, THREAT, TARGET, NEGATION, REPORT, WORD, END = range(7)
Machine = dict  # state -> {symbol: (next state, output symbol, weight)}; a symbol without an entry passes and the state stays


def report_machine() -> Machine:
    """Within a clause, after a word of report: insults and threats weigh less."""
    return {0: {REPORT: (1, REPORT, 1.0)},
            1: {INSULT: (1, INSULT, 0.4), THREAT: (1, THREAT, 0.4), END: (0, END, 1.0)}}


def negation_machine(scope: int = 3) -> Machine:
    """Up to ``scope`` words after a negation: insults and threats weigh less."""
    out: Machine = {0: {NEGATION: (scope, NEGATION, 1.0)}}
    for k in range(1, scope + 1):
        out[k] = {NEGATION: (scope, NEGATION, 1.0), INSULT: (0, INSULT, 0.3), THREAT: (0, THREAT, 0.3), END: (0, END, 1.0)}
        out[k] |= {s: (k - 1, s, 1.0) for s in (WORD, TARGET, REPORT)}
    return out


def aim_machine(reach: int = 4) -> Machine:
    """Insults within ``reach`` words after a target weigh more; a threat counts only when a target follows or went before."""
    out: Machine = {0: {TARGET: (reach, TARGET, 1.0), THREAT: (-reach, THREAT, 0.0)}}
    for k in range(1, reach + 1):
        out[k] = {s: (k - 1, s, 1.0) for s in (WORD, NEGATION, REPORT)}
        out[k] |= {TARGET: (reach, TARGET, 1.0), INSULT: (reach, INSULT, 1.5), THREAT: (0, THREAT, 1.5), END: (0, END, 1.0)}
        out[-k] = {s: (1 - k, s, 1.0) for s in (WORD, NEGATION, REPORT)}
        out[-k] |= {TARGET: (reach, THREAT, 1.5), INSULT: (-k, INSULT, 1.0), THREAT: (-reach, THREAT, 0.0), END: (0, END, 1.0)}
    return out


def composed(first: Machine, second: Machine) -> Machine:
    """The machine that passes the output of ``first`` to ``second``; weights multiply; the start state is (0, 0)."""
    out, todo = {}, [(0, 0)]
    while todo:
        state = todo.pop()
        if state in out:
            continue
        out[state] = {}
        for symbol in range(7):
            a, mid, x = first[state[0]].get(symbol, (state[0], symbol, 1.0))
            b, end, y = second[state[1]].get(mid, (state[1], mid, 1.0))
            out[state][symbol] = ((a, b), end, x * y)
            todo.append((a, b))
    number = {s: k for k, s in enumerate(sorted(out, key=lambda s: (s != (0, 0), s)))}
    return {number[s]: {c: (number[t], o, w) for c, (t, o, w) in arcs.items()} for s, arcs in out.items()}


GRAMMAR = composed(composed(report_machine(), negation_machine()), aim_machine())


@dataclass
class Lexicon:
    """Insult words and beginnings with their weights; ``lengths`` are those of the beginnings."""

    words: dict[str, float]
    stems: dict[str, float]

    def __post_init__(self):
        self.lengths = sorted({len(s) for s in self.stems})

    def weight(self, word: str) -> float:
        w = self.words.get(word, 0.0)
        for n in self.lengths:
            if n > len(word):
                break
            w = max(w, self.stems.get(word[:n], 0.0))
        return w


SEED_LEXICON = Lexicon(SEEDS, {})


def figures(text: str | None, lexicon: Lexicon) -> tuple[float, float, float]:
    """log(1 + sum of the clauses' weights), the best clause, the sum for each 100 words (of 20 at least)."""
    low = (text or "").lower()
    words = WORDS.findall(low)
    weights = {w: x for w in set(words) if (x := lexicon.weight(w)) > 0}
    if not weights and THREATS.isdisjoint(words):
        return 0.0, 0.0, 0.0
    total, best = 0.0, 0.0
    state = 0
    for clause in CLAUSES.split(low):
        found = 0.0
        for word in WORDS.findall(clause):
            own = weights.get(word)
            symbol = (INSULT if own else THREAT if word in THREATS else TARGET if word in TARGETS
                      else NEGATION if word in NEGATIONS else REPORT if word in REPORTS else WORD)
            state, read, factor = GRAMMAR[state][symbol]
            if read == INSULT or read == THREAT:
                found += factor * (own or 1.0)
        state = GRAMMAR[state][END][0]
        total += found
        best = max(best, found)
    return float(np.log1p(total)), best, 100.0 * total / max(20, len(words))


def shingle_digest(words: list[str]) -> bytes:
    """The same for texts with the same set of five-word shingles."""
    return md5("\n".join(sorted({" ".join(words[k:k + 5]) for k in range(max(1, len(words) - 4))})).encode()).digest()


def beginnings(sample: DataFrame) -> DataFrame:
    """copy (digest of the text's set of shingles), label, features: the words and beginnings of each sampled text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, features = [], []
            for t in batch.column(0):
                words = WORDS.findall((t.as_py() or "").lower())
                distinct = set(words)
                copies.append(shingle_digest(words))
                features.append([f"={w}" for w in distinct] + list({w[:n] for w in distinct for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}))
            yield pa.RecordBatch.from_arrays([pa.array(copies, pa.binary()), batch.column(1), pa.array(features, pa.list_(pa.string()))],
                                             names=["copy", "label", "features"])

    return sample.select("text", "label").mapInArrow(run, "copy binary, label int, features array<string>")


def learned(sample: DataFrame) -> Lexicon:
    """Seeds, and the words and beginnings that mark the toxic texts of the sample; at most 1 / LEAST_SHARE * a text's words."""
    rows = stored(beginnings(sample).dropDuplicates(["copy", "label"]), "beginnings")  # equal shingles, so equal features: any row will do
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return SEED_LEXICON
    least = max(LEAST, int(LEAST_SHARE * n1))
    marked = rows.where("label = 1").select(F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("n1")).where(F.col("n1") >= least)
    clean = rows.where("label = 0").select(F.explode("features").alias("f")).join(marked.select("f"), "f", "left_semi").groupBy("f").agg(F.count("*").alias("n0"))
    share = F.col("n1") / n1 / (F.col("n1") / n1 + (F.coalesce("n0", F.lit(0)) + 0.5) / n0)
    held = F.col("n1") + F.coalesce("n0", F.lit(0))
    toxic, rest = F.col("n1") / held, 1 - F.col("n1") / held  # Chernoff's bound of a binomial count as large as n1 of those held
    bound = held * (toxic * F.log(toxic * (n1 + n0) / n1) + F.when(rest > 0, rest * F.log(rest * (n1 + n0) / n0)).otherwise(0))
    found = marked.join(clean, "f", "left").withColumn("share", share)
    found = found.where((F.col("share") >= PURE) & (bound >= SURE)).select("f", "n1", "share").collect()
    words, stems, held_by = dict(SEEDS), {}, {}
    for f, n, pure in sorted(((r["f"], r["n1"], r["share"]) for r in found), key=lambda r: (-r[2], -r[1], len(r[0]), r[0])):
        if f[0] == "=":
            words[f[1:]] = max(words.get(f[1:], 0.0), float(pure))
        elif held_by.get(f, 0) < 0.8 * n and not any(f[:k] in stems for k in range(SHORTEST, len(f))):
            stems[f] = float(pure)  # a beginning gives way to a purer one that is longer and nearly as common
            for k in range(SHORTEST, len(f)):
                held_by[f[:k]] = max(held_by.get(f[:k], 0), n)
    return Lexicon(words, stems)


@dataclass
class Model:
    lexicon: Lexicon
    curve: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))


def figure_rows(docs: DataFrame, lexicon: Lexicon, extra: str) -> DataFrame:
    """The ``extra`` column and x (array of double) of each row."""
    schema = T.StructType([docs.schema[extra], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [figures(t.as_py(), lexicon) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=schema.names)

    return docs.select(extra, "text").mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    texts = stored(labelled_texts(docs, labels, label, sample), "toxicity-sample")
    lexicon = learned(texts)
    rows = figure_rows(texts, lexicon, "label").toPandas()
    y = rows["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, FIXED_CURVE)
    x = np.array(rows["x"].tolist())
    order = np.lexsort([*x.T, y])
    x, y = x[order], y[order]
    return Model(lexicon, logistic(x, y, np.where(y == 1, y.mean(), 1 - y.mean()) ** -0.5))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: one row per document row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([figures(t.as_py(), model.lexicon) for t in batch.column(1)]).reshape(batch.num_rows, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model(x))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    out = scores(docs, fit(docs, labels, sample=sample))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels, sample=sample)

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        x = np.array([figures(t, model.lexicon) for t in texts]).reshape(len(texts), 3)
        return pd.Series(model(x) < threshold)

    return docs.where(passes("text"))
