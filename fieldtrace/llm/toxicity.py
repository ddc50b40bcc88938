"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

The lexicon is a fixed list of insults and what the labelled sample teaches: words, and beginnings of words, that
toxic documents hold far more often than others. While training, a document's own label doesn't count towards the
lexicon by which it is described.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.llm.common import fold, materialise

TRAIN_DOCS = 20_000
#: The least evidence for an entry of the learned lexicon (a log likelihood ratio).
EVIDENCE = 8.0

#: Words that insult, by language.
INSULTS = frozenset(
    "arsehole asshole bastard bitch bullshit clown coward cretin creep crap cunt dickhead disgrace disgusting dork douche dumb dumbass "
    "dunce failure filth filthy freak fuck fucker fucking garbage goon gross hag hate hideous idiot idiotic idiots ignorant imbecile "
    "inferior jackass jerk lame liar loser losers lowlife lunatic maggot moron moronic morons nasty numbskull parasite pathetic pest "
    "prick punk repulsive retard retarded rotten rubbish scum scumbag shit shithead shut sick skank slob slut smelly snake sucker sucks stupid "
    "subhuman swine trash twat twit ugly useless vermin wanker weakling whore wimp worm worthless wretch "
    "abruti connard connasse crétin débile imbécile merde minable ordure pute salaud salope "
    "arschloch blöd blödmann depp dumm dummkopf hure idioten miststück scheiße schwachkopf schwein trottel versager wichser "
    "basura cabrón estúpido gilipollas idiota imbécil inútil mierda pendejo perdedor puta asqueroso".split()
)
#: Second-person words.
YOU = frozenset("you your yours yourself youre you're u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen sie ihr euch tú ti tus usted ustedes vosotros".split())

FEATURES = ["learned", "learned_rate", "learned_kinds", "strongest", "hits", "density", "hidden", "near_you", "you", "capitals", "exclaims", "questions", "punctuation", "symbols", "length"]

_PLAIN = bytes(32 if chr(c) in ".,;:!?\"()[]{}<>|#%&*$\n\t\r\x0b\x0c" else c for c in range(256))
_LEET = [str.maketrans("013457@$!|", f"o{one}eastas{one}l") for one in "il"]
_MARKS = "…«»¡¿"
_SPACED = re.compile(r"(?<!\w)\w[ .\-_*]\w[ .\-_*]\w[ .\-_*](?:\w[ .\-_*])*\w\b")
_DISGUISED = re.compile(r"[*@$!|0-9]|[^\W\d_][._\-]+[^\W\d_]").search
_LETTER = re.compile(r"[^\W\d_]").search


def _masked() -> frozenset:
    """Insults with one inner letter hidden by an asterisk."""
    return frozenset(w[:i] + "*" + w[i + 1 :] for w in INSULTS if len(w) > 3 for i in range(1, len(w) - 1))


MASKED = _masked()
MARKED = INSULTS | YOU


def _uncovers(token: str) -> bool:
    return any(re.sub(r"[ .\-_]", "", token.translate(t)).strip("*!?,;:") in INSULTS for t in _LEET) or re.sub(r"[ .\-_]", "", token).strip(".!?,;:") in MASKED


def _parted(low: str) -> str:
    """Spaces for marks of more than a byte, which the byte table leaves."""
    for mark in _MARKS:
        low = low.replace(mark, " ")
    return low


def _hidden(low: str) -> int:
    """Insults under other characters: hidden inside a word, or spelled letter by letter."""
    found, low = 0, _parted(low)
    if any(c in low for c in "*@$!|-_0123456789") or low.count(".") > low.count(". ") + low.count(".\n") + low.endswith("."):
        found += sum(map(_uncovers, filter(_LETTER, filter(_DISGUISED, low.split()))))
    if _SPACED.search(low):
        found += sum(map(_uncovers, _SPACED.findall(low)))
    return found


def _words(low: str) -> list[str]:
    return _parted(low).encode("utf-8", "surrogatepass").translate(_PLAIN).decode("utf-8", "surrogatepass").split()


def _evidence(a: float, b: float, base: float) -> float:
    """Log likelihood ratio of a word that ``a`` toxic and ``b`` other documents hold, if toxic ones hold it more."""
    return a * log(a / (a + b) / base) if a and a > base * (a + b) else 0.0


class Lexicon:
    """Document counts (toxic, other) of entries; an entry that ends in ``*`` stands for words that begin so."""

    def __init__(self, counts: dict[str, tuple[int, int]], base: float):
        self.counts, self.base = counts, base
        self.sure = {w for w, (a, b) in counts.items() if _evidence(a, b, base) >= EVIDENCE}
        self.starts = {w[:-1] for w in counts if w.endswith("*")}

    def odds(self, words: list[str], label: float | None) -> list[tuple[str, float]]:
        """The entries among the words, with smoothed log odds; ``label``: what the counts include for this text, taken out again."""
        found, counts, starts = [], self.counts, self.starts
        for w in [w for w in words if w in counts or w[:4] in starts]:
            for unit in (w, w[:4] + "*") if len(w) > 5 else (w,):
                if (c := counts.get(unit)) is None:
                    continue
                a, b = c
                if label is None:
                    if unit not in self.sure:
                        continue
                else:
                    a, b = (max(a - 1, 0), b) if label else (a, max(b - 1, 0))
                    if _evidence(a, b, self.base) < EVIDENCE:
                        continue
                found.append((w, log((a + 0.5) / (b + 0.5) * (1 - self.base) / self.base)))
        return found


def describe(text: str | None, lexicon: Lexicon, label: float | None = None) -> list[float]:
    """The features of a text, in the order of FEATURES; null and empty texts have zeros."""
    text = text or ""
    low = text.lower()
    words = _words(low)
    n, chars = max(len(words), 1), max(len(text), 1)
    learned = lexicon.odds(words, label)
    bad = {w for w, _ in learned}
    marked = [i for i, w in enumerate(words) if w in MARKED]
    hits, you = [i for i in marked if words[i] in INSULTS], [i for i in marked if words[i] in YOU]
    near = 0
    if you and (hits or bad):
        rude = np.array([i for i, w in enumerate(words) if w in INSULTS or w in bad])
        at = np.array(you)
        after = np.searchsorted(at, rude)
        gap = np.minimum(np.abs(at[np.minimum(after, len(at) - 1)] - rude), np.abs(at[np.maximum(after - 1, 0)] - rude))
        near = int((gap <= 5).sum())
    hidden = _hidden(low)
    upper = sum(map(str.isupper, text.split()))
    count = text.count
    points = sum(map(count, ".,;:!?"))
    symbols = sum(map(count, "#*$%&|<>@"))
    return [
        log1p(len(learned)), len(learned) / n, log1p(len(bad)), max((x for _, x in learned), default=0.0),
        log1p(len(hits)), len(hits) / n, hidden / n, near / n, len(you) / n, upper / n, count("!") / chars, count("?") / chars, points / chars, symbols / chars, log1p(len(words)),
    ]


def learn(sample: DataFrame) -> Lexicon:
    """The lexicon of a bounded labelled sample (``text, label``); equal texts count once, with the highest of their labels.

    Entries need evidence over the whole sample; their number is bounded by its words. An entry that lacks it only because
    of one document's own label stays out for that document too: let in, it made more false alarms on held-out rows.
    """

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = set(_words((text.as_py() or "").lower()))
                found = list(words | {w[:4] + "*" for w in words if len(w) > 5})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label] * len(found), pa.float64())], ["unit", "label"])

    distinct = sample.groupBy(F.sha2("text", 256).alias("digest")).agg(F.max("text").alias("text"), F.max("label").alias("label"))
    n, a = distinct.agg(F.count(F.lit(1)), F.sum("label")).first()
    base = min(max(a / n, 1e-6), 1 - 1e-6)
    counts = distinct.select("text", "label").mapInArrow(units, "unit string, label double").groupBy("unit").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    weight = F.col("a") * F.log(F.col("a") / (F.col("a") + F.col("b")) / base)
    rows = counts.filter((F.col("a") > 0) & (weight >= EVIDENCE)).collect()
    return Lexicon({r["unit"]: (int(r["a"]), int(r["b"])) for r in rows}, base)


def features(docs: DataFrame, lexicon: Lexicon, labelled: bool = False) -> DataFrame:
    """``doc_id`` and one double per feature, for every row; ``labelled``: also ``label``, and ``counted``, what the lexicon counts for the text."""
    carry = ("doc_id", "label", "counted") if labelled else ("doc_id",)
    carried = docs.select(*carry, "text")
    schema = ", ".join([f"`{c}` {carried.schema[c].dataType.simpleString()}" for c in carry] + [f"{f} double" for f in FEATURES])
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            own = b.column(2).to_pylist() if labelled else [None] * b.num_rows
            x = np.array([describe(t.as_py(), known, y) for t, y in zip(b.column(len(carry)), own, strict=True)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(carry))), *(pa.array(x[:, k]) for k in range(len(FEATURES)))], [*carry, *FEATURES])

    return carried.mapInArrow(described, schema)


def classify(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, trees: int = 12, depth: int = 3, seed: int = 9) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    At most ``train_docs`` labelled documents outside the fold crc32(doc_id) mod 5 = 0 (those with the lowest seeded
    hashes of their ids) train the trees (three quarters) and the isotonic calibration (one quarter). Neither labels
    nor lang, source or id enter a score. Equal texts with different labels count as toxic in the lexicon, and each as
    labelled for the trees. Where the labels hold one class or none, every score is that class, or 0.
    Null and empty texts have all-zero features; repeated rows come out as often as they come in; rows without an id
    are scored and never held out.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
        .groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(train_docs)
    )
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null")
    texts = materialise(texts.withColumn("counted", F.max("label").over(Window.partitionBy(F.sha2("text", 256)))), "toxicity-texts")
    classes = {r["label"] for r in texts.select("label").distinct().collect()}
    if len(classes) < 2:
        only = F.lit(float(max(classes, default=0.0)))
        return docs.select("doc_id", held_out, only.alias("score"), (only >= 0.5).cast("int").alias("predicted"))
    lexicon = learn(texts)
    sample = materialise(features(texts, lexicon, labelled=True), "toxicity-sample")
    every = features(docs, lexicon)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    part = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(4))
    fit, calibrate = sample.filter(part != 0), sample.filter(part == 0)
    if fit.select("label").distinct().count() < 2:
        fit = sample
    model = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, maxBins=64, stepSize=0.3, seed=seed).fit(assembler.transform(fit))

    def chance(df: DataFrame) -> DataFrame:
        return model.transform(assembler.transform(df)).withColumn("chance", vector_to_array("probability")[1])

    line = None
    if calibrate.select("label").distinct().count() == 2:
        line = IsotonicRegression(featuresCol="chance", labelCol="label", predictionCol="score").fit(chance(calibrate).select("chance", "label"))
    scored = chance(every).select("doc_id", "chance")
    scored = line.transform(scored) if line else scored.withColumn("score", F.col("chance"))
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", held_out, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
