"""Language identification: the family first, then one-versus-one linear support vector machines inside the family.

Features are hashed byte n-grams (one to ``MAX_GRAM`` bytes) of the lower-cased whole text, every run of bytes that are not
letters being one space. Counts are damped by a square root and scaled to length one. The family classifier is a multinomial
logistic regression; each pair of languages of a family has its own support vector machine and the pair votes decide. Both are
trained by Spark ML on a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.linalg import SparseVector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let_go, number_lists, settle

#: Families of common language codes; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sk", "sr", "hr", "sl"),
    "finnic": ("fi", "et"),
    "turkic": ("tr", "az", "kk"),
    "indic": ("hi", "bn", "mr", "ne", "ur"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
UNDETERMINED = "und"
DIMENSIONS = 1 << 12
MAX_GRAM = 3
PIECE = 1 << 20  # bytes that are hashed at a time

# ASCII letters in lower case and bytes of longer characters stay; all else is a space
_FOLD = np.full(256, 32, np.uint8)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalpha():
        _FOLD[_b] = ord(chr(_b).lower())
    elif _b >= 128:
        _FOLD[_b] = _b


def counts(text: bytes, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Hashed n-gram counts of one text; long texts are added up piece by piece."""
    total = np.zeros(dimensions)
    for at in range(0, len(text), PIECE):
        # each piece begins with the bytes that its first n-grams need
        head = min(at, MAX_GRAM - 1)
        raw = _FOLD[np.frombuffer(text, np.uint8, min(PIECE, len(text) - at) + head, at - head)]
        keep = np.ones(len(raw), bool)
        keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
        raw = raw[keep].astype(np.uint32)
        code = np.zeros(len(raw), np.uint32)
        for n in range(1, MAX_GRAM + 1):
            code = code[:len(raw) - n + 1] * np.uint32(257) + raw[n - 1:] if n > 1 else raw.copy()
            if not len(code):
                break
            hashed = (code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - int(dimensions).bit_length() + 1)
            total += np.bincount(hashed[max(0, head - n + 1):] if at else hashed, minlength=dimensions)
    return total


def features(text: bytes, dimensions: int = DIMENSIONS) -> np.ndarray:
    x = np.sqrt(counts(text, dimensions))
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


@dataclass
class Model:
    """Weights per class; ``pairs[family]`` holds (first, second, weights, intercept), positive margins mean ``second``."""

    families: list[str]
    family_weights: np.ndarray
    family_bias: np.ndarray
    members: dict[str, list[str]]
    pairs: dict[str, list[tuple[str, str, np.ndarray, float]]]

    def predict(self, text: bytes) -> tuple[str, float]:
        """Language and a score from 0 to 1: the family's probability times the mean squashed margin of the winner's pairs."""
        if not self.families:
            return UNDETERMINED, 0.0
        x = features(text)
        z = self.family_weights @ x + self.family_bias
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        family = self.families[best]
        langs = self.members[family]
        votes, belief = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for a, b, w, bias in self.pairs[family]:
            margin = float(w @ x + bias)
            q = 1 / (1 + np.exp(-2 * margin))
            votes[b if margin > 0 else a] += 1
            belief[a] += 1 - q
            belief[b] += q
        lang = min(langs, key=lambda v: (-votes[v], -belief[v], v))
        inner = belief[lang] / (len(langs) - 1) if len(langs) > 1 else 1.0
        return lang, float(p[best] * inner)


def _vectors(text: Column) -> Column:
    def vector(values: pa.Array) -> pa.Array:
        let_go("langid")
        return number_lists([features(v.as_buffer().to_pybytes()).astype(np.float32) for v in values], np.float32)

    return F.arrow_udf(vector, "array<float>")(text)


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> DataFrame:
    """(lang, features) of at most ``per_lang`` rows a language: those with the smallest id hashes, so the choice doesn't depend on order.

    Every task keeps its own smallest ids first, so the final ranking sees at most ``per_lang`` rows of a task and language."""
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit("langid"))
    few = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), h.alias("h"))
    # counts of hashes in 4096 equal steps give a cut below which a language has enough rows
    step = F.shiftright("h", 52)
    cuts = few.groupBy("lang", step.alias("step")).count()
    upto = F.sum("count").over(Window.partitionBy("lang").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    cuts = cuts.withColumn("before", F.coalesce(upto, F.lit(0))).where(F.col("before") < per_lang).groupBy("lang").agg(F.max("step").alias("last"))
    near = few.join(F.broadcast(cuts), "lang").where(step <= F.col("last"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = near.withColumn("rank", rank).where(F.col("rank") <= per_lang)
    return chosen.select("lang", _vectors(F.col("text")).alias("x"))


def _weights(vector) -> np.ndarray:
    return vector.toArray() if isinstance(vector, SparseVector) else np.asarray(vector)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400) -> Model:
    """Fit on at most ``per_lang`` labelled rows of each language (the only bound of the training).

    Without labelled rows the model knows no language and calls every text 'und'."""
    from pyspark.ml.functions import array_to_vector

    sample = labelled_sample(docs, id_col, text_col, lang_col, per_lang).select("lang", array_to_vector(F.col("x").cast("array<double>")).alias("features"))
    sample = settle(sample.coalesce(2)).cache()  # bounded by per_lang; two tasks per step of the fits
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    members: dict[str, list[str]] = {}
    for lang in langs:
        members.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    families = sorted(members)
    bias, weights = np.zeros(len(families)), np.zeros((len(families), DIMENSIONS))
    if len(families) > 1:
        number = {lang: float(i) for i, f in enumerate(families) for lang in members[f]}
        of = F.create_map(*[F.lit(v) for kv in number.items() for v in kv])
        fit = LogisticRegression(regParam=1e-4, maxIter=25, standardization=False, family="multinomial").fit(sample.select("features", of[F.col("lang")].alias("label")))
        weights, bias = fit.coefficientMatrix.toArray(), _weights(fit.interceptVector)
    pairs: dict[str, list] = {f: [] for f in families}
    for f in families:
        for a, b in combinations(members[f], 2):
            rows = sample.where(F.col("lang").isin(a, b)).select("features", (F.col("lang") == b).cast("double").alias("label"))
            fit = LinearSVC(regParam=1e-4, maxIter=25, standardization=False).fit(rows)
            pairs[f].append((a, b, _weights(fit.coefficients), float(fit.intercept)))
    sample.unpersist()
    return Model(families, weights, bias, members, pairs)


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a column ``out``: struct (lang, score).

    A text that is null or has no letter is 'und' with score 0. The whole text counts, however long. Other columns pass
    through; one called ``out`` is replaced. An empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(values: pa.Array) -> pa.Array:
        let_go("langid")
        m = shared.value
        found = [m.predict(v.as_buffer().to_pybytes()) if v.is_valid else (UNDETERMINED, 0.0) for v in values]
        return pa.array([{"lang": a, "score": b} for a, b in found], pa.struct([("lang", pa.string()), ("score", pa.float64())]))

    text = F.col(text_col)
    has_letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    guess = F.arrow_udf(predict, "struct<lang: string, score: double>")(F.when(has_letter, text))
    return docs.withColumn(out, guess)


def certain(model: Model, language: Column, margin: float = 0.05) -> Column:
    """Whether a result (lang, score) of ``identify`` names a language of the model with a score above chance.

    Chance is one family among the known ones, and an undecided pair inside it; the score has to be ``margin`` of the way from there to 1."""
    chance = {lang: (0.5 if len(langs) > 1 else 1.0) / len(model.families) for langs in model.members.values() for lang in langs}
    if not chance:
        return F.lit(False)
    least = F.create_map(*[F.lit(v) for lang, c in chance.items() for v in (lang, c + margin * (1 - c))])
    return F.coalesce(language["score"] >= F.try_element_at(least, language["lang"]), F.lit(False))
