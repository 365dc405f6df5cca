"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_of, small_batches

BUCKETS = 4096
SAMPLE_PER_LANG = 600
MOST_ROWS, LEAST_PER_LANG = 12_800, 20  # many languages share MOST_ROWS, and have LEAST_PER_LANG rows in any case
FOLDS, HELD_OUT = 4, 2

#: Families of language codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn mr gu pa ur ne",
    "sinitic": "zh yue",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[[b for b in range(128) if not chr(b).isalpha()]] = 32


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


def features(texts: list[str]) -> np.ndarray:
    """Square roots of the relative frequencies of each text's byte trigrams, hashed to BUCKETS columns."""
    raw = [b" " + t.lower().encode("utf-8", "replace") + b"  " for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    b = _FOLDED[np.frombuffer(b"".join(raw) + b"  ", np.uint8)].astype(np.uint32)
    codes = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(20)
    used = ~((b[:-2] == 32) & (b[1:-1] == 32))  # nor any trigram that reaches into the next text
    owner = np.repeat(np.arange(len(raw), dtype=np.int64) * BUCKETS, sizes)
    counts = np.bincount((owner + codes)[used], minlength=len(raw) * BUCKETS).reshape(len(raw), BUCKETS)
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    return np.sqrt(counts / total).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 120) -> np.ndarray:
    """Weights (last: bias) of a linear SVM with squared hinge loss, y in {-1, 1}, classes weighted alike.

    Accelerated gradient descent over the whole sample: the same sample gives the same weights.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    v, rate = w.copy(), 0.2  # rows have a squared length of 2 at most, so the loss is 4-smooth
    for step in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        gradient = -2 * (x.T @ (share * slack * y)) + penalty * v
        after = v - rate * gradient
        v = after + step / (step + 3) * (after - w)
        w = after
    return w


@dataclass
class Model:
    """Linear models as rows of ``weights``: families (one against the rest), then pairs within a family."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS + 1), np.float32))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score from 0 to 1) of each text; ``und`` and 0 without a letter or a model."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not known or not self.families:
            return out
        margins = features([texts[i] for i in known]) @ self.weights[:, :-1].T + self.weights[:, -1]
        chance = 1 / (1 + np.exp(-3 * margins))
        at = {p: len(self.families) + k for k, p in enumerate(self.pairs)}
        for row, i in enumerate(known):
            k = int(np.argmax(margins[row, : len(self.families)]))
            score = float(chance[row, k]) if len(self.families) > 1 else 1.0
            langs = self.members[self.families[k]]
            votes = dict.fromkeys(langs, 0)
            sure = dict.fromkeys(langs, 1.0)
            for a, b in combinations(langs, 2):
                p = float(chance[row, at[a, b]])
                votes[a if p >= 0.5 else b] += 1
                sure[a], sure[b] = min(sure[a], p), min(sure[b], 1 - p)
            best = max(langs, key=lambda c: (votes[c], sure[c]))
            out[i] = (best, score * sure[best])
        return out


def _featured(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_lang"), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())],
                names=["lang", "x"],
            )

    return rows.mapInArrow(run, "lang string, x binary")


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fit on rows outside the held-out fold that have a language and a letter in their text.

    Every language is learned.  Of each at most ``per_lang`` rows are taken, fewer where that makes
    more than MOST_ROWS, in the order of a hash of id and text; the driver gets only their hashed
    features (8 kB a row, twice that while it fits: 0.3 GB for MOST_ROWS).
    """
    small_batches(docs.sparkSession)
    rows = docs.filter(
        (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    ).select(F.col("lang").alias("_lang"), F.col("text").alias("_text"), F.xxhash64("doc_id", "text").alias("_place"))
    counts = rows.groupBy("_lang").count().collect()
    if not counts:
        return Model()
    per_lang = max(min(per_lang, MOST_ROWS // len(counts)), min(per_lang, LEAST_PER_LANG))
    # four times what is needed goes to the sort that takes the least places; small languages go whole
    frequent = {r["_lang"]: r["count"] for r in counts if r["count"] > 8 * per_lang}
    if frequent:
        share = F.create_map(*(F.lit(v) for lang, n in sorted(frequent.items()) for v in (lang, 4.0 * per_lang / n)))
        near = F.pmod("_place", F.lit(1_000_000)) / 1_000_000 < F.coalesce(F.try_element_at(share, F.col("_lang")), F.lit(1.0))
        rows = rows.filter(near)
    rows = rows.groupBy("_lang", "_place").agg(F.min("_text").alias("_text"))  # repeated rows count once
    least = Window.partitionBy("_lang").orderBy("_place", "_text")
    sample = rows.withColumn("_nth", F.row_number().over(least)).filter(F.col("_nth") <= per_lang)
    found = _featured(sample.select("_lang", "_text")).toArrow()
    if not found.num_rows:
        return Model()
    langs = np.array(found["lang"].to_pylist())
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float16).reshape(len(langs), BUCKETS).astype(np.float32)
    order = np.lexsort((x @ np.arange(1, BUCKETS + 1, dtype=np.float32), langs))
    langs, x = langs[order], x[order]
    model = Model()
    for lang in sorted(set(langs.tolist())):
        model.members.setdefault(family_of(lang), []).append(lang)
    model.families = sorted(model.members)
    owner = np.array([family_of(c) for c in langs])
    weights = [fit_svm(x, np.where(owner == f, 1.0, -1.0).astype(np.float32)) for f in model.families]
    for members in model.members.values():
        for a, b in combinations(members, 2):
            near = (langs == a) | (langs == b)
            weights.append(fit_svm(x[near], np.where(langs[near] == a, 1.0, -1.0).astype(np.float32)))
            model.pairs.append((a, b))
    model.weights = np.array(weights, np.float32)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text; only the text decides.

    Null texts and texts without a letter are ``und`` with score 0, as is all when nothing could be
    learned; repeated rows get the same answer; an empty table gives no rows; other columns are
    ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.predict(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "held_out")),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    held_out = (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out, F.col("text").alias("_text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
