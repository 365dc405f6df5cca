"""Toxicity: a weighted finite-state pattern grammar over clauses, with a lexicon learned from labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, small_batches, text_beside_row

FOLDS, HELD_OUT = 5, 0
MOST_TOXIC, MOST_CLEAN = 3000, 6000  # bounds of the labelled sample that the score is fitted on
HELD_STEMS = 300_000  # stems that a worker counts before it hands them on
LEAST_DOCS, LEAST_RATIO, LEAST_WEIGHT = 4, 10.0, 2.0
STEM_SIZES = (4, 5, 6)
N_FEATURES = 6

NEGATIONS = frozenset(
    "not no never none cannot don't isn't aren't won't nicht kein keine keinen nie niemals "
    "ne pas jamais aucun non nunca jamás ningún tampoco".split()
)
REPORTS = frozenset(
    "said says say told wrote writes quoted quote claimed reported according sagte sagt schrieb zitierte laut "
    "dit disait écrit selon cité dijo dice escribió citó según".split()
)
TARGETS = frozenset(
    "you your you're u ya they them these those people he she du dich dir ihr euch sie dein deine "
    "tu te toi vous ton votre ils elles tú usted ustedes vosotros os ellos ellas su".split()
)
INTENTS = frozenset(
    "will i'll we'll gonna shall must should going werde werden wird sollst sollten vais va allons dois doit "
    "voy vamos debes debe deberías".split()
)
#: Verb stems of a threat and the endings of their language's forms.
THREAT_FORMS = {
    "kill hurt destroy murder shoot stab burn hang beat": ("", "s", "ed", "ing", "ting", "bing", "bed", "er", "en"),
    "töt schlag vernicht erschieß": ("e", "en", "t", "et", "st", "est", "te", "ete", "ten", "eten"),
    "bring umbring umgebrach": ("en", "t", "e"),
    "frapp tu but": ("e", "er", "ez", "ons", "ent", "erai", "era", "erons", "eront", "é"),
    "détrui": ("re", "s", "t", "sons", "sez", "sent", "rai", "ra", "rons", "ront"),
    "mat golpe quem": ("ar", "o", "as", "a", "amos", "an", "aré", "ará", "aremos", "arán", "é", "ó"),
    "destru": ("ir", "yo", "yes", "ye", "yen", "iré", "irá", "iremos"),
}
THREATS = frozenset(s + e for stems, ends in THREAT_FORMS.items() for s in stems.split() for e in ends) - {"bring", "bringe", "bringen", "bringt", "tu", "but"}
PLAIN, TARGET, NEGATION, REPORT, INTENT, THREAT, INSULT, AIMED_THREAT, AIMED_INSULT = range(9)
HOSTILE = (THREAT, INSULT, AIMED_THREAT, AIMED_INSULT)
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_ENDS = ".!?;:,"
Symbol = tuple[int, float]


class Transducer:
    """A weighted finite-state transducer over symbols (class, weight).

    ``arcs``: (state, class) -> (next state, class out, factor).  ``idle`` says where a class without an
    arc leads from each state; it goes out as it is.  ``backwards`` reads from the right.
    """

    def __init__(
        self, arcs: dict[tuple[int, int], tuple[int, int, float]], idle: dict[int, int], backwards: bool = False
    ):
        self.arcs, self.idle, self.backwards = arcs, idle, backwards

    def __call__(self, symbols: list[Symbol]) -> list[Symbol]:
        state, out = 0, []
        for kind, weight in reversed(symbols) if self.backwards else symbols:
            state, after, factor = self.arcs.get((state, kind), (self.idle[state], kind, 1.0))
            out.append((after, weight * factor))
        return out[::-1] if self.backwards else out


def _insult(span: int = 3, factor: float = 1.25) -> Transducer:
    """Insults heaped on each other: from the second within ``span`` words each weighs more."""
    arcs = {(0, INSULT): (span, INSULT, 1.0)} | {(s, INSULT): (span, INSULT, factor) for s in range(1, span + 1)}
    return Transducer(arcs, {s: max(0, s - 1) for s in range(span + 1)})


def _threat(span: int = 4, factor: float = 2.0) -> Transducer:
    """A threatening verb within ``span`` words after a word of intent weighs more."""
    arcs = {(s, INTENT): (span, INTENT, 1.0) for s in range(span + 1)}
    arcs |= {(s, THREAT): (s - 1, THREAT, factor) for s in range(1, span + 1)}
    return Transducer(arcs, {s: max(0, s - 1) for s in range(span + 1)})


def _target(backwards: bool, insult: float = 1.5) -> Transducer:
    """Hostile words that a target stands before (or, read backwards, after) are aimed at it.

    An aimed insult weighs more.
    """
    arcs = {(s, TARGET): (1, TARGET, 1.0) for s in (0, 1)}
    arcs |= {(1, INSULT): (1, AIMED_INSULT, insult), (1, THREAT): (1, AIMED_THREAT, 1.0)}
    return Transducer(arcs, {0: 0, 1: 1}, backwards)


def _aimless(factor: float = 0.2) -> Transducer:
    """A threat against no one counts little."""
    return Transducer({(0, THREAT): (0, THREAT, factor)}, {0: 0})


def _negation(span: int = 3, factor: float = 0.4) -> Transducer:
    """Hostile words within ``span`` words after a negation weigh less."""
    arcs = {(s, NEGATION): (span, NEGATION, 1.0) for s in range(span + 1)}
    arcs |= {(s, k): (s - 1, k, factor) for s in range(1, span + 1) for k in HOSTILE}
    return Transducer(arcs, {s: max(0, s - 1) for s in range(span + 1)})


def _reported(factor: float = 0.6) -> Transducer:
    """Hostile words after a verb of saying, to the clause's end, weigh less."""
    arcs = {(s, REPORT): (1, REPORT, 1.0) for s in (0, 1)} | {(1, k): (1, k, factor) for k in HOSTILE}
    return Transducer(arcs, {0: 0, 1: 1})


#: Composed in this order; the classes of their input come from the lexicon.
CASCADE = {
    "insult": _insult(),
    "threat": _threat(),
    "target before": _target(False),
    "target after": _target(True),
    "aimless threat": _aimless(),
    "negation": _negation(),
    "reported speech": _reported(),
}


def clause_parts(symbols: list[Symbol], without: str = "") -> tuple[float, float, float]:
    """(insults, threats, aimed) of one clause: what leaves the composed transducers by class.

    ``without`` leaves one transducer out.
    """
    for name, transducer in CASCADE.items():
        if name != without:
            symbols = transducer(symbols)
    hostile = Counter()
    for kind, weight in symbols:
        hostile[kind] += weight
    insults = hostile[INSULT] + hostile[AIMED_INSULT]
    return insults, hostile[THREAT] + hostile[AIMED_THREAT], hostile[AIMED_INSULT] + hostile[AIMED_THREAT]


def clause_score(symbols: list[Symbol], without: str = "") -> float:
    """Weight of one clause after all transducers."""
    insults, threats, _ = clause_parts(symbols, without)
    return insults + threats


_CLOSED = ((NEGATION, NEGATIONS), (REPORT, REPORTS), (TARGET, TARGETS), (INTENT, INTENTS))


class _Lexer(dict):
    """Raw token -> (class, weight, whether a clause ends here), remembered up to a bound."""

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        self.stems = stems

    def __missing__(self, token: str) -> tuple[int, float, bool]:
        if len(self) > 400_000:
            self.clear()
        kind, weight = PLAIN, 0.0
        for word in _WORD.findall(token):
            found = max((self.stems.get(s, 0.0) for s in stems_of(word)), default=0.0)
            if found > weight:
                kind, weight = INSULT, found
        bare = token.strip("\"'()[]«»“”" + _ENDS)
        if bare in THREATS:  # the learned weight is a threat's too
            kind, weight = THREAT, max(1.0, weight)
        elif kind == PLAIN:
            kind = next((k for k, words in _CLOSED if bare in words), PLAIN)
        self[token] = value = (kind, weight, token[-1] in _ENDS)
        return value


def stems_of(word: str) -> list[str]:
    """What the lexicon knows a word by: itself, and its beginnings of STEM_SIZES letters."""
    return [word, *(word[:n] + "*" for n in STEM_SIZES if len(word) > n)] if len(word) > 2 else []


@dataclass
class Model:
    """Weights of stems, and of the document features in the logistic score (the last is the bias)."""

    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [0.0] * N_FEATURES + [-4.0])

    def __post_init__(self) -> None:
        self._lexer = _Lexer(self.stems)

    def __reduce__(self):
        return Model, (self.stems, self.weights)

    def symbols(self, text: str) -> list[list[Symbol]]:
        """The clauses that hold a hostile word, as symbols."""
        lexer = self._lexer
        found = [lexer[t] for t in text.lower().replace("\n", " \n. ").split()]
        clauses, clause, hostile = [], [], False
        if not any(kind in HOSTILE for kind, _, _ in found):
            return clauses
        for kind, weight, ends in found:
            clause.append((kind, weight))
            hostile = hostile or kind in HOSTILE
            if ends:
                if hostile:
                    clauses.append(clause)
                clause, hostile = [], False
        return [*clauses, clause] if hostile else clauses

    def clauses(self, text: str) -> list[float]:
        """Scores of the clauses that hold a hostile word."""
        return [clause_score(c) for c in self.symbols(text)]

    def features(self, text: str | None) -> tuple[float, ...]:
        """Highest clause, sum and number of clauses; then, each apart, threats, aimed words, and what was softened."""
        clauses = self.symbols(text or "")
        if not clauses:
            return (0.0,) * N_FEATURES
        parts = [clause_parts(c) for c in clauses]
        scores = [insults + threats for insults, threats, _ in parts]
        threats, aimed = (math.log1p(sum(p[k] for p in parts)) for k in (1, 2))
        raw = sum(w for c in clauses for kind, w in c if kind in HOSTILE)
        softened = math.log1p(max(0.0, raw - sum(scores)))
        return max(scores), math.log1p(sum(scores)), math.log1p(len(scores)), threats, aimed, softened

    def score(self, text: str | None) -> float:
        """0 to 1; label 1 is likelier the higher."""
        *weights, bias = self.weights
        z = bias + sum(w * x for w, x in zip(weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _known(labels: DataFrame) -> DataFrame:
    """_labelled and _toxic of the ids labelled outside the held-out fold."""
    labels = labels.select("doc_id", "toxic")
    kept = labels.filter((fold_of(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("toxic").isNotNull())
    return kept.groupBy(F.col("doc_id").alias("_labelled")).agg(F.max("toxic").alias("_toxic"))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(_labelled, _text, _toxic) of the rows with these ids, none of which are in the held-out fold."""
    rows = docs.select(F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.filter(fold_of(F.col("_doc"), FOLDS) != HELD_OUT)
    return rows.join(ids, F.col("_doc") == F.col("_labelled")).select("_labelled", "_text", "_toxic")


def _sample(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(text, toxic) of at most MOST_TOXIC + MOST_CLEAN labelled rows.

    Rows are chosen by a hash of their id.  Only ids are broadcast, at most as many.
    """
    order = [F.xxhash64("_labelled"), F.col("_labelled")]
    toxic = known.filter("_toxic = 1").orderBy(*order).limit(MOST_TOXIC)
    clean = known.filter("_toxic = 0").orderBy(*order).limit(MOST_CLEAN)
    return _texts(docs, F.broadcast(toxic.unionByName(clean)))


def _count_stems(rows: DataFrame) -> DataFrame:
    def handed(counts: dict[str, list[int]]) -> pa.RecordBatch:
        columns = [pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))]
        return pa.RecordBatch.from_arrays(columns, names=["stem", "clean", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("_text").to_pylist(), batch.column("_toxic").to_pylist()):
                for s in {s for w in set(_WORD.findall(text.lower())) for s in stems_of(w)}:
                    if s not in counts:
                        counts[s] = [0, 0]
                    counts[s][bool(toxic)] += 1
            if len(counts) > HELD_STEMS:
                yield handed(counts)
                counts = {}
        yield handed(counts)

    counted = rows.mapInArrow(run, "stem string, clean long, toxic long")
    return counted.groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5) -> list[float]:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w += np.linalg.solve(hessian, x.T @ (y - p) - ridge @ w)
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn the insult lexicon and the score from ``labels`` (doc_id, toxic) outside the held-out fold.

    A stem counts by the lower bound of its log ratio of document frequencies in toxic and clean
    rows, over all labelled rows, and needs LEAST_DOCS toxic ones however many there are; the score
    is fitted on a sample.  Without labels of both kinds nothing is learned and no text is toxic.
    """
    small_batches(docs.sparkSession)
    known = _known(labels)
    labelled = _texts(docs, known.hint("shuffle_hash"))  # the same plan, without a sort of texts, at every size
    sizes = {r["_toxic"]: r["count"] for r in labelled.groupBy("_toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model()
    rate = lambda c, n: (F.col(c) + 0.5) / (n + 1)
    ratio = F.log(rate("toxic", toxic) / rate("clean", clean))
    doubt = F.sqrt(1 / F.col("toxic") + 1 / (F.col("clean") + 0.5))
    found = (
        _count_stems(labelled)
        .filter((F.col("toxic") >= LEAST_DOCS) & (ratio >= math.log(LEAST_RATIO)))
        .select("stem", (ratio - doubt).alias("weight"))
        .filter(F.col("weight") >= LEAST_WEIGHT)
        .collect()
    )
    model = Model({r["stem"]: round(r["weight"], 6) for r in found})

    names = [f"f{k}" for k in range(N_FEATURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.features(t) for t in batch.column("_text").to_pylist()]
            columns = list(zip(*rows)) or [()] * N_FEATURES
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column("_labelled").cast(pa.string())),
                    batch.column("_toxic").cast(pa.int64()),
                    *(pa.array(c, pa.float64()) for c in columns),
                ],
                names=["id", "y", *names],
            )

    found = _sample(docs, known).mapInArrow(run, f"id string, y long, {', '.join(f'{n} double' for n in names)}")
    found = found.groupBy("id").agg(F.max(F.struct("y", *names)).alias("x")).select("x.*")  # a repeated id is one row
    rows = found.toArrow().sort_by([(n, "ascending") for n in ("y", *names)])
    data = np.column_stack([c.to_numpy() for c in rows.columns]).astype(float)
    return Model(model.stems, _fit_logistic(data[:, 1:], data[:, 0]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text; only the text decides.

    Null and empty texts have the score of a text without hostile clauses; repeated rows score
    alike; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "held_out")),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    held_out = (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out, F.col("text").alias("_text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, all columns unchanged."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            yield batch.filter(pa.array([model.score(t) < 0.5 for t in texts], pa.bool_()))

    rows, schema, _ = text_beside_row(docs)
    return rows.mapInArrow(run, schema).select("row.*")
