"""Toxicity by weak supervision.

1. Voters look at a text and vote toxic or abstain: word lists, patterns, and
   groups of word stems that labelled rows of the learning fold single out.
2. A generative label model explains the votes of all documents by a hidden class.
   It estimates, without trusting any voter, each one's hit rates under both
   classes (accuracy), finds pairs that still agree once the class is known, and
   models such voters jointly (correlation).  Labels enter as one more voter, an
   annotator with error rates of its own.
3. A linear classifier over word and stem features learns from the posterior
   labels and scores every whole text.

Only counts of vote patterns (at most 2^voters) and the features of a bounded
sample reach the driver; the model sent to the tasks has a constant bound.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import sampled, text_of

#: Labelled rows of the learning fold that are used at most (least hash of the id first).
FIT_ROWS = 16_000
#: Size of the hashed feature space.
SPACE = 1 << 20
#: Standard errors by which a feature must depart from independence to be used.
SIGNIFICANT = 5.0
#: Features the classifier may use at most, and stems the voters may use at most.
FEATURES, STEMS = 8192, 1024
#: Words that a task remembers.
REMEMBERED = 200_000
FOLDS = 5

# Word lists of the lexicon voters.
LEXICONS = {
    "intellect": "idiot idiots moron morons stupid dumb fool imbecile dumme dummkopf trottel blöd stupide crétin imbécile "
    "estúpido tonto idiota",
    "worth": "loser losers worthless pathetic useless failure nichtsnutz wertlos minable nul inútil patético perdedor",
    "contempt": "scum trash clown garbage vermin filth abschaum müll ordure déchet escoria basura payaso",
    "disgust": "disgusting repulsive vile sickening ekelhaft widerlich dégoûtant répugnant asqueroso repugnante",
    "threat": "kill hurt destroy beat die sterben töten tuer crever matar morir",
    "profanity": "damn hell crap bastard bitch asshole shit fuck arschloch scheiße merde connard mierda cabrón",
}
_WORD = re.compile(r"\w+")
_INSULT = re.compile(r"\b(?:you|you're|youre|he|she|they)\b(?:\W+\w+){0,3}?\W+(\w+)", re.IGNORECASE)
_SHOUT = re.compile(r"(?:\b[A-ZÄÖÜÉÈ]{3,}\b[\s,.]*){3}!")
_MARKS = re.compile(r"!{3,}")
#: Groups that the stems found in labelled rows are dealt to.
STEM_GROUPS = 6


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word: itself and its stems of 4 to 6 characters."""
    forms = {f"w {word}", *(f"s {word[:n]}" for n in (4, 5, 6) if len(word) > n)}
    return tuple(sorted({zlib.crc32(f.encode()) % SPACE for f in forms}))


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(text: str, known: dict[str, tuple[int, ...]] | None = None) -> np.ndarray:
    """Distinct features of a text, ascending; ``known`` remembers words."""
    known = {} if known is None else known
    if len(known) > REMEMBERED // 4:
        known.clear()
    found: set[int] = set()
    for w in words_of(text):
        f = known.get(w)
        if f is None:
            f = known[w] = word_features(w)
        found.update(f)
    return np.fromiter(sorted(found), np.uint32, len(found))


# -- voters ---------------------------------------------------------------------
@dataclass(frozen=True)
class Voters:
    """Votes of a text as bits: lexicons, stem groups, then patterns."""

    stems: dict[int, int]  # feature to group
    lexicon: dict[str, int] = field(
        default_factory=lambda: {w: 1 << k for k, ws in enumerate(LEXICONS.values()) for w in ws.split()}
    )

    @property
    def count(self) -> int:
        return len(LEXICONS) + STEM_GROUPS + 3

    def of_word(self, word: str) -> int:
        bits = self.lexicon.get(word, 0)
        for f in word_features(word):
            if f in self.stems:
                bits |= 1 << (len(LEXICONS) + self.stems[f])
        return bits

    def patterns(self, text: str, bits: int) -> int:
        first = len(LEXICONS) + STEM_GROUPS
        if bits & ((1 << len(LEXICONS)) - 1) and any(m[1].lower() in self.lexicon for m in _INSULT.finditer(text)):
            bits |= 1 << first
        if "!" in text:
            if _SHOUT.search(text):
                bits |= 1 << (first + 1)
            if "!!!" in text and _MARKS.search(text):
                bits |= 1 << (first + 2)
        return bits

    def votes(self, text: str, known: dict[str, int]) -> int:
        """``known`` remembers the bits of words."""
        if len(known) > REMEMBERED:
            known.clear()
        bits = 0
        for w in words_of(text):
            b = known.get(w)
            if b is None:
                b = known[w] = self.of_word(w)
            bits |= b
        return self.patterns(text, bits)


# -- label model ------------------------------------------------------------------
class LabelModel:
    """Hidden class with voters that are independent given it, but for cliques modelled jointly."""

    CLIQUE = 4
    DEPENDENT = 0.1

    def __init__(self, voters: int):
        self.voters = voters
        self.cliques = [[v] for v in range(voters)]
        self.prior = 0.1
        self.tables: list[np.ndarray] = []
        self.annotator = np.array([[0.95, 0.05], [0.05, 0.95]])  # class, label

    def _codes(self, bits: np.ndarray) -> list[np.ndarray]:
        return [sum(((bits >> v) & 1) << k for k, v in enumerate(c)) for c in self.cliques]

    def _fit(self, bits, n, gold, start, rounds=200):
        """EM over vote patterns ``bits`` with weights ``n``; ``gold``: label of a pattern's rows, -1 for none."""
        codes, p = self._codes(bits), start
        for _ in range(rounds):
            w = np.stack([n * (1 - p), n * p])
            self.prior = float(np.clip(w[1].sum() / max(1e-9, w.sum()), 1e-4, 0.5))
            self.tables = []
            for c, code in zip(self.cliques, codes):
                t = np.stack([np.bincount(code, w[y], 1 << len(c)) for y in (0, 1)]) + 0.1
                self.tables.append(t / t.sum(axis=1, keepdims=True))
            marked = gold >= 0
            if marked.any():
                a = np.stack([np.bincount(gold[marked], w[y][marked], 2) for y in (0, 1)]) + np.array([[19, 1], [1, 19]])
                self.annotator = a / a.sum(axis=1, keepdims=True)
            new = self.posterior(bits, gold)
            if np.abs(new - p).max() < 1e-6:
                break
            p = new
        return p

    def fit(self, bits: np.ndarray, n: np.ndarray, gold: np.ndarray) -> None:
        if not len(bits):
            return
        some = bits > 0
        start = np.where(gold == 1, 0.95, np.where(gold == 0, 0.05, np.where(some, 0.6, 0.02)))
        self.cliques = self._dependent(bits, n)
        self._fit(bits, n, gold, start)

    def _dependent(self, bits, n) -> list[list[int]]:
        """Cliques of voters that correlate given the class, strongest pairs first.

        Voters that depend on the class alone have covariances a_i * a_j.  Each a is
        taken from triples of voters (a low quantile, as dependent pairs push it
        up); what a pair's covariance has beyond the product is its own.
        """
        votes = ((bits[:, None] >> np.arange(self.voters)) & 1).astype(float)
        mean = n @ votes / n.sum()
        cov = (votes * n[:, None]).T @ votes / n.sum() - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
        seen = [v for v in range(self.voters) if mean[v] * n.sum() >= 20]
        share = np.full(self.voters, np.nan)
        for i in seen:
            rest = [j for j in seen if j != i and cov[i, j] > 0]
            squares = [cov[i, j] * cov[i, k] / cov[j, k] for j in rest for k in rest if j < k and cov[j, k] > 1e-9]
            if squares:
                share[i] = np.sqrt(np.quantile(squares, 0.33))
        strength = np.nan_to_num((cov - np.outer(share, share)) / np.outer(sd, sd))
        cliques = {v: [v] for v in range(self.voters)}
        pairs = [(strength[i, j], i, j) for i in range(self.voters) for j in range(i)]
        for s, i, j in sorted(pairs, reverse=True):
            if s < self.DEPENDENT:
                break
            if cliques[i] is not cliques[j] and len(cliques[i]) + len(cliques[j]) <= self.CLIQUE:
                both = cliques[i] + cliques[j]
                for v in both:
                    cliques[v] = both
        return list({id(c): c for c in cliques.values()}.values())

    def posterior(self, bits: np.ndarray, gold: np.ndarray) -> np.ndarray:
        odds = np.full(len(bits), np.log(self.prior / (1 - self.prior)))
        for code, t in zip(self._codes(bits), self.tables):
            odds += np.log(t[1][code] / t[0][code])
        known = gold >= 0
        odds[known] += np.log(self.annotator[1][gold[known]] / self.annotator[0][gold[known]])
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


# -- classifier -------------------------------------------------------------------
def associated(rows: list[np.ndarray], target: np.ndarray, most: int, positive: bool) -> np.ndarray:
    """Features whose rate departs most from independence of the target."""
    if not rows or not 0 < target.sum() < len(rows):
        return np.zeros(0, dtype=np.uint32)
    df, hit = np.zeros(SPACE), np.zeros(SPACE)
    for at in range(0, len(rows), 1000):
        part = rows[at : at + 1000]
        flat = np.concatenate(part)
        df += np.bincount(flat, minlength=SPACE)
        hit += np.bincount(flat, np.repeat(target[at : at + 1000], [len(r) for r in part]), SPACE)
    rate = target.mean()
    z = (hit - df * rate) / np.sqrt(np.maximum(df * rate * (1 - rate), 1e-9))
    z = np.where(df >= 5, z, 0.0)
    order = np.argsort(-(z if positive else np.abs(z)), kind="stable")[:most]
    return order[(z if positive else np.abs(z))[order] >= SIGNIFICANT].astype(np.uint32)


def fit_linear(rows: list[np.ndarray], target: np.ndarray, rounds: int = 600) -> tuple[dict[int, float], float]:
    """Logistic regression on present features with soft labels; weights and bias."""
    rate = float(np.clip(target.mean() if len(target) else 0.05, 1e-3, 1 - 1e-3))
    bias = np.log(rate / (1 - rate))
    chosen = np.sort(associated(rows, target, FEATURES, positive=False))
    if not len(chosen):
        return {}, float(bias)
    place = np.full(SPACE, -1, dtype=np.int64)
    place[chosen] = np.arange(len(chosen))
    kept = [c[c >= 0] for c in (place[r] for r in rows)]
    row = np.repeat(np.arange(len(rows)), [len(c) for c in kept])
    col = np.concatenate(kept)
    weight, grad_w, sq_w = np.zeros(len(chosen)), np.zeros(len(chosen)), np.zeros(len(chosen))
    grad_b = sq_b = 0.0
    for t in range(1, rounds + 1):
        odds = bias + np.bincount(row, weight[col], len(rows))
        off = (1 / (1 + np.exp(-np.clip(odds, -40, 40))) - target) / len(rows)
        g, gb = np.bincount(col, off[row], len(chosen)) + 1e-5 * weight, off.sum()
        grad_w, sq_w = 0.9 * grad_w + 0.1 * g, 0.99 * sq_w + 0.01 * g * g
        grad_b, sq_b = 0.9 * grad_b + 0.1 * gb, 0.99 * sq_b + 0.01 * gb * gb
        step = 0.1 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        weight -= step * grad_w / (np.sqrt(sq_w) + 1e-8)
        bias -= step * grad_b / (np.sqrt(sq_b) + 1e-8)
    return dict(zip(chosen.tolist(), weight.tolist())), float(bias)


@dataclass
class Model:
    weights: dict[int, float]
    bias: float
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def score(self, text: str) -> float:
        known, weights = self.known, self.weights
        if len(known) > REMEMBERED:
            known.clear()
        found: set[int] = set()
        for w in words_of(text):
            f = known.get(w)
            if f is None:
                f = known[w] = tuple(x for x in word_features(w) if x in weights)
            if f:
                found.update(f)
        odds = self.bias + sum(weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(odds, -40, 40))))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of at most FIT_ROWS labelled rows of the learning fold, in an order of their own."""
    marks = (
        labels.select(F.col(id_col).alias("__id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("__id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("__id")))
        .groupBy("__id")
        .agg(F.max("toxic").alias("toxic"))
    )
    marks = sampled(marks, F.col("__id"), FIT_ROWS, marks.count())
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("text"))
    found = rows.join(F.broadcast(marks), "__id").select("text", "toxic")

    def run(batches):
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            got = [features(t.as_py(), known).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), batch.column("toxic")], names=["features", "toxic"])

    got = found.mapInArrow(run, "features binary, toxic int").toArrow()
    pairs = sorted(zip(got["features"].to_pylist(), got["toxic"].to_pylist()))
    return [np.frombuffer(f, np.uint32) for f, _ in pairs], np.array([y for _, y in pairs], dtype=np.int64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, LabelModel]:
    """Voters, label model and classifier from all documents' votes and a bounded sample of labelled rows."""
    spark = docs.sparkSession
    rows, gold = _sample(docs, labels, id_col, text_col)
    stems = associated(rows, gold.astype(float), STEMS, positive=True)
    voters = Voters({int(f): int(f) % STEM_GROUPS for f in stems})
    shared = spark.sparkContext.broadcast(voters)

    def vote(batches):
        own, known = shared.value, {}
        for batch in batches:
            bits = [own.votes(t.as_py(), known) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64())], names=["bits"])

    patterns = (
        docs.select(text_of(text_col).alias("text")).mapInArrow(vote, "bits long").groupBy("bits").count().orderBy("bits").collect()
    )
    # The sample's votes, from its features: the annotator is tied to them.
    lexicon: dict[int, int] = {}
    for w, b in voters.lexicon.items():
        f = zlib.crc32(f"w {w}".encode()) % SPACE
        lexicon[f] = lexicon.get(f, 0) | b
    for f, g in voters.stems.items():
        lexicon[f] = lexicon.get(f, 0) | 1 << (len(LEXICONS) + g)
    table = np.zeros(SPACE, dtype=np.int64)
    table[list(lexicon)] = list(lexicon.values())
    own = np.array([int(np.bitwise_or.reduce(table[r])) if len(r) else 0 for r in rows], dtype=np.int64)

    model = LabelModel(voters.count)
    bits = np.concatenate([np.array([p.bits for p in patterns], dtype=np.int64), own])
    n = np.concatenate([np.array([p["count"] for p in patterns], dtype=float), np.ones(len(own))])
    model.fit(bits, n, np.concatenate([np.full(len(patterns), -1), gold]))
    target = model.posterior(own, gold) if len(own) else np.zeros(0)
    return Model(*fit_linear(rows, target)), model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, score (0 to 1, higher: more likely toxic).  NULL text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([own.score(t.as_py()) for t in batch.column("text")], pa.float64())],
                names=["id", "score"],
            )

    schema = rows.select("id").schema.add("score", "double")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def reject(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs``, all columns, without the rows whose score is ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            keep = [own.score(t.as_py() or "") < least for t in batch.column(text_col)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
