"""Toxicity of texts after noisy-channel restoration.

A writer who hides a word swaps letters for signs (``1d10t``), spaces it out (``i d i o t``) or
stretches it (``idiooot``).  Such words become lattices: every observed sign may stand for several
letters, a run may stand for one or two letters, a separator for none.  The Viterbi path under a
character language model, counted over all texts, is the restored word.  Words that can only be
read as they stand skip the lattice.

A text is scored by the words and word beginnings that labelled texts tie to toxicity.  Their weights
(log odds) come from one part of the training rows, the logistic model over a text's evidence from
another part, so that rare words don't vouch for themselves.

Bounds: at most about ``sample`` labelled rows are fitted, at most ``features`` weights are kept, and the
language model has a fixed alphabet; these are all that tasks receive.

Defined results: a null or empty text has no evidence and gets the model's score for that; labels that
are null or neither 0 nor 1 are not learned from; of rows with the same id every row is scored for
itself, and an id with several labels is learned with the largest; with no usable labels the score is
0; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise

#: The letters of the language model (0 is a word's edge, the last any other letter).
LETTERS = "abcdefghijklmnopqrstuvwxyz"
EDGE, OTHER, SIZE = 0, 27, 28
#: What a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = ".-_*~^'`,:;/\\​­"
#: Costs (negative logarithms) of the channel: a letter as it stands, a sign for a letter, a doubled letter kept, a run cut to one.
PLAIN, SIGN, DOUBLE, SHRINK, DROP = 0.05, 0.7, 0.7, 0.3, 0.1
#: Costs of a word's edge at a separator or space, and at several spaces.
WORD, GAP = 1.0, 0.1

ODD = re.compile(r"[^\W\d_]*(?:[0-9@$!|+(€£¡]|[.\-_*~^'`,:;/\\​­](?=\w))", re.UNICODE)
PAIR = re.compile(r"([^\W\d_])\1")
SPACED = re.compile(r"(?<!\S)\S(?:[ ]{1,2}\S){3,}(?!\S)")
EDGES = ".,;:!?\"'()[]{}<>«»¿¡…*#&%|~`"


# --- language model -----------------------------------------------------------------------------------


def letter_codes(text: str) -> np.ndarray:
    """Codes of a text's characters: letters, other letters as one, anything else as an edge."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    codes = np.zeros(len(points), dtype=np.int64)
    ascii_ = (points >= 97) & (points <= 122)
    codes[ascii_] = points[ascii_] - 96
    codes[points >= 0xC0] = OTHER
    return codes


def count_trigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n): counts of letter triples over all texts; a task sends one row per triple that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, dtype=np.int64)
        for b in batches:
            for t in b.column(0):
                c = np.concatenate([[EDGE, EDGE], letter_codes(t.as_py() or ""), [EDGE]])
                total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
        met = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["gram", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame, add: float = 0.1) -> np.ndarray:
    """Costs -log p(c | a, b) as an array [a, b, c]; at most 28 ** 3 rows reach the driver.

    Triples are smoothed by the letter's frequency after b.
    """
    n = np.zeros(SIZE**3)
    for gram, c in counts.collect():
        n[gram] = c
    n = n.reshape(SIZE, SIZE, SIZE)
    two = n.sum(axis=0) + add
    two = two / two.sum(axis=1, keepdims=True)
    return -np.log((n + 20 * add * two[None]) / (n.sum(axis=2, keepdims=True) + 20 * add))


# --- restoration --------------------------------------------------------------------------------------


def lattice(token: str, edges: bool = False) -> list[list[tuple[str, float]]]:
    """Per observed run the strings that it may stand for, with their costs; with ``edges`` a separator may be a space."""
    out, i = [], 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        n = j - i
        if c in SIGNS:
            ways = [(x, SIGN) for x in SIGNS[c]]
            ways += [(x * 2, SIGN + DOUBLE) for x in SIGNS[c]] if n > 1 else []
            ways += [("", 3.0)] if not c.isdigit() else []
        elif c.isalpha():
            ways = [(c, PLAIN + (SHRINK if n > 1 else 0))] + ([(c * 2, PLAIN + (DOUBLE if n > 2 else 0))] if n > 1 else [])
        else:
            ways = [("", DROP)] + ([(" ", GAP if c == " " and n > 1 else WORD)] if edges else [])
        out.append(ways)
        i = j
    return out


def decode(token: str, costs: np.ndarray, edges: bool = False) -> str:
    """The cheapest reading of a token: Viterbi over the lattice, states are the last two letters.

    Paths share their beginnings, so work and memory are linear in the token's length.
    """
    code = lambda c: EDGE if c == " " else ord(c) - 96 if "a" <= c <= "z" else OTHER
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
    for ways in lattice(token, edges):
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in best.items():
            for way, price in ways:
                x, y, total = a, b, cost + price
                for c in way:
                    k = code(c)
                    total += costs[x, y, k]
                    x, y = y, k
                if (x, y) not in step or total < step[x, y][0]:
                    step[x, y] = (total, (path, way) if way else path)
        best = step
    path = min(((cost + costs[a, b, EDGE], i, path) for i, ((a, b), (cost, path)) in enumerate(best.items())), default=(0.0, 0, None))[2]
    out = []
    while path is not None:
        path, way = path
        out.append(way)
    return "".join(reversed(out))


def readings(token: str, costs: np.ndarray) -> list[str]:
    """The words a token is scored as: itself, and its restored forms, as one word and as several, where it may hide some."""
    plain, bare = token.strip(EDGES), token.strip(".,;:?\"'()[]{}<>«»¿…*#&%~`")
    spread = any(c in SEPARATORS or c == " " for c in bare)
    if not (spread or ODD.match(bare) or ODD.match(token) or PAIR.search(token)) or not any(map(str.isalpha, token)):
        return [plain]
    several = decode(bare, costs, edges=True).split() if spread else []
    whole = token.strip(".,;:?\"'")
    return list(dict.fromkeys([plain, *several, *(decode(t, costs) for t in {whole: 0, bare: 0})]))


def tokens(text: str) -> list[str]:
    """Distinct tokens of a text; letters that are spaced out also make one token, with and without a letter at either end, and one with its spaces."""
    low = text.lower()
    out = set(low.split())
    for m in SPACED.finditer(low):
        run = m.group().replace(" ", "")
        out.update((run, run[1:], run[:-1], run[1:-1], m.group()))
    return list(out)


def features_of(word: str) -> list[str]:
    """The word, and its beginnings of four to six letters."""
    return [word, *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) > n)] if len(word) > 2 else []


# --- fitting ------------------------------------------------------------------------------------------


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept out of training: the remainder of the id's CRC-32 by four is two."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(text, toxic, part) of at most about ``sample`` labelled rows that are not held out; part 0 for weights, 1 for the model."""
    y = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    y = materialise(y.where("_id is not null"), "labels")
    share = min(1.0, sample / max(1, y.count()))
    y = y.where(F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1_000_000)) < F.lit(round(share * 1_000_000)))
    rows = docs.select(F.col(id_col).alias("_d"), F.col(text_col).cast("string").alias("text")).join(y, F.col("_d") == F.col("_id"))
    part = (F.pmod(F.xxhash64(F.lit("part"), F.col("_id").cast("string")), F.lit(2))).cast("int")
    return materialise(rows.select(F.coalesce("text", F.lit("")).alias("text"), "toxic", part.alias("part")), "training")


def _feature_counts(rows: DataFrame, costs, only=None) -> DataFrame:
    """(feature, n): in how many of the texts each feature occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[str]] = {}
        wanted = only.value if only is not None else None
        total: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0):
                found: set[str] = set()
                for token in tokens(t.as_py()):
                    f = seen.get(token)
                    if f is None:
                        f = [x for w in readings(token, costs.value) for x in features_of(w)]
                        f = f if wanted is None else [x for x in f if x in wanted]
                        if len(seen) < 500_000:
                            seen[token] = f
                    found.update(f)
                total.update(found)
                if len(total) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["feature", "n"])
                    total = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["feature", "n"])

    return rows.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def weights(rows: DataFrame, costs, features: int, least: int, odds: float) -> dict[str, float]:
    """Log odds of the features that toxic texts have at least ``least`` times and that weigh ``odds`` or more."""
    spark = rows.sparkSession
    rows = rows.where("part = 0")
    sizes = dict(rows.groupBy("toxic").count().collect())
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return {}
    often = _feature_counts(rows.where("toxic = 1"), costs).where(F.col("n") >= least)
    often = dict(often.orderBy(F.col("n").desc(), "feature").limit(20 * features).collect())
    others = dict(_feature_counts(rows.where("toxic = 0"), costs, spark.sparkContext.broadcast(frozenset(often))).collect())
    weigh = {f: math.log((n + 0.5) / (bad + 1)) - math.log((others.get(f, 0) + 0.5) / (good + 1)) for f, n in often.items()}
    best = sorted((f for f, w in weigh.items() if w >= odds), key=lambda f: (-weigh[f] * math.sqrt(often[f]), f))
    return {f: weigh[f] for f in best[:features]}


def evidence(text: str, weight: dict[str, float], costs: np.ndarray, seen: dict[str, float]) -> tuple[float, float, float]:
    """(strongest weight, sum of the weights of distinct tokens, number of tokens with weight)."""
    top = total = count = 0.0
    for token in tokens(text):
        w = seen.get(token)
        if w is None:
            w = max((weight.get(f, 0.0) for r in readings(token, costs) for f in features_of(r)), default=0.0)
            if len(seen) < 500_000:
                seen[token] = w
        if w:
            top, total, count = max(top, w), total + w, count + 1
    return top, total, count


def inputs(found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Columns of the logistic model from evidence and text sizes."""
    top, total, count = found.T
    size = np.log1p(sizes)
    return np.stack([np.ones(len(top)), top, np.log1p(total), np.log1p(count), np.log1p(total) - 0.5 * size, size], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic model by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - y) + ridge * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def share(y: np.ndarray) -> float:
    """Smoothed share of ones; 0 for no rows."""
    return float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0


def _evidence_rows(rows: DataFrame, keep: list[str], weight, costs) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, float] = {}
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(0)]
            found = np.asarray([evidence(t, weight.value, costs.value, seen) for t in texts]).reshape(-1, 3)
            extra = [pa.array(found[:, i]) for i in range(3)] + [pa.array([float(len(t)) for t in texts])]
            yield pa.RecordBatch.from_arrays([*(b.column(i + 1) for i in range(len(keep))), *extra], names=[*keep, "top", "total", "count", "size"])

    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select("text", *keep).mapInArrow(run, f"{types}, top double, total double, count double, size double")


class Model:
    """Language model, feature weights and logistic weights; all of fixed bounds.

    Texts without evidence get the share of toxic texts among such training rows.
    """

    def __init__(self, costs: np.ndarray, weight: dict[str, float], rows: np.ndarray):
        """``rows``: toxic, evidence (three columns) and size of the second part of the training rows."""
        self.costs, self.weight, self.beta = costs, weight, None
        some = rows[:, 3] > 0
        self.without, self.with_ = share(rows[~some, 0]), share(rows[some, 0])
        if len(set(rows[some, 0])) == 2:
            self.beta = fit_logistic(inputs(rows[some, 1:4], rows[some, 4]), rows[some, 0])

    def scores(self, texts: list[str], seen: dict[str, float]) -> np.ndarray:
        """Scores of texts; ``seen`` keeps the weights of tokens from call to call."""
        found = np.asarray([evidence(t, self.weight, self.costs, seen) for t in texts], dtype=float).reshape(-1, 3)
        p = np.full(len(texts), self.with_)
        if self.beta is not None:
            p = 1 / (1 + np.exp(-np.clip(inputs(found, np.asarray([float(len(t)) for t in texts])) @ self.beta, -30, 30)))
        return np.where(found[:, 2] > 0, p, self.without)

    def _whole(self, token: str) -> str:
        found = readings(token, self.costs)
        return decode(token.strip(EDGES), self.costs) if len(found) > 1 else found[0]

    def restore(self, text: str) -> str:
        """The text with every token in its cheapest reading."""
        return " ".join(self._whole(t) for t in text.lower().split())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000, features: int = 5_000, least: int = 6, odds: float = 2.0) -> Model:
    """Language model from all texts, weights and model from a bounded sample of labelled rows."""
    spark = docs.sparkSession
    costs = language_model(count_trigrams(docs, text_col))
    rows = training_rows(docs, labels, id_col, text_col, label_col, sample)
    shared = spark.sparkContext.broadcast(costs)
    weight = weights(rows, shared, features, least, odds)
    got = np.asarray(_evidence_rows(rows.where("part = 1"), ["toxic"], spark.sparkContext.broadcast(weight), shared).collect(), dtype=float).reshape(-1, 5)
    return Model(costs, weight, got)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = shared.value, {}
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            p = m.scores(texts, seen)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, **options) -> DataFrame:
    """Per row doc_id, held_out, score and predicted."""
    out = score(docs, fit(docs, labels, id_col, text_col, label_col, **options), id_col, text_col)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """The rows of the input whose text scores below the threshold."""
    model = fit(docs, labels, id_col, text_col, **options)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = shared.value, {}
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(b.schema.get_field_index(text_col))]
            if texts:
                b = b.filter(pa.array(m.scores(texts, seen) < threshold))
            yield b

    return docs.mapInArrow(run, docs.schema)
