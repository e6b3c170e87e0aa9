"""Quality classifier by co-training a text view and a metadata view.

Two logistic regressions see different sides of a document: its text (shares of byte values, word
and line statistics) and its metadata (hashed language, source, both together, length). Both start from
the labelled sample. In each round both score every document of the table in one distributed pass, and each
hands pseudo-labelled documents to the other's training set. Then each view is calibrated on labelled rows kept
apart (Platt scaling), the calibrated log-odds are combined by a third regression on the same rows,
whose weights are not negative, and all documents are scored in one more pass.

What keeps the exchange from doing harm: confidence is read off calibrated probabilities; a view hands over a
class only where its picks among the rows kept apart have a precision of `sure` at least and at most half the
errors of guessing that class; classes go over in the labelled ratio, so a view that is sure of one class only
hands over nothing; and a view keeps what it was given only if its loss on the rows kept apart does not rise.

What is bounded: at most labelled_rows labelled rows, drawn by a hash from all, and at most handed_rows
pseudo-labelled ones for each view and round, drawn by a hash from all documents that qualify; their features (a
few hundred numbers each) are fitted at the driver. Every document is a candidate and is scored.

Defined results: a null or empty text has features of zero; null metadata has buckets of its own;
a document with labels that disagree is not used for fitting; of rows with one labelled id, the first by a hash
of text and metadata is fitted; without labels of both classes every document gets score 1 and is kept;
repeated rows are scored alike; an empty table gives an empty result; the input's columns are passed on
first, in their order, and one whose name the result needs gets underscores after its name.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backleaf.llm.common import beside, parts, stage

_SHAPE = 8
TEXT_WIDTH = 256 + _SHAPE
_BUCKETS, _LENGTHS = 64, 24


def text_features(texts: list[str | None]) -> np.ndarray:
    """Square roots of byte shares, then shape: words, their length, repetition, capitals, lines."""
    out = np.zeros((len(texts), TEXT_WIDTH))
    for row, text in zip(out, texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        if not words:
            continue
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        n, lines = len(words), [x for x in raw.split(b"\n") if x.strip()]
        row[:256] = np.sqrt(counts / len(raw))
        capitals = counts[65:91].sum()
        row[256:] = (
            np.log1p(n),
            (len(raw) - counts[[9, 10, 11, 12, 13, 32]].sum()) / n,
            len(set(words)) / n,
            sum(map(bytes.__eq__, words, words[1:])) / n,
            capitals / len(raw),
            min(1.0, capitals / n),
            len(set(lines)) / len(lines),
            np.log1p(n / len(lines)),
        )
    return out


def _bucket(kind: str, value: object) -> int:
    return zlib.crc32(f"{kind}={value!r}".encode()) % _BUCKETS


def meta_features(columns: list[tuple[str, list]], lengths: list) -> np.ndarray:
    """One-hot: a bucket for each named column's value and for all of them together, and the length's power of two."""
    columns = [*columns, ("all", list(zip(*(values for _, values in columns))))] if len(columns) > 1 else columns
    n, width = len(lengths), len(columns) * _BUCKETS
    out = np.zeros((n, width + _LENGTHS))
    for k, (name, values) in enumerate(columns):
        known = {v: _bucket(name, v) for v in set(values)}
        out[np.arange(n), [k * _BUCKETS + known[v] for v in values]] = 1
    out[np.arange(n), [width + (_LENGTHS - 1 if x is None else min(_LENGTHS - 2, max(0, int(x)).bit_length())) for x in lengths]] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Logistic:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25, rising: bool = False) -> Logistic:
        """Newton's method on the mean loss with an L2 penalty / n; rising: features that would get a negative weight get none."""
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = np.c_[(x - mean) / scale, np.ones(len(x))]
        w, ridge = np.zeros(z.shape[1]), np.r_[np.full(z.shape[1] - 1, penalty), 1e-6]
        for _ in range(steps):
            p = _sigmoid(z @ w)
            step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        if rising and (w[:-1] < 0).any():
            use = w[:-1] > 0
            rest = cls.fit(x[:, use], y, penalty, steps, True)
            w[:-1] = 0
            w[:-1][use], w[-1] = rest.weights, rest.bias
        return cls(mean, scale, w[:-1], float(w[-1]))

    def logit(self, x: np.ndarray) -> np.ndarray:
        # Row by row, so that a row's value does not depend on its neighbours.
        return ((x - self.mean) / self.scale * self.weights).sum(1) + self.bias


@dataclass
class CoTrained:
    """Both views, their calibrations (slope and offset of log-odds) and their combination."""

    text: Logistic
    meta: Logistic
    calibrations: tuple[Logistic, Logistic]
    both: Logistic

    def scores(self, text_x: np.ndarray, meta_x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality: by text, by metadata, combined."""
        a = self.calibrations[0].logit(self.text.logit(text_x)[:, None])
        b = self.calibrations[1].logit(self.meta.logit(meta_x)[:, None])
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.both.logit(np.c_[a, b]))


class Exchange:
    """Co-training over labelled rows; candidates come from picks() and go to learn(), round by round."""

    def __init__(self, text_x: np.ndarray, meta_x: np.ndarray, y: np.ndarray, sure: float = 0.95, least: int = 8):
        self.x, self.y, self.sure, self.least = (text_x, meta_x), y, sure, least
        self.apart = np.arange(len(y)) % 3 == 0
        self.extra: list[dict[int, tuple[np.ndarray, int]]] = [{}, {}]  # by view: rows that the other has labelled
        self.models = [self._fitted(k, {}) for k in (0, 1)]
        self.platt = [self._calibrated(k, m) for k, m in enumerate(self.models)]

    def _fitted(self, k: int, extra: dict[int, tuple[np.ndarray, int]]) -> Logistic:
        rows = [self.x[k][~self.apart], *(x[None, :] for x, _ in extra.values())]
        return Logistic.fit(np.concatenate(rows), np.r_[self.y[~self.apart], [label for _, label in extra.values()]].astype(float))

    def _calibrated(self, k: int, model: Logistic) -> Logistic:
        return Logistic.fit(model.logit(self.x[k][self.apart])[:, None], self.y[self.apart], rising=True)

    def _loss(self, k: int, model: Logistic, platt: Logistic) -> float:
        z = platt.logit(model.logit(self.x[k][self.apart])[:, None])
        return float(np.logaddexp(0, np.where(self.y[self.apart] == 1, -z, z)).mean())

    def sureness(self, k: int, x: np.ndarray) -> np.ndarray:
        """A view's calibrated probabilities of class 1."""
        return _sigmoid(self.platt[k].logit(self.models[k].logit(x)[:, None]))

    def thresholds(self) -> list[tuple[float, float]]:
        """Of each view the least probabilities of class 0 and 1 from which its picks of the rows kept apart are right often enough; 2 for none."""
        out, y = [], self.y[self.apart]
        for k in (0, 1):
            p = self.sureness(k, self.x[k][self.apart])
            of_view = []
            for label in (0, 1):
                trust = p if label else 1 - p
                order = np.argsort(-trust, kind="stable")
                right = np.cumsum(y[order] == label)
                n = np.arange(1, len(y) + 1)
                need = max(self.sure, 1 - (1 - (y == label).mean()) / 2)
                ends = np.r_[trust[order][1:] < trust[order][:-1], True]  # ties stand or fall together
                good = np.flatnonzero((n >= self.least) & (right >= need * n) & ends)
                of_view.append(float(max(trust[order][good[-1]], 0.5)) if len(good) else 2.0)
            out.append((of_view[0], of_view[1]))
        return out

    def picks(self, text_x: np.ndarray, meta_x: np.ndarray, thresholds: list[tuple[float, float]]) -> np.ndarray:
        """(rows, views): the class a view hands a row over with, or -1."""
        out = np.full((len(text_x), 2), -1, np.int8)
        for k, x in enumerate((text_x, meta_x)):
            p = self.sureness(k, x)
            out[p >= thresholds[k][1], k] = 1
            out[1 - p >= thresholds[k][0], k] = 0
        return out

    def learn(self, keys: list[int], text_x: np.ndarray, meta_x: np.ndarray, picks: np.ndarray, most: int) -> list[int]:
        """Hands over, in the order given, at most `most` rows of each view in the labelled ratio; returns how many each view kept."""
        bad, good = (max(1, int((self.y[~self.apart] == c).sum())) for c in (0, 1))
        kept = []
        for giver, taker in ((0, 1), (1, 0)):
            of = [[i for i in np.flatnonzero(picks[:, giver] == c) if keys[i] not in self.extra[taker]] for c in (0, 1)]
            units = min(len(of[0]) / bad, len(of[1]) / good, most / (bad + good))
            chosen = [(i, c) for c, share in ((0, bad), (1, good)) for i in of[c][: int(units * share)]]
            kept.append(0)
            if chosen:
                extra = self.extra[taker] | {keys[i]: ((text_x, meta_x)[taker][i], c) for i, c in chosen}
                model = self._fitted(taker, extra)
                platt = self._calibrated(taker, model)
                if self._loss(taker, model, platt) <= self._loss(taker, self.models[taker], self.platt[taker]):
                    self.extra[taker], self.models[taker], self.platt[taker] = extra, model, platt
                    kept[-1] = len(chosen)
        return kept

    def result(self) -> CoTrained:
        """A view has a part in the combination only where it earns it: likelihood on the rows kept apart less 2 for each view is largest."""
        z, y = np.c_[tuple(self.platt[k].logit(self.models[k].logit(self.x[k][self.apart])[:, None]) for k in (0, 1))], self.y[self.apart]
        options = []
        for use in ([True, False], [False, True], [True, True]):
            both = Logistic.fit(np.where(use, z, 0.0), y, rising=True)
            likelihood = -np.logaddexp(0, np.where(y == 1, -1, 1) * both.logit(np.where(use, z, 0.0))).sum()
            both.weights = np.where(use, both.weights, 0.0)
            options.append((likelihood - 2 * sum(use), both))
        return CoTrained(self.models[0], self.models[1], (self.platt[0], self.platt[1]), max(options, key=lambda o: o[0])[1])


def exchange_of(text_x: np.ndarray, meta_x: np.ndarray, y: np.ndarray, **options) -> Exchange | None:
    """None if a class is missing among the rows that fit or those kept apart, a third of all."""
    apart = np.arange(len(y)) % 3 == 0
    return Exchange(text_x, meta_x, y, **options) if len(set(y[apart])) == 2 and len(set(y[~apart])) == 2 else None


def co_train(text_x: np.ndarray, meta_x: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = 3, handed_rows: int = 1000, **options) -> CoTrained | None:
    """Co-training with a pool in memory; y has 0 and 1. None as in exchange_of()."""
    state = exchange_of(text_x, meta_x, y, **options)
    if state is None:
        return None
    for _ in range(rounds):
        if not sum(state.learn(list(range(len(pool_text))), pool_text, pool_meta, state.picks(pool_text, pool_meta, state.thresholds()), handed_rows)):
            break
    return state.result()


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, meta_cols: tuple[str, ...], length_col: str, labelled_rows: int, handed_rows: int, rounds: int, seed: int) -> CoTrained | None:
    """Draws the labelled sample by hash, then lets the views exchange rows of all documents."""
    by_hash = F.xxhash64(F.lit(seed), F.col("id"))
    agreed = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
    drawn = stage(agreed.select("id", "y").orderBy(by_hash, "id").limit(labelled_rows), "labels")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *[docs[c].alias(f"m{i}") for i, c in enumerate(meta_cols)], docs[length_col].alias("length"))
    key = F.xxhash64(F.lit(seed), *rows.columns)
    # drawn has labelled_rows rows at most: small whatever the input.
    rows = rows.withColumn("key", key).join(F.broadcast(drawn), "id", "left")

    def features_of(b) -> np.ndarray:
        m = meta_features([(c, b.column(f"m{i}").to_pylist()) for i, c in enumerate(meta_cols)], b.column("length").to_pylist())
        return np.c_[text_features(b.column("text").to_pylist()), m].astype("<f4")

    def gathered(got: list) -> np.ndarray:
        return np.frombuffer(b"".join(r.x for r in got), "<f4").reshape(len(got), -1 if got else TEXT_WIDTH).astype(float)

    def featured(batches):
        import pyarrow as pa

        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), b.column("key"), pa.array([r.tobytes() for r in features_of(b)], pa.binary())], names=["id", "y", "key", "x"])

    # One row for each labelled id, whatever its rows in docs: the first by hash, found before features are made.
    known = rows.where("y is not null")
    first = known.groupBy("id").agg(F.min_by(F.struct(*[c for c in known.columns if c != "id"]), "key").alias("r")).select("id", "r.*")
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("y", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("x", T.BinaryType())])
    got = first.mapInArrow(featured, schema).orderBy(by_hash, "id").limit(labelled_rows).collect()
    x, y = gathered(got), np.array([r.y for r in got])
    state = exchange_of(x[:, :TEXT_WIDTH], x[:, TEXT_WIDTH:], y)
    if state is None:
        return None
    unlabelled = rows.where("y is null").drop("id", "y")
    for _ in range(rounds):
        at = state.thresholds()
        if not any(max(t) <= 1 for t in at):  # no view may hand over both classes
            break
        quota = 20 + 4 * handed_rows // max(1, unlabelled.rdd.getNumPartitions())

        def picked(batches, state=state, at=at, quota=quota):
            """Of a partition the first rows by hash of each view and class, about four times its share of what is handed over."""
            import pyarrow as pa

            held: dict[tuple[int, int], list] = {(k, c): [] for k in (0, 1) for c in (0, 1)}
            for b in parts(batches):
                both = features_of(b).astype(float)
                picks = state.picks(both[:, :TEXT_WIDTH], both[:, TEXT_WIDTH:], at)
                keys = b.column("key").to_pylist()
                for (k, c), best in held.items():
                    best += [(keys[i], both[i].astype("<f4").tobytes()) for i in np.flatnonzero(picks[:, k] == c)]
                    best.sort()
                    del best[quota:]
            out = [(key, k, c, x) for (k, c), best in held.items() for key, x in best]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["key", "view", "label", "x"])

        found = stage(unlabelled.mapInArrow(picked, "key long, view int, label int, x binary"), "picked")
        got = [r for k in (0, 1) for c in (0, 1) for r in found.where((F.col("view") == k) & (F.col("label") == c)).orderBy("key", "x").limit(handed_rows).collect()]
        if not got:
            break
        x = gathered(got)
        picks = np.full((len(got), 2), -1, np.int8)
        picks[np.arange(len(got)), [r.view for r in got]] = [r.label for r in got]
        if not sum(state.learn([r.key for r in got], x[:, :TEXT_WIDTH], x[:, TEXT_WIDTH:], picks, handed_rows)):
            break
    return state.result()


def classify(
    df: DataFrame,
    labels: DataFrame,
    training: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    meta_cols: tuple[str, ...] = ("lang", "source"),
    length_col: str = "n_chars",
    min_score: float = 0.5,
    labelled_rows: int = 6000,
    handed_rows: int = 1000,
    rounds: int = 3,
    seed: int = 11,
    keep_columns: tuple[str, ...] | None = None,
) -> DataFrame:
    """df (or its keep_columns) with text_score, meta_score, score and kept (score >= min_score).

    labels: id_col and label_col (1: good). training: the documents that labels speak of, df if not given.
    """
    columns = ("text_score", "meta_score", "score", "kept")
    keep = [f for f in df.schema.fields if keep_columns is None or f.name in keep_columns]
    names = beside([f.name for f in keep], columns)
    model = fit(df if training is None else training, labels, id_col, text_col, label_col, meta_cols, length_col, labelled_rows, handed_rows, rounds, seed)
    schema = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, keep)] + [T.StructField(c, T.BooleanType() if c == "kept" else T.DoubleType()) for c in columns])

    def scored(batches):
        import pyarrow as pa

        for b in parts(batches):
            n = b.num_rows
            if model is None:
                scores = (np.ones(n),) * 3
            else:
                m = meta_features([(c, b.column(c).to_pylist()) for c in meta_cols], b.column(length_col).to_pylist())
                scores = model.scores(text_features(b.column(text_col).to_pylist()), m)
            arrays = [b.column(f.name) for f in keep] + [pa.array(s) for s in scores] + [pa.array(scores[2] >= min_score)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.mapInArrow(scored, schema)
