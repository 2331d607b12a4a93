"""Quality classifier by co-training of two views.

One view sees a document's content (hashed byte trigrams), the other what a page's metadata say (source, language,
length and layout of lines). Both are logistic regressions. They start from labelled documents; in each round both score
the whole corpus, each view labels documents that it is sure of (log-odds beyond SURE), in the labels' proportion, and
these pseudo-labels join the training of both. Each view is then calibrated (Platt scaling) on labelled documents kept
apart, the calibrated log-odds are combined by a logistic regression fitted on these too, and every document is scored;
one is rejected where its probability of being good is under THRESHOLD.

`labelled` bounds the labelled documents that are fitted on (those of least hash of their id), at any corpus size; a round
adds at most GROWTH times their number for each view. Of the documents that a view is sure of, those of least hash of their
content are taken, distinct ones only, from all of the corpus. Everything is scored, whole texts.

Null and empty texts have no trigrams and are scored by what is left; null metadata are a value of their own; null ids are
scored like others. Conflicting labels of one id count as their majority, ties as good; null labels are none; of rows of one
labelled id that of least content hash is fitted on. Without labels of both kinds all documents score 1 and stay. Repeated
rows are scored alike; an empty table gives none. Other columns pass; those named like the new ones are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.llm.common import bounded_arrow, give_back, map_batches, set_aside, text_or_empty

LABELLED = 4000
ROUNDS, GROWTH, SURE = 4, 0.1, 1.0
DIMENSIONS, META = 1024, 64 + 16 + 5 * 16
THRESHOLD = 0.4
SCORES = "struct<p_text:double,p_meta:double,score:double>"


def content_features(texts: list[str | None]) -> np.ndarray:
    """Rows of unit length: square roots of the counts of hashed byte trigrams."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for k, t in enumerate(texts):
        raw = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        if len(raw) >= 3:
            h = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA77)) ^ (raw[2:] * np.uint32(0xC2B2AE3D))
            counts = np.sqrt(np.bincount(h >> np.uint32(22), minlength=DIMENSIONS))
            out[k] = counts / np.sqrt((counts**2).sum())
    return out


def _bucket(value: object, n: int) -> int:
    import zlib

    return 0 if value is None else 1 + zlib.crc32(str(value).encode()) % (n - 1)


def metadata_features(texts: list[str | None], sources: list, langs: list, chars: list) -> np.ndarray:
    """One-hot rows: source, language, and bins of length and of the lines' number, mean, greatest and blank share."""
    out = np.zeros((len(texts), META), np.float32)
    for k, (t, s, g, n) in enumerate(zip(texts, sources, langs, chars, strict=True)):
        lines = [len(x) for x in (t or "").split("\n")]
        numbers = (n or 0, len(lines), sum(lines) / len(lines), max(lines), 1000 * lines.count(0) / len(lines))
        out[k, _bucket(s, 64)] = out[k, 64 + _bucket(g, 16)] = 1
        for j, x in enumerate(numbers):
            out[k, 80 + 16 * j + min(15, int(1.2 * np.log1p(max(0.0, float(x)))))] = 1
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 120, start: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression by accelerated gradient descent; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    y, weight = y.astype(np.float32), (weight / weight.sum()).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32) if start is None else start.astype(np.float32)
    rate = np.float32(1.0 / (0.25 * float((x**2).sum(1).max()) + penalty))
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        slope = x.T @ (weight * (p - y))
        slope[:-1] += np.float32(penalty) * v[:-1]
        new = v - rate * slope
        v = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Model:
    content: np.ndarray
    metadata: np.ndarray
    #: (slope, constant) of each view's calibration; (slope of each view, constant) of their combination.
    scales: tuple[tuple[float, float], tuple[float, float]]
    combined: tuple[float, float, float]

    def views(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """Calibrated log-odds of both views."""
        return [np.clip(s * odds(x, w) + c, -12, 12) for x, w, (s, c) in ((a, self.content, self.scales[0]), (b, self.metadata, self.scales[1]))]

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        z = self.views(a, b)
        both = self.combined[0] * z[0] + self.combined[1] * z[1] + self.combined[2]
        return np.stack([1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (*z, both)], 1)


@dataclass
class Trainer:
    """Labelled rows (content a, metadata b, label y), a quarter of them apart, and the pseudo-labelled ones so far."""

    a: np.ndarray
    b: np.ndarray
    y: np.ndarray
    more_a: list[np.ndarray] = field(default_factory=list)
    more_b: list[np.ndarray] = field(default_factory=list)
    more_y: list[int] = field(default_factory=list)
    models: list = field(default_factory=lambda: [None, None])

    def __post_init__(self) -> None:
        apart = np.arange(len(self.y)) % 4 == 3
        if len(set(self.y[~apart])) < 2 or len(set(self.y[apart])) < 2:
            apart = np.zeros(len(self.y), bool)
        self.apart, self.good = apart, float(self.y[~apart].mean())

    def fit(self) -> list[np.ndarray]:
        label = np.concatenate([self.y[~self.apart].astype(float), np.array(self.more_y, float)])
        weight = np.where(label == 1, 0.5 / max(self.good, 1e-3), 0.5 / max(1 - self.good, 1e-3))
        weight[len(label) - len(self.more_y) :] *= 0.5  # pseudo-labels count half
        views = ((self.a, self.more_a, 1e-4), (self.b, self.more_b, 1e-3))
        self.models = [fit(np.vstack([x[~self.apart], *more]), label, weight, penalty, start=w) for (x, more, penalty), w in zip(views, self.models, strict=True)]
        return self.models

    def add(self, a: np.ndarray, b: np.ndarray, y: list[int]) -> None:
        self.more_a += list(a[:, None])
        self.more_b += list(b[:, None])
        self.more_y += y

    def finish(self) -> Model:
        held = self.apart if self.apart.any() else ~self.apart
        y, even, scales = self.y[held].astype(float), np.ones(int(held.sum())), []
        for x, w in ((self.a, self.models[0]), (self.b, self.models[1])):
            z = odds(x[held], w)[:, None]
            spread = float(np.abs(z).max()) or 1.0
            s, c = fit(z / spread, y, even, 1e-3, 2000)
            scales.append((float(s) / spread, float(c)))
        model = Model(self.models[0], self.models[1], (scales[0], scales[1]), (1.0, 1.0, 0.0))
        z = np.stack(model.views(self.a[held], self.b[held]), 1)
        s, t, c = fit(z / 12, y, even, 1e-3, 2000)
        return Model(model.content, model.metadata, model.scales, (float(s) / 12, float(t) / 12, float(c)))


def _content_hash(text: str):
    return F.xxhash64(F.lit("cotraining"), F.col(text), F.col("source"), F.col("lang"), F.col("n_chars"))


def _given(docs: DataFrame, row: str, text: str) -> DataFrame:
    return docs.select(row, F.col(text).alias("__t"), F.col("source").alias("__src"), F.col("lang").alias("__lang"), F.col("n_chars").alias("__n"), _content_hash(text).alias("__h"))


def _both(t: list, s: list, g: list, n: list) -> tuple[np.ndarray, np.ndarray]:
    return content_features(t), metadata_features(t, s, g, n)


def _packed(a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    return [pa.array([x.tobytes() for x in v], pa.binary()) for v in (a.astype(np.float16), b.astype(np.int8))]


def _unpacked(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([np.frombuffer(x, np.float16) for x in a], np.float32).reshape(-1, DIMENSIONS), np.array([np.frombuffer(x, np.int8) for x in b], np.float32).reshape(-1, META)


def _sample(docs: DataFrame, labels: DataFrame, row: str, text: str, labelled: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, set[int]]:
    """Features, labels and content hashes of the bounded labelled sample."""
    order = F.xxhash64(F.lit("cotraining"), F.col(row))
    named = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(row)).agg((F.avg("quality") >= 0.5).cast("int").alias("__y"))
    chosen = named.join(docs.select(row), row, "left_semi").orderBy(order, row).limit(labelled).withColumnRenamed(row, "__id")
    rows = _given(docs, row, text).join(F.broadcast(chosen), F.col(row) == F.col("__id"))
    bounded_arrow(docs.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, t, s, g, n, h, y = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([*_packed(*_both(t, s, g, n)), pa.array(y, pa.int32()), pa.array(h, pa.int64()), batch.column(0)], ["a", "b", "y", "h", "id"])

    kind = docs.schema[row].dataType.simpleString()
    made = rows.select(row, "__t", "__src", "__lang", "__n", "__h", "__y").mapInArrow(features, f"a binary, b binary, y int, h long, id {kind}")
    got = made.groupBy("id").agg(F.min_by(F.struct("a", "b", "y", "h"), "h").alias("x")).orderBy(F.xxhash64(F.lit("cotraining"), "id"), "id").select("x.*").toArrow()
    a, b = _unpacked(got.column("a").to_pylist(), got.column("b").to_pylist())
    return a, b, np.array(got.column("y").to_pylist(), int), set(got.column("h").to_pylist())


def _sure(docs: DataFrame, models: list[np.ndarray], quotas: tuple[int, int], known: set[int], row: str, text: str) -> list:
    """(view, label, h, a, b) of documents that a view is sure of, quotas[label] of least content hash for each view, over
    the whole corpus; contents in `known` are left out. A task keeps and sends as many at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], dict[int, tuple[bytes, bytes]]] = {(v, y): {} for v in (0, 1) for y in (0, 1)}
        tops: dict[tuple[int, int], list[int]] = {k: [] for k in held}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for k in range(0, batch.num_rows, 256):
                t, s, g, n, h = (c[k : k + 256] for c in columns)
                a, b = _both(t, s, g, n)
                for view, (x, w) in enumerate(((a, models[0]), (b, models[1]))):
                    z = odds(x, w)
                    for label, found in ((0, np.flatnonzero(z < -SURE)), (1, np.flatnonzero(z > SURE))):
                        own, top = held[view, label], tops[view, label]
                        for i in found.tolist():
                            if h[i] in own or h[i] in known or len(top) >= quotas[label] and h[i] > -top[0]:
                                continue
                            own[h[i]] = (a[i].astype(np.float16).tobytes(), b[i].astype(np.int8).tobytes())
                            heapq.heappush(top, -h[i])
                            if len(top) > quotas[label]:
                                own.pop(-heapq.heappop(top))
        rows = [(v, y, h, a, b) for (v, y), own in held.items() for h, (a, b) in own.items()]
        for k in range(0, len(rows), 256):
            v, y, h, a, b = zip(*rows[k : k + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()), pa.array(y, pa.int32()), pa.array(h, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["view", "y", "h", "a", "b"])

    found = map_batches(_given(docs, row, text).select("__t", "__src", "__lang", "__n", "__h"), work, "view int, y int, h long, a binary, b binary")
    found = found.groupBy("view", "y", "h").agg(F.first("a").alias("a"), F.first("b").alias("b"))  # equal content has equal features
    quota = F.when(F.col("y") == 0, quotas[0]).otherwise(quotas[1])
    for keys in (["view", "y", F.pmod("h", F.lit(64))], ["view", "y"]):
        found = found.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("r") <= quota).drop("r")
    return found.orderBy("view", "y", "h").collect()


def fitted(docs: DataFrame, labels: DataFrame, row: str = "doc_id", text: str = "text", labelled: int = LABELLED) -> Model | None:
    a, b, y, known = _sample(docs, labels, row, text, labelled)
    if not len(y) or y.min() == y.max():
        return None
    trainer = Trainer(a, b, y)
    n = max(2, int(GROWTH * len(y)))
    quotas = (max(1, round(n * (1 - trainer.good))), max(1, round(n * trainer.good)))
    for _ in range(ROUNDS):
        by_content: dict[int, list] = {}
        for r in _sure(docs, trainer.fit(), quotas, known, row, text):
            by_content.setdefault(r["h"], []).append(r)
        taken = [rows[0] for rows in by_content.values() if len({r["y"] for r in rows}) == 1]  # the views don't contradict
        if not taken:
            break
        known |= set(by_content)
        trainer.add(*_unpacked([r["a"] for r in taken], [r["b"] for r in taken]), [r["y"] for r in taken])
    trainer.fit()
    return trainer.finish()


def scored(docs: DataFrame, labels: DataFrame, row: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, labelled: int = LABELLED) -> DataFrame:
    """The input with p_text, p_meta, score (probabilities of being good) and kept."""
    model = fitted(docs, labels, row, text, labelled)
    bounded_arrow(docs.sparkSession)

    def score(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for given in columns:
            t, s, g, n = (c.to_pylist() for c in given)
            parts = [np.ones((len(t[k : k + 256]), 3)) if model is None else model.scores(*_both(*(c[k : k + 256] for c in (t, s, g, n)))) for k in range(0, len(t), 256)]
            p = np.vstack([*parts, np.empty((0, 3))]).round(6)
            yield pa.StructArray.from_arrays([pa.array(p[:, j], pa.float64()) for j in range(3)], ["p_text", "p_meta", "score"])
        give_back()

    score.__annotations__ = {"columns": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(score, T._parse_datatype_string(SCORES))
    docs, restored = set_aside(docs, ("__s",))
    kept = docs.drop("p_text", "p_meta", "score", "kept")
    columns = kept.columns
    out = kept.withColumn("__s", udf(text_or_empty(text), F.col("source"), F.col("lang"), F.col("n_chars")))
    return restored(out.select(*columns, "__s.p_text", "__s.p_meta", "__s.score").withColumn("kept", F.col("score") >= threshold))
