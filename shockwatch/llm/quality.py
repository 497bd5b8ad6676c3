"""Quality by attention-based multiple-instance learning: a document is a bag of passages.

Every passage (PASSAGE bytes of whole words) is described by shares and ratios of its words and
characters and encoded by one hidden layer; gated attention, tanh(V h) * sigmoid(U h), weighs the
passages of a document, and a logistic unit scores the weighted mean. Only document labels are
known; they train encoder, attention and score together (Adam, numpy, on the driver).

The fit sees a bounded sample of labelled rows, each with all passages of its text: the first
TRAIN_DOCS in the order of a hash of their id, as far as their passages together fill TRAIN_BYTES (a
passage is FEATURES floats, so that is about 170 MB of text); a row that alone needs more than a
sixteenth of it (11 MB of text) is not part of the sample. Scoring reads every passage of every
document, in Arrow batches, short texts together up to RUN bytes and a longer one in blocks of at most
BLOCK: the attention is a running softmax, so a text of any length needs one block of memory.

Defined cases: a null text is empty; a text without words is one passage of zeros and gets the
score the model gives that; labels that are null are ignored, several labels of one id are averaged;
without labels of both kinds the score is the smoothed share of label 1; a null doc_id counts as
held out; repeated rows get equal scores; only doc_id and text are read, other columns pass through
``keep_good`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import store, text_of

PASSAGE = 512
BLOCK, RUN = 1 << 20, 1 << 17
TRAIN_DOCS, TRAIN_BYTES = 4000, 32 << 20
FOLDS = 5
THRESHOLD = 0.3
HIDDEN, GATE, EPOCHS, BATCH, RATE, SEED = 16, 8, 40, 128, 0.01, 7

SPACE, LOWER, UPPER, DIGIT, POINT, SHOUT, BAR, SYMBOL, WIDE = range(9)


def byte_classes() -> np.ndarray:
    table = np.full(256, SYMBOL, np.uint8)
    table[[32, *range(9, 14)]] = SPACE
    table[97:123], table[65:91], table[48:58], table[128:] = LOWER, UPPER, DIGIT, WIDE
    table[[ord(c) for c in ".,;:?'\"()-"]] = POINT
    table[ord("!")], table[ord("|")] = SHOUT, BAR
    return table


CLASSES = byte_classes()
CODES = np.random.default_rng(SEED).integers(1, 1 << 62, 256, np.uint64)
FEATURES = 24


def passages(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of the texts data[bounds[i]:bounds[i + 1]], and their text's i."""
    n_docs = len(bounds) - 1
    kind = CLASSES[data]
    letter = kind != SPACE
    first = np.zeros(len(data) + 1, bool)
    first[bounds[:-1]] = True
    first = first[:len(data)]
    before, after = np.empty_like(letter), np.empty_like(letter)
    before[:1], before[1:] = False, letter[:-1]
    after[-1:], after[:-1] = False, letter[1:] & ~first[1:]
    starts, ends = np.flatnonzero(letter & (first | ~before)), np.flatnonzero(letter & ~after) + 1
    doc = np.searchsorted(bounds, starts, "right") - 1
    local = (starts - bounds[doc]) // PASSAGE
    new = np.ones(len(starts), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (local[1:] != local[:-1])
    row = np.cumsum(new) - 1
    n_rows = int(row[-1]) + 1 if len(row) else 0
    owner = doc[new]

    def per_word(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[ends] - total[starts]

    count = {k: per_word(kind == k) for k in range(1, 9)}
    size = (ends - starts).astype(np.float64)
    code = CODES[data]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code)])
    steps = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * np.arange(len(data), dtype=np.uint64))])
    word = (steps[ends] - steps[starts]) - starts.astype(np.uint64) * (sums[ends] - sums[starts]) + sums[ends] - sums[starts]
    word = (word * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(26)  # 38 bits
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    keys = np.sort((row.astype(np.uint64) << np.uint64(38)) | word)
    distinct = np.ones(len(keys), bool)
    distinct[1:] = keys[1:] != keys[:-1]

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(row, values, n_rows)

    n = np.maximum(total(np.ones(len(row))), 1)
    used = np.maximum(total(size), 1)
    mean = total(size) / n
    last = data[ends - 1] if len(ends) else data[:0]
    lines = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])
    gap = np.zeros(len(starts))
    gap[1:] = np.where(doc[1:] == doc[:-1], lines[starts[1:]] - lines[ends[:-1]], 0)
    columns = [
        np.log1p(n) / 5, mean / 10, np.sqrt(np.maximum(total(size**2) / n - mean**2, 0)) / 10,
        *(total(count[k]) / used for k in (LOWER, UPPER, DIGIT, POINT, SHOUT, BAR, SYMBOL, WIDE)),
        np.bincount((keys[distinct] >> np.uint64(38)).astype(np.int64), minlength=n_rows) / n, total(same) / n,
        total((count[UPPER] > 1) & (count[LOWER] == 0)) / n, total(count[SHOUT] > 1) / n, total(count[SYMBOL] > 1) / n,
        total((size == 1) & (count[BAR] == 1)) / n, total((count[UPPER] == 1) & (count[LOWER] > 0)) / n,
        np.minimum(total(gap), n) / n, total(size >= 20) / n, total(size == 1) / n,
        total((last == 46) | (last == 63)) / n, total(last == 44) / n, total(count[DIGIT] == size) / n]
    rows = np.stack(columns, 1).astype(np.float32) if n_rows else np.zeros((0, FEATURES), np.float32)
    bare = np.setdiff1d(np.arange(n_docs), owner)
    if len(bare):
        owner = np.concatenate([owner, bare])
        order = np.argsort(owner, kind="stable")
        rows, owner = np.concatenate([rows, np.zeros((len(bare), FEATURES), np.float32)])[order], owner[order]
    return rows, owner


def blocks(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, bounds, first text) of runs of short texts, and of the parts of a long one."""
    at, n = 0, len(bounds) - 1
    while at < n:
        upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + min(RUN, BLOCK), "right")) - 1)
        low, high = int(bounds[at]), int(bounds[upto])
        if high - low <= BLOCK:
            yield data[low:high], bounds[at:upto + 1] - low, at
        else:  # one long text, cut after a space where there is one
            while low < high:
                cut = min(low + BLOCK, high)
                if cut < high:
                    spaces = np.flatnonzero(CLASSES[data[low:cut]] == SPACE)
                    cut = low + int(spaces[-1]) + 1 if len(spaces) else cut
                yield data[low:cut], np.array([0, cut - low]), at
                low = cut
        at = upto


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; a null is empty."""
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


class Model:
    """Encoder, gated attention and score; a constant when there is nothing to learn from."""

    def __init__(self, prior: float = 0.5):
        self.constant: float | None = prior
        self.weights: dict[str, np.ndarray] = {}

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        w = self.weights
        hidden = np.tanh((rows - w["mean"]) / w["scale"] @ w["w"] + w["b"])
        t, s = np.tanh(hidden @ w["v"]), 1 / (1 + np.exp(-(hidden @ w["u"])))
        return hidden, t, s, (t * s) @ w["a"]

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        top, mass, held = np.full(n, -np.inf), np.zeros(n), np.zeros((n, HIDDEN))
        for part, inner, at in blocks(data, bounds):
            rows, owner = passages(part, inner)
            owner = owner + at
            hidden, _, _, weight = self.encode(rows)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            docs = owner[starts]
            peak = np.maximum(np.maximum.reduceat(weight, starts), top[docs])
            old = np.exp(top[docs] - peak)
            e = np.exp(weight - peak[np.searchsorted(docs, owner)])
            mass[docs] = mass[docs] * old + np.add.reduceat(e, starts)
            held[docs] = held[docs] * old[:, None] + np.add.reduceat(e[:, None] * hidden, starts, axis=0)
            top[docs] = peak
        w = self.weights
        return 1 / (1 + np.exp(-(held / mass[:, None] @ w["c"] + w["d"])))

    def fit(self, bags: list[np.ndarray], labels: np.ndarray) -> Model:
        self.constant = (labels.sum() + 1) / (len(labels) + 2)
        if len(set((labels >= 0.5).tolist())) < 2:
            return self
        self.constant = None
        rng, every = np.random.default_rng(SEED), np.concatenate(bags)
        w = self.weights = {
            "mean": every.mean(0), "scale": every.std(0) + 1e-3,
            "w": rng.normal(0, 0.3, (every.shape[1], HIDDEN)), "b": np.zeros(HIDDEN),
            "v": rng.normal(0, 0.3, (HIDDEN, GATE)), "u": rng.normal(0, 0.3, (HIDDEN, GATE)),
            "a": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(())}
        learned = [k for k in w if k not in ("mean", "scale")]
        m, v, step = {k: 0.0 for k in learned}, {k: 0.0 for k in learned}, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                step += 1
                picked = order[at:at + BATCH]
                for k, g in self.gradients([bags[i] for i in picked], labels[picked]).items():
                    g = g + 1e-4 * w[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def gradients(self, bags: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        w, rows = self.weights, np.concatenate(bags)
        sizes = np.array([len(b) for b in bags])
        starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(bags)), sizes)
        x = (rows - w["mean"]) / w["scale"]
        h, t, s, weight = self.encode(rows)
        e = np.exp(weight - np.maximum.reduceat(weight, starts)[owner])
        share = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(share[:, None] * h, starts, axis=0)
        error = (1 / (1 + np.exp(-(z @ w["c"] + w["d"]))) - labels) / len(bags)
        dz = error[:, None] * w["c"]
        dshare = (h * dz[owner]).sum(1)
        dweight = share * (dshare - np.add.reduceat(share * dshare, starts)[owner])
        dgate = dweight[:, None] * w["a"]
        dt, ds = dgate * s * (1 - t * t), dgate * t * s * (1 - s)
        dh = (share[:, None] * dz[owner] + dt @ w["v"].T + ds @ w["u"].T) * (1 - h * h)
        return {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ dweight,
                "c": z.T @ error, "d": error.sum()}


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_DOCS,
          most_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on at most ``most`` labelled documents outside the held-out fold, all passages of each."""
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                raw = np.frombuffer(text.encode(), np.uint8)
                rows = np.concatenate([passages(p, b)[0] for p, b, _ in blocks(raw, np.array([0, len(raw)]))] or [
                    np.zeros((1, FEATURES), np.float32)])
                out.append(rows.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("target"), pa.array(out)],
                                             names=["doc_id", "target", "rows"])

    # labels without a document do not use up the sample
    chosen = labels.filter(F.col(label).isNotNull() & ~held_out()).join(docs.select("doc_id"), "doc_id", "left_semi").groupBy(
        "doc_id").agg(F.avg(label).alias("target")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows
    described = store(sample.mapInArrow(describe, "doc_id long, target double, rows binary"), "training")
    size = described.groupBy("doc_id").agg(F.sum(F.octet_length("rows")).alias("_size")).filter(F.col("_size") <= most_bytes // 16)
    filled = F.sum("_size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most ``most`` narrow rows
    kept = size.withColumn("_filled", filled).filter(F.col("_filled") <= most_bytes).select("doc_id")
    found = sorted(described.join(F.broadcast(kept), "doc_id").select("doc_id", "target", "rows").collect(),
                   key=lambda r: (r["doc_id"], bytes(r["rows"])))
    if not found:
        return Model()
    return Model().fit([np.frombuffer(r["rows"], np.float32).reshape(-1, FEATURES) for r in found],
                       np.array([r["target"] for r in found]))


def scored(docs: DataFrame, model: Model, text: str, out: str) -> DataFrame:
    """``docs`` with the score of column ``text`` added as ``out``."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.scores(*utf8(batch.column(text))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, out])

    return docs.mapInArrow(score, schema)


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id"), text_of().alias("text"))
    return scored(rows, model, "text", "score").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents the classifier does not reject, all columns as they were."""
    model = train(docs, labels)
    return scored(docs, model, "text", "_llm_score").filter(F.col("_llm_score") >= threshold).select(docs.columns)
