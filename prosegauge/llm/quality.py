"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 512 bytes.  A passage is encoded by how often
each pair of character classes (vowel, consonant, upper case, digit, space, kinds
of punctuation, non-ASCII) stands side by side and by how its words repeat,
followed by a learned layer.
Gated attention, learned from document labels alone, weighs the passages; the
weighted passage representation gives the score, and the weights say which
passages made it.

Learning: labelled rows in the order of a hash of their id and text, ``sample_docs`` at
most, as long as they have no more than ``sample_passages`` passages together (a row that
does not fit any more is passed over); a chosen row is read whole.  So the driver
holds ``sample_passages`` encodings at most.  Scoring reads all passages of all texts;
labels, language, source and id are no input of it.

Defined cases: null and empty texts have one passage without pairs and so get the
model's score for that; without labelled rows of both kinds every score is
the smoothed share of label 1 (0.5 without rows); an id labelled twice has the
larger label; rows that repeat an id are scored one by one, and equal rows are learned
from once; an empty table gives an empty table; further columns are carried
through unless they bear the name of the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from prosegauge.llm.batches import parts

PASSAGE = 512
CLASSES = 16
PAIRS = CLASSES * CLASSES
WIDTH = PAIRS + 4
HIDDEN, GATE = 24, 16
PIECE = PASSAGE * 4096
DECAY = 1e-5


def _class_table() -> np.ndarray:
    table = np.full(256, 14, dtype=np.uint8)
    table[128:] = 15
    for k, chars in enumerate(
        (b"aeiouy", b"bcdfghjklmnpqrstvwxz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t", b".", b",", b"!?", b"|", b"#$%&*@^~+=<>`", b"\"'()[]{}", b"-_/\\", b":;")
    ):
        table[np.frombuffer(chars, dtype=np.uint8)] = k
    return table


CLASS_OF = _class_table()


def _repetition(passage: bytes) -> tuple[float, float, float, float]:
    """Shares of words equal to the one before, to the one before that, and met
    before in the passage; mean word length."""
    words = passage.split()
    n = max(1, len(words))
    near = sum(map(eq, words, words[1:])), sum(map(eq, words, words[2:]))
    return near[0] / n, near[1] / n, 1 - len(set(words)) / n, min(2.0, len(passage) / n / 10)


def encode(text: bytes) -> np.ndarray:
    """Square roots of pair shares and word repetition, one row for each
    passage (at least one)."""
    rows = []
    for k in range(0, max(1, len(text)), PIECE):
        piece = text[k : k + PIECE]
        kinds = CLASS_OF[np.frombuffer(piece, dtype=np.uint8)].astype(np.int64)
        n = max(1, -(-len(kinds) // PASSAGE))
        pairs = (kinds[:-1] * CLASSES + kinds[1:]) + np.arange(max(0, len(kinds) - 1)) // PASSAGE * PAIRS
        counts = np.bincount(pairs, minlength=n * PAIRS).reshape(n, PAIRS).astype(np.float32)
        repeats = np.array([_repetition(piece[i * PASSAGE : (i + 1) * PASSAGE]) for i in range(n)], dtype=np.float32)
        rows.append(np.hstack([np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)), repeats]))
    return np.concatenate(rows)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights: encoder ``e`` and ``eb``, gates ``v`` and ``u``, attention ``w``,
    output ``c`` and ``cb``; or a constant score."""

    parts: dict[str, np.ndarray] | None
    constant: float = 0.5

    def attend(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Score of a document and the weight of each passage."""
        if self.parts is None:
            return self.constant, np.full(len(x), 1 / len(x))
        p = self.parts
        h = np.tanh(x @ p["e"] + p["eb"])
        s = (np.tanh(h @ p["v"]) * _sigmoid(h @ p["u"])) @ p["w"]
        a = np.exp(s - s.max())
        a /= a.sum()
        return float(_sigmoid((a @ h) @ p["c"] + p["cb"])[0]), a

    def score(self, text: bytes) -> float:
        return self.attend(encode(text))[0]


def loss_and_gradient(p: dict[str, np.ndarray], bags: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted mean log loss of a batch of documents, with a little decay of the
    encoder, and its gradient."""
    x = np.concatenate(bags).astype(np.float64)
    sizes = np.array([len(b) for b in bags])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    bag = np.repeat(np.arange(len(bags)), sizes)
    h = np.tanh(x @ p["e"] + p["eb"])
    tv, su = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    s = (tv * su) @ p["w"]
    a = np.exp(s - np.maximum.reduceat(s, starts)[bag])
    a /= np.add.reduceat(a, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts)
    out = _sigmoid(z @ p["c"] + p["cb"])[:, 0]
    sure = np.clip(np.where(labels == 1, out, 1 - out), 1e-12, 1)
    loss = float(-(weight * np.log(sure)).mean() + DECAY / 2 * (p["e"] ** 2).sum())
    d_out = (out - labels) * weight / len(bags)
    g = {"c": z.T @ d_out[:, None], "cb": np.array([d_out.sum()])}
    d_z = d_out[:, None] * p["c"].T
    d_a = (d_z[bag] * h).sum(axis=1)
    d_s = a * (d_a - np.add.reduceat(a * d_a, starts)[bag])
    g["w"] = (tv * su).T @ d_s
    d_tv, d_su = np.outer(d_s, p["w"]) * su, np.outer(d_s, p["w"]) * tv
    d_v, d_u = d_tv * (1 - tv**2), d_su * su * (1 - su)
    g["v"], g["u"] = h.T @ d_v, h.T @ d_u
    d_h = a[:, None] * d_z[bag] + d_v @ p["v"].T + d_u @ p["u"].T
    d_e = d_h * (1 - h**2)
    g["e"], g["eb"] = x.T @ d_e + DECAY * p["e"], d_e.sum(axis=0)
    return loss, g


def fit(bags: list[np.ndarray], labels: np.ndarray, *, epochs: int = 40, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam on the log loss of document labels, both labels given equal weight
    as a whole by half (square root of the imbalance)."""
    n, ones = len(bags), int(labels.sum())
    if not 0 < ones < n:
        return Model(None, (ones + 1) / (n + 2))
    rng = np.random.default_rng(seed)
    p = {
        "e": rng.normal(0, 1, (WIDTH, HIDDEN)),
        "eb": np.zeros(HIDDEN),
        "v": rng.normal(0, 0.3, (HIDDEN, GATE)),
        "u": rng.normal(0, 0.3, (HIDDEN, GATE)),
        "w": rng.normal(0, 0.3, GATE),
        "c": rng.normal(0, 0.3, (HIDDEN, 1)),
        "cb": np.zeros(1),
    }
    first, second = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    weight = np.where(labels == 1, np.sqrt((n - ones) / ones), 1.0)
    weight /= weight.mean()
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for begin in range(0, n, batch):
            take = order[begin : begin + batch]
            _, g = loss_and_gradient(p, [bags[k] for k in take], labels[take], weight[take])
            step += 1
            speed = rate * min(1.0, 2 * (1 - epoch / epochs))
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                p[k] -= speed * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(p)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    usable: Column | None = None,
    sample_docs: int = 4000,
    sample_passages: int = 100_000,
) -> Model:
    """Fit on a bounded sample of rows of ``labels`` (where ``usable`` holds)."""
    spot = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    share = min(1.0, sample_docs / max(1, rows.count()))
    chosen = rows.where(spot < share).orderBy(spot, id_col).limit(sample_docs).select(F.col(id_col).alias("_id"), "label", spot.alias("spot"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts([batch], 64):
                bags = [encode(t.as_py()) for t in part.column(3).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(3)), pa.array([x.astype(np.float16).tobytes() for x in bags], pa.binary())],
                    names=["spot", "label", "tie", "x"],
                )

    # lengths alone say which rows fit, so only those are encoded, and nothing is kept between the two readings
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text"))
    passages = F.greatest(F.lit(1), F.ceil(F.octet_length("_text") / PASSAGE)).cast("long")
    joined = own.join(F.broadcast(chosen), "_id").select("spot", "label", F.md5("_text").alias("tie"), "_text")
    left, taken = sample_passages, []
    for r in joined.select("spot", "tie", passages.alias("n")).dropDuplicates(["spot", "tie"]).orderBy("spot", "tie").limit(sample_docs).collect():
        if r["n"] <= left:
            left -= r["n"]
            taken.append((r["spot"], r["tie"]))
    if not taken:
        return Model(None)
    spots, ties = zip(*taken)
    wanted = docs.sparkSession.createDataFrame(pa.table({"spot": pa.array(spots, pa.float64()), "tie": pa.array(ties, pa.string())}))
    fitting = joined.join(F.broadcast(wanted), ["spot", "tie"], "left_semi").select("spot", "label", "tie", "_text")
    bags = fitting.mapInArrow(encoded, "spot double, label int, tie string, x binary").dropDuplicates(["spot", "tie"])
    got = sorted(bags.collect(), key=lambda r: (r["spot"], r["tie"]))
    x = [np.frombuffer(bytes(r["x"]), dtype=np.float16).reshape(-1, WIDTH) for r in got]
    return fit(x, np.array([r["label"] for r in got], dtype=np.float64))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every text; narrow, no exchange."""
    kept = [c for c in docs.columns if c != name]
    source = docs.select(*kept)
    at = kept.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.parts, model.constant))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in parts(batches):
            found = [model.score(t.as_py() or b"") for t in batch.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*kept, name])

    return source.mapInArrow(run, StructType(list(source.schema.fields)).add(name, DoubleType()))
