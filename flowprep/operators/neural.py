"""Feed-forward networks fitted where the rows are (ML-3..6).

An epoch is one Spark job.  Every task takes the weights it is sent, goes over its rows in mini-batches
with Adam, and gives back its weights times the weight of its rows; these are added up as a tree (``FAN``
tasks at a time, in groups) and the weighted mean is what the next epoch starts from (local stochastic
gradient descent).  The driver and every task hold a few copies of the weights, whatever the number of rows or partitions.
The validation loss of the weights an epoch starts from is taken in the same pass over the table.

An epoch depends on the table, the seed and the weights it starts from, so a lost task is simply run again; with
``path`` each epoch's weights are written there and a fit that died goes on after its last whole epoch.

Odd input: rows without features or label are left out; rows whose features differ in length or hold NULLs, and a
table without a row to fit on, are errors.  Rows may repeat.  Dropout masks and the order of mini-batches come from (seed, epoch,
partition), so results are equal for equal partitions of the table, not for any cut of it.

Unlike the published trainers there is no batch normalisation, and the loss is the cross-entropy of the softmax.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import argmax
from ..session import cut_lineage

#: States that one task adds up.
FAN = 32
#: Rows of one file of a table to fit on: an epoch is as long as its longest task, so larger tables are dealt evenly.
ROWS_EACH = 1 << 16

_SUMS = "pid long, rows double, steps double, train_loss double, val_rows double, val_loss double, state binary"

_ACTIVATE = {"relu": lambda z: np.maximum(z, 0.0), "tanh": np.tanh, "sigmoid": lambda z: 1.0 / (1.0 + np.exp(-z)), "linear": lambda z: z}
_SLOPE = {"relu": lambda a: (a > 0).astype(float), "tanh": lambda a: 1.0 - a * a, "sigmoid": lambda a: a * (1.0 - a),
          "linear": np.ones_like}


class Layers:
    """Widths and activations of a network; its weights are one flat vector."""

    def __init__(self, widths: Sequence[int], activations: Sequence[str], dropout: float = 0.0):
        if len(activations) != len(widths) - 1:
            raise ValueError("one activation a layer")
        unknown = set(activations) - set(_ACTIVATE) - {"softmax"}
        if unknown or "softmax" in activations[:-1]:
            raise ValueError(f"unknown activations: {sorted(unknown) or 'softmax is for the last layer'}")
        self.widths, self.activations, self.dropout = [int(w) for w in widths], list(activations), float(dropout)

    def start(self, seed: int) -> np.ndarray:
        """Uniform weights scaled by the widths (He before ReLU, Glorot otherwise), no bias."""
        rng, out = np.random.default_rng(seed), []
        for d, k, act in zip(self.widths, self.widths[1:], self.activations, strict=False):
            bound = math.sqrt(6.0 / d) if act == "relu" else math.sqrt(6.0 / (d + k))
            out += [rng.uniform(-bound, bound, d * k), np.zeros(k)]
        return np.concatenate(out)

    def parts(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for d, k in zip(self.widths, self.widths[1:], strict=False):
            out.append((flat[at : at + d * k].reshape(d, k), flat[at + d * k : at + d * k + k]))
            at += d * k + k
        return out

    def forward(self, flat: np.ndarray, x: np.ndarray, rng=None, upto: int | None = None, parts: list | None = None) -> list[np.ndarray]:
        """Outputs of every layer, the input first; ``rng`` draws dropout masks for hidden layers."""
        outs = [x]
        for i, (w, b) in enumerate((parts or self.parts(flat))[:upto]):
            z = outs[-1] @ w
            z += b
            if self.activations[i] == "softmax":
                e = np.exp(z - z.max(axis=1, keepdims=True))
                outs.append(e / e.sum(axis=1, keepdims=True))
            else:
                a = _ACTIVATE[self.activations[i]](z)
                if rng is not None and self.dropout and i < len(self.activations) - 1:
                    a = a * (rng.random(a.shape) >= self.dropout) / (1.0 - self.dropout)
                outs.append(a)
        return outs

    def losses(self, out: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Per row: cross-entropy against class codes, or the mean squared distance to the target."""
        if self.activations[-1] == "softmax":
            return -np.log(np.maximum(out[np.arange(len(out)), target], 1e-15))
        return ((out - target) ** 2).mean(axis=1)

    def gradient(self, flat: np.ndarray, x: np.ndarray, target: np.ndarray, weight: np.ndarray, rng, parts: list | None = None,
                 into: tuple[np.ndarray, list] | None = None) -> tuple[float, np.ndarray]:
        """Weighted sum of the losses, and the gradient of their weighted mean.

        A loop gives ``parts`` of ``flat``, and ``into``: a vector to be overwritten with the gradient, and its parts.
        """
        parts = parts or self.parts(flat)
        grad, slots = into or (np.empty_like(flat), None)
        slots = slots or self.parts(grad)
        outs = self.forward(flat, x, rng, parts=parts)
        share = (weight / weight.sum())[:, None]
        if self.activations[-1] == "softmax":
            loss = self.losses(outs[-1], target)
            delta = outs[-1].copy()
            delta[np.arange(len(x)), target] -= 1.0
            delta *= share
        else:
            delta = outs[-1] - target
            loss = np.add.reduce(delta * delta, axis=1) / target.shape[1]
            delta *= 2.0
            delta /= target.shape[1]
            delta *= share
            if self.activations[-1] != "linear":
                delta *= _SLOPE[self.activations[-1]](outs[-1])
        for i in range(len(parts) - 1, -1, -1):
            np.matmul(outs[i].T, delta, out=slots[i][0])
            np.add.reduce(delta, axis=0, out=slots[i][1])
            if i:
                act, kept = self.activations[i - 1], outs[i]
                delta = delta @ parts[i][0].T
                if self.dropout:  # a masked unit passes nothing back, a kept one passes the mask's factor
                    delta *= _SLOPE[act](kept * (1.0 - self.dropout)) * (kept != 0) / (1.0 - self.dropout)
                elif act == "relu":
                    delta *= kept > 0
                elif act != "linear":
                    delta *= _SLOPE[act](kept)
        return float(loss @ weight), grad

    def to_json(self) -> str:
        return json.dumps({"widths": self.widths, "activations": self.activations, "dropout": self.dropout})


def _features():
    """The vector column ``fvec`` as an array; NULL stays NULL."""
    return F.when(F.col("fvec").isNotNull(), vector_to_array("fvec"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten()
    if len(flat) != len(column) * width or flat.null_count:
        raise ValueError(f"features must be {width} numbers in every row")
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _epoch(layers: Layers, sent, epoch: int, learn: bool, batch_size: int, rate: float, seed: int):
    """The work of one task in one epoch (``mapInArrow``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, epoch, pid])
        start, (flat, m, v), steps = sent.value[0][0], [a.copy() for a in sent.value[0]], sent.value[1]
        grad, t, u = np.empty_like(flat), np.empty_like(flat), np.empty_like(flat)
        parts, into = layers.parts(flat), (grad, layers.parts(grad))
        rows = train_loss = val_rows = val_loss = 0.0
        for batch in batches:
            x, weight = _matrix(batch.column(0), layers.widths[0]), batch.column(2).to_numpy()
            val = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            target = batch.column(1).to_numpy().astype(int) if layers.activations[-1] == "softmax" else x
            if val.any():
                out = layers.forward(start, x[val])[-1]
                val_loss += float((layers.losses(out, target[val]) * weight[val]).sum())
                val_rows += float(weight[val].sum())
            if not learn:
                continue
            order = rng.permutation(np.flatnonzero(~val & (weight > 0)))
            x, target, weight = x[order], target[order], weight[order]
            for at in range(0, len(order), batch_size):
                some = slice(at, at + batch_size)
                loss, _ = layers.gradient(flat, x[some], target[some], weight[some], rng, parts, into)
                steps += 1.0
                # Adam, without new vectors: m += 0.1 (g - m), v += 0.001 (g g - v)
                np.subtract(grad, m, out=t)
                t *= 0.1
                m += t
                np.multiply(grad, grad, out=t)
                t -= v
                t *= 0.001
                v += t
                np.divide(m, 1 - 0.9**steps, out=t)
                t *= rate
                np.divide(v, 1 - 0.999**steps, out=u)
                np.sqrt(u, out=u)
                u += 1e-8
                t /= u
                flat -= t
                train_loss += loss
            rows += float(weight.sum())
        if rows or val_rows:
            state = np.concatenate([flat, m, v]) * rows
            yield _sums([pid], [rows], [steps * rows], [train_loss], [val_rows], [val_loss], [state.tobytes()])

    return run


def _sums(*columns) -> pa.RecordBatch:
    names = [c.split()[0] for c in _SUMS.split(", ")]
    types = [pa.int64(), *[pa.float64()] * 5, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _add(key, table: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_total(key[0].as_py(), table.sort_by("pid").to_pylist())])


def _total(pid: int, rows: list[dict]) -> pa.RecordBatch:
    state = sum(np.frombuffer(r["state"]) for r in rows)
    return _sums([pid], *[[float(sum(r[c] for r in rows))] for c in ("rows", "steps", "train_loss", "val_rows", "val_loss")], [state.tobytes()])


def _summed(parts: DataFrame, partitions: int) -> dict | None:
    """All tasks' sums, added up ``FAN`` at a time; the driver adds the last ``FAN``."""
    groups = partitions
    while groups > FAN:
        groups = math.ceil(groups / FAN)
        by = F.expr(f"pid % {groups}").alias("_group")
        parts = parts.groupBy(by).applyInArrow(lambda key, table: _add(key, table), _SUMS)
    rows = sorted((r.asDict() for r in parts.collect()), key=lambda r: r["pid"])
    return _total(0, rows).to_pylist()[0] if rows else None


class _States:
    """Weights after each epoch, one small Parquet table an epoch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def last(self) -> tuple[int, list[np.ndarray], float, dict] | None:
        jvm = self.spark._jvm
        whole = jvm.org.apache.hadoop.fs.Path(f"{self.path}/epoch-*/_SUCCESS")
        found = whole.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(whole)
        names = sorted(f.getPath().getParent().toString() for f in found or [])
        if not names:
            return None
        r = self.spark.read.parquet(names[-1]).first()
        return r["epoch"], list(np.frombuffer(r["state"]).reshape(3, -1).copy()), r["steps"], json.loads(r["record"])

    def put(self, epoch: int, state: list[np.ndarray], steps: float, record: dict) -> None:
        row = [(epoch, bytearray(np.concatenate(state).tobytes()), float(steps), json.dumps(record))]
        out = self.spark.createDataFrame(row, "epoch int, state binary, steps double, record string")
        out.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/epoch-{epoch:06d}")


def fit_layers(table: DataFrame, layers: Layers, *, epochs: int = 50, patience: int = 0, batch_size: int = 256, rate: float = 0.003,
               seed: int = 42, path: str | None = None) -> tuple[np.ndarray, list[dict]]:
    """Fit on ``table`` (x array<double>, y int, w double, val boolean); (weights, history).

    The history has one entry an epoch: train loss (mean over the epoch), validation loss after it (None without validation
    rows).  The weights of the least validation loss are given back, the last ones without validation rows.
    ``patience`` > 0 ends the fit that many epochs after the last improvement.
    """
    spark = table.sparkSession
    rows = table.select("x", "y", "w", "val").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    partitions = rows.rdd.getNumPartitions()
    flat = layers.start(seed)
    state, steps, done = [flat, np.zeros_like(flat), np.zeros_like(flat)], 0.0, 0
    record: dict = {"history": [], "best": None, "best_weights": None}
    states = _States(spark, path) if path else None
    before = states.last() if states else None
    if before:
        done, state, steps, record = before
    history, best = record["history"], record["best"]
    kept = np.array(record["best_weights"]) if best is not None else None
    for epoch in range(done, epochs + 1):
        ended = bool(patience) and best is not None and epoch - 1 - best[0] >= patience
        sent = spark.sparkContext.broadcast((state, steps))
        learn = epoch < epochs and not ended
        total = _summed(rows.mapInArrow(_epoch(layers, sent, epoch, learn, batch_size, rate, seed), _SUMS), partitions)
        sent.unpersist()
        if learn and not (total and total["rows"]):
            raise ValueError("no rows to fit on")
        if epoch and total and total["val_rows"]:  # the loss of the weights that this epoch started from
            loss = total["val_loss"] / total["val_rows"]
            history[epoch - 1]["val_loss"] = loss
            if best is None or loss < best[1]:
                best, kept = [epoch, loss], state[0]
            if patience and epoch - best[0] >= patience:
                break
        if not learn:
            break
        state = list(np.frombuffer(total["state"]).reshape(3, -1) / total["rows"])
        steps = total["steps"] / total["rows"]
        history.append({"epoch": epoch + 1, "train_loss": total["train_loss"] / total["rows"], "val_loss": None})
        if states:
            weights = kept.tolist() if kept is not None else None
            states.put(epoch + 1, state, steps, {"history": history, "best": best, "best_weights": weights})
    return (state[0] if kept is None else kept), history


class _Writer:
    """``model.write().overwrite().save(path)``, as Spark's own models have it."""

    def __init__(self, model: NetworkModel):
        self.model, self.mode = model, "error"

    def overwrite(self) -> _Writer:
        self.mode = "overwrite"
        return self

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        row = [(json.dumps(self.model.settings()), bytearray(np.concatenate([n[1] for n in self.model.nets]).tobytes()))]
        spark.createDataFrame(row, "settings string, weights binary").coalesce(1).write.mode(self.mode).parquet(path)


class NetworkModel(Model):
    """Fitted networks, applied one after the other; the last one gives the output.

    A classifier adds ``raw``, ``prob`` and ``pred_idx`` as Spark's classifiers do, an autoencoder adds ``encoded`` and ``recon``.
    A row without features gets NULLs.
    """

    def __init__(self, nets: list[tuple[Layers, np.ndarray]], code_layer: int | None = None, history: Sequence[dict] = ()):
        super().__init__()
        self.nets, self.code_layer, self.history = nets, code_layer, list(history)

    def settings(self) -> dict:
        return {"nets": [json.loads(n[0].to_json()) for n in self.nets], "code_layer": self.code_layer, "history": self.history}

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def load(cls, path: str) -> NetworkModel:
        row = SparkSession.getActiveSession().read.parquet(path).select("settings", "weights").first()
        s, flat, nets = json.loads(row["settings"]), np.frombuffer(row["weights"]), []
        for n in s["nets"]:
            layers = Layers(n["widths"], n["activations"], n["dropout"])
            size = len(layers.start(0))
            nets.append((layers, flat[:size]))
            flat = flat[size:]
        return cls(nets, s["code_layer"], s["history"])

    def _outputs(self, features, net: int, upto: int | None = None):
        """Output of one network's layer for an ``array<double>`` column (Arrow batches)."""
        layers, flat = self.nets[net]

        @F.arrow_udf("array<double>")
        def run(column: pa.Array) -> pa.Array:
            there = column.is_valid()
            out = layers.forward(flat, _matrix(column.filter(there), layers.widths[0]), upto=upto)[-1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
            place = np.cumsum(there.to_numpy(zero_copy_only=False)) - 1
            return lists.take(pa.array(place, mask=~there.to_numpy(zero_copy_only=False)))

        return run(features)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = _features()
        if self.nets[-1][0].activations[-1] != "softmax":
            coded = dataset.withColumn("encoded", self._outputs(x, 0, self.code_layer))
            return coded.withColumn("recon", self._outputs(x, 0))
        if len(self.nets) == 2:
            x = self._outputs(x, 0, self.code_layer)
        scored = dataset.withColumn("_probs", self._outputs(x, len(self.nets) - 1))
        scored = scored.withColumn("prob", F.when(F.col("_probs").isNotNull(), array_to_vector("_probs")))
        return scored.withColumn("raw", F.col("prob")).withColumn("pred_idx", argmax("_probs").cast("double")).drop("_probs")


def _table(df: DataFrame, weight_col: str | None, label: str | None) -> DataFrame:
    """(x, y, w, val, role) of a table with ``fvec``; ``is_val`` marks validation rows, ``role`` unlabelled ones, where they are there."""
    val = F.coalesce(F.col("is_val"), F.lit(False)) if "is_val" in df.columns else F.lit(False)
    role = F.col("role") if "role" in df.columns else F.lit(None).cast("string")
    y = F.col(label).cast("int") if label else F.lit(0)
    weight = F.when(val, 1.0).otherwise(F.col(weight_col).cast("double")) if weight_col else F.lit(1.0)
    stored = cut_lineage(df.select(_features().alias("x"), y.alias("y"), weight.alias("w"), val.alias("val"), role.alias("role")))
    n = stored.count()  # of the files' footers
    return cut_lineage(stored.repartition(-(-n // ROWS_EACH))) if n > ROWS_EACH else stored


class NetworkClassifier(Estimator):
    """ML-3: hidden layers of one activation, softmax, Adam, row weights, early stop on validation rows (``is_val``)."""

    def __init__(self, hidden: Sequence[int] = (64,), activation: str = "relu", dropout: float = 0.0, epochs: int = 50, patience: int = 0,
                 batch_size: int = 256, rate: float = 0.003, seed: int = 42, weight_col: str | None = None, path: str | None = None):
        super().__init__()
        self.hidden, self.activation, self.dropout = list(hidden), activation, dropout
        self.weight_col, self.fitting = weight_col, dict(epochs=epochs, patience=patience, batch_size=batch_size, rate=rate, seed=seed, path=path)

    def fit_table(self, table: DataFrame) -> tuple[Layers, np.ndarray, list[dict]]:
        width, classes = table.where(F.col("x").isNotNull()).agg(F.max(F.size("x")), F.max("y") + 1).first()
        if classes is None:
            raise ValueError("no rows to fit on")
        acts = [self.activation] * len(self.hidden) + ["softmax"]
        layers = Layers([width, *self.hidden, classes], acts, self.dropout)
        return (layers, *fit_layers(table, layers, **self.fitting))

    def _fit(self, dataset: DataFrame) -> NetworkModel:
        layers, flat, history = self.fit_table(_table(dataset, self.weight_col, "label_idx"))
        return NetworkModel([(layers, flat)], history=history)


class Autoencoder(Estimator):
    """ML-4: encoder and decoder layers; the code is the encoder's last output, the loss the mean squared distance.

    Hidden layers have ``activation``, the code ``code_activation``, the output ``output_activation``.
    """

    def __init__(self, encoder: Sequence[int] = (32, 8), decoder: Sequence[int] = (32,), activation: str = "relu",
                 code_activation: str = "linear", output_activation: str = "linear", epochs: int = 50, patience: int = 0,
                 batch_size: int = 256, rate: float = 0.003, seed: int = 42, path: str | None = None):
        super().__init__()
        self.encoder, self.decoder = list(encoder), list(decoder)
        self.acts = [activation] * (len(self.encoder) - 1) + [code_activation] + [activation] * len(self.decoder) + [output_activation]
        self.fitting = dict(epochs=epochs, patience=patience, batch_size=batch_size, rate=rate, seed=seed, path=path)

    def fit_table(self, table: DataFrame) -> tuple[Layers, np.ndarray, list[dict]]:
        width = table.where(F.col("x").isNotNull()).agg(F.max(F.size("x"))).first()[0]
        if width is None:
            raise ValueError("no rows to fit on")
        layers = Layers([width, *self.encoder, *self.decoder, width], self.acts)
        return (layers, *fit_layers(table, layers, **self.fitting))

    def _fit(self, dataset: DataFrame) -> NetworkModel:
        layers, flat, history = self.fit_table(_table(dataset, None, None))
        return NetworkModel([(layers, flat)], len(self.encoder), history)


class PretrainedClassifier(Estimator):
    """ML-5: an autoencoder fitted on the rows of role ``unsup`` (all rows where there are none), a classifier on the codes of the others.

    Validation rows (``is_val``) serve both.  ``path`` keeps the epochs of both.
    """

    #: Rows of role ``unsup`` are used, not left out.
    uses_unlabelled = True

    def __init__(self, encoder: Sequence[int] = (32, 8), decoder: Sequence[int] = (32,), hidden: Sequence[int] = (32,), epochs: int = 50,
                 ae_epochs: int = 50, patience: int = 0, batch_size: int = 256, rate: float = 0.003, seed: int = 42,
                 weight_col: str | None = None, path: str | None = None):
        super().__init__()
        common = dict(patience=patience, batch_size=batch_size, rate=rate, seed=seed)
        self.ae = Autoencoder(encoder, decoder, epochs=ae_epochs, path=path and f"{path}/ae", **common)
        self.net = NetworkClassifier(hidden, epochs=epochs, weight_col=weight_col, path=path and f"{path}/net", **common)

    def _fit(self, dataset: DataFrame) -> NetworkModel:
        table = _table(dataset, self.net.weight_col, "label_idx")
        unsup = F.coalesce(F.col("role") == "unsup", F.lit(False))
        some = table.where(unsup).limit(1).count() > 0
        plain = table.withColumn("w", F.lit(1.0))
        layers, flat, _ = self.ae.fit_table(plain.where(unsup | F.col("val")) if some else plain)
        code = len(self.ae.encoder)
        coder = NetworkModel([(layers, flat)], code)
        labelled = table.where(~unsup) if some else table
        coded = cut_lineage(labelled.withColumn("x", coder._outputs(F.col("x"), 0, code)))
        last, weights, history = self.net.fit_table(coded)
        return NetworkModel([(layers, flat), (last, weights)], code, history)
