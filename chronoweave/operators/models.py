"""Scorers: a trained linear model, and a numpy Transformer encoder with attributions and attention.

The linear scorer is the one meant for scale. The encoder has no published
weights here; it is for users who bring their own (`Encoder(weights)`), and its
results are no claim of parity with any published model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD = 0

#: Up to so many positions uniformly drawn subsets are of all sizes; of more, nearly all are about half.
UNIFORM = 15


@lru_cache(maxsize=1)
def _subsets(k: int, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subsets of k positions [M, K] for the Shapley kernel, and what solves its regression: the weights [K, M] of the values, and the direction [K] that makes up the sum.

    All subsets of one position, and all but one, are there; the sizes between are
    drawn as the kernel weighs them, each subset with its complement, so that
    effects of pairs of positions are split without error. Depends on no
    sequence: the last one is kept, for sequences in the order of k.
    """
    rng = np.random.default_rng(seed)
    s = np.arange(1, k)
    weight = (k - 1) / (s * (k - s))  # of all subsets of a size together
    inner = weight[1:-1]
    size = rng.choice(s[1:-1], -(-draws // 2), p=inner / inner.sum())
    few = (rng.random((len(size), k)).argsort(1).argsort(1) < size[:, None]).astype(float)
    z = np.vstack([np.eye(k), 1 - np.eye(k), few, 1 - few])
    wt = np.concatenate([np.full(2 * k, weight[0] / k), np.full(2 * len(few), inner.sum() / (2 * len(few)))])
    solved = np.linalg.solve((z.T * wt) @ z, np.hstack([z.T * wt, np.ones((k, 1))]))
    return z, solved[:, :-1], solved[:, -1] / solved[:, -1].sum()


def weighted(df: DataFrame, label: str) -> DataFrame:
    """Adds `weight`: negatives per positive for positives, one for the rest."""
    w = df.agg((F.count_if(F.col(label) == 0) / F.nullif(F.count_if(F.col(label) == 1), F.lit(0))).alias("__w"))
    return df.join(F.broadcast(w)).withColumn("weight", F.when(F.col(label) == 1, F.coalesce("__w", F.lit(1.0))).otherwise(1.0)).drop("__w")


def train_tokens(df: DataFrame, tokens: str = "tokens", label: str = "y", features: int = 1 << 14, reg: float = 0.01, max_iter: int = 50):
    """A class-weighted logistic model over hashed token counts, fitted distributed; rows without label are left out, and no rows give no model."""
    rows = weighted(df.where(F.col(label).isNotNull()), label)
    if rows.isEmpty():
        return None
    stages = [HashingTF(inputCol=tokens, outputCol="features", numFeatures=features), LogisticRegression(labelCol=label, weightCol="weight", regParam=reg, maxIter=max_iter)]
    return Pipeline(stages=stages).fit(rows)


def train_columns(df: DataFrame, columns: list[str], label: str, kind: str = "linear", standardize: bool = True, trees: int = 200):
    """A model over numeric columns: `linear` or `boosted` (trees of depth 4, step 0.05); no rows give no model."""
    rows = weighted(df.where(F.col(label).isNotNull()).dropna(subset=columns), label)
    if rows.isEmpty():
        return None
    stages = [VectorAssembler(inputCols=columns, outputCol="raw")]
    if standardize:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True))
    else:
        stages[0].setOutputCol("features")
    stages.append(LogisticRegression(labelCol=label, weightCol="weight") if kind == "linear" else GBTClassifier(labelCol=label, weightCol="weight", maxIter=trees, maxDepth=4, stepSize=0.05, seed=42))
    return Pipeline(stages=stages).fit(rows)


def with_score(model, df: DataFrame) -> DataFrame:
    """Adds score, the probability of the positive class; null without a model. A column of that name is replaced."""
    cols = [c for c in df.columns if c != "score"]
    if model is None:
        return df.select(*cols, F.lit(None).cast("double").alias("score"))
    return model.transform(df).select(*cols, vector_to_array("probability")[1].alias("score"))


def _norm(x: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    m = x.mean(-1, keepdims=True)
    return (x - m) / np.sqrt(((x - m) ** 2).mean(-1, keepdims=True) + 1e-5) * g + b


def _norm_back(x: np.ndarray, g: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Gradient by x of _norm(x, g, b), given that by its result."""
    c = x - x.mean(-1, keepdims=True)
    s = np.sqrt((c**2).mean(-1, keepdims=True) + 1e-5)
    c, dy = c / s, dy * g
    return (dy - dy.mean(-1, keepdims=True) - c * (dy * c).mean(-1, keepdims=True)) / s


class Encoder:
    """Pre-norm Transformer encoder over token ids with a classification head on the first position."""

    def __init__(self, weights: dict[str, np.ndarray], heads: int):
        self.w, self.heads = weights, heads
        self.layers = sum(k.startswith("qkv_w") for k in weights)

    @classmethod
    def random(cls, vocab: int, dim: int = 32, heads: int = 4, layers: int = 2, max_len: int = 512, seed: int = 0) -> Encoder:
        rng = np.random.default_rng(seed)
        m = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        w = {"tok": rng.normal(0, 1, (vocab, dim)), "pos": rng.normal(0, 0.1, (max_len, dim)), "emb_g": np.ones(dim), "emb_b": np.zeros(dim)}
        w["tok"][PAD] = 0
        for i in range(layers):
            w |= {f"qkv_w{i}": m(dim, 3 * dim), f"qkv_b{i}": np.zeros(3 * dim), f"out_w{i}": m(dim, dim), f"out_b{i}": np.zeros(dim), f"up_w{i}": m(dim, 4 * dim), f"up_b{i}": np.zeros(4 * dim), f"down_w{i}": m(4 * dim, dim), f"down_b{i}": np.zeros(dim)}
            w |= {f"{n}_{x}{i}": v for n in ("n1", "n2") for x, v in (("g", np.ones(dim)), ("b", np.zeros(dim)))}
        w |= {"head_w0": m(dim, dim // 2), "head_b0": np.zeros(dim // 2), "head_w1": m(dim // 2, 1), "head_b1": np.zeros(1)}
        return cls(w, heads)

    def embed(self, ids: np.ndarray) -> np.ndarray:
        return self.w["tok"][ids]

    def run(self, emb: np.ndarray, pad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits [B] and mean attention [B, L, L] over layers and heads, from token embeddings [B, L, D]."""
        w, (n, length, dim) = self.w, emb.shape
        x = _norm(emb + w["pos"][:length], w["emb_g"], w["emb_b"])
        seen = np.zeros((n, length, length))
        hide = np.where(pad, -1e9, 0.0)[:, None, None, :]
        for i in range(self.layers):
            h = _norm(x, w[f"n1_g{i}"], w[f"n1_b{i}"]) @ w[f"qkv_w{i}"] + w[f"qkv_b{i}"]
            q, k, v = (t.reshape(n, length, self.heads, -1).transpose(0, 2, 1, 3) for t in np.split(h, 3, axis=-1))
            a = q @ k.transpose(0, 1, 3, 2) / np.sqrt(dim // self.heads) + hide
            a = np.exp(a - a.max(-1, keepdims=True))
            a /= a.sum(-1, keepdims=True)
            seen += a.mean(1) / self.layers
            x = x + (a @ v).transpose(0, 2, 1, 3).reshape(n, length, dim) @ w[f"out_w{i}"] + w[f"out_b{i}"]
            h = _norm(x, w[f"n2_g{i}"], w[f"n2_b{i}"]) @ w[f"up_w{i}"] + w[f"up_b{i}"]
            x = x + np.maximum(h, 0) @ w[f"down_w{i}"] + w[f"down_b{i}"]
        h = np.maximum(x[:, 0] @ w["head_w0"] + w["head_b0"], 0)
        return (h @ w["head_w1"] + w["head_b1"])[:, 0], seen

    def logits(self, ids: np.ndarray) -> np.ndarray:
        return self._slope(self.embed(ids), ids == PAD, False)[0]

    def _slope(self, emb: np.ndarray, pad: np.ndarray, back: bool = True, weigh: Callable[[np.ndarray], np.ndarray] | None = None, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Logits [B] and their gradients by the embeddings [B, L, D].

        Only the first position's output is scored, so the last layer computes
        that row alone and needs no attention of every position to every other.
        With `weigh`, logits to the derivative of a loss by each, the gradients are
        the loss's; `grads` is filled with those by the weights, all but `tok`.
        """
        w, (n, length, dim), d = self.w, emb.shape, emb.shape[2] // self.heads
        split = lambda t: t.reshape(n, -1, self.heads, d).transpose(0, 2, 1, 3)
        join = lambda t: t.transpose(0, 2, 1, 3).reshape(n, -1, dim)
        hide = np.where(pad, -1e9, 0.0)[:, None, None, :]
        start = emb + w["pos"][:length]
        x = _norm(start, w["emb_g"], w["emb_b"])
        kept = []
        for i in range(self.layers):
            rows = slice(0, 1) if i == self.layers - 1 else slice(None)
            h = _norm(x, w[f"n1_g{i}"], w[f"n1_b{i}"])
            wq, wk, wv = np.split(w[f"qkv_w{i}"], 3, axis=1)
            bq, bk, bv = np.split(w[f"qkv_b{i}"], 3)
            q, k, v = split(h[:, rows] @ wq + bq), split(h @ wk + bk), split(h @ wv + bv)
            a = q @ k.transpose(0, 1, 3, 2) / np.sqrt(d) + hide
            a = np.exp(a - a.max(-1, keepdims=True))
            a /= a.sum(-1, keepdims=True)
            mid = x[:, rows] + join(a @ v) @ w[f"out_w{i}"] + w[f"out_b{i}"]
            up = _norm(mid, w[f"n2_g{i}"], w[f"n2_b{i}"]) @ w[f"up_w{i}"] + w[f"up_b{i}"]
            kept.append((rows, x, q, k, v, a, mid, up))
            x = mid + np.maximum(up, 0) @ w[f"down_w{i}"] + w[f"down_b{i}"]
        h = x[:, 0] @ w["head_w0"] + w["head_b0"]
        out = (np.maximum(h, 0) @ w["head_w1"] + w["head_b1"])[:, 0]
        if not back:
            return out, None
        flat = lambda t: t.reshape(-1, t.shape[-1])

        def linear(name: str, i: int, before: np.ndarray, dy: np.ndarray) -> None:
            if grads is not None:
                grads[f"{name}_w{i}"], grads[f"{name}_b{i}"] = flat(before).T @ flat(dy), flat(dy).sum(0)

        def scale(name: str, i: int | str, before: np.ndarray, dy: np.ndarray) -> None:
            if grads is not None:
                one = np.ones(dim)
                grads[f"{name}_g{i}"], grads[f"{name}_b{i}"] = flat(dy * _norm(before, one, 0 * one)).sum(0), flat(dy).sum(0)

        g = np.zeros_like(x)
        dl = np.ones((n, 1)) if weigh is None else weigh(out)[:, None]
        dh = dl * (h > 0) * w["head_w1"][:, 0]
        linear("head", 1, np.maximum(h, 0), dl)
        linear("head", 0, x[:, 0], dh)
        g[:, 0] = dh @ w["head_w0"].T
        for i in reversed(range(self.layers)):
            rows, x, q, k, v, a, mid, up = kept[i]
            gu = (g @ w[f"down_w{i}"].T) * (up > 0)
            gm = gu @ w[f"up_w{i}"].T
            if grads is not None:
                linear("down", i, np.maximum(up, 0), g)
                linear("up", i, _norm(mid, w[f"n2_g{i}"], w[f"n2_b{i}"]), gu)
                scale("n2", i, mid, gm)
            g = g + _norm_back(mid, w[f"n2_g{i}"], gm)
            o = split(g @ w[f"out_w{i}"].T)
            ga = o @ v.transpose(0, 1, 3, 2)
            gs = a * (ga - (ga * a).sum(-1, keepdims=True)) / np.sqrt(d)
            wq, wk, wv = np.split(w[f"qkv_w{i}"], 3, axis=1)
            gq, gk, gv = join(gs @ k), join(gs.transpose(0, 1, 3, 2) @ q), join(a.transpose(0, 1, 3, 2) @ o)
            gh = gk @ wk.T + gv @ wv.T
            gh[:, rows] += gq @ wq.T
            if grads is not None:
                linear("out", i, join(a @ v), g)
                h = _norm(x, w[f"n1_g{i}"], w[f"n1_b{i}"])
                grads[f"qkv_w{i}"] = np.hstack([flat(h[:, rows]).T @ flat(gq), flat(h).T @ flat(gk), flat(h).T @ flat(gv)])
                grads[f"qkv_b{i}"] = np.concatenate([flat(t).sum(0) for t in (gq, gk, gv)])
                scale("n1", i, x, gh)
            gx = _norm_back(x, w[f"n1_g{i}"], gh)
            gx[:, rows] += g
            g = gx
        scale("emb", "", start, g)
        g = _norm_back(start, w["emb_g"], g)
        if grads is not None:
            grads["pos"] = np.zeros_like(w["pos"])
            grads["pos"][:length] = g.sum(0)
        return out, g

    def loss(self, ids: np.ndarray, y: np.ndarray, positive: float = 1.0) -> tuple[float, dict[str, np.ndarray]]:
        """Mean weighted cross-entropy of labels y, positives counting `positive` times, and its gradients by all weights."""
        wt = np.where(y > 0, positive, 1.0)
        grads: dict[str, np.ndarray] = {}
        out, g = self._slope(self.embed(ids), ids == PAD, True, lambda f: wt * (1 / (1 + np.exp(-f)) - y) / len(y), grads)
        grads["tok"] = np.zeros_like(self.w["tok"])
        np.add.at(grads["tok"], ids.ravel(), g.reshape(-1, g.shape[-1]))
        grads["tok"][PAD] = 0
        return float((wt * np.logaddexp(0, np.where(y > 0, -out, out))).mean()), grads

    def integrated(self, ids: np.ndarray, steps: int = 16, baseline: np.ndarray | None = None) -> np.ndarray:
        """Attribution of each position: the path integral from the padding embedding (or a baseline; a stack of them gives the mean), positions kept."""
        x, pad = self.embed(ids[None])[0], ids == PAD
        base = self.embed(np.zeros_like(ids)[None]) if baseline is None else baseline.reshape(-1, *x.shape)
        out = np.zeros(len(ids))
        at = np.linspace(0, 1, steps + 1)[:, None, None]
        for b in base:
            delta = x - b
            slope = self._slope(b + at * delta, np.repeat(pad[None], steps + 1, 0))[1]
            out += (slope.mean(0) * delta).sum(-1) / len(base)
        return np.where(pad, 0.0, out)

    def shapley_kernel(self, ids: np.ndarray, positions: list[int], samples: int = 200, seed: int = 0) -> np.ndarray:
        """Kernel-weighted regression over masked subsets of the positions; the other tokens stay.

        Any number of positions: beyond UNIFORM the subsets grow with them, `samples`
        for each UNIFORM positions, and are drawn by size (_subsets); the values then
        add up to the change of the logit exactly.
        """
        k = len(positions)
        if k > UNIFORM:
            z, by, sum_by = _subsets(k, -(-samples * k // UNIFORM), seed)
            f = self._without(ids, positions, np.vstack([np.zeros((1, k)), np.ones((1, k)), z]))
            value = by @ (f[2:] - f[0])
            return value + sum_by * (f[1] - f[0] - value.sum())
        rng = np.random.default_rng(seed)
        z = np.vstack([np.zeros(k, int), np.ones(k, int), rng.integers(0, 2, (samples, k))])
        f = self._without(ids, positions, z)
        size = z.sum(1)
        from math import comb

        wt = np.array([1e6 if s in (0, k) else (k - 1) / (comb(k, s) * s * (k - s)) for s in size])
        a = np.hstack([np.ones((len(z), 1)), z]) * np.sqrt(wt)[:, None]
        return np.linalg.lstsq(a, f * np.sqrt(wt), rcond=None)[0][1:]

    def _without(self, ids: np.ndarray, positions: list[int], z: np.ndarray) -> np.ndarray:
        """Logits of the sequence for each row of z, without the positions where it is 0.

        In one layer only the first position attends, and what is masked drops out
        of its attention: so every position's key and value are computed once, and
        each subset is a sum over them.
        """
        if self.layers == 1 and 0 not in positions and ids[0] != PAD:
            w, dim, d = self.w, self.w["tok"].shape[1], self.w["tok"].shape[1] // self.heads
            x = _norm(self.embed(ids) + w["pos"][: len(ids)], w["emb_g"], w["emb_b"])
            h = _norm(x, w["n1_g0"], w["n1_b0"])
            q, k, v = (t.reshape(len(t), self.heads, d) for t in np.split(h @ w["qkv_w0"] + w["qkv_b0"], 3, axis=1))
            a = np.einsum("hd,lhd->lh", q[0], k) / np.sqrt(d)
            a = np.where(ids[:, None] == PAD, 0.0, np.exp(a - a[ids != PAD].max(0)))
            terms = np.concatenate([a, (a[:, :, None] * v).reshape(len(ids), dim)], axis=1)
            rest = np.ones(len(ids), bool)
            rest[positions] = False
            total = terms[rest].sum(0) + z @ terms[positions]
            if total[:, : self.heads].min() > 1e-100:
                mixed = (total[:, self.heads :].reshape(-1, self.heads, d) / total[:, : self.heads, None]).reshape(-1, dim)
                mid = x[0] + mixed @ w["out_w0"] + w["out_b0"]
                up = _norm(mid, w["n2_g0"], w["n2_b0"]) @ w["up_w0"] + w["up_b0"]
                y = mid + np.maximum(up, 0) @ w["down_w0"] + w["down_b0"]
                return (np.maximum(y @ w["head_w0"] + w["head_b0"], 0) @ w["head_w1"] + w["head_b1"])[:, 0]
        masked = np.repeat(ids[None], len(z), 0)
        for j, p in enumerate(positions):
            masked[z[:, j] == 0, p] = PAD
        return np.concatenate([self.logits(masked[i : i + 64]) for i in range(0, len(z), 64)])

    def expected_gradients(self, ids: np.ndarray, background: np.ndarray, seed: int = 0, draws: int = 8) -> np.ndarray:
        """Path attributions averaged over random background sequences and path points."""
        rng = np.random.default_rng(seed)
        base = np.zeros((draws, len(ids)), ids.dtype)
        n = min(background.shape[1], len(ids))
        base[:, :n] = background[rng.integers(0, len(background), draws), :n]
        return self.integrated(ids, 2, self.embed(base))


class AdamW:
    """Adam with decoupled weight decay, in place on a dictionary of weights."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float, decay: float, b1: float = 0.9, b2: float = 0.999):
        self.w, self.rate, self.decay, self.b1, self.b2, self.t = weights, rate, decay, b1, b2, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in weights.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = self.b1 * self.m[k] + (1 - self.b1) * g
            self.v[k] = self.b2 * self.v[k] + (1 - self.b2) * g * g
            m, v = self.m[k] / (1 - self.b1**self.t), self.v[k] / (1 - self.b2**self.t)
            self.w[k] -= self.rate * (m / (np.sqrt(v) + 1e-8) + self.decay * self.w[k])


def train_encoder(train: DataFrame, validation: DataFrame, start: Encoder, epochs: int = 50, rate: float = 1e-3, decay: float = 0.01, patience: int = 5, batch: int = 64, workers: int = 64, seed: int = 0) -> tuple[Encoder, list[dict]]:
    """The encoder of the best epoch by validation AUROC, and the history (epoch, train_loss, val_auroc, val_average_precision).

    train, validation: (key, input_ids, y). In every epoch each of at most
    `workers` tasks goes through its rows in hash order by batches of `batch`, with
    AdamW on its own copy of the weights; the copies are averaged by rows. So an
    epoch is one job over the whole data, and what reaches the driver is `workers`
    times the size of the weights. Positives count as negatives per positive.
    Training stops after `patience` epochs without a better AUROC.
    Rows without label or ids are left out; without training rows the start is
    returned with no history.
    """
    from chronoweave.common import checkpointed
    from chronoweave.operators import metrics as Me

    sc = train.sparkSession.sparkContext
    known = lambda df: df.where("y is not null and size(input_ids) > 0").select("key", "input_ids", "y")
    rows = checkpointed(known(train).repartition(max(1, min(workers, sc.defaultParallelism)), "key"))
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("y").cast("int")), F.lit(0))).first()
    if not n:
        return start, []
    positive = (n - pos) / max(pos, 1)
    held = checkpointed(known(validation))
    weights = {k: x.copy() for k, x in start.w.items()}
    best, best_auroc, waited, history = start, 0.0, 0, []
    for epoch in range(1, epochs + 1):
        shared = sc.broadcast(Encoder(weights, start.heads))

        def fit(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mine = Encoder({k: x.copy() for k, x in shared.value.w.items()}, shared.value.heads)
            adam = AdamW(mine.w, rate, decay)
            seen, total = 0, 0.0
            for pdf in pdfs:
                pdf = pdf.sample(frac=1.0, random_state=seed + epoch)
                for i in range(0, len(pdf), batch):
                    part = pdf.iloc[i : i + batch]
                    loss, grads = mine.loss(_padded(list(part["input_ids"])), part["y"].to_numpy(float), positive)
                    adam.step(grads)
                    seen, total = seen + len(part), total + loss * len(part)
            if seen:
                yield pd.DataFrame({"n": [seen], "loss": [total], "w": [np.concatenate([mine.w[k].ravel() for k in sorted(mine.w)]).tobytes()]})

        got = rows.mapInPandas(fit, "n bigint, loss double, w binary").collect()
        shared.destroy()
        mean = sum(np.frombuffer(r.w) * (r.n / n) for r in got)
        at, weights = 0, {}
        for k in sorted(start.w):
            shape = start.w[k].shape
            weights[k] = mean[at : at + start.w[k].size].reshape(shape).copy()
            at += start.w[k].size
        model = Encoder(weights, start.heads)
        scores = checkpointed(predicted(held, model).join(held.select("key", "y"), "key"))
        auroc, ap = Me.auroc(scores, F.col("score"), F.col("y")).first()[0], Me.average_precision(scores, F.col("score"), F.col("y")).first()[0]
        history.append({"epoch": epoch, "train_loss": sum(r.loss for r in got) / n, "val_auroc": auroc, "val_average_precision": ap})
        if auroc is not None and auroc > best_auroc:
            best, best_auroc, waited = Encoder({k: x.copy() for k, x in weights.items()}, start.heads), auroc, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return (best if best_auroc else Encoder(weights, start.heads)), history


def _padded(lists: list, least: int = 1) -> np.ndarray:
    n = max([least, *(len(x) for x in lists)])
    out = np.zeros((len(lists), n), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _over(df: DataFrame, encoder: Encoder, schema: str, one: Callable[[Encoder, pd.DataFrame], pd.DataFrame], batch: int = 64) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(encoder)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            pdf = pdf.iloc[np.argsort([0 if x is None else len(x) for x in pdf["input_ids"]], kind="stable")]  # little padding
            for i in range(0, len(pdf), batch):
                yield one(shared.value, pdf.iloc[i : i + batch])

    return df.mapInPandas(run, schema)


def predicted(encoded: DataFrame, encoder: Encoder) -> DataFrame:
    """(key, score) of (key, input_ids), padded per batch; rows without ids score null."""

    def one(e: Encoder, pdf: pd.DataFrame) -> pd.DataFrame:
        has = pdf["input_ids"].map(lambda x: x is not None and len(x) > 0)
        ids = _padded([x if h else [] for x, h in zip(pdf["input_ids"], has)])
        s = 1 / (1 + np.exp(-e.logits(ids)))
        return pd.DataFrame({"key": pdf["key"], "score": pd.Series(np.where(has, s, np.nan), pdf.index).astype(object).where(has, None)})

    return _over(encoded.select("key", "input_ids"), encoder, "key string, score double", one)


def path_attributions(encoded: DataFrame, encoder: Encoder, steps: int = 16) -> DataFrame:
    """(key, pos, attr) of every position of (key, input_ids)."""

    def one(e: Encoder, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(k, p, float(a)) for k, ids in zip(pdf["key"], pdf["input_ids"]) if ids is not None and len(ids) for p, a in enumerate(e.integrated(np.asarray(ids, np.int64), steps))]
        return pd.DataFrame(rows, columns=["key", "pos", "attr"])

    return _over(encoded.select("key", "input_ids"), encoder, "key string, pos int, attr double", one, 8)


def kernel_attributions(encoded: DataFrame, positions: DataFrame, encoder: Encoder, samples: int = 200) -> DataFrame:
    """(key, pos, value) for the given (key, pos), any number of positions per key."""
    p = positions.groupBy("key").agg(F.array_sort(F.collect_set("pos")).alias("positions"))

    def one(e: Encoder, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for k, ids, pos in zip(pdf["key"], pdf["input_ids"], pdf["positions"]):
            rows += [(k, int(q), float(v)) for q, v in zip(pos, e.shapley_kernel(np.asarray(ids, np.int64), list(pos), samples))]
        return pd.DataFrame(rows, columns=["key", "pos", "value"])

    return _over(encoded.join(p, "key").select("key", "input_ids", "positions"), encoder, "key string, pos int, value double", one, 8)


def token_comparison(encoded: DataFrame, encoder: Encoder, specials: int = 3, samples: int = 200) -> DataFrame:
    """Per id of (key, input_ids) from `specials` on: n_path, path, n_kernel, kernel: counts and means of both attributions.

    The kernel values, too, are those of every position of such ids. A sequence is
    attributed once and each task hands on sums by id only.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(encoder)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = shared.value
        size = len(e.w["tok"])
        sums, counts = np.zeros((2, size)), np.zeros((2, size), np.int64)
        for pdf in pdfs:
            known = [np.asarray(x, np.int64) for x in pdf["input_ids"] if x is not None and len(x)]
            for ids in sorted(known, key=lambda ids: (ids >= specials).sum()):  # as many positions, the same subsets
                np.add.at(sums[0], ids, e.integrated(ids))
                np.add.at(counts[0], ids, 1)
                pos = np.flatnonzero(ids >= specials)
                if len(pos):
                    np.add.at(sums[1], ids[pos], e.shapley_kernel(ids, list(pos), samples))
                    np.add.at(counts[1], ids[pos], 1)
        some = np.flatnonzero(counts[0])
        yield pd.DataFrame({"id": some, "n_path": counts[0, some], "path": sums[0, some], "n_kernel": counts[1, some], "kernel": sums[1, some]})

    rows = encoded.select("input_ids").mapInPandas(run, "id long, n_path long, path double, n_kernel long, kernel double")
    total = rows.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n_path", "path", "n_kernel", "kernel")]).where("n_kernel > 0")
    return total.select("id", "n_path", (F.col("path") / F.col("n_path")).alias("path"), "n_kernel", (F.col("kernel") / F.col("n_kernel")).alias("kernel"))


def global_gradients(encoded: DataFrame, encoder: Encoder, background: list[list[int]]) -> DataFrame:
    """(token_id, n, value): expected gradients averaged per occurrence. background: a bounded list of sequences."""
    bg = _padded([list(b) for b in background[:20]])

    def one(e: Encoder, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(i), float(v)) for ids in pdf["input_ids"] if ids is not None and len(ids) for i, v in zip(ids, e.expected_gradients(np.asarray(ids, np.int64), bg))]
        return pd.DataFrame(rows, columns=["token_id", "value"])

    return _over(encoded.select("key", "input_ids"), encoder, "token_id int, value double", one, 4).groupBy("token_id").agg(F.count("*").alias("n"), F.avg("value").alias("value"))


def attention_flow(encoded: DataFrame, positions: DataFrame, encoder: Encoder, tolerance: int = 5, cap: int = 20) -> DataFrame:
    """Attention among a pattern's positions against pairs outside it at like distances.

    positions: (pattern_id, key, positions). Output per pattern: n_samples (all
    matches), mean_cross, mean_baseline, ratio, uplift. Matches of fewer than two
    positions count as samples and give no attention.
    """

    def flow(a: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> tuple[float | None, float | None]:
        rest = np.setdiff1d(np.flatnonzero(ids != PAD), pos)
        if len(pos) < 2 or not len(rest):
            return None, None
        i, j = np.nonzero(~np.eye(len(pos), dtype=bool))

        def first(k: int, m: int) -> np.ndarray:
            """The first `cap` pairs of the first m rows at about distance k."""
            far = np.abs(rest[:m, None] - rest[None])
            x, y = np.nonzero((np.abs(far - k) <= tolerance) & (far > 0))
            return a[rest[x[:cap]], rest[y[:cap]]]

        near, times = [], []
        for k, n in zip(*np.unique(np.abs(pos[i] - pos[j]), return_counts=True)):
            val = first(k, 8)
            if len(val) < cap < 8 * len(rest) and len(rest) > 8:
                val = first(k, len(rest))
            if len(val):
                near.append(val.mean())
                times.append(n)
        cross = float(a[pos[i], pos[j]].mean())
        if near:
            return cross, float(np.average(near, weights=times))
        n = len(rest)
        among = a[np.ix_(rest, rest)]
        return cross, float((among.sum() - np.trace(among)) / (n * n - n)) if n > 1 else None

    def one(e: Encoder, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for ids, found in zip(pdf["input_ids"], pdf["found"]):
            ids = np.asarray(ids, np.int64)
            a = e.run(e.embed(ids[None]), (ids == PAD)[None])[1][0]  # once for all patterns of the sequence
            rows += [(f["pattern_id"], *flow(a, ids, np.array([x for x in f["positions"] if x < len(ids)], int))) for f in found]
        return pd.DataFrame(rows, columns=["pattern_id", "cross", "base"])

    found = positions.groupBy("key").agg(F.collect_list(F.struct("pattern_id", "positions")).alias("found"))
    rows = _over(found.join(encoded, "key").select("input_ids", "found"), encoder, "pattern_id string, cross double, base double", one, 8)
    out = rows.groupBy("pattern_id").agg(F.count("*").alias("n_samples"), F.avg("cross").alias("mean_cross"), F.coalesce(F.avg("base"), F.lit(0.0)).alias("mean_baseline")).where("mean_cross is not null")
    return out.withColumn("ratio", F.col("mean_cross") / F.greatest("mean_baseline", F.lit(1e-8))).withColumn("uplift", F.col("mean_cross") - F.col("mean_baseline"))
