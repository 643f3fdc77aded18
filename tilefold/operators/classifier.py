"""A small convolutional network that picks a tile's format from its bitmap."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilefold.functions import bits as B
from tilefold.functions.staging import saved

CONV = (32, 64, 128)
FULL = (256, 128)


def activations(x: Column, whole: Column) -> dict[str, Column]:
    """relu, tanh and softmax of an entry of an array, and the slopes of the first two."""
    total = F.aggregate(whole, F.lit(0.0), lambda s, v: s + F.exp(v))
    return {"relu": F.greatest(x, F.lit(0.0)), "relu_slope": F.when(x > 0, 1.0).otherwise(0.0), "tanh": F.tanh(x), "tanh_slope": 1 - F.tanh(x) * F.tanh(x), "softmax": F.exp(x) / total}


def _moments() -> tuple[Column, Column]:
    mean = F.col("nnz") / 256
    return mean.alias("mean"), F.sqrt(mean * (1 - mean)).alias("deviation")


def tile_moments(tiles: DataFrame) -> DataFrame:
    """(ti, tj, mean, deviation) of the 256 bits of tiles(): the figures that image() scales by."""
    return tiles.select("ti", "tj", *_moments())


def _scaled(tiles: DataFrame, made: Callable[[Column], Column]) -> DataFrame:
    """(ti, tj, masks, off, on): what image() makes of a bit that is 0 and of one that is 1, which are a tile's only two values."""
    value = lambda bit: made((F.lit(bit) - F.col("mean")) / F.greatest(F.col("deviation"), F.lit(1e-6)))
    return tiles.select("ti", "tj", "masks", *_moments()).select("ti", "tj", "masks", value(0.0).alias("off"), value(1.0).alias("on"))


def _pixel(p: Column) -> Column:
    return F.when(B.has_bit(F.element_at("masks", F.shiftright(p, 4) + 1), p.bitwiseAND(F.lit(15))), F.col("on")).otherwise(F.col("off"))


def tile_images(tiles: DataFrame) -> DataFrame:
    """(ti, tj, pixels): the 256 bits of tiles() scaled to mean 0 and deviation 1, as image() does, in column expressions."""
    return _scaled(tiles, lambda v: v).select("ti", "tj", F.transform(F.sequence(F.lit(0), F.lit(255)), _pixel).alias("pixels"))


def tile_pixels(tiles: DataFrame, made: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """(ti, tj, p, pixel): the images of tile_images() as a row for each place, with what `made` gives for a value. It works on
    two values a tile; the rows only pick one of them, in compiled code."""
    places = _scaled(tiles, made).select("*", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("p"))
    return places.select("ti", "tj", "p", _pixel(F.col("p")).alias("pixel"))


def image(bits: str) -> np.ndarray:
    """A 0/1 string as a 16x16 image of mean 0 and deviation 1."""
    x = (np.frombuffer(bits.encode(), np.uint8) - 48).astype(np.float64).reshape(16, 16)
    return (x - x.mean()) / max(x.std(), 1e-6)


def _patches(x: np.ndarray) -> np.ndarray:
    """3x3 neighbourhoods with zero borders: (n, channels, h, w) -> (n, h, w, 9 * channels)."""
    p = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    v = np.lib.stride_tricks.sliding_window_view(p, (3, 3), (2, 3))
    return v.transpose(0, 2, 3, 1, 4, 5).reshape(len(x), x.shape[2], x.shape[3], -1)


def _near(x: np.ndarray) -> np.ndarray:
    """The same with images last, which makes long runs of numbers: (c, h, h, n) -> (9 c, h h n), the place before the channel."""
    c, h, _, n = x.shape
    wide, near = np.zeros((c, h + 2, h + 2, n), x.dtype), np.empty((9, c, h, h, n), x.dtype)
    wide[:, 1:-1, 1:-1] = x
    for k in range(9):
        near[k] = wide[:, k // 3 : k // 3 + h, k % 3 : k % 3 + h]
    return near.reshape(9 * c, -1)


def _by_place(w: np.ndarray) -> np.ndarray:
    """Weights of a convolution in the order of _near(), a row for each channel that it makes."""
    return np.ascontiguousarray(w.reshape(-1, 9, w.shape[1]).transpose(2, 1, 0)).reshape(w.shape[1], -1)


def _quarters(y: np.ndarray) -> list[np.ndarray]:
    """The four places of each 2x2 block."""
    return [y[:, a::2, b::2] for a in (0, 1) for b in (0, 1)]


def _top(y: np.ndarray) -> np.ndarray:
    q = _quarters(y)
    return np.maximum(np.maximum(q[0], q[1]), np.maximum(q[2], q[3]))


class Network:
    """Three convolutions with 2x2 maximum pooling, two full layers, and softmax over the classes."""

    def __init__(self, classes: int, conv: tuple[int, ...] = CONV, full: tuple[int, ...] = FULL, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.conv, self.full, sizes, c = [], [], [], 1
        for n in conv:
            self.conv.append([rng.standard_normal((9 * c, n)) * np.sqrt(2 / (9 * c)), np.zeros(n)])
            c = n
        sizes = [c * (16 >> len(conv)) ** 2, *full, classes]
        for a, b in zip(sizes, sizes[1:]):
            self.full.append([rng.standard_normal((a, b)) * np.sqrt(2 / a), np.zeros(b)])

    def forward(self, x: np.ndarray) -> np.ndarray:
        x = x[:, None]
        for w, b in self.conv:
            p = _patches(x)
            y = np.maximum(p @ w + b, 0).transpose(0, 3, 1, 2)
            n, c, h, _ = y.shape
            blocks = y.reshape(n, c, h // 2, 2, h // 2, 2).transpose(0, 1, 2, 4, 3, 5).reshape(n, c, h // 2, h // 2, 4)
            x = blocks.max(-1)
        x = x.reshape(len(x), -1)
        for k, (w, b) in enumerate(self.full):
            x = x @ w + b
            if k < len(self.full) - 1:
                x = np.maximum(x, 0)
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def labels(self, x: np.ndarray) -> np.ndarray:
        """The class that forward() gives each image: images lie last and a layer is one product, which takes a fraction of the time."""
        x = np.ascontiguousarray(x.transpose(1, 2, 0))[None]
        for w, b in self.conv:
            x = np.maximum(_top((_by_place(w) @ _near(x)).reshape(-1, *x.shape[1:])) + b[:, None, None, None], 0)
        x = x.reshape(-1, x.shape[3])
        for k, (w, b) in enumerate(self.full):
            x = w.T @ x + b[:, None]
            if k < len(self.full) - 1:
                x = np.maximum(x, 0)
        return x.argmax(0)

    def step(self, x: np.ndarray, label: np.ndarray, rate: float) -> float:
        """One gradient step on the cross entropy; the loss before it. Images lie last."""
        x, convs, fulls = np.ascontiguousarray(x.transpose(1, 2, 0))[None], [], []
        for w, b in self.conv:
            near, own = _near(x), _by_place(w)
            y = (own @ near).reshape(-1, *x.shape[1:]) + b[:, None, None, None]
            x = np.maximum(_top(y), 0)
            convs.append((near, own, y, x))
        shape = x.shape
        x = x.reshape(-1, shape[3])
        for k, (w, b) in enumerate(self.full):
            fulls.append(x)
            x = w.T @ x + b[:, None]
            if k < len(self.full) - 1:
                x = np.maximum(x, 0)
        e = np.exp(x - x.max(0))
        g = e / e.sum(0)
        each = np.arange(shape[3])
        loss = float(-np.log(g[label, each] + 1e-12).mean())
        g[label, each] -= 1
        g /= shape[3]
        for k in range(len(self.full) - 1, -1, -1):
            w, b = self.full[k]
            back = w @ g
            w -= rate * (fulls[k] @ g.T)
            b -= rate * g.sum(1)
            g = back * (fulls[k] > 0) if k else back
        g = g.reshape(shape)
        for k in range(len(self.conv) - 1, -1, -1):
            w, b = self.conv[k]
            near, own, y, top = convs[k]
            g, left, d = g * (top > 0), np.ones(top.shape, bool), np.empty_like(y)
            for into, q in zip(_quarters(d), _quarters(y)):  # a block's slope goes to the first of its greatest places
                hit = left & (q == top)
                left &= ~hit
                np.multiply(g, hit, out=into)
            flat = d.reshape(len(d), -1)
            if k:
                c, h, _, n = convs[k - 1][3].shape
                spread, out = (own.T @ flat).reshape(9, c, h, h, n), np.zeros((c, h + 2, h + 2, n), d.dtype)
                for m in range(9):
                    out[:, m // 3 : m // 3 + h, m % 3 : m % 3 + h] += spread[m]
                g = out[:, 1:-1, 1:-1]
            w -= rate * (near @ flat.T).reshape(9, -1, len(flat)).transpose(1, 0, 2).reshape(w.shape)
            b -= rate * flat.sum(1)
        return loss

    def numbers(self) -> np.ndarray:
        """All weights and offsets in one list."""
        return np.concatenate([x.ravel() for layers in (self.conv, self.full) for layer in layers for x in layer])

    def of(self, numbers: np.ndarray) -> Network:
        """A network of this one's layers with the weights of a list of numbers()."""
        out, at = Network.__new__(Network), 0
        for kind in ("conv", "full"):
            layers = []
            for layer in getattr(self, kind):
                layers.append([])
                for x in layer:
                    layers[-1].append(numbers[at : at + x.size].reshape(x.shape).copy())
                    at += x.size
            setattr(out, kind, layers)
        return out


def train(samples: list[tuple[str, str]], classes: list[str], epochs: int = 50, batch: int = 32, rate: float = 0.01, decay: float = 0.98, seed: int = 0, **shape) -> Network:
    """The network of best training accuracy over the epochs; samples are (bits, label)."""
    x = np.array([image(b) for b, _ in samples])
    y = np.array([classes.index(c) for _, c in samples])
    net, rng, best, kept = Network(len(classes), seed=seed, **shape), np.random.default_rng(seed), -1.0, None
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), batch):
            net.step(x[order[k : k + batch]], y[order[k : k + batch]], rate * decay**epoch)
        right = float((net.forward(x).argmax(1) == y).mean())
        if right > best:
            best, kept = right, [[[w.copy(), b.copy()] for w, b in layers] for layers in (net.conv, net.full)]
    net.conv, net.full = kept
    return net


#: Images that go through the network at once: what a layer holds of them stays in a core's cache.
IMAGES = 256

#: Tiles of a part, which one task fits in one go.
PART = 1 << 13


def _images(tiles: np.ndarray) -> np.ndarray:
    """image() of tiles of 32 bytes, a row each."""
    x = np.unpackbits(tiles, axis=1).astype(np.float64).reshape(-1, 16, 16)
    return (x - x.mean((1, 2), keepdims=True)) / np.maximum(x.std((1, 2), keepdims=True), 1e-6)


def _packed(bits) -> np.ndarray:
    """0/1 strings as rows of 32 bytes."""
    return np.packbits(np.frombuffer("".join(bits).encode(), np.uint8).reshape(-1, 256) - 48, axis=1)


def parts_of(samples: DataFrame, classes: list[str]) -> DataFrame:
    """(part, tiles, labels): different (bits, label) dealt by hash into parts of some PART, a row each, in the shared folder."""
    samples = samples.select("bits", "label").distinct()
    parts = 1 + samples.agg(F.approx_count_distinct("bits")).first()[0] // PART

    def run(batches):
        import pyarrow as pa

        part, tiles, labels = None, [], []
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                tiles.append(_packed(batch.column("bits").to_pylist()).tobytes())
                labels.append(bytes(map(classes.index, batch.column("label").to_pylist())))
        if tiles:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "tiles": [b"".join(tiles)], "labels": [b"".join(labels)]})

    at = F.pmod(F.xxhash64("bits"), F.lit(parts)).cast("int")
    dealt = samples.withColumn("part", at).repartitionById(parts, "part").sortWithinPartitions("bits", "label")
    return saved(dealt.mapInArrow(run, "part int, tiles binary, labels binary"), "parts")


def fit(samples: DataFrame, classes: list[str], epochs: int = 50, batch: int = 32, rate: float = 0.01, decay: float = 0.98, seed: int = 0, **shape) -> Network:
    """train() on all different rows of a table (bits, label), by tasks: in an epoch each part takes the network through its
    tiles, and the new one is the mean of what the parts come to, by their tiles. As there, the network of best training
    accuracy. Only sums of weights come to the driver; parts, and so the network, do not depend on the tasks."""
    parts = parts_of(samples, classes)
    net, best, kept = Network(len(classes), seed=seed, **shape), -1.0, None
    for epoch in range(epochs + 1):

        def run(batches, net=net, epoch=epoch):
            import pyarrow as pa

            now = net.of(net.numbers().astype(np.float32))
            for rows in batches:
                for r in rows.to_pylist():
                    tiles, y = np.frombuffer(r["tiles"], np.uint8).reshape(-1, 32), np.frombuffer(r["labels"], np.uint8)
                    right = sum(int((now.labels(_images(tiles[k : k + IMAGES]).astype(np.float32)) == y[k : k + IMAGES]).sum()) for k in range(0, len(y), IMAGES))
                    own = now.of(now.numbers())
                    order = np.random.default_rng([seed, epoch, r["part"]]).permutation(len(y)) if epoch < epochs else []
                    for k in range(0, len(order), batch):
                        some = order[k : k + batch]
                        own.step(_images(tiles[some]).astype(np.float32), y[some], rate * decay**epoch)
                    sums = np.r_[len(y), right, own.numbers().astype(np.float64) * len(y)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), r["part"], np.int32)), pa.array(np.arange(len(sums))), pa.array(sums)], names=["part", "at", "x"])

        each = F.array_sort(F.collect_list(F.struct("part", "x")))  # added in the order of the parts
        sums = parts.mapInArrow(run, "part int, at bigint, x double").groupBy("at").agg(F.aggregate(each, F.lit(0.0), lambda s, e: s + e["x"]).alias("x")).orderBy("at").collect()
        if not sums:
            return net
        n, right, *numbers = (r["x"] for r in sums)
        if epoch and right / n > best:
            best, kept = right / n, net
        net = net.of(np.array(numbers) / n)
    return kept or net


def predict(tiles: DataFrame, net: Network, classes: list[str], bits: str = "bits") -> DataFrame:
    """tiles with the predicted label; the network goes to the tasks once. Of equal tiles in a batch one goes through it."""
    shared = tiles.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("string")
    def label(column):
        import pandas as pd

        if not len(column):
            return pd.Series([], dtype=object)
        few, which = np.unique(_packed(column).view("V32").ravel(), return_inverse=True)
        x = _images(few.view(np.uint8).reshape(-1, 32))
        out = np.concatenate([shared.value.labels(x[k : k + IMAGES]) for k in range(0, len(x), IMAGES)])
        return pd.Series(np.array(classes, dtype=object)[out[which]], dtype=object)

    return tiles.withColumn("predicted", label(F.col(bits)))


WEIGHTS = "kind string, layer int, part string, shape array<int>, values array<double>"


def save(spark: SparkSession, net: Network, path: str) -> None:
    """The weights as a table, a row for each layer's matrix and for its offsets."""
    rows = [(kind, k, part, list(x.shape), x.ravel().tolist()) for kind in ("conv", "full") for k, layer in enumerate(getattr(net, kind)) for part, x in zip("wb", layer)]
    spark.createDataFrame(rows, WEIGHTS).coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> Network:
    found = {(r["kind"], r["layer"], r["part"]): np.array(r["values"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
    net = Network.__new__(Network)
    for kind in ("conv", "full"):
        n = 1 + max(k for name, k, _ in found if name == kind)
        setattr(net, kind, [[found[kind, k, "w"], found[kind, k, "b"]] for k in range(n)])
    return net
