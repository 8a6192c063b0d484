"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of its own text (hashed words and endings, length, share of symbols,
capitals, digits, repetition); those of the previous and next line enter with weights of their own.
The field labels each line good or bad; forward-backward gives each line's probability of good
given the whole document, and the length-weighted mean of these is the document's quality, mapped
to a probability by a logistic fit.

Training: lines inherit their document's label, from at most ``SAMPLE`` documents per label, taken
in hash order among the training rows (those over ``SAMPLE_CHARS`` characters are passed over); weights are fitted by Adam on the exact log-likelihood with
numpy. Everything else covers all rows. Labels, language, source and id never enter a score.

Edge cases: null and empty texts have one empty line and get its score; lines of any length and any
number of lines are scored whole, in chunks; rows without a label are scored alike; repeated rows get
equal scores; with no training rows of either label, the field is all zero and every score is the
rate of label 1 (0.5 without any label); an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, small_batches

SAMPLE = 1500
#: Characters, plus 100 a line, of the sample of one label; bounds the driver's memory. In hash order, a document that
#: would pass it is left out of the fit, whole. It is scored like all others.
SAMPLE_SIZE = 16_000_000
#: Lines whose features are held at once.
LINES = 4096
#: Lines, with padding, of a training batch of several documents; training lines up to which features are kept.
PADDED, KEPT = 16_384, 65_536
HASHED = 512
SCALARS = 13
FEATURES = HASHED + SCALARS
CUT = 0.3
FOLDS, HELD_OUT = 5, 0

_words: dict[bytes, tuple[int, int]] = {}


def word_slots(w: bytes) -> tuple[int, int]:
    """Hashed feature of a word and of its last three bytes."""
    got = _words.get(w)
    if got is None:
        if len(_words) > 60_000:
            _words.clear()
        got = _words[w] = (zlib.crc32(w) % (HASHED // 2), HASHED // 2 + zlib.crc32(w[-3:], 7) % (HASHED // 2))
    return got


#: Character classes by byte: 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 symbol, 6 above ASCII.
CLASS = np.zeros(256, np.uint8)
CLASS[[*range(97, 123)]] = 1
CLASS[[*range(65, 91)]] = 2
CLASS[[*range(48, 58)]] = 3
CLASS[[9, 10, 11, 12, 13, 32]] = 4
CLASS[[*b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"]] = 5
CLASS[128:] = 6
#: Longest piece of a line; longer lines count as several lines, none is cut off.
PIECE = 4000


def lines_of(text: str) -> list[bytes]:
    out = []
    for line in text.encode("utf-8").split(b"\n"):
        out += [line[i : i + PIECE] for i in range(0, len(line), PIECE)] or [b""]
    return out


def line_features(lines: list[bytes], seen: dict[bytes, int] | None = None) -> np.ndarray:
    """A row per line: hashed word shares, then scalars. seen: how often the document's earlier lines came."""
    x = np.zeros((len(lines), FEATURES), np.float32)
    seen = {} if seen is None else seen
    for i, line in enumerate(lines):
        words = line.lower().split()
        n, row = len(words), x[i]
        if n:
            slots = np.array([word_slots(w) for w in words])
            row[:HASHED] = np.bincount(slots.ravel(), minlength=HASHED) / np.sqrt(n)
        share = np.bincount(CLASS[np.frombuffer(line, np.uint8)], minlength=7) / max(1, len(line))
        before = seen.get(line, 0)
        seen[line] = before + 1
        row[HASHED:] = [1.0, np.log1p(len(line)) / 8, *share[1:], n and len(set(words)) / n, (len(line) / max(1, n)) / 20, min(before, 4) / 4, n < 4, n and sum(map(bytes.__eq__, words, words[1:])) / n * 4]
    return x


def feature_chunks(lines: list[bytes]) -> Iterator[np.ndarray]:
    seen: dict[bytes, int] = {}
    for at in range(0, len(lines), LINES):
        yield line_features(lines[at : at + LINES], seen)


@dataclass
class Field:
    """Weights of own, previous and next line for good minus bad, transitions, and calibration."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    change: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def weights(self) -> np.ndarray:
        return np.stack([self.own, self.before, self.after], axis=1)

    def marginals(self, lines: list[bytes]) -> np.ndarray:
        """Probability of good for every line."""
        parts = np.concatenate([x @ self.weights() for x in feature_chunks(lines)])
        return chain(emissions(parts, np.array([len(lines)]))[None, :], np.array([len(lines)]), self.change)[0][0]

    def quality(self, lines: list[bytes]) -> float:
        """Length-weighted mean of the lines' probabilities."""
        size = np.array([len(s) + 1 for s in lines], float)
        return float((self.marginals(lines) * size).sum() / size.sum())

    def score(self, quality: np.ndarray) -> np.ndarray:
        z = self.slope * (quality - 0.5) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def emissions(parts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-odds of good of lines of documents of n lines one after the other, from each line's products with the weights
    of own, previous and next line."""
    e = parts[:, 0].copy()
    first = np.zeros(len(e), bool)
    first[n.cumsum() - n] = True
    follows = ~first[1:]  # the line before is of the same document
    e[1:][follows] += parts[:-1, 1][follows]
    e[:-1][follows] += parts[1:, 2][follows]
    return e


def chain(e: np.ndarray, n: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward for a batch of chains of lengths n; e: log-odds of good per line.

    Returns (probability of good, summed pair probabilities, log of the partition sum)."""
    rows, steps = e.shape
    pot = np.stack([np.zeros_like(e), e], axis=2)
    alpha, beta = np.zeros((rows, steps, 2)), np.zeros((rows, steps, 2))
    alpha[:, 0] = pot[:, 0]
    for t in range(1, steps):
        alpha[:, t] = pot[:, t] + np.logaddexp(alpha[:, t - 1, 0, None] + change[0], alpha[:, t - 1, 1, None] + change[1])
    inside = np.arange(steps)[None, :] < n[:, None]
    for t in range(steps - 2, -1, -1):
        nxt = beta[:, t + 1] + pot[:, t + 1]
        b = np.logaddexp(nxt[:, 0, None] + change[:, 0], nxt[:, 1, None] + change[:, 1])
        beta[:, t] = np.where(inside[:, t + 1, None], b, 0)
    last = alpha[np.arange(rows), n - 1]
    z = np.logaddexp(last[:, 0], last[:, 1])
    p = np.exp(np.where(inside, alpha[:, :, 1] + beta[:, :, 1] - z[:, None], -np.inf))
    pairs = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            joint = alpha[:, :-1, a] + change[a, b] + pot[:, 1:, b] + beta[:, 1:, b] - z[:, None]
            pairs[a, b] = np.exp(np.where(inside[:, 1:], joint, -np.inf)).sum()
    return p, pairs, z


def fit(texts: list[str], labels: list[int], rounds: int = 16, batch: int = 64, rate: float = 0.02, decay: float = 1e-4, seed: int = 3) -> Field:
    """Exact conditional likelihood by Adam; both labels weigh the same."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, float)
    zero = lambda *s: np.zeros(s)
    field = Field(zero(FEATURES), zero(FEATURES), zero(FEATURES), zero(2, 2))
    if len(y) == 0 or y.min() == y.max():
        rate1 = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        field.shift = float(np.log(rate1 / (1 - rate1)))
        field.slope = 0.0
        return field
    lines = [lines_of(t) for t in texts]
    length = np.array([len(x) for x in lines])
    # few lines are kept as features; beyond, features are made again for each batch
    kept = [line_features(x) for x in lines] if length.sum() <= KEPT else None
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    params = [field.own, field.before, field.after, field.change]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0

    def chunks(pick: np.ndarray) -> Iterator[np.ndarray]:
        if kept is not None:
            yield np.concatenate([kept[i] for i in pick])
        else:
            for i in pick.tolist():
                yield from feature_chunks(lines[i])

    for _ in range(rounds):
        order = rng.permutation(len(lines))
        order = order[np.argsort(length[order] // 8, kind="stable")]
        # a batch ends at so many documents or padded lines
        starts = [0]
        for k in range(1, len(order)):
            if k - starts[-1] >= batch or (k - starts[-1] + 1) * length[order[k]] > PADDED:
                starts.append(k)
        cuts = list(zip(starts, [*starts[1:], len(order)], strict=True))
        for c in rng.permutation(len(cuts)).tolist():
            pick = order[cuts[c][0] : cuts[c][1]]
            n = length[pick]
            flat = emissions(np.concatenate([x @ field.weights() for x in chunks(pick)]), n)
            inside = np.arange(n.max())[None, :] < n[:, None]
            e = np.zeros(inside.shape)
            e[inside] = flat
            p, _, _ = chain(e, n, field.change)
            grad_e = ((p - y[pick][:, None] * inside) * (weight[pick] / n)[:, None])[inside] / len(pick)
            grad_c = np.zeros((2, 2))
            for label in (0, 1):  # all lines of a document carry its label
                own = y[pick] == label
                if own.any():
                    _, pairs, _ = chain(e[own], n[own], field.change)
                    seen = np.zeros((2, 2))
                    seen[label, label] = (n[own] - 1).sum()
                    grad_c += (pairs - seen) / n[own].mean() * float(weight[pick][own][0])
            # a line's features meet the gradient of the next line (as its previous one) and of the previous one
            ends = n.cumsum()
            ahead, behind = np.append(grad_e[1:], 0.0), np.append(0.0, grad_e[:-1])
            ahead[ends - 1] = behind[ends - n] = 0
            toward, at, sums = np.stack([grad_e, ahead, behind], axis=1), 0, np.zeros((FEATURES, 3))
            for x in chunks(pick):
                sums += x.T @ toward[at : at + len(x)]
                at += len(x)
            grads = [*sums.T, grad_c / len(pick)]
            step += 1
            for k, g in enumerate(grads):
                g = g + decay * params[k]
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            np.clip(field.change, -3, 3, out=field.change)
    q = np.array([field.quality(x) for x in lines])
    field.slope, field.shift = logistic(q - 0.5, y, np.ones_like(y))
    return field


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Two-parameter logistic regression by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * w * x).sum() + ridge * a, ((p - y) * w).sum()])
        s = w * p * (1 - p) + 1e-9
        h = np.array([[(s * x * x).sum() + ridge, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-9:
            break
    return float(a), float(b)


def is_held_out(id_col: str):
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Fit on at most ``sample`` documents per label outside the held-out fold."""
    usable = labels.where(F.col(label_col).isin(0, 1) & ~is_held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).distinct()
    order = (F.xxhash64("id"), F.col("id"))
    picked = usable.where("y = 0").orderBy(*order).limit(sample).unionAll(usable.where("y = 1").orderBy(*order).limit(sample))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), text.alias("text"), F.xxhash64(text).alias("hash")).join(F.broadcast(picked), F.col("doc") == F.col("id"))
    size = (F.length("text") + 100 * (F.regexp_count("text", F.lit("\n")) + 1)).cast("long")
    sized = rows.select("id", "y", "hash", size.alias("size")).distinct().where(F.col("size") <= SAMPLE_SIZE)
    by = Window.partitionBy("y").orderBy(*order, "hash")  # a few thousand rows; more only if ids repeat
    fits = sized.withColumns({"nth": F.row_number().over(by), "upto": F.sum("size").over(by)}).where((F.col("nth") <= sample) & (F.col("upto") <= SAMPLE_SIZE))
    chosen = rows.join(F.broadcast(fits.select("id", "y", "hash")), ["id", "y", "hash"], "left_semi").select("id", "y", "text").distinct()
    got = sorted(tuple(r) for r in chosen.collect())  # at most SAMPLE_SIZE characters a label
    # the calibration needs the rate of label 1 among all training rows
    field = fit([t for _, _, t in got], [y for _, y, _ in got])
    rate = usable.agg(F.avg("y")).first()[0]
    own = np.mean([y for _, y, _ in got]) if got else 0.5
    if rate is not None and 0 < rate < 1 and 0 < own < 1:
        field.shift += float(np.log(rate / (1 - rate)) - np.log(own / (1 - own)))
    return field


def score(docs: DataFrame, field: Field, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1, higher for better texts, in a new column ``out`` (underscores before it if docs has one)."""

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array(field.score(np.array([field.quality(lines_of(t.as_py() or "")) for t in part])), pa.float64())

    small_batches(docs.sparkSession)
    return docs.withColumn(free_name(docs, out), scored(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, *, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs and, last, score and predicted (1: good); underscores go before a name that docs has."""
    scored = score(docs, train(docs, labels, id_col=id_col, text_col=text_col), text_col=text_col)
    return scored.withColumn(free_name(scored, "predicted"), F.when(F.col(scored.columns[-1]) >= cut, 1).otherwise(0))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return classify(docs, labels).select("doc_id", is_held_out("doc_id").alias("held_out"), "score", "predicted")
