"""Main text of web pages by a recurrent block labeller.

A page is scanned into leaf blocks (``html_blocks``). A block's vector holds hashed entries of its
tag path, hashed words and a few shares; a bidirectional LSTM in numpy reads all blocks of the page
in both directions, so each block is judged with the whole page in view. Blocks judged part of the
article are joined in page order by a line feed.

The weights are trained by back-propagation on seeded, generated pages (``html_pages``); no page
of the input enters the training. Training takes a few seconds on the driver; the weights (some
100 KB) go to the tasks.

Edge cases: null and empty html give an empty text; pages without tags are one block; broken
markup is scanned as far as it goes; pages of any length are read whole; repeated rows get equal
results; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .common import free_name, small_batches
from .html_blocks import Block, blocks_of
from .html_pages import PageMaker

PATH, WORDS, SHARES = 384, 32, 8
INPUT = PATH + WORDS + SHARES
HIDDEN = 16
TRAIN_PAGES, ROUNDS = 900, 10
#: Padded cells scored at once; bounds memory whatever the pages' lengths.
CELLS = 200_000
#: Blocks of one page whose vectors are held at once.
LONG = 4096


@lru_cache(maxsize=100_000)
def entry_slots(entry: str) -> tuple[int, ...]:
    """Hashed entries of a path entry: its tag and the names of its classes and ids."""
    tag, *names = entry.split(" ")
    return tuple({zlib.crc32(b"t" + tag.encode()) % PATH, *(zlib.crc32(b"n" + n.encode()) % PATH for n in names)})


def block_vectors(blocks: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
    """A row per block; first: number of blocks of the page before these, total: all of the page."""
    x = np.zeros((len(blocks), INPUT), np.float32)
    total = total or len(blocks)
    for i, b in enumerate(blocks):
        row, words = x[i], b.text.lower().encode("utf-8").split(b" ")
        row[list(b.marks)] = 1.0
        row[zlib.crc32(b"i" + b.tag.encode()) % PATH] = 1.0
        row[PATH : PATH + WORDS] = np.bincount([zlib.crc32(w) % WORDS for w in words], minlength=WORDS) / (4 * np.sqrt(len(words)))
        n = len(b.text)
        row[-SHARES:] = [1.0, np.log1p(n) / 6, np.log1p(len(words)) / 4, b.linked / n, (b.text.count(".") + b.text.count(",")) / len(words), b.text[-1] in ".!?\"'»”", min(b.depth, 20) / 10, (first + i) / total]
    return x


class Labeller:
    """Bidirectional LSTM with one output per block (log-odds of article)."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"out": init(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": init(INPUT, 4 * HIDDEN) * 0.5, f"u{d}": init(HIDDEN, 4 * HIDDEN), f"c{d}": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)}

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None, state: list | None = None) -> np.ndarray:
        """Hidden states of one direction; x: (pages, blocks, INPUT). state: (h, c) to start from, then the last ones."""
        rows, steps, _ = x.shape
        pre = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
        h = c = np.zeros((rows, HIDDEN), np.float32)
        if state:
            h, c = state
        out = np.zeros((rows, steps, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.p[f"u{d}"]
            i, f, o = (1 / (1 + np.exp(-z[:, k * HIDDEN : (k + 1) * HIDDEN])) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            c, h = m * c_new, m * o * tc
            out[:, t] = h
        if state is not None:
            state[:] = h, c
        return out

    def page_logits(self, blocks: list[Block]) -> np.ndarray:
        """Log-odds of a page of any length; features of LONG blocks are held at once."""
        z = np.full(len(blocks), self.p["bias"][0], np.float32)
        starts = range(0, len(blocks), LONG)
        for k, d in enumerate("fb"):
            state: list = []
            for at in starts if d == "f" else reversed(starts):
                x = block_vectors(blocks[at : at + LONG], at, len(blocks))[None]
                z[at : at + LONG] += (self.run(x, np.ones(x.shape[:2], np.float32), d, state=state) @ self.p["out"][k * HIDDEN : (k + 1) * HIDDEN])[0]
        return z

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self.run(x, mask, "f") @ self.p["out"][:HIDDEN] + self.run(x, mask, "b") @ self.p["out"][HIDDEN:] + self.p["bias"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        hidden = {d: self.run(x, mask, d, kept[d]) for d in "fb"}
        z = hidden["f"] @ self.p["out"][:HIDDEN] + hidden["b"] @ self.p["out"][HIDDEN:] + self.p["bias"]
        dz = (1 / (1 + np.exp(-z)) - y) * mask / mask.sum()
        g = {"bias": dz.sum(keepdims=True).reshape(1), "out": np.concatenate([np.einsum("rt,rth->h", dz, hidden[d]) for d in "fb"])}
        for k, d in enumerate("fb"):
            dh_all = dz[:, :, None] * self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
            dpre = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gu = np.zeros_like(self.p[f"u{d}"])
            dh = dc = np.zeros((len(x), HIDDEN), np.float32)
            for t, h0, c0, i, f, o, gg, tc, m in reversed(kept[d]):
                dh = (dh + dh_all[:, t]) * m
                dc = dc * m + dh * o * (1 - tc * tc)
                dpre[:, t] = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                gu += h0.T @ dpre[:, t]
                dh, dc = dpre[:, t] @ self.p[f"u{d}"].T, dc * f
            g |= {f"u{d}": gu, f"c{d}": dpre.sum((0, 1)), f"w{d}": x.reshape(-1, INPUT).T @ dpre.reshape(-1, 4 * HIDDEN)}
        return g


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((len(pages), steps, INPUT), np.float32), np.zeros((len(pages), steps), np.float32)
    for r, p in enumerate(pages):
        x[r, : len(p)], mask[r, : len(p)] = p, 1
    return x, mask


def training_page(maker: PageMaker) -> tuple[np.ndarray, np.ndarray]:
    html, marked = maker.page()
    blocks = blocks_of(html, entry_slots)
    good, labels = False, []
    for b in blocks_of(marked):
        # marks around an article part end up in or beside its blocks; blocks of marks alone have no twin
        inside = good
        for c in b.text:
            if c == "\x02":
                good = inside = True
            elif c == "\x03":
                good = False
        if b.text.strip("\x02\x03 "):
            labels.append(inside)
    if len(labels) != len(blocks):
        return np.zeros((0, INPUT), np.float32), np.zeros(0)
    return block_vectors(blocks), np.array(labels, np.float32)


@lru_cache(maxsize=1)
def trained(seed: int = 11) -> Labeller:
    """The labeller after Adam on generated pages; the same for the same seed."""
    maker, model = PageMaker(seed), Labeller(seed)
    pages = [p for p in (training_page(maker) for _ in range(TRAIN_PAGES)) if len(p[0])]
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    step = 0
    for r in range(ROUNDS):
        order = rng.permutation(len(pages))
        order = order[np.argsort([len(pages[i][0]) // 10 for i in order], kind="stable")]
        for at in rng.permutation(np.arange(0, len(order), 24)):
            pick = order[at : at + 24]
            x, mask = padded([pages[i][0] for i in pick])
            y = np.zeros_like(mask)
            for k, i in enumerate(pick):
                y[k, : len(pages[i][1])] = pages[i][1]
            g = model.gradients(x, mask, y)
            scale = min(1.0, 2.0 / (1e-9 + np.sqrt(sum(float((a * a).sum()) for a in g.values()))))
            step += 1
            rate = 0.012 * (1 - 0.8 * r / ROUNDS)
            for k, a in g.items():
                a = a * scale + 1e-5 * model.p[k]
                m[k] += 0.1 * (a - m[k])
                v[k] += 0.01 * (a * a - v[k])
                model.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def main_texts(model: Labeller, htmls: list[str]) -> list[str]:
    pages = [blocks_of(h, entry_slots) for h in htmls]
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    out = [""] * len(pages)
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= CELLS // 8 and end - at < 256:
            end += 1
        pick = order[at:end]
        if len(pages[pick[0]]) > LONG:
            z = [model.page_logits(pages[i]) for i in pick]
        else:
            z = model.logits(*padded([block_vectors(pages[i]) for i in pick]))
        for k, i in enumerate(pick):
            out[i] = "\n".join(b.text for b, s in zip(pages[i], z[k], strict=False) if s > 0)
        at = end
    return out


def extract(pages: DataFrame, *, html_col: str = "html", out: str = "main_text") -> DataFrame:
    """pages with the article's text in a new last column ``out`` (underscores before it if pages has one)."""
    small_batches(pages.sparkSession)
    model, out = trained(), free_name(pages, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = main_texts(model, [h or "" for h in part.column(html_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out])

    return pages.mapInArrow(run, StructType([*pages.schema.fields]).add(out, StringType()))


def op8_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    made = extract(pages, out="text").drop("html")
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
