"""Exact Jaccard self-join on word shingles by token-combination prefixes.

Two sets of sizes a and b link when ``100 * |A & B| >= percent * |A | B|``. Tokens have three
classes by how many sets hold them, and all sets are sorted by one global order: class 1 (rare)
first, then class 2, then class 3 (most frequent), by hash inside a class. Let t = percent / 100,
p = n - ceil(t n) + 1, and D = floor((1 - t) n / t): no partner of a set of size n differs from it in
more than D tokens.

* Singles. Linked sets share their first common token inside both p-prefixes. If it is rare, the
  single rare tokens of the p-prefix find the pair.
* Combinations. If not, no common token is rare. The D' <= D differing tokens cut the common ones into
  at most D' + 1 runs that are consecutive in both sets. Without a common pair of neighbours of
  class 2, a run has at most one token of class 2; without a common triple of neighbours of class 3, at
  most two of class 3, and one run spans both classes. So the first ``reach(k, D)`` places of the
  merged order hold a common combination: neighbouring pairs of class 2 if they end before class 3,
  else these and neighbouring triples of class 3.
* Small sets. The places may end with the set; then combinations of k are sure only from
  ``least_size(k)`` tokens of the larger set on. Below, class k is indexed like class k - 1, down to
  singles of the whole prefix. A set whose partners may lie on either side of that size is
  indexed both ways.
* Filter. Sizes and parity bitmaps: the Hamming distance of two bitmaps never exceeds the symmetric
  difference, so what it drops cannot link. Short lists give their pairs (their number is bounded
  by the list's length limit); a long list gives a spanning forest of the pairs that pass, found block by
  block, never the pairs. What the forest joins is a candidate group: every link lies inside one.
* Verify. Inside a group, full sets are compared in blocks of bounded size; a task gives a count of links
  for each set and a spanning forest of the links, never the links. With ``count_links`` all block pairs are
  compared, as counting needs; without, only sets that are still apart after the first round.

Equal sets are one node throughout.

Edge cases: null, empty or blank texts have the empty set, link with nothing and are their own
component; texts with fewer words than a shingle have one shingle; rows that repeat an id are
separate texts, each in the component of its own set; null ids link with nothing and get a null
component; whole texts of any length are used; an empty table gives no rows. Token and set hashes
have 64 bits; texts that collide in them would count as equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name, small
from .components import components
from .shingles import mix, shingle_set, signed

WORDS, PERCENT = 5, 80
#: A token is in class 2 or 3 from so many sets on; only speed depends on it.
FREQUENT, MOST_FREQUENT = 32, 1024
#: Tokens held by a task between counts, and the least count that it then reports. A token that goes
#: unreported, or above the cut below, has at most 2 (or 1 / SENT) in COUNT_TOKENS of all tokens.
COUNT_TOKENS, COUNT_LEAST = 1_000_000, 3
#: Frequent tokens that are sent to the tasks; class 2 starts higher until they fit.
SENT = 500_000
#: Lists up to SHORT members give their pairs.
SHORT = 6
#: Rows and tokens of a block: of bitmaps in a long list, of full sets in a candidate group.
LIST_BLOCK, GROUP_BLOCK = (4096, 64_000_000), (1024, 1_000_000)
#: Tokens held by fewer sets of a block are counted pair by pair, the others by a matrix product.
DENSE, CELLS = 16, 4_000_000
#: Largest tables that are broadcast, by counted rows: ids, and rows of some eight numbers.
IDS_BROADCAST, ROWS_BROADCAST = 1_000_000, 200_000
BITMAP = 256


def most_apart(n: int, percent: int) -> int:
    return (100 - percent) * n // percent


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def spanned(k: int) -> int:
    """Common tokens that runs over several classes hold beyond k - 1 each."""
    return (k - 1) * (k - 2) // 2


def reach(k: int, apart: int) -> int:
    """Places that hold a common combination of some class up to k."""
    return k * apart + k + spanned(k)


def sure(k: int, n: int, percent: int) -> bool:
    """Whether combinations up to k find every partner of at most n tokens of a set of n tokens."""
    return k == 1 or n * (100 - k * (100 - percent)) >= 100 * (k + spanned(k))


def neighbours(tokens: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive tokens."""
    out = tokens[: max(0, len(tokens) - k + 1)]
    for i in range(1, k):
        out = mix(out * np.uint64(3) + tokens[i : len(tokens) - k + 1 + i])
    return out


def signatures(tokens: np.ndarray, frequent: np.ndarray, most: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, is a combination) of one token set; frequent (classes 2 and 3) and most (class 3) are sorted."""
    n = len(tokens)
    apart = most_apart(n, percent)
    if not apart:  # only equal sets link, and those are one node
        return np.empty(0, np.uint64), np.empty(0, bool)
    often, very = held(tokens, frequent), held(tokens, most)
    classes = [tokens[~often], tokens[often & ~very], tokens[very]]
    p = prefix_length(n, percent)
    singles = classes[0][:p]
    if len(singles) == p:
        return singles, np.zeros(p, bool)
    # partners have at most n / t tokens, which decides how long combinations may be
    low, high = (max(k for k in (1, 2, 3) if sure(k, m, percent)) for m in (n, 100 * n // percent))
    combos: list[np.ndarray] = []
    for top in range(low, high + 1):
        own = [*classes[: top - 1], np.concatenate(classes[top - 1 :])]
        if top == 1:
            singles = own[0][:p]
            continue
        before = len(own[0])
        for k in range(2, top + 1):
            places = reach(k, apart)
            combos.append(neighbours(own[k - 1][: max(0, places - before)], k))
            before += len(own[k - 1])
            if before >= places:
                break
    return np.concatenate([singles, *combos]), np.repeat([False, True], [len(singles), sum(map(len, combos))])


def held(tokens: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(tokens), bool)
    return among[np.minimum(np.searchsorted(among, tokens), len(among) - 1)] == tokens


def parity(tokens: np.ndarray, bits: int) -> bytes:
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def sketch_bits(n: int) -> int:
    """One to two bits a token, a power of two."""
    return max(BITMAP, 1 << (n - 1).bit_length()) if n else BITMAP


def need(na, nb, percent: int):
    """Least intersection of linked sets."""
    return (percent * (na + nb) + 99 + percent) // (100 + percent)


def alike_sizes(na, nb, percent: int):
    return 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)


def _words(column: pa.Array) -> np.ndarray:
    """Binary column of equal-length bitmaps as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)


def shingle_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Row per document, and rows (null, token, count) of tokens that many sets of the task share."""
        import xxhash

        names = ["doc_id", "n", "node", "bitmap", "sketch", "token", "seen"]
        kept: list[np.ndarray] = []
        sets: set[int] = set()
        total = 0

        def report() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(kept), return_counts=True)
            keep = counts >= COUNT_LEAST
            m = int(keep.sum())
            none = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array(signed(tokens[keep])), pa.array(counts[keep])], names)

        for batch in batches:
            n, node, maps, sketches = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k)
                n.append(len(s))
                node.append(h := xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0)
                maps.append(parity(s, BITMAP))
                sketches.append(parity(s, sketch_bits(len(s))))
                if h not in sets and len(s):
                    sets.add(h)
                    kept.append(s)
                    total += len(s)
            m = batch.num_rows
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(signed(np.array(node, np.uint64))), pa.array(maps, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names)
            if total >= COUNT_TOKENS:
                yield report()
                kept, total = [], 0
                sets.clear()
        if kept:
            yield report()

    return run


def signature_rows(k: int, percent: int, frequent: np.ndarray, most: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        done: set[int] = set()  # equal sets of one task are indexed once
        for batch in batches:
            sigs, nodes, combos, counts = [], [], [], []
            for text in batch.column(0):
                s = shingle_set(text.as_py(), k)
                h = xxhash.xxh3_64_intdigest(s.tobytes())
                if h in done or not len(s):
                    continue
                if len(done) > 200_000:
                    done.clear()
                done.add(h)
                sig, combo = signatures(s, frequent, most, percent)
                sigs.append(sig)
                combos.append(combo)
                nodes.append(h)
                counts.append(len(sig))
            if sigs:
                node = np.repeat(np.array(nodes, np.uint64), counts)
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sigs))), pa.array(signed(node)), pa.array(np.concatenate(combos))], ["sig", "node", "combo"])

    return run


def short_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by list, all lists short: the pairs that may link."""
        tail: pa.Table | None = None
        for batch in batches:
            fresh = 0 if tail is None else tail.num_rows
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])]).combine_chunks()
            sig, node, n = (t.column(c).to_numpy() for c in ("sig", "node", "n"))
            maps = _words(t.column("bitmap").combine_chunks())
            out = []
            for d in range(1, min(SHORT - 1, len(sig) - 1) + 1):
                i = np.flatnonzero((sig[d:] == sig[:-d]) & (node[d:] != node[:-d]) & alike_sizes(n[d:], n[:-d], percent))
                i = i[i + d >= fresh]  # the rest was compared with the batch before
                apart = np.bitwise_count(maps[i] ^ maps[i + d]).sum(axis=1, dtype=np.int64)
                i = i[apart <= n[i] + n[i + d] - 2 * need(n[i], n[i + d], percent)]
                out.append((np.minimum(node[i], node[i + d]), np.maximum(node[i], node[i + d])))
            tail = t.slice(max(0, t.num_rows - SHORT))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b"])

    return run


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Rows of parity bitmaps folded to fewer words; parity is kept."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def alike_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (a, b, na, nb, x, y): the pairs whose sketches may link."""
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            most = na + nb - 2 * need(na, nb, percent)
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64)[None, :] for v in (x, y))
                words = min(x.shape[1], y.shape[1])
                if np.bitwise_count(fold(x, words) ^ fold(y, words)).sum(dtype=np.int64) <= most[i]:
                    keep.append(i)
            if keep:
                yield batch.select(["a", "b"]).take(pa.array(keep))

    return run


Linked = Callable[[int, np.ndarray], np.ndarray]


def sketch_linked(n: np.ndarray, blobs: list[bytes], percent: int) -> Linked:
    """Function of a row and other rows: which of them may link to it by size and sketch."""
    width = np.array([len(b) // 8 for b in blobs])
    rows, place = {}, np.zeros(len(n), np.int64)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        rows[w] = np.frombuffer(b"".join(blobs[i] for i in own.tolist()), np.uint64).reshape(len(own), w)
        place[own] = np.arange(len(own))

    def linked(i: int, others: np.ndarray) -> np.ndarray:
        ok = alike_sizes(n[i], n[others], percent)
        at = np.flatnonzero(ok)
        mine = rows[width[i]][place[i]][None, :]
        kinds = width[others[at]]
        for w in np.unique(kinds).tolist():
            some = at[kinds == w]
            words = min(w, mine.shape[1])
            theirs = fold(rows[w][place[others[some]]], words)
            apart = np.bitwise_count(theirs ^ fold(mine, words)).sum(axis=1, dtype=np.int64)
            m = n[others[some]]
            ok[some] = apart <= n[i] + m - 2 * need(n[i], m, percent)
        return ok

    return linked


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes, right above the diagonal."""
    m = len(sets)
    out = np.zeros((m, m), np.int32)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(m), [len(s) for s in sets])[order]
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    size = np.diff(start, append=len(flat))
    each = np.repeat(size, size)
    few = (each > 1) & (each < DENSE)
    a, f = owner[few], flat[few]  # a token's owners ascend
    for d in range(1, min(DENSE - 1, len(a))):
        i = np.flatnonzero(f[d:] == f[:-d])
        if not len(i):
            break
        np.add.at(out, (a[i], a[i + d]), 1)
    many = size >= DENSE
    if many.any():
        number = np.repeat(np.cumsum(many) - 1, size)
        at = np.flatnonzero(each >= DENSE)
        step = max(1, CELLS // m)
        for lo in range(0, int(many.sum()), step):
            own = at[(number[at] >= lo) & (number[at] < lo + step)]
            dense = np.zeros((m, step), np.float32)
            dense[owner[own], number[own] - lo] = 1
            out += (dense @ dense.T).astype(np.int32)  # step columns: exact in single precision
    return out


def set_links(n: np.ndarray, blobs: list[bytes], percent: int) -> np.ndarray:
    """Matrix of which full sets link."""
    common = common_counts([np.frombuffer(b, np.uint64) for b in blobs])
    common = np.triu(common, 1).astype(np.int64)
    links = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    links &= common > 0
    return links | links.T


def spanning(side: np.ndarray, label: np.ndarray, linked: Linked) -> tuple[np.ndarray, np.ndarray]:
    """Stars (row, first row of its component) over rows that linked() joins; rows of one label are joined
    already. Only rows of different sides are compared, or any if a side is 0."""
    left = np.arange(len(side))
    rows, centres = [], []

    def take(labels: np.ndarray) -> list[int]:
        nonlocal left
        own = np.isin(label[left], labels)
        got, left = left[own], left[~own]
        return got.tolist()

    while len(left):
        seed = int(left[0])
        queue = take(label[seed : seed + 1])
        while queue and len(left):
            i = queue.pop()
            others = left if not side[i] else left[side[left] != side[i]]
            hits = others[linked(i, others)] if len(others) else others
            if len(hits):
                found, first = np.unique(label[hits], return_index=True)
                rows += hits[first].tolist()
                centres += [seed] * len(first)
                queue += take(found)
    return np.array(rows, np.int64), np.array(centres, np.int64)


def block_rows(percent: int, exact: bool, counts: bool):
    names = ["node", "links", "centre"]

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        t = t.combine_chunks()
        side, node, n, weight, label = (t.column(c).to_numpy() for c in ("side", "node", "n", "weight", "label"))
        blobs = t.column("data").to_pylist()
        if exact:  # a node stands once on a side: rows that repeat an id may bring it twice
            one = sorted({k: i for i, k in enumerate(zip(side.tolist(), node.tolist(), strict=True))}.values())
            side, node, n, weight, label = (x[one] for x in (side, node, n, weight, label))
            blobs = [blobs[i] for i in one]
        links = np.zeros(len(node), np.int64)
        if exact:
            found = set_links(n, blobs, percent)
            found &= (side[:, None] != side) | (side == 0)
            found &= node[:, None] != node
            if counts:
                links = found @ weight
            linked: Linked = lambda i, others: found[i, others]
        else:
            linked = sketch_linked(n, blobs, percent)
        rows, centres = spanning(side, label, linked)
        centre = node.copy()
        centre[rows] = node[centres]
        out = np.flatnonzero((links > 0) | (centre != node))
        return pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (node, links, centre)], names) if len(out) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (list, block pair): counts of links and spanning stars."""
        kept: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("list", "bi", "bj")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts, cuts[1:], strict=False):
                now = tuple(key[:, at].tolist())
                if kept and now != last:
                    if len(kept) > 1 or kept[0].num_rows > 1:
                        if (got := solve(pa.Table.from_batches(kept))) is not None:
                            yield got
                    kept = []
                kept.append(batch.slice(at, end - at))
                last = now
        if kept and (got := solve(pa.Table.from_batches(kept))) is not None:
            yield got

    return run


def in_blocks(rows: DataFrame, data: DataFrame, scratch: Scratch, *, percent: int, exact: bool, counts: bool, limit: tuple[int, int]) -> DataFrame:
    """rows (list, node, n, weight), data (node, data) -> (node, links, centre): links counted and joined inside every list.

    A list is cut into blocks of at most about ``limit`` rows and tokens. For counts, all pairs of blocks
    are compared. Otherwise each block is compared with itself, and then only rows outside their
    list's largest component with the rows of other components. Rows are dealt before they get their data."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda m, tokens: F.greatest(F.ceil(F.col(m) / limit[0]), F.ceil(F.col(tokens) / limit[1])).cast("int")
    sized = rows.groupBy("list").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("tokens")).where("m > 1")
    sized = scratch.table(sized.select(F.col("list").alias("_list"), blocks("m", "tokens").alias("blocks")), "sized")
    several = sized.where("blocks > 1").head(1)
    placed = rows.join(sized, F.col("list") == F.col("_list")).drop("_list").withColumn("own", _block(F.col("node"), F.col("blocks")))
    done = block_rows(percent, exact, counts)
    narrow = ["list", "bi", "bj", "side", "node", "n", "weight", "label"]

    def solved(dealt: DataFrame, name: str) -> DataFrame:
        dealt = scratch.table(dealt.select(narrow), "dealt")
        with_data = data.join(small(dealt, dealt.count(), ROWS_BROADCAST), "node").select(*narrow, "data")
        sorted_ = with_data.repartition(parts, "list", "bi", "bj").sortWithinPartitions("list", "bi", "bj")
        return scratch.table(sorted_.mapInArrow(done, "node long, links long, centre long"), name)

    own, other = F.col("own"), F.col("other")
    if counts:
        dealt = placed.withColumn("label", F.col("node")).withColumn("other", _every("blocks"))
        side = F.when(own == other, 0).when(own < other, 1).otherwise(2)
        return solved(dealt.withColumns({"bi": F.least(own, other), "bj": F.greatest(own, other), "side": side}), "counted")
    first = solved(placed.withColumns({"bi": own, "bj": own, "side": F.lit(0), "label": F.col("node")}), "first")
    if not several:
        return first
    names = components(first.select(F.col("node").alias("a"), F.col("centre").alias("b")), scratch)
    wide = placed.where("blocks > 1").join(names.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").withColumn("label", F.coalesce("component", "node")).drop("_node", "component")
    wide = scratch.table(wide, "wide")
    shares = wide.groupBy("list", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("tokens"))
    largest = F.struct("m", "label")
    total = shares.groupBy("list").agg(F.max_by("label", largest).alias("main"), (F.sum("m") - F.max("m")).alias("rest"), (F.sum("tokens") - F.max_by("tokens", largest)).alias("rest_tokens")).where("rest > 0")
    total = scratch.table(total.select(F.col("list").alias("_list"), "main", blocks("rest", "rest_tokens").alias("rest_blocks")), "apart")
    apart = wide.join(total, F.col("list") == F.col("_list"))
    rest = apart.where("label <> main").withColumn("bi", _block(F.col("node"), F.col("rest_blocks"))).withColumn("bj", _every("blocks")).withColumn("side", F.lit(1))
    every = apart.withColumn("bj", own).withColumn("bi", _every("rest_blocks")).withColumn("side", F.lit(2))
    return first.unionByName(solved(rest.select(narrow).unionByName(every.select(narrow)), "second"))


def _block(node: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(node), blocks).cast("int")


def _every(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def whole_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingle_set(t.as_py(), k) for t in batch.column(0).slice(at, 256)]
                nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(signed(nodes)), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "data"])

    return run


def jaccard_components(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, count_links: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of docs; ids must fit a long.

    n_links counts the other rows with an id whose set links; without count_links it is left out."""
    scratch = Scratch(docs.sparkSession, "ngram")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    long_id = F.col("doc_id").isNotNull()

    made = scratch.table(texts.mapInArrow(shingle_rows(words), "doc_id long, n long, node long, bitmap binary, sketch binary, token long, seen long"), "sets")
    sets = made.where("token IS NULL")
    totals = made.where("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= FREQUENT)
    totals = scratch.table(totals, "frequent")
    if (n := totals.count()) > SENT:
        totals = totals.where(F.col("seen") > totals.select(F.percentile_approx("seen", 1 - SENT / n, 10_000)).first()[0])
    sent = totals.select("token", (F.col("seen") >= MOST_FREQUENT).alias("most")).collect()
    array = lambda rows: np.sort(np.array([r["token"] for r in rows], np.int64).view(np.uint64))
    frequent, most = array(sent), array([r for r in sent if r["most"]])

    # one row per distinct set; the smallest id stands for it
    nodes = sets.where(long_id & (F.col("n") > 0)).groupBy("node", "n").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("weight"), F.first("bitmap").alias("bitmap"), F.first("sketch").alias("sketch"))
    nodes = scratch.table(nodes, "nodes")

    index = texts.where(long_id).select("text").mapInArrow(signature_rows(words, percent, frequent, most), "sig long, node long, combo boolean")
    # lists of combinations are dealt over several tasks; singles are dropped where all of a list is together
    salt = F.when(F.col("combo"), F.pmod(F.col("node"), F.lit(64))).otherwise(0)
    size = F.count(F.lit(1)).over(Window.partitionBy("sig", "salt"))
    lists = index.withColumn("salt", salt).withColumn("size", size).where("combo OR size > 1")
    lists = scratch.table(lists.groupBy("sig", "salt", "node").agg(F.lit(1)).select("sig", "node"), "lists")
    sizes = lists.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1").withColumnRenamed("sig", "_sig")
    shared = scratch.table(lists.join(sizes, F.col("sig") == F.col("_sig")).select("sig", "df", "node"), "shared")
    scratch.drop(lists)

    short = shared.where(F.col("df") <= SHORT).join(nodes.select("node", "n", "bitmap"), "node").select("sig", "node", "n", "bitmap")
    pairs = short.repartition("sig").sortWithinPartitions("sig").mapInArrow(short_pairs(percent), "a long, b long").distinct()
    side = lambda x, n, data: nodes.select(F.col("node").alias(x), F.col("n").alias(n), F.col("sketch").alias(data))
    pairs = scratch.table(pairs, "pairs")
    near = pairs.join(side("a", "na", "x"), "a").join(side("b", "nb", "y"), "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(alike_pairs(percent), "a long, b long")
    near = scratch.table(near, "near")
    scratch.drop(pairs)
    long_lists = shared.where(F.col("df") > SHORT).join(nodes.select("node", "n"), "node")
    long_lists = scratch.table(long_lists.select(F.col("sig").alias("list"), "node", "n", F.lit(1).cast("long").alias("weight")), "long")
    scratch.drop(shared)
    stars = in_blocks(long_lists, nodes.select("node", F.col("sketch").alias("data")), scratch, percent=percent, exact=False, counts=False, limit=LIST_BLOCK)

    # every link lies inside a group of what may link
    groups = components(near.unionByName(stars.select(F.col("node").alias("a"), F.col("centre").alias("b"))), scratch)
    scratch.drop(long_lists, near)
    members = scratch.table(nodes.select("node", "n", "doc", "weight").join(groups.withColumnRenamed("component", "list"), "node"), "members")
    ids = small(members.select(F.col("doc").alias("id")), members.count(), IDS_BROADCAST)
    full = texts.join(ids, F.col("doc_id") == F.col("id"), "left_semi").select("text").mapInArrow(whole_sets(words), "node long, data binary")
    full = scratch.table(full, "full")
    found = in_blocks(members.select("list", "node", "n", "weight"), full, scratch, percent=percent, exact=True, counts=count_links, limit=GROUP_BLOCK)
    scratch.drop(full)
    names = components(found.select(F.col("node").alias("a"), F.col("centre").alias("b")), scratch)

    named = nodes.select("node", "doc", "weight").join(names.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"))
    first = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = named.select("node", "component").join(first, "component").select(F.col("node").alias("_node"), "component_id")
    of_node = nodes.select("node", "doc", "weight").join(named, F.col("node") == F.col("_node"), "left")
    links = found.groupBy(F.col("node").alias("_n")).agg(F.sum("links").alias("links"))
    of_node = of_node.join(links, F.col("node") == F.col("_n"), "left")
    of_node = of_node.select(F.col("node").alias("_set"), F.coalesce("component_id", "doc").alias("component_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = sets.select("doc_id", "n", F.when((F.col("n") > 0) & long_id, F.col("node")).alias("node")).join(of_node, F.col("node") == F.col("_set"), "left")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")]
    return out.select(*columns, *[F.coalesce("links", F.lit(0)).alias("n_links")] * count_links)


def drop_near_copies(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one with the smallest id (ids before null ids).

    Rows equal in id and text are copies: one of them stays. Rows without words all stay, but for such
    copies. Texts of any length are compared whole; an empty table gives no rows."""
    scratch = Scratch(docs.sparkSession, "classes")
    key, gone = free_name(docs, "_key"), free_name(docs, "_gone")
    keyed = docs.withColumn(key, F.xxhash64(F.lit(1), F.col(id_col), F.col(id_col).isNull(), F.col(text_col), F.col(text_col).isNull()))
    narrow = keyed.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    classes = scratch.table(jaccard_components(narrow, words=words, percent=percent, count_links=False, id_col="key"), "classes")
    groups = classes.groupBy("component_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("component_id").alias("c"))
    members = classes.join(groups, F.col("component_id") == F.col("c"), "left_semi").select(F.col("doc_id").alias("m"), F.col("component_id").alias("c")).distinct()
    members = scratch.table(members, "members")
    n = members.count()
    rows = scratch.table(narrow.select("key", "id").join(small(members, n, IDS_BROADCAST), F.col("key") == F.col("m")), "rows")
    kept = rows.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "m")).alias("first")).select(F.col("first.m").alias("kept"))
    others = members.join(kept, F.col("m") == F.col("kept"), "left_anti").select(F.col("m").alias(gone))
    out = keyed.join(small(others, n, IDS_BROADCAST), F.col(key) == F.col(gone), "left_anti")
    if rows.count() > n:  # some rows are equal in id and text
        out = out.dropDuplicates([key])
    return out.drop(key)


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, words=4, percent=85)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(list_transform(s, lambda x: hash(x))) AS t FROM s),
f AS (SELECT t FROM u GROUP BY t HAVING count(*) > 1),
x AS (SELECT doc_id, t FROM u SEMI JOIN f USING (t)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
h AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r AS (SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c.component, n.doc_id) AS component_id, coalesce(k.n_links, 0) AS n_links
FROM n LEFT JOIN c ON c.node = n.doc_id LEFT JOIN k ON k.a = n.doc_id
"""
