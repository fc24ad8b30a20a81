"""Operator 9, near-duplicate classes by an LSH forest.

1. Sets. Each text's distinct word shingles become 64-bit hashes (words by BLAKE2b, shingles by mixing
   their words in order); equal sets have one 128-bit name (node), so exact copies meet in a partial
   aggregation and go on as one.
2. Forest. ``TREES`` orders of the nodes, each by up to ``DEPTH`` MinHash values. The nodes are sorted
   by (order, values) across the cluster with a range partitioning that splits regions of any size. A
   node's candidates are the ``REACH`` nodes on either side with which it agrees in the longest prefix,
   at least in the least depth. So the depth adapts region by region: in a sparse one all nodes that
   share the least depth are compared, in a crowded one those that share more. A candidate counts if
   its two-bit signature agrees well enough (``SLACK`` below the threshold); others are passed over and
   do not hide those behind them.
3. Clusters. What a region connects becomes a star around its least node, so the links of a dense group
   mostly coincide from tree to tree; their components, by contraction, hold all that may be linked.
4. Exact links. The full sets of a cluster's nodes meet in blocks of bounded size. In a block, an
   inverted index gives a node's exact intersections with all others; after a few central nodes, only
   the nodes outside the largest component need theirs, for a link between two components has an
   end outside the largest. Clusters beyond one block do the same between blocks: first central
   nodes, then every node outside the cluster's largest component visit the blocks of their own size
   and the sizes beside it, the only ones where a link can be.

Blocks and rounds decide where comparisons happen, not whether. What the forest may miss is a pair
that no chain of candidates connects: in the sparse case a pair at the threshold shares the least
depth in no order with a chance below ``MISS``; tests measure recall on crowded tables.

Defined cases: null, empty and wordless texts have empty sets, are linked with nothing and are their
own class; texts of fewer words than a shingle have one shingle; very long texts go through in
overlapping parts; repeated rows are linked copies; of ties (equal texts under several ids) the least
id names the class; a null doc_id takes part, but a class is named by its least non-null id (null if it
has none); empty tables give no row; other columns are not read, whatever their names. An id names no
row: a row is known by its id and the digest of its text (:func:`text_key`), so repeated and null ids
are told apart wherever rows are looked up or dropped.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, held, prepare, raw_bytes, small, stored, table
from .graph import components
from .spans import mix, offsets_of, ragged

TREES = 16
DEPTH = 8
#: Neighbours on either side of a node in an order that are its candidates.
REACH = 16
#: The chance of missing a pair at the threshold that decides the least depth.
MISS = 2e-5
#: Signatures may say so much less than the threshold: five standard deviations at 0.8.
SLACK = 0.2
#: Texts and shingles that a block of a cluster holds at most, about.
BLOCK_ROWS = 1500
BLOCK_SHINGLES = 3_000_000
#: Central nodes of a block.
PIVOTS = 16
CHUNK_BYTES = 1 << 20
#: A text beyond so many bytes is hashed in parts.
LONG_BYTES = 4 << 20
#: Rows of an order that are compared together.
RUN_ROWS = 1 << 15
#: Words whose hashes a worker remembers, and the longest of them.
MAX_WORDS = 200_000
MAX_WORD_BYTES = 64

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_RANDOM = np.random.RandomState(9)
_A = (_RANDOM.randint(0, 1 << 31, TREES * DEPTH).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RANDOM.randint(0, 1 << 31, TREES * DEPTH).astype(np.uint32) * np.uint32(2)
_CHAIN = np.uint64(0x9E3779B97F4A7C15)


class Rule(NamedTuple):
    """Shingle length, and the least similarity as a percentage."""

    words: int = 5
    percent: int = 80

    @property
    def least_depth(self) -> int:
        fits = [d for d in range(1, DEPTH + 1) if (1 - (self.percent / 100) ** d) ** TREES <= MISS]
        return max(fits, default=1)


_BORDER = re.compile(rb"[\x20\x09-\x0D]")


class _WordHashes(dict):
    """64-bit hashes of words; long words are hashed anew each time."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= MAX_WORD_BYTES:
            self[word] = value
        return value


def shingle_sets(batch: list[bytes], words: int, limit: int = LONG_BYTES) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text beyond the limit goes through in overlapping parts."""
    if not batch:
        return []
    if len(batch) == 1 and len(batch[0]) > limit and len(parts := _overlapping(batch[0], words, limit)) > 1:
        whole = np.zeros(0, dtype=np.uint64)
        for part in parts:
            whole = np.union1d(whole, shingle_sets([part], words, len(part))[0])
        return [whole]
    known = held("neardup", _WordHashes)
    if len(known) > MAX_WORDS:
        known.clear()
    # bytes.split() knows the same white space as the rule: space and 0x09 to 0x0D.
    split = [t.translate(_LOWER).split() for t in batch]
    n_words = np.array([len(w) for w in split], dtype=np.int64)
    hashes = np.fromiter((known[w] for some in split for w in some), dtype=np.uint64, count=int(n_words.sum()))
    counts = np.where(n_words >= words, n_words - words + 1, (n_words > 0).astype(np.int64))
    begin = ragged(offsets_of(n_words)[:-1], counts)
    shingles = np.zeros(len(begin), dtype=np.uint64)
    short = np.repeat(n_words, counts) if (n_words < words).any() else None
    for j in range(words):
        if short is None:
            shingles = mix(shingles * _CHAIN + hashes[begin + j])
        else:
            more = np.flatnonzero(short > j)
            shingles[more] = mix(shingles[more] * _CHAIN + hashes[begin[more] + j])
    upto = offsets_of(counts)
    return [np.unique(shingles[a:b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


def _overlapping(text: bytes, words: int, limit: int) -> list[bytes]:
    """Parts that begin after white space, each going on for the ``words - 1`` words after its end.

    So every shingle is in the part in which it begins; a part of fewer words has none that begins there.
    """
    ahead = re.compile(rb"[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){0,%d}" % (words - 1))
    parts, at = [], 0
    while at < len(text):
        found = _BORDER.search(text, at + limit) if len(text) - at > limit else None
        stop = found.end() if found else len(text)
        part = text[at : ahead.match(text, stop).end()]
        if len(part.split(maxsplit=words)) >= words:
            parts.append(part)
        at = stop
    return parts or [text]


def node_of(shingles: np.ndarray) -> bytes | None:
    """The name of a set: a digest of its sorted hashes; null for the empty set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def minhash(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH least values."""
    low = np.full(TREES * DEPTH, 0xFFFFFFFF, dtype=np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 256):
        part = x[i : i + 256, None] * _A
        part += _B
        np.minimum(low, part.min(axis=0), out=low)
    return low


def sketch(low: np.ndarray) -> tuple[bytes, bytes]:
    """Of MinHash values: 16 bits each to sort by (equal values stay equal), and two bits each as a signature."""
    mixed = low * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x85EBCA6B)
    two = (mixed & np.uint32(3)).astype(np.uint8).reshape(-1, 4)
    return (mixed >> np.uint32(16)).astype(">u2").tobytes(), (two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).tobytes()


_SIGNATURE_BYTES = TREES * DEPTH // 4


def least_agreement(percent: int) -> int:
    """Of TREES * DEPTH places of two signatures, how many agree at least: a quarter of the different values do by chance."""
    return math.ceil(TREES * DEPTH * (0.25 + 0.75 * (percent / 100 - SLACK)))


def _chunked(batch: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in batch:
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def features(docs: DataFrame, rule: Rule, text: str = "text") -> DataFrame:
    """(doc_id, key, node, n, signature, orders) of every row; the last two are null where an equal set came before in the batch."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            nodes, sizes, signatures, orders = [], [], [], []
            seen: set[bytes] = set()
            for some in _chunked(raw_bytes(batch.column(1))):
                for shingles in shingle_sets(some, rule.words):
                    node = node_of(shingles)
                    nodes.append(node)
                    sizes.append(len(shingles))
                    if node is None or node in seen:
                        signatures.append(None)
                        orders.append(None)
                        continue
                    seen.add(node)
                    order, signature = sketch(minhash(shingles))
                    signatures.append(signature)
                    orders.append(order)
            arrays = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), pa.array(orders, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays], ["doc_id", "key", "node", "n", "signature", "orders"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", text, text_key(F.col(text)).alias("key"))
    return keyed.mapInArrow(run, f"doc_id {kind}, key binary, node binary, n long, signature binary, orders binary")


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (each the least place of its component) after linking places ``a`` with places ``b``."""
    parent = label.tolist()

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    out = np.array(parent, dtype=np.int64)
    while not np.array_equal(nearer := out[out], out):
        out = nearer
    return out


class Order:
    """Consecutive rows of the orders: compares each with those before it, and says what became connected."""

    def __init__(self, least_depth: int, least: int, reach: int = REACH) -> None:
        self.prefix, self.least, self.reach = 2 * least_depth, least, reach
        self.regions: list[bytes] = []
        self.names: list[bytes] = []
        self.signatures: list[bytes] = []

    def __call__(self, regions: list[bytes], names: list[bytes], signatures: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Links (node, least node of its star) that the new rows bring, with the last rows of the call before."""
        old = len(self.names)
        regions, names, signatures = self.regions + regions, self.names + names, self.signatures + signatures
        n = len(names)
        _, region = np.unique(np.array(regions, dtype=object), return_inverse=True)
        bits = np.frombuffer(b"".join(signatures), dtype=np.uint64).reshape(n, -1)
        label = np.arange(n)
        odd = np.uint64(0x5555555555555555)
        for step in range(1, min(self.reach, n - 1) + 1):
            here = np.flatnonzero(region[step:] == region[:-step]) + step
            here = here[(here >= old) & (label[here] != label[here - step])]
            if not len(here):
                continue
            apart = bits[here] ^ bits[here - step]
            apart = np.bitwise_count((apart | apart >> np.uint64(1)) & odd).sum(axis=1)
            here = here[TREES * DEPTH - apart >= self.least]
            if len(here):
                label = _roots(label, here, here - step)
        # The star's centre is the least name, so that stars of other orders have the same.
        halves = np.frombuffer(b"".join(names), dtype=">u8").reshape(n, 2)
        by_name = np.lexsort((halves[:, 1], halves[:, 0]))
        centre = np.empty(n, dtype=np.int64)
        centre[label[by_name[::-1]]] = by_name[::-1]
        self.regions, self.names, self.signatures = regions[-self.reach :], names[-self.reach :], signatures[-self.reach :]
        return [(names[i], names[c]) for i, c in enumerate(centre[label].tolist()) if names[i] != names[c]]


_ROW = pa.schema([("border", pa.bool_()), ("region", pa.binary()), ("place", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])


def _links(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    nothing = [None] * len(found)
    return pa.RecordBatch.from_arrays(
        [pa.array([False] * len(found)), pa.array(nothing, pa.binary()), pa.array(nothing, pa.binary()), *(pa.array([f[k] for f in found], pa.binary()) for k in (0, 1))],
        schema=_ROW,
    )


def _runs(batches: Iterator[pa.RecordBatch], limit: int = RUN_ROWS) -> Iterator[list[list]]:
    """The columns of up to ``limit`` rows at a time, as lists."""
    held: list[list] = []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        held = [a + b for a, b in zip(held, columns, strict=True)] if held else columns
        if held and len(held[0]) >= limit:
            yield held
            held = []
    if held and held[0]:
        yield held


def neighbours(nodes: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) of nodes (node, signature, orders) that connect each node with its agreeing candidates in every order."""
    width = 2 * DEPTH
    least_depth, least = rule.least_depth, least_agreement(rule.percent)
    prefix = 2 * least_depth
    spread = nodes.select("node", "signature", "orders", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        F.expr(f"concat(unhex(lpad(hex(tree), 2, '0')), substring(orders, tree * {width} + 1, {width}))").alias("place"), "node", "signature"
    )
    ordered = spread.repartitionByRange("place", "node").sortWithinPartitions("place", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within the partition; the rows at its two ends go on beside them, to meet those of other partitions."""
        order = Order(least_depth, least)
        first: list[tuple] = []
        last: list[tuple] = []
        for places, names, signatures in _runs(batches):
            yield _links(order([p[: 1 + prefix] for p in places], names, signatures))
            rows = list(zip(places, names, signatures, strict=True))
            first += rows[: max(0, REACH - len(first))]
            last = (last + rows[-REACH:])[-REACH:]
        ends = sorted(set(first + last))
        if ends:
            # Of the border's rows only those in the regions of the first and the last row can have neighbours beyond.
            region = {ends[0][0][: 1 + prefix], ends[-1][0][: 1 + prefix]}
            ends = [e for e in ends if e[0][: 1 + prefix] in region]
            yield pa.RecordBatch.from_arrays(
                [pa.array([True] * len(ends)), pa.array([e[0][: 1 + prefix] for e in ends], pa.binary()), *(pa.array([e[k] for e in ends], pa.binary()) for k in (0, 1, 2))],
                schema=_ROW,
            )

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(least_depth, least)
        for regions, _, names, signatures in _runs(batches):
            yield _links(order(regions, names, signatures)).select(["a", "b"])

    found = stored(ordered.mapInArrow(run, "border boolean, region binary, place binary, a binary, b binary"))
    border = found.filter("border").select("region", "place", F.col("a").alias("node"), F.col("b").alias("signature"))
    met = border.repartition("region").sortWithinPartitions("region", "place", "node").mapInArrow(across, "a binary, b binary")
    return found.filter("NOT border").select("a", "b").unionByName(met).distinct()


class Block:
    """The sets of one block, with an inverted index from shingles to rows."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.upto = offsets_of(self.sizes)
        joined = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        self.known, self.codes = np.unique(joined, return_inverse=True)
        rows = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(self.codes, kind="stable")
        self.rows = rows[order]
        self.counts = np.bincount(self.codes, minlength=len(self.known))
        self.begin = np.cumsum(self.counts) - self.counts

    def linked(self, codes: np.ndarray, size: int) -> np.ndarray:
        """Rows linked with a set of this size of which these shingles are known."""
        common = np.bincount(self.rows[ragged(self.begin[codes], self.counts[codes])], minlength=len(self.sizes))
        return np.flatnonzero((100 * common >= self.percent * (size + self.sizes - common)) & (common > 0))

    def own(self, row: int) -> np.ndarray:
        return self.linked(self.codes[self.upto[row] : self.upto[row + 1]], int(self.sizes[row]))

    def visitor(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(0, dtype=np.int64)
        place = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return self.linked(place[self.known[place] == shingles], len(shingles))

    def central(self) -> np.ndarray:
        """Rows by how common their shingles are in the block, per shingle, most first."""
        weight = np.add.reduceat(self.counts[self.codes].astype(float), self.upto[:-1]) / self.sizes
        return np.argsort(-weight, kind="stable")

    def labels(self) -> np.ndarray:
        """The exact components: for each row the least row of its component."""
        label = np.arange(len(self.sizes))

        def link(row: int) -> None:
            roots = np.unique(label[np.append(self.own(row), row)])
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]

        first = self.central()[:PIVOTS]
        for row in first.tolist():
            link(row)
        done = np.zeros(len(label), dtype=bool)
        done[first] = True
        largest = np.bincount(label).argmax()
        for row in np.flatnonzero((label != largest) & ~done).tolist():
            link(row)
        return label


_SET = "cluster binary, block long, blocks long, node binary, shingles binary"
_LABELLED = f"{_SET}, root binary, central boolean"


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[list[dict]]:
    """Rows with equal keys that follow each other; a group is held whole, and its size is bounded by the blocks."""
    held: list[dict] = []
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[k] for k in key)
            if held and now != last:
                yield held
                held = []
            last = now
            held.append(row)
    if held:
        yield held


def _rows(rows: list[dict], ddl: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=ddl)


_LABELLED_ARROW = pa.schema(
    [("cluster", pa.binary()), ("block", pa.int64()), ("blocks", pa.int64()), ("node", pa.binary()), ("shingles", pa.binary()), ("root", pa.binary()), ("central", pa.bool_())]
)


def label_blocks(sets: DataFrame, percent: int) -> DataFrame:
    """Add the exact root within the block to each row; the sets go on only for clusters of several blocks."""
    dealt = sets.repartition("cluster", "block").sortWithinPartitions("cluster", "block", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for group in _groups(batches, ("cluster", "block")):
            block = Block([np.frombuffer(r["shingles"], dtype=np.uint64) for r in group], percent)
            label = block.labels()
            several = group[0]["blocks"] > 1
            middle = set()
            if several:
                largest = np.bincount(label).argmax()
                middle = set([r for r in block.central().tolist() if label[r] == largest][:PIVOTS])
            for i, row in enumerate(group):
                out.append({**row, "shingles": row["shingles"] if several else None, "root": group[label[i]]["node"], "central": i in middle})
            if len(out) >= 1024:
                yield _rows(out, _LABELLED_ARROW)
                out = []
        if out:
            yield _rows(out, _LABELLED_ARROW)

    return dealt.mapInArrow(run, _LABELLED)


def visits(members: DataFrame, visitors: DataFrame, percent: int) -> DataFrame:
    """Exact links (a, b) of visitors with the members of other blocks of their cluster, one for each root there.

    A visitor goes to the blocks of its own band of set sizes and of the two beside it: sets of other
    bands differ in size by more than the threshold allows.
    """
    home = members.select("cluster", "block", "node", "root", "shingles", F.lit(0).alias("visits"))
    rooms = members.select("cluster", "block").distinct().withColumnRenamed("block", "room")
    away = visitors.select("cluster", F.col("block").alias("home"), "node", "root", "shingles").join(rooms, "cluster")
    away = away.filter((F.col("room") != F.col("home")) & (F.abs(band_of("room") - band_of("home")) <= 1))
    both = home.unionByName(away.select("cluster", F.col("room").alias("block"), "node", "root", "shingles", F.lit(1).alias("visits")))
    dealt = both.repartition("cluster", "block").sortWithinPartitions("cluster", "block", "visits", "node")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, block, roots = None, [], None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                now = (row["cluster"], row["block"])
                if now != key:
                    key, rows, block = now, [], None
                shingles = np.frombuffer(row["shingles"], dtype=np.uint64)
                if not row["visits"]:
                    rows.append((row["node"], row["root"], shingles))
                    continue
                if block is None:
                    block = Block([s for _, _, s in rows], percent)
                    roots = np.unique([r for _, r, _ in rows], return_inverse=True)[1] if rows else np.zeros(0, dtype=np.int64)
                found = block.visitor(shingles)
                for i in found[np.unique(roots[found], return_index=True)[1]].tolist():
                    out.append({"a": row["node"], "b": rows[i][0]})
            if out:
                yield _rows(out, schema)

    return dealt.mapInArrow(run, "a binary, b binary")


#: Blocks of one band of set sizes.
_BAND = 1 << 24


def band_of(block: str) -> Column:
    return F.floor(F.col(block) / _BAND)


def dealt_blocks(chosen: DataFrame, percent: int) -> DataFrame:
    """Add blocks (their number in the cluster) and block to nodes (cluster, node, n).

    Clusters within one block's bounds are one block. Others are cut into bands of set sizes, each a
    factor of the threshold wide, and a band into as many blocks, by hash, as its rows and shingles need.
    """
    needed = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / min(percent, 99)))).cast("long")
    chosen = chosen.withColumn("band", band)
    by_band = chosen.groupBy("cluster", "band").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), needed.alias("own"))
    whole = by_band.groupBy("cluster").agg(
        F.greatest(F.ceil(F.sum("rows") / BLOCK_ROWS), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks"),
        F.collect_list(F.struct("band", "own")).alias("bands"),
    )
    # The bands of a cluster are few: log(longest / shortest) of them.
    own = F.filter("bands", lambda b: b["band"] == F.col("band"))[0]["own"]
    placed = F.when(F.col("blocks") <= 1, F.lit(0).cast("long")).otherwise(F.col("band") * _BAND + F.pmod(F.xxhash64("node"), own))
    return chosen.join(whole, "cluster").withColumn("block", placed).drop("n", "band", "bands")


def _sets(docs: DataFrame, chosen: DataFrame, rule: Rule, text: str) -> DataFrame:
    """The shingle sets of the chosen nodes, from the text of one row each (rep: its id and key)."""
    held = docs.select("doc_id", F.col(text).alias("text"), text_key(F.col(text)).alias("key"))
    same = F.col("d.doc_id").eqNullSafe(F.col("c.rep.doc_id")) & F.col("d.key").eqNullSafe(F.col("c.rep.key"))
    joined = held.alias("d").join(small(chosen).alias("c"), same)
    joined = joined.select("text", "node", "cluster", "block", "blocks")
    schema = pa.schema([("cluster", pa.binary()), ("block", pa.int64()), ("blocks", pa.int64()), ("node", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 0):
            rest = batch.select(["node", "cluster", "block", "blocks"]).to_pylist()
            found = [s for some in _chunked(raw_bytes(batch.column(0))) for s in shingle_sets(some, rule.words)]
            yield _rows([{**r, "shingles": s.tobytes()} for r, s in zip(rest, found, strict=True)], schema)

    return joined.mapInArrow(run, _SET)


def classes(docs: DataFrame, rule: Rule, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Features of every row (doc_id, key, node, n), and the root of each node that has a link (node, root)."""
    prepare(docs.sparkSession)
    rows = stored(features(docs, rule, text))
    nodes = stored(rows.filter("orders IS NOT NULL").select("node", "signature", "orders").dropDuplicates(["node"]))
    clusters = components(neighbours(nodes, rule)).select("node", F.col("root").alias("cluster"))
    known = rows.filter("node IS NOT NULL").groupBy("node").agg(_first_row().alias("rep"), F.first("n").alias("n"))
    chosen = stored(dealt_blocks(clusters.join(known, "node"), rule.percent))
    sets = _sets(docs, chosen, rule, text).dropDuplicates(["cluster", "block", "node"]) if _repeats(rows) else _sets(docs, chosen, rule, text)
    labelled = stored(label_blocks(sets, rule.percent))
    roots = labelled.filter("node != root").select("node", "root")
    several = labelled.filter("blocks > 1")
    if several.limit(1).count():
        inner = several.select(F.col("node").alias("a"), F.col("root").alias("b"))
        links = stored(visits(several, several.filter("central"), rule.percent))
        now = components(inner.unionByName(links))
        named = several.join(now.withColumnRenamed("root", "now"), "node")
        largest = named.groupBy("cluster", "now").count().groupBy("cluster").agg(F.max_by("now", F.struct("count", "now")).alias("largest"))
        outside = named.join(largest, "cluster").filter("now != largest").select(several.columns)
        links = links.unionByName(visits(several, outside, rule.percent))
        whole = components(inner.unionByName(links)).filter("node != root")
        roots = labelled.filter("blocks = 1 AND node != root").select("node", "root").unionByName(whole.select("node", "root"))
    return rows.select("doc_id", "key", "node", "n"), roots


def _first_row() -> Column:
    """The least (id, key) of a group's rows; ids come before null."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key"))


def _repeats(rows: DataFrame) -> bool:
    """Whether some id and text stand for several rows, which a join by both would bring twice."""
    return rows.groupBy("doc_id", "key").count().filter("count > 1").limit(1).count() > 0


def near_duplicates(docs: DataFrame, rule: Rule | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the class's least id) and kept (the document that stands for its class) of every row."""
    rows, roots = classes(docs, rule or Rule(), text)
    named = rows.filter("node IS NOT NULL")
    least = named.groupBy("node").agg(F.min("doc_id").alias("low")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = least.groupBy("root").agg(F.min("low").alias("component_id"))
    # Only nodes that are not their own root need their root's id from elsewhere.
    of_node = least.join(of_root, "root").select("node", "component_id")
    linked = named.join(of_node, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.filter("node IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", kept())


def deduplicate(docs: DataFrame, rule: Rule | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the near copies: one row of each class stays, with all its columns.

    It is the one with the least id (null comes last) and then the least key. Rows go by an anti join
    with the ids and keys that are not kept, the smaller side; of rows that share id and text one stays.
    """
    rows, roots = classes(docs.select("doc_id", text), rule or Rule(), text)
    named = rows.filter("node IS NOT NULL").select("doc_id", "key", "node")
    of_node = named.groupBy("node").agg(_first_row().alias("low")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = of_node.groupBy("root").agg(F.min("low").alias("first"))
    stays = of_node.join(of_root, "root").select("node", "first")
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("key").eqNullSafe(F.col("first.key")))
    gone = named.join(stays, "node").filter(other).select("doc_id", "key").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & text_key(F.col(f"d.{text}")).eqNullSafe(F.col("g.key"))
    left = docs.alias("d").join(gone.alias("g"), same, "left_anti")
    return left.dropDuplicates(["doc_id", text]) if _repeats(rows) else left


def kept() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("component_id"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), Rule(words=3, percent=85))


QUERIES = {"op9_minhash_near_dedup": op9_minhash_near_dedup}
