"""N-gram Jaccard join, exact at SAME percent: documents whose sets of word shingles agree so far are linked.

Equal sets are one node. Nodes lie in bands of size, each SAME percent of the next, so that the partners of a node are in its band or in
one beside it. Two that link differ in at most so many shingles as their band allows; their hashes are cut into more ranges than that,
so a range is equal in both. Nodes are dealt by the hashes of their ranges, and what shares one is a tile. (A range of less than two
shingles says little and is left out, unless a node has more of these than there are spare ranges: then whoever is equal to it there
has them too.) Tiles of the same members are one tile.

In a tile each node has a bitmap of its hashes, bits by its size. A bit that only one of two has stands for a shingle that the other
lacks, so bit counts bound the overlap from above; what passes is told by the intersection of the sorted hashes. First the nodes of a
tile are compared to a few of them; then only what is not in one component yet. Links that join no components are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import Words, byte_table, checkpointed, column, dealt_join, grams, hot_keys, mixed, partitions, slices, stored
from foliant.llm.components import components

SHINGLE, SAME = 4, 85
#: Members of a tile that one task has; nodes whose ids go to the tasks; ids that a task remembers; comparisons at once, in 64-bit words.
HOT, FEW, SEEN, WORDS = 512, 1 << 18, 1 << 18, 1 << 21
#: Members to which all of a tile are compared at first.
FIRST = 8
SLICE = 1 << 20

#: Words between the ASCII white space characters; a zero byte is a letter like any other, and no word has byte 32.
_SPACED = byte_table(lambda b: b != 32 and not 9 <= b <= 13)
_SPACED[0] = 32


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The distinct hashes of each text's k-word shingles in order; of fewer words the whole sequence is one."""
    w = Words(texts, _SPACED)
    n = w.counts()
    first, g = np.cumsum(n) - n, grams(w.hash, k)
    out = []
    for a, m in zip(first.tolist(), n.tolist(), strict=True):
        if m >= k:
            out.append(np.unique(g[a : a + m - k + 1]))
        elif m:
            out.append(mixed(grams(w.hash[a : a + m], m) + np.uint64(m)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(hashes: np.ndarray) -> tuple[int, int]:
    """Two numbers of a set that do not depend on each other: its id, and a check that the id is of no other."""
    with np.errstate(over="ignore"):
        own = mixed(hashes ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64), mixed(hashes + np.uint64(0x8EBC6AF09C88C6E3)).sum(dtype=np.uint64)
        return tuple(int(x) for x in mixed(np.array(own) + np.uint64(len(hashes))).view(np.int64))


class Bands:
    """Bands of set sizes for links at same percent or more, and the ranges of each."""

    def __init__(self, same: int = SAME):
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(100 * edges[-1] // same + 1)
        self.same, self.edges = same, np.array(edges)
        self.apart = []  # shingles that only one of two has, at most, the smaller one being in the band
        for top in edges[1:]:
            a = top - 1
            self.apart.append((a + 100 * a // same) * (100 - same) // (100 + same))
        self._cuts: dict[int, np.ndarray] = {}

    def cuts(self, band: int) -> tuple[np.ndarray, int]:
        """First hashes of all ranges but the first, and how many ranges are spare."""
        spare = 1 + self.apart[band] // 16
        if band not in self._cuts:
            parts = self.apart[band] + 1 + spare
            self._cuts[band] = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
        return self._cuts[band], spare

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """What a set is dealt by: hashes of its ranges, for its own band and the one below."""
        own = int(np.searchsorted(self.edges, len(hashes), side="right")) - 1
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ np.uint64(0xE7037ED1A0B428DB)), dtype=np.uint64)))
        out = []
        for band in (own - 1, own):
            if band < 0 or not self.apart[band]:
                continue
            cuts, spare = self.cuts(band)
            edge = np.concatenate(([0], np.searchsorted(hashes, cuts), [len(hashes)]))
            size = np.diff(edge)
            part = np.arange(len(size), dtype=np.uint64) + (np.uint64(band) << np.uint64(40))
            key = mixed(total[edge[1:]] - total[edge[:-1]] + mixed(part + np.uint64(1)))
            weak = size < 2
            out.append(key[~weak] if weak.sum() <= spare else key)
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether two sets, as sorted hashes, agree by same percent or more."""
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        if not len(a):
            return False
        both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return 100 * both >= self.same * (len(a) + len(b) - both)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A bit for each hash in 4 times as many bits or more, a power of two; half of the words is the bitmap of half the bits."""
    bits = 64
    while bits < 4 * len(hashes):
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(mixed(hashes) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


class Maps:
    """Bitmaps of the members of a tile, folded to the shortest."""

    def __init__(self, maps: list[np.ndarray], sizes: np.ndarray, same: int):
        width = min(map(len, maps))
        self.rows = np.array([np.bitwise_or.reduce(m.reshape(-1, width), axis=0) for m in maps])
        self.sizes, self.same, self.bits = sizes.astype(np.int64), same, np.bitwise_count(self.rows).sum(1, dtype=np.int64)

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For members a by members b, whether the overlap that the bits allow is enough."""
        both = np.bitwise_count(self.rows[a][:, None] & self.rows[b][None]).sum(2, dtype=np.int64)
        spare = self.sizes - self.bits  # shingles that share their bit with another of their own set
        most = both + np.minimum(spare[a][:, None], spare[b][None])
        most = np.minimum(most, np.minimum(self.sizes[a][:, None], self.sizes[b][None]))
        return (100 + self.same) * most >= self.same * (self.sizes[a][:, None] + self.sizes[b][None])

    def pairs(self, other: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each member with those before it that it may link to and for which other (labels) differs."""
        m = len(self.sizes)
        step = max(1, WORDS // max(1, m * self.rows.shape[1]))
        for at in range(0, m, step):
            a = np.arange(at, min(m, at + step))
            if (other[: a[-1] + 1] == other[0]).all():
                continue
            may = self.may_link(a, np.arange(a[-1] + 1)) & (other[a][:, None] != other[None, : a[-1] + 1])
            for i, row in zip(a.tolist(), may, strict=True):
                yield i, np.flatnonzero(row[:i])


def _nodes(text: pa.Array, k: int) -> list:
    """Node, check and size of each text, null for those without words."""
    own = [(*node_of(s), len(s)) if len(s) else (None, None, 0) for s in shingle_sets(text, k)]
    return [list(x) for x in zip(*own, strict=True)] if own else [[], [], []]


def marks(docs: DataFrame, text: str, key: str, k: int) -> DataFrame:
    from pyspark.sql.types import LongType, StructField

    from foliant.llm.common import map_texts

    own = docs.select(column(key).alias("doc_id"), column(text).cast("string").alias("_text"))
    return map_texts(own, ["_text"], ["doc_id"], [StructField(c, LongType()) for c in ("node", "check", "n")], lambda: lambda t: _nodes(t, k))


def _each_set(docs: DataFrame, text: str, k: int, made: Callable, schema: str) -> DataFrame:
    """made(node, hashes) for the sets of a task, each once as far as it remembers, as record batches of schema."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                out = []
                for hashes in shingle_sets(part.column(0), k):
                    if not len(hashes):
                        continue
                    node = node_of(hashes)[0]
                    if node not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(node)
                        out += made(node, hashes)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*out, strict=True)], names=names)

    return docs.select(column(text).cast("string").alias("t")).mapInArrow(run, schema)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def shared_ranges(docs: DataFrame, text: str, k: int, bands: Bands) -> DataFrame:
    """key, node: nodes with a range that another node has too."""

    def dealt(node: int, hashes: np.ndarray) -> list:
        keys = bands.keys(hashes)
        return [(_signed(keys), pa.array(np.full(len(keys), node)))] if len(keys) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of key and node. The last row waits for the next one."""
        last, given = None, False
        for batch in batches:
            key, node = (c.to_numpy() for c in batch.columns)
            if last is not None:
                key, node = np.concatenate(([last[0]], key)), np.concatenate(([last[1]], node))
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
            key, node = key[new], node[new]
            if not len(key):
                continue
            alike = key[1:] == key[:-1]
            many = np.concatenate((alike, [False])) | np.concatenate(([False], alike))
            many[0] &= not (last is not None and given)
            # the first row may be the one that waited; the last one goes now only if it is like the one before it
            given = bool(many[-1]) or (len(key) == 1 and last is not None and given)
            last = (key[-1], node[-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(node[many])], names=["key", "node"])

    spread = partitions(docs.sparkSession)
    rows = _each_set(docs, text, k, dealt, "key long, node long")
    return rows.repartition(spread, "key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long")


def _tiles(rows: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(table) for the rows of each key, one key at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if held and held[0].column(0)[0].as_py() != keys[a]:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held))

    return rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "node").mapInArrow(run, schema)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _lists(table: pa.Table, name: str) -> list[np.ndarray]:
    found = table.column(name).combine_chunks()
    flat = found.flatten().to_numpy().view(np.uint64)
    return np.split(flat, np.cumsum(found.value_lengths().to_numpy())[:-1])


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = SHINGLE, same: int = SAME, hot: int = HOT, few: int = FEW) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    component_id is the least key reachable by links of sets that agree by same percent or more (null only if all keys of the
    component are). Null and empty texts and those of white space have no shingles and link with nothing; very long texts
    are read whole. Rows of a repeated key are documents each, equal texts have equal results. An empty table gives an empty
    result. No column but key and text is read, so others may have any name. Two sets with one 64-bit id, of which some twenty
    are to be expected among 3e10, raise an error.
    """
    bands = Bands(same)
    marked = checkpointed(marks(docs, text, key, k))
    nodes = checkpointed(marked.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("m"), F.min("check").alias("low"), F.max("check").alias("high")))
    n, rows, clash = nodes.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.max(F.col("low") != F.col("high")), F.lit(False))).first()
    if clash:
        raise RuntimeError("two different sets have one id")
    root = components(links(docs, text, k, bands, hot, few))
    named = nodes.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    named = dealt_join(named.select("node", "root"), whole.select("root", "component_id"), "root", hot_keys(whole, "root", n), "node").select("node", "component_id")
    out = dealt_join(marked.filter("node is not null"), named, "node", hot_keys(nodes, "node", rows), "doc_id")
    alone = marked.filter("node is null").withColumn("component_id", F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone.select("doc_id", "n", "component_id"))


def links(docs: DataFrame, text: str, k: int, bands: Bands, hot: int = HOT, few: int = FEW) -> DataFrame:
    """Links a, b between nodes, enough of them to join all that link."""
    same = bands.same
    shared = stored(shared_ranges(docs, text, k, bands), "ranges", tidy=True)
    tiles = shared.groupBy("key").agg(F.count("*").alias("m"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y"))
    tiles = checkpointed(tiles.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", "m"))
    n = shared.count()
    members = stored(dealt_join(shared, tiles, "key", hot_keys(tiles, "key", n), "node"), "tiles", tidy=True)
    sets = _sets(docs, text, k, members.select("node").distinct(), few)

    # a few members of each tile against all; a large tile in pieces, whose first members are compared to each other
    cuts = F.ceil(F.col("m") / hot).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    maps = sets.select("node", "n", "map")
    cut = members.withColumn("cuts", cuts).select(F.xxhash64("key", own).alias("key"), "node").join(maps, "node").select("key", "node", "n", "map")

    def few_first(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        node, rest = _numbers(table, "node"), np.arange(table.num_rows)
        tile, a, b = Maps(_lists(table, "map"), _numbers(table, "n"), same), [], []
        for _ in range(FIRST):
            if len(rest) < 2:
                break
            near = np.concatenate([tile.may_link(rest[:1], x)[0] for x in np.array_split(rest[1:], 1 + len(rest) * tile.rows.shape[1] // WORDS)])
            a += [node[rest[0]]] * int(near.sum())
            b += node[rest[1:][near]].tolist()
            rest = rest[1:][~near]
        yield _edges(a, b)

    tops = members.withColumn("cuts", cuts).filter("cuts > 1").groupBy("key", own.alias("piece")).agg(F.min("node").alias("b"))
    tops = tops.join(tops.groupBy("key").agg(F.min("b").alias("a")), "key").filter("a <> b").select("a", "b")
    edges = checkpointed(_tiles(cut, few_first, "a long, b long").union(tops).distinct())
    told = checkpointed(_told(edges, sets, bands))

    # what is left: members of one tile that these links don't join in two steps, any two of a tile in one task
    root = _near_roots(told)
    spread = members.withColumn("cuts", cuts).join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = spread.groupBy("key").agg((F.min("root") != F.max("root")).alias("open"), F.count("*").alias("m")).filter("open")
    left = dealt_join(spread.drop("m"), open_.select("key"), "key", hot_keys(open_, "key", n), "node")
    left = left.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    left = left.select(F.xxhash64("key", F.least("own", "with"), F.greatest("own", "with")).alias("key"), "node", "root")

    def may(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        tile, found = Maps(_lists(table, "map"), _numbers(table, "n"), same), np.zeros(table.num_rows, bool)
        for i, near in tile.pairs(_numbers(table, "root")):
            if len(near):
                found[i] = found[near] = True
        if found.any():
            yield table.select(["key", "node", "root"]).filter(pa.array(found)).combine_chunks().to_batches()[0]

    def all_left(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        node, label, hashes = _numbers(table, "node"), _numbers(table, "root").copy(), _lists(table, "hashes")
        tile, a, b = Maps([bitmap(x) for x in hashes], np.array([len(x) for x in hashes]), same), [], []
        for i, near in tile.pairs(label.copy()):
            while len(near := near[label[near] != label[i]]):
                if bands.linked(hashes[i], hashes[near[0]]):
                    a.append(int(node[i]))
                    b.append(int(node[near[0]]))
                    label[label == label[i]] = label[near[0]]
                near = near[1:]
        yield _edges(a, b)

    flagged = checkpointed(_tiles(left.join(maps, "node").select("key", "node", "root", "n", "map"), may, "key long, node long, root long"))
    rest = _tiles(flagged.join(sets.select("node", "hashes"), "node").select("key", "node", "root", "hashes"), all_left, "a long, b long")
    return told.union(rest)


def _sets(docs: DataFrame, text: str, k: int, wanted: DataFrame, few: int) -> DataFrame:
    """node, n, map, hashes of the wanted nodes. Up to few of them are told to the tasks, so that only their sets leave these."""
    wanted = checkpointed(wanted)
    n = wanted.count()
    ids = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow().column(0).to_numpy())) if n <= few else None

    def made(node: int, hashes: np.ndarray) -> list:
        if ids is not None:
            at = int(np.searchsorted(ids.value, node))
            if at == len(ids.value) or ids.value[at] != node:
                return []
        one = lambda x: pa.array([x.view(np.int64)], pa.list_(pa.int64()))
        return [(pa.array([node]), pa.array([len(hashes)]), one(bitmap(hashes)), one(hashes))]

    rows = _each_set(docs, text, k, made, "node long, n long, map array<long>, hashes array<long>")
    if ids is None:
        rows = rows.join(wanted, "node", "left_semi")
    return stored(rows.dropDuplicates(["node"]), "sets", tidy=True)


def _near_roots(edges: DataFrame) -> DataFrame:
    """node, root: the least node within two links; what has one root is in one component, though not the other way round."""
    both = edges.union(edges.select("b", "a"))
    near = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"), F.count("*").alias("m")).withColumnRenamed("a", "node"))
    n = near.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    further = dealt_join(both.withColumnRenamed("b", "node"), near.select("node", "least"), "node", hot_keys(near, "node", n), "a")
    return further.groupBy(F.col("a").alias("node")).agg(F.min("least").alias("root"))


def _told(edges: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """Those of edges a, b that are links, by the intersection of the sorted hashes."""
    counted = edges.groupBy("a").agg(F.count("*").alias("m"))
    half = edges.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    both = dealt_join(half, sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a", hot_keys(counted, "a", edges.count()), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if batch.num_rows:
                kept = [bands.linked(x, y) for x, y in zip(_lists(table, "x"), _lists(table, "y"), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(kept))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")
