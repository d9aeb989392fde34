"""What the operators share: the shared folder, components, tiles, and the word kernel."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast; larger sides are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Edges up to which one task joins what contraction has left of a graph: 16 bytes each.
ONE_TASK = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is named, a temporary one is set in local mode (tests), where all tasks share it;
    on a cluster that is an error, as executors would write to disks of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="copyloom-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/copyloom-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def giving_back(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step of mapInArrow that gives freed memory back to the system when its task ends: Spark keeps Python workers for later stages, where
    what their allocators hold counts beside the stage's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs in here hands Python workers batches of so many rows at most; a smaller setting of the session stays. Executors hold a batch
    several times outside their heap, as Arrow vectors and as what is sent, and keep those buffers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    if 0 < int(was) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def _scanned(df: DataFrame) -> bool:
    """Whether the rows of df are those of Parquet files, one for one."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if not plan.nodeName().startswith(("Relation", "LogicalRelation")):
        return False
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def numbered(df: DataFrame) -> DataFrame:
    """The table with a column row_ in front that tells its rows apart, the same whenever it is read: the numbers of the file and of
    the row within it for Parquet files; other tables are stored with a number."""
    if not _scanned(df):
        return stored(df.select(F.monotonically_increasing_id().alias("row_"), "*"), "numbered")
    at = df.select(F.col("_metadata.file_path").alias("file_"), F.col("_metadata.row_index").alias("index_"), "*")
    names = sorted(r[0] for r in at.select("file_").distinct().collect())
    files = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(names)), "k_ long, file_ string"))
    return at.join(files, "file_").select((F.shiftleft("k_", 33) + F.col("index_")).alias("row_"), *df.columns)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a stored table for broadcast if it has at most so many rows; else the planner shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all nodes of edges (a, b), in one task."""
    ends = [np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]], 1) for batch in batches]
    nodes, at = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *ends]), return_inverse=True)
    forest = Forest(len(nodes))  # nodes are in order, so a root is its tree's smallest
    for x, y in at.reshape(-1, 2).tolist():
        forest.join(x, y)
    for lo in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (nodes, nodes[forest.roots()])], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b), which are longs; the component is its smallest node.

    Each round hooks every node to its smallest neighbour (or itself) and contracts the edges, until at most ONE_TASK are left, which
    one task joins; every round is written to the shared folder. Self-loops and repeated edges do no harm; nodes that have
    no edge to another node are not returned. Nothing is returned for an empty table.
    """
    cur = stored(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    hooks: list[DataFrame] = []
    while cur.count() > ONE_TASK:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("to")), "hooks")
        hooks.append(hook)
        ha, hb = hook.toDF("a", "x"), hook.toDF("b", "y")
        nxt = cur.join(ha, "a").join(hb, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        cur = stored(nxt, "edges")
    last = stored(cur.coalesce(1).mapInArrow(_forest, "node long, component long"), "labels")
    if not hooks:
        return last
    at = hooks[0].select("node", F.col("to").alias("component"))
    for hook in [*hooks[1:], last]:
        at = at.join(hook.toDF("component", "next"), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    at = stored(at, "labels")
    root = at.groupBy("component").agg(F.least(F.min("node"), F.first("component")).alias("low"))
    return at.join(root, "component").select("node", F.col("low").alias("component"))


def tiles(nodes: DataFrame, block: int) -> DataFrame:
    """Deals nodes (group, band, node, ...) to tiles such that any two nodes of a group whose bands differ by at most
    1 meet in at least one tile. Adds tiles, an array of (tile, side): tile a long, its lowest bit set if the tile is compared
    with itself. The caller explodes it, after what else a node needs is at hand.

    A group of up to `block` nodes is one tile. Larger ones are cut into blocks within bands, and each pair of blocks
    is a tile of its own, so no task holds more than 2 * `block` nodes at once (about; blocks are dealt by hash).
    """
    count = nodes.groupBy("group", "band").agg(F.count(F.lit(1)).alias("n"))
    count = stored(count, "bands")
    total = count.groupBy("group").agg(F.sum("n").alias("total"))
    nb = count.select("group", "band", F.ceil(F.col("n") / block).cast("int").alias("nb"))
    near = [nb.select("group", (F.col("band") - d).alias("band"), F.col("nb").alias(name)) for d, name in ((1, "nb_next"), (-1, "nb_prev"))]
    plan = stored(total.join(nb, "group").join(near[0], ["group", "band"], "left").join(near[1], ["group", "band"], "left"), "plan")
    at = nodes.join(small(plan), ["group", "band"])
    at = at.withColumn("i", F.expr("cast(pmod(xxhash64(node), nb) as int)"))
    one = F.expr("array(struct(cast(xxhash64(group) | 1L as long) as tile, 0 as side))")
    many = F.expr("""concat(
        transform(sequence(0, nb - 1), j -> struct(
            case when i = j then xxhash64(group, band, i, band, j) | 1L else xxhash64(group, band, least(i, j), band, greatest(i, j)) & -2L end as tile,
            if(i <= j, 0, 1) as side)),
        if(nb_next is null, array(), transform(sequence(0, nb_next - 1), j -> struct(xxhash64(group, band, i, band + 1, j) & -2L as tile, 0 as side))),
        if(nb_prev is null, array(), transform(sequence(0, nb_prev - 1), j -> struct(xxhash64(group, band - 1, j, band, i) & -2L as tile, 1 as side))))""")
    at = at.withColumn("tiles", F.when(F.col("total") <= block, one).otherwise(many))
    return at.select("tiles", *[c for c in nodes.columns if c != "group"])


def by_tile(nodes: DataFrame) -> DataFrame:
    """A row for each tile of a node, the rows of a tile together in order; runs() then cuts them apart."""
    rest = [c for c in nodes.columns if c != "tiles"]
    return nodes.select(F.inline("tiles"), *rest).repartition("tile").sortWithinPartitions("tile", "side")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The tables of rows that share a tile, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column("tile").to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if held and s == 0 and held[-1].column("tile")[0].as_py() != key[0]:
                yield pa.Table.from_batches(held)
                held = []
            elif s:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def give_back() -> None:
    """Returns freed memory to the system, as idle Python workers keep what they once took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def roots(self) -> np.ndarray:
        while not np.array_equal(nxt := self.up[self.up], self.up):
            self.up = nxt
        return self.up


# Words are hashed from the bytes of a whole batch at once: a random 64-bit number for each byte, times an odd base to the
# power of its place; differences of prefix sums give each word's hash, brought to place 0 by the inverse power.
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each text starts (nulls count as empty)."""
    wide = pa.types.is_large_string(col.type)
    if col.null_count:
        col = col.fill_null("")
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(offs) and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def chunks(offs: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ (A-Z lower-cased) of texts, and where each text's words start."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    value = _BYTE[buf]
    inside = value != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offs[(offs > 0) & (offs < n)]
    first[at] = inside[at]
    last[at - 1] = inside[at - 1]
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value * power[:n], out=sums[1:])
    s = np.flatnonzero(first)
    e = np.flatnonzero(last) + 1
    return mixed((sums[e] - sums[s]) * inverse[s]), np.searchsorted(s, offs)
