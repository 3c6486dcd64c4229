"""SimHash near-duplicate detection: fingerprints, exact tiled comparison, components.

Defined results: a null text counts as empty; a text without words has fingerprint 0 and links like any
other; a row without id gets its fingerprint's component; repeated rows share one component; an empty
table gives an empty result.  Extra columns are ignored, so their names cannot clash.

Distance <= radius implies that of radius + 1 bit blocks at least one is equal, so fingerprints meet in
buckets keyed by one block.  Rows ordered by bucket and population count are cut into tiles, and tiles are compared
with exclusive-or and bit counts; pairs of tiles that share no bucket, or whose population counts differ by more than
the radius, are skipped.  Buckets over `TILE` rows are dealt out as pairs of tiles to separate groups, so that no group
grows with the data.  Each group emits a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pallium.llm.common import saved, slices

SEED = 42
RADIUS = 3
SHINGLE = 3
TILE = 1024
#: Fingerprints with over one HOT-th of all rows are joined by broadcast.
HOT = 1_000
#: Rows that go are dropped by a broadcast of their marks up to this many (8 MB); beyond it the join shuffles.
BROADCAST_MARKS = 1_000_000
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    edges = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], edges[:-shingle])).tolist()
    ends = (edges[shingle - 1 :] - 1).tolist()
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        pairs = zip(starts[at : at + BLOCK], ends[at : at + BLOCK])
        hashes = np.array([digest(joined[s:e], SEED) for s, e in pairs], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(starts)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, also: list[str] = []) -> DataFrame:  # noqa: B006
    """(id, fp, the columns `also`): fp holds the 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                values = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values.view(np.int64)), *part.columns[2:]], ["id", "fp", *also])

    kind = docs.schema[id_col].dataType.simpleString()
    more = "".join(f", {name} {docs.schema[name].dataType.simpleString()}" for name in also)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *also).mapInArrow(run, f"id {kind}, fp long{more}")


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows 0..n-1 the smallest row reachable over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def close_rows(keys: np.ndarray, fps: np.ndarray, radius: int, tile: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (a, b), a < b, with equal key and at most `radius` differing bits.

    Rows come ordered by key, then population count, and are cut into tiles; a tile is compared with itself and with
    those after it as long as they share a key and the population counts there are within the radius.
    """
    n = len(keys)
    pop = np.bitwise_count(fps).astype(np.int16)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    first = np.arange(0, n, tile)
    last = np.minimum(first + tile, n) - 1
    place = np.arange(tile)
    mine, step = np.arange(len(first)), 0
    while len(mine):
        for at in range(0, len(mine), 128):
            i = mine[at : at + 128]
            rows, others = first[i][:, None] + place, first[i + step][:, None] + place
            a, b = np.minimum(rows, n - 1), np.minimum(others, n - 1)
            near = np.bitwise_count(fps[a][:, :, None] ^ fps[b][:, None, :]) <= radius
            near &= keys[a][:, :, None] == keys[b][:, None, :]
            near &= (rows[:, :, None] < others[:, None, :]) & (others < n)[:, None, :]
            pair, x, y = np.nonzero(near)
            out_a.append(rows[pair, x])
            out_b.append(others[pair, y])
        step += 1
        mine = mine[mine + step < len(first)]
        later = first[mine + step]
        mine = mine[(keys[last[mine]] == keys[later]) & (pop[later] - pop[last[mine]] <= radius)]
    return np.concatenate(out_a), np.concatenate(out_b)


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (u > v) between distinct fingerprints at most `radius` bits apart, enough to connect each component."""
    blocks = radius + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = [
        F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) * blocks + F.lit(k)
        for k, (lo, hi) in enumerate(zip(edges, edges[1:]))
    ]
    pop = F.bit_count(F.col("fp")).cast("int")
    routed = nodes.select("fp", pop.alias("pop"), F.explode(F.array(*keys)).alias("bucket"))
    # Buckets over one tile: each population count gets its own tiles, hashed apart beyond `tile` rows.
    counts = routed.groupBy("bucket", "pop").agg(F.count("*").alias("n"))
    large = (
        counts.groupBy("bucket")
        .agg(F.sum("n").alias("rows"), F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("n") / tile).cast("int").alias("k")))).alias("tiles"))
        .filter(F.col("rows") > tile)
        .select("bucket", "tiles")
    )
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")[F.col("pop")]).cast("int")

    def pair(p, j):
        """The group of the tile pair (pop, own) and (p, j), the same from either side."""
        a, b = F.struct(F.col("pop").alias("p"), F.col("own").alias("j")), F.struct(p.alias("p"), j.alias("j"))
        return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))

    near = F.filter(F.map_entries("tiles"), lambda e: F.abs(e["key"] - F.col("pop")) <= radius)
    pairs = F.flatten(F.transform(near, lambda e: F.transform(F.sequence(F.lit(0), e["value"] - 1), lambda j: pair(e["key"], j))))
    joined = routed.join(large, "bucket", "left").withColumn("own", F.when(F.col("tiles").isNotNull(), own))
    dealt = joined.select(
        "fp",
        "pop",
        "bucket",
        F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(pairs, lambda x: F.xxhash64(x)))).alias("pair"),
    )

    def compare(batches):
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            fps = np.concatenate((fps, batch.column(1).to_numpy()))
            # the last key may go on in the next batch
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            yield forest(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
        yield forest(keys, fps)

    def forest(keys, fps):
        a, b = close_rows(keys, fps.view(np.uint64), radius) if len(keys) else (keys, keys)
        label = _labels(len(fps), a, b)
        rows = np.flatnonzero(label != np.arange(len(fps)))
        u, v = fps[rows], fps[label[rows]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    sorted_rows = (
        dealt.select(F.xxhash64("bucket", "pair").alias("key"), "pop", "fp")
        .repartition("key")
        .sortWithinPartitions("key", "pop", "fp")
        .select("key", "fp")
    )
    return sorted_rows.mapInArrow(compare, "u long, v long").filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (u > v), root being the smallest node: large-star and small-star by turns.

    Each round writes its edges to the shared folder; only a count and a checksum reach the driver.
    """
    state = saved(edges.select("u", "v"), "links")
    seen = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = state.union(state.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        star = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star = saved(star, "large-star")
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = saved(small.union(low).distinct(), "small-star")


def _components_of(prints: DataFrame, radius: int) -> DataFrame:
    """prints (id, fp, ..) with the component's smallest fingerprint `root` and `component_id`, its smallest id.

    Fingerprints of over a HOT-th of all rows, HOT of them at most, are broadcast, so that no join gathers their rows.
    """
    nodes = saved(prints.groupBy("fp").agg(F.min("id").alias("first_id"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    members = roots.union(roots.select("root", "root").distinct()).toDF("fp", "root")
    named = members.join(nodes, "fp")
    first = named.groupBy("root").agg(F.min("first_id").alias("linked_id"))
    linked = named.select("fp", "root").join(first, "root").select("fp", "root", "linked_id")
    of_print = nodes.join(linked, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("linked_id", "first_id").alias("component_id"))
    of_print = saved(of_print, "components")
    total = of_print.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(of_print.filter(F.col("n") > total / HOT).drop("n"))
    few = prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(of_print.drop("n"), "fp")
    return prints.join(hot, "fp").union(few)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of docs."""
    prints = saved(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return _components_of(prints, radius).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component of docs, that with the smallest id and then mark of id and text; rows without id stay.

    Rows are known by the mark, so rows that share an id but not a text are judged apart.  The marks of the rows that go
    are broadcast while they are few, so that texts don't move.  Of rows that repeat as a whole one stays.
    """
    mark = F.xxhash64(F.col(id_col), F.col(text_col))
    prints = fingerprints(docs.filter(F.col(id_col).isNotNull()).withColumn("_mark", mark), id_col, text_col, shingle, ["_mark"])
    rows = _components_of(saved(prints, "fingerprints"), radius).select("id", "root", "_mark")
    rows = saved(rows.groupBy("id", "_mark", "root").agg(F.count("*").alias("n")), "rows")
    kept = rows.groupBy("root").agg(F.min(F.struct("id", "_mark", "n")).alias("k")).select("k.*")
    gone = saved(rows.join(kept, ["id", "_mark"], "left_anti").select("_mark"), "gone")
    if gone.count() <= BROADCAST_MARKS:
        gone = F.broadcast(gone)
    left = docs.withColumn("_own", mark).join(gone, F.col("_own") == F.col("_mark"), "left_anti")
    left = left.filter(F.col(id_col).isNotNull())
    repeated = saved(kept.filter("n > 1").select("_mark"), "repeated")
    out = left
    if n := repeated.count():
        if n <= BROADCAST_MARKS:
            repeated = F.broadcast(repeated)
        again = F.col("_own") == F.col("_mark")
        out = left.join(repeated, again, "left_anti").union(left.join(repeated, again, "left_semi").dropDuplicates(["_own"]))
    return out.select(docs.columns).union(docs.filter(F.col(id_col).isNull()))
