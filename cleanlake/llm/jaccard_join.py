"""N-gram Jaccard join by PartEnum signatures, and the groups its links form.

A document is its set of word shingles; equal sets are one class. Two sets similar enough differ in
at most k shingles, and k follows from their sizes. Sizes fall into bands; a set takes part in its
own band and in that of the largest partner it can have. A band cuts the domain of shingles into
more parts than any such pair can differ in, so similar sets agree on some part that is not empty:
what a part holds is a signature. By the prefix principle k + 1 signatures of a set are enough if
all sets choose them by one order; parts that hold many shingles come first, as a passage that many
documents share seldom fills such a part alone. A set that fills too few parts adds signatures whose
parts are single shingles, with which the guarantee always holds.

Classes with a common signature form buckets. A bucket is first searched around the member that shares
most; what that links forms components, and only pairs that are still in different
components are compared. Small buckets list such pairs. Members of large ones choose their signatures
anew, the rarest first, which breaks up what common passages brought together; those that still meet
are near copies of one text, and each that its cluster's largest component lacks is compared with the
whole cluster, block by block. So no link between components is lost, near copies are not expanded
into all pairs, and no bucket comes to one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cleanlake.llm.shared import (
    forget,
    fresh_folder,
    key_filter,
    mixed,
    passing,
    slices,
    table,
    written,
)

SHINGLE, SIMILAR = 5, 80
#: Ratio of a band's bounds; parts for each shingle of a band's largest set; members of a bucket
#: from which on its pairs are not listed.
BAND, PARTS, LARGE = 1.6, 0.30, 32
#: Characters whose shingles are worked out together; some 50 bytes of memory each.
PART = 1_000_000
#: Sets in a block of those that are compared one by one.
BLOCK = 256

_RANDOM = np.random.default_rng(20240501)
#: A random word for each byte, so that text hashes do not depend on how bytes are numbered.
BYTES = _RANDOM.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
PLACES = _RANDOM.integers(0, 1 << 64, 16, np.uint64, endpoint=False) | np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    """1, b, b ** 2, ... modulo 2 ** 64."""
    out = np.full(n, _BASE)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _inverse() -> np.uint64:
    return np.uint64(pow(int(_BASE), -1, 1 << 64))


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes.

    Words are runs of bytes other than blanks, A to Z in lower case. A text of fewer words is
    one shingle; one without words has none.
    """
    parts = [t.encode("utf-8", "replace").lower() if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    blank = _BLANK[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank])))
    starts, ends = edges[::2], edges[1::2]
    # A word's hash: a polynomial over its bytes, from running sums, moved to its beginning.
    powers = _powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[data] * powers, dtype=np.uint64)])
    back = np.full(len(data), _inverse())
    back[:1] = 1
    back = np.multiply.accumulate(back)
    words = mixed((sums[ends] - sums[starts]) * back[starts])
    bounds = np.cumsum([0, *[len(p) + 1 for p in parts]])
    first = np.searchsorted(starts, bounds)
    count = max(0, len(words) - size + 1)
    joined = np.zeros(count, np.uint64)
    for k in range(size):
        joined += words[k : k + count] * PLACES[k]
    joined = mixed(joined)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1]))
        elif b > a:
            whole = (words[a:b] * PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mixed(whole + PLACES[size + b - a]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def class_of(own: np.ndarray) -> int:
    """A 64-bit number for the set: equal sets have the same, and others differ (but for a chance
    of 2 ** -64 for any two)."""
    h = mixed(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64, keepdims=True)
    h = mixed(h + np.array([len(own)], np.uint64) * _BASE)
    return int(h.astype(np.int64)[0])


def bands(most: int, ratio: float = BAND) -> np.ndarray:
    """Upper bounds of the size bands, up to one that holds ``most``."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array(out, np.int64)


def difference(a: np.ndarray, b: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    """The most shingles by which similar sets of these sizes can differ; below 0 if none are."""
    total = a + b
    shared = -(-similar * total // (100 + similar))
    return np.where(shared <= np.minimum(a, b), total - 2 * shared, -1)


def _most_difference(size: np.ndarray, upper: np.ndarray, similar: int) -> np.ndarray:
    """The same over all partners of a set within a band; sums of sizes matter, so the nine largest
    partners show the largest value."""
    largest = np.minimum(size * 100 // similar, upper)
    out = np.zeros(len(size), np.int64)
    for less in range(12):
        out = np.maximum(out, difference(size, np.maximum(largest - less, 1), similar))
    return out


def signatures(
    sets: list[np.ndarray], seed: int = 0, similar: int = SIMILAR, every: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set's place in the list, band, signature, how many are enough) of sets that are not empty.

    Those that are enough, or ``every`` one. Signatures of single shingles have a band below 0.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    nothing = np.empty(0, np.int64)
    if not len(sizes) or not sizes.max():
        return nothing, nothing, nothing.astype(np.uint64), nothing
    upper = bands(int(sizes.max()) * 100 // similar + 1)
    low = np.searchsorted(upper, sizes)
    high = np.searchsorted(upper, sizes * 100 // similar)
    elements = np.concatenate(sets)
    begin = np.cumsum(sizes) - sizes
    salt = mixed(np.array([seed], np.uint64))[0]
    found = []
    for step in range(int((high - low)[sizes > 0].max()) + 1):
        take = np.flatnonzero((low + step <= high) & (sizes > 0))
        band = low[take] + step
        own = sizes[take]
        owner = np.repeat(np.arange(len(take)), own)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(own) - own, own) + begin[take][owner]
        element = elements[at]
        parts = np.maximum(1, np.ceil(PARTS * upper[band])).astype(np.int64) + 1
        k = _most_difference(own, upper[band], similar)
        coded = mixed(element ^ salt)
        part = (coded % parts[owner].astype(np.uint64)).astype(np.int64)
        before = np.cumsum(parts) - parts
        place = before[owner] + part
        order = np.argsort(place, kind="stable")
        place = place[order]
        first = np.flatnonzero(np.diff(place, prepend=-1))
        held = np.diff(np.append(first, len(place)))
        content = np.add.reduceat(mixed(element[order] + salt), first)
        who = owner[order][first]
        number = (place[first] - before[who]).astype(np.uint64)
        tag = (band[who].astype(np.uint64) << np.uint64(32)) + number
        signature = mixed(content + mixed(tag + salt) * _BASE)
        found.append(_prefix(who, held, signature, k, take, band, every))
        # Too few parts are filled: single shingles are parts that cannot be too few.
        few = np.bincount(who, minlength=len(take)) <= k
        if few.any():
            use = few[owner]
            single = mixed(coded[use] + mixed(band[owner[use]].astype(np.uint64) + np.uint64(77)))
            one = np.ones(int(use.sum()), np.int64)
            found.append(_prefix(owner[use], one, single, k, take, -1 - band, every))
    return tuple(np.concatenate(x) for x in zip(*found))


def _prefix(who, held, signature, k, take, band, every):
    """The first k + 1 signatures of each set: many shingles first, then by value."""
    order = np.lexsort((signature, -held, who))
    who, signature = who[order], signature[order]
    if not every:
        first = np.flatnonzero(np.diff(who, prepend=-1))
        rank = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        keep = rank <= k[who]
        who, signature = who[keep], signature[keep]
    return take[who], band[who], signature, k[who] + 1


def _classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for i, j in slices(texts, PART):
            sets = shingle_sets(texts[i:j])
            columns = [
                batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "code", "n", "c"])


def _signature_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # classes this task has had: copies add nothing
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for i, j in slices(texts, PART):
            fresh, classes = [], []
            for own in shingle_sets(texts[i:j]):
                if len(own) and (c := class_of(own)) not in seen:
                    seen.add(c)
                    fresh.append(own)
                    classes.append(c)
            yield _rows(fresh, classes, 0)


def _rows(sets: list[np.ndarray], classes: list[int], seed: int) -> pa.RecordBatch:
    who, _, signature, _ = signatures(sets, seed)
    own, sizes = np.array(classes, np.int64), np.array([len(s) for s in sets], np.int64)
    columns = [
        pa.array(signature.astype(np.int64)), pa.array(own[who]), pa.array(sizes[who].astype(np.int32))
    ]
    return pa.RecordBatch.from_arrays(columns, names=["sig", "c", "n"])


_ROWS = "sig long, c long, n int"


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as bytes, and the same cut to 16 bits a shingle."""
    seen: set[int] = set()  # classes this task has had: copies add nothing
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for i, j in slices(texts, PART):
            sets, classes = [], []
            for own in shingle_sets(texts[i:j]):
                if len(own) and (c := class_of(own)) not in seen:
                    seen.add(c)
                    sets.append(own)
                    classes.append(c)
            columns = [
                pa.array(classes, pa.int64()),
                pa.array([s.tobytes() for s in sets], pa.binary()),
                pa.array([s.astype(np.uint16).tobytes() for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["c", "own", "brief"])


def enough(shared: int, a: int, b: int) -> bool:
    return 100 * shared >= SIMILAR * (a + b - shared)


def _likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets may be similar: cut shingles agree at least as often as whole ones."""
    there = np.zeros(1 << 16, bool)
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint16) for v in (x, y))
            if len(x) > len(y):
                x, y = y, x
            there[y] = True
            keep.append(enough(int(np.count_nonzero(there[x])), len(x), len(y)))
            there[y] = False
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(enough(shared, len(x), len(y)))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough: a cheap test that loses none, then
    the exact one on those that pass.

    ``sets`` is bucketed by class, so only pairs travel to the sets of ``b``. Those of ``a`` are cut
    down to the ones that are needed first: ``a`` may be a hub with very many pairs, and the two
    sides of that join are plain shuffles, of which a hub's rows are split.
    """

    def tested(pairs: DataFrame, column: str, test) -> DataFrame:
        of_b = sets.select(F.col("c").alias("b"), F.col(column).alias("y"))
        of_a = sets.select("c", column).join(pairs.select(F.col("a").alias("c")).distinct(), "c", "left_semi")
        of_a = of_a.select(F.col("c").alias("a"), F.col(column).alias("x"))
        both = pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "x", "y")
        return written(both.mapInArrow(test, "a long, b long"), "links")

    return tested(tested(pairs, "brief", _likely), "own", _exact)


@contextmanager
def _bucketed(sets: DataFrame) -> Iterator[DataFrame]:
    """The sets as a table in the shared folder, dealt into buckets by class and once each, while
    it is needed."""
    spark = sets.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_folder(spark, "sets")
    name = path.rpartition("/")[2].replace("-", "_")
    sets = sets.repartition(buckets, "c").dropDuplicates(["c"])
    sets.write.bucketBy(buckets, "c").sortBy("c").option("path", path).format("parquet").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"drop table {name}")


def _shared_by_two(rows: DataFrame, label: str) -> DataFrame:
    """(sig, c, n, size) where two or more classes have the signature, once for each class."""
    same = Window.partitionBy("sig")
    rows = rows.withColumns({"low": F.min("c").over(same), "high": F.max("c").over(same)})
    rows = rows.where("low <> high").groupBy("sig", "c").agg(F.min("n").alias("n"))
    return written(rows.withColumn("size", F.count(F.lit(1)).over(same)), label)


def _near_in_size(n: str, m: str) -> str:
    return f"100 * least({n}, {m}) >= {SIMILAR} * greatest({n}, {m})"


def _labelled(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups, "c", "left").withColumn("comp", F.coalesce("comp", "c"))


def _undecided(rows: DataFrame, by: str) -> DataFrame:
    """Rows of buckets whose members are in different components."""
    same = Window.partitionBy(by)
    rows = rows.withColumns({"low": F.min("comp").over(same), "high": F.max("comp").over(same)})
    return rows.where("low <> high").drop("low", "high")


def _search(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, comp) of all classes that similar pairs connect with others."""
    same = Window.partitionBy("sig")
    weight = written(members.groupBy("c").agg(F.sum("size").alias("weight")), "weights")
    led = members.join(weight, "c")
    led = led.withColumn("lead", F.max(F.struct("weight", "c", "n")).over(same))
    star = led.where("c <> lead.c").where(_near_in_size("n", "lead.n"))
    star = written(star.select(F.col("lead.c").alias("a"), F.col("c").alias("b")).distinct(), "star")
    links = _similar(star, sets)
    groups = components(links)

    open_ = written(_undecided(_labelled(members, groups), "sig"), "open")
    small = open_.where(F.col("size") < LARGE)
    left = small.select("sig", F.col("c").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("p"))
    right = small.select("sig", F.col("c").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("q"))
    pairs = left.join(right, "sig").where("a < b and p <> q").where(_near_in_size("n_a", "n_b"))
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    links, groups = _joined(links, _similar(written(pairs, "pairs"), sets), groups)

    large = _labelled(open_.where(F.col("size") >= LARGE).drop("comp"), groups)
    large = written(_undecided(large, "sig").select("c").distinct(), "large")
    if large.isEmpty():
        return groups
    again = _shared_by_two(_rarest(sets.join(large, "c", "left_semi")), "rare-members")
    return _joined(links, _clusters(again, groups, sets), groups)[1]


def _joined(links: DataFrame, more: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links and the components they make; those known, if there are no more links."""
    if more.isEmpty():
        return links, groups
    links = links.union(more)
    return links, components(links)


def _rarest(sets: DataFrame) -> DataFrame:
    """Signatures of these sets, as many as are enough of each, those that fewest sets have first."""

    def every(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = np.array(batch.column(0).to_pylist(), np.int64)
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
            who, band, signature, most = signatures(own, every=True)
            sizes = np.array([len(s) for s in own], np.int32)
            columns = [signature.astype(np.int64), classes[who], sizes[who], band, most]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=["sig", "c", "n", "band", "most"])

    rows = sets.select("c", "own").mapInArrow(every, _ROWS + ", band int, most int")
    rows = rows.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("sig")))
    first = F.row_number().over(Window.partitionBy("c", "band").orderBy("held", "sig"))
    return rows.withColumn("first", first).where("first <= most").select("sig", "c", "n")


def _clusters(members: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members that buckets connect but links do not, found block by block.

    A cluster is what undecided buckets connect. Each member outside its largest component is
    compared with all members; a task gets a block of the former and a block of the latter.
    """
    open_ = written(_undecided(_labelled(members, groups), "sig"), "open")
    first = F.min("c").over(Window.partitionBy("sig"))
    tied = written(open_.select(first.alias("a"), F.col("c").alias("b")).distinct(), "tied")
    clusters = components(tied).withColumnRenamed("comp", "cluster")
    rows = clusters.join(open_.select("c", "n", "comp").distinct(), "c")
    sizes = rows.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.groupBy("cluster").agg(
        F.max(F.struct("m", "comp"))["comp"].alias("largest"), F.sum("m").alias("all"),
        (F.sum("m") - F.max("m")).alias("rest"),
    )
    rows = written(rows.join(sizes, "cluster").join(sets.select("c", "own"), "c"), "clusters")
    across = F.ceil(F.col("all") / BLOCK).cast("int")
    down = F.ceil(F.col("rest") / BLOCK).cast("int")

    def dealt(rows: DataFrame, own: str, own_blocks, other: str, other_blocks) -> DataFrame:
        place = F.pmod(F.xxhash64("c"), own_blocks).cast("int").alias(own)
        copies = F.explode(F.sequence(F.lit(0), other_blocks - 1)).alias(other)
        rows = rows.select("cluster", "c", "comp", "largest", "own", place, copies)
        return rows.select("cluster", "i", "j", "c", "comp", "largest", "own")

    left = dealt(rows.where("comp <> largest"), "i", down, "j", across)
    right = dealt(rows, "j", across, "i", down)
    key = ["cluster", "i", "j"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        one, all_ = left.to_pylist(), right.to_pylist()
        found: list[tuple[int, int]] = []
        if one and all_:
            sets_ = [np.frombuffer(r["own"], np.uint64) for r in all_]
            sizes = np.array([len(s) for s in sets_])
            ends = np.cumsum(sizes)
            together = np.concatenate(sets_)
            for r in one:
                own = np.frombuffer(r["own"], np.uint64)
                at = np.minimum(np.searchsorted(own, together), len(own) - 1)
                hits = np.concatenate([[0], np.cumsum(own[at] == together)])
                shared = hits[ends] - hits[ends - sizes]
                near = 100 * shared >= SIMILAR * (len(own) + sizes - shared)
                found += [
                    (r["c"], all_[k]["c"]) for k in np.flatnonzero(near).tolist()
                    if all_[k]["comp"] != r["comp"]
                ]
        a, b = ([p[k] for p in found] for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    both = left.groupBy(*key).cogroup(right.groupBy(*key))
    return written(both.applyInArrow(compare, "a long, b long"), "links")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(c, comp): each end of an edge (a, b) with the smallest class it is connected with. ``edges``
    is read several times: give written tables.

    Large star, small star: rounds grow with the logarithm of a component's size. Each round is a
    written table, and none of it comes to the driver but whether edges are stars yet.
    """
    edges = edges.select("a", "b").where("a <> b")
    for _ in range(most_rounds):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Persisted, so that both sides of the join are plain shuffles and a hub's rows are split.
        least = least.persist()
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), "m")
        # Each node's smaller neighbours: no hub, as a hub is smaller than its neighbours.
        smallest = F.min("m").over(Window.partitionBy("u"))
        small = large.select("u", "m", smallest.alias("least"))
        small = small.select(
            F.explode(F.array(F.struct("m", "least"), F.struct(F.col("u").alias("m"), "least"))).alias("e")
        )
        new = small.select(F.col("e.m").alias("a"), F.col("e.least").alias("b"))
        edges = written(new.where("a <> b").distinct(), "edges")
        # Stars: no node has two edges to smaller ones, or one while it is the centre of others.
        one = F.lit(1)
        ends = edges.select(F.col("a").alias("x"), one.alias("up"), (one - 1).alias("down"))
        ends = ends.union(edges.select("b", one - 1, one))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        wrong = ends.where("up > 1 or up = 1 and down = 1").agg(F.count(one)).first()[0]
        least.unpersist()
        if not wrong:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("c"), F.col("b").alias("comp"))
    return written(roots.union(edges.select("b", "b").distinct()), "groups")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``.

    Two documents link when their sets of five-word shingles have a Jaccard similarity of 0.8 or
    more, exactly; ``component_id`` is the smallest id that links lead to, the own one included. Words
    are runs of characters other than blanks, A to Z in lower case. Fewer than five words are one
    shingle; a null text or one without words has none and links with nothing. Equal sets always
    link, so do repeated rows. Null ids are passed over in looking for the smallest. An empty table
    gives an empty table.
    """
    rows = row_groups(docs, id_col, text_col)
    rows = written(rows.select("doc_id", "n", "comp"), "in-components")
    least = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    least = written(least.where("least is not null"), "least-ids")
    return rows.join(least, "comp", "left").select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("least", "doc_id").alias("component_id"),
    )


def row_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``code`` (hash of the text), ``n`` shingles and ``comp``,
    a number of the component, null for a text without words. Read it once, or write it."""
    docs = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("code"), F.col(text_col).alias("text")
    )
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(_classes, f"doc_id {id_type}, code long, n long, c long")
    rows = written(rows, "classes")

    members = docs.select("text").mapInArrow(_signature_rows, _ROWS)
    members = _shared_by_two(members, "members")
    involved = rows.join(members.select("c").distinct(), "c", "left_semi")
    codes = involved.groupBy("c").agg(F.min("code").alias("code"))
    # Texts are read where they lie. Others that pass the filter have no pairs and are not looked at.
    texts = passing(docs, F.col("code"), key_filter(codes, "code")).select("text")
    sets = texts.mapInArrow(_sets, "c long, own binary, brief binary")
    with _bucketed(sets) as sets:
        groups = _search(members, sets)
    rows = rows.join(groups, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    return rows.select("doc_id", "code", "n", "comp")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
with recursive split as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents
), shingles as (
    select distinct doc_id, case when len(words) < 5 then array_to_string(words, ' ')
        else array_to_string(words[pos : pos + 4], ' ') end as shingle
    from (select *, unnest(range(1, greatest(len(words) - 3, 2))) as pos from split where len(words) > 0)
), sizes as (
    select s.doc_id, count(shingle) as n from split s left join shingles using (doc_id) group by s.doc_id
), pairs as (
    select a.doc_id as x, b.doc_id as y, count(*) as shared
    from shingles a join shingles b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2
), links as (
    select p.x, p.y from pairs p join sizes a on a.doc_id = p.x join sizes b on b.doc_id = p.y
    where 100 * p.shared >= 80 * (a.n + b.n - p.shared)
), reached as (
    select doc_id, doc_id as other from split
    union
    select r.doc_id, l.y from reached r join links l on l.x = r.other
)
select s.doc_id, s.n as n_shingles, min(r.other) as component_id
from sizes s join reached r using (doc_id) group by s.doc_id, s.n
"""
