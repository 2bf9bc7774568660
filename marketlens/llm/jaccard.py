"""N-gram Jaccard join by vertical partitioning of a global n-gram order.

Texts become sets of 64-bit n-gram hashes; texts with equal sets form one class (128-bit
digest). The global order goes from rare n-grams to common ones, by a count sketch of fixed
size and then by hash; any order is exact, this one keeps common passages out of the way.

The order is cut into fragments. The first one of each set, its prefix, must meet the prefix
of every set similar enough; sets that share a prefix n-gram form a bucket. The pairs of a small
bucket are listed as it streams by. Partial overlaps are counted per fragment and pair, and
summed per pair; pairs whose overlap in the prefixes rules out the threshold are not counted.

A crowded bucket is not paired off: its classes are compared with hubs, the members with the
most links so far, and with a few others, and components of the links found are merged. What is
left apart meets block by block, by maps of bits that bound what a pair can share; only pairs
whose components differ and whose maps leave enough are listed. So no link between components
is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Words, discard, gram_hashes, materialise, mix64, released, signed, slices, small
from .components import components

CELLS = 1 << 20
BLOCK = 1 << 14
FRAGMENTS = 4
# Bytes of text whose n-grams are made at once: a task holds about a hundred times as many.
SLICE = 1 << 17
CROWD = 64
CROWD_ROUNDS = 2
# Hubs a class of a crowded bucket is compared with in one round.
HUBS = 4
# Classes of a crowded bucket that meet as many others in one task.
CROWD_BLOCK = 1 << 12
# Classes whose texts are looked up by a broadcast of their ids; beyond, by a join.
LOOKUP_ROWS = 300_000
# Bits of the map that bounds what two classes of a crowded bucket can share, before their sets are moved.
BITS = 1 << 10


def gram_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its n-grams of lower-cased words; a text with
    fewer words is one n-gram; null and wordless texts give an empty array."""
    words = Words(column, lower=True)
    hashes = words.hashes()
    grams = gram_hashes(hashes, n)
    for r in range(len(column)):
        low, high = words.first[r], words.first[r + 1]
        if high - low >= n:
            yield np.unique(grams[low : high - n + 1])
        elif high > low:
            yield gram_hashes(hashes[low:high], high - low, seed=int(high - low))
        else:
            yield np.empty(0, np.uint64)


def digest(grams: np.ndarray) -> bytes:
    """128 bits that name a set, from two sums of mixed members and its size."""
    a = mix64(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mix64(grams ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return mix64(np.array([a + np.uint64(len(grams)), b], np.uint64)).tobytes()


def _sets_and_counts(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        names = ["doc_id", "version", "n", "class", "block", "counts"]
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sizes, classes = [], []
                for grams in gram_sets(part.column("text"), n):
                    np.add.at(cells, (grams >> np.uint64(44)).astype(np.int64), 1)
                    sizes.append(len(grams))
                    classes.append(digest(grams) if len(grams) else None)
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("version"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                    names=names,
                )
        filled = [b for b in range(CELLS // BLOCK) if cells[b * BLOCK : (b + 1) * BLOCK].any()]
        if filled:
            count = len(filled)
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(count, pa.int64())] * 3, pa.nulls(count, pa.binary()), pa.array(filled, pa.int32()),
                 pa.array([cells[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in filled], pa.binary())],
                names=names,
            )

    return released(run)


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            at = sums.setdefault(block, np.zeros(BLOCK, np.int64))
            at += np.frombuffer(counts.as_buffer(), np.uint32)
    if sums:
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary())})


def _sketch(counted: DataFrame) -> np.ndarray:
    """Summed cells: a table of fixed size, so it may come to the driver."""
    blocks = counted.where("block is not null").select("block", "counts").repartition(CELLS // BLOCK // 4, "block")
    out = np.zeros(CELLS, np.int64)
    for row in blocks.mapInArrow(_sum_blocks, "block int, counts binary").toLocalIterator():
        out[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.counts, np.int64)
    return out


def _order(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells, and the counts at which one fragment of the order ends and the next begins."""
    order = np.sort(counts[counts > 0])
    total = np.cumsum(order)
    bounds = order[np.searchsorted(total, [total[-1] * k // FRAGMENTS for k in range(1, FRAGMENTS)])] if len(order) else np.empty(0)
    return np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32), bounds


def _prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _prefixes(n: int, percent: int, cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (counts, _), seen = cells.value, set()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                keys, names, sizes, places = [], [], [], []
                for grams in gram_sets(part.column("text"), n):
                    if not len(grams) or (name := digest(grams)) in seen:
                        continue
                    seen.add(name)
                    order = np.lexsort((grams, counts[(grams >> np.uint64(44)).astype(np.int64)]))
                    head = grams[order[: _prefix_length(len(grams), percent)]]
                    keys.append(head)
                    names += [name] * len(head)
                    sizes.append(np.full(len(head), len(grams)))
                    places.append(np.arange(len(head)))
                if keys:
                    yield pa.RecordBatch.from_pydict(
                        {"gram": pa.array(signed(np.concatenate(keys))), "class": pa.array(names, pa.binary()),
                         "n": pa.array(np.concatenate(sizes), pa.int32()), "place": pa.array(np.concatenate(places), pa.int32())}
                    )

    return run


def _needed(na, nb, percent: int):
    """Least overlap of two similar sets of these sizes."""
    return -(-percent * (na + nb) // (100 + percent))


class _Run:
    """Rows of a batch sorted by n-gram and class: numbers by numpy, class names as pairs of 64-bit words."""

    def __init__(self, gram, name, n, place):
        self.gram, self.name, self.n, self.place = gram, name, n, place

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> _Run:
        column = batch.column("class")
        raw = np.frombuffer(column.buffers()[2], np.uint8)[16 * column.offset : 16 * (column.offset + len(column))]
        return cls(batch.column("gram").to_numpy(), raw.view(np.uint64).reshape(-1, 2), batch.column("n").to_numpy(), batch.column("place").to_numpy())

    def __len__(self) -> int:
        return len(self.gram)

    def take(self, which) -> _Run:
        return _Run(self.gram[which], self.name[which], self.n[which], self.place[which])

    def after(self, other: _Run | None) -> _Run:
        if other is None:
            return self
        return _Run(*(np.concatenate([getattr(other, f), getattr(self, f)]) for f in ("gram", "name", "n", "place")))

    def single(self) -> _Run:
        """One row of each n-gram and class."""
        keep = np.ones(len(self), bool)
        keep[1:] = (self.gram[1:] != self.gram[:-1]) | (self.name[1:] != self.name[:-1]).any(axis=1)
        return self.take(keep)


_MET = "gram long, a binary, b binary, na int, nb int, place int, near boolean"


def _names(name: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(name), [None, pa.py_buffer(np.ascontiguousarray(name).tobytes())]).cast(pa.binary())


def _members(rows: _Run) -> pa.RecordBatch:
    none = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(rows.gram), _names(rows.name), pa.nulls(none, pa.binary()), pa.array(rows.n, pa.int32()), pa.nulls(none, pa.int32()), pa.array(rows.place, pa.int32()), pa.nulls(none, pa.bool_())],
        names=["gram", "a", "b", "na", "nb", "place", "near"],
    )


def _pairs(rows: _Run, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of one n-gram whose sizes fit, and whether they may first meet there."""
    for step in range(1, CROWD):
        i = np.flatnonzero(rows.gram[step:] == rows.gram[:-step])
        if not len(i):
            return
        x, y = rows.take(i), rows.take(i + step)
        fit = 100 * np.minimum(x.n, y.n).astype(np.int64) >= percent * np.maximum(x.n, y.n).astype(np.int64)
        x, y = x.take(fit), y.take(fit)
        if len(x):
            near = 1 + np.minimum(x.n - x.place - 1, y.n - y.place - 1) >= _needed(x.n.astype(np.int64), y.n.astype(np.int64), percent)
            none = len(x)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(none, pa.int64()), _names(x.name), _names(y.name), pa.array(x.n, pa.int32()), pa.array(y.n, pa.int32()), pa.nulls(none, pa.int32()), pa.array(near)],
                names=["gram", "a", "b", "na", "nb", "place", "near"],
            )


def _buckets(percent: int):
    """From rows sorted by n-gram and class: the pairs of buckets of at most CROWD classes (b is set),
    the rows of larger ones (b is null). At most CROWD rows are held over between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, crowded = None, None, None

        def handed(rows: _Run, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
            # the bucket that was crowded before stays so
            crowd = (np.repeat(sizes, sizes) > CROWD) | (rows.gram == crowded if crowded is not None else False)
            if crowd.any():
                yield _members(rows.take(crowd))
            few = rows.take(~crowd & (np.repeat(sizes, sizes) > 1))
            if len(few):
                yield from _pairs(few, percent)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Run.read(batch).after(held).single()
            if last is not None and held is None and rows.gram[0] == last.gram[0] and (rows.name[0] == last.name[0]).all():
                rows = rows.take(slice(1, None))
                if not len(rows):
                    continue
            starts = np.flatnonzero(np.concatenate([[True], rows.gram[1:] != rows.gram[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(rows)]]))
            last = rows.take(slice(-1, None))
            open_bucket = last.gram[0] != crowded and sizes[-1] <= CROWD
            held = rows.take(slice(starts[-1], None)) if open_bucket else None
            if open_bucket:
                rows, sizes = rows.take(slice(0, starts[-1])), sizes[:-1]
            yield from handed(rows, sizes)
            crowded = None if open_bucket else last.gram[0]
        if held is not None:
            yield from handed(held, np.array([len(held)]))

    return run


def _fragments(n: int, cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, bounds = cells.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows = []
                for name, grams in zip(part.column("class").to_pylist(), gram_sets(part.column("text"), n), strict=True):
                    if len(grams) and digest(grams) == name:
                        where = np.searchsorted(bounds, counts[(grams >> np.uint64(44)).astype(np.int64)])
                        rows += [(name, f, grams[where == f].tobytes()) for f in range(FRAGMENTS) if (where == f).any()]
                if rows:
                    a, b, c = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_pydict({"class": pa.array(a, pa.binary()), "fragment": pa.array(b, pa.int32()), "grams": pa.array(c, pa.binary())})

    return run


def _bit_maps(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                maps = np.zeros((part.num_rows, BITS), bool)
                for row, grams in enumerate(gram_sets(part.column("text"), n)):
                    maps[row, (grams % np.uint64(BITS)).astype(np.int64)] = True
                words = np.packbits(maps, axis=1).view(np.int64)
                ends = pa.array(np.arange(len(words) + 1) * words.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("class"), pa.ListArray.from_arrays(ends, pa.array(words.ravel())), pa.array(maps.sum(axis=1), pa.int32())], names=["class", "bits", "filled"]
                )

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [
            len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True))
            for x, y in zip(batch.column("grams_a"), batch.column("grams_b"), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", "na", "nb", "fragment")] + [pa.array(both, pa.int64())], names=["a", "b", "na", "nb", "fragment", "overlap"])


def similar_enough(overlap: Column, na: Column, nb: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (na + nb - overlap)


def _listed(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        """Pairs of two blocks of a bucket, of different components, that may share enough.

        Beyond the bits two maps share, at most as many n-grams can be common as share a bit with another
        one of their set; and at most those from this n-gram on, as a pair is listed in the first it shares.
        """
        low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
        n, place, filled, block = (rows[c].to_numpy().astype(np.int64) for c in ("n", "place", "filled", "block"))
        label = rows["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        bits = np.unpackbits(rows["bits"].combine_chunks().flatten().to_numpy().view(np.uint8).reshape(len(n), -1), axis=1).astype(np.float32)
        one, two = np.flatnonzero(block == low), np.flatnonzero(block == high)
        found = []
        for at in range(0, len(one), 256):
            x = one[at : at + 256]
            least = lambda v: np.minimum(v[x][:, None], v[two])
            need = _needed(n[x][:, None], n[two], percent)
            near = (bits[x] @ bits[two].T + least(n - filled) >= need) & (least(n - place) >= need) & (label[x][:, None] != label[two])
            if low == high:
                near &= x[:, None] < two
            i, j = np.nonzero(near)
            found.append(np.stack([x[i], two[j]]))
        i, j = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        names = rows["class"].to_pylist()
        swap = np.array([names[x] > names[y] for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        column = lambda which: pa.array([names[k] for k in which.tolist()], pa.binary())
        return pa.table({"a": column(i), "b": column(j), "na": pa.array(n[i], pa.int32()), "nb": pa.array(n[j], pa.int32())})

    return run


def _texts_of(names: DataFrame, texts: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written ids of one document for each of the named classes, and (class, text) of these."""
    needed = materialise(names.join(classes, "class").select("class", F.col("doc_id").alias("d"), F.col("version").alias("v")), "jaccard-needed")
    wanted = small(needed, LOOKUP_ROWS)
    met = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["d"]) & (texts["version"] == wanted["v"]))
    return needed, met.select("class", "text")


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, n: int, percent: int, cells) -> DataFrame:
    """The written pairs(a, b, na, nb) that reach the threshold: overlaps per fragment, summed per pair.

    Only the sets of classes in the pairs are made, from one document each, and moved; one of
    them travels with each pair.
    """
    names = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    needed, met = _texts_of(names, texts, classes)
    fragments = materialise(met.mapInArrow(_fragments(n, cells), "class binary, fragment int, grams binary"), "jaccard-fragments")
    one, two = (fragments.select(F.col("class").alias(x), "fragment", F.col("grams").alias(f"grams_{x}")) for x in ("a", "b"))
    partial = pairs.join(one, "a").join(two, ["b", "fragment"]).select("a", "b", "na", "nb", "fragment", "grams_a", "grams_b")
    counted = partial.mapInArrow(_overlaps, "a binary, b binary, na int, nb int, fragment int, overlap long")
    # a fragment counts once, also where a repeated row gave it twice
    overlap = [F.coalesce(F.max(F.when(F.col("fragment") == f, F.col("overlap"))), F.lit(0)) for f in range(FRAGMENTS)]
    summed = counted.groupBy("a", "b", "na", "nb").agg(reduce(lambda x, y: x + y, overlap).alias("overlap"))
    links = materialise(summed.where(similar_enough(F.col("overlap"), F.col("na"), F.col("nb"), percent)).select("a", "b"), "jaccard-links")
    for done in (needed, fragments, pairs):
        discard(done)
    return links


def _can_reach(met: Column, percent: int) -> Column:
    """Whether sets whose prefixes overlap in ``met`` can be similar: beyond the shorter-reaching prefix
    at most the rest of its set can be shared."""
    rest = F.greatest(*[F.ceil(F.lit(percent) * F.col(c) / 100) - 1 for c in ("na", "nb")])
    return met + rest >= F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))


def _lengths_fit(na: str, nb: str, percent: int) -> Column:
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def _ordered(x: str, y: str) -> list[Column]:
    """Columns a, b, na, nb of a pair of structs (class, n), the smaller name first."""
    first = F.col(f"{x}.class") < F.col(f"{y}.class")
    pick = lambda field, here, there: F.when(first, F.col(f"{here}.{field}")).otherwise(F.col(f"{there}.{field}"))
    return [pick("class", x, y).alias("a"), pick("class", y, x).alias("b"), pick("n", x, y).alias("na"), pick("n", y, x).alias("nb")]


def _crowds(rows: DataFrame) -> DataFrame:
    """Written rows of crowded buckets: n-gram and place, class and size, and in how many such buckets the class is."""
    lists = rows.groupBy("class", "n").agg(F.collect_list(F.struct("gram", "place")).alias("grams"))
    return materialise(lists.select("class", "n", F.size("grams").alias("met_in"), F.explode("grams").alias("g")).select("class", "n", "met_in", "g.gram", "g.place"), "jaccard-crowds")


def _mixed(crowds: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of crowded buckets in which more than one component is left, with components and degrees."""
    ends = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("degree"))
    known = components(links).select(F.col("node").alias("class"), "label").join(ends, "class")
    marked = crowds.join(known, "class", "left").withColumns({"label": F.coalesce("label", "class"), "degree": F.coalesce("degree", F.lit(0))})
    mixed = marked.groupBy("gram").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    return materialise(marked.join(mixed.select("gram"), "gram", "left_semi"), "jaccard-mixed")


def _tries(mixed: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs worth a look: each class with the hubs of its buckets that most of them name, and with two others.

    A hub has the most links of its bucket; at first, the least of its own, which is the most in common.
    """
    me = F.struct("class", "n", "label")
    worth = F.struct("degree" if turn else F.col("met_in") - F.ceil(F.col("n") * (100 - percent) / 100), F.xxhash64("class", F.lit(turn)))
    hubs = mixed.groupBy("gram").agg(F.max_by(me, worth).alias("y"))
    shuffled = Window.partitionBy("gram").orderBy(F.xxhash64("class", "gram", F.lit(turn)))
    found = []
    for pairs, keep in (
        (mixed.select("gram", me.alias("x")).join(hubs, "gram"), HUBS),
        (mixed.select(me.alias("x"), F.lag(me).over(shuffled).alias("y")), 2),
    ):
        votes = pairs.where((F.col("x.label") != F.col("y.label")) & _lengths_fit("x.n", "y.n", percent)).groupBy("x", "y").agg(F.count("*").alias("votes"))
        best = Window.partitionBy("x.class").orderBy(F.col("votes").desc(), F.xxhash64("x.class", "y.class"))
        found.append(votes.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep).select(*_ordered("x", "y")))
    return found[0].unionByName(found[1]).distinct()


def _crowd_links(crowds: DataFrame, links: DataFrame, verify, bit_maps, percent: int) -> DataFrame:
    """Links that join the components left apart in crowded buckets.

    Classes still apart meet in blocks of their buckets, and only pairs whose bit maps leave enough in
    common have their sets compared.
    """

    mixed = _mixed(crowds, links)
    for turn in range(CROWD_ROUNDS):
        if mixed.isEmpty():
            return links
        links = materialise(links.unionByName(verify(materialise(_tries(mixed, turn, percent), "jaccard-pairs"))), "jaccard-links")
        discard(mixed)
        mixed = _mixed(crowds, links)

    maps = bit_maps(mixed.select("class").distinct())
    parts = mixed.groupBy("gram").agg(F.ceil(F.count("*") / CROWD_BLOCK).cast("int").alias("parts"))
    dealt = mixed.join(small(maps), "class").join(parts, "gram").withColumn("block", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    both = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    met = both.select("gram", "low", "high", "block", "class", "n", "place", "label", "bits", "filled").groupBy("gram", "low", "high")
    listed = met.applyInArrow(_listed(percent), "a binary, b binary, na int, nb int")
    links = materialise(links.unionByName(verify(materialise(listed.distinct(), "jaccard-pairs"))), "jaccard-links")
    for done in (mixed, maps):
        discard(done)
    return links


def _class_links(documents: DataFrame, classes: DataFrame, n: int, percent: int, cells) -> DataFrame:
    """Links (a, b) between classes that join everything the similarity joins."""
    texts = documents.select("doc_id", "version", "text")

    def verify(pairs: DataFrame) -> DataFrame:
        return _verified(pairs, texts, classes, n, percent, cells)

    def bit_maps(names: DataFrame) -> DataFrame:
        needed, met = _texts_of(names, texts, classes)
        # a repeated row gives its class twice
        maps = materialise(met.mapInArrow(_bit_maps(n), "class binary, bits array<long>, filled int").dropDuplicates(["class"]), "jaccard-bits")
        discard(needed)
        return maps

    buckets = materialise(
        texts.select("text").mapInArrow(_prefixes(n, percent, cells), "gram long, class binary, n int, place int")
        .repartition(F.col("gram")).sortWithinPartitions("gram", "class")
        .mapInArrow(_buckets(percent), _MET),
        "jaccard-buckets",
    )
    small_met = materialise(
        buckets.where("b is not null").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("met"), F.max("near").alias("near")).where("near"), "jaccard-met"
    )
    rows = buckets.where("b is null").select(F.col("a").alias("class"), F.col("na").alias("n"), "gram", "place")
    crowds = _crowds(rows)
    more = materialise(crowds.groupBy("class").agg(F.count("*").alias("more")), "jaccard-crowd-sizes")
    sizes = [small(more.select(F.col("class").alias(c), F.col("more").alias(f"more_{c}"))) for c in ("a", "b")]
    both = F.least(*[F.coalesce(f"more_{c}", F.lit(0)) for c in ("a", "b")])
    # a pair first met in a crowded bucket is listed there
    likely = small_met.join(sizes[0], "a", "left").join(sizes[1], "b", "left").where(_can_reach(F.col("met") + both, percent))
    links = verify(materialise(likely.select("a", "b", "na", "nb"), "jaccard-pairs"))
    discard(buckets)
    links = _crowd_links(crowds, links, verify, bit_maps, percent)
    for done in (small_met, crowds, more):
        discard(done)
    return links


def grouped(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, version, n, label): the group of every document, null for texts without words.

    ``version`` is a hash of the text and tells rows with one id apart.
    """
    chosen = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("version", F.xxhash64("text"))
    counted = materialise(
        chosen.mapInArrow(_sets_and_counts(n), "doc_id long, version long, n long, class binary, block int, counts binary"), "jaccard-sets"
    )
    cells = documents.sparkSession.sparkContext.broadcast(_order(_sketch(counted)))
    members = counted.where("block is null").select("doc_id", "version", "n", "class")
    # one document of each class, with an id if there is one
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version")).alias("first")
    classes = materialise(members.where("class is not null").groupBy("class").agg(first).select("class", "first.doc_id", "first.version"), "jaccard-classes")
    labels = components(_class_links(chosen, classes, n, percent, cells)).withColumnRenamed("node", "class")
    return members.join(labels, "class", "left").select("doc_id", "version", "n", F.coalesce("label", "class").alias("label"))


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document.

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` of their n-gram sets;
    component_id is the least doc_id that links lead to. Texts that are null or without words
    have no n-grams and stand alone. Repeated rows are documents of their own; documents
    without an id link but lend no id.
    """
    members = materialise(grouped(documents, doc_id, text, n, percent), "jaccard-groups")
    least = members.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return members.join(least, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_per_group(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, less all but the least id of every group; rows without an id go first.

    Documents without words stay; of rows equal in id and text one stays.
    """
    members = materialise(grouped(documents, doc_id, text, n, percent), "jaccard-groups")
    kept = (
        members.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version")).alias("k")).select("k.doc_id", "k.version")
        .unionByName(members.where("label is null").select("doc_id", "version").distinct())
    )
    keyed = documents.select(
        F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("v")
    )
    met = keyed.join(kept, keyed["d"].eqNullSafe(kept["doc_id"]) & (keyed["v"] == kept["version"]), "left_semi")
    return met.dropDuplicates(["d", "v"]).select("row.*")
