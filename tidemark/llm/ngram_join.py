"""Jaccard self-join on word n-grams by a grouped prefix join (operator 7).

Shingles are ordered: frequent ones last, then by hash. If two sets reach the threshold, their prefixes in this order share
a shingle. Documents with equal sets are one class; classes with equal prefix and size are one group. Groups meet in the
lists of their prefix shingles, are filtered by size, place and a bound from bit masks, and only pairs that are left are
expanded to classes, filtered by the classes' own masks and verified on whole sets.

Only classes that are not yet known to be linked are ever paired. Star rounds verify each class against one hub of its
lists, the nearest by the masks, while many pairs are left; a last round takes all pairs that are left between components.
So a large group of near copies costs a few pairs each, and no link between components is missed.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import components, written
from tidemark.llm._text import mix, shingles, slices, string_column

BITS = 512  # of a class's mask; bit = parity of the shingles that fall on it
WORDS = BITS // 64
LONG_SET, LONG_BITS = 500, 16_384  # larger sets are first compared by masks of so many bits
FREQUENT, MOST_FREQUENT = 64, 100_000  # shingles of so many documents go last in the order; the order's table is bounded, not the work
ROUNDS, HUBS = 6, 4  # further star rounds at most, and the hubs of a list in each
DENSE, SAMPLE = 4, 32  # a further round is run while the pairs left, estimated from one class in SAMPLE, are over DENSE a class
SMALL_IDS = 500_000  # up to so many ids (some 20 MB) are sent to all executors to pick texts, which then need no shuffle; beyond, Spark joins


def prefix_length(n, num: int, den: int):
    """Shingles of a set of size n that a partner must share one of: n - ceil(n * num / den) + 1."""
    return n + (-n * num // den) + 1


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, end, data, offsets in slices(string_column(batch, "text")):
        yield first, end, *shingles(data, offsets, size)


def _common_low(size: int, num: int, den: int):
    """Counts of the shingles in the low part of the hash space, which holds about all prefix shingles."""
    limit = np.uint64(min(2**64 - 1, int(2**64 * min(1.0, 1.25 * (1 - num / den)))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, grams, _ in _sets(batch, size):
                low, n = np.unique(grams[grams < limit], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(n.astype(np.int32))], names=["gram", "n"])

    return work


def _features(size: int, num: int, den: int, frequent):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for first, end, grams, bounds in _sets(batch, size):
                n = np.diff(bounds)
                owner = np.repeat(np.arange(len(n)), n)
                late = np.zeros(len(grams), bool)
                if len(last) and len(grams):
                    at = np.minimum(np.searchsorted(last, grams), len(last) - 1)
                    late = last[at] == grams
                order = np.argsort(owner * 2 + late, kind="stable")  # within a text: rare by hash, then frequent by hash
                place = np.arange(len(grams)) - bounds[owner]
                want = np.where(n > 0, prefix_length(n, num, den), 0)
                prefix = grams[order][place < want[owner]]
                with np.errstate(over="ignore"):
                    sums = [np.add.reduceat(np.append(mix(grams + np.uint64(salt)), np.uint64(0)), np.minimum(bounds[:-1], len(grams))) for salt in (1, 2)]
                bit = owner * BITS + (mix(grams ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(BITS - 1)).astype(np.int64)
                parity = (np.bincount(bit, minlength=len(n) * BITS) & 1).astype(np.uint8)
                masks = np.packbits(parity.reshape(-1, 64), axis=1).view(">i8").astype(np.int64).reshape(len(n), WORDS)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(want)]).astype(np.int32)), pa.array(prefix.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, end - first), pa.array(n.astype(np.int64)), *(pa.array(np.where(n > 0, s, np.uint64(0)).view(np.int64)) for s in sums), lists,
                     *(pa.array(masks[:, i]) for i in range(WORDS))],
                    names=["doc_id", "n", "h1", "h2", "prefix", *(f"m{i}" for i in range(WORDS))],
                )

    return work


def _whole(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for first, end, grams, bounds in _sets(batch, size):
                n = np.diff(bounds)
                sums = np.add.reduceat(np.append(mix(grams + np.uint64(1)), np.uint64(0)), np.minimum(bounds[:-1], len(grams)))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(first, end - first), pa.array(np.where(n > 0, sums, np.uint64(0)).view(np.int64)), lists], names=["id", "h1", "grams"])

    return work


def _long_masks(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for first, end, grams, bounds in _sets(batch, size):
                n = np.diff(bounds)
                sums = np.add.reduceat(np.append(mix(grams + np.uint64(1)), np.uint64(0)), np.minimum(bounds[:-1], len(grams)))
                bits = (mix(grams ^ np.uint64(0xD6E8FEB86659FD93)) & np.uint64(LONG_BITS - 1)).astype(np.int64)
                masks = [np.packbits((np.bincount(bits[a:b], minlength=LONG_BITS) & 1).astype(np.uint8)).view(np.int64) for a, b in zip(bounds, bounds[1:], strict=False)]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(masks)), LONG_BITS // 64).cast(pa.list_(pa.int64()))
                h1 = pa.array(np.where(n > 0, sums, np.uint64(0)).view(np.int64))
                yield pa.RecordBatch.from_arrays([ids.slice(first, end - first), h1, pa.array(n.astype(np.int64)), lists], names=["id", "h1", "n", "mask"])

    return work


def _needed(a: Column, b: Column, num: int, den: int) -> Column:
    """Least intersection of sets of sizes a and b that reach num / den."""
    return F.floor(((a + b) * num + (num + den - 1)) / (num + den)).cast("long")


def _sizes_fit(a: Column, b: Column, num: int, den: int) -> Column:
    return (F.least(a, b) * den >= F.greatest(a, b) * num)


def _apart(x: str, y: str) -> Column:
    """Lower bound of the symmetric difference of two classes: bits in which their masks differ."""
    return reduce(operator.add, (F.bit_count(F.col(f"{x}.m{i}").bitwiseXOR(F.col(f"{y}.m{i}"))) for i in range(WORDS)))


def _group_apart(x: str, y: str) -> Column:
    """The same for groups: bits that all classes of one have and all of the other lack."""
    parts = []
    for i in range(WORDS):
        xa, xo, ya, yo = (F.col(f"{s}.{k}{i}") for s in (x, y) for k in "ao")
        parts.append(F.bit_count(xa.bitwiseAND(F.bitwise_not(yo)).bitwiseOR(ya.bitwiseAND(F.bitwise_not(xo)))))
    return reduce(operator.add, parts)


def within(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``keys`` (one column, distinct): a small list goes to all executors, a larger one is joined by Spark."""
    keys = keys.select(F.col(keys.columns[0]).alias("__key"))
    return df.join(F.broadcast(keys) if keys.count() <= SMALL_IDS else keys, F.col(column) == F.col("__key"), "left_semi")


def _long_near(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs of large sets that masks of ``LONG_BITS`` bits allow: 2 KB a set in place of the whole set for those that don't."""
    def masks(side: str, mark: str, name: str) -> DataFrame:
        ids = written(pairs.select(F.col(side).alias("id")).distinct(), "ngram")
        made = within(docs, "doc_id", ids).select("doc_id", "text").mapInArrow(_long_masks(size), "id long, h1 long, n long, mask array<long>")
        return made.select(F.col("id").alias(side), F.col("h1").alias(mark), F.struct("n", "mask").alias(name)).dropDuplicates([side, mark])

    both = pairs.join(masks("da", "ha", "x"), ["da", "ha"]).join(masks("db", "hb", "y"), ["db", "hb"])
    apart = F.aggregate(F.zip_with("x.mask", "y.mask", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)
    n = F.col("x.n") + F.col("y.n")
    return both.where(apart <= n - 2 * _needed(F.col("x.n"), F.col("y.n"), num, den)).select(*pairs.columns)


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of class ids whose sets reach the threshold, written; sets are made anew from the texts of these classes only.

    Hubs are few: their sets come last, so what is shuffled by hub is wide and a hot hub's share is split.
    """
    marks = classes.select("id", "doc", "h1", "n")
    keyed = pairs.join(marks.withColumnsRenamed({"id": "a", "doc": "da", "h1": "ha", "n": "na"}), "a").join(marks.select(F.col("id").alias("b"), F.col("doc").alias("db"), F.col("h1").alias("hb")), "b")
    keyed = keyed.select("a", "da", "ha", "b", "db", "hb", (F.coalesce("na", F.lit(0)) > LONG_SET).alias("long"))
    keyed = written(keyed, "ngram")
    large = keyed.where("long")
    if not large.isEmpty():
        keyed = written(keyed.where("not long").unionByName(_long_near(large, docs, size, num, den)), "ngram")

    def sets(side: str, mark: str, name: str) -> DataFrame:
        ids = written(keyed.select(F.col(side).alias("id")).distinct(), "ngram")
        made = within(docs, "doc_id", ids).select("doc_id", "text").mapInArrow(_whole(size), "id long, h1 long, grams array<long>")
        return made.select(F.col("id").alias(side), F.col("h1").alias(mark), F.col("grams").alias(name))  # an id may have several texts: h1 picks

    both = keyed.join(sets("da", "ha", "x"), ["da", "ha"]).join(sets("db", "hb", "y"), ["db", "hb"])
    same = F.size(F.array_intersect("x", "y")).cast("long")
    return written(both.where(same * den >= num * (F.size("x") + F.size("y") - same)).select("a", "b").distinct(), "ngram")


def ngram_jaccard(df: DataFrame, *, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``df`` (doc_id, text); Jaccard of at least num / den links two rows.

    Words: runs of other than ASCII white space, A-Z lower-cased. A set: the distinct shingles of ``size`` words; fewer words
    make one shingle, no words an empty set, which links with nothing. component_id: smallest doc_id reachable. Null text
    is empty. Rows with null doc_id join their equal set's class but are no links of their own (component_id null if no
    named row has this set). Rows with equal doc_id are one node: each of their sets links, and they share a component. Whole
    texts; extra columns are left out.
    """
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    low = docs.select("text").mapInArrow(_common_low(size, num, den), "gram long, n int")
    top = low.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "gram").limit(MOST_FREQUENT).select("gram").toArrow()
    frequent = spark.sparkContext.broadcast(np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64)))  # at most MOST_FREQUENT words of 8 bytes
    masks = [f"m{i}" for i in range(WORDS)]
    schema = "doc_id long, n long, h1 long, h2 long, prefix array<long>, " + ", ".join(f"{m} long" for m in masks)
    rows = written(docs.mapInArrow(_features(size, num, den, frequent), schema), "ngram")
    named, ids = rows.where("doc_id is not null").agg(F.count("*"), F.count_distinct("doc_id")).first()
    if named != ids:  # repeated rows: sets are made from each text of an id once
        docs = written(docs.where("doc_id is not null").distinct(), "ngram")
    classes, groups, wide, repeated = _classes(rows)

    # lists of two groups or more; the first shingle of a group of several classes stays in any case, so that its own pairs meet there
    posted = wide.select(F.col("doc_id").alias("g"), "prefix").join(groups.select("g"), "g", "left_semi").select("g", F.posexplode("prefix").alias("place", "gram"))
    several = groups.where("members > 1").select("g")
    firsts = posted.where("place = 0").join(several, "g", "left_semi").select("gram")
    shared = posted.groupBy("gram").agg(F.count("*").alias("groups")).where("groups > 1").select("gram")
    lists = written(shared.unionByName(firsts).distinct(), "ngram")
    posted = written(posted.join(lists, "gram", "left_semi"), "ngram")
    of = classes.join(groups.select("n", "p1", "p2", "g", "members"), ["n", "p1", "p2"]).select("g", "id", "members")
    of = written(of.join(wide.select(F.col("doc_id").alias("id"), "n", *masks), "id"), "ngram")

    # first round: a class against its group's first class, a group's first class against the first group of its lists
    hub = posted.groupBy("gram").agg(F.min("g").alias("hub"))
    own = of.where("members > 1 and id <> g").select("id", F.col("g").alias("hub"))
    stars = own.unionByName(posted.drop("place").join(hub, "gram").where("hub <> g").groupBy(F.col("g").alias("id")).agg(F.min("hub").alias("hub")))
    links = _verified(_nearest(stars, of, masks, num, den), docs, classes, size, num, den)
    if repeated is not None:  # the classes of an id are linked
        links = written(links.unionByName(repeated.select(F.col("least").alias("a"), F.col("id").alias("b")).where("a <> b")), "ngram")
    joined = components(links)

    live, at = _live(posted, of, joined)
    for turn in range(ROUNDS):
        parts = _parts(live, at, masks)
        sampled = _group_pairs(parts, masks, num, den, one_in=SAMPLE).count()
        if sampled * SAMPLE <= DENSE * at.count():
            break
        new = _verified(_nearest(_hubs(live, at, turn), at, masks, num, den, apart=True), docs, classes, size, num, den)
        links = written(links.unionByName(new), "ngram")
        joined = components(links)
        live, at = _live(live, at.drop("c"), joined)
    else:
        parts = _parts(live, at, masks)

    pairs = written(_remaining(_group_pairs(parts, masks, num, den), at, masks, num, den), "ngram")
    more = _verified(pairs, docs, classes, size, num, den)
    joined = components(written(links.unionByName(more), "ngram"))
    known = classes.select("n", "h1", "h2", "id", "doc").join(joined, F.col("id") == F.col("node"), "left").select("n", "h1", "h2", "id", "doc", F.coalesce("component", "id").alias("component"))
    out = rows.select("doc_id", "n", "h1", "h2")
    if repeated is not None:  # ids of classes are numbers here; rows without words go with the other rows of their id
        known = known.join(known.groupBy("component").agg(F.min("doc").alias("low")), "component").select("n", "h1", "h2", "id", F.col("low").alias("component"))
        other = repeated.where("id = least").join(known.select("id", F.col("component").alias("other")), "id").select("doc_id", "other")
        out = out.join(other, "doc_id", "left")
    else:
        out = out.withColumn("other", F.lit(None).cast("long"))
    out = out.join(known.select("n", "h1", "h2", "component"), ["n", "h1", "h2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "other", "doc_id").alias("component_id"))


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(classes: id, doc, n, h1, h2, p1, p2 of each distinct set; groups: n, p1, p2, g, members; the one row of ``rows`` for each class, its id in doc_id;
    doc_id, id, least for the classes of ids with several sets).

    doc: smallest doc_id of the set, and the class's id. If an id has several sets, classes are numbered instead, so none shares its id; otherwise the last table is None.
    """
    key = ["n", "h1", "h2"]
    named = rows.where("n > 0 and doc_id is not null").withColumns({"p1": F.xxhash64("prefix"), "p2": F.xxhash64(F.lit(3), "prefix")})
    classes = written(named.groupBy(*key, "p1", "p2").agg(F.min("doc_id").alias("doc")), "ngram")
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*key)).alias("low"), F.max(F.struct(*key)).alias("high")).where("low <> high")
    several = written(several.select("doc_id"), "ngram")
    repeated = None
    if several.isEmpty():
        classes = classes.select("*", F.col("doc").alias("id"))
        wide = within(named, "doc_id", classes.select("id"))
        if wide.count() != classes.count():  # repeated rows
            wide = written(wide.dropDuplicates(["doc_id"]), "ngram")
    else:
        classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "ngram")
        sets = named.select("doc_id", *key).join(several, "doc_id", "left_semi").distinct().join(classes.select("id", *key), key).select("doc_id", "id")
        sets = written(sets, "ngram")
        repeated = written(sets.join(sets.groupBy("doc_id").agg(F.min("id").alias("least")), "doc_id"), "ngram")
        wide = named.join(classes.select(F.col("doc").alias("doc_id"), *key, "id"), ["doc_id", *key]).dropDuplicates(["id"]).drop("doc_id").withColumnRenamed("id", "doc_id")
        wide = written(wide, "ngram")
    groups = classes.groupBy("n", "p1", "p2").agg(F.min("id").alias("g"), F.count("*").alias("members"))
    return classes, written(groups, "ngram"), wide, repeated


def _near(num: int, den: int) -> Column:
    """Sizes and masks of classes x and y allow the threshold."""
    a, b = F.col("x.n"), F.col("y.n")
    return _sizes_fit(a, b, num, den) & (_apart("x", "y") <= a + b - 2 * _needed(a, b, num, den))


def _nearest(candidates: DataFrame, of: DataFrame, masks: list[str], num: int, den: int, *, apart: bool = False) -> DataFrame:
    """(a, b): for each class of ``candidates`` (id, hub) the hub nearest by the masks; ``apart``: of another component."""
    slim = of.select("id", "n", *masks, *(["c"] if apart else []))
    fits = _near(num, den) & (F.col("x.c") != F.col("y.c")) if apart else _near(num, den)
    both = candidates.alias("k").join(slim.alias("x"), F.col("k.id") == F.col("x.id")).join(slim.alias("y"), (F.col("k.hub") == F.col("y.id")) & fits)
    best = both.select(F.col("k.id").alias("a"), F.col("k.hub").alias("b"), _apart("x", "y").alias("d"))
    return written(best.groupBy("a").agg(F.min(F.struct("d", "b")).alias("best")).select("a", "best.b"), "ngram")


def _live(posted: DataFrame, of: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings of the lists that still hold several components; their classes with component c)."""
    at = of.join(joined, of["id"] == joined["node"], "left").select(*of.columns, F.coalesce("component", "id").alias("c"))
    parts = at.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    mixed = posted.join(parts, "g").groupBy("gram").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("gram")
    live = written(posted.join(mixed, "gram", "left_semi"), "ngram")
    return live, written(at.join(live.select("g").distinct(), "g", "left_semi"), "ngram")


def _hubs(live: DataFrame, at: DataFrame, turn: int) -> DataFrame:
    """(id, hub): classes of live lists with ``HUBS`` classes drawn from each of their lists."""
    member = live.join(at.select("g", "id"), "g").select("gram", "id")
    drawn = [F.min_by("id", F.xxhash64("id", F.lit(turn * HUBS + k))).alias(f"h{k}") for k in range(HUBS)]
    hubs = member.groupBy("gram").agg(*drawn).select("gram", F.explode(F.array_distinct(F.array(*[f"h{k}" for k in range(HUBS)]))).alias("hub"))
    per_group = live.join(hubs, "gram").select("g", "hub").distinct()
    return per_group.join(at.select("g", "id"), "g").where("id <> hub").select("id", "hub")


def _parts(live: DataFrame, at: DataFrame, masks: list[str]) -> DataFrame:
    """Live postings per (group, component): gram, place, g, c, n and the AND and OR of the masks of the classes in it."""
    held = [F.bit_and(m).alias(f"a{i}") for i, m in enumerate(masks)] + [F.bit_or(m).alias(f"o{i}") for i, m in enumerate(masks)]
    return written(live.join(at.groupBy("g", "c", "n").agg(*held), "g"), "ngram")


def _group_pairs(parts: DataFrame, masks: list[str], num: int, den: int, *, one_in: int = 1) -> DataFrame:
    """(ga, ca, gb, cb): pairs of parts of different components that share a list and whose sizes, places and masks allow the threshold.

    ``one_in``: for an estimate, only the pairs of one group in so many.
    """
    n_a, n_b = F.col("x.n"), F.col("y.n")
    need = _needed(n_a, n_b, num, den)
    reach = F.least(n_a - F.col("x.place"), n_b - F.col("y.place"))  # common shingles from the first one on
    once = (F.col("x.g") < F.col("y.g")) | ((F.col("x.g") == F.col("y.g")) & (F.col("x.c") < F.col("y.c")))
    fits = _sizes_fit(n_a, n_b, num, den) & (reach >= need) & (_group_apart("x", "y") <= n_a + n_b - 2 * need)
    first = parts
    if one_in > 1:
        first = parts.where(F.pmod(F.xxhash64("g"), F.lit(one_in)) == 0)
    pairs = first.alias("x").join(parts.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.c") != F.col("y.c")) & once & fits)
    return pairs.select(F.col("x.g").alias("ga"), F.col("x.c").alias("ca"), F.col("y.g").alias("gb"), F.col("y.c").alias("cb")).distinct()


def _remaining(pairs: DataFrame, at: DataFrame, masks: list[str], num: int, den: int) -> DataFrame:
    """(a, b): the classes of the group pairs that their own masks allow."""
    members = pairs.alias("p").join(at.alias("x"), (F.col("p.ga") == F.col("x.g")) & (F.col("p.ca") == F.col("x.c")))
    members = members.join(at.alias("y"), (F.col("p.gb") == F.col("y.g")) & (F.col("p.cb") == F.col("y.c")) & _near(num, den))
    return members.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
