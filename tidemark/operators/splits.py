"""Deterministic splits, subsets and cluster resampling.

Every draw is an order by a salted hash of the entity, so it does not depend on the
partitioning, the row order or the engine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import hash_rank
from tidemark.functions.scalars import DRAW_STEP, MIX32, RANK_STEP, WORD32, hash32, mix32
from tidemark.session import materialize


def strata_ranks(entities: DataFrame, strata: Sequence[str], salt: Sequence[Column | str], entity: str, tasks: int | None = None) -> DataFrame:
    """Adds ``rank`` (1-based, by salted hash) and ``rank_total`` inside each stratum."""
    hashed = entities.withColumn("__h", hash32(*[F.lit(s) if isinstance(s, str) else s for s in salt], entity))
    return hash_rank(hashed, strata, "__h", entity, tasks=tasks).drop("__h")


def case_control_split(
    entities: DataFrame, *, entity: str, label: str, n_controls: int, case_train: int, control_train: int,
    salt: str = "split",
) -> DataFrame:
    """Sample ``n_controls`` controls; the first k of each stratum train, the rest test."""
    ranked = strata_ranks(entities, [label], [salt], entity)
    is_case, r = F.col(label) == 1, F.col("rank")
    return ranked.where(is_case | (r <= n_controls)).select(
        entity,
        label,
        F.when(r <= F.when(is_case, case_train).otherwise(control_train), "train").otherwise("test").alias("part"),
    )


def repeated_folds(
    entities: DataFrame, *, entity: str, positive: str, repeats: int = 5, folds: int = 5, salt: str = "fold"
) -> DataFrame:
    """(repeat, entity, fold): folds stratified by ``positive``, one whole entity per fold."""
    rep = F.explode(F.array(*[F.lit(r) for r in range(repeats)]))
    exploded = entities.select(entity, positive).withColumn("repeat", rep)
    ranked = strata_ranks(exploded, ["repeat", positive], [salt, F.col("repeat")], entity)
    return ranked.select("repeat", entity, positive, F.pmod(F.col("rank") - 1, F.lit(folds)).cast("int").alias("fold"))


def site_folds(entities: DataFrame, *, entity: str, site: str, folds: int = 5) -> DataFrame:
    """Whole sites per fold, balanced by size: sites in size order are dealt out in a snake."""
    sizes = entities.groupBy(site).agg(F.countDistinct(entity).alias("n"))
    # one row per site: the number of sites is the small dimension here
    pos = F.row_number().over(Window.orderBy(F.desc("n"), F.col(site))) - 1
    lap, k = F.floor(F.col("pos") / folds), F.pmod(F.col("pos"), F.lit(folds))
    fold = F.when(lap % 2 == 0, k).otherwise(folds - 1 - k).cast("int")
    return sizes.withColumn("pos", pos).select(site, "n", fold.alias("fold"))


def era_flag(df: DataFrame, index: str, cutoff: int, name: str = "late_era") -> DataFrame:
    return df.withColumn(name, (F.col(index) >= cutoff).cast("int"))


def nested_subsets(
    entities: DataFrame, *, entity: str, strata: str, fractions: Sequence[float], salt: str = "curve"
) -> DataFrame:
    """Learning-curve subsets: the first floor(f*n) of each stratum; smaller subsets nest in larger ones."""
    ranked = strata_ranks(entities, [strata], [salt], entity)
    keep = F.array_compact(
        F.array(*[F.when(F.col("rank") <= F.floor(F.lit(float(f)) * F.col("rank_total")), F.lit(float(f)))
                  for f in fractions])
    )
    return ranked.select(F.explode(keep).alias("fraction"), entity, strata)


def stratified_bootstrap(
    entities: DataFrame, *, draws: int, entity: str = "stay", stratum: str = "case", salt: str = "boot"
) -> DataFrame:
    """(draw, stratum, entity, m): n draws with replacement inside each stratum of n entities.

    One multiplicity per entity and draw, shared by all repeats, arms and phases; entities that
    were not drawn have no row. Slot r of a draw picks the entity ranked hash(draw, r) mod n: a counter-based integer hash,
    seeded by salt and stratum.
    """
    ranked = strata_ranks(entities.select(entity, stratum), [stratum], ["rank"], entity)
    slots = ranked.select(stratum, "rank", "rank_total").withColumn(
        "draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))
    )
    word = F.lit(WORD32).cast("long")
    of_draw = mix32((hash32(F.lit(salt), stratum) + F.col("draw").cast("long") * DRAW_STEP).bitwiseAND(word))
    pick = mix32((of_draw + F.col("rank").bitwiseAND(word) * RANK_STEP).bitwiseAND(word)) % F.col("rank_total") + 1
    picks = slots.select("draw", stratum, pick.alias("rank")).groupBy("draw", stratum, "rank").agg(
        F.count("*").cast("int").alias("m")
    )
    return picks.join(ranked.select(stratum, "rank", entity), [stratum, "rank"]).select("draw", stratum, entity, "m")


PICK_BLOCK = 4096  # entities whose draws are counted together in one task


def _mixed(x: np.ndarray) -> np.ndarray:
    """``scalars.mix32`` of a whole array."""
    for shift, factor in zip((16, 15), MIX32, strict=True):
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(WORD32)
    return x ^ (x >> np.uint64(16))


def bootstrap_weights(
    entities: DataFrame, *, draws: int, entity: str = "stay", stratum: str = "case", salt: str = "boot"
) -> DataFrame:
    """(entity, w): the multiplicities of ``stratified_bootstrap`` as one byte per draw, for the resampling operators.

    Same picks, hashed in whole arrays. They leave the hashing tasks as two bytes each, sorted by block of ``PICK_BLOCK``
    ranks, and are counted per block; no row per draw and entity is made. The result is written once, whatever reads it
    later. A multiplicity over 255 has no byte (and no practical probability): it fails.
    """
    ranked = materialize(strata_ranks(entities.select(entity, stratum), [stratum], ["rank"], entity))
    slots = ranked.select(F.col(stratum).cast("string").alias("s"), "rank", "rank_total", hash32(F.lit(salt), stratum).alias("seed"))

    def pick(batches):
        for batch in batches:
            strata = np.array(batch.column(0).to_pylist(), object)
            ranks, totals, seeds = (c.to_numpy() for c in batch.columns[1:])
            for s in dict.fromkeys(strata):
                own = np.flatnonzero(strata == s)
                n = totals[own[0]]
                of_draw = _mixed((seeds[own[0]].astype(np.uint64) + np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(DRAW_STEP)) & np.uint64(WORD32))
                counted = (ranks[own].astype(np.uint64) & np.uint64(WORD32)) * np.uint64(RANK_STEP)
                out = {"s": [], "block": [], "draw": [], "picks": []}
                for d in range(draws):
                    found = np.sort((_mixed((of_draw[d] + counted) & np.uint64(WORD32)) % np.uint64(n)).astype(np.int64))
                    blocks = found // PICK_BLOCK
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(found)]])
                    for x, y in zip(cuts, cuts[1:], strict=False):
                        for name, value in (("s", s), ("block", int(blocks[x])), ("draw", d + 1), ("picks", (found[x:y] % PICK_BLOCK).astype(np.uint16).tobytes())):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("s", pa.string()), ("block", pa.int64()), ("draw", pa.int32()), ("picks", pa.binary())]))

    def count(key, table):
        matrix = np.zeros((PICK_BLOCK, draws), np.int32)
        for d, picks in zip(table.column("draw").to_pylist(), table.column("picks").to_pylist(), strict=True):
            matrix[:, d - 1] += np.bincount(np.frombuffer(picks, np.uint16), minlength=PICK_BLOCK).astype(np.int32)
        if matrix.max() > 255:
            raise ValueError("a multiplicity is over 255")
        used = np.flatnonzero(matrix.any(axis=1))
        rows = matrix[used].astype(np.uint8)
        return pa.Table.from_pydict({
            "s": pa.array([key[0].as_py()] * len(used), pa.string()), "rank": pa.array(used + key[1].as_py() * PICK_BLOCK + 1, pa.int64()),
            "w": pa.array([r.tobytes() for r in rows], pa.binary())})

    picks = slots.repartition("rank").mapInArrow(pick, "s string, block long, draw int, picks binary")
    counted = picks.groupBy("s", "block").applyInArrow(count, "s string, rank long, w binary")
    return materialize(counted.join(ranked.select(F.col(stratum).cast("string").alias("s"), "rank", entity), ["s", "rank"]).select(entity, "w"))


@dataclass(frozen=True)
class Slots:
    """A bootstrap that tasks draw themselves: ``places`` is (entity, slot), ``strata`` the seed and size of each stratum, whose slots follow one another.

    Without ``places`` the rows' entities are slots already."""

    places: DataFrame | None
    strata: tuple[tuple[int, int], ...]

    @property
    def size(self) -> int:
        return sum(n for _, n in self.strata)


def bootstrap_slots(entities: DataFrame, *, entity: str = "stay", stratum: str = "case", salt: str = "boot") -> Slots:
    """The draws of ``stratified_bootstrap`` for the resampling operators, without a table of multiplicities.

    A draw's picks depend on the strata's seeds and sizes alone, so a task that holds many rows counts them anew
    (``multiplicities``); a row carries its entity's slot, eight bytes, whatever the number of draws.
    """
    ranked = strata_ranks(entities.select(entity, stratum), [stratum], ["rank"], entity)
    ranked = materialize(ranked.select(F.col(stratum).cast("string").alias("s"), "rank", "rank_total", hash32(F.lit(salt), stratum).alias("seed"), entity))
    sizes = sorted((r["s"], r["seed"], r["rank_total"]) for r in ranked.select("s", "seed", "rank_total").distinct().collect())
    first, before = F.lit(None).cast("long"), 0
    for s, _, n in sizes:
        first, before = F.when(F.col("s") == s, F.lit(before).cast("long")).otherwise(first), before + n
    return Slots(ranked.select(entity, (first + F.col("rank") - 1).alias("slot")), tuple((int(seed), int(n)) for _, seed, n in sizes))


_PICKS = 1 << 15  # hashed at once


def multiplicities(strata: Sequence[tuple[int, int]], lo: int, hi: int) -> np.ndarray:
    """(draws lo..hi-1, slots + 1): how often each slot is picked. Draw 0 has ones; the last slot stands for entities without one.

    A multiplicity over 255 has no byte (and no practical probability): it fails.
    """
    out = np.zeros((hi - lo, sum(n for _, n in strata) + 1), np.uint8)
    steps = np.arange(1, _PICKS + 1, dtype=np.uint32) * np.uint32(RANK_STEP)
    for d, row in zip(range(lo, hi), out, strict=True):
        if d == 0:
            row[:] = 1
            continue
        at = 0
        for seed, n in strata:
            counts, size = row[at : at + n], np.uint32(n)
            of_draw = int(_mixed(np.array([(seed + d * DRAW_STEP) & WORD32], np.uint64))[0])
            for first in range(0, n, _PICKS):
                x = steps[: n - first] + np.uint32((of_draw + first * RANK_STEP) & WORD32)
                for shift, factor in zip((16, 15), MIX32, strict=True):
                    x ^= x >> np.uint32(shift)
                    x *= np.uint32(factor)
                x ^= x >> np.uint32(16)
                x -= x // size * size
                np.add.at(counts, x.astype(np.intp), np.uint8(1))
            if counts.sum(dtype=np.int64) != n:
                raise ValueError("a multiplicity is over 255")
            at += n
    return out


_UNPICK = 1 << 22  # words turned back at once


def _unmixed(x: np.ndarray) -> np.ndarray:
    """The words (uint32) that ``scalars.mix32`` sends to ``x``."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(pow(MIX32[1], -1, 1 << 32))
    x ^= (x >> np.uint32(15)) ^ (x >> np.uint32(30))
    x *= np.uint32(pow(MIX32[0], -1, 1 << 32))
    return x ^ (x >> np.uint32(16))


def slot_multiplicities(strata: Sequence[tuple[int, int]], slots: np.ndarray, draws: int) -> np.ndarray:
    """(draws 0..``draws``, slots): columns of ``multiplicities`` for some slots (ascending, distinct).

    A draw's hash is a bijection of words, so the words that pick a slot are known without the draws: turned back, they are at most
    2^32 / n ranks from a draw's offset, and a draw picks those in a window of n. A few slots of many thus cost no pass over all slots;
    all slots together cost some 2^32 words for any number of draws. The cheaper of the two ways is taken in each stratum.
    """
    out = np.zeros((draws + 1, len(slots)), np.uint8)
    out[0] = 1
    if not draws:
        return out
    back, word, at = np.uint32(pow(RANK_STEP, -1, 1 << 32)), 1 << 32, 0
    for seed, n in strata:
        lo, hi = np.searchsorted(slots, (at, at + n))
        own = (slots[lo:hi] - at).astype(np.uint64)
        at += n
        if not len(own):
            continue
        each = word // n + 1
        if 3 * len(own) * each > n * draws:
            for d in range(1, draws + 1):
                out[d, lo:hi] = multiplicities([(seed, n)], d, d + 1)[0][own.astype(np.int64)]
            continue
        of_draw = _mixed((np.uint64(seed) + np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(DRAW_STEP)) & np.uint64(WORD32))
        starts = (of_draw * np.uint64(back) + np.uint64(1)) & np.uint64(WORD32)
        steps, size = np.arange(each, dtype=np.uint64) * np.uint64(n), max(1, _UNPICK // each)
        for first in range(0, len(own), size):
            some = own[first : first + size]
            x = (some[:, None] + steps).reshape(-1)
            owner = np.repeat(np.arange(len(some), dtype=np.uint64), each)
            if int(some[-1]) + n * (each - 1) >= word:
                real = x < word
                x, owner = x[real], owner[real]
            ranks = (_unmixed(x.astype(np.uint32)) * back).astype(np.uint64)
            ranks = np.sort((ranks << np.uint64(32)) | owner)
            owner = (ranks & np.uint64(WORD32)).astype(np.int64)
            ends = starts + np.uint64(n)
            left = np.searchsorted(ranks, starts << np.uint64(32))
            right = np.searchsorted(ranks, np.minimum(ends, np.uint64(WORD32)) << np.uint64(32))
            right[ends > np.uint64(WORD32)] = len(ranks)
            over = np.searchsorted(ranks, np.where(ends > np.uint64(word), ends - np.uint64(word), np.uint64(0)) << np.uint64(32))
            for d in range(draws):
                m = np.bincount(owner[left[d] : right[d]], minlength=len(some))
                if over[d]:
                    m += np.bincount(owner[: over[d]], minlength=len(some))
                if m.max() > 255:
                    raise ValueError("a multiplicity is over 255")
                out[d + 1, lo + first : lo + first + len(some)] = m
    return out


_COUNTED, _RETURNED = 1 << 14, 1 << 10  # slots counted at once, and those whose rows leave a task together


def multiplicity_rows(slots: Slots, *, draws: int, entity: str = "stay") -> DataFrame:
    """(draw, entity, m) of the entities drawn, as ``stratified_bootstrap``: slots are cut into ranges and each task counts its own; nothing but slots is shuffled.

    Rows leave a task by entity, then draw: a file then holds each entity in one run, and no list of entities that grows with the table.
    """
    strata, schema = slots.strata, slots.places.schema
    parts = max(1, min(slots.size // PICK_BLOCK, max(slots.places.sparkSession.sparkContext.defaultParallelism, slots.size >> 20)))
    fields = f"draw int, {entity} {schema[entity].dataType.simpleString()}, m int"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("slot")
        slot, ids = table.column("slot").to_numpy(), table.column(entity).combine_chunks()
        for first in range(0, len(slot), _COUNTED):
            counted = slot_multiplicities(strata, slot[first : first + _COUNTED], draws)
            for at in range(0, counted.shape[1], _RETURNED):
                m = np.ascontiguousarray(counted[1:, at : at + _RETURNED].T)
                row, draw = np.nonzero(m)
                yield pa.RecordBatch.from_arrays([pa.array((draw + 1).astype(np.int32)), ids.take(pa.array(row + first + at)), pa.array(m[row, draw].astype(np.int32))], names=["draw", entity, "m"])

    ranged = slots.places.withColumn("__part", F.floor(F.col("slot") * parts / max(slots.size, 1)))
    return ranged.repartition(3 * parts, "__part").groupBy("__part").applyInArrow(rows, fields)


def plain_bootstrap(entities: DataFrame, *, draws: int, entity: str = "stay", salt: str = "plain") -> DataFrame:
    one = entities.select(entity).withColumn("__one", F.lit(0))
    return stratified_bootstrap(one, draws=draws, entity=entity, stratum="__one", salt=salt).drop("__one")


def matched_donors(
    rows: DataFrame, *, entity: str, keys: Sequence[str], salt: str = "donor", minimum: int = 5,
    carry: Sequence[str] = (), vary: Sequence[str] = (), tasks: int | None = None,
) -> DataFrame:
    """Pair every row with another entity's row of the same structural group.

    Rows of a group are put in salted-hash order and rotated by 1..n-1 places, so a donor is never
    the row itself; groups below ``minimum`` keep ``donor`` NULL. ``carry`` columns of the donor
    come along as ``donor_<name>``. ``vary`` columns (a subset of the keys, e.g. a trial) change the order. ``tasks``: number of
    partitions of the exchanges. Rows are ranked once; each goes to its own rank as a donor and to its donor's rank as a receiver.
    """
    keys = list(keys)
    ranked = strata_ranks(rows, keys, [salt, *[F.col(c) for c in vary]], entity, tasks)
    n = F.col("rank_total")
    shift = F.pmod(hash32(F.lit(salt + "-shift"), *keys), n - 1) + 1
    pos = F.when(n >= minimum, F.pmod(F.col("rank") - 1 + shift, n) + 1)
    gives = F.struct(F.when(n >= minimum, F.col("rank")).alias("__pos"), F.lit(0).alias("__takes"))
    placed = ranked.withColumn("__at", F.explode(F.array(gives, F.struct(pos.alias("__pos"), F.lit(1).alias("__takes")))))
    rest = [c for c in rows.columns if c not in keys]
    placed = placed.where("__at.__takes = 1 or __at.__pos is not null").select(*keys, *rest, "__at.*")
    dealt = placed.repartition(*([tasks] if tasks else []), "__pos", *keys)
    at = Window.partitionBy("__pos", *keys).orderBy("__takes")
    donor = lambda c: F.when(F.lag("__takes").over(at) == 0, F.lag(c).over(at))
    found = dealt.select("*", donor(entity).alias("donor"), *[donor(c).alias(f"donor_{c}") for c in carry])
    return found.where("__takes = 1").select(*keys, *rest, "donor", *[f"donor_{c}" for c in carry])


def pool_counts(rows: DataFrame, *, entity: str, y: str) -> DataFrame:
    return rows.agg(
        F.countDistinct(entity).alias("entities"),
        F.countDistinct(F.when(F.col(y) == 1, F.col(entity))).alias("cases"),
        F.sum(F.col(y).cast("long")).alias("positive_rows"),
    )
