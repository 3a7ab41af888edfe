"""Greedy clusters of terms that stand in the same records (H3), block by block and exact.

Terms have an order.  The first one left is a seed; it takes each later one with which
enough of its records are left, and what it takes is gone.  Whether a seed takes a term
depends only on the terms before it and on the earlier seeds.  So the loops may change
places: the terms are cut into blocks of consecutive ones; in each block the seeds of
earlier blocks go first, in their order, with the records they have left, and then what is
left of the block makes seeds.  A block's task needs the postings of the block and what
seeds have left among its records, and most seeds are down to a few records after their
first block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.tables import settled, small, written

#: Postings (12 bytes each) up to which one task sweeps a group to the end; a block starts anew after as many.
LOCAL = 5_000_000
#: Terms that start a large group and have blocks of their own: they narrow the seeds with the most records.
FIRST = 256
#: Tasks for the groups' ends, at most; by a number of their own, as small groups would be put together otherwise.
MOST_TASKS = 10_000
#: Postings looked at together to find the earlier seeds that can take a term.
AT_ONCE = 4_000_000


def _gather(values: np.ndarray, begin: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The values of some lists, list after list; list i is values[begin[i]:begin[i + 1]]."""
    n = begin[some + 1] - begin[some]
    return values[np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _able(earlier: Sequence[np.ndarray], terms: np.ndarray, of_doc: np.ndarray, n: int, least: int) -> list[int]:
    """Which earlier seeds share enough of their records with some term, so that they may take it."""
    size = np.fromiter((int((of_doc[left + 1] - of_doc[left]).sum()) for left in earlier), np.int64, len(earlier))
    portion, out = np.cumsum(size) // AT_ONCE, []
    for lo, hi in zip(*(np.searchsorted(portion, np.unique(portion), side) for side in ("left", "right")), strict=True):
        key = np.repeat(np.arange(lo, hi), size[lo:hi]) * n + _gather(terms, of_doc, np.concatenate(earlier[lo:hi]))
        key, count = np.unique(key, return_counts=True)
        out += np.unique(key[count >= least] // n).tolist()
    return out


def moves(doc: np.ndarray, term: np.ndarray, records: int, least: int, earlier: Sequence[np.ndarray] = (), new: bool = True) -> Iterator[tuple[int | None, list[int], np.ndarray]]:
    """What seeds take, and the records they have left; ``doc`` (below ``records``) and ``term`` are different pairs, terms numbered in their order.

    ``earlier`` are the records of seeds before these terms; those that take some come
    first, each with its number.  Then (if ``new``) come the clusters of new seeds, which
    are members of their own, without a number.

    Only terms that stand in enough of a seed's records are looked at, with their counts
    in the records that are left; these are counted down as records go."""
    n = int(term.max()) + 1 if len(term) else 0
    order = np.lexsort((doc, term))
    docs, of_term = doc[order], np.concatenate([[0], np.cumsum(np.bincount(term, minlength=n))])
    order = np.lexsort((term, doc))
    terms, of_doc = term[order], np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=records))])
    used, place = np.zeros(n, bool), np.full(n, -1)

    def swept(seed: int, left: np.ndarray) -> tuple[list[int], np.ndarray]:
        near = _gather(terms, of_doc, left)
        if 4 * len(near) > n:
            count = np.bincount(near, minlength=n)
            later = np.flatnonzero(count >= least)
            later = later[(later > seed) & ~used[later]]
            count = count[later]
        else:
            later, count = np.unique(near[(near > seed) & ~used[near]], return_counts=True)
            later, count = later[count >= least], count[count >= least]
        members, at = [], 0
        while at < len(later):
            c = count[at:]
            shrinks = np.flatnonzero((c >= least) & (c < len(left)))
            k = int(shrinks[0]) if len(shrinks) else len(c)
            members += later[at : at + k][c[:k] >= least].tolist()
            if k < len(c):
                j = int(later[at + k])
                members.append(j)
                stay = np.isin(left, docs[of_term[j] : of_term[j + 1]], assume_unique=True)
                gone = _gather(terms, of_doc, left[~stay])
                place[later] = np.arange(len(later))
                gone = place[gone]
                count = count - np.bincount(gone[gone >= 0], minlength=len(later))
                place[later] = -1
                left = left[stay]
            at += k + 1
        return members, left

    for i in _able(earlier, terms, of_doc, n, least):
        members, left = swept(-1, earlier[i])
        if members:
            used[members] = True
            yield i, members, left
    for seed in range(n if new else 0):
        if not used[seed] and of_term[seed] < of_term[seed + 1]:
            members, left = swept(seed, docs[of_term[seed] : of_term[seed + 1]])
            used[[seed, *members]] = True
            yield None, [seed, *members], left


def clusters(doc: np.ndarray, term: np.ndarray, least: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """Members and records of each cluster, for all terms at once (``moves``)."""
    for _, members, left in moves(doc, term, int(doc.max()) + 1 if len(doc) else 0, least):
        yield members, left


_FOUND = "g string, seed int, members array<int>, n bigint, digest bigint"
#: What a block adds: each row is a term that a seed takes, or a record it has left then.
_TAKEN = "g string, seed int, t int, d bigint"


def _postings(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Record ids, names of terms, and the pairs of both by number, of records (d, ts)."""
    lists = table.column("ts").combine_chunks()
    names, term = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    d = table.column("d").to_numpy()
    return d, names, np.repeat(np.arange(len(d)), np.diff(lists.offsets.to_numpy())), term


def _whole(key: tuple, table: pa.Table, least: int) -> pa.Table:
    """The clusters of a group."""
    d, names, doc, term = _postings(table)
    found = [(int(names[m[0]]), names[m].tolist(), len(left), int(np.bitwise_xor.reduce(d[left]))) for m, left in clusters(doc, term, least)]
    seed, members, n, digest = zip(*found, strict=True) if found else ((), (), (), ())
    return pa.table({"g": pa.array([key[0].as_py()] * len(found), pa.string()), "seed": pa.array(seed, pa.int32()), "members": pa.array(members, pa.list_(pa.int32())), "n": pa.array(n, pa.int64()), "digest": pa.array(digest, pa.int64())})


def _block(least: int, new: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """What earlier seeds (seed, d) and, if ``new``, those of a block take of its records (d, ts)."""
    return lambda key, table, state: _taken(key, table, state, least, new)


def _taken(key: tuple, table: pa.Table, state: pa.Table, least: int, new: bool) -> pa.Table:
    d, names, doc, term = _postings(table)
    seed, record = state.column("seed").to_numpy(), state.column("d").to_numpy()
    by_id, order = np.argsort(d), np.lexsort((record, seed))
    record = by_id[np.searchsorted(d, record[order], sorter=by_id)] if len(record) else order
    seeds, begin = np.unique(seed[order], return_index=True)
    out: tuple[list, list, list] = ([], [], [])
    for i, members, left in moves(doc, term, len(d), least, np.split(record, begin[1:]) if len(seeds) else (), new):
        out[0].append(names[members[0]] if i is None else seeds[i])
        out[1].append(names[members])
        out[2].append(d[left])
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out[1:]]
    owner = [np.repeat(np.asarray(out[0], np.int32), [len(x) for x in xs]) for xs in out[1:]]
    return pa.table({
        "g": pa.array([key[0].as_py()], pa.string()).take(pa.array(np.zeros(len(flat[0]) + len(flat[1]), np.int64))),
        "seed": pa.array(np.concatenate(owner), pa.int32()),
        "t": pa.concat_arrays([pa.array(flat[0], pa.int32()), pa.nulls(len(flat[1]), pa.int32())]),
        "d": pa.concat_arrays([pa.nulls(len(flat[0]), pa.int64()), pa.array(flat[1], pa.int64())]),
    })


def _cut(many: DataFrame, local: int, first: int) -> tuple[DataFrame, DataFrame]:
    """The blocks (g, block, wide, from, to) of groups, and their records (g, block, wide, d, ts).

    A block has less than ``local`` postings before its last term; a term with more is a
    block of its own, a wide one.
    """
    counts = many.select("g", F.explode("ts").alias("t")).groupBy("g", "t").agg(F.count("*").alias("n"))
    by = Window.partitionBy("g").orderBy("t")
    before = F.sum("n").over(by) - F.col("n")
    placed = counts.select("g", "t", (F.col("n") > local).alias("wide"), F.floor(before / max(local, 1)).alias("slot"), (F.row_number().over(by) > first).alias("later"))
    starts = F.col("wide") | F.lag("wide", 1, True).over(by) | (F.col("slot") != F.lag("slot", 1, -1).over(by)) | (F.col("later") != F.lag("later", 1, False).over(by))
    numbered = placed.withColumn("block", F.sum(starts.cast("int")).over(by).cast("int") - 1)
    blocks = settled(numbered.groupBy("g", "block").agg(F.first("wide").alias("wide"), F.min("t").alias("from"), F.max("t").alias("to")))
    bounds = blocks.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("block", "wide", "from", "to"))).alias("bounds"))
    parts = F.transform("bounds", lambda b: F.struct(b["block"].alias("block"), b["wide"].alias("wide"), F.filter("ts", lambda t: (t >= b["from"]) & (t <= b["to"])).alias("ts")))
    dealt = many.join(small(settled(bounds)), "g").select("g", "d", F.explode(F.filter(parts, lambda p: F.size(p["ts"]) > 0)).alias("p")).select("g", "d", "p.*")
    return blocks, written(dealt.repartition("block", "g").sortWithinPartitions("block", "g"))


def _wide(docs: DataFrame, state: DataFrame, least: int) -> DataFrame:
    """Who takes a term with very many records (g, t, d), one of a group: the first earlier seed with enough of them, or it is a seed itself."""
    hits = settled(state.join(docs, ["g", "d"]).select("g", "seed", "t", "d"))
    owner = settled(hits.groupBy("g", "seed").agg(F.count("*").alias("n")).filter(F.col("n") >= least).groupBy("g").agg(F.min("seed").alias("seed")))
    new = docs.join(small(owner), "g", "left_anti").withColumn("seed", F.col("t"))
    pairs = hits.join(small(owner), ["g", "seed"]).select("g", "seed", "t", "d").unionByName(new)
    return pairs.select("g", "seed", "t", F.lit(None).cast("bigint").alias("d")).distinct().unionByName(pairs.select("g", "seed", F.lit(None).cast("int").alias("t"), "d"))


def _step(docs: DataFrame, state: DataFrame, least: int, local: int) -> DataFrame:
    """What is taken of blocks (g, d, ts), one of a group; earlier seeds with more than ``local`` of its records go in turns."""
    near = settled(state.join(docs.select("g", "d"), ["g", "d"]).select("g", "seed", "d"))
    size = near.groupBy("g", "seed").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("seed")) - F.col("n")
    turns = settled(size.select("g", "seed", F.floor(before / max(local, 1)).alias("turn")))
    last = turns.agg(F.max("turn")).first()[0] or 0
    near, taken = near.join(small(turns), ["g", "seed"]), None
    for turn in range(last + 1):
        left = docs
        if taken is not None:
            gone = taken.filter("t IS NOT NULL").groupBy("g").agg(F.collect_list("t").alias("gone"))
            left = docs.join(small(settled(gone)), "g", "left").withColumn("ts", F.when(F.col("gone").isNull(), F.col("ts")).otherwise(F.array_except("ts", "gone"))).drop("gone")
        some = near.filter(F.col("turn") == turn).drop("turn")
        step = settled(left.groupBy("g").cogroup(some.groupBy("g")).applyInArrow(_block(least, turn == last), _TAKEN))
        taken = step if taken is None else taken.unionByName(step)
    return taken


def _by_blocks(many: DataFrame, least: int, local: int, first: int) -> DataFrame:
    """The clusters of large groups, block after block."""
    blocks, dealt = _cut(many, local, first)
    members, state = [], many.sparkSession.createDataFrame([], "g string, seed int, d bigint")
    for r in blocks.groupBy("block").agg(F.bool_or("wide").alias("wide"), F.bool_and("wide").alias("only")).orderBy("block").collect():
        docs, parts = dealt.filter(F.col("block") == r.block), []
        if r.wide:
            parts.append(_wide(docs.filter("wide").select("g", F.col("ts")[0].alias("t"), "d"), state, least))
        if not r.only:
            parts.append(_step(docs.filter("NOT wide").select("g", "d", "ts"), state, least, local))
        taken = settled(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
        members.append(taken.filter("t IS NOT NULL").drop("d"))
        changed = small(settled(taken.select("g", "seed").distinct()))
        state = settled(state.join(changed, ["g", "seed"], "left_anti").unionByName(taken.filter("d IS NOT NULL").drop("t")))
    found = members[0]
    for m in members[1:]:
        found = found.unionByName(m)
    found = found.groupBy("g", "seed").agg(F.sort_array(F.collect_list("t")).alias("members"))
    return found.join(state.groupBy("g", "seed").agg(F.count("*").alias("n"), F.bit_xor("d").alias("digest")), ["g", "seed"])


def sweep(records: DataFrame, least: int, local: int = LOCAL, first: int = FIRST) -> DataFrame:
    """Clusters of the terms of each group.

    ``records`` (settled): g (string), d (long, one row each in a group) and ts, the
    different numbers of its terms, ascending, by which terms are ordered in the group.
    Every term stands in ``least`` records of the group at least.

    A group of at most ``local`` postings is one task.  A larger one goes block by block,
    the blocks of all groups with the same number at once, so that there are as many rounds
    as the largest group has times ``local`` postings.  The ``first`` terms have blocks of
    their own; a term in more than ``local`` records is dealt with by joins.  Nothing is
    cut off: the result is the sequential sweep's.

    Returns g, seed, members (ascending), n (records with all members) and digest (the
    exclusive or of their ``d``).
    """
    sizes = settled(records.groupBy("g").agg(F.sum(F.size("ts")).alias("size")))
    large = settled(sizes.filter(F.col("size") > local).select("g"))
    rest = records.join(small(large), "g", "left_anti")
    tasks = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4 * sizes.count(), MOST_TASKS))
    found = rest.repartition(tasks, "g").groupBy("g").applyInArrow(lambda key, table: _whole(key, table, least), _FOUND)
    if large.isEmpty():
        return found
    return found.unionByName(_by_blocks(records.join(small(large), "g", "left_semi"), least, local, first).select("g", "seed", "members", "n", "digest"))
