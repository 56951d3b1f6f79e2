"""Accounts within two steps, counted in blocks: paths of two steps meet in a task's memory and are never listed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Links of the accounts counted by one task, and of those it counts among, about.
OWN, AMONG = 2_000_000, 6_000_000
#: Reached accounts of one account that are looked at together; lists with more than this share of all accounts in a task are kept as bits.
LOT, DENSE = 2_000_000, 128


def within_two_steps(near: DataFrame, own: int = OWN, among: int = AMONG) -> DataFrame:
    """(account, n): distinct accounts next to an account or to one of those, itself included, of near (account, other), a table with distinct links both ways.

    Accounts are dealt to blocks, and so are the accounts they may reach; a task has one block of each, with the links that lead from the
    first to the second. Links are sent to as many tasks as need them: their number grows with the links over `own` and `among`.
    """
    links = near.count()
    mine, theirs = (max(1, -(-links // most)) for most in (own, among))
    block = lambda x, n: F.pmod(F.xxhash64(x), F.lit(n))
    lists = near.groupBy("account").agg(F.collect_list("other").alias("others"))
    at = F.explode(F.array(*(F.lit(b).cast("long") for b in range(theirs)))).alias("b")
    left = lists.select(block("account", mine).alias("a"), at, "account", "others").withColumn("next", F.filter("others", lambda x: block(x, theirs) == F.col("b")))
    step = near.select(block("account", mine).alias("a"), "other").distinct()
    reach = near.select(F.col("account").alias("other"), block("other", theirs).alias("b"), F.col("other").alias("reached")).groupBy("other", "b").agg(F.collect_list("reached").alias("reached"))
    right = step.join(reach, "other").select("a", "b", "other", "reached")
    kind = near.schema["account"].dataType.simpleString()
    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_counting(), f"account {kind}, n long")
    return found.groupBy("account").agg(F.sum("n").alias("n"))


def _counting():
    """The function of a task; it brings along what it needs, so that tasks import nothing of this package."""
    lot_size, dense_share = LOT, DENSE

    def flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Values of a column of lists in one array, and where each list begins, with the end."""
        lists = lists.combine_chunks()
        n = lists.value_lengths().to_numpy(zero_copy_only=False) if len(lists) else np.empty(0, np.int64)
        return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n, dtype=np.int64)])

    def numbers(values: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The place of each value in known, which is sorted and has it."""
        out = np.empty(len(values), np.int32)
        for at in range(0, len(values), lot_size):
            out[at : at + lot_size] = np.searchsorted(known, values[at : at + lot_size])
        return out

    def lots(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        held, size = [], 0
        for x in parts:
            held.append(x)
            size += len(x)
            if size >= lot_size:
                yield np.concatenate(held)
                held, size = [], 0
        if held:
            yield np.concatenate(held)

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        """For each account of left (account, others, next), how many accounts are in `next` or in `reached` of right (other, reached) for one of `others`."""
        others, begin = flat(left["others"])
        direct, begin_direct = flat(left["next"])
        reached, begin_reached = flat(right["reached"])
        known = np.unique(np.concatenate([np.unique(reached), np.unique(direct)]))
        reached, direct = numbers(reached, known), numbers(direct, known)
        # the list of each of others in right; none where it reaches nothing in this block
        names = right["other"].to_numpy()
        order = np.argsort(names)
        place = np.searchsorted(names, others, sorter=order) if len(names) else np.zeros(len(others), np.int64)
        has = place < len(names)
        row = np.full(len(others), -1, np.int64)
        row[has] = order[place[has]]
        row[has] = np.where(names[row[has]] == others[has], row[has], -1)
        lengths = np.diff(begin_reached)
        words = -(-len(known) // 64)
        dense = np.flatnonzero(lengths > max(1000, len(known) // dense_share))
        bits = np.zeros((len(dense), words * 8), np.uint8)
        for k, r in enumerate(dense):
            flags = np.zeros(words * 64, np.uint8)
            flags[reached[begin_reached[r] : begin_reached[r + 1]]] = 1
            bits[k] = np.packbits(flags, bitorder="little")
        as_bits = np.full(len(lengths) + 1, -1, np.int64)  # the last is for no list
        as_bits[dense] = np.arange(len(dense))
        seen, places = np.zeros(len(known), np.int32), np.arange(2 * lot_size, dtype=np.int32)
        n = np.zeros(len(left), np.int64)
        for a in range(len(left)):
            rows = row[begin[a] : begin[a + 1]]
            kept = as_bits[rows]
            sparse = rows[(rows >= 0) & (kept < 0)]
            full = np.unique(kept[kept >= 0])
            mark = None
            if len(full):
                mark = bits[full[0]].copy()
                for k in full[1:]:
                    mark |= bits[k]
            parts = [direct[begin_direct[a] : begin_direct[a + 1]], *(reached[s:e] for s, e in zip(begin_reached[sparse].tolist(), begin_reached[sparse + 1].tolist(), strict=True))]
            if sum(map(len, parts)) <= lot_size:
                all_ = np.concatenate(parts)
                at = places[: len(all_)]
                seen[all_] = at  # one of equals stays
                once = seen[all_] == at
                if mark is None:
                    n[a] = np.count_nonzero(once)
                else:
                    all_ = all_[once]
                    n[a] = int(np.bitwise_count(mark.view(np.uint64)).sum()) + np.count_nonzero(((mark[all_ >> 3] >> (all_ & 7).astype(np.uint8)) & 1) == 0)
            else:
                flags = np.zeros(words * 64, bool) if mark is None else np.unpackbits(mark, bitorder="little").astype(bool)
                for lot in lots(iter(parts)):
                    flags[lot] = True
                n[a] = np.count_nonzero(flags)
        return pa.table({"account": left["account"], "n": n})

    return counted
