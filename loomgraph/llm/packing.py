"""Problem 7: filling containers of fixed capacity, by the configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fits one container; the program asks how many containers, whole or not, to fill by each so
that every length is used up with the fewest containers. It is solved by multiplicative weights: each length has a weight that grows
in every round and falls by the share of its items that the round uses; a round prices all configurations by a knapsack dynamic
program over the weights and gives the best one an equal share of the containers. The fractional solution is then rounded down to
whole containers, and what that leaves over is a smaller program of its own, until a share is one container.

The program sees the histogram alone: at most `capacity` numbers, whatever the number of items, and its rounds grow with the
logarithm of their count. All lengths are priced in every round. The items themselves are only counted, ranked within their length and
told their container.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph import storage

#: Rounds of one program: each configuration priced gets one in so many of the containers still needed.
ROUNDS = 200
#: A length unused over a whole program has its weight multiplied by exp(STEEPNESS), one used up at once is divided by it.
STEEPNESS = 4.0
#: A length of which all programs so far left twice the share of the whole begins with its weight multiplied by exp(BEHIND).
BEHIND = 0.5
#: A program ends before its rounds do when a configuration leaves so much more room than the fullest: finer shares fill it better.
SLACK = 0.002
#: A configuration within this share of the greatest weight counts as the greatest, as rounds don't depend on less.
PRECISION = 1e-4
#: Items of one length that are ranked in one task.
RANKED = 100_000


def price(weight: np.ndarray, sizes: np.ndarray, limit: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size the configuration of greatest weight holds, at most limit of it: a bounded knapsack by dynamic programming.

    The relaxed knapsack, filled by weight per token, bounds every configuration from above, a filled one bounds the greatest from below.
    Taking an item off the relaxed filling or adding one costs a known weight; where that is more than the two bounds
    are apart, the number of such items is settled. The program runs over all the others and the room they can have.
    """
    limit = np.minimum(limit, capacity // sizes)
    order = np.argsort(-weight / sizes, kind="stable")
    w, s, most = weight[order], sizes[order], limit[order]
    load = np.cumsum(s * most)
    out = np.zeros(len(sizes), np.int64)
    if load[-1] <= capacity:
        out[order] = most
        return out
    k = int(np.searchsorted(load, capacity, "right"))
    base = most.copy()
    base[k:] = 0
    room = capacity - (int(load[k - 1]) if k else 0)
    base[k] = room // s[k]
    room -= int(base[k] * s[k])
    value = float(w @ base)
    density = w[k] / s[k]
    upper = value + room * density
    # a filled configuration: the heaviest that fits the room, again and again
    full, left = base.copy(), room
    while left > 0:
        fits = np.flatnonzero((s[k:] <= left) & (most[k:] > full[k:])) + k
        if not len(fits):
            break
        j = fits[np.argmax(w[fits] * np.minimum(most[fits] - full[fits], left // s[fits]))]
        n = min(int(most[j] - full[j]), left // int(s[j]))
        full[j] += n
        left -= n * int(s[j])
    lower = float(w @ full)
    gap = upper - lower
    if gap > PRECISION * upper:
        swing = np.floor(np.minimum(gap / np.maximum(np.abs(w - s * density), 1e-300), 1e9)).astype(np.int64)
        swing[k] = most[k]
        low, high = np.maximum(base - swing, 0), np.minimum(base + swing, most)
        open_ = np.flatnonzero(high > low)
        kept = base.copy()
        kept[open_] = low[open_]
        best, got = _table(w[open_], s[open_], (high - low)[open_], capacity - int(s @ kept))
        if float(w @ kept) + best > lower:
            full = kept
            full[open_] += got
    out[order] = full
    return out


def _table(weight: np.ndarray, sizes: np.ndarray, limit: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The dynamic program over the room: (greatest weight, how many of each size)."""
    who, load, gain = [], [], []
    for k, (size, left, g) in enumerate(zip(sizes.tolist(), np.minimum(limit, room // sizes).tolist(), weight.tolist(), strict=True)):
        m = 1
        while left > 0:  # 1, 2, 4 ... and the rest, so that each number up to the limit can be made
            m = min(m, left)
            who.append(k), load.append(size * m), gain.append(g * m)
            left, m = left - m, 2 * m
    best, with_it = np.zeros(room + 1, np.float32), np.empty(room + 1, np.float32)
    took = np.empty((len(who), room + 1), bool)  # places below an item's load are neither written nor read
    for i, (size, g) in enumerate(zip(load, np.array(gain, np.float32), strict=True)):
        new, old = with_it[size:], best[size:]
        np.add(best[: room + 1 - size], g, out=new)
        np.greater(new, old, out=took[i, size:])
        np.maximum(new, old, out=old)
    out, c = np.zeros(len(sizes), np.int64), int(best.argmax())
    top = float(best[c])
    for i in range(len(who) - 1, -1, -1):
        if c >= load[i] and took[i, c]:
            out[who[i]] += load[i] // sizes[who[i]]
            c -= load[i]
    return top, out


@dataclass
class Plan:
    """Runs of equal containers as ranges of ranks: items of `size` from rank `first` on go to container `base` and up, `each` to one.

    Sorted by (size, first); lengths and shorter: the lengths, and by length the number of shorter items. The number of rows is
    bounded by the rounds times the capacity.
    """

    size: np.ndarray
    first: np.ndarray
    base: np.ndarray
    each: np.ndarray
    containers: int
    lengths: np.ndarray
    shorter: np.ndarray

    def container(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The container of each item. Items and ranges have ordinals over all items by length, then rank, so that one search finds the range."""
        own = self.shorter[np.searchsorted(self.lengths, size)]
        k = np.searchsorted(self.shorter[np.searchsorted(self.lengths, self.size)] + self.first, own + rank, "right") - 1
        assert (self.size[k] == size).all()
        return self.base[k] + (rank - self.first[k]) // self.each[k]


def program(sizes: np.ndarray, demand: np.ndarray, capacity: int, log_weight: np.ndarray, rounds: int = ROUNDS) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """A fractional solution for items of `sizes`: (containers, places in sizes, how many of each) of every configuration used.

    log_weight is where the weights begin. No length is used more than its demand. A share is what makes `rounds` of them all the containers, but not more than lengths with
    half of the tokens have items. Where that is not more than one container it is one, and the program goes on until
    all items are used; else it ends with its rounds, and some items can be left.
    """
    tokens = sizes * demand
    by = np.argsort(demand, kind="stable")
    half = int(demand[by[np.searchsorted(np.cumsum(tokens[by]), tokens.sum() / 2)]])
    share = max(1.0, min(float(tokens.sum()) / capacity / rounds, half))
    whole = share == 1.0
    left = demand.astype(float)
    used: list[tuple[float, np.ndarray, np.ndarray]] = []
    log_weight = log_weight.copy()
    fullest = 0
    live = np.flatnonzero(left >= share)
    t = 0
    while len(live) and (whole or t < rounds):
        log_weight += STEEPNESS / rounds
        steep = log_weight[live]
        weight = sizes[live] / capacity * np.exp(np.maximum(steep - steep.max(), -20.0))
        config = price(weight, sizes[live], np.floor(left[live] / share + 1e-9).astype(np.int64), capacity)
        k = np.flatnonzero(config)
        filled = int(sizes[live[k]] @ config[k])
        fullest = max(fullest, filled)
        if not whole and filled < fullest - SLACK * capacity:
            break
        at, many = live[k], config[k]
        used.append((share, at, many))
        left[at] -= many * share
        log_weight[at] -= STEEPNESS * many * share / demand[at]
        live = live[left[live] >= share * (1 - 1e-9)]
        t += 1
    return used


def solve(histogram: dict[int, int], capacity: int) -> Plan:
    """histogram: number of items by length, 1 to capacity. Items as long as a container get one each."""
    rows, base = [], int(histogram.get(capacity, 0))
    if base:
        rows.append((capacity, 0, 0, 1))
    sizes = np.array(sorted((s for s in histogram if 0 < s < capacity and histogram[s] > 0), reverse=True), np.int64)
    total = np.array([histogram[s] for s in sizes], np.int64)
    left, tokens = total.copy(), float(sizes @ total)
    while (live := np.flatnonzero(left)).size:
        behind = left[live] / total[live] * (tokens / float(sizes @ left)) - 1
        for share, at, many in program(sizes[live], left[live], capacity, np.minimum(BEHIND * behind, STEEPNESS)):
            whole, at = int(share), live[at]  # rounded down; the rest of the share stays for the next program
            for s, m in zip(at, many, strict=True):
                rows.append((int(sizes[s]), int(total[s] - left[s]), base, int(m)))
                left[s] -= m * whole
            base += whole
    rows.sort()
    size, first, at, each = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    lengths = np.array(sorted(s for s in histogram if 0 < s <= capacity and histogram[s] > 0), np.int64)
    return Plan(size, first, at, each, base, lengths, np.r_[0, np.cumsum([histogram[s] for s in lengths])][:-1].astype(np.int64))


def pieces(items: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(size_name, doc_id, piece_no, n_tokens): each item for each capacity; only items longer than it in several pieces, all but the last full."""
    parts = [F.struct(F.lit(k).alias("size_name"), F.lit(int(c)).cast("long").alias("capacity")) for k, c in sorted(capacities.items())]
    each = items.select("doc_id", F.col("n_tokens").cast("long").alias("n"), F.explode(F.array(*parts)).alias("c")).select("doc_id", "n", "c.*")
    last = F.greatest(F.expr("(n - 1) div capacity"), F.lit(0))
    each = each.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return each.select("size_name", "doc_id", F.col("piece_no").cast("int").alias("piece_no"), F.least(F.col("n") - F.col("piece_no") * F.col("capacity"), "capacity").alias("n_tokens"))


def pack(items: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(size_name, doc_id, piece_no int, n_tokens long, container_id long): items (doc_id, n_tokens) in containers of every capacity.

    Every item is whole in one container, but for those longer than the capacity, which are divided. Items without tokens
    (or with a null or negative number of them) take no room and stand in container 0. Repeated ids are items of their own. An empty
    table gives no rows. Capacities are 1 or more.
    """
    if any(c < 1 for c in capacities.values()):
        raise ValueError("a capacity is 1 or more")
    cut = storage.cut(pieces(items.select("doc_id", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).alias("n_tokens")), capacities), "pieces")
    counted = cut.groupBy("size_name", "n_tokens").count().collect()  # at most one row for each length up to the capacities
    plans = {name: solve({r["n_tokens"]: r["count"] for r in counted if r["size_name"] == name}, c) for name, c in capacities.items()}
    buckets = max(1, -(-max((r["count"] for r in counted), default=1) // RANKED))
    return _assign(cut, plans, buckets)


def _assign(cut: DataFrame, plans: dict[str, Plan], buckets: int) -> DataFrame:
    """Ranks the items of each length, in hashed buckets that bound a task, and looks their container up in the plan."""
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)).cast("int"))
    own = F.row_number().over(W.partitionBy("size_name", "n_tokens", "bucket").orderBy("doc_id", "piece_no")) - 1
    ranked = cut.withColumn("own", own)
    if buckets > 1:
        n = cut.groupBy("size_name", "n_tokens", "bucket").count()
        before = F.sum("count").over(W.partitionBy("size_name", "n_tokens").orderBy("bucket")) - F.col("count")
        ranked = ranked.join(n.select("size_name", "n_tokens", "bucket", before.alias("before")), ["size_name", "n_tokens", "bucket"])
    else:
        ranked = ranked.withColumn("before", F.lit(0))
    ranked = ranked.select("size_name", "doc_id", "piece_no", "n_tokens", (F.col("before") + F.col("own")).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = np.array(b.column(0).to_pylist(), object)
            size, rank = b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
            out = np.zeros(len(size), np.int64)
            for name, p in plans.items():
                at = np.flatnonzero((names == name) & (size > 0))
                if not len(at):
                    continue
                out[at] = p.container(size[at], rank[at])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(out)], ["size_name", "doc_id", "piece_no", "n_tokens", "container_id"])

    kind = dict(cut.dtypes)
    return ranked.mapInArrow(place, f"size_name string, doc_id {kind['doc_id']}, piece_no int, n_tokens long, container_id long")


def summary(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(size_name, n_items, n_tokens, n_containers, least_containers, unused_share): least_containers is the bound by volume."""
    room = F.element_at(F.create_map(*[x for k, c in capacities.items() for x in (F.lit(k), F.lit(c))]), F.col("size_name"))
    per = packed.where("n_tokens > 0").groupBy("size_name", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    out = per.groupBy("size_name").agg(F.sum("k").alias("n_items"), F.sum("t").alias("n_tokens"), F.count("*").alias("n_containers"), F.max("t").alias("fullest"))
    return out.select("size_name", "n_items", "n_tokens", "n_containers", F.ceil(F.col("n_tokens") / room).alias("least_containers"), "fullest", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * room), 6).alias("unused_share"))
