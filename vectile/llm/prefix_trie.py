"""The trie of conversation prefixes from the sorted sequences alone: ranges, not nodes, are looked up.

lcp[i] is the number of turns that sorted sequence i shares with the one before. A prefix of d turns first occurs at the
i with lcp[i] < d <= length[i]; its members are i and all after it up to the first with lcp < d. That end, and both ends
of its parent's range, are found by binary search over a sparse table of minima, each candidate on its own; what a node
reports are sums and minima over its range. Ranges that leave a block go on over a sparse table of the blocks, and end
in a block that says how far a prefix of each depth reaches into it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectile.llm import words as W
from vectile.llm.turn_order import Minima, Sorted, conversation_turns, over_blocks, sequence, shared_with_previous, sort_sequences, turn_digest
from vectile.session import cut

ID_CHUNK = 1 << 16  # ids whose list one row of a group holds
EVERY = 100  # conversations that share a root
HEADS = 6
NONE = hashlib.sha256().hexdigest()
FAR = np.iinfo(np.int64).max

_RANGE = "n_convs long, text_all long, text_once long, n_leaves long, n_children long, least long"
_NODE = f"kind int, block int, depth long, {_RANGE}, base long, next_block int, parent_block int, parent long, ends string"


def rebuilt(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): each conversation with the first h turns of the one at the hundred below in place of its own.

    h = crc32(conv) % 6, the conversation at the hundred is conv - conv % 100. If that one is shorter it gives all it has,
    if it is absent nothing; the conversation's own turns follow from the h-th on, so there may be none at all. Turns are
    ordered by turn, null first, ties by digest; null role and text are empty; rows without a conversation are left out.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    turns = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), turn_digest(F.col(role), F.col(text)).alias("digest"), F.length(body).cast("bigint").alias("chars"))
    own = cut(conversation_turns(turns, "chars"))
    first = F.col("conv") - F.col("conv") % EVERY
    heads = own.where(first == F.col("conv")).select(F.col("conv").alias("first"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv").cast("string")) % HEADS).cast("int")
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    joined = own.withColumn("first", first).join(heads, "first", "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    return joined.select("conv", F.concat(head, rest).alias("turns"))


def _chunked_digests(members: DataFrame) -> DataFrame:
    """(name, ends): SHA-256 of the ascending comma-joined ids of each name. A long list is hashed in pieces, in order,
    from rows that hold the ids of one range each; no list is ever whole."""
    ids = members.groupBy("name", F.floor(F.col("conv") / ID_CHUNK).alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))

    def digest(batches):
        name, state = None, None
        for batch in batches:
            out = []
            for at, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if at != name:
                    if name is not None:
                        out.append((name, state.hexdigest()))
                    name, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_pydict({"name": [x[0] for x in out], "ends": [x[1] for x in out]})
        if name is not None:
            yield pa.RecordBatch.from_pydict({"name": [name], "ends": [state.hexdigest()]})

    return ids.repartition("name").sortWithinPartitions("name", "chunk").mapInArrow(digest, "name string, ends string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row a node.

    ``conversations`` (conv, turns): distinct long ids, turns as structs with digest and chars. A node is a distinct
    sequence of first turns, the root of none included; members are the conversations that begin with it. ``conv_id`` and
    ``parent_conv_id`` are smallest members, ``saved_tokens`` sums (n_convs - 1) times the characters of the last turn
    over the subtree, ``ends_sha256`` is that of the ids of members without further turns. An empty table gives no rows.
    """
    seqs = conversations.select("conv", sequence("turns").alias("seq"), F.transform("turns", lambda x: x["chars"]).alias("chars")).withColumn("name", F.md5("seq"))
    seqs = cut(seqs)
    groups = seqs.groupBy("name").agg(F.any_value("seq").alias("seq"), F.any_value("chars").alias("chars"), F.count(F.lit(1)).alias("mult"), F.min("conv").alias("least"))
    groups = cut(groups.join(_chunked_digests(seqs.select("name", "conv")), "name").drop("name"))
    ordered = sort_sequences(groups, int(groups.agg(F.coalesce(F.sum(F.size("chars")), F.lit(0))).first()[0]))
    if not ordered.lcp:
        return _finished(groups.sparkSession.createDataFrame([], _NODE))
    return _finished(cut(_nodes(ordered)))


class _Block:
    """The sequences of a block: lengths, shared turns, running sums of what nodes report."""

    def __init__(self, table: pa.Table, first: int, after: int):
        self.lcp, self.size, start = shared_with_previous(table.column("seq"), max(first, 0))
        self.n = len(self.size)
        chars = table.column("chars").combine_chunks()
        flat = chars.flatten().to_numpy() if self.n else np.zeros(0, np.int64)
        self.run = np.concatenate([[0], np.cumsum(flat)])
        self.start = start
        self.mult, self.least = table.column("mult").to_numpy(), table.column("least").to_numpy()
        self.after = np.append(self.lcp[1:], after)
        self.low, self.ids = Minima(self.lcp), Minima(self.least)
        whole = self.chars(np.arange(self.n), self.size)
        sums = (self.mult, self.mult * whole, whole - self.chars(np.arange(self.n), self.lcp), (self.after < self.size).astype(np.int64))
        self.sums = [np.concatenate([[0], np.cumsum(x)]) for x in sums]
        self.by_lcp = np.sort(_key(self.lcp, np.arange(self.n)))

    def chars(self, i: np.ndarray, turns: np.ndarray) -> np.ndarray:
        return self.run[self.start[i] + turns] - self.run[self.start[i]]

    def total(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> list[np.ndarray]:
        """Members, characters of all and of each node once, leaves, children at that depth, and the least id of [lo, hi)."""
        out = [s[hi] - s[lo] for s in self.sums]
        children = np.searchsorted(self.by_lcp, _key(depth, hi)) - np.searchsorted(self.by_lcp, _key(depth, lo))
        least = np.full(len(lo), FAR)
        some = hi > lo
        least[some] = self.ids.least(lo[some], hi[some])
        return [*out, children, least]


def _key(lcp: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (lcp.astype(np.int64) << 32) + at


def _nodes(ordered: Sorted) -> DataFrame:
    lcp = np.array(ordered.lcp, dtype=np.int64)
    after = np.append(lcp[1:], -1)

    def summary(block: int, table: pa.Table) -> pa.Table:
        b = _Block(table, int(lcp[block]), int(after[block]))
        inner = int(b.lcp[1:].min(initial=FAR))
        first = int(block == 0)
        sums = b.total(np.array([0]), np.array([b.n]), np.array([0]))
        low = min(inner, int(b.lcp[0]))
        # children of the root: sequences that share no turn with the one before; the very first unless it has no turn
        roots = int(sums[4][0]) - int(first and b.size[0] == 0)
        ends = table.column("ends")[0].as_py() if first and b.size[0] == 0 else None
        values = [block, inner, low, int((b.lcp == low).sum()), roots, ends, *[int(sums[k][0]) for k in (0, 1, 2, 3, 5)]]
        return pa.Table.from_pylist([dict(zip(names, values, strict=True))], schema=pa.schema([(c, pa.string() if c == "ends" else pa.int64()) for c in names]))

    names = ["block", "inner", "low", "n_low", "roots", "ends", "n_convs", "text_all", "text_once", "n_leaves", "least"]
    schema = ", ".join(f"{c} {'string' if c == 'ends' else 'long'}" for c in names)
    told = sorted(over_blocks(ordered, summary, schema).collect(), key=lambda r: r["block"])
    column = lambda c: np.array([r[c] for r in told], dtype=np.int64)
    inner, low = column("inner"), column("low")
    sums = [np.concatenate([[0], np.cumsum(column(c))]) for c in ("n_convs", "text_all", "text_once", "n_leaves")]
    many = np.argsort(_key(low, np.arange(len(low))))
    key, count = _key(low, np.arange(len(low)))[many], np.concatenate([[0], np.cumsum(column("n_low")[many])])
    ids, left, right = Minima(column("least")), Minima(low), Minima(np.minimum(inner, after))
    root = [int(s[-1]) for s in sums] + [int(column("roots").sum()), int(column("least").min())]
    root_ends = told[0]["ends"]

    def nodes(block: int, table: pa.Table) -> pa.Table:
        b = _Block(table, int(lcp[block]), int(after[block]))
        own = b.size - b.lcp
        i = np.repeat(np.arange(b.n), own)
        depth = W.ranges(b.lcp + 1, own)
        end = b.low.reach_right(i + 1, depth)
        total = b.total(i, end, depth)
        total[4] += b.size[i] > depth  # the chain that goes on in i itself
        base = b.chars(i, depth - 1)
        total[2] += b.chars(i, b.lcp[i]) - base  # of i's own nodes only those from this one on
        open_ = (end == b.n) & (after[block] >= depth)
        next_block = np.full(len(i), -1)
        if open_.any():
            d = depth[open_]
            stop = right.reach_right(np.full(len(d), block + 1), d)
            next_block[open_] = stop
            lo, hi = np.full(len(d), block + 1), stop
            for t, s in zip(total, sums, strict=False):
                t[open_] += s[hi] - s[lo]
            total[4][open_] += count[np.searchsorted(key, _key(d, hi))] - count[np.searchsorted(key, _key(d, lo))]
            some = hi > lo
            far = np.full(len(d), FAR)
            far[some] = ids.least(lo[some], hi[some])
            total[5][open_] = np.minimum(total[5][open_], far)
        # the parent's range, searched on its own to both sides
        up = depth - 1
        inside = up > 0
        head, tail = b.low.reach_left(i, up), b.low.reach_right(i + 1, up)
        away = inside & ((head < 0) | ((tail == b.n) & (after[block] >= up)))
        parent = np.full(len(i), root[5])
        here = inside & ~away
        parent[here] = b.ids.least(head[here], tail[here])
        parent_block = np.full(len(i), -1)
        parent_block[away] = block
        outside = away & (head < 0)
        if outside.any():
            parent_block[outside] = left.reach_left(np.full(int(outside.sum()), block - 1), up[outside])
        ends = table.column("ends").combine_chunks().take(pa.array(np.where(b.size[i] == depth, i, 0)))
        ends = pc.if_else(pa.array(b.size[i] == depth), ends, pa.scalar(None, pa.string())) if len(i) else ends
        # how far prefixes that come from earlier blocks reach into this one
        d = np.arange(1, max(int(lcp[block]), 0) + 1)
        reach = b.low.reach_right(np.ones(len(d), np.int64), d)
        inward = b.total(np.zeros(len(d), np.int64), reach, d)
        zero = np.zeros(len(d), np.int64)
        top = int(block == 0)
        cols = {
            "kind": np.concatenate([np.zeros(len(i) + top), zero + 1]), "block": np.full(len(i) + top + len(d), block), "depth": np.concatenate([np.zeros(top), depth, d]),
            **{c: np.concatenate([[root[k]] * top, total[k], inward[k]]) for k, c in enumerate(("n_convs", "text_all", "text_once", "n_leaves", "n_children", "least"))},
            "base": np.concatenate([np.zeros(top), base, zero]), "next_block": np.concatenate([-np.ones(top), next_block, zero - 1]),
            "parent_block": np.concatenate([-np.ones(top), parent_block, zero - 1]),
        }
        none = np.concatenate([np.ones(top, bool), np.zeros(len(i), bool), np.ones(len(d), bool)])
        int32 = {"kind", "block", "next_block", "parent_block"}
        out = {c: pa.array(v.astype(np.int32 if c in int32 else np.int64)) for c, v in cols.items()}
        out["parent"] = pa.array(np.concatenate([np.zeros(top), parent, zero]).astype(np.int64), mask=none)
        out["ends"] = pa.concat_arrays([pa.array([root_ends] * top, pa.string()), ends, pa.nulls(len(d), pa.string())])
        return pa.table(out)

    return over_blocks(ordered, nodes, _NODE)


def _finished(nodes: DataFrame) -> DataFrame:
    """Ranges that end in another block get its part; nodes under such a range get its least id."""
    own = nodes.where("kind = 0")
    within = nodes.where("kind = 1").select(F.col("block").alias("next_block"), "depth", *[F.col(c).alias(f"{c}_in") for c in ("n_convs", "text_all", "text_once", "n_leaves", "n_children", "least")])
    crossing = own.where("next_block >= 0").join(within, ["next_block", "depth"])
    added = {c: F.col(c) + F.col(f"{c}_in") for c in ("n_convs", "text_all", "text_once", "n_leaves", "n_children")} | {"least": F.least("least", "least_in")}
    crossing = cut(crossing.withColumns(added).select(*own.columns))
    whole = own.where("next_block < 0").unionByName(crossing)
    heads = crossing.select(F.col("block").alias("parent_block"), (F.col("depth") + 1).alias("depth"), F.col("least").alias("above"))
    whole = whole.join(heads, ["parent_block", "depth"], "left")
    return whole.select(
        F.col("least").alias("conv_id"), "depth", F.when(F.col("parent_block") >= 0, F.col("above")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", (F.col("text_all") - F.col("n_convs") * F.col("base") - F.col("text_once")).alias("saved_tokens"), F.coalesce("ends", F.lit(NONE)).alias("ends_sha256"),
    )
