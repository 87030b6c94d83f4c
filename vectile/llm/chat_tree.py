"""Conversations as one prefix tree of tokens: shared first turns once, depth-first, with what each turn attends to.

Conversations are sorted by their turns' digests, so those that share first turns stand together, and each gives only
the turns that the one before doesn't have: that is the tree in depth-first order. A turn's tokens stand at ``offset`` of
the whole output; their position ids count from ``position``; they attend to the ranges ``attends`` of the output, the
turns above them, and to what stands before them in their own turn. Ranges that touch are one, so a conversation
without branches has one, however long it is.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectile.llm import words as W
from vectile.llm.joins import attached
from vectile.llm.tokens import Encoder
from vectile.llm.turn_order import Sorted, conversation_turns, over_blocks, sequence, shared_with_previous, sort_sequences, turn_digest
from vectile.session import cut

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
# Fixed strings by which chat templates mark turns, without the first character; the last stands for all of that kind.
CONTROLS = [r"/?s>", r"/?INST\]", r"/?<?/?SYS>>", r"\|[A-Za-z0-9_]+\|>"]
_CONTROL = rf"(?:{'|'.join(CONTROLS)})"
_TURN = re.compile(re.escape(BEGIN) + r"([^\n]*)\n(.*)" + re.escape(END), re.DOTALL)
_ESCAPED = re.compile(rf"([<\[])\\(\\*{_CONTROL})")
_ROLE = re.compile(r"\\(.)")
PAGE = 1 << 14  # tokens of the output that a page of the reader's join holds

_SPAN = "array<struct<start:bigint,end:bigint>>"
_ENCODED = "conv {conv}, turn {turn}, role string, digest string, ids binary, n bigint, body_from int, body_to int"
_RUN = f"name string, conv {{conv}}, lcp int, n_turns int, offset bigint, shared bigint, n_tokens bigint, attends {_SPAN}"


def escaped(text: Column) -> Column:
    """A backslash behind the first character of every control string; those that have some get one more."""
    return F.regexp_replace(text, rf"([<\[])(\\*{_CONTROL})", r"$1\\$2")


def escaped_role(role: Column) -> Column:
    """As ``escaped``, in one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def unescaped_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def _encoded(rows: DataFrame, vocabulary: str, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Every row's turn as token ids: its head, its text and its end each on their own, so that a text's tokens are just its."""
    encoder = Encoder(vocabulary)
    flat = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    flat = flat.select("conv", "turn", "role", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.concat(F.lit(BEGIN), escaped_role(F.col("role")), F.lit("\n")).alias("head"), escaped(F.col("text")).alias("text"))

    def run(batches):
        tail = None
        for batch in batches:
            if tail is None:
                tail = encoder.encode(pa.array([END]))[0]
            for part in W.pieces(batch, "text"):
                found = [encoder.encode(part.column(c)) for c in ("head", "text")]
                sizes = [np.diff(bounds) for _, bounds in found] + [np.full(part.num_rows, len(tail))]
                total = np.sum(sizes, axis=0)
                ends = np.cumsum(total)
                ids = np.empty(int(total.sum()), dtype=np.uint32)
                at = ends - total
                for (values, _), size in zip([*found, (np.tile(tail, part.num_rows), None)], sizes, strict=True):
                    ids[W.ranges(at, size)] = values
                    at = at + size
                bounds = 4 * np.concatenate([[0], ends])
                blob = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                cols = {c: part.column(c) for c in ("conv", "turn", "role", "digest")}
                yield pa.RecordBatch.from_pydict(cols | {"ids": blob, "n": pa.array(total, pa.int64()), "body_from": pa.array(sizes[0], pa.int32()), "body_to": pa.array(sizes[0] + sizes[1], pa.int32())})

    kind = {c: flat.schema[c].dataType.simpleString() for c in ("conv", "turn")}
    return flat.mapInArrow(run, _ENCODED.format(**kind))


class _Stack:
    """The path to the place reached in the tree: (tokens above, offset) of every stretch that doesn't follow on."""

    def __init__(self, entries: list[tuple[int, int]]):
        self.entries = list(entries)

    def back_to(self, tokens: int) -> None:
        while self.entries and self.entries[-1][0] >= tokens:
            self.entries.pop()

    def spans(self, tokens: int) -> list[dict]:
        ends = [*[t for t, _ in self.entries[1:]], tokens]
        return [{"start": o, "end": o + e - t} for (t, o), e in zip(self.entries, ends, strict=False)]

    def put(self, tokens: int, offset: int) -> None:
        if not self.entries or self.entries[-1][1] + tokens - self.entries[-1][0] != offset:
            self.entries.append((tokens, offset))


def _lengths(table: pa.Table, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shared turns, turns, shared tokens, tokens) of a block's sequences."""
    lcp, size, start = shared_with_previous(table.column("seq"), max(first, 0))
    run = np.concatenate([[0], np.cumsum(table.column("tokens").combine_chunks().flatten().to_numpy())])
    return lcp, size, run[start + lcp] - run[start], run[start + size] - run[start]


def _runs(ordered: Sorted, conv_type: str) -> DataFrame:
    """What each sequence adds to the tree, where it stands and what it attends to above."""
    lcp = ordered.lcp

    def walk(table: pa.Table, first: int, stack: _Stack, offset: int):
        shared_turns, turns, shared, tokens = _lengths(table, first)
        for k in range(len(turns)):
            stack.back_to(int(shared[k]))
            yield int(shared_turns[k]), int(turns[k]), offset, int(shared[k]), int(tokens[k]), stack.spans(int(shared[k]))
            if tokens[k] > shared[k]:
                stack.put(int(shared[k]), offset)
            offset += int(tokens[k] - shared[k])

    def summary(block: int, table: pa.Table) -> pa.Table:
        _, _, shared, tokens = _lengths(table, lcp[block])
        stack = _Stack([])
        for _ in walk(table, lcp[block], stack, 0):
            pass
        row = {"block": block, "least": int(shared.min()), "added": int((tokens - shared).sum()), "at": [t for t, _ in stack.entries], "offset": [o for _, o in stack.entries]}
        return pa.Table.from_pylist([row], schema=pa.schema([("block", pa.int64()), ("least", pa.int64()), ("added", pa.int64()), ("at", pa.list_(pa.int64())), ("offset", pa.list_(pa.int64()))]))

    told = sorted(over_blocks(ordered, summary, "block long, least long, added long, at array<long>, offset array<long>").collect(), key=lambda r: r["block"])
    starts, stack, offset = [], _Stack([]), 0  # the path at the start of each block: as many stretches as it has branches
    for r in told:
        starts.append((list(stack.entries), offset))
        stack.back_to(r["least"])
        for t, o in zip(r["at"], r["offset"], strict=True):
            stack.put(t, offset + o)
        offset += r["added"]

    def place(block: int, table: pa.Table) -> pa.Table:
        entries, at = starts[block]
        rows = list(zip(*walk(table, lcp[block], _Stack(entries), at), strict=True))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        cols = [pa.array(list(c), k) for c, k in zip(rows, kinds, strict=True)]
        return pa.table([table.column("name"), table.column("conv"), *cols], names=["name", "conv", "lcp", "n_turns", "offset", "shared", "n_tokens", "attends"])

    return over_blocks(ordered, place, _RUN.format(conv=conv_type))


def write_chat_tree(
    rows: DataFrame, path: str, vocabulary: str, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant",
) -> None:
    """Three tables under ``path``.

    ``turns``, in depth-first order: offset, n_tokens, position, depth, role, loss (the role is ``learn``), body_from and
    body_to (the tokens of the text within the turn), ids (little-endian unsigned 32-bit), attends. ``sequences``: sequence,
    n_turns, n_tokens, attends with the own turns, one row for each distinct sequence of turns. ``conversations``: conv_id,
    sequence.

    A conversation's turns are ordered by turn, null first, ties by digest; repeated rows are turns of their own; null
    role and text are empty; rows without a conversation id are one conversation. An empty table gives empty tables.
    Control strings in texts and roles are escaped (``unescaped``). Other columns aren't read.
    """
    encoded = cut(_encoded(rows, vocabulary, conv_col, turn_col, role_col, text_col))
    conv_type = encoded.schema["conv"].dataType.simpleString()
    seqs = conversation_turns(encoded, "n", conv="conv").select("conv", sequence("turns").alias("seq"), F.transform("turns", lambda x: x["n"]).alias("tokens"))
    seqs = cut(seqs.withColumn("name", F.md5("seq")))
    order = F.struct(F.col("conv").isNull().alias("none"), "conv")
    distinct = cut(seqs.groupBy("name").agg(F.any_value("seq").alias("seq"), F.any_value("tokens").alias("tokens"), F.min(order)["conv"].alias("conv")))
    ordered = sort_sequences(distinct, int(distinct.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]))
    runs = cut(_runs(ordered, conv_type)) if ordered.parts else rows.sparkSession.createDataFrame([], _RUN.format(conv=conv_type))
    within = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "digest")
    placed = encoded.withColumn("depth", F.row_number().over(within)).withColumn("position", F.coalesce(F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = runs.select(F.col("conv").alias("own"), "lcp", F.col("offset").alias("run_offset"), "shared", "attends")
    new = placed.join(run.hint("merge"), F.col("conv").eqNullSafe(F.col("own"))).where(F.col("depth") > F.col("lcp"))
    offset = F.col("run_offset") + F.col("position") - F.col("shared")
    turns = new.select(
        offset.alias("offset"), F.col("n").alias("n_tokens"), "position", "depth", "role", (F.col("role") == learn).alias("loss"), "body_from", "body_to", "ids",
        _with(F.col("attends"), F.col("run_offset"), offset).alias("attends"),
    )
    turns.repartitionByRange("offset").sortWithinPartitions("offset").write.parquet(f"{path}/turns")
    own = _with(F.col("attends"), F.col("offset"), F.col("offset") + F.col("n_tokens") - F.col("shared"))
    runs.select(F.col("name").alias("sequence"), "n_turns", "n_tokens", own.alias("attends")).write.parquet(f"{path}/sequences")
    seqs.select(F.col("conv").alias("conv_id"), F.col("name").alias("sequence")).write.parquet(f"{path}/conversations")


def _with(spans: Column, start: Column, end: Column) -> Column:
    """The ranges and one more, which may be empty or follow on from the last."""
    last = F.element_at(spans, -1)
    one = lambda a: F.array(F.struct(a.alias("start"), end.alias("end")))
    joined = F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), one(last["start"]))
    return F.when(start >= end, spans).when((F.size(spans) > 0) & (F.try_element_at(spans, F.lit(-1))["end"] == start), joined).otherwise(F.concat(spans, one(start)))


def read_chat_tree(spark: SparkSession, path: str, vocabulary: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation, from the files.

    Ids are decoded and parsed turn by turn; a sequence's turns are those that lie in the ranges it attends to. Turns meet
    ranges page by page. Every distinct sequence is read once, its copies take its row.
    """
    turns = spark.read.parquet(f"{path}/turns")

    def decode(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        text_of = lru_cache(1 << 12)(lambda ids: tokenizer.decode(np.frombuffer(ids, np.uint32).tolist(), skip_special_tokens=False))  # heads and ends are few
        for batch in batches:
            blobs, loss, lo, hi = (batch.column(c).to_pylist() for c in ("ids", "loss", "body_from", "body_to"))
            bodies = tokenizer.decode_batch([np.frombuffer(x, np.uint32)[a:b].tolist() for x, a, b in zip(blobs, lo, hi, strict=True)], skip_special_tokens=False)
            texts = [text_of(x[: 4 * a]) + body + text_of(x[4 * b :]) for x, a, body, b in zip(blobs, lo, bodies, hi, strict=True)]
            parsed = [_TURN.fullmatch(t) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "offset": batch.column("offset"), "role": [unescaped_role(m[1]) for m in parsed], "text": [unescaped(m[2]) for m in parsed],
                "learnt": [unescaped(x) if k else "" for x, k in zip(bodies, loss, strict=True)], "chars": pa.array([len(t) for t in texts], pa.int64()),
            })

    read = turns.select("offset", "ids", "loss", "body_from", "body_to").mapInArrow(decode, "offset long, role string, text string, learnt string, chars long")
    read = read.withColumn("page", F.floor(F.col("offset") / PAGE))
    spans = spark.read.parquet(f"{path}/sequences").select("sequence", F.explode("attends").alias("x")).select("sequence", "x.*")
    spans = spans.withColumn("page", F.explode(F.sequence(F.floor(F.col("start") / PAGE), F.floor((F.col("end") - 1) / PAGE))))
    met = spans.join(read.hint("merge"), "page").where((F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end")))

    def digest(batches):
        # rows in order of sequence and place; a conversation is a few counters, however long it is
        name, turns, loss, n = None, None, None, None
        done = lambda: (name, n[0], turns.hexdigest(), n[1], loss.hexdigest(), n[2])
        cols = ["sequence", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            out = []
            for at, role, text, learnt, chars in zip(*(batch.column(c).to_pylist() for c in ("sequence", "role", "text", "learnt", "chars")), strict=True):
                if at != name:
                    if name is not None:
                        out.append(done())
                    name, turns, loss, n = at, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(learnt.encode())
                n[0], n[1], n[2] = n[0] + 1, n[1] + len(learnt), n[2] + chars
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(cols, map(list, zip(*out, strict=True)), strict=True)))
        if name is not None:
            yield pa.RecordBatch.from_pydict(dict(zip(cols, ([x] for x in done()), strict=True)))

    ordered = met.select("sequence", "offset", "role", "text", "learnt", "chars").repartition("sequence").sortWithinPartitions("sequence", "offset")
    per = cut(ordered.mapInArrow(digest, "sequence string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))
    return attached(spark.read.parquet(f"{path}/conversations"), per, "sequence").drop("sequence")
