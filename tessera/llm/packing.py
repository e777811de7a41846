"""Vector bin packing of token sequences: several limits at once, placed by the dot product.

Examples are dealt by a seeded hash into blocks that one task holds in memory. In a block, a bin
is open until nothing more goes into it: of the examples that fit under every limit, the one whose
demands (tokens, segments, loss-bearing tokens, each as a share of its limit) have the largest dot
product with the room that is left goes next; when none fits, a piece is cut off the largest so
that the bin is full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_small_batches, lean, numbered_copies, small, spare, written
from tessera.llm.tokens import MEMO_ENTRIES, encoder

BLOCK_EXAMPLES = 3_000
BLOCK_BYTES = 12_000_000
#: Partitions that blocks are dealt over at most; a task takes its blocks one after the other.
MOST_PARTITIONS = 50_000
#: Turns of a conversation that make one example at most.
TURNS = 64
SEED = 6


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


#: Instruction data: few long answers bear loss in a sequence.
INSTRUCTIONS = Limits(tokens=1024, segments=16, loss=512)

PACKED = "example_id long, part long, start long, length long, loss long, example_tokens long, sequence_id long, offset long, ids binary"


def place(tokens: list[int], bearing: list[np.ndarray | None], limits: Limits) -> list[tuple[int, int, int, int, int]]:
    """Pieces (example, start, length, bin, offset) for examples of so many tokens; ``bearing``: for
    each example which of its tokens bear loss, or None if all do. Every token lies in one piece;
    each bin keeps all limits."""
    start = np.zeros(len(tokens), np.int64)
    left = np.asarray(tokens, np.int64)
    sums = [None if x is None else np.append(0, np.cumsum(x, dtype=np.int64)) for x in bearing]
    pieces: list[tuple[int, int, int, int, int]] = []
    caps = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
    bins = 0

    def loss_of(i: int, n: int) -> int:
        of = sums[i]
        return n if of is None else int(of[start[i] + n] - of[start[i]])

    def longest(i: int, room: list[int]) -> int:
        """The most tokens of example i that the room takes, from where it starts now."""
        n, of = min(int(left[i]), room[0]), sums[i]
        if of is None:
            return min(n, room[2])
        return min(n, int(np.searchsorted(of, of[start[i]] + room[2], side="right")) - 1 - int(start[i]))

    # what fills a bin alone is cut off first
    for i in range(len(tokens)):
        while left[i] and (n := longest(i, [limits.tokens, 1, limits.loss])) < left[i]:
            pieces.append((i, int(start[i]), n, bins, 0))
            start[i] += n
            left[i] -= n
            bins += 1

    order = np.flatnonzero(left > 0)
    need = left[order]
    loss = np.array([loss_of(int(i), int(n)) for i, n in zip(order, need, strict=True)], np.int64)
    alive = np.ones(len(order), bool)
    remaining = len(order)
    while remaining:
        room, at = [limits.tokens, limits.segments, limits.loss], 0
        while remaining and room[0] and room[1]:
            weight = np.array(room) / caps
            score = need * (weight[0] / caps[0]) + weight[1] / caps[1] + loss * (weight[2] / caps[2])
            score[~(alive & (need <= room[0]) & (loss <= room[2]))] = -1.0
            k = int(score.argmax())
            whole = score[k] >= 0
            if not whole:
                k = int(np.where(alive, need, -1).argmax())
            i = int(order[k])
            n = longest(i, room)
            if not n:
                break
            pieces.append((i, int(start[i]), n, bins, at))
            room[0] -= n
            room[1] -= 1
            room[2] -= loss_of(i, n)
            at += n
            start[i] += n
            left[i] -= n
            if left[i]:
                need[k], loss[k] = left[i], loss_of(i, int(left[i]))
            else:
                alive[k] = False
                remaining -= 1
        bins += 1
    return pieces


def pack(examples: DataFrame, blocks: int, limits: Limits = Limits(), forgets: bool = False) -> DataFrame:
    """Pieces (``PACKED``) of ``examples`` (block long, example_id long, part long, ids binary of
    little-endian numbers of ``width`` bytes, width int, bearing binary), block being below ``blocks``.

    ``bearing``: a byte for each token, not 0 if it bears loss; null if all do. Examples without
    tokens give no piece. sequence_id: the block, then the bin's number in it; offsets in a
    sequence have no gap; ``ids`` of a piece are little-endian uint32, ``loss`` of them bear loss.
    ``forgets``: workers that encoded drop their encoders first.
    """

    def packed(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py()
        names, parts = rows.column("example_id").to_pylist(), rows.column("part").to_pylist()
        order = sorted(range(len(rows)), key=lambda i: (names[i] is None, names[i] or 0, parts[i] is None, parts[i] or 0))
        raw, widths, marks = (rows.column(x).to_pylist() for x in ("ids", "width", "bearing"))
        ids = [np.frombuffer(raw[i] or b"", f"<u{widths[i]}").astype("<u4") for i in order]
        bearing = [None if marks[i] is None else np.frombuffer(marks[i], np.uint8) != 0 for i in order]
        pieces = place([len(x) for x in ids], bearing, limits)
        columns = list(zip(*pieces, strict=True)) or [()] * 5
        return pa.table(
            {
                "example_id": pa.array([names[order[i]] for i in columns[0]], pa.int64()),
                "part": pa.array([parts[order[i]] for i in columns[0]], pa.int64()),
                "start": pa.array(columns[1], pa.int64()),
                "length": pa.array(columns[2], pa.int64()),
                "loss": pa.array([n if bearing[i] is None else int(bearing[i][a : a + n].sum()) for i, a, n, _, _ in pieces], pa.int64()),
                "example_tokens": pa.array([len(ids[i]) for i in columns[0]], pa.int64()),
                "sequence_id": pa.array([(block << 32) + b for b in columns[3]], pa.int64()),
                "offset": pa.array(columns[4], pa.int64()),
                "ids": pa.array([ids[p[0]][p[1] : p[1] + p[2]].tobytes() for p in pieces], pa.binary()),
            }
        )

    def run(rows: pa.Table) -> pa.Table:
        with spare("" if forgets else "tokens"):
            return packed(rows)

    partitions = min(blocks, MOST_PARTITIONS)
    dealt = examples.withColumn("partition", F.pmod("block", F.lit(partitions)).cast("int")).repartitionById(partitions, "partition")
    return dealt.groupBy("partition", "block").applyInArrow(run, PACKED)


def blocks_for(df: DataFrame, text: str = "text") -> int:
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return max(1, math.ceil(rows / BLOCK_EXAMPLES), math.ceil(size / BLOCK_BYTES))


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int = 0, limits: Limits = Limits(), seed: int = SEED, memo_entries: int = MEMO_ENTRIES) -> DataFrame:
    """Packs the tokens of ``documents`` (doc_id, text), each with ``end_id`` at its end.

    A null text counts as empty: its document is the end id alone. Null ids, repeated rows and
    ties keep a piece each, and very many equal rows are dealt over the blocks; very long documents
    are cut; an empty table gives no piece; other columns are ignored. Every token bears loss.
    ``memo_entries``: words that a Python worker remembers; where that is fewer than usual, it
    forgets its encoder before it packs.
    """
    rows = in_small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    n = blocks_for(rows)
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text", "copy"), F.lit(n))
    dealt = numbered_copies(rows).select(block.alias("block"), F.col("doc_id").alias("example_id"), "text")

    @lean("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, entries=memo_entries)
        end = np.array([end_id], encode.dtype).tobytes()
        for batch in batches:
            ids = [x + end for x in encode.encode(batch.column(2).to_pylist())]
            width = pa.array(np.full(len(ids), encode.dtype.itemsize, np.int32))
            nothing = pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nothing[0], pa.array(ids, pa.binary()), width, nothing[1]], EXAMPLES)

    return pack(dealt.mapInArrow(run, EXAMPLE_TYPES), n, limits, forgets=memo_entries < MEMO_ENTRIES)


EXAMPLES = ["block", "example_id", "part", "ids", "width", "bearing"]
EXAMPLE_TYPES = "block long, example_id long, part long, ids binary, width int, bearing binary"


def _examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, turns array<struct<turn, role, text>>): ``TURNS`` turns or fewer, in order.

    Turns that several different rows of a conversation claim, and rows without conversation or
    turn, are examples of their own.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    named = "conv_id is not null and turn is not null"
    several = written(rows.where(named).groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where("n > 1").select("conv_id", "turn"))
    said = F.struct("turn", "role", "text")
    apart = rows.where(f"not ({named})").unionByName(rows.where(named).join(small(several), ["conv_id", "turn"], "left_semi"))
    apart = apart.select("conv_id", F.col("turn").alias("part"), F.array(said).alias("turns"))
    orderly = rows.where(named).join(small(several), ["conv_id", "turn"], "left_anti")
    first = (F.floor(F.col("turn") / TURNS) * TURNS).alias("part")
    return orderly.groupBy("conv_id", first).agg(F.sort_array(F.collect_list(said)).alias("turns")).unionByName(apart)


def pack_conversations(conversations: DataFrame, tokenizer: str, end_id: int = 0, limits: Limits = INSTRUCTIONS, bears_loss: str = "assistant", seed: int = SEED) -> DataFrame:
    """Packs ``conversations`` (conv_id, turn, role, text): the tokens of a conversation's turns in
    their order, each turn with ``end_id`` at its end; those of the role ``bears_loss`` bear loss.

    An example is a conversation's turns from number ``part`` on, ``TURNS`` of them or fewer. Equal
    rows are one; turns that different rows claim and rows without conversation or turn are
    examples of their own; null texts count as empty, null roles bear no loss; an empty table gives
    no piece; other columns are ignored.
    """
    examples = in_small_batches(_examples(conversations))
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.coalesce(F.octet_length(t["text"]), F.lit(0)))
    rows, total = examples.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    n = max(1, math.ceil(rows / BLOCK_EXAMPLES), math.ceil(total / BLOCK_BYTES))
    block = F.pmod(F.xxhash64(F.lit(seed), "conv_id", "part", "turns"), F.lit(n))
    texts, roles = F.transform("turns", lambda t: t["text"]), F.transform("turns", lambda t: F.coalesce(t["role"] == bears_loss, F.lit(False)))
    dealt = examples.select(block.alias("block"), "conv_id", "part", texts.alias("texts"), roles.alias("bears"))

    @lean("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], encode.dtype).tobytes()
        for batch in batches:
            texts, bears = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            flat = iter([x + end for x in encode.encode([t for of in texts for t in of])])
            each = [[next(flat) for _ in of] for of in texts]
            marks = [np.repeat(np.array(b, np.uint8), [len(x) // encode.dtype.itemsize for x in of]).tobytes() for of, b in zip(each, bears, strict=True)]
            width = pa.array(np.full(len(each), encode.dtype.itemsize, np.int32))
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array([b"".join(x) for x in each], pa.binary()), width, pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, EXAMPLES)

    return pack(dealt.mapInArrow(run, EXAMPLE_TYPES), n, limits)
