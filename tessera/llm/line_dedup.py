"""Repeated passages: content-defined chunks of lines, found by hash, compared by bytes, removed.

A text's lines end at line breaks and sentence ends; a line of more words than ``WRAP_WORDS`` is
also cut inside, at places that its content chooses, so that a passage in the middle of a
paragraph has lines of its own. A rolling hash over each two lines that follow each other says
whether their meeting is an even or an odd boundary. A chunk reaches from a boundary to the next
one of its kind, both lines of either included; the text's ends count as boundaries of both
kinds. A boundary depends on two lines alone, so the same lines are cut alike wherever they stand.
Of any three boundaries two are of one kind: of four or more lines that two texts share, all but
one at an edge lie in shared chunks.

What a chunk's place and the place that stays have in common goes on by one line where the lines
before both, or after both, are the same: so all lines of such a passage go.

Chunks have ``LEAST_LINES`` lines or more. Of the places that hold the same chunk the first stays:
the least doc_id, then text hash, then place. So every line that is removed stands, byte for byte,
at an earlier place that stays.

Hashes alone cut nothing: a chunk's hash counts where it stands for one row of line hashes, and
each of these for one line, whose bytes are compared. What a text repeats of itself is found where
the text is; only the first place of a chunk in each text goes on to be compared with other texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm.common import Scratch, in_small_batches, lean, small, written
from tessera.llm.hash_filter import filter_of, passes

LEAST_LINES = 3
#: Lines of more words are cut inside, where a place's hash is less than those of as many places
#: on each side. Where writing has no spaces, so many bytes count as a word.
WRAP_WORDS, WRAP_REACH = 16, 5
BYTES_A_WORD = 9
#: Bytes of texts that are cut at once.
SLICE_BYTES = 1 << 21

_SPACE, _BREAK = 32, 10
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[_SPACE, _BREAK]] = True
#: Stops and commas of Chinese and Japanese in UTF-8.
_WIDE_STOPS = ("。".encode(), "！".encode(), "？".encode())
_WIDE_COMMAS = ("、".encode(), "，".encode(), "；".encode(), "：".encode())
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def _after(data: np.ndarray, letters: tuple[bytes, ...]) -> np.ndarray:
    """Where one of some letters of three bytes ends."""
    out = [np.zeros(0, np.int64)]
    for a, b, c in letters:
        at = np.flatnonzero(data == a)
        at = at[at + 2 < len(data)]
        out.append(at[(data[at + 1] == b) & (data[at + 2] == c)] + 3)
    return np.concatenate(out)


def _line_ends(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ascending ends of the lines of texts that follow each other in ``data``."""
    spaces = np.flatnonzero(data == _SPACE)
    at_end = np.zeros(len(data) + 1, bool)
    stopped = spaces[_STOPS[data[spaces - 1]]]
    at_end[stopped + 1] = True
    at_end[bounds[:-1][data[np.minimum(bounds[:-1], len(data) - 1)] == _SPACE] + 1] = False  # what precedes is another text
    at_end[1:] |= data == _BREAK
    wide = bool((data >= 0xE3).any())
    if wide:
        at_end[_after(data, _WIDE_STOPS)] = True
    at_end[bounds] = True
    at_end[0] = False
    ends = np.flatnonzero(at_end)
    places = np.sort(np.concatenate([spaces + 1, _after(data, _WIDE_COMMAS)])) if wide else spaces + 1
    starts = np.append(0, ends[:-1])
    size = ends - starts
    text = np.searchsorted(bounds, starts, side="right") - 1

    def inside(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places inside of lines, and the number of each one's line."""
        line = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(places, ends, side="right"), prepend=0))
        places = places[: len(line)]
        some = (places < ends[line]) & (places > starts[line])
        return places[some], line[some]

    places, line = inside(places)
    places_in = np.bincount(line, minlength=len(ends))
    long = (places_in >= WRAP_WORDS) | (size > 2 * WRAP_WORDS * BYTES_A_WORD)
    if not long.any():
        return ends
    dense = long & (size > 4 * BYTES_A_WORD * (places_in + 1))
    if dense.any():
        # lines without words are cut between letters, at a quarter of the places between them
        letters, of = inside(np.flatnonzero((data & 0xC0) != 0x80))
        letters = letters[dense[of]]
        places, line = inside(np.union1d(places, letters[(_hash_at(data, letters) & np.uint64(3)) == 0]))
    some = long[line]
    places, line = places[some], line[some]
    some = (places - 8 >= bounds[text[line]]) & (places + 8 <= bounds[text[line] + 1])
    places, line = places[some], line[some]
    if len(places) <= 2 * WRAP_REACH:
        return ends
    hashes = _hash_at(data, places)
    cut = np.zeros(len(places), bool)
    middle = slice(WRAP_REACH, len(places) - WRAP_REACH)
    cut[middle] = True
    for k in range(-WRAP_REACH, WRAP_REACH + 1):
        if k:
            other = slice(WRAP_REACH + k, len(places) - WRAP_REACH + k)
            cut[middle] &= (line[middle] == line[other]) & (hashes[middle] < hashes[other])
    at_end[places[cut]] = True
    return np.flatnonzero(at_end)


def _hash_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hashes of the eight bytes before and the eight after each place."""
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, 16)[places] if len(places) else np.zeros((0, 16), np.uint8)
    both = np.ascontiguousarray(around).view("<u8")
    return _mixed(both[:, 0] * _ODD[2] ^ both[:, 1] * _ODD[3])


def _parts(view: memoryview, start: np.ndarray, stop: np.ndarray) -> Iterator[memoryview]:
    return map(view.__getitem__, map(slice, start.tolist(), stop.tolist()))


@dataclass
class Lines:
    """Lines with content of texts that follow each other: the number of the text, the first byte,
    the end of the content, the end of the line with blank lines after it, and the hash.

    Blank lines at a text's start are left out."""

    text: np.ndarray
    start: np.ndarray
    content: np.ndarray
    stop: np.ndarray
    hash: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, bounds: np.ndarray, line_hash: Callable[[bytes], int] = xxh64_intdigest) -> Lines:
        ends = _line_ends(data, bounds) if len(data) else np.zeros(0, np.int64)
        starts = np.append(0, ends[:-1])[: len(ends)]
        content = ends.copy()
        for _ in range(4):  # what is left after so many characters is seldom
            content -= (content > starts) & _BLANK[data[content - 1]]
        if ((content > starts) & _BLANK[data[content - 1]]).any():
            content = np.maximum(starts, np.maximum.accumulate(np.where(_BLANK[data], -1, np.arange(len(data))))[ends - 1] + 1)
        some = content > starts
        starts, content = starts[some], content[some]
        text = np.searchsorted(bounds, starts, side="right") - 1
        follows = np.append(text[1:] == text[:-1], False)[: len(text)]
        stop = np.where(follows, np.append(starts[1:], 0)[: len(starts)], bounds[text + 1])
        view = memoryview(data)
        hashes = np.fromiter(map(line_hash, _parts(view, starts, content)), np.uint64, len(starts))
        return cls(text, starts, content, stop, hashes)

    def doubtful(self, data: np.ndarray) -> np.ndarray:
        """Which lines share their hash with a line here of other bytes."""
        order = np.argsort(self.hash, kind="stable")
        equal = np.flatnonzero(self.hash[order][1:] == self.hash[order][:-1]) if len(order) else order
        a, b = order[equal], order[equal + 1]
        size = self.content - self.start
        view = memoryview(data)
        differ = size[a] != size[b]
        same = np.flatnonzero(~differ)
        one, other = (_parts(view, self.start[x[same]], self.content[x[same]]) for x in (a, b))
        differ[same] = np.fromiter(map(ne, one, other), bool, len(same))
        return np.isin(self.hash, self.hash[a[differ]]) if differ.any() else np.zeros(len(self.hash), bool)

    def beside(self, line: np.ndarray, step: int) -> np.ndarray:
        """The lines before (-1) or after (1) some, or these where their text has none there."""
        if not len(line):
            return line
        other = np.clip(line + step, 0, len(self.text) - 1)
        return np.where(self.text[other] == self.text[line], other, line)

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first line, last line, hash) of the chunks of all texts, by place."""
        n = len(self.text)
        meets = np.flatnonzero(self.text[1:] == self.text[:-1])
        kind = _mixed(self.hash[meets] * _ODD[2] + self.hash[meets + 1] * _ODD[3]) >> np.uint64(63)
        new = np.flatnonzero(np.diff(self.text, prepend=-1))
        last = np.append(new[1:], n)[: len(new)] - 1
        first, end = [], []
        for of in (0, 1):
            boundary = meets[kind == of]
            first.append(np.sort(np.concatenate([new, boundary])))
            end.append(np.sort(np.concatenate([boundary + 1, last])))
        first, end = np.concatenate(first), np.concatenate(end)
        some = end - first >= LEAST_LINES - 1
        # a whole text can be a chunk of both kinds
        first, end = np.divmod(np.unique(first[some] * (n + 1) + end[some]), n + 1)
        powers = np.cumprod(np.full(n + 1, _ODD[0]))
        back = np.cumprod(np.full(n + 1, np.uint64(pow(int(_ODD[0]), -1, 2**64))))
        sums = np.append(np.uint64(0), np.cumsum(_mixed(self.hash) * powers[:n], dtype=np.uint64))
        return first, end, _mixed((sums[end + 1] - sums[first]) * back[first] + (end - first).astype(np.uint64) * _ODD[1])


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, bounds) of some texts after the other; null is empty."""
    texts = texts.fill_null(b"")
    wide = pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def _rows_differ(hashes: np.ndarray, first: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether the hashes from ``first`` to ``end`` are others than those from ``other`` to ``other_end``."""
    size = end - first + 1
    out = size != other_end - other + 1
    alike = np.flatnonzero(~out)
    size = size[alike]
    starts = np.cumsum(size) - size
    if len(alike):
        inside = np.arange(int(size.sum())) - np.repeat(starts, size)
        unequal = hashes[np.repeat(first[alike], size) + inside] != hashes[np.repeat(other[alike], size) + inside]
        out[alike] = np.logical_or.reduceat(unequal, starts)
    return out


@dataclass
class Chunks:
    """The chunks of a slice of texts, by text and place: first and last line, hash, and the first
    chunk of the text that is the same (itself, if there is none before)."""

    lines: Lines
    first: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    origin: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, bounds: np.ndarray, line_hash: Callable[[bytes], int]) -> Chunks:
        lines = Lines.of(data, bounds, line_hash)
        first, end, hashes = lines.chunks()
        usable = np.ones(len(first), bool)
        doubtful = lines.doubtful(data)
        if doubtful.any():
            before = np.append(0, np.cumsum(doubtful))
            usable = before[np.minimum(end + 2, len(lines.hash))] == before[np.maximum(first - 1, 0)]
        first, end, hashes = first[usable], end[usable], hashes[usable]
        in_text = hashes ^ lines.text[first].astype(np.uint64) * _ODD[3]
        by_hash = np.argsort(in_text, kind="stable")
        same = np.append(False, in_text[by_hash][1:] == in_text[by_hash][:-1])[: len(first)]
        origin = np.empty(len(first), np.int64)
        origin[by_hash] = by_hash[np.maximum.accumulate(np.where(same, 0, np.arange(len(first))))] if len(first) else by_hash
        later = np.flatnonzero(origin != np.arange(len(first)))
        differ = lines.text[first[later]] != lines.text[first[origin[later]]]
        differ |= _rows_differ(lines.hash, first[later], end[later], first[origin[later]], end[origin[later]])
        origin[later[differ]] = later[differ]
        return cls(lines, first, end, hashes, origin)

    def repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, stop) of what texts repeat of themselves, with a line on either side that
        does."""
        lines, later = self.lines, np.flatnonzero(self.origin != np.arange(len(self.first)))
        of = self.origin[later]
        ends = []
        for edge, step in ((self.first, -1), (self.end, 1)):
            mine, its = lines.beside(edge[later], step), lines.beside(edge[of], step)
            alike = (mine != edge[later]) & (its != edge[of]) & (lines.hash[mine] == lines.hash[its])
            ends.append(np.where(alike, mine, edge[later]))
        text = lines.text[ends[0]] if len(later) else later
        return merged(text, lines.start[ends[0]], lines.stop[ends[1]])


def merged(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, stop), ascending, of what spans that overlap or adjoin cover together."""
    if not len(text):
        return text, start, stop
    order = np.lexsort((start, text))
    text, start, stop = text[order], start[order], stop[order]
    shift = text.astype(np.int64) << 32  # no text has as many bytes
    reach = np.maximum.accumulate(shift + stop)
    new = np.append(True, (shift + start)[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(text)) - 1
    return text[new], start[new], (reach - shift)[last]


def _chunk_hashes(rows: DataFrame, line_hash: Callable[[bytes], int]) -> DataFrame:
    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, bounds in _slices(batch.column(2)):
                found = Chunks.of(data, bounds, line_hash)
                once = found.hash[found.origin == np.arange(len(found.hash))]
                yield pa.RecordBatch.from_arrays([pa.array(once.view(np.int64))], ["chunk_hash"])

    return rows.mapInArrow(run, "chunk_hash long")


#: Rows of three kinds. Places: a chunk's first place in a text, the hashes of the lines before and
#: after it (0 at the text's ends), and where the former starts and the latter stops. Repeats: from
#: where to where a text repeats itself. Evidence: for a chunk's hash its lines' hashes, and for
#: the hash of such a line, or one beside it, its bytes.
PLACE, REPEAT, OF_CHUNK, OF_LINE = range(4)
FOUND = "kind int, doc_id long, text_hash long, hash long, start int, stop int, before long, after long, from int, to int, content binary"


def _rows(kind: int, n: int, **columns: pa.Array) -> pa.RecordBatch:
    types = {"kind": pa.int32(), "doc_id": pa.int64(), "text_hash": pa.int64(), "hash": pa.int64(), "start": pa.int32(), "stop": pa.int32()}
    types |= {"before": pa.int64(), "after": pa.int64(), "from": pa.int32(), "to": pa.int32(), "content": pa.binary()}
    columns["kind"] = pa.array(np.full(n, kind, np.int32))
    return pa.RecordBatch.from_arrays([columns[x] if x in columns else pa.nulls(n, t) for x, t in types.items()], list(types))


def _found(rows: DataFrame, bits: bytes | None, line_hash: Callable[[bytes], int]) -> DataFrame:
    """``FOUND`` of the chunks whose hash passes the filter, and of all that texts repeat of themselves."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = None if shared.value is None else np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for at, data, bounds in _slices(batch.column(2)):
                found = Chunks.of(data, bounds, line_hash)
                lines = found.lines

                def placed(text: np.ndarray, at=at, bounds=bounds, batch=batch, **places: np.ndarray) -> dict[str, pa.Array]:
                    of = pa.array(text + at)
                    return {k: pa.array((x - bounds[text]).astype(np.int32)) for k, x in places.items()} | {"doc_id": batch.column(0).take(of), "text_hash": batch.column(1).take(of)}

                text, start, stop = found.repeats()
                yield _rows(REPEAT, len(text), **placed(text, start=start, stop=stop))

                some = (found.origin == np.arange(len(found.hash))) & passes(filled, found.hash)
                first, end, hashes = found.first[some], found.end[some], found.hash[some]
                previous, following = lines.beside(first, -1), lines.beside(end, 1)
                sides = {"start": lines.start[first], "stop": lines.stop[end], "from": lines.start[previous], "to": lines.stop[following]}
                before, after = (pa.array(np.where(x == edge, 0, lines.hash[x].view(np.int64))) for x, edge in ((previous, first), (following, end)))
                yield _rows(PLACE, len(first), hash=pa.array(hashes.view(np.int64)), before=before, after=after, **placed(lines.text[first], **sides))

                # in a slice a line's hash stands for one content, or the line is in no chunk
                depth = np.bincount(previous, minlength=len(lines.hash) + 1) - np.bincount(following + 1, minlength=len(lines.hash) + 1)
                covered = np.flatnonzero(np.cumsum(depth)[:-1])
                covered = covered[np.unique(lines.hash[covered], return_index=True)[1]]
                contents = {lines.hash[a : b + 1].tobytes(): h for a, b, h in zip(first.tolist(), end.tolist(), hashes.view(np.int64).tolist(), strict=True)}
                yield _rows(OF_CHUNK, len(contents), hash=pa.array(contents.values(), pa.int64()), content=pa.array(contents.keys(), pa.binary()))
                view = memoryview(data)
                contents = [bytes(view[a:b]) for a, b in zip(lines.start[covered].tolist(), lines.content[covered].tolist(), strict=True)]
                yield _rows(OF_LINE, len(covered), hash=pa.array(lines.hash[covered].view(np.int64)), content=pa.array(contents, pa.binary()))

    return rows.mapInArrow(run, FOUND)


def _doubtful(found: DataFrame) -> tuple[DataFrame, bool]:
    """(hash) of the chunks whose hash, or a line's, stands for several contents; and whether a
    line's does."""
    evidence = found.where(F.col("kind") >= OF_CHUNK).select("kind", "hash", "content")
    several = written(evidence.distinct().groupBy("kind", "hash").agg(F.count("*").alias("n")).where("n > 1").select("kind", "hash"))
    chunks = several.where(F.col("kind") == OF_CHUNK).select("hash")
    if several.where(F.col("kind") == OF_LINE).isEmpty():
        return chunks, False
    at = F.sequence(F.lit(1), F.octet_length("content"), F.lit(8))
    each = evidence.where(F.col("kind") == OF_CHUNK).select("hash", F.explode(F.transform(at, lambda i: F.substring("content", i, F.lit(8)))).alias("raw"))
    digits = F.lpad(F.hex("hash"), 16, "0")
    lines = several.where(F.col("kind") == OF_LINE).select(F.unhex(F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)])).alias("raw"))
    return chunks.unionAll(each.join(lines, "raw", "left_semi").select("hash")).distinct(), True


def repeated_chunks(documents: DataFrame, line_hash: Callable[[bytes], int] = xxh64_intdigest) -> DataFrame:
    """(doc_id, text_hash, start, stop) of every chunk that stands earlier, too, with a line on
    either side that does.

    Rows equal in doc_id and text are one document; a null doc_id comes after all others.
    """
    rows = in_small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    with Scratch() as scratch:
        counts = _chunk_hashes(rows, line_hash).groupBy("chunk_hash").agg(F.count("*").alias("n"))
        repeated = scratch.written(counts.where("n > 1").select("chunk_hash"))
        bits = filter_of(repeated, "chunk_hash")
        found = _found(rows, bits, line_hash)
        if bits is None:  # no filter holds that many; a join does its work
            found = found.join(repeated.withColumn("kind", F.lit(PLACE)).withColumnRenamed("chunk_hash", "hash"), ["kind", "hash"], "left_semi").unionByName(found.where(F.col("kind") != PLACE))
        found = scratch.written(found, compression="zstd")
        chunks, lines_too = _doubtful(found)
        doubtful = scratch.written(chunks)
        own = found.where(F.col("kind") == REPEAT).select("doc_id", "text_hash", "start", "stop")
        places = found.where(F.col("kind") == PLACE).drop("kind", "content")
        site = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "start")
        least = F.min(F.struct(site.alias("site"), "before", "after")).alias("kept")
        firsts = scratch.written(places.groupBy("hash").agg(least, F.count("*").alias("n")).where("n > 1").select("hash", "kept"))
        again = places.join(firsts, "hash").where(~site.eqNullSafe(F.col("kept.site"))).join(doubtful, "hash", "left_anti")
        alike = lambda side: F.lit(not lines_too) & (F.col(side) == F.col(f"kept.{side}"))
        start, stop = F.when(alike("before"), F.col("from")).otherwise(F.col("start")), F.when(alike("after"), F.col("to")).otherwise(F.col("stop"))
        return written(again.select("doc_id", "text_hash", start.alias("start"), stop.alias("stop")).unionAll(own))


def _removals(repeated: DataFrame) -> DataFrame:
    """(_id, _hash, _cuts array<struct<start, stop>>): what goes from each document that loses anything."""

    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            sizes = pc.list_value_length(spans).to_numpy(zero_copy_only=False)
            each = spans.flatten()
            text, start, stop = merged(np.repeat(np.arange(len(sizes)), sizes), each.field("start").to_numpy(), each.field("stop").to_numpy())
            offsets = np.append(0, np.cumsum(np.bincount(text, minlength=len(sizes)))).astype(np.int32)
            both = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], ["start", "stop"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), both)], ["_id", "_hash", "_cuts"])

    # a document's own chunks, each once
    spans = repeated.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return spans.mapInArrow(run, "_id long, _hash long, _cuts array<struct<start: int, stop: int>>")


def _without(text: Column, cuts: Column) -> Column:
    """The text's bytes outside of the ascending ``cuts``; a separator that a cut leaves at the end goes, too."""
    raw = text.cast("binary")
    size = F.octet_length(text)

    def part(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1)["stop"])
        end = F.when(i == F.size(cuts), size).otherwise(F.get(cuts, i)["start"])
        return F.substring(raw, start + 1, end - start).cast("string")

    left = F.array_join(F.transform(F.sequence(F.lit(0), F.size(cuts)), part), "")
    return F.when(F.element_at(cuts, -1)["stop"] == size, F.regexp_replace(left, r"[ \n]\z", "")).otherwise(left)


def without_repeated_lines(documents: DataFrame, line_hash: Callable[[bytes], int] = xxh64_intdigest) -> DataFrame:
    """``documents`` with repeated passages cut out of ``text``; every row and other column stays.

    A document of which nothing is left has an empty text; null texts stay null, and texts of fewer
    than ``LEAST_LINES`` lines stay as they are. A column ``removed_passages`` (int, 0 where the
    text is as it was) is added, in place of any of that name. Lines that share their hash with a
    line of other bytes, as about one in 2**64 pairs does, are left.
    """
    cuts = written(_removals(repeated_chunks(documents, line_hash)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    joined = documents.drop("removed_passages").join(small(cuts), same, "left")
    text = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("_cuts")))
    removed = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size("_cuts"))
    return joined.withColumns({"text": text, "removed_passages": removed}).drop("_id", "_hash", "_cuts")
