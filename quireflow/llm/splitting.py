"""Splitting oversized texts and files at natural boundaries, with overlap.

Cuts are looked for at anchors, multiples of a step from the start.  A cut is
the best boundary in the window before its anchor (a paragraph or heading
before a line, a line before a sentence, a sentence before a word, the latest
of equals), so each depends only on the characters near its anchor and ranges
of one text can be searched apart.  The step, the window and the overlap add up
to the limit, which bounds every piece.

Nothing is loaded whole: workers count the characters of byte ranges, lengths
are added up, workers find the cuts of each range (reading a halo before it),
the tables of the ranges are stitched, and pieces are read by offset.  Values of
a table are written to files first, as one stream of bytes each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireflow.llm.tokens import code_points, word_table
from quireflow.session import checkpointed, ensure_checkpoint_dir

KINDS = ("anywhere", "word", "sentence", "line", "paragraph", "end")
# Marks that end sentences, and marks that may follow them.
_TERMINATORS = ".!?…。！？｡؟۔।॥።፧፨։;"
_CLOSERS = "\"'”’»›)]}）】」』》〉"
_LINE_ENDS = [0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029]
_SPACES = [*_LINE_ENDS, 0x09, 0x1F, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
_WIDE = [ord(c) for c in "。！？｡"]


def _marks(points: np.ndarray, which: list[int]) -> np.ndarray:
    return np.isin(points, np.array(which, dtype=np.uint32))


@dataclass(frozen=True)
class Plan:
    """Sizes in code points: no piece is longer than `limit`, each repeats the `overlap` before it."""

    limit: int
    overlap: int
    window: int

    @staticmethod
    def of(limit: int, overlap: int | None = None, window: int | None = None) -> Plan:
        overlap = limit // 8 if overlap is None else overlap
        window = max(1, limit // 4) if window is None else window
        if overlap < 0 or window < 1 or limit - overlap - window < 1:
            raise ValueError("limit must exceed the overlap and the window together")
        return Plan(limit, overlap, window)

    @property
    def step(self) -> int:
        return self.limit - self.overlap - self.window

    def anchors(self, length: int) -> int:
        """Number of anchors of a text: none if it is within the limit."""
        if length <= self.limit:
            return 0
        # the rest after the last cut, which may lie a window before its anchor, must fit
        return -(-(length + self.window + self.overlap - self.limit) // self.step)


def levels(points: np.ndarray) -> np.ndarray:
    """The kind of boundary between each code point and the one before it."""
    n = len(points)
    out = np.zeros(n, dtype=np.int8)
    if n < 2:
        return out
    space = _marks(points, _SPACES)
    line = _marks(points, _LINE_ENDS)
    slash = (points[:-1] == 0x2F) & (points[1:] == ord("n"))  # the two-character line mark
    mark = np.zeros(n, dtype=bool)
    mark[:-1] |= slash
    mark[1:] |= slash
    # a two-character mark counts where white space or a line's end is next to it, as in paths it is none
    outer = np.ones(n, dtype=bool)
    outer[2:] &= ~word_table()[points[2:]]
    ends = np.zeros(n, dtype=bool)
    ends[1:] = slash
    ends[:-1] &= outer[1:] | mark[1:]
    line |= ends
    out[1:][space[:-1] & ~space[1:]] = 1
    terminator = _marks(points, [ord(c) for c in _TERMINATORS])
    closer = _marks(points, [ord(c) for c in _CLOSERS])
    # place of the last terminator if only closing marks came since
    index = np.arange(n)
    last_plain = np.maximum.accumulate(np.where(~closer, index, -1))
    ended = (last_plain >= 0) & terminator[np.maximum(last_plain, 0)]
    last_solid = np.maximum.accumulate(np.where(~space, index, -1))
    after_end = (last_solid >= 0) & ended[np.maximum(last_solid, 0)]
    out[1:][space[:-1] & ~space[1:] & after_end[:-1]] = 2
    wide = _marks(points, _WIDE)
    wide_end = (last_plain >= 0) & wide[np.maximum(last_plain, 0)]
    out[1:][wide_end[:-1] & ~closer[1:] & ~space[1:]] = 2
    fed = np.zeros(n, dtype=bool)
    fed[1:] = line[:-1] & ~((points[:-1] == 0x0D) & (points[1:] == 0x0A))
    out[fed & ~line] = 3
    blank = fed & ~line
    # an empty line before: the last two line ends have only white space between them
    breaks = np.cumsum(fed)
    solid_breaks = np.where(~(space | mark), breaks, -1)
    before = np.concatenate([[0], np.maximum.accumulate(solid_breaks)[:-1]])
    out[blank & (breaks - before >= 2)] = 4
    return out


def cuts(points: np.ndarray, offset: int, plan: Plan, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and kinds of the cuts of anchors first to last.

    `points` starts at `offset` of the whole text and must reach from a window
    (and some context) before the first anchor to the last anchor.
    """
    kinds = levels(points)
    places, found = [], []
    marks = word_table()[points]
    for k in range(first, last + 1):
        stop = k * plan.step - offset
        start = max(1, stop - plan.window + 1)
        # the boundary before the code point at the anchor itself is allowed
        here = kinds[start : stop + 1]
        best = len(here) - 1 - int(np.argmax(here[::-1]))
        place = start + best
        if here[best] == 0 and marks[place] and _is_mark(points[place]):
            while place > start and _is_mark(points[place]):  # don't part a mark from its letter
                place -= 1
        places.append(place + offset)
        found.append(int(here[best]))
    return np.array(places, dtype=np.int64), np.array(found, dtype=np.int8)


def _is_mark(point: int) -> bool:
    import unicodedata

    return unicodedata.category(chr(point))[0] == "M"


def split_points(points: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and kind of end of the pieces of one text that is held whole, as tests compare it."""
    anchors = plan.anchors(len(points))
    places, kinds = cuts(points, 0, plan, 1, anchors)
    ends = np.append(places, len(points))
    starts = np.maximum(np.concatenate([[0], places]) - plan.overlap, 0)
    return starts, ends, np.append(kinds, len(KINDS) - 1)


_PIECES = "piece int, n_pieces int, start_pos long, end_pos long, repeated long, boundary string, text string"
_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
RANGE_BYTES = 4 << 20


def split_texts(df: DataFrame, id_column: str, text_column: str, limit: int, overlap: int | None = None, window: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id, piece, n_pieces, start_pos, end_pos, repeated, boundary, text): every text's pieces in order.

    No piece has more than `limit` code points; the first `repeated` of a
    piece are the last of the one before, `overlap` unless the text is shorter
    there.  Without its repeated part each piece continues the one before, so
    the text is whole.  boundary tells what the piece ends with.  A text
    within the limit, also an empty one, is one piece; a null text has none.
    Repeated rows and ids are kept; other columns are not read.

    Texts of more bytes than the limit are written one after another to files
    in the shared checkpoint folder, and are cut there by byte ranges.
    """
    plan = Plan.of(limit, overlap, window)
    rows = df.select(F.col(id_column).alias("key"), F.col(text_column).alias("text")).where(F.col("text").isNotNull())
    short = rows.where(F.octet_length("text") <= limit).select(
        "key",
        F.lit(0).alias("piece"),
        F.lit(1).alias("n_pieces"),
        F.lit(0).cast("long").alias("start_pos"),
        F.length("text").cast("long").alias("end_pos"),
        F.lit(0).cast("long").alias("repeated"),
        F.lit(KINDS[-1]).alias("boundary"),
        "text",
    )
    streams = _exported(rows.where(F.octet_length("text") > limit))
    return short.union(split_streams(streams, plan, range_bytes)).withColumnRenamed("key", id_column)


def split_files(spark: SparkSession, paths: list[str], limit: int, overlap: int | None = None, window: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, piece, n_pieces, start_pos, end_pos, repeated, boundary, text) of giant UTF-8 files.

    As split_texts.  Bytes that aren't UTF-8 become replacement characters.
    Paths are URIs or local paths that every executor can read.  An empty file
    is one empty piece; a file named twice comes out once.
    """
    names = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string").repartition(max(1, min(len(paths), 1000)))
    sized = names.mapInArrow(_sizes, "path string, bytes long")
    streams = sized.select(F.col("path").alias("key"), "path", F.lit(0).cast("long").alias("low"), F.col("bytes").alias("high"))
    return split_streams(streams, Plan.of(limit, overlap, window), range_bytes).withColumnRenamed("key", "path")


def _exported(rows: DataFrame) -> DataFrame:
    """(key, path, low, high) of rows (key, text) written as UTF-8 to files, each task its own, in the shared folder."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/streams-{uuid.uuid4()}"
    kind = rows.schema[0].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # another attempt of the task writes another file
        path = f"{folder}/{uuid.uuid4()}"
        system, name = _open(path)
        file, at = None, 0
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            sizes = pc.binary_length(texts).to_numpy()
            if file is None and len(sizes):
                system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                file = system.open_output_stream(name)
            for text in texts:
                file.write(text.as_buffer())
            ends = at + np.cumsum(sizes)
            at = int(ends[-1]) if len(ends) else at
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([path] * len(sizes), pa.string()), pa.array(ends - sizes, pa.int64()), pa.array(ends, pa.int64())], names=["key", "path", "low", "high"])
        if file is not None:
            file.close()

    return checkpointed(rows.mapInArrow(write, f"key {kind}, path string, low long, high long"))


def split_streams(streams: DataFrame, plan: Plan, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of streams (key, path, low, high), each the bytes from low to high of a file.

    Workers count the code points of byte ranges, and lengths are added up by
    stream.  Workers then look for cuts in each range, reading a halo before
    it that reaches back to a letter, so that the cuts are those of the whole
    text; the first cut of a range ends the last piece of the one before,
    which is all that the tables of neighbouring ranges are stitched by.  Each
    range then emits the pieces that begin in it, by offset, with one open.
    """
    kind = streams.schema["key"].dataType.simpleString()
    ranges = streams.withColumn("a", F.explode(F.expr(f"sequence(low, greatest(high - 1, low), {range_bytes}L)")))
    ranges = ranges.withColumn("b", F.least("high", F.col("a") + range_bytes)).repartition("path", "a")
    counted = ranges.mapInArrow(_counts, f"key {kind}, {_RANGE}, points long")
    along = Window.partitionBy("path", "low").orderBy("a")
    placed = counted.withColumns({"at": F.sum("points").over(along) - F.col("points"), "length": F.sum("points").over(Window.partitionBy("path", "low"))})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Reader() as reader:
            for batch in batches:
                found = [_range_cuts(reader, row, plan) for row in _rows(batch)]
                firsts = [[(x[k][0] if len(x[0]) else None) for x in found] for k in range(3)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in firsts)], names=[*batch.schema.names, "cut", "cut_byte", "cut_kind"])

    spread = placed.repartition("path", "a")
    searched = spread.mapInArrow(search, f"key {kind}, {_RANGE}, points long, at long, length long, cut long, cut_byte long, cut_kind long")
    after = along.rowsBetween(1, Window.unboundedFollowing)
    stitched = searched.withColumns({f"next_{c}": F.first(c, ignorenulls=True).over(after) for c in ("cut", "cut_byte", "cut_kind")}).where("cut is not null")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Reader() as reader:
            for batch in batches:
                for i, row in enumerate(_rows(batch)):
                    pieces = list(_range_pieces(reader, row, plan))
                    keys = batch.column(0).take(pa.array(np.full(len(pieces), i)))
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(list(x), t) for x, t in zip(zip(*pieces, strict=True), _TYPES, strict=True))], names=["key", *(x.split()[0] for x in _PIECES.split(", "))])

    return stitched.repartition("path", "a").mapInArrow(emit, f"key {kind}, {_PIECES}")


_RANGE = "path string, low long, high long, a long, b long"


def _rows(batch: pa.RecordBatch) -> list[dict]:
    """The rows of a batch without their key, which may be of any type."""
    return batch.select([n for n in batch.schema.names if n != "key"]).to_pylist()


def _range_cuts(reader: _Reader, row: dict, plan: Plan) -> tuple[list[int], list[int], list[int]]:
    """Places, bytes and kinds of the cuts whose anchors lie in a range; the stream's start is one."""
    first = max(1, -(-row["at"] // plan.step))
    last = min(plan.anchors(row["length"]), (row["at"] + row["points"] - 1) // plan.step)
    head: tuple[list[int], list[int], list[int]] = ([0], [row["low"]], [0]) if row["a"] == row["low"] else ([], [], [])
    if first > last:
        return head
    need, halo = plan.window + 2, 4 * (plan.window + 64)
    while True:
        start = max(row["low"], row["a"] - halo)
        text, before = reader.text(row, start, row["b"], row["a"])
        points = code_points(text)
        # the first window begins so many code points after the range's start
        begin = before + first * plan.step - row["at"] - need
        if start == row["low"] or (begin > 2 and _context(points[:begin])):
            break
        halo *= 2
    offset = row["at"] - before
    found, kinds = cuts(points, offset, plan, first, last)
    widths = np.concatenate([[0], np.cumsum(1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)])
    begins = reader.aligned(row, start) + widths[found - offset]
    return head[0] + found.tolist(), head[1] + begins.tolist(), head[2] + kinds.tolist()


def _context(points: np.ndarray) -> bool:
    """Whether a letter or number, which isn't part of a line mark, lies in the points: nothing before it bears on what comes after."""
    solid = word_table()[points[1:]] & ~((points[:-1] == 0x2F) & (points[1:] == ord("n")))
    return bool(solid[1:].any())


def _range_pieces(reader: _Reader, row: dict, plan: Plan) -> Iterator[tuple]:
    """The pieces that begin at the cuts of a range, up to the next range's first cut."""
    places, begins, kinds = _range_cuts(reader, row, plan)
    ends = [*places[1:], row["length"] if row["next_cut"] is None else row["next_cut"]]
    stop = row["high"] if row["next_cut"] is None else row["next_cut_byte"]
    closing = [*kinds[1:], len(KINDS) - 1 if row["next_cut"] is None else row["next_cut_kind"]]
    start = max(row["low"], begins[0] - 4 * plan.overlap)
    text, before = reader.text(row, start, stop, begins[0])
    offset = places[0] - before
    first = -(-row["at"] // plan.step) if row["a"] != row["low"] else 0
    total = plan.anchors(row["length"]) + 1
    for k, (cut, end, kind) in enumerate(zip(places, ends, closing, strict=True)):
        repeated = min(plan.overlap, cut)
        yield first + k, total, cut - repeated, end, repeated, KINDS[kind], text[cut - repeated - offset : end - offset]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class _Reader:
    """Reads byte ranges; keeps the last file open."""

    def __init__(self) -> None:
        self.path: str | None = None
        self.file: pa.NativeFile | None = None

    def __enter__(self) -> _Reader:
        return self

    def __exit__(self, *_: object) -> None:
        if self.file is not None:
            self.file.close()

    def bytes(self, path: str, low: int, high: int) -> bytes:
        if path != self.path:
            self.__exit__()
            system, name = _open(path)
            self.path, self.file = path, system.open_input_file(name)
        return self.file.read_at(high - low, low) if high > low else b""

    def aligned(self, row: dict, at: int) -> int:
        """The first byte from `at` on that begins a character of the stream."""
        if at == row["low"]:
            return at
        data = self.bytes(row["path"], at, min(row["high"], at + 3))
        return at + next((k for k, b in enumerate(data) if b & 0xC0 != 0x80), len(data))

    def text(self, row: dict, low: int, high: int, middle: int) -> tuple[str, int]:
        """The characters that start in [low, high), and how many of them start before `middle`."""
        low, middle, high = self.aligned(row, low), self.aligned(row, middle), self.aligned(row, high) if high < row["high"] else high
        data = self.bytes(row["path"], low, high)
        before = data[: middle - low].decode("utf-8", "replace")
        return before + data[middle - low :].decode("utf-8", "replace"), len(before)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_open(p) for p in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.get_file_info(n).size for s, n in found], pa.int64())], names=["path", "bytes"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with _Reader() as reader:
        for batch in batches:
            points = [len(reader.text(r, r["a"], r["b"], r["a"])[0]) for r in _rows(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(points, pa.int64())], names=[*batch.schema.names, "points"])
