"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of about ``FRAME`` bytes, each with the units (tokens) and code points
before it, so that a place given in units is found in the directory and only the frame that it falls into is decompressed.
The output of a document is again an ordered list of frames: whole frames are taken over as they are, a cut frame is
decompressed and written as two, the markers are frames of their own. Digests and the restored text read frames in order,
one at a time; no step needs a whole text decompressed.

A unit is a word with the white space before it, or white space at the end: a unit starts at the start of the text and
wherever white space follows a word. The prefix ends after the smaller of two hashed places, the middle after the larger.
A text that is empty or has a marker in it stays plain.

Everything is decided row by row: no shuffle, and the cost of a row is in proportion to its text.

Defined results: a null text is an empty text; a null doc_id draws its places as an empty id (``42:``); rows repeated
under one id are transformed alike, a row each; an empty table gives an empty result; extra columns are ignored; both
places equal give an empty middle. Texts of any length, with or without white space, are cut only at code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import WORD_SPACE, materialize, pick

FRAME = 1 << 16  # bytes of text in a frame, about
LEVEL = 3
SEED = 42
FIM_PERCENT = 50  # of documents that are transformed
SPM_PERCENT = 80  # of those, in the order suffix, prefix, middle
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: The parts of the text in the order of each form, with the marker before each.
ORDERS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
_SPACE = np.zeros(256, bool)
_SPACE[list(WORD_SPACE)] = True

_STORED = "doc_id long, n long, chars long, marked boolean, units array<long>, points array<long>, frames array<binary>"
_OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>"


def _points(data: bytes) -> int:
    """Code points of UTF-8 bytes: those that don't continue a character."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def unit_starts(data: bytes, before: int | None) -> np.ndarray:
    """Offsets at which a unit starts; ``before`` is the byte before ``data``, None at the start of a text."""
    space = _SPACE[np.frombuffer(data, np.uint8)]
    follows = np.empty(len(space), bool)
    follows[1:] = ~space[:-1]
    if len(space):
        follows[0] = before is None or not _SPACE[before]
    starts = space & follows
    if before is None and len(space):
        starts[0] = True
    return np.flatnonzero(starts)


def encode(data: bytes, frame: int = FRAME) -> tuple[list[int], list[int], list[bytes]]:
    """(units before, code points before, frames) of a text; the first two have the totals as their last element."""
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    units, points, frames, at = [0], [0], [], 0
    while at < len(data):
        end = min(at + frame, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:  # not inside a character
            end += 1
        part = data[at:end]
        frames.append(pack(part))
        units.append(units[-1] + len(unit_starts(part, data[at - 1] if at else None)))
        points.append(points[-1] + _points(part))
        at = end
    return units, points, frames


def store(docs: DataFrame, frame: int = FRAME) -> DataFrame:
    """(doc_id, n, chars, marked, units, points, frames): every whole text as frames with their directory.

    ``n`` counts the units, ``chars`` the code points; ``marked`` texts have a marker in them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                found = [encode(t, frame) for t in texts]
                marked = [any(m in t for m in (PREFIX, SUFFIX, MIDDLE)) for t in texts]
                longs, blobs = pa.list_(pa.int64()), pa.list_(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([u[-1] for u, _, _ in found], pa.int64()), pa.array([p[-1] for _, p, _ in found], pa.int64()), pa.array(marked, pa.bool_()),
                        pa.array([u for u, _, _ in found], longs), pa.array([p for _, p, _ in found], longs), pa.array([f for _, _, f in found], blobs),
                    ],
                    ["doc_id", "n", "chars", "marked", "units", "points", "frames"],
                )

    return pick(docs, ["doc_id", "text"]).mapInArrow(run, _STORED)


def _draw(k: int) -> Column:
    """The k-th group of eight hex digits of the document's digest, as an unsigned number."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def choose(stored: DataFrame) -> DataFrame:
    """``stored`` with ``form`` and the places ``cut_a`` and ``cut_b`` in units, from the directory and the id alone."""
    a, b = (_draw(k) % (F.col("n") + 1) for k in (0, 1))
    plain = (F.col("chars") == 0) | F.col("marked") | (_draw(2) % 100 >= FIM_PERCENT)
    form = F.when(plain, "plain").when(_draw(3) % 100 < SPM_PERCENT, "spm").otherwise("psm")
    return stored.withColumns({"form": form, "cut_a": F.least(a, b), "cut_b": F.greatest(a, b)})


class _Text:
    """Stored frames of one text, read where needed."""

    def __init__(self, units: list[int], points: list[int], frames: list[bytes]):
        self.units, self.points, self.frames = units, points, frames
        self.unpack = zstandard.ZstdDecompressor().decompress

    def seek(self, unit: int) -> tuple[int, int, int]:
        """(frame, byte offset in it, code points before) of the start of a unit; the end of the text for the last."""
        if unit >= self.units[-1]:
            return len(self.frames), 0, self.points[-1]
        if unit == 0:
            return 0, 0, 0
        k = int(np.searchsorted(self.units, unit, "right")) - 1  # the last frame with at most so many units before it
        data = self.unpack(self.frames[k])
        before = None
        if k:
            before = self.unpack(self.frames[k - 1])[-1]
        offset = int(unit_starts(data, before)[unit - self.units[k]])
        return k, offset, self.points[k] + _points(data[:offset])

    def between(self, a: tuple[int, int, int], b: tuple[int, int, int]) -> Iterator[bytes]:
        """Frames of the text from place ``a`` to place ``b``: those inside as they are stored."""
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for k in range(a[0], b[0] + (b[1] > 0)):
            start, end = a[1] if k == a[0] else 0, b[1] if k == b[0] else None
            if start == 0 and end is None:
                yield self.frames[k]
            elif part := self.unpack(self.frames[k])[start:end]:
                yield pack(part)


def transform(stored: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, frames): the output of every document as ordered frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                out = []
                for x in batch.slice(lo, 64).to_pylist():
                    if x["form"] == "plain":
                        out.append((x["doc_id"], x["n"], "plain", None, None, x["frames"]))
                        continue
                    text = _Text(x["units"], x["points"], x["frames"])
                    places = [text.seek(0), text.seek(x["cut_a"]), text.seek(x["cut_b"]), text.seek(x["n"])]
                    frames = []
                    for marker, part in ORDERS[x["form"]]:
                        frames += [pack(marker), *text.between(places[part], places[part + 1])]
                    out.append((x["doc_id"], x["n"], x["form"], places[1][2], places[2][2] - places[1][2], frames))
                names, kinds = _names(_OUTPUT), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    chosen = choose(stored).select("doc_id", "n", "form", "cut_a", "cut_b", "units", "points", "frames")
    return chosen.mapInArrow(run, _OUTPUT)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def decode(frames: list[bytes]) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    for f in frames:
        yield unpack(f)


def _place(frames: list[bytes], marker: bytes, start: tuple[int, int]) -> tuple[int, int]:
    """(frame, byte offset) of the first ``marker`` at or after ``start``; it may lie across frames."""
    unpack, carry = zstandard.ZstdDecompressor().decompress, b""
    held = []  # frame and offset of each byte carried over
    for k in range(start[0], len(frames)):
        data, skip = unpack(frames[k]), start[1] if k == start[0] else 0
        joined = carry + data[skip:]
        at = joined.find(marker)
        if at >= 0:
            return held[at] if at < len(carry) else (k, at - len(carry) + skip)
        size = len(joined)
        places = [held[i] if i < len(carry) else (k, i - len(carry) + skip) for i in range(max(0, size - 2), size)]
        carry, held = joined[-2:], places
    raise ValueError(f"no {marker!r} in the output")


def restore(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The original text from an output and its form alone, in pieces."""
    if form == "plain":
        yield from decode(frames)
        return
    unpack = zstandard.ZstdDecompressor().decompress
    at, spans = (0, 0), {}
    marks = ORDERS[form]
    for i, (marker, part) in enumerate(marks):
        at = _place(frames, marker, at)
        if i:
            spans[marks[i - 1][1]][1] = at
        at = _step(frames, at, len(marker), unpack)
        spans[part] = [at, (len(frames), 0)]
    for part in (0, 1, 2):
        a, b = spans[part]
        for k in range(a[0], min(b[0] + 1, len(frames))):
            yield unpack(frames[k])[a[1] if k == a[0] else 0 : b[1] if k == b[0] else None]


def _step(frames: list[bytes], at: tuple[int, int], size: int, unpack) -> tuple[int, int]:
    """The place ``size`` bytes on."""
    k, offset = at
    while size:
        left = len(unpack(frames[k])) - offset
        if size < left:
            return k, offset + size
        size, k, offset = size - left, k + 1, 0
    return k, offset


def digests(outputs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256), streamed frame by frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                given, restored = [], []
                for form, frames in zip(part.column(2).to_pylist(), part.column(5).to_pylist()):
                    out, back = hashlib.sha256(), hashlib.sha256()
                    for piece in decode(frames):
                        out.update(piece)
                    for piece in restore(frames, form):
                        back.update(piece)
                    given.append(out.hexdigest())
                    restored.append(back.hexdigest())
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(given), pa.array(restored)], [*_names(_OUTPUT)[:5], "output_sha256", "restored_sha256"])

    return outputs.mapInArrow(run, _OUTPUT.rsplit(", ", 1)[0] + ", output_sha256 string, restored_sha256 string")


def texts(outputs: DataFrame) -> DataFrame:
    """(doc_id, form, output): the output of every document as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                made = [b"".join(decode(f)).decode() for f in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.string())], ["doc_id", "form", "output"])

    return outputs.select("doc_id", "form", "frames").mapInArrow(run, "doc_id long, form string, output string")


def fill_in_middle(docs: DataFrame, frame: int = FRAME) -> DataFrame:
    """Outputs of all documents, from frames stored once in the shared folder."""
    return transform(materialize(store(docs, frame), "fim-frames"))
