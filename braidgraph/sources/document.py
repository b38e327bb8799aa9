"""JSON documents of any length, which are one object: their long arrays are written and read by tasks, a part at a time.

Written: tasks make a line of each element, and the driver copies the parts of the lines into the file one behind the other.
Read: the driver goes through the file in pieces and puts the elements of the long arrays, a line each, into parts in the shared
folder, which tasks parse.  What the driver holds is a piece and the document without these arrays.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import shared_dir, written

#: Bytes of a document that are read at once; a search for marks takes some twenty times as much of the driver's memory.
PIECE = 1 << 20
#: Pieces that make a part.
PIECES = 4
_BETWEEN = ",\n"
#: The arrays that may be long, by their keys from the top.
LONG = (("pathTable",), ("nodes",), ("edges",), ("graph", "nodes"), ("graph", "edges"))
_KEY = re.compile(rb'"(?:pathTable|nodes|edges)"\s*:\s*$')
_BRACKETS = np.zeros(256, np.int8)
_BRACKETS[list(b"[{")], _BRACKETS[list(b"]}")] = 1, -1
_SPECIAL = np.zeros(256, bool)
_SPECIAL[list(b'"[]{},\n\r')] = True


#: What can be wrong with an element, the first counts.
FAULTS = ("parse_error", "invalid_structure", "corrupted_data")


class BadElement(Exception):
    """An element that can't be used; ``reason`` is one of FAULTS."""

    def __init__(self, reason: str, message: str):
        super().__init__(message)
        self.reason = reason


def bare(metadata: Column, fields: list[str]) -> Column:
    """A struct, or null if all its fields are null."""
    return F.when(F.coalesce(*[F.when(metadata[f].isNotNull(), True) for f in fields]), metadata)


def quoted(text: Column) -> Column:
    """The JSON text of a string."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def write(spark: SparkSession, pieces: list[str | DataFrame], path: str) -> None:
    """Make a file of texts and of the lines (value) of tables, in the order of their rows, with commas between them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = f"{shared_dir(spark)}/document-{uuid.uuid4().hex}"
    for i, p in enumerate(pieces):
        if isinstance(p, DataFrame):
            p.write.option("lineSep", _BETWEEN).text(f"{where}/{i}")
    top = jvm.org.apache.hadoop.fs.Path(where)
    fs = top.getFileSystem(conf)
    out = jvm.org.apache.hadoop.fs.FileSystem.getLocal(conf).getRawFileSystem().create(jvm.org.apache.hadoop.fs.Path("file://" + os.path.abspath(path)), True)
    try:
        parts: list[tuple] = []
        for i, p in enumerate([*pieces, ""]):
            if isinstance(p, DataFrame):
                own = fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{where}/{i}"))
                parts += sorted(((i, s.getPath().getName(), s.getLen(), s.getPath()) for s in own if s.getLen() and s.getPath().getName().startswith("part-")), key=lambda x: x[:2])
                continue
            for k, (_, _, length, part) in enumerate(parts, 1):  # of all tables before this text
                given = fs.open(part)
                jvm.org.apache.commons.io.IOUtils.copyLarge(given, out, 0, length - len(_BETWEEN) * (k == len(parts)))
                given.close()
            parts = []
            out.write(bytearray(p.encode()))
    finally:
        out.close()
        fs.delete(top, True)


@dataclass
class Split:
    """A document without its long arrays, which are empty in ``rest``; where their parts are, and how many elements they have."""

    rest: dict
    parts: dict[tuple[str, ...], str]
    counts: dict[tuple[str, ...], int]


def _events(piece: np.ndarray, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Of the marks of a piece: place, byte, whether it is outside strings, the depth behind it; and whether the piece ends in a string."""
    slashes = np.flatnonzero(piece == 92)
    if slashes.size:
        gap = np.diff(slashes) != 1
        starts, ends = slashes[np.r_[True, gap]], slashes[np.r_[gap, True]]
        piece = piece.copy()
        escaped = ends[(ends - starts) % 2 == 0] + 1
        piece[escaped[escaped < piece.size]] = 0  # no marks
    at = np.flatnonzero(_SPECIAL[piece])
    mark = piece[at]
    quote = mark == 34
    within = (np.cumsum(quote) + inside) % 2
    free = (within == 0) & ~quote
    depths = depth + np.cumsum(np.where(free, _BRACKETS[mark], 0))
    return at, mark, free, depths, int(within[-1]) if at.size else inside


def _place(head: bytes, depth: int) -> tuple[str, ...] | None:
    """The keys of an array that begins behind ``head`` at this depth, if it is one of the long ones."""
    try:
        data = json.loads(head + b"[]" + b"}" * (depth - 1))
    except ValueError:
        return None
    keys: tuple[str, ...] = ()
    while isinstance(data, dict) and data:
        key = list(data)[-1]  # the array is the last thing in what holds it
        keys, data = (*keys, key), data[key]
    return keys if keys in LONG and len(keys) == depth - 1 else None


def split(spark: SparkSession, path: str, piece: int = PIECE) -> Split:
    """Take a document apart; ValueError if what is left without its long arrays is no JSON."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = f"{shared_dir(spark)}/document-{uuid.uuid4().hex}"
    rest, parts, counts = bytearray(), {}, {}
    own = where.removeprefix("file://") if re.match(r"file:///[^/]|/", where) else None

    def put(keys: tuple[str, ...], first: int, lines: bytes) -> None:
        name = f"{parts[keys]}/part-{first:015d}"
        if own is not None:
            with open(name.removeprefix("file://"), "wb") as f:
                f.write(lines)
            return
        target = jvm.org.apache.hadoop.fs.Path(name)
        out = target.getFileSystem(conf).create(target, True)
        out.write(bytearray(lines))
        out.close()

    keys, level, waiting, first, ready, inside, depth = None, 0, [], 0, 0, 0, 0  # ready: whole elements in what waits
    with open(path, "rb") as f:
        while text := f.read(piece):
            while text.endswith(b"\\") and (more := f.read(1)):  # what is escaped is read with its backslashes
                text += more
            array = np.frombuffer(text, np.uint8)
            at, mark, free, depths, inside = _events(array, inside, depth)
            now = 0
            while now < len(text):
                if keys is None:
                    opens = at[free & (mark == 91) & ((depths == 2) | (depths == 3)) & (at >= now)]
                    for here in opens.tolist():
                        if not _KEY.search((bytes(rest[-100:]) + text[max(now, here - 100) : here])[-100:]):
                            continue
                        level = int(depths[np.searchsorted(at, here)])
                        keys = _place(bytes(rest) + text[now:here], level)
                        if keys:
                            break
                    if keys is None:
                        rest += text[now:]
                        break
                    rest += text[now : here + 1]
                    now, waiting, first, ready = here + 1, [], 0, 0
                    parts[keys], counts[keys] = f"{where}/{uuid.uuid4().hex}", 0
                    if own is not None:
                        os.makedirs(parts[keys].removeprefix("file://"))
                    else:
                        folder = jvm.org.apache.hadoop.fs.Path(parts[keys])
                        folder.getFileSystem(conf).mkdirs(folder)
                ends = at[free & (mark == 93) & (depths == level - 1) & (at >= now)]
                end = int(ends[0]) if ends.size else len(text)
                own_marks = (at >= now) & (at < end) & free
                lines = array[now:end].copy()
                lines[at[own_marks & ((mark == 10) | (mark == 13))] - now] = 32
                commas = at[own_marks & (mark == 44) & (depths == level)] - now
                lines[commas] = 10
                ready += commas.size
                if commas.size and sum(map(len, waiting)) + lines.size >= PIECES * piece:
                    last = int(commas[-1])
                    put(keys, first, b"".join([*waiting, lines[:last].tobytes()]))
                    first, ready, waiting = first + ready, 0, [lines[last + 1 :].tobytes()]
                else:
                    waiting.append(lines.tobytes())
                if ends.size:
                    left = b"".join(waiting)
                    if first or ready or left.strip():
                        put(keys, first, left)
                        first += ready + 1
                    counts[keys], keys = first, None
                now = end
            depth = int(depths[-1]) if at.size else depth
    return Split(json.loads(bytes(rest)), parts, counts)


def table(spark: SparkSession, parts: str, count: int, kind: pa.Schema, ddl: str, rows: Callable[[list, int], list[dict]]) -> DataFrame:
    """A written table of the elements of parts: ``rows`` makes rows of elements and the number of the first.  The worst fault of
    them, if there is one, is raised as a BadElement."""
    schema = pa.schema([*kind, pa.field("reason", pa.string()), pa.field("fault", pa.string())])

    def one(first: int, content: bytes) -> pa.RecordBatch:
        reason, elements = "parse_error", None
        try:
            elements = json.loads(b"[" + content.replace(b"\n", b",\n") + b"]")
            reason = "corrupted_data"
            return pa.RecordBatch.from_pylist(rows(elements, first), schema)
        except BadElement as e:
            return pa.RecordBatch.from_pylist([{"reason": e.reason, "fault": str(e)}], schema)
        except Exception as e:  # noqa: BLE001  whatever an odd document holds
            return pa.RecordBatch.from_pylist([{"reason": reason, "fault": f"{type(e).__name__}: {e}"}], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                yield one(int(path.as_py().rsplit("part-", 1)[1]), content.as_py())

    if not count:
        return spark.createDataFrame([], ddl)
    found = written(spark.read.format("binaryFile").load(parts).select("path", "content").mapInArrow(run, f"{ddl}, reason string, fault string"), "elements")
    for reason in FAULTS:
        bad = found.where(F.col("reason") == reason).select("fault").first()
        if bad:
            raise BadElement(reason, bad[0])
    return found.drop("reason", "fault")


def beside(path: str) -> str:
    """A new file in the folder of a file, which must exist."""
    folder = os.path.dirname(os.path.abspath(path))
    if not os.path.isdir(folder):
        raise FileNotFoundError(f"Directory does not exist: {folder}")
    fd, name = tempfile.mkstemp(dir=folder, suffix=".tmp")
    os.close(fd)
    return name
