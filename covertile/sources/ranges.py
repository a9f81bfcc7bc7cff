"""Alignment text by byte ranges, where a filter on contigs reaches the files.

``on_contigs(spark, path).filter("rname = 'chr1'")`` opens only the stretches of sorted files that can hold the contig. A file is sorted if its
header says SO:coordinate (then it is taken at its word, as tools that keep an index do). There, contigs follow the order of @SQ lines, so the
first and last byte of a contig are found by bisection: each probe reads one line, some forty for a file of a terabyte. No index is kept. Files
that aren't sorted, and contigs that a header doesn't have, take all ranges; lines of other contigs go in the task that reads them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

RANGE = 128 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _source():
    # Classes are made in a function, so that they travel to workers by value.
    import re
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

    def opened(path: str):
        from urllib.parse import quote, unquote

        from pyarrow import fs

        local = re.fullmatch(r"file:/+(.*)", path, re.S)
        store, place = (fs.LocalFileSystem(), "/" + unquote(local[1])) if local else fs.FileSystem.from_uri(quote(path, safe=":/@%"))
        return store.open_input_file(place)

    def line_from(f, at: int, size: int) -> tuple[int, bytes]:
        """(start, line) of the first line that begins at ``at`` or behind it; an empty line at the file's end."""
        start = at
        if at > 0:
            f.seek(at - 1)
            start = at - 1 + len(_to_newline(f))
        if start >= size:
            return size, b""
        f.seek(start)
        return start, _to_newline(f)

    def _to_newline(f) -> bytes:
        got = []
        while piece := f.read(1 << 16):
            cut = piece.find(b"\n")
            if cut >= 0:
                got.append(piece[: cut + 1])
                break
            got.append(piece)
        return b"".join(got)

    def contig_of(line: bytes) -> str | None:
        fields = line.split(b"\t", 3)
        return fields[2].decode("utf-8", "replace").rstrip("\r\n") if len(fields) > 2 else None

    def head(f, size: int) -> tuple[bool, dict[str, int], int]:
        """(sorted, place of each contig, first byte behind the header)."""
        ordered, places, at = False, {}, 0
        while at < size:
            f.seek(at)
            line = _to_newline(f)
            if not line.startswith(b"@"):
                break
            at += len(line)
            fields = line.decode("utf-8", "replace").rstrip("\r\n").split("\t")
            if fields[0] == "@HD":
                ordered = "SO:coordinate" in fields
            elif fields[0] == "@SQ":
                places.setdefault(next((x[3:] for x in fields if x.startswith("SN:")), ""), len(places))
        return ordered, places, at

    def stretches(path: str, wanted: set[str] | None) -> list[tuple[int, int]]:
        """Byte stretches of a file that hold every line of the wanted contigs."""
        with opened(path) as f:
            size = f.size()
            if wanted is None:
                return [(0, size)]
            ordered, places, begin = head(f, size)
            if not ordered or not wanted <= places.keys():
                return [(0, size)]

            def bound(place: int) -> int | None:
                """The first byte whose line stands at ``place`` or behind it; None if a line is of no known contig."""
                lo, hi = begin, size
                while lo < hi:
                    mid = (lo + hi) // 2
                    start, line = line_from(f, mid, size)
                    name = contig_of(line) if line else "*"
                    here = len(places) if name == "*" else places.get(name)
                    if here is None:
                        return None
                    if here >= place:
                        hi = mid
                    else:
                        lo = start + len(line)
                return line_from(f, lo, size)[0]

            out = []
            for place in sorted(places[w] for w in wanted):
                a, b = bound(place), bound(place + 1)
                if a is None or b is None:
                    return [(0, size)]
                if out and out[-1][1] == a:
                    out[-1] = (out[-1][0], b)
                elif a < b:
                    out.append((a, b))
            return out

    class Range(InputPartition):
        def __init__(self, path: str, start: int, stop: int):
            super().__init__(None)
            self.path, self.start, self.stop = path, start, stop

    class Reader(DataSourceReader):
        def __init__(self, files: list[str], size: int):
            self.files, self.size, self.wanted = files, size, None

        def pushFilters(self, filters: list[Filter]):
            for f in filters:
                if isinstance(f, (EqualTo, In)) and f.attribute == ("rname",):
                    values = {v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
                    self.wanted = values if self.wanted is None else self.wanted & values
                else:
                    yield f

        def partitions(self):
            cuts = [(p, a, b) for p in self.files for a, b in stretches(p, self.wanted)]
            ranges = [Range(p, k, min(k + self.size, b)) for p, a, b in cuts for k in range(a, b, self.size)]
            return ranges or [Range("", 0, 0)]

        def read(self, partition) -> Iterator[pa.RecordBatch]:
            if not partition.path:
                return
            with opened(partition.path) as f:
                at = line_from(f, partition.start, f.size())[0]
                f.seek(at)
                rest = b""
                while at < partition.stop:
                    # whole lines that begin before the stop; the last one may end behind it
                    piece = f.read(min(8 << 20, partition.stop - at))
                    if not piece:
                        break
                    at += len(piece)
                    if at >= partition.stop and not piece.endswith(b"\n"):
                        piece += _to_newline(f)
                    *lines, rest = (rest + piece).split(b"\n")
                    yield from self.batch(partition.path, lines)
                if rest:
                    yield from self.batch(partition.path, [rest])

        def batch(self, path: str, lines: list[bytes]) -> Iterator[pa.RecordBatch]:
            names, values = [], []
            for line in lines:
                if line and not line.startswith(b"@"):
                    name = contig_of(line)
                    if self.wanted is None or name in self.wanted:
                        names.append(name)
                        values.append(line.decode("utf-8", "replace").removesuffix("\r"))
            if values:
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(values), pa.string()), pa.array(names, pa.string()), pa.array(values, pa.string())], names=["path", "rname", "value"])

    class AlignmentLines(DataSource):
        @classmethod
        def name(cls) -> str:
            return "alignment_lines"

        def schema(self) -> str:
            return "path string, rname string, value string"

        def reader(self, schema) -> Reader:
            return Reader(json.loads(self.options["files"]), int(self.options["range"]))

    return AlignmentLines


def on_contigs(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, rname, value): alignment lines (no headers) of the text files under ``path``, in ranges of ``size`` bytes, for ``readers.alignments``.

    Equalities and IN lists on rname are pushed down: the session's switch for filters of Python sources is turned on. A line belongs to
    the range that holds its first byte. rname is NULL for lines of fewer than three fields; empty lines are left out. Compressed files can't be read so.
    """
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(_source())
    # named as Spark names them elsewhere, so that headers meet their lines; the content isn't read
    files = sorted(r[0] for r in spark.read.format("binaryFile").load(path).select("_metadata.file_path").collect())
    return spark.read.format("alignment_lines").option("files", json.dumps(files)).option("range", size).load()
