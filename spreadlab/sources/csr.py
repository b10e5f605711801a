"""Compressed rows as a Spark data source, ``csr_edges``: columns u, v, thr.

A folder holds parts and a manifest.  A part is what one task has written: the offsets of its sources, 64 bits each, in one file,
and its pairs (v, thr) of 32 bits in another.  A manifest, written when all tasks are done, names the parts that count, so what a
lost attempt has left behind is never read, and no byte of the graph goes through the driver.  A vertex of many edges may span parts.
A single binary file (n, m, n + 1 offsets, m pairs) is read the same way, as one part.

The driver plans ranges of edges from the manifest.  Bounds of u come as options ``first`` and ``last`` (both included) or, with option
``pushdown`` and spark.sql.python.filterPushdown.enabled, as filters that Spark pushes down: parts outside are left out, and of those
at the ends two offsets are found, so that tasks read the wanted edges alone.

Ids are 0 to 2^32 - 1, thresholds end at 2^31 - 1; a null or an id out of range is an error.  Equal rows stay.  An empty table has no parts.
"""

from __future__ import annotations

import bisect
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from spreadlab.session import ROOT
from spreadlab.sources.files import filesystem

SCHEMA = "u long, v long, thr long"
MANIFEST = "_manifest.json"
PAIR = np.dtype([("v", "<u4"), ("w", "<i4")])
#: Edges of one planned range, and ranges that the driver plans at most, about; beyond that they become longer.
BLOCK, RANGES = 1 << 22, 100_000
#: Edges of an Arrow batch, and offsets held at a time.
BATCH, WINDOW = 1 << 17, 1 << 16


class Offsets:
    """The offsets of a part's sources as a sequence on disk."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size = file, at, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> int:
        return int(self.run(i, 1)[0])

    def run(self, i: int, n: int) -> np.ndarray:
        self.file.seek(self.at + 8 * i)
        return np.frombuffer(self.file.read(8 * n), "<u8").astype(np.int64)


# ---- reading --------------------------------------------------------------------------------


def manifest(files, root: str) -> dict:
    """The manifest of a folder; without parts where nothing was written."""
    from pyarrow import fs

    path = f"{root}/{MANIFEST}"
    if files.get_file_info(path).type != fs.FileType.File:
        return {"n": 0, "parts": []}
    with files.open_input_stream(path) as f:
        return json.loads(f.read())


def parts_of(files, root: str) -> list[tuple[str, int, str, int, int, int, int]]:
    """(offsets' file, place of the first, pairs' file, place of the first, first source, sources, edges) of each part."""
    from pyarrow import fs

    kind = files.get_file_info(root).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    if kind == fs.FileType.File:
        with files.open_input_file(root) as f:
            n, m = (int(x) for x in np.frombuffer(f.read(16), "<u8"))
        return [(root, 16, root, 16 + 8 * (n + 1), 0, n, m)]
    return [(f"{root}/{name}.first", 0, f"{root}/{name}.arcs", 0, first, sources, m) for name, first, sources, m in manifest(files, root)["parts"]]


def plan(options: dict, first: int | None = None, last: int | None = None) -> list[tuple]:
    """(part, first edge, edge after the last): ranges of the edges whose u is in the bounds."""
    files, root = filesystem(options["path"])
    wanted = []
    for part in parts_of(files, root):
        offsets_file, at, _, _, low, sources, m = part
        a = low if first is None else max(first, low)
        b = low + sources if last is None else min(last + 1, low + sources)
        if a >= b or not m:
            continue
        start, end = 0, m
        if a > low or b < low + sources:
            with files.open_input_file(offsets_file) as f:
                offsets = Offsets(f, at, sources + 1)
                start, end = offsets[a - low], offsets[b - low]
        if start < end:
            wanted.append((part, start, end))
    size = max(int(options.get("block", BLOCK)), -(-sum(end - start for _, start, end in wanted) // RANGES))
    return [(part, x, min(x + size, end)) for part, start, end in wanted for x in range(start, end, size)]


def read_range(options: dict, part: tuple, at: int, end: int):
    """Batches of a part's edges from ``at`` to ``end``."""
    files, _ = filesystem(options["path"])
    offsets_file, offsets_at, pairs_file, pairs_at, low, sources, _ = part
    with files.open_input_file(offsets_file) as f, files.open_input_file(pairs_file) as pairs:
        offsets, source = Offsets(f, offsets_at, sources + 1), None
        while at < end:
            if source is None:
                source = bisect.bisect_right(offsets, at) - 1
            window = offsets.run(source, min(WINDOW, sources - source) + 1)
            if window[-1] <= at:  # sources without edges: go on at the next one that has some
                source = None
                continue
            while at < min(end, window[-1]):
                stop = min(end, int(window[-1]), at + BATCH)
                pairs.seek(pairs_at + PAIR.itemsize * at)
                pair = np.frombuffer(pairs.read(PAIR.itemsize * (stop - at)), PAIR)
                u = low + source + np.searchsorted(window, np.arange(at, stop), "right") - 1
                yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(pair["v"].astype(np.int64)), "thr": pa.array(pair["w"].astype(np.int64))})
                at = stop
            source += len(window) - 1


def bounds_of(filters: list, first: int | None, last: int | None) -> tuple[int | None, int | None, list]:
    """The bounds of u that the filters leave, and those filters that are not bounds of u."""
    from pyspark.sql import datasource as S

    low, high, rest = [] if first is None else [first], [] if last is None else [last], []
    for f in filters:
        if getattr(f, "attribute", None) != ("u",) or type(getattr(f, "value", None)) is not int:
            rest.append(f)
        elif isinstance(f, S.EqualTo):
            low.append(f.value)
            high.append(f.value)
        elif isinstance(f, S.GreaterThan | S.GreaterThanOrEqual):
            low.append(f.value + isinstance(f, S.GreaterThan))
        elif isinstance(f, S.LessThan | S.LessThanOrEqual):
            high.append(f.value - isinstance(f, S.LessThan))
        else:
            rest.append(f)
    return max(low, default=None), min(high, default=None), rest


# ---- writing --------------------------------------------------------------------------------


def write_part(batches, folder: str) -> tuple[str, int, int, int, int] | None:
    """(name, first source, sources, edges, greatest id) of this task's part; its rows come in order of u."""
    files, root = filesystem(folder)
    name, offsets, done, low, after, top = f"part-{uuid.uuid4().hex}", None, 0, 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if any(c.null_count for c in batch.columns):
            raise ValueError("an edge has a null")
        u, v, w = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if min(u.min(), v.min()) < 0 or max(u.max(), v.max()) >= 1 << 32:
            raise ValueError("an id is not of 32 bits")
        if (u[1:] < u[:-1]).any() or (done and u[0] < after - 1):
            raise ValueError("edges are not in order of u")
        if offsets is None:
            files.create_dir(root, recursive=True)
            offsets, pairs = files.open_output_stream(f"{root}/{name}.first"), files.open_output_stream(f"{root}/{name}.arcs")
            low = after = int(u[0])
        end = int(u[-1]) + 1
        for a in range(after, end, WINDOW):
            offsets.write((done + np.searchsorted(u, np.arange(a, min(a + WINDOW, end)), "left")).astype("<u8").tobytes())
        pair = np.empty(len(u), PAIR)
        pair["v"], pair["w"] = v, np.minimum(w, 2**31 - 1)
        pairs.write(pair.tobytes())
        after, done, top = end, done + len(u), max(top, int(u[-1]), int(v.max()))
    if offsets is None:
        return None
    offsets.write(np.array([done], "<u8").tobytes())
    offsets.close()
    pairs.close()
    return name, low, after - low, done, top


def commit(folder: str, written: list[tuple], is_new: bool) -> None:
    """The manifest of the parts written, and of the earlier ones unless is_new, takes the place of the last; parts that it drops are removed."""
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    old = manifest(files, root)
    kept = {"n": 0, "parts": []} if is_new else old
    parts = sorted([*map(tuple, kept["parts"]), *(x[:4] for x in written)], key=lambda x: (x[1], x[0]))
    n = max([kept["n"], *(x[4] + 1 for x in written)])
    draft = f"{root}/.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as f:
        f.write(json.dumps({"n": n, "m": sum(x[3] for x in parts), "parts": parts}).encode())
    files.move(draft, f"{root}/{MANIFEST}")
    if is_new:
        discard(folder, [x[0] for x in old["parts"]])


def discard(folder: str, names: list[str]) -> None:
    """Removes parts that no manifest names."""
    from pyarrow import fs

    files, root = filesystem(folder)
    for name in names:
        for end in ("first", "arcs"):
            if files.get_file_info(f"{root}/{name}.{end}").type == fs.FileType.File:
                files.delete_file(f"{root}/{name}.{end}")


# ---- the data source ------------------------------------------------------------------------


def csr_edges() -> type[DataSource]:
    """The data source; its classes go to the workers by value, and import this module by name."""
    own = ROOT

    def module():
        import importlib
        import sys

        if own not in sys.path:
            sys.path.append(own)
        return importlib.import_module("spreadlab.sources.csr")

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = options
            self.first, self.last = (int(options[k]) if k in options else None for k in ("first", "last"))

        def partitions(self):
            return [InputPartition(x) for x in module().plan(self.options, self.first, self.last)] or [InputPartition(())]

        def read(self, partition):
            if partition.value:
                yield from module().read_range(self.options, *partition.value)

    class PushingReader(Reader):
        def pushFilters(self, filters):
            self.first, self.last, rest = module().bounds_of(filters, self.first, self.last)
            return rest

    class Writer(DataSourceArrowWriter):
        def __init__(self, folder, is_new):
            self.folder, self.is_new = folder, is_new

        def write(self, iterator):
            message = WriterCommitMessage()
            message.part = module().write_part(iterator, self.folder)
            return message

        def commit(self, messages):
            module().commit(self.folder, [m.part for m in messages if m is not None and m.part], self.is_new)

        def abort(self, messages):
            module().discard(self.folder, [m.part[0] for m in messages if m is not None and m.part])

    class CsrEdges(DataSource):
        """spark.read.format("csr_edges").load(path), and df.write.format("csr_edges").mode("append" or "overwrite").save(folder)."""

        @classmethod
        def name(cls):
            return "csr_edges"

        def schema(self):
            return module().SCHEMA

        def reader(self, schema):
            options = {k.lower(): v for k, v in self.options.items()}
            return (PushingReader if options.get("pushdown") == "true" else Reader)(options)

        def writer(self, schema, overwrite):
            return Writer(self.options["path"], overwrite)

    return CsrEdges
