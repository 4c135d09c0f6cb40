"""Unstructured VTK files: pieces of a bounded number of cells written by the tasks, and an index that names them.

Each task writes its own pieces, named by partition and number, so a task that runs again writes the same files once more. Paths are those of
pyarrow's file systems and must be shared by all executors. Cells have corners of their own (pixels in two dimensions, voxels in three).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import corner, real_space
from ..operators.mesh import Config

MODES = ("ascii", "binary", "appended")
#: VTK's numbers of the cell types.
PIXEL, VOXEL = 8, 11
_TYPES = {"float64": "Float64", "float32": "Float32", "int64": "Int64", "int32": "Int32", "uint8": "UInt8"}


def _arrays(points, fields: dict, dim: int):
    """(section, name, components, values) of a piece; ``points``: cells x corners x 3."""
    import numpy as np

    n, corners = len(points), 1 << dim
    yield "Points", "Points", 3, points.reshape(-1)
    yield "Cells", "connectivity", 1, np.arange(n * corners, dtype=np.int64)
    yield "Cells", "offsets", 1, np.arange(1, n + 1, dtype=np.int64) * corners
    yield "Cells", "types", 1, np.full(n, PIXEL if dim == 2 else VOXEL, np.uint8)
    for name, values in fields.items():
        yield "CellData", name, 1, values


def piece(points, fields: dict, dim: int, mode: str = "appended") -> bytes:
    """The text of a piece. ascii: numbers that read back exactly; binary: base64 in place; appended: raw bytes at the end."""
    from xml.sax.saxutils import quoteattr

    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    head = f'<VTKFile type="UnstructuredGrid" version="1.0" byte_order="LittleEndian" header_type="UInt64">\n<UnstructuredGrid>\n<Piece NumberOfPoints="{len(points) << dim}" NumberOfCells="{len(points)}">\n'
    body, tail, at, section = [head], [], 0, None
    for part, name, components, values in _arrays(points, fields, dim):
        if part != section:
            body.append(f"</{section}>\n" if section else "")
            body.append(f"<{part}>\n")
            section = part
        attributes = f'type="{_TYPES[values.dtype.name]}" Name={quoteattr(name)} NumberOfComponents="{components}"'
        raw = len(values) * values.dtype.itemsize
        block = raw.to_bytes(8, "little") + values.astype(values.dtype.newbyteorder("<")).tobytes() if mode != "ascii" else b""
        if mode == "ascii":
            body.append(f'<DataArray {attributes} format="ascii">\n{" ".join(map(repr, values.tolist()))}\n</DataArray>\n')
        elif mode == "binary":
            body.append(f'<DataArray {attributes} format="binary">{(base64.b64encode(block[:8]) + base64.b64encode(block[8:])).decode()}</DataArray>\n')
        else:
            body.append(f'<DataArray {attributes} format="appended" offset="{at}"/>\n')
            tail.append(block)
            at += len(block)
    body.append(f"</{section}>\n</Piece>\n</UnstructuredGrid>\n")
    if tail:
        return "".join(body).encode() + b'<AppendedData encoding="raw">\n_' + b"".join(tail) + b"\n</AppendedData>\n</VTKFile>\n"
    return ("".join(body) + "</VTKFile>\n").encode()


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write(spark: SparkSession, path: str, cells: DataFrame, cfg: Config, names: list[str], mode: str = "appended", cells_per_piece: int = 500_000) -> int:
    """Writes the cells (key, axes, ``names``) in a folder with ``index.pvtu``; returns the number of pieces.

    Null values become NaN. An empty table gives an index without pieces. A task holds one piece in memory.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    dim = cfg.dim
    axes = [F.col(a) for a in cfg.axes]
    xyz = [c for n in range(1 << dim) for c in [*real_space(corner(F.col("key"), axes, cfg.block, n, dim), cfg.low, cfg.scale), *[F.lit(0.0)] * (3 - dim)]]
    rows = cells.select(F.array(*[c.cast("double") for c in xyz]).alias("points"), *[F.col(n).cast("double").alias(f"d{i}") for i, n in enumerate(names)])
    target = path.rstrip("/")
    fs, base = _open(target)
    fs.create_dir(base, recursive=True)

    def pieces(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, number, held, count = TaskContext.get().partitionId(), 0, [], 0
        store, root = _open(target)

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            points = table.column("points").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 1 << dim, 3)
            fields = {n: np.asarray(table.column(f"d{i}").to_numpy(), np.float64) for i, n in enumerate(names)}
            name = f"piece-{part:06d}-{number:06d}.vtu"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(piece(points, fields, dim, mode))
            return pa.RecordBatch.from_pydict({"piece": [name], "cells": pa.array([len(points)], pa.int64())})

        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, cells_per_piece - count)
                held.append(batch.slice(0, take))
                batch, count = batch.slice(take), count + take
                if count == cells_per_piece:
                    yield flush()
                    number, held, count = number + 1, [], 0
        if count:
            yield flush()

    found = sorted(r.piece for r in rows.mapInArrow(pieces, "piece string, cells long").collect())  # one name for half a million cells
    from xml.sax.saxutils import quoteattr

    with fs.open_output_stream(f"{base}/index.pvtu") as out:
        out.write(b'<VTKFile type="PUnstructuredGrid" version="1.0" byte_order="LittleEndian" header_type="UInt64">\n<PUnstructuredGrid GhostLevel="0">\n')
        out.write(b'<PPoints><PDataArray type="Float64" Name="Points" NumberOfComponents="3"/></PPoints>\n<PCellData>\n')
        out.write("".join(f'<PDataArray type="Float64" Name={quoteattr(n)}/>\n' for n in names).encode() + b"</PCellData>\n")
        for name in found:
            out.write(f'<Piece Source="{name}"/>\n'.encode())
        out.write(b"</PUnstructuredGrid>\n</VTKFile>\n")
    return len(found)
