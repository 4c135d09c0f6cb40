"""VTU pieces read back with a plain XML parser."""

import base64
import re
import xml.etree.ElementTree as ET
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamesh.operators.mesh import Config, uniform
from stratamesh.sources import vtu


def read(path):
    """Arrays by name."""
    raw = Path(path).read_bytes()
    head, mark, tail = raw.partition(b'<AppendedData encoding="raw">\n_')
    root = ET.fromstring(head + b"</VTKFile>" if mark else raw)
    kinds = {"Float64": "<f8", "Int64": "<i8", "UInt8": "u1"}
    out = {}
    for a in root.iter("DataArray"):
        kind = kinds[a.get("type")]
        if a.get("format") == "ascii":
            out[a.get("Name")] = np.array([float(x) for x in a.text.split()]).astype(kind)
            continue
        data = tail[int(a.get("offset")) :] if mark else base64.b64decode(a.text[:12]) + base64.b64decode(a.text[12:])
        size = int.from_bytes(data[:8], "little")
        out[a.get("Name")] = np.frombuffer(data[8 : 8 + size], kind)
    return out, root.find(".//Piece").attrib


@pytest.mark.parametrize("mode", vtu.MODES)
@pytest.mark.parametrize("dim", [2, 3])
def test_cells_read_back(spark, tmp_path, dim, mode):
    cfg = Config(dim=dim, brick=(2, 1, 1)[:dim], periodic=(True,) * dim, block=(2,) * dim, low=(-1.0, 0.5, 0.0)[:dim], scale=2.0)
    cells = uniform(spark, cfg, 1)
    for a in cfg.axes:
        cells = cells.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(1))))
    cells = cells.withColumn("mass & heat", F.col("i") + 0.1).withColumn("odd", F.when(F.col("i") == 1, 2.5)).repartition(3)
    n = vtu.write(spark, f"file://{tmp_path}/out", cells, cfg, ["mass & heat", "odd"], mode, cells_per_piece=7)
    names = re.findall(r'Source="([^"]+)"', (tmp_path / "out/index.pvtu").read_text())
    assert ET.parse(tmp_path / "out/index.pvtu").getroot().tag == "VTKFile" and len(names) == n == len(list((tmp_path / "out").glob("*.vtu")))
    total, volume, mass = 0, 0.0, []
    for name in names:
        arrays, sizes = read(tmp_path / "out" / name)
        points = arrays["Points"].reshape(-1, 1 << dim, 3)
        total += len(points)
        assert int(sizes["NumberOfCells"]) == len(points) <= 7 and int(sizes["NumberOfPoints"]) == len(points) << dim
        assert list(arrays["connectivity"]) == list(range(len(points) << dim)) and list(arrays["offsets"]) == [(i + 1) << dim for i in range(len(points))]
        assert set(arrays["types"]) == {8 if dim == 2 else 11}
        size = points[:, -1] - points[:, 0]  # the corners go from the lowest to the highest, x first
        volume += np.prod(size[:, :dim], axis=1).sum()
        assert (points[:, 1, 0] > points[:, 0, 0]).all() and (points[:, 0, 0] >= -1).all() and (points[:, -1, 0] <= 3).all() and (points[:, -1, 1] <= 2.5).all()
        mass += list(arrays["mass & heat"])
        assert (np.isnan(arrays["odd"]) == (arrays["mass & heat"] < 1)).all()
    assert total == cells.count() and volume == pytest.approx(2 * 2.0**dim)
    assert sorted(set(mass)) == [0.1, 1.1]


def test_no_cells_and_unknown_modes(spark, tmp_path):
    cfg = Config()
    cells = uniform(spark, cfg, 0).limit(0).selectExpr("key", "0 AS i", "0 AS j", "1.0 AS a")
    assert vtu.write(spark, f"file://{tmp_path}/none", cells, cfg, ["a"]) == 0
    with pytest.raises(ValueError, match="unknown mode"):
        vtu.write(spark, f"file://{tmp_path}/none", cells, cfg, ["a"], "xml")
