"""Queries on tables whose keys or sizes go beyond the driver's smallest ones."""

from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from tilewright import bridge as B
from tilewright import catalog
from tilewright import schema as S
from tilewright.kernels import batches as KB
from tilewright.kernels import lines as L
from tilewright.kernels import polygons as P
from tilewright.operators import build as BU
from tilewright.sources import files, mvt


def test_merged_slot_is_the_least_with_part_keys_over_a_million(spark, tmp_path):
    line = "SELECT * FROM (VALUES (7::BIGINT, 1::INT, 2500000::BIGINT, 3::BIGINT, 'N', 'O'), (7, 2, 5, 4, 'N', 'O'), (7, 2, 9, 4, 'N', 'F'), (8, 3, 1100000, 4, 'A', 'F')) t(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus)"
    con = duckdb.connect()
    con.execute(f"COPY ({line}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS {line}")
    told = con.execute(catalog.ORACLES["same_attr_merge"])
    names = [c[0] for c in told.description]
    got = catalog.QUERIES["same_attr_merge"](spark, str(tmp_path)).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(told.fetchall())


def test_lines_of_a_batch_are_drawn_as_one_by_one_and_dealt_in_lots():
    rng = np.random.default_rng(5)
    lines = []
    for k in range(60):
        n = int(rng.choice([1, 2, 3, 4, 7, 20, 30]))
        p = rng.random(2) * 1.2 - 0.1 + rng.integers(-8, 8, (n, 2)) * 10.0 ** -rng.integers(4, 7)
        lines.append(np.concatenate((p, p[:1])) if k % 3 == 0 else np.repeat(p, 2, axis=0) if k % 5 == 0 else p)
    pins = [rng.random(len(p)) < 0.2 for p in lines]
    matches = [[{"layer": S.LAYER_ID[name], "min_zoom": z, "paint_rank": 1, "geom": "own", "attrs": [{"key": "kind", "from_zoom": f, "value": "a"} for f in (0, 11)]} for name, z in (("streets", k % 15), ("ferries", 9))[k % 3 :]] for k in range(60)]
    rows = [{"id": k, "closed": False, "xs": p[:, 0].tolist(), "ys": p[:, 1].tolist(), "pins": pins[k].tolist(), "matches": matches[k]} for k, p in enumerate(lines) if matches[k]]
    match = pa.struct([("layer", pa.int32()), ("min_zoom", pa.int32()), ("paint_rank", pa.int32()), ("geom", pa.string()), ("attrs", pa.list_(pa.struct([("key", pa.string()), ("from_zoom", pa.int32()), ("value", pa.string())])))])
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.int64()), ("closed", pa.bool_()), ("xs", pa.list_(pa.float64())), ("ys", pa.list_(pa.float64())), ("pins", pa.list_(pa.bool_())), ("matches", pa.list_(match))]))
    emitter = BU.Emitter(BU.Options())
    one = Counter((*f[:7], tuple(f[7])) for row in rows for f in emitter.way(row))
    got = Counter((*f[:7], tuple(f[7])) for b in BU.line_batches(batch, BU.Options()) for f in zip(*(b.column(c).to_pylist() for c in BU.FEATURE_NAMES), strict=True))
    assert got == one and len(one) > 1000
    x, offsets = np.tile([0.1, 0.9], 50), np.arange(0, 101, 2)
    assert all(b - a == 1 or (b - a) * 2 << KB.MAX_ZOOM <= KB.BUDGET for a, b in KB.lots(x, x, offsets))


def test_queries_of_one_kind_leave_the_other_kinds_undrawn(spark):
    found = spark.createDataFrame([(1, S.LAYER_ID["streets"], "own"), (2, S.LAYER_ID["land"], "own"), (3, S.LAYER_ID["land"], "line"), (4, S.LAYER_ID["sites"], "label")], "id long, layer int, geom string")
    ids = {kind: sorted(r["id"] for r in BU.drawing(found, kind).collect()) for kind in (mvt.POINT, mvt.LINE, mvt.POLYGON)}
    assert ids == {mvt.POINT: [4], mvt.LINE: [1, 3], mvt.POLYGON: [2]}


def test_python_holds_slices_of_a_batch():
    batch = pa.RecordBatch.from_pydict({"a": list(range(1000))})
    sizes = [b.num_rows for b in files.slices(iter([batch, batch]))]
    assert max(sizes) == 256 and sum(sizes) == 2000


def test_tasks_grow_in_number_and_not_in_size(spark):
    rows = spark.range(1000).withColumnRenamed("id", "way")
    partitions = lambda size: B.dealt(rows, "way", size, task=1000).rdd.getNumPartitions()
    assert partitions(60_000) == 60 and partitions(6_000) == 6
    assert partitions(1_000) == rows.rdd.getNumPartitions()


def test_one_measure_tells_the_vertices_that_every_tolerance_keeps():
    rng = np.random.default_rng(8)
    for k in range(120):
        p = rng.random(2) + rng.integers(-6, 6, (int(rng.choice([1, 2, 3, 5, 9, 24, 40])), 2)) / 10.0 ** rng.integers(1, 5)
        closed = k % 2 == 0 and len(p) > 2
        p = np.concatenate((p, p[:1])) if closed else p
        pins = rng.random(len(p)) < 0.15
        walked = KB.chains(p[:, 0].copy(), p[:, 1].copy(), pins, np.array([0, len(p)]), np.array([closed]))
        for z in range(0, 14, 2):
            told = (L.simplify_closed if closed else L.simplify)(p, P.grid_tolerance(z), pins)
            assert walked.at[walked.over > P.grid_tolerance(z) ** 2].tolist() == told.tolist()
