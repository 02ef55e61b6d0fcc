import zlib

import numpy as np

from codewarden.llm import slots
from codewarden.llm.queries import QUERIES
from tests.llm.helpers import EDGES, docs, words

SF = "/root/testdata/sf0.01"


def test_query_keeps_its_law(spark):
    import pyarrow.dataset as ds

    texts = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    want = {r["doc_id"]: r["text"].encode() for r in texts}
    rows = QUERIES["op2_virtual_slots"](spark, SF).collect()
    assert len(rows) == len(want)
    total = np.zeros(24)
    for r in rows:
        assert r["size"] == len(want[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(want[r.doc_id])
        total[r.shard] += r["size"]
    # Slots of a single document bound how near the sizes can come.
    assert total.max() - total.min() <= 2 * slots.TOLERANCE * total.mean() + max(r["size"] for r in rows)
    for shard in range(24):
        mine = sorted(r.slot for r in rows if r.shard == shard)
        assert mine == list(range(len(mine)))
    assert len({(r.virtual_slot, r.shard) for r in rows}) == len({r.virtual_slot for r in rows})


def test_rebalance_levels_and_moves_little():
    r = np.random.default_rng(0)
    for weight in (r.gamma(50, 100, 4096), r.pareto(1.5, 4096) * 100):
        weight = weight.astype(int)
        first = slots.first_map(24)
        edited = slots.rebalance(first, weight, 24)
        total = np.bincount(edited, weight, 24)
        assert total.max() - total.min() <= 2 * slots.TOLERANCE * total.mean() + weight.max()
        assert (edited == slots.rebalance(edited, weight, 24)).all()
        grown = slots.rebalance(edited, weight, 25)
        assert (grown != edited).sum() < 0.4 * len(edited) and len(set(grown)) == 25
        fewer = slots.rebalance(grown, weight, 20)
        assert set(fewer) == set(range(20)) and (fewer[grown < 20] == grown[grown < 20]).mean() > 0.7
    assert (slots.rebalance(first, np.zeros(4096, int), 24) == first).all()


def test_a_slot_depends_on_the_record_alone(spark):
    rows = [(n, words(n, 5)) for n in range(50)]
    one = {r.doc_id: r.virtual_slot for r in slots.records(docs(spark, rows)).collect()}
    two = {r.doc_id: r.virtual_slot for r in slots.records(docs(spark, rows[:7] + [(99, "x")])).collect()}
    assert all(one[n] == two[n] for n in range(7))


def test_versions(spark, tmp_path):
    path = str(tmp_path / "map")
    rows = np.arange(8)
    for version in (1, 2):
        shard_of = slots.first_map(version + 1, 8)
        slots.write_map(slots.map_frame(spark, shard_of, rows, version).drop("version"), path, version)
    latest = {r.virtual_slot: (r.shard, r.offset) for r in slots.read_map(spark, path).collect()}
    assert latest == {0: (0, 0), 1: (0, 0), 2: (0, 1), 3: (1, 0), 4: (1, 3), 5: (1, 7), 6: (2, 0), 7: (2, 6)}
    assert {r.shard for r in slots.read_map(spark, path, 1).collect()} == {0, 1}


def test_edges(spark):
    found = slots.records(docs(spark, EDGES, extra=True))
    _, rows = slots.slot_totals(found)
    frame = slots.map_frame(spark, slots.first_map(3), rows, 1)
    placed = slots.place(found, frame).collect()
    assert len(placed) == len(EDGES)
    assert sorted(r["size"] for r in placed) == [8, 8, 8, 11, 12, 12, 22]
    for shard in range(3):
        mine = sorted(r.slot for r in placed if r.shard == shard)
        assert mine == list(range(len(mine)))
    assert slots.slot_totals(slots.records(docs(spark, [])))[1].sum() == 0
