import zlib
from collections import Counter, defaultdict

import xxhash

from skein.llm import sharding
from skein.llm.sharding import SlotMap


def check(rows, got, shards):
    now = SlotMap.of(shards)
    grown = now.grown()
    want, loads = [], Counter()
    for d, t in rows:
        data = (t or "").encode()
        v = (xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), 42) if d is not None else 42) if d is not None else None
        if v is None:
            slot = 42 % sharding.SLOTS
        else:
            slot = (v - (1 << 64) if v >> 63 else v) % sharding.SLOTS
        loads[slot] += len(data) + 16
        want.append((d, len(data) + 16, zlib.crc32(data), "key", now.owners[slot], grown.owners[slot], slot))
    assert Counter(want) == Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard, r.virtual_slot) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.slot_bytes == loads[r.virtual_slot]
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_maps():
    for n in (1, 2, 7, 40):
        m, g = SlotMap.of(n), SlotMap.of(n + 1)
        assert m.grown() == g and g.version == m.version + 1
        counts = Counter(m.owners)
        assert len(counts) == n and max(counts.values()) - min(counts.values()) <= 1 + n // 8
        assert all(b in (a, n) for a, b in zip(m.owners, g.owners))


def test_rebalanced():
    m = SlotMap.of(8)
    load = {s: 1000 + (s * s) % 700 + 3000 * (m.owners[s] == 3) for s in range(sharding.SLOTS)}
    out = m.rebalanced(load)
    sums = Counter()
    for s, shard in enumerate(out.owners):
        sums[shard] += load[s]
    assert max(sums.values()) - min(sums.values()) <= 0.02 * sum(sums.values()) / 8
    assert out.version == m.version + 1
    assert sum(a != b for a, b in zip(m.owners, out.owners)) < sharding.SLOTS // 3
    assert m.rebalanced({}).owners == m.owners


def test_odd_rows(spark):
    rows = [(1, "é"), (1, "é"), (None, None), (None, "x"), (7, ""), (8, None), (2**62, "long " * 40000)] + [(5, "hot")] * 200
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, shard int").repartition(5)
    check(rows, sharding.assigned(docs, 4).collect(), 4)
    assert sharding.assigned(docs.limit(0), 4).count() == 0


def test_op8(spark, sf):
    from skein.llm.queries import op8_virtual_slot_shards

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    frame = op8_virtual_slot_shards(spark, sf)
    check(rows, frame.collect(), 40)
    assert "Python" not in frame._jdf.queryExecution().toString() and "Arrow" not in frame._jdf.queryExecution().toString()
