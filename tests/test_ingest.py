"""The small heap of two classes against values worked out by hand."""

import pytest
from hprof_writer import Writer, small_heap

from heapscope.operators import dominators, edges
from heapscope.plans.graph import Graph
from heapscope.plans.ingest import ingest
from heapscope.sources import hprof as H

#: address, class id, used size, dominator, retained size, references, referrers
GOLDEN = {
    0: (0x0, 2, 256, -1, 256, [2], [7, 8]),
    1: (0x100, 1, 0, -1, 0, [], [7, 8]),
    2: (0x200, 1, 0, -1, 0, [], [0]),
    3: (0x300, 1, 0, 10, 0, [], [10]),
    4: (0x4000, 8, 256, -1, 1280, [8, 9], []),
    5: (0x5000, 7, 256, 9, 512, [7, 10], [9]),
    6: (0x6000, 7, 256, 9, 256, [7], [9]),
    7: (0x10000, 1, 0, -1, 0, [1, 0], [5, 6, 9, 8]),
    8: (0x11000, 1, 0, -1, 0, [1, 0, 7], [4]),
    9: (0x20000, 7, 256, 4, 1024, [7, 5, 6], [4]),
    10: (0x30000, 3, 256, 5, 256, [3], [5]),
}


@pytest.fixture(scope="module")
def heap(spark, tmp_path_factory):
    dump = ingest(spark, small_heap(tmp_path_factory.mktemp("h") / "small.hprof"))
    return dump, Graph(dump.raw)


def listed(df, key, value):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r[key], r["seq"])):
        out.setdefault(r[key], []).append(r[value])
    return out


def test_header_and_sizes(heap):
    dump, _ = heap
    assert (dump.header.id_size, dump.header.created_ms, dump.ref_size, dump.step) == (4, 1234567890, 4, 256)
    assert {dump.classes[a].name for a in (0x100, 0x200, 0x300)} == {"java.lang.Class", "java.lang.ClassLoader", "int[]"}


def test_objects_and_dominators(heap):
    _, g = heap
    objects = {r["object_id"]: r for r in g.objects.collect()}
    tree = {r["object_id"]: r for r in g.dominators.collect()}
    assert sorted(objects) == sorted(GOLDEN)
    for i, (address, class_id, size, up, retained, _, _) in GOLDEN.items():
        assert (objects[i]["address"], objects[i]["class_id"], objects[i]["used_size"]) == (address, class_id, size), i
        assert (tree[i]["idom"], tree[i]["retained"]) == (up, retained), i
    assert g.total == 1536


def test_references(heap):
    _, g = heap
    out, into = listed(g.edges, "src", "dst"), listed(edges.inbound(g.edges), "dst", "src")
    for i, (*_, refs, referrers) in GOLDEN.items():
        assert out.get(i, []) == refs and into.get(i, []) == referrers, i
    assert g.n_references == 15
    read = listed(g.read_edges, "src", "dst")
    assert [read[i] for i in (1, 2, 3)] == [[1], [1], [1]]


def test_children_statistics_and_histogram(heap):
    _, g = heap
    children = {}
    for r in sorted(dominators.dominated_children(g.dominators).collect(), key=lambda r: (r["idom"], r["nr"])):
        children.setdefault(r["idom"], []).append(r["object_id"])
    assert children[-1] == [4, 0, 1, 2, 7, 8] and children[9] == [5, 6]
    stats = {r["class_id"]: (r["n_objects"], r["used_size"]) for r in g.histogram.collect()}
    assert stats == {1: (5, 0), 2: (1, 256), 3: (1, 256), 7: (3, 768), 8: (1, 256)}
    assert {r["class_id"]: r["retained"] for r in g.class_retained.collect()} == {2: 256, 3: 256, 7: 1024, 8: 1280}
    gone = [tuple(r) for r in g.unreachable_histogram.collect()]
    assert gone == [(0x11000, "com.example.Child", 1, 256)]


def test_duplicate_records(spark, tmp_path):
    w = Writer()
    w.string(1, "A")
    w.string(2, "refField")
    w.load_class(1, 0x1000, 1)
    for _ in range(2):
        w.class_dump(0x1000, fields=[(2, 2)])
    for target in (0x9000, 0x1000):
        w.instance(0x5000, 0x1000, w.id(target))
    w.instance(0x9000, 0x1000)
    w.segment()
    g = Graph(ingest(spark, w.write(tmp_path / "d.hprof")).raw, keep_unreachable=True)
    rows = {r["address"]: r["object_id"] for r in g.objects.collect()}
    assert listed(g.edges, "src", "dst")[rows[0x5000]] == [rows[0x1000], rows[0x9000]]


def test_layout_and_truncated_fields(spark, tmp_path):
    w = Writer()
    names = ["Base", "Sub", "bool", "baseRef", "subRef"]
    for i, t in enumerate(names, 1):
        w.string(i, t)
    w.load_class(1, 0x1000, 1)
    w.load_class(2, 0x2000, 2)
    w.class_dump(0x1000, fields=[(3, 4), (4, 2)])
    w.class_dump(0x2000, up=0x1000, fields=[(5, 2)])
    w.instance(0x5000, 0x2000, w.id(0x9001) + b"\1" + w.id(0x9000))
    w.instance(0x6000, 0x2000, w.id(0x9001) + b"\1")
    w.instance(0x9000, 0x1000)
    w.instance(0x9001, 0x1000)
    w.segment()
    dump = ingest(spark, w.write(tmp_path / "t.hprof"))
    assert [(n, t, at) for _, n, t, at in dump.layout_of(0x2000)] == [("subRef", 2, 0), ("bool", 4, 4), ("baseRef", 2, 5)]
    refs = {(r["src_address"], r["dst_address"]) for r in dump.raw.refs.where("seq > 0").collect()}
    assert {(0x5000, 0x9001), (0x5000, 0x9000), (0x6000, 0x9001)} <= refs and (0x6000, 0x9000) not in refs


def test_odd_records(spark, tmp_path):
    w = Writer()
    w.segment()
    w.record(0x5A, b"12345678")
    w.root(0xFF, 0x4000)
    w.class_dump(100)
    w.instance(0x4000, 100)
    w.segment(0x1C)
    w.segment()
    dump = ingest(spark, w.write(tmp_path / "o.hprof"))
    assert [r["address"] for r in dump.raw.roots.where("root_type = 255").collect()] == [0x4000]
    assert dump.classes[100].name == "Class@64"
    assert 0x4000 in {r["address"] for r in Graph(dump.raw).objects.collect()}


def test_broken_files(tmp_path):
    for name, raw in (("a", b"JAVA"), ("b", b"x" * 200), ("c", b"J\0\0\0\0\5" + b"\0" * 8)):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(H.HprofError):
            H.segments(str(tmp_path / name))
    with pytest.raises(H.HprofError):
        H.checked_path("x.hprof.gz")
