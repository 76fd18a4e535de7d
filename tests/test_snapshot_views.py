"""A heap with strings, a map, references and threads: values, stacks, queries, snapshots."""

import struct

import pytest
from hprof_writer import Writer, small_heap

from heapscope import __main__ as cli
from heapscope.plans import commands, oql, snapshot, views
from heapscope.plans.graph import Graph
from heapscope.plans.ingest import ingest

NAMES = [
    "java/lang/Object", "java/lang/String", "value", "hash", "java/util/HashMap", "table", "size", "java/util/HashMap$Node", "key", "next", "java/lang/ref/Reference", "referent",
    "java/lang/ref/WeakReference", "java/lang/Thread", "name", "run", "()V", "T.java", "[Ljava/util/HashMap$Node;", "java/lang/Class", "java/lang/ClassLoader",
]
ID = {n: i for i, n in enumerate(NAMES, 1)}
OBJ, STR, MAP, NODE, REF, WEAK, THREAD, NODES, CLS, CL = (0x1000 + 0x40 * i for i in range(10))


def rich_heap(path):
    w = Writer(id_size=8)
    for n, i in ID.items():
        w.string(i, n)
    for serial, (address, name) in enumerate([(OBJ, NAMES[0]), (STR, NAMES[1]), (MAP, NAMES[4]), (NODE, NAMES[7]), (REF, NAMES[10]), (WEAK, NAMES[12]), (THREAD, NAMES[13]), (NODES, NAMES[18]), (CLS, NAMES[19]), (CL, NAMES[20])], 1):
        w.load_class(serial, address, ID[name])
    w.frame(0x9001, ID["run"], ID["()V"], ID["T.java"], 7, 42)
    w.frame(0x9002, ID["run"], ID["()V"], 0, 7, -3)
    w.trace(1, 0, [])
    w.trace(2, 5, [0x9001, 0x9002])
    w.class_dump(OBJ)
    for address, up, fields in (
        (STR, OBJ, [("value", 2), ("hash", 10)]), (MAP, OBJ, [("table", 2), ("size", 10)]), (NODE, OBJ, [("hash", 10), ("key", 2), ("value", 2), ("next", 2)]),
        (REF, OBJ, [("referent", 2)]), (WEAK, REF, []), (THREAD, OBJ, [("name", 2)]), (NODES, OBJ, []), (CLS, OBJ, []), (CL, OBJ, []),
    ):
        w.class_dump(address, up=up, fields=[(ID[n], t) for n, t in fields])
    w.root(8, 0x5000, 5, 2)
    w.root(3, 0x6000, 5, 0)
    w.root(5, OBJ)
    q = lambda *x: struct.pack(f">{len(x)}Q", *x)
    w.instance(0x5000, THREAD, q(0x7000))
    w.instance(0x6000, MAP, q(0x6100) + struct.pack(">i", 2))
    w.object_array(0x6100, NODES, [0, 0x6200, 0, 0])
    w.instance(0x6200, NODE, struct.pack(">i", 1) + q(0x7000, 0x7010, 0x6240))
    w.instance(0x6240, NODE, struct.pack(">i", 1) + q(0x7010, 0, 0))
    w.instance(0x7000, STR, q(0x7100) + struct.pack(">i", 9))
    w.instance(0x7010, STR, q(0x7200) + struct.pack(">i", 9))
    w.primitive_array(0x7100, 5, "H", [ord(c) for c in "key-é"])
    w.primitive_array(0x7200, 5, "H", [ord("z")] * 4)
    w.instance(0x8000, WEAK, q(0x8100))
    w.instance(0x8100, OBJ)
    w.root(1, 0x8000)
    w.segment()
    return w.write(path)


@pytest.fixture(scope="module")
def rich(spark, tmp_path_factory):
    dump = ingest(spark, rich_heap(tmp_path_factory.mktemp("r") / "rich.hprof"))
    return dump, views.with_values(dump, Graph(dump.raw))


def ids_of(graph):
    return {r["address"]: r["object_id"] for r in graph.objects.collect()}


def test_strings_and_fields(rich):
    dump, g = rich
    at = ids_of(g)
    assert {r["object_id"]: r["value"] for r in g.strings.collect()} == {at[0x7000]: "key-é", at[0x7010]: "zzzz"}
    sizes = {r["address"]: r["i"] for r in views.field_values(dump).where("field = 'size'").collect()}
    assert sizes == {0x6000: 2}
    part = {r["address"]: r for r in views.elements(views.array_bodies(dump), 1, 2).collect()}
    assert part[0x7200]["integers"] == [122, 122] and part[0x6100]["refs"] == [0x6200, None] and part[0x6100]["integers"] is None
    assert [r["address"] for r in views.constant_arrays(dump).collect()] == [0x7200]


def test_maps_and_references(rich):
    _, g = rich
    at = ids_of(g)
    entries = {(r["map_id"], r["slot"], r["key_id"], r["value_id"]) for r in views.map_entries(g).collect()}
    assert entries == {(at[0x6000], at[0x6200], at[0x7000], at[0x7010]), (at[0x6000], at[0x6200], at[0x7010], None)}
    row = views.map_collisions(g).first()
    assert (row["n_entries"], row["n_slots"], row["ratio"]) == (2, 1, 0.5)
    stats = views.reference_statistics(g, "java.lang.ref.WeakReference").collect()
    assert [(r["name"], r["n_objects"], r["n_only"]) for r in stats] == [("java.lang.Object", 1, 1)]
    assert [r["capacity"] for r in views.collections(g, "java.util.HashMap", "size", "table").collect()] == [4]


def test_threads(rich):
    dump, g = rich
    text = views.threads_text(dump).collect()
    assert [r["text"] for r in text] == ["Thread 0x5000\n  at java.lang.Thread.run()V (T.java:42)\r\n  at java.lang.Thread.run()V ((Native Method))\r\n\n  locals:\n    objectId=0x6000, line=0\n\n"]
    row = views.thread_overview(dump, g).first()
    assert (row["thread_address"], row["depth"], row["n_locals"]) == (0x5000, 2, 1)
    assert {r["address"]: r["thread_address"] for r in g.roots.collect()}[0x6000] == 0x5000
    at = ids_of(g)
    assert g.edges.where(f"src = {at[0x5000]} and dst = {at[0x6000]}").count() == 1


def test_queries(rich):
    _, g = rich
    at = ids_of(g)
    run = lambda text: sorted(tuple(r) for r in oql.run(g, text).collect())
    assert run("SELECT s.value.length AS n, toString(s) AS t FROM java.lang.String s WHERE s.hash = 9 AND s.value.@length > 4") == [(5, "key-é")]
    assert run('SELECT n.key.@objectId AS k FROM "java.util.HashMap.*" n WHERE n.next != null') == [(at[0x7000],)]
    assert run("SELECT count(*) AS n FROM INSTANCEOF java.lang.ref.Reference r WHERE r.referent != null") == [(1,)]
    assert run(f"SELECT o.@objectAddress AS a FROM {at[0x7000]}, {at[0x8100]} o") == [(0x7000,), (0x8100,)]
    assert run("SELECT DISTINCT classof(o).@name AS n FROM OBJECTS (SELECT s.@objectId FROM java.lang.String s) o") == [("java.lang.String",)]
    assert run("SELECT o.@usedHeapSize * 2 - o.@usedHeapSize AS u FROM java.lang.Thread o WHERE NOT (o.@usedHeapSize IN (1, 2) OR o.@usedHeapSize < 0)") == run("SELECT o.@usedHeapSize AS u FROM java.lang.Thread o")
    assert run("SELECT c.@objectAddress AS a FROM OBJECTS INSTANCEOF java.lang.ref.Reference c") == [(REF,), (WEAK,)]
    assert run('SELECT c.@objectAddress AS a FROM OBJECTS ${snapshot.getClassesByName("java.lang.ref.Reference", false)} c') == [(REF,)]
    assert run("SELECT count(*) AS n FROM ${ snapshot.getClassesByName('java.lang.ref.Reference', true) } r") == [(1,)]
    assert run("SELECT count(*) AS n FROM OBJECTS ${snapshot.getClasses()} c") == [(g.classes.count(),)]
    assert run("SELECT s.@classSpecificName AS t, s.@technicalName AS n FROM 0x7000, 0x8100 s WHERE s.@objectAddress < 0x8000") == [("key-é", "java.lang.String @ 0x7000")]
    for wrong in ("SELECT * FROM ${snapshot.delete()}", "SELECT * FROM 1, 0x10 s", "SELECT", "SELECT o. FROM x", "SELECT o.nothing FROM java.lang.String o", "SELECT * FROM java.lang.String s extra words", "SELECT o.@nothing FROM java.lang.String o"):
        with pytest.raises(oql.OqlError):
            oql.run(g, wrong).collect()


def test_paths(rich):
    _, g = rich
    at = ids_of(g)
    target = g.objects.where(f"object_id = {at[0x7200]}").select("object_id")
    path = commands.paths_to_roots(g, target).first()["path"]
    assert path == [at[a] for a in (0x5000, 0x6000, 0x6100, 0x6200, 0x7010, 0x7200)]
    merged = {tuple(r["classes"]): r["n_objects"] for r in commands.merged_paths(g, target).collect()}
    assert merged[("java.lang.Thread", "java.util.HashMap")] == 1
    kept = {r["object_id"] for r in commands.only_through(g, g.objects.where(f"object_id = {at[0x6000]}")).collect()}
    # with their classes, which nothing else refers to here
    assert kept == {at[a] for a in (0x6000, 0x6100, 0x6200, 0x6240, 0x7010, 0x7200, MAP, NODE, NODES)}
    lines = [r["line"] for r in commands.tree_text(g, 3, 2).collect()]
    assert lines and not lines[0].startswith(" ")
    assert commands.suspects(g, 1.0).count() > 0 and commands.accumulation_points(g, 1.0).count() > 0


def test_snapshot(spark, rich, tmp_path):
    dump, g = rich
    at, folder = ids_of(g), str(tmp_path / "snap")
    with pytest.raises(snapshot.SnapshotError):
        snapshot.Snapshot(spark, folder)
    s = snapshot.save(g, folder, snapshot.dump_info(dump))
    with pytest.raises(snapshot.SnapshotError):
        snapshot.save(g, folder)
    assert s.facts["n_objects"] == g.objects.count() and s.total == g.total and s.facts["id_size"] == 8
    assert [r["src"] for r in s.inbound(at[0x7100]).collect()] == [at[0x7000]]
    assert [r["dst"] for r in s.outbound(at[0x7000]).collect()] == [at[STR], at[0x7100]]
    assert s.dominator(at[0x7100]) == at[0x7000] and s.retained_size(at[0x7100]) == s.objects.where(f"object_id = {at[0x7100]}").first()["used_size"]
    assert {r["object_id"] for r in s.instances(at[STR]).collect()} == {at[0x7000], at[0x7010]}
    assert oql.run(s, "SELECT count(*) AS n FROM java.lang.String s").first()["n"] == 2
    # values are kept too, and asked for alike
    texts = ["SELECT s.value.length AS n, toString(s) AS t FROM java.lang.String s WHERE s.hash = 9", "SELECT t.@displayName AS shown, t.name.@objectId AS name FROM java.lang.Thread t"]
    assert [sorted(map(tuple, oql.run(s, t).collect())) for t in texts] == [sorted(map(tuple, oql.run(g, t).collect())) for t in texts]
    assert oql.run(s, texts[1]).first()["shown"] == "java.lang.Thread @ 0x5000  key-é"
    bare = snapshot.save(Graph(dump.raw), str(tmp_path / "bare"))
    with pytest.raises(oql.OqlError):
        oql.run(bare, texts[0])
    assert oql.answered(bare, texts[0]).first()["error"] == "this heap has no field values"
    s.views("heap_")
    assert spark.sql("SELECT sum(used_size) AS s FROM heap_objects").first()["s"] == g.total
    assert s.overview().count() == len(s.facts)


def test_command_line(spark, tmp_path, capsys):
    path = small_heap(tmp_path / "small.hprof")
    assert cli.main(["estimate", path]) == 0 and '"objects": 6' in capsys.readouterr().out
    assert cli.main(["ingest", path]) == 0 and cli.main(["ingest", path]) == 1
    assert cli.main(["query", str(tmp_path / "small.heapscope"), "SELECT count(*) AS n FROM com.example.Base b", "SELECT x FROM"]) == 0
    out = capsys.readouterr().out
    assert "COLUMNS n\nROWS 1\n3\nEND" in out and "ERROR" in out
    assert cli.main(["nothing"]) == 2 and cli.main(["ingest", str(tmp_path / "absent.hprof")]) == 1
