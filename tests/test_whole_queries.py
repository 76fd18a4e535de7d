from collections import defaultdict

import __spark_entry__

import pytest

from heapscope.plans import commands, dump_queries, registry

SF = "/root/testdata/sf0.001"


def test_consumers_suspects_and_paths(spark):
    every = __spark_entry__.queries()
    names = ["leak_suspects_and_points", "top_consumers_by_kind", "merged_class_paths", "shortest_paths_of_class"]
    assert set(names) <= set(every)
    g = registry.graph(spark, SF)
    tree = {r["object_id"]: r for r in g.dominators.collect()}
    objects = {r["object_id"]: r for r in g.objects.collect()}
    classes = {r["object_id"]: r for r in g.classes.collect()}
    kinds = {
        "object": lambda i: str(objects[i]["address"]),
        "class": lambda i: classes[objects[i]["class_id"]]["name"],
        "loader": lambda i: str(classes[objects[i]["class_id"]]["loader_address"]),
        "package": lambda i: classes[objects[i]["class_id"]]["name"].rpartition(".")[0],
    }
    top = [i for i, r in tree.items() if r["idom"] == -1]

    def grouped(kind, chosen):
        out = defaultdict(lambda: [0, 0])
        for i in chosen:
            out[kinds[kind](i)][0] += 1
            out[kinds[kind](i)][1] += tree[i]["retained"]
        return out

    want = {(k, w, n, kept) for k in kinds for w, (n, kept) in grouped(k, top).items() if kept * 100 >= g.total}
    got = {tuple(r[c] for c in ("kind", "what", "n_objects", "retained")) for r in every["top_consumers_by_kind"](spark, SF).collect()}
    assert got == want and {k for k, *_ in got} >= {"class", "loader", "package"}

    children = defaultdict(list)
    for i, r in tree.items():
        children[r["idom"]].append(i)

    def point(i):
        while children[i]:
            child = max(children[i], key=lambda c: (tree[c]["retained"], -c))
            if tree[child]["retained"] < 0.7 * tree[i]["retained"]:
                break
            i = child
        return objects[i]["address"]

    for percent, query in ((10.0, lambda: every["leak_suspects_and_points"](spark, SF)), (2.0, lambda: commands.leaks(g, 2.0))):
        least = g.total * percent / 100
        want = {("object", str(objects[i]["address"]), 1, tree[i]["retained"], point(i)) for i in top if tree[i]["retained"] >= least}
        want |= {("class", w, n, kept, None) for w, (n, kept) in grouped("class", [i for i in top if tree[i]["retained"] < least]).items() if kept >= least}
        assert {tuple(r[c] for c in ("kind", "what", "n_objects", "retained", "accumulation")) for r in query().collect()} == want

    chosen = {i for i in objects if kinds["class"](i) == "db.sales.Customer"}
    paths = {r["object_id"]: [int(x) for x in r["path"].split(">")] for r in every["shortest_paths_of_class"](spark, SF).collect()}
    assert set(paths) == chosen and all(p[-1] == i for i, p in paths.items())
    merged = defaultdict(int)
    for p in paths.values():
        for n in range(1, len(p) + 1):
            merged[">".join(kinds["class"](x) for x in p[:n])] += 1
    assert {r["classes"]: r["n_objects"] for r in every["merged_class_paths"](spark, SF).collect()} == merged


@pytest.mark.parametrize(("query", "by"), [("dump_component_report_top", "loader_address"), ("dump_component_report_packages", "package")])
def test_component_reports(spark, query, by):
    _, g = dump_queries.dump(spark, SF)
    tree = {r["object_id"]: (r["idom"], r["retained"]) for r in g.dominators.collect()}
    classes = {r["object_id"]: r for r in g.classes.collect()}
    objects = {r["object_id"]: r for r in g.objects.collect()}
    name = {i: classes[r["class_id"]]["name"] for i, r in objects.items()}
    part = {i: name[i].rpartition(".")[0] if by == "package" else str(classes[r["class_id"]]["loader_address"]) for i, r in objects.items()}

    def above(i):
        while (i := tree[i][0]) >= 0:
            yield i

    kept, size = defaultdict(set), defaultdict(int)
    for i in objects:
        for p in {part[i], *(part[u] for u in above(i))}:
            kept[p].add(i)
        if part[i] not in {part[u] for u in above(i)}:
            size[part[i]] += tree[i][1]
    large = {p for p, n in size.items() if n * 100 >= g.total}
    assert large and len(large) < len(size) or by == "loader_address"
    want = defaultdict(lambda: [0, 0])

    def add(p, section, what, i, n=1):
        want[p, section, what][0] += n
        want[p, section, what][1] += objects[i]["used_size"]

    text = {r["object_id"]: r["value"] for r in g.strings.collect()}
    fields = defaultdict(dict)
    for r in g.fields.where("not hidden").collect():
        fields[r["object_id"]][r["field"]] = r["i"] if r["kind"] == "integer" else r["ref_id"]
    length = {r["object_id"]: r["length"] for r in g.lengths.collect()}
    weak = {f["referent"] for i, f in fields.items() if name[i] == "java.lang.ref.WeakReference"}
    final = {f["referent"] for i, f in fields.items() if name[i] == "java.lang.ref.Finalizer"}
    later = defaultdict(int)  # entries that another one of the chain leads to
    chained = {i: f["next"] for i, f in fields.items() if name[i] in ("java.util.HashMap$Node", "java.util.Hashtable$Entry") and f["next"]}
    holders = {f["table"]: i for i, f in fields.items() if f.get("table")}
    slots = defaultdict(set)
    for r in g.edges.where("seq > 0").collect():
        if r["src"] in holders:
            slots[holders[r["src"]]].add(r["dst"])
    for m, heads in slots.items():
        for i in heads:
            while i in chained:
                i = chained[i]
                later[m] += 1
    tables = {"java.util.ArrayList": ("size", "elementData"), "java.util.HashMap": ("size", "table"), "java.util.Hashtable": ("count", "table")}
    for p in large:
        for i in kept[p]:
            add(p, "retained", name[i], i)
            if part[i] == p:
                add(p, "instances", name[i], i)
            if i in text:
                add(p, "duplicate strings", text[i], i)
            for kind in tables if name[i] in tables or name[i] == "java.util.Properties" else ():
                if name[i] == kind or (kind, name[i]) == ("java.util.Hashtable", "java.util.Properties"):
                    used, room = fields[i][tables[kind][0]], length.get(fields[i][tables[kind][1]], 0)
                    add(p, "collections", f"{kind} {min(5, -(-used * 5 // room)) if room else 0}", i)
            if later[i]:
                add(p, "map collisions", name[i], i, later[i])
            if i in weak:
                add(p, "weak references", name[i], i)
            if i in final:
                add(p, "finalizers", name[i], i)
    want = {k: tuple(v) for k, v in want.items() if k[1] != "duplicate strings" or v[0] > 1}
    got = {(r["component"], r["section"], r["what"]): (r["n_objects"], r["used_size"]) for r in registry.whole_queries()[query](spark, SF).collect()}
    assert got == want
    assert {k[1] for k in got} >= {"instances", "retained", "collections", "finalizers"}
