"""SQL for the registered queries, over the relational tables. It builds the same heap by its own definitions and computes
the results relationally: recursive queries for reachability, counts of distinct referrers for dominators."""

from __future__ import annotations

from . import dump_queries

K = 1 << 40

#: number, name, superclass, loader: the class table of the relational heap (fixed values).
CLASS_ROWS = """(1,'java.lang.Class',2,0),(2,'java.lang.Object',0,0),(3,'db.geo.Region',12,1),(4,'db.geo.Nation',12,1),(5,'db.sales.Customer',12,1),
 (6,'db.sales.Order',12,1),(7,'db.sales.LineItem',12,1),(8,'db.shared.OrderFlag',13,1),(9,'db.shared.ShipDay',13,1),(10,'db.shared.CustomerYear',13,1),
 (11,'db.peer.Supplier',2,2),(12,'db.Row',2,1),(13,'db.Shared',12,1),(14,'java.lang.ClassLoader',2,0),(15,'db.shared.ShipDay',13,2)"""

BASE = f"""
cls AS (SELECT (n*256)::BIGINT AS address, name, (up*256)::BIGINT AS super_address, CASE WHEN ld=0 THEN 0 ELSE 12*{K}+ld END::BIGINT AS loader_address FROM (VALUES {CLASS_ROWS}) v(n,name,up,ld)),
ln AS (SELECT l_orderkey AS o, o_custkey AS c, l_linenumber AS nr, l_orderkey*8+l_linenumber AS item,
   l_orderkey*4 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag,
   date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day,
   o_custkey*64 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END*16 + CASE l_linestatus WHEN 'F' THEN 0 ELSE 8 END + year(l_shipdate)%8 AS yr
   FROM lineitem JOIN orders ON l_orderkey=o_orderkey),
it AS (SELECT DISTINCT o, c, nr, item FROM ln),
obj AS (SELECT address::BIGINT AS address, class_address::BIGINT AS class_address, used_size::BIGINT AS used_size FROM (
 SELECT 1*{K}+r_regionkey AS address, 3*256 AS class_address, 24 AS used_size FROM region UNION ALL
 SELECT 2*{K}+n_nationkey, 4*256, 32 FROM nation UNION ALL
 SELECT 3*{K}+c_custkey, 5*256, 40+8*(c_custkey%4) FROM customer UNION ALL
 SELECT 4*{K}+o_orderkey, 6*256, 48+8*(o_orderkey%3) FROM orders UNION ALL
 SELECT 5*{K}+item, 7*256, 56+8*nr FROM it UNION ALL
 SELECT DISTINCT 6*{K}+flag, 8*256, 16 FROM ln UNION ALL
 SELECT DISTINCT 7*{K}+day, 9*256, 24 FROM ln UNION ALL
 SELECT DISTINCT 8*{K}+yr, 10*256, 32 FROM ln UNION ALL
 SELECT 10*{K}+s_suppkey, 11*256, 40 FROM supplier UNION ALL
 SELECT 0, 14*256, 32 UNION ALL SELECT 12*{K}+1, 14*256, 64 UNION ALL SELECT 12*{K}+2, 14*256, 64 UNION ALL
 SELECT address, 256, 8 FROM cls)),
held AS (
 SELECT 1*{K}+n_regionkey AS s, 2*{K}+n_nationkey AS d FROM nation UNION ALL
 SELECT 2*{K}+c_nationkey, 3*{K}+c_custkey FROM customer WHERE c_mktsegment<>'MACHINERY' UNION ALL
 SELECT 3*{K}+o_custkey, 4*{K}+o_orderkey FROM orders UNION ALL
 SELECT 4*{K}+o, 5*{K}+item FROM it UNION ALL
 SELECT 5*{K}+item, 6*{K}+flag FROM ln UNION ALL SELECT 5*{K}+item, 7*{K}+day FROM ln UNION ALL SELECT 5*{K}+item, 8*{K}+yr FROM ln UNION ALL
 SELECT 10*{K}+s_suppkey, 10*{K}+s_suppkey+CASE WHEN s_suppkey%2=1 THEN 1 ELSE -1 END FROM supplier UNION ALL
 SELECT address, super_address FROM cls WHERE super_address<>0 UNION ALL SELECT address, loader_address FROM cls),
dangling AS (SELECT 3*{K}+o_custkey AS s, 4*{K}+o_orderkey+10000000000 AS d FROM orders WHERE o_orderkey%97=0),
ids AS (SELECT address, row_number() OVER (ORDER BY address)-1 AS id FROM obj),
rts AS (SELECT address, 5 AS root_type FROM cls UNION ALL SELECT 1*{K}+r_regionkey, 1 FROM region UNION ALL SELECT 12*{K}+1, 1 UNION ALL SELECT 12*{K}+2, 1),
alle AS (SELECT address AS s, class_address AS d FROM obj UNION SELECT h.s, h.d FROM held h JOIN obj o ON o.address=h.d),
reach AS (SELECT address FROM rts UNION SELECT alle.d FROM reach JOIN alle ON alle.s=reach.address)"""

#: Of what is left: numbered objects n, references e (src, seq, dst).
LIVE = f"""{BASE},
n AS (SELECT o.address, row_number() OVER (ORDER BY o.address)-1 AS id, o.class_address, o.used_size FROM obj o JOIN reach r USING (address)),
pairs AS (SELECT s.id AS src, t.id AS dst, min(CASE WHEN s.class_address=t.address THEN 0 ELSE 1 END) AS later FROM alle JOIN n s ON s.address=alle.s JOIN n t ON t.address=alle.d GROUP BY 1,2),
e AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY later, dst)-1 AS seq, dst FROM pairs)"""

#: Dominators in closed form: a tree object's is its owner; a shared object's the lowest level at which its live referrers have one owner.
TREE = f"""{LIVE},
live AS (SELECT ln.*, c_nationkey AS na, n_regionkey AS re FROM ln JOIN customer ON c=c_custkey JOIN nation ON c_nationkey=n_nationkey WHERE c_mktsegment<>'MACHINERY'),
sh AS (SELECT 6*{K}+flag AS address, * FROM live UNION ALL SELECT 7*{K}+day, * FROM live UNION ALL SELECT 8*{K}+yr, * FROM live),
up AS (
 SELECT address, CASE WHEN count(DISTINCT item)=1 THEN 5*{K}+min(item) WHEN count(DISTINCT o)=1 THEN 4*{K}+min(o) WHEN count(DISTINCT c)=1 THEN 3*{K}+min(c)
   WHEN count(DISTINCT na)=1 THEN 2*{K}+min(na) WHEN count(DISTINCT re)=1 THEN 1*{K}+min(re) ELSE -1 END AS parent FROM sh GROUP BY address UNION ALL
 SELECT DISTINCT 5*{K}+item, 4*{K}+o FROM live UNION ALL
 SELECT 4*{K}+o_orderkey, 3*{K}+o_custkey FROM orders JOIN customer ON o_custkey=c_custkey WHERE c_mktsegment<>'MACHINERY' UNION ALL
 SELECT 3*{K}+c_custkey, 2*{K}+c_nationkey FROM customer WHERE c_mktsegment<>'MACHINERY' UNION ALL
 SELECT 2*{K}+n_nationkey, 1*{K}+n_regionkey FROM nation),
dom AS (SELECT n.id, n.address, n.class_address, n.used_size, coalesce(p.id,-1) AS idom FROM n LEFT JOIN up ON up.address=n.address LEFT JOIN n p ON p.address=up.parent),
clo AS (SELECT id AS anc, id AS dsc FROM dom UNION ALL SELECT d.idom, clo.dsc FROM clo JOIN dom d ON d.id=clo.anc WHERE d.idom>=0),
ret AS (SELECT anc AS id, sum(d.used_size)::BIGINT AS retained FROM clo JOIN dom d ON d.id=clo.dsc GROUP BY 1),
tree AS (SELECT dom.*, ret.retained FROM dom JOIN ret USING (id))"""

#: What instances of a class and its class object keep.
KEPT = f"""{TREE},
mem AS (SELECT oid, cid, count(*) AS w FROM (SELECT n.id AS oid, c.id AS cid FROM n JOIN n c ON c.address=n.class_address UNION ALL SELECT n.id, n.id FROM n JOIN cls USING (address)) GROUP BY 1,2),
below AS (SELECT d.id AS oid, d.class_address AS dc, a.class_address AS ac FROM (SELECT anc, dsc FROM clo WHERE anc<>dsc) x JOIN n d ON d.id=x.dsc JOIN n a ON a.id=x.anc),
inner_ AS (SELECT DISTINCT b.oid, c.id AS cid FROM below b JOIN n c ON c.address=b.dc WHERE b.ac=b.dc),
kept AS (SELECT m.cid, sum(m.w*t.retained)::BIGINT AS retained FROM mem m JOIN tree t ON t.id=m.oid LEFT JOIN inner_ i ON i.oid=m.oid AND i.cid=m.cid WHERE i.oid IS NULL GROUP BY 1 HAVING sum(m.w*t.retained)>0)"""

HIST = "hist AS (SELECT n.class_address, c.name, c.loader_address, c.super_address, count(*) AS n_objects, sum(used_size)::BIGINT AS used_size FROM n JOIN cls c ON c.address=n.class_address GROUP BY 1,2,3,4)"


def sql(prelude: str, query: str) -> str:
    return f"WITH RECURSIVE {prelude} {query}"


ORACLE = {
    "object_identifiers": sql(BASE, "SELECT address, id AS object_id FROM ids"),
    "class_histogram": sql(f"{KEPT}, {HIST}", "SELECT name, loader_address, n_objects, hist.used_size, coalesce(retained,0)::BIGINT AS retained FROM hist JOIN n c ON c.address=hist.class_address LEFT JOIN kept ON cid=c.id"),
    "total_heap": sql(LIVE, "SELECT sum(used_size)::BIGINT AS used_size, count(*) AS n_objects FROM n"),
    "outbound_normalized": sql(LIVE, "SELECT src, seq, dst FROM e"),
    "inbound_ordered": sql(LIVE, "SELECT dst, row_number() OVER (PARTITION BY dst ORDER BY CASE WHEN seq=0 THEN 0 ELSE 1 END, src)-1 AS seq, src FROM e"),
    "degrees": sql(LIVE, "SELECT object_id, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT src AS object_id,1 AS o,0 AS i FROM e UNION ALL SELECT dst,0,1 FROM e) GROUP BY 1"),
    "dangling_filtered": sql(BASE, "SELECT count(*) AS n_refs, (SELECT count(*) FROM (SELECT s, d FROM held UNION SELECT s, d FROM dangling) x WHERE d NOT IN (SELECT address FROM obj)) AS n_dangling FROM (SELECT s, d FROM alle)"),
    "reachable_objects": sql(BASE, "SELECT id AS object_id FROM ids JOIN reach USING (address)"),
    "unreachable_histogram": sql(BASE, "SELECT c.address AS class_address, c.name, count(*) AS n_objects, sum(used_size)::BIGINT AS used_size FROM obj o JOIN cls c ON c.address=o.class_address WHERE o.address NOT IN (SELECT address FROM reach) GROUP BY 1,2"),
    "renumbered_objects": sql(LIVE, "SELECT n.id AS object_id, n.address, c.id AS class_id, n.used_size FROM n JOIN n c ON c.address=n.class_address"),
    "artificial_roots": sql(BASE, f"""SELECT address FROM (
        SELECT o.address FROM obj o LEFT JOIN (SELECT DISTINCT d FROM alle a WHERE a.s<>a.d AND a.s NOT IN (SELECT address FROM reach)) h ON h.d=o.address WHERE o.address NOT IN (SELECT address FROM reach) AND h.d IS NULL
        UNION ALL SELECT 10*{K}+min(s_suppkey) FROM supplier GROUP BY (s_suppkey+1)//2 HAVING count(*)=2)"""),
    "immediate_dominators": sql(TREE, "SELECT id AS object_id, idom FROM dom"),
    "retained_sizes": sql(TREE, "SELECT id AS object_id, retained FROM tree"),
    "dominated_children": sql(TREE, "SELECT idom, row_number() OVER (PARTITION BY idom ORDER BY retained DESC, id)-1 AS nr, id AS object_id, retained FROM tree"),
    "class_min_retained": sql(KEPT, "SELECT c.name, c.loader_address, k.retained FROM kept k JOIN n ON n.id=k.cid JOIN cls c ON c.address=n.address"),
    "retained_set": sql(TREE, f"SELECT dsc AS object_id FROM clo JOIN n ON n.id=clo.anc WHERE n.address=2*{K}+7"),
    "first_with_retained": sql(TREE, "SELECT min(id) AS object_id FROM tree WHERE retained=64"),
    "dominator_tree": sql(TREE, "SELECT id AS object_id, used_size, retained, round(retained*100.0/(SELECT sum(used_size) FROM n),4) AS percent FROM tree WHERE idom=-1"),
    "dominator_by_class": sql(TREE, "SELECT c.name, count(*) AS n_objects, sum(used_size)::BIGINT AS used_size, sum(retained)::BIGINT AS retained FROM tree JOIN cls c ON c.address=class_address WHERE idom=-1 GROUP BY 1"),
    "dominator_by_loader": sql(TREE, "SELECT c.loader_address, count(*) AS n_objects, sum(used_size)::BIGINT AS used_size, sum(retained)::BIGINT AS retained FROM tree JOIN cls c ON c.address=class_address WHERE idom=-1 GROUP BY 1"),
    "dominator_by_package": sql(TREE, "SELECT regexp_replace(c.name,'\\.?[^.]*$','') AS package, count(*) AS n_objects, sum(used_size)::BIGINT AS used_size, sum(retained)::BIGINT AS retained FROM tree JOIN cls c ON c.address=class_address WHERE idom=-1 GROUP BY 1"),
    "top_consumers": sql(TREE, "SELECT id AS object_id, retained FROM tree WHERE idom=-1 AND retained*100.0>=(SELECT sum(used_size) FROM n)*1.0"),
    "biggest_objects": sql(TREE, "SELECT id AS object_id, retained FROM (SELECT * FROM tree WHERE idom=-1 ORDER BY retained DESC, id LIMIT 3) UNION ALL SELECT NULL, ((SELECT sum(used_size) FROM n)-(SELECT sum(retained) FROM (SELECT retained FROM tree WHERE idom=-1 ORDER BY retained DESC, id LIMIT 3)))::BIGINT"),
    "big_drops": sql(TREE, "SELECT t.id AS object_id, t.retained, coalesce(b.m,0) AS biggest_child, t.retained-coalesce(b.m,0) AS dropped FROM tree t LEFT JOIN (SELECT idom, max(retained) AS m FROM tree GROUP BY 1) b ON b.idom=t.id WHERE t.retained-coalesce(b.m,0)>=2000"),
    "immediate_dominators_of_class": sql(TREE, "SELECT coalesce(c.name,'<ROOT>') AS dominator_class, count(*) AS n_dominators, sum(k)::BIGINT AS n_dominated, sum(coalesce(p.used_size,0))::BIGINT AS dominator_size, sum(z)::BIGINT AS dominated_size FROM (SELECT idom, count(*) AS k, sum(used_size) AS z FROM tree WHERE class_address=9*256 GROUP BY 1) g LEFT JOIN tree p ON p.id=g.idom LEFT JOIN cls c ON c.address=p.class_address GROUP BY 1"),
    "histogram_by_package": sql(f"{LIVE}, {HIST}", """SELECT array_to_string(parts[1:i],'.') AS package, i::INT AS depth, count(*) AS n_classes, sum(n_objects)::BIGINT AS n_objects, sum(used_size)::BIGINT AS used_size
        FROM (SELECT n_objects, used_size, parts, unnest(generate_series(1,len(parts))) AS i FROM (SELECT *, string_split(name,'.') AS parts FROM hist)) GROUP BY 1,2"""),
    "histogram_by_loader": sql(f"{LIVE}, {HIST}", "SELECT loader_address, count(*) AS n_classes, sum(n_objects)::BIGINT AS n_objects, sum(used_size)::BIGINT AS used_size FROM hist GROUP BY 1"),
    "histogram_by_superclass": sql(f"{LIVE}, {HIST}, sup AS (SELECT address, address AS anc FROM cls UNION ALL SELECT sup.address, c.super_address FROM sup JOIN cls c ON c.address=sup.anc WHERE c.super_address<>0)",
        "SELECT c.address AS ancestor, c.name, sum(n_objects)::BIGINT AS n_objects, sum(used_size)::BIGINT AS used_size FROM sup JOIN hist ON hist.class_address=sup.address JOIN cls c ON c.address=sup.anc GROUP BY 1,2"),
    "subclass_closure": sql(f"{BASE}, sup AS (SELECT address, address AS ancestor, 0 AS distance FROM cls UNION ALL SELECT sup.address, c.super_address, distance+1 FROM sup JOIN cls c ON c.address=sup.ancestor WHERE c.super_address<>0)", "SELECT * FROM sup"),
    "duplicate_classes": sql(BASE, "SELECT name, count(DISTINCT loader_address) AS n_loaders FROM cls GROUP BY 1 HAVING count(DISTINCT loader_address)>1"),
    "classloader_explorer": sql(f"{LIVE}, {HIST}", "SELECT c.loader_address, count(*) AS n_classes, (SELECT coalesce(sum(n_objects),0) FROM hist h WHERE h.loader_address=c.loader_address)::BIGINT AS n_objects FROM cls c GROUP BY 1"),
    "gc_roots_by_type": sql(LIVE, "SELECT root_type, c.name, count(*) AS n_objects, sum(used_size)::BIGINT AS used_size FROM rts JOIN n USING (address) JOIN cls c ON c.address=n.class_address GROUP BY 1,2"),
    "class_references": sql(LIVE, "SELECT a.name AS from_class, b.name AS to_class, count(*) AS n_refs FROM e JOIN n x ON x.id=src JOIN n y ON y.id=dst JOIN cls a ON a.address=x.class_address JOIN cls b ON b.address=y.class_address WHERE seq>0 GROUP BY 1,2"),
    "sampled_objects": sql(LIVE, "SELECT address, used_size FROM n WHERE (address>>3)%5=0"),
    "duplicate_records_first_wins": "SELECT l_orderkey*8+l_linenumber AS address, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey,l_linenumber ORDER BY l_partkey*100000+l_suppkey, l_quantity) AS r FROM lineitem) WHERE r=1",
    "thread_root_asof": "SELECT a.event_id AS address, coalesce(b.thread,0) AS thread_address FROM (SELECT * FROM events WHERE event_type<>'signup' AND event_id%2=0) a ASOF LEFT JOIN (SELECT user_id AS u, event_id AS pos, event_id+1000000 AS thread FROM events WHERE event_id%2=1) b ON a.user_id=b.u AND a.event_id>b.pos",
    "frame_strings_asof": "SELECT a.event_id AS pos, b.event_type AS value FROM (SELECT user_id, event_id FROM events WHERE event_id%3=0) a ASOF LEFT JOIN (SELECT user_id AS u, event_id AS p, event_type FROM events WHERE event_id%3<>0) b ON a.user_id=b.u AND a.event_id>b.p",
    "alignment_gcd": "WITH a AS (SELECT DISTINCT o_orderkey*24+4096 AS x FROM orders), g AS (SELECT list(x-(SELECT min(x) FROM a)) AS l FROM a) SELECT greatest(8,least(256,list_reduce(l, lambda p, q: gcd(p,q))))::BIGINT AS step FROM g",
    "compressed_refs": "SELECT coalesce(bool_or(address>b AND address<b+16+8*n),false) AS compressed FROM (SELECT address, lag(address) OVER (ORDER BY pos) AS b, lag(length) OVER (ORDER BY pos) AS n FROM (SELECT o_orderkey*1000 AS pos, o_orderkey*64 AS address, o_custkey%5 AS length FROM orders))",
    "group_strings": "SELECT text, count(*) AS n_objects, sum(24+2*length(text))::BIGINT AS used_size FROM documents GROUP BY 1 HAVING count(*)>1",
    "find_strings": "SELECT doc_id AS object_id, length(text) AS n_chars FROM documents WHERE regexp_full_match(text, '(?s).*[0-9]{16}.*')",
    "arrays_by_size": "SELECT len(embedding)::BIGINT AS length, count(*) AS n_objects, sum(16+4*len(embedding))::BIGINT AS used_size FROM embeddings GROUP BY 1",
    "collections_by_size": "SELECT size, count(*) AS n_objects FROM (SELECT conv_id, count(*) AS size FROM conversations GROUP BY 1) GROUP BY 1",
    "path_to_gc_roots": sql(f"{LIVE}, bfs AS (SELECT DISTINCT id, 0 AS distance FROM n JOIN rts USING (address) UNION SELECT e.dst, bfs.distance+1 FROM bfs JOIN e ON e.src=bfs.id WHERE bfs.distance<8)", "SELECT id AS object_id, min(distance)::INT AS distance FROM bfs GROUP BY 1"),
    "merge_shortest_paths": sql(f"{LIVE}, bfs AS (SELECT DISTINCT id, 0 AS distance FROM n JOIN rts USING (address) UNION SELECT e.dst, bfs.distance+1 FROM bfs JOIN e ON e.src=bfs.id WHERE bfs.distance<8), d AS (SELECT id, min(distance) AS distance FROM bfs GROUP BY 1)", "SELECT d.distance::INT AS distance, c.name, count(*) AS n_objects FROM d JOIN n USING (id) JOIN cls c ON c.address=n.class_address GROUP BY 1,2"),
    "leak_suspects": sql(TREE, "SELECT id AS object_id, retained FROM tree WHERE idom=-1 AND retained*100.0>=(SELECT sum(used_size) FROM n)*10.0"),
    "show_retained_set": sql(f"{LIVE}, w AS (SELECT DISTINCT address FROM rts WHERE address NOT IN (SELECT address FROM n WHERE class_address=6*256) UNION SELECT a.d FROM w JOIN alle a ON a.s=w.address JOIN n t ON t.address=a.d WHERE t.class_address<>6*256)", "SELECT c.name, count(*) AS n_objects, sum(used_size)::BIGINT AS used_size FROM n JOIN cls c ON c.address=n.class_address WHERE n.address NOT IN (SELECT address FROM w) GROUP BY 1"),
}

ORACLE |= {
    "oql_select_instances": sql(LIVE, "SELECT id AS object_id, used_size FROM n WHERE class_address=5*256"),
    "oql_instanceof_where": sql(TREE, "SELECT address, retained FROM tree WHERE class_address IN (8*256,9*256,10*256,15*256,13*256) AND retained>=24 AND used_size<>16"),
    "oql_aggregates": sql(TREE, "SELECT count(*) AS n, max(retained) AS biggest, min(retained) AS smallest, sum(used_size)::BIGINT AS used FROM tree JOIN cls c ON c.address=class_address WHERE regexp_full_match(c.name,'db\\.(sales|geo)\\..*')"),
    "oql_classof": sql(LIVE, "SELECT DISTINCT c.name, used_size FROM n JOIN cls c ON c.address=class_address WHERE regexp_full_match(c.name,'db\\..*') AND c.name LIKE '%S%'"),
    "oql_reference_lists": sql(TREE, f"SELECT t.id AS object_id, (SELECT count(*) FROM e WHERE src=t.id) AS n_out, (SELECT count(*) FROM e WHERE dst=t.id) AS n_in, (SELECT count(*) FROM tree k WHERE k.idom=t.id) AS n_dominated, t.idom AS dominator FROM tree t WHERE class_address=4*256"),
    "oql_class_objects": sql(LIVE, "SELECT name, loader_address FROM cls WHERE regexp_full_match(name,'db\\..*')"),
    "oql_gc_roots": sql(LIVE, "SELECT address, (SELECT count(*) FROM rts WHERE rts.address=n.address) AS n_roots FROM n WHERE class_address=3*256"),
    "oql_union": sql(LIVE, f"SELECT address FROM n WHERE class_address=3*256 OR (class_address=4*256 AND address>2199023255562)"),
}

ORACLE |= {
    "oql_field_path": sql(LIVE, f"SELECT n.id AS object_id, min(day) AS day FROM n JOIN ln ON n.address=5*{K}+item GROUP BY 1 HAVING min(day)<9600"),
    "oql_field_like": sql(LIVE, f"SELECT c_name AS name, c_acctbal AS balance FROM customer JOIN n ON n.address=3*{K}+c_custkey WHERE regexp_full_match(c_name,'.*[05]') AND c_acctbal>=100"),
    "collection_fill_ratio": "SELECT ceil(k/7.0*5)/5 AS ratio, count(*) AS n_objects FROM (SELECT l_orderkey, count(DISTINCT l_linenumber)::DOUBLE AS k FROM lineitem GROUP BY 1) GROUP BY 1",
    "constant_value_arrays": "SELECT l_orderkey AS address, min(l_linestatus) AS value, count(*)::INT AS length FROM lineitem GROUP BY 1 HAVING min(l_linestatus)=max(l_linestatus)",
    "map_collision_ratio": "SELECT c_nationkey, count(*) AS n_entries, count(DISTINCT c_custkey%64) AS n_slots, round((count(*)-count(DISTINCT c_custkey%64))/count(*)::DOUBLE,6) AS ratio FROM customer GROUP BY 1",
    "waste_in_arrays": "SELECT l_orderkey AS array_id, 90 AS length, (max(d)+1-min(d))::INT AS used FROM (SELECT l_orderkey, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS d FROM lineitem) GROUP BY 1 HAVING max(d)+1-min(d)<90",
    "weak_reference_statistics": sql(LIVE, "SELECT 'db.shared.ShipDay' AS name, count(*) AS n_objects, count(*) AS n_only FROM n WHERE class_address=9*256"),
    "shortest_paths": sql(LIVE, f"""SELECT m.id AS object_id, r.id || '>' || p.id || '>' || m.id AS path FROM
        (SELECT c_nationkey, min(n.id) AS id FROM customer JOIN n ON n.address=3*{K}+c_custkey GROUP BY 1) m JOIN nation ON n_nationkey=c_nationkey JOIN n p ON p.address=2*{K}+n_nationkey JOIN n r ON r.address=1*{K}+n_regionkey"""),
    "component_report": sql(TREE, """SELECT c.name, count(*) AS n_objects, sum(t.used_size)::BIGINT AS used_size, sum(CASE WHEN t.idom IN (SELECT id FROM n JOIN cls k ON k.address=n.class_address WHERE starts_with(k.name,'db.shared.')) THEN 0 ELSE t.retained END)::BIGINT AS retained
        FROM tree t JOIN cls c ON c.address=t.class_address WHERE starts_with(c.name,'db.shared.') GROUP BY 1"""),
    "list_objects": sql(TREE, "SELECT id AS object_id, t.address, 'db.geo.Nation' AS name, used_size, retained FROM tree t WHERE class_address=4*256"),
    "list_objects_tree": sql(TREE, """SELECT path, level, nr, c.name, t.retained FROM (
        SELECT id, id::VARCHAR AS path, 0 AS level, 0 AS nr FROM n WHERE class_address=4*256 UNION ALL
        SELECT a.dst, a.src || '>' || a.dst, 1, a.seq FROM e a JOIN n ON n.id=a.src WHERE class_address=4*256 UNION ALL
        SELECT b.dst, a.src || '>' || a.dst || '>' || b.dst, 2, b.seq FROM e a JOIN n ON n.id=a.src JOIN e b ON b.src=a.dst WHERE class_address=4*256) x
        JOIN tree t USING (id) JOIN cls c ON c.address=t.class_address"""),
    "compare_dumps": sql(BASE, "SELECT 'b' AS side, count(*) AS n, sum(used_size)::BIGINT AS used_size FROM obj WHERE address NOT IN (SELECT address FROM reach)"),
    "snapshot_counts": sql(LIVE, """SELECT 'objects' AS name, count(*) AS n FROM n UNION ALL SELECT 'classes', count(*) FROM cls JOIN n USING (address) UNION ALL SELECT 'roots', count(DISTINCT address) FROM rts
        UNION ALL SELECT 'references', (SELECT count(*) FROM n) + (SELECT count(*) FROM held h JOIN n s ON s.address=h.s JOIN n t ON t.address=h.d)"""),
}

ORACLE |= dump_queries.oracle_sql()
