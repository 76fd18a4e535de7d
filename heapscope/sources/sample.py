"""A heap dump written from the relational test tables, for the queries that read dumps.

Regions are threads with a constant of an enumeration, a string builder, a big integer and a map of their nations as local variable; nations hold lists of their customers, customers their nation. Customers of one segment are in
no list; every third customer is weakly referred to. Parts are a list linked one way, suppliers one linked both ways, with finalizers that are linked
both ways too and by fives in a queue. The application's classes hang on a loader that holds them in turn. Some records are odd on purpose: second records of
an address, references to nothing, instance data that end early, an array class that the dump does not define.

Tables that grow are written by executors, a file a task, and the driver joins the files in order; it sees no row of them. The writer makes fixtures and is no
part of reading dumps.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import ship
from .hprof import opened

KIND, KEY = 1 << 40, 1 << 16
GARBAGE_SEGMENT = "MACHINERY"
SEGMENT_BYTES = 1 << 20
L, Z, C, FL, D, B, S, INT, J = 2, 4, 5, 6, 7, 8, 9, 10, 11
#: number -> name as recorded, number of the superclass, whether the application's loader loaded it, fields, static references. A class object's address is
#: 65536 + 8 * number.
CLASSES: dict[int, tuple[str, int, bool, list[tuple[str, int]], list[tuple[str, int]]]] = {
    1: ("java/lang/Object", 0, False, [], []),
    2: ("java/lang/Class", 1, False, [], []),
    3: ("java/lang/ClassLoader", 1, False, [("classes", L)], []),
    4: ("java/lang/String", 1, False, [("value", L), ("coder", B), ("hash", INT)], []),
    5: ("java/lang/Thread", 1, False, [("name", L), ("data", L), ("level", L), ("buffer", L), ("big", L), ("priority", INT)], []),
    6: ("java/lang/ref/Reference", 1, False, [("referent", L), ("next", L)], []),
    7: ("java/lang/ref/WeakReference", 6, False, [], []),
    8: ("java/lang/ref/Finalizer", 6, False, [("next", L), ("prev", L)], [("unfinalized", 24 * KIND)]),
    9: ("java/util/HashMap", 1, False, [("table", L), ("size", INT)], []),
    10: ("java/util/HashMap$Node", 1, False, [("hash", INT), ("key", L), ("value", L), ("next", L)], []),
    11: ("java/util/ArrayList", 1, False, [("elementData", L), ("size", INT)], []),
    12: ("java/util/Hashtable", 1, False, [("table", L), ("count", INT)], []),
    13: ("java/util/Hashtable$Entry", 1, False, [("hash", INT), ("key", L), ("value", L), ("next", L)], []),
    14: ("java/util/Properties", 12, False, [], []),
    15: ("java/lang/System", 1, False, [], [("props", 25 * KIND + KEY)]),
    16: ("[C", 1, False, [], []),
    17: ("[B", 1, False, [], []),
    18: ("[I", 1, False, [], []),
    19: ("[Ljava/lang/Object;", 1, False, [], []),
    20: ("[Ljava/util/HashMap$Node;", 1, False, [], []),
    21: ("[Ljava/util/Hashtable$Entry;", 1, False, [], []),
    22: ("shop/Row", 1, True, [("link", L)], []),
    23: ("shop/Customer", 22, True, [("name", L), ("nation", L), ("key", J), ("balance", D), ("ratio", FL), ("rank", S), ("grade", B), ("initial", C), ("active", Z), ("orders", INT)], []),
    24: ("shop/Nation", 22, True, [("name", L), ("customers", L)], []),
    25: ("shop/Part", 22, True, [("key", J)], []),
    26: ("shop/Supplier", 22, True, [("prev", L), ("data", L)], []),
    27: ("shop/Level", 28, True, [], []),
    28: ("java/lang/Enum", 1, False, [("name", L), ("ordinal", INT)], []),
    29: ("java/lang/AbstractStringBuilder", 1, False, [("value", L), ("coder", B), ("count", INT)], []),
    30: ("java/lang/StringBuilder", 29, False, [], []),
    31: ("java/math/BigInteger", 1, False, [("signum", INT), ("mag", L)], []),
}


def at(kind: int, key: int) -> int:
    return kind * KIND + key * KEY


def class_at(number: int) -> int:
    return 65536 + 8 * number


def ids(*values: int) -> bytes:
    return struct.pack(f">{len(values)}Q", *values)


def instance(address: int, of: int, data: bytes) -> bytes:
    return b"\x21" + ids(address) + struct.pack(">I", 0) + ids(class_at(of)) + struct.pack(">i", len(data)) + data


def object_array(address: int, of: int, values: list[int]) -> bytes:
    return b"\x22" + ids(address) + struct.pack(">Ii", 0, len(values)) + ids(class_at(of)) + ids(*values)


def primitive_array(address: int, kind: int, code: str, values) -> bytes:
    return b"\x23" + ids(address) + struct.pack(">Ii", 0, len(values)) + bytes([kind]) + struct.pack(f">{len(values)}{code}", *values)


def text(string: int, array: int, value: str) -> bytes:
    """A string of Latin-1 bytes."""
    return instance(string, 4, ids(array) + struct.pack(">bi", 0, 0)) + primitive_array(array, B, "B", value.encode("latin-1"))


def rows_of(df: DataFrame, *columns: str) -> Iterator[tuple]:
    return (tuple(r) for r in df.select(*columns).orderBy(columns[0]).toLocalIterator())


def fixed_records(spark: SparkSession, sf_dir: str) -> Iterator[bytes]:
    """Sub-records of the heap that do not grow with the tables, one or a few at a time."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    names = Names()
    for n, (_, up, app, fields, statics) in CLASSES.items():
        body = ids(class_at(n)) + struct.pack(">I", 0) + ids(class_at(up) if up else 0, at(1, 1) if app else 0, 0, 0, 0, 0) + struct.pack(">iH", 0, 0)
        body += struct.pack(">H", len(statics)) + b"".join(ids(names.of(name)) + bytes([L]) + ids(target) for name, target in statics)
        yield b"\x20" + body + struct.pack(">H", len(fields)) + b"".join(ids(names.of(name)) + bytes([kind]) for name, kind in fields)
        if not app:
            yield b"\x05" + ids(class_at(n))
    yield b"\x01" + ids(at(14, 1), 0) + b"\x01" + ids(at(12, 0), 0) + b"\x07" + ids(at(15, 0))
    yield instance(at(1, 1), 3, ids(at(2, 1))) + object_array(at(2, 1), 19, [class_at(n) for n, c in CLASSES.items() if c[2]])

    regions = list(rows_of(table("region"), "r_regionkey", "r_name"))
    nations = list(rows_of(table("nation"), "n_nationkey", "n_name", "n_regionkey"))
    yield instance(at(25, 1), 14, ids(at(26, 1)) + struct.pack(">i", len(regions)))
    yield object_array(at(26, 1), 21, [at(27, r) for r, _ in regions])
    for r, name in regions:
        yield b"\x08" + ids(at(16, r)) + struct.pack(">II", r + 1, r + 1) + b"\x03" + ids(at(21, r)) + struct.pack(">Ii", r + 1, 0)
        yield instance(at(33, r), 27, ids(at(19, r)) + struct.pack(">i", r))
        built = f"built {r}".encode()
        yield instance(at(34, r), 30, ids(at(35, r)) + struct.pack(">bi", 0, len(built))) + primitive_array(at(35, r), B, "B", built.ljust(16, b"\0"))
        yield instance(at(36, r), 31, struct.pack(">i", -1) + ids(at(37, r))) + primitive_array(at(37, r), INT, "i", [r + 1, 5])
        yield instance(at(16, r), 5, ids(at(19, r), at(32, r), at(33, r), at(34, r), at(36, r)) + struct.pack(">i", r + 1)) + text(at(19, r), at(20, r), f"worker-{r}") + primitive_array(at(32, r), J, "q", [2**60 + r, -r, 2**53 + 1])
        own = [n for n, _, of in nations if of == r]
        yield instance(at(21, r), 9, ids(at(22, r)) + struct.pack(">i", len(own)))
        yield object_array(at(22, r), 20, [next((at(23, n) for n in own if n % 8 == slot), 0) for slot in range(8)])
        for n in own:
            yield instance(at(23, n), 10, struct.pack(">i", n) + ids(at(5, n), at(8, n), next((at(23, m) for m in own if m > n and m % 8 == n % 8), 0)))
        yield instance(at(27, r), 13, struct.pack(">i", r) + ids(at(28, r), at(30, r), 0)) + text(at(28, r), at(29, r), name.lower()) + text(at(30, r), at(31, r), f"region {r}")
    for n, name, _ in nations:
        yield instance(at(5, n), 4, ids(at(6, n)) + struct.pack(">bi", 0, 0)) + primitive_array(at(6, n), C, "H", [ord(c) for c in name])
        yield instance(at(8, n), 24, ids(at(5, n), at(9, n), 0))


def growing_records(spark: SparkSession, sf_dir: str) -> Iterator[tuple[DataFrame, Callable[..., bytes]]]:
    """Rows and what makes sub-records of one, in the order of the file."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    customers = table("customer")
    listed = F.coalesce(F.col("c_mktsegment") != GARBAGE_SEGMENT, F.lit(True))
    members = customers.where(listed).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list("c_custkey")).alias("own"))
    weak = customers.where("c_custkey % 3 = 0").agg(F.lit(0).alias("nr"), F.sort_array(F.collect_list("c_custkey")).alias("keys"))
    n_parts, n_suppliers = table("part").count(), table("supplier").count()  # keys count from 0
    yield customers.select("c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").cast("double")), customer_records
    yield weak, lambda _, keys: object_array(at(14, 1), 19, [at(13, c) for c in keys])
    yield table("nation").select("n_nationkey").join(members, "n_nationkey", "left").select("n_nationkey", "own"), list_records
    yield table("part").select("p_partkey"), lambda p: instance(at(12, p), 25, struct.pack(">q", p) + ids(at(12, p + 1) if p + 1 < n_parts else 0))
    yield table("supplier").select("s_suppkey"), lambda s: supplier_records(s, n_suppliers)


def customer_records(c: int, name: str, nation: int, balance: float) -> bytes:
    values = struct.pack(">qdfhbHBi", c, balance, c % 8 / 4, c % 1000 - 500, c % 128, 65 + c % 26, c % 2, c % 50)
    link = ids(at(99, c) if c % 7 == 0 else 0)
    out = instance(at(7, c), 23, ids(at(3, c), at(8, nation)) + values + link) + text(at(3, c), at(4, c), name)
    if c % 10 == 0:
        out += instance(at(7, c), 23, ids(0, 0) + values + link)
    if c % 3 == 0:
        out += instance(at(13, c), 7, ids(at(7, c)) + (b"" if c % 9 == 0 else ids(0)))
    return out


def list_records(n: int, own: list[int] | None) -> bytes:
    own = own or []
    head = instance(at(9, n), 11, ids(at(10, n)) + (b"" if n % 5 == 4 else struct.pack(">i", len(own))))
    return head + object_array(at(10, n), 19, [at(7, c) for c in own] + [0] * (n % 3))


def supplier_records(s: int, count: int) -> bytes:
    after, before = s + 1 < count, s > 0
    out = instance(at(15, s), 26, ids(at(15, s - 1) if before else 0, at(18, s), at(15, s + 1) if after else 0))
    out += primitive_array(at(18, s), INT, "i", [s % 7] * 4 if s % 2 == 0 else [s, s + 1, s + 2, 9])
    queued = 0 if s % 5 else at(24, s + 5) if s + 5 < count else at(24, s)
    return out + instance(at(24, s), 8, ids(at(24, s + 1) if after else 0, at(24, s - 1) if before else 0, at(15, s), queued))


def record(tag: int, body: bytes) -> bytes:
    return struct.pack(">BII", tag, 0, len(body)) + body


def segments_of(parts: Iterable[bytes]) -> Iterator[bytes]:
    """Heap sub-records as records of a segment each."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= SEGMENT_BYTES:
            yield record(0x1C, b"".join(held))
            held, size = [], 0
    if held:
        yield record(0x1C, b"".join(held))


def written(rows: DataFrame, encode: Callable[..., bytes], path: str) -> list[str]:
    """Files with the segments of the rows in order of their first column, each written by one task. Only files of tasks that came to their end are named."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        name = f"{path}.{uuid.uuid4().hex}"
        with opened(name, "wb") as f:
            for segment in segments_of(encode(*row) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                f.write(segment)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name])], names=["part", "name"])

    ship(rows.sparkSession)
    return [r["name"] for r in sorted(rows.orderBy(rows.columns[0]).mapInArrow(run, "part int, name string").collect(), key=lambda r: r["part"])]


class Names:
    """Strings of the dump, numbered from 1."""

    FRAMES = ("run", "()V", "Worker.java", "main", "([Ljava/lang/String;)V")

    def __init__(self):
        words = [n for n, *_ in CLASSES.values()] + [f for c in CLASSES.values() for f, _ in [*c[3], *c[4]]] + list(self.FRAMES)
        self.ids = {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}

    def of(self, word: str) -> int:
        return self.ids[word]


def write(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Writes the dump of a folder's tables."""
    names = Names()
    files = [name for rows, encode in growing_records(spark, sf_dir) for name in written(rows, encode, path)]
    with opened(path, "wb") as f:
        f.write(b"JAVA PROFILE 1.0.2\0" + struct.pack(">IQ", 8, 1_600_000_000_000))
        for word, i in names.ids.items():
            f.write(record(1, ids(i) + word.encode()))
        for n, (name, *_) in CLASSES.items():
            f.write(record(2, struct.pack(">I", n) + ids(class_at(n)) + struct.pack(">I", 0) + ids(names.of(name))))
        for r in range(5):
            f.write(record(4, ids(r + 1, names.of("run"), names.of("()V"), names.of("Worker.java")) + struct.pack(">Ii", 22, (-3, -2, -1, 0, 42)[r])))
        f.write(record(4, ids(100, names.of("main"), names.of("([Ljava/lang/String;)V"), 0) + struct.pack(">Ii", 24, 7)))
        for r in range(5):
            f.write(record(5, struct.pack(">III", r + 1, r + 1, 2) + ids(r + 1, 100)))
        for segment in segments_of(fixed_records(spark, sf_dir)):
            f.write(segment)
        for name in files:
            with opened(name) as part:
                while piece := part.read(SEGMENT_BYTES):
                    f.write(piece)
        f.write(record(0x2C, b""))
    for name in files:
        where = spark._jvm.org.apache.hadoop.fs.Path(name)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)
    return path
