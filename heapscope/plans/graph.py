"""From raw records to a numbered, pruned heap graph with its dominator tree. Every table is made when first asked
for and kept as a staged table, so all queries on a graph share the work."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import rows_from, ship, sized
from ..operators import aggregates, dominators, edges, ids, reach
from ..schemas import RawHeap

JAVA_CLASS = "java.lang.Class"


def found(ids: DataFrame, addresses: DataFrame) -> DataFrame:
    """Those rows of ids that have one of some addresses, which are few beside the heap (classes, roots)."""
    return sized(ids.join(sized(addresses.distinct(), "addresses"), "address", "left_semi"), "found")


class Graph:
    def __init__(self, raw: RawHeap, keep_unreachable: bool = False):
        self.raw, self.keep_unreachable = raw, keep_unreachable
        ship(raw.objects.sparkSession)

    # as recorded, by address

    @cached_property
    def refs(self) -> DataFrame:
        return sized(self.raw.refs.select("src_address", "seq", "dst_address"), "refs")

    @cached_property
    def _used_classes(self) -> DataFrame:
        """The addresses that objects name as their class, the superclasses, loaders and classes: few beside the heap."""
        named = self.raw.classes.select(F.explode(F.array("address", "super_address", "loader_address")).alias("address"))
        return sized(self.raw.objects.select(F.col("class_address").alias("address")).unionAll(named).distinct(), "used-classes")

    @cached_property
    def _known_classes(self) -> DataFrame:
        """Those of them at which an object is."""
        return found(self.raw.objects.select("address"), self._used_classes)

    @cached_property
    def _raw_roots(self) -> DataFrame:
        return sized(self.raw.roots, "roots")

    @cached_property
    def reached(self) -> DataFrame:
        """object_id: the addresses of what the roots reach, and of absent objects to which that refers."""
        here = self.raw.objects.select("address")
        starts = found(here, self._raw_roots.where("thread_address = 0").select("address")).select(F.col("address").alias("object_id"))
        refs = rows_from(self.refs, self.refs.select(F.col("src_address").alias("src"), F.col("dst_address").alias("dst")))
        return sized(reach.reached(refs, starts, among=here.withColumnRenamed("address", "object_id")), "reached")

    def _with_classes(self, records: DataFrame) -> DataFrame:
        """object_id, address, class_id, used_size, is_array of numbered records. An object of an unknown class is one of java.lang.Class. Classes are looked
        up once, so that the objects of a common class are not dealt by it."""
        here = found(records.select("address", "object_id"), self._used_classes)
        fallback = self.raw.classes.where(F.col("name") == JAVA_CLASS).agg(F.min("address")).first()[0]
        unknown = here.where(F.col("address") == F.lit(fallback)).agg(F.min("object_id")).first()[0]
        known = self._known_classes.distinct().join(here, "address", "left").select(F.col("address").alias("class_address"), F.col("object_id").alias("class_id"), F.lit(True).alias("known"))
        with_class = records.join(F.broadcast(known), "class_address", "left")
        return with_class.select("object_id", "address", F.when(F.col("known"), F.col("class_id")).otherwise(F.lit(unknown)).cast("bigint").alias("class_id"), "used_size", "is_array")

    # before pruning

    @cached_property
    def records(self) -> DataFrame:
        return ids.ranked_records(self.raw.objects, self.raw.n_records)

    @cached_property
    def all_ids(self) -> DataFrame:
        return self.records.select("address", "object_id")

    @cached_property
    def all_objects(self) -> DataFrame:
        return sized(self._with_classes(self.records), "all-objects")

    @cached_property
    def all_classes(self) -> DataFrame:
        """The class table with ids; a superclass at address 0 resolves to id 0."""
        here = found(self.all_ids, self._used_classes)
        up = here.select(F.col("address").alias("super_address"), F.col("object_id").alias("super_id"))
        loader = here.select(F.col("address").alias("loader_address"), F.col("object_id").alias("loader_id"))
        return sized(self.raw.classes.join(here, "address").join(up, "super_address", "left").join(loader, "loader_address", "left"), "all-classes")

    @cached_property
    def all_edges(self) -> DataFrame:
        return sized(edges.resolved(self.refs, self.all_ids, found(self.all_ids, self._used_classes)).select("src", "seq", "dst"), "all-edges")

    @cached_property
    def all_roots(self) -> DataFrame:
        roots = self._raw_roots
        here = found(self.all_ids, roots.select(F.explode(F.array("address", "thread_address")).alias("address")))
        known = roots.join(here, "address", "left")
        thread = here.select(F.col("address").alias("thread_address"), F.col("object_id").alias("thread_id"))
        return known.join(thread, "thread_address", "left").select("address", F.coalesce("object_id", F.lit(-1)).alias("object_id"), "root_type", "thread_address", F.when(F.col("thread_address") == 0, -1).otherwise(F.coalesce("thread_id", F.lit(-1))).cast("bigint").alias("thread_id"), "root_seq")

    @cached_property
    def reachable(self) -> DataFrame:
        return sized(self.all_ids.join(self.reached.select(F.col("object_id").alias("address")), "address", "left_semi").select("object_id"), "reachable")

    @cached_property
    def unreachable_histogram(self) -> DataFrame:
        return reach.unreachable_histogram(self.all_objects, self.reachable, self.all_classes)

    # after pruning

    @cached_property
    def objects(self) -> DataFrame:
        if self.keep_unreachable:
            return self.all_objects
        return sized(self._with_classes(ids.ranked_records(self.raw.objects, self.raw.n_records, self.reached)), "objects")

    @property
    def _ids(self) -> DataFrame:
        return self.objects.select("address", "object_id")

    @cached_property
    def _resolved(self) -> DataFrame:
        return edges.resolved(self.refs, self._ids, found(self._ids, self._used_classes))

    @cached_property
    def n_references(self) -> int:
        """References before normalizing."""
        return self._resolved.count()

    @cached_property
    def edges(self) -> DataFrame:
        return sized(edges.normalized(self._resolved, "src_address"), "edges")

    @cached_property
    def read_edges(self) -> DataFrame:
        return edges.with_class_first(self.edges, self.objects)

    @cached_property
    def classes(self) -> DataFrame:
        """Classes that are left, with ids; links to what is gone are null."""
        here = found(self.objects.select("object_id", "address"), self.raw.classes.select(F.explode(F.array("address", "super_address")).alias("address")))
        up = here.select(F.col("address").alias("super_address"), F.col("object_id").alias("super_id"))
        return sized(self.raw.classes.join(here, "address").join(up, "super_address", "left"), "classes")

    @cached_property
    def roots(self) -> DataFrame:
        here = found(self._ids, self._raw_roots.select("address"))
        real = sized(self._raw_roots.join(here, "address").select("object_id", "address", "root_type", "thread_address", "root_seq"), "live-roots")
        if not self.keep_unreachable:
            return real
        made = reach.artificial_roots(self.objects, self.edges, self.reachable)
        made = made.join(self.objects.select("object_id", "address"), "object_id")
        last = self.raw.roots.agg(F.coalesce(F.max("root_seq"), F.lit(-1)).alias("last")).first()["last"]
        return real.unionByName(made.select("object_id", "address", F.lit(0x1000).alias("root_type"), F.lit(0).cast("bigint").alias("thread_address"), (F.lit(last + 1) + F.col("stage") * F.lit(1 << 40) + F.col("nr")).alias("root_seq")))

    @cached_property
    def dominators(self) -> DataFrame:
        return sized(dominators.dominator_table(self.objects, self.edges, reach.usable_roots(self.roots)), "dominators")

    @cached_property
    def total(self) -> int:
        return aggregates.total_heap(self.objects).first()["used_size"]

    @cached_property
    def class_retained(self) -> DataFrame:
        return sized(dominators.class_min_retained(self.objects, self.dominators, self.classes), "class-retained")

    @cached_property
    def histogram(self) -> DataFrame:
        return aggregates.histogram(self.objects, self.classes, self.class_retained)
