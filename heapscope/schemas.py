"""The heap tables. Addresses and ids are 64-bit; a reference list is a table of edges, never an array of unbounded length."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

#: One row an object as recorded: instances, arrays and class objects. `pos` orders records of one address.
RAW_OBJECTS = "address bigint, class_address bigint, used_size bigint, pos bigint, is_array boolean"
#: One row a reference as recorded, the class first (seq 0).
RAW_REFS = "src_address bigint, seq bigint, dst_address bigint"
CLASSES = "address bigint, name string, super_address bigint, loader_address bigint"
#: thread_address is 0 unless the root is a local of a thread.
RAW_ROOTS = "address bigint, root_type int, thread_address bigint, root_seq bigint"

OBJECTS = "object_id bigint, address bigint, class_id bigint, used_size bigint, is_array boolean"
EDGES = "src bigint, seq bigint, dst bigint"


@dataclass
class RawHeap:
    """What a provider reads: records by address."""

    objects: DataFrame
    refs: DataFrame
    classes: DataFrame
    roots: DataFrame
    n_records: int | None = None  # about how many objects, if known


@dataclass
class Heap:
    """Objects numbered by address rank; edges in reading order; roots by object id."""

    objects: DataFrame
    edges: DataFrame
    classes: DataFrame
    roots: DataFrame
