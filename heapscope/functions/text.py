"""Names, sizes, stack frames and escapes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Element types of array descriptors (fixed values of the class file format).
PRIMITIVES = {"Z": "boolean", "C": "char", "F": "float", "D": "double", "B": "byte", "S": "short", "I": "int", "J": "long"}
#: HPROF tags of root sub-records and their kinds (fixed values).
ROOT_KINDS = {
    0x01: "NATIVE_STATIC", 0x02: "NATIVE_LOCAL", 0x03: "JAVA_LOCAL", 0x04: "NATIVE_STACK", 0x05: "SYSTEM_CLASS",
    0x06: "THREAD_BLOCK", 0x07: "BUSY_MONITOR", 0x08: "THREAD_OBJ", 0x1000: "UNREACHABLE",
}


def class_name(name: Column) -> Column:
    """The display name of a class name as recorded: array descriptors become element[] and slashes dots, those
    after an opening parenthesis excepted. Null is UnknownClass."""
    head, tail = F.substring_index(name, "(", 1), F.regexp_extract(name, r"(?s)(\(.*)$", 1)
    dotted = F.concat(F.replace(head, F.lit("/"), F.lit(".")), tail)
    brackets = F.regexp_extract(dotted, r"^(\[+)(?:L.*;|[ZCFDBSIJ])$", 1)
    depth = F.length(brackets)
    element = F.when(F.substring(dotted, depth + 1, F.lit(1)) == "L", F.substring(dotted, depth + 2, F.length(dotted) - depth - 2))
    kinds = F.create_map(*[F.lit(x) for pair in PRIMITIVES.items() for x in pair])
    element = element.otherwise(kinds[F.substring(dotted, depth + 1, F.lit(1))])
    return F.when(name.isNull(), "UnknownClass").when(depth > 0, F.concat(element, F.repeat(F.lit("[]"), depth))).otherwise(dotted)


def root_kind(tag: Column) -> Column:
    kinds = F.create_map(*[x for k, v in ROOT_KINDS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(kinds[tag.cast("int")], F.lit("UNKNOWN"))


def align(value: Column, step: Column | int) -> Column:
    step = F.lit(step).cast("bigint") if isinstance(step, int) else step
    return value + F.pmod(-value, step)


def hex_address(address: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(address)))


def string_constant(string_id: Column, value: Column) -> Column:
    """A string record's text: id 0 is the empty string, an unknown id says so."""
    return F.when(string_id == 0, "").otherwise(F.coalesce(value, F.concat(F.lit("Unresolved Name "), hex_address(string_id))))


def frame_line(class_name_: Column, method: Column, signature: Column, file: Column, line: Column) -> Column:
    """`  at C.m+sig (place)`; the line number also tells compiled (-2) and native (-3) methods."""
    named = F.coalesce(file, F.lit(""))
    place = F.when(line > 0, F.concat(F.coalesce(file, F.lit("null")), F.lit(":"), line.cast("string"))).when(line.isin(0, -1), F.coalesce(file, F.lit("Unknown Source")))
    place = place.when(line == -2, F.concat(named, F.lit("(Compiled Code)"))).when(line == -3, F.concat(named, F.lit("(Native Method)"))).otherwise("")
    return F.concat(F.lit("  at "), class_name_, F.lit("."), method, signature, F.lit(" ("), place, F.lit(")"))


def loader_label(address: Column) -> Column:
    return F.when(address == 0, "<system class loader>").otherwise(F.concat(F.lit("ClassLoader@"), F.lower(F.hex(address))))


def escape_controls(text: Column) -> Column:
    """Line breaks, tabs and backslashes written as two characters, other control characters as \\u and their code."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(code))
    for i in [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F]:
        out = F.replace(out, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    return out


def escape_field(text: Column) -> Column:
    """Percent escapes of the separators of serialized fields."""
    out = F.replace(text, F.lit("%"), F.lit("%25"))
    for char in (":", ";", "\0"):
        out = F.replace(out, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return out


_UNITS = {"": 1, "B": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def parse_size(text: str) -> int:
    """`512M`, `4GB`, `1.5G` or plain bytes, by powers of 1024."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([KMGT]?)B?\s*", text.upper())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * _UNITS[m[2]])


def format_size(n: int) -> str:
    for unit in ("TB", "GB", "MB", "KB"):
        if n >= _UNITS[unit[0]]:
            return f"{n / _UNITS[unit[0]]:.1f} {unit}"
    return f"{n} B"
