"""Writes small HPROF files for tests."""

import struct


class Writer:
    def __init__(self, id_size=4, created=1234567890):
        self.id_size = id_size
        self.out = bytearray(b"JAVA PROFILE 1.0.2\0" + struct.pack(">IQ", id_size, created))
        self.heap = bytearray()

    def id(self, x):
        return struct.pack(">Q" if self.id_size == 8 else ">I", x)

    def record(self, tag, body):
        self.out += struct.pack(">BII", tag, 0, len(body)) + body

    def string(self, i, text):
        self.record(1, self.id(i) + text.encode())

    def load_class(self, serial, address, name):
        self.record(2, struct.pack(">I", serial) + self.id(address) + struct.pack(">I", 0) + self.id(name))

    def frame(self, i, method, signature, file, serial, line):
        self.record(4, self.id(i) + self.id(method) + self.id(signature) + self.id(file) + struct.pack(">Ii", serial, line))

    def trace(self, serial, thread, frames):
        self.record(5, struct.pack(">III", serial, thread, len(frames)) + b"".join(map(self.id, frames)))

    def root(self, tag, address, *numbers):
        self.heap += bytes([tag]) + self.id(address) + (self.id(0) if tag == 1 else b"") + b"".join(struct.pack(">I", n) for n in numbers)

    def class_dump(self, address, up=0, loader=0, fields=(), statics=(), size=0):
        body = self.id(address) + struct.pack(">I", 0) + self.id(up) + self.id(loader) + 4 * self.id(0) + struct.pack(">iH", size, 0)
        body += struct.pack(">H", len(statics)) + b"".join(self.id(n) + bytes([t]) + v for n, t, v in statics)
        body += struct.pack(">H", len(fields)) + b"".join(self.id(n) + bytes([t]) for n, t in fields)
        self.heap += b"\x20" + body

    def instance(self, address, of, data=b""):
        self.heap += b"\x21" + self.id(address) + struct.pack(">I", 0) + self.id(of) + struct.pack(">i", len(data)) + data

    def object_array(self, address, of, elements):
        self.heap += b"\x22" + self.id(address) + struct.pack(">Ii", 0, len(elements)) + self.id(of) + b"".join(map(self.id, elements))

    def primitive_array(self, address, kind, code, values):
        self.heap += b"\x23" + self.id(address) + struct.pack(">Ii", 0, len(values)) + bytes([kind]) + struct.pack(f">{len(values)}{code}", *values)

    def segment(self, tag=0x0C):
        self.record(tag, bytes(self.heap))
        self.heap = bytearray()

    def write(self, path):
        path.write_bytes(bytes(self.out))
        return str(path)


def small_heap(path):
    """Two classes, three reachable instances, an array of each kind, one unreachable instance."""
    w = Writer()
    for i, text in enumerate(("com.example.Base", "com.example.Child", "ref", "x"), 1):
        w.string(i, text)
    w.load_class(1, 0x10000, 1)
    w.load_class(2, 0x11000, 2)
    w.class_dump(0x10000, fields=[(3, 2)])
    w.class_dump(0x11000, up=0x10000, fields=[(3, 2), (4, 10)])
    w.root(1, 0x4000)
    w.instance(0x4000, 0x11000, struct.pack(">II", 0x20000, 1))
    w.instance(0x5000, 0x10000, struct.pack(">I", 0x30000))
    w.instance(0x6000, 0x10000, struct.pack(">I", 0))
    w.instance(0x7000, 0x11000, struct.pack(">II", 0, 1))
    w.object_array(0x20000, 0x10000, [0x5000, 0x6000])
    w.primitive_array(0x30000, 10, "i", [7, 8, 9])
    w.segment()
    return w.write(path)
