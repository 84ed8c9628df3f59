"""Binary tag files (named binary tags, gzip or plain) as rows, and back to bytes."""

from __future__ import annotations

import gzip
import json
import struct

from pyspark.sql import DataFrame, SparkSession

#: Tag numbers of the public format and the layout of their numbers (fixed values).
END, BYTE, SHORT, INT, LONG, FLOAT, DOUBLE, BYTES, STRING, LIST, COMPOUND, INTS, LONGS = range(13)
NUMBERS = {BYTE: ">b", SHORT: ">h", INT: ">i", LONG: ">q", FLOAT: ">f", DOUBLE: ">d"}
ARRAYS = {BYTES: ">b", INTS: ">i", LONGS: ">q"}


def parse(raw: bytes) -> tuple[str, dict]:
    """(name, tree) of a file: compounds as dicts of name to (tag, value), lists as (element tag, values)."""
    data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    at = 0

    def take(layout: str):
        nonlocal at
        (out,) = struct.unpack_from(layout, data, at)
        at += struct.calcsize(layout)
        return out

    def text() -> str:
        nonlocal at
        n = take(">H")
        at += n
        return data[at - n : at].decode("utf-8", "surrogatepass")

    def value(tag: int):
        if tag in NUMBERS:
            return take(NUMBERS[tag])
        if tag in ARRAYS:
            return [take(ARRAYS[tag]) for _ in range(take(">i"))]
        if tag == STRING:
            return text()
        if tag == LIST:
            kind = take(">b")
            return kind, [value(kind) for _ in range(take(">i"))]
        if tag == COMPOUND:
            out = {}
            while (kind := take(">b")) != END:
                name = text()
                out[name] = (kind, value(kind))
            return out
        raise ValueError(f"no such tag: {tag}")

    if take(">b") != COMPOUND:
        raise ValueError("a file begins with a compound")
    name = text()
    return name, value(COMPOUND)


def serialise(name: str, tree: dict, zipped: bool = True) -> bytes:
    """The bytes of a tree as ``parse`` gives it."""
    out = bytearray()

    def text(s: str) -> None:
        raw = s.encode("utf-8", "surrogatepass")
        out.extend(struct.pack(">H", len(raw)) + raw)

    def put(tag: int, v) -> None:
        if tag in NUMBERS:
            out.extend(struct.pack(NUMBERS[tag], v))
        elif tag in ARRAYS:
            out.extend(struct.pack(">i", len(v)) + b"".join(struct.pack(ARRAYS[tag], x) for x in v))
        elif tag == STRING:
            text(v)
        elif tag == LIST:
            out.extend(struct.pack(">bi", v[0], len(v[1])))
            for x in v[1]:
                put(v[0], x)
        else:
            for k, (kind, x) in v.items():
                out.extend(struct.pack(">b", kind))
                text(k)
                put(kind, x)
            out.append(END)

    out.extend(struct.pack(">b", COMPOUND))
    text(name)
    put(COMPOUND, tree)
    return gzip.compress(bytes(out), mtime=0) if zipped else bytes(out)


def gathered(tree: dict, under: str, beside: tuple[str, ...] = ("DataVersion",)) -> dict:
    """The tree in a newer shape: all keys but those ``beside`` move into one compound; a tree in that shape stays."""
    if under in tree:
        return tree
    return {k: v for k, v in tree.items() if k in beside} | {under: (COMPOUND, {k: v for k, v in tree.items() if k not in beside})}


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """One row (source, path, tag, value) for each leaf of tag files; lists and arrays are JSON."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def leaves(tree: dict, prefix: str):
        for k, (tag, v) in tree.items():
            place = f"{prefix}.{k}" if prefix else k
            if tag == COMPOUND:
                yield from leaves(v, place)
            else:
                yield place, tag, v if tag == STRING else json.dumps(v)

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(p, *leaf) for p, c in zip(f["path"], f["content"], strict=True) for leaf in leaves(parse(bytes(c))[1], "")]
            yield pd.DataFrame(rows, columns=["source", "path", "tag", "value"])

    return files.mapInPandas(run, "source string, path string, tag int, value string")


def write_tags(spark: SparkSession, files: list[tuple[str, dict]], folder: str) -> None:
    """One zipped file for each (name, tree), through the store's own file system."""
    jvm = spark.sparkContext._jvm
    for name, tree in files:
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.dat")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(serialise(name, tree)))
        out.close()
