"""Small class files and archives written from names, for queries over tables that hold no compiled code."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A class of this name stands in the sample; as a prefix and six digits, others have the same length.
PREFIX, DIGITS = "shop/P", 6
PARENT = "shop/Base"


def class_file(name: str = PREFIX + "0" * DIGITS) -> bytes:
    """A public class that extends PARENT, with `void run(int[], Base)` whose line 7 calls `static int make(long)` of it."""
    texts = [name, PARENT, "run", f"([IL{PARENT};)V", "Code", "LineNumberTable", "make", "(J)I"]
    pool = b"".join(struct.pack(">BH", 1, len(x)) + x.encode() for x in texts)
    pool += struct.pack(">BHBHBHHBHH", 7, 1, 7, 2, 12, 7, 8, 10, 10, 11)  # 9, 10: the classes; 11: name and type; 12: the method
    lines = struct.pack(">HIHHH", 6, 6, 1, 0, 7)
    code = struct.pack(">HHI6BHH", 2, 3, 6, 0x09, 0xB8, 0, 12, 0x57, 0xB1, 0, 1) + lines
    method = struct.pack(">HHHHHI", 1, 3, 4, 1, 5, len(code)) + code
    return struct.pack(">IHHH", 0xCAFEBABE, 0, 52, 13) + pool + struct.pack(">HHHHH", 1, 9, 10, 0, 0) + struct.pack(">H", 1) + method + struct.pack(">H", 0)


def class_files(rows: DataFrame, number: str, package: str, whole: bool = False) -> DataFrame:
    """(package, path, content) of a class for each row, numbered by a column.

    Longer numbers are cut, so that several rows have one class; or, if whole, each has its own.
    """
    text = F.col(number).cast("string")
    digits = F.lpad(text, F.greatest(F.lit(DIGITS), F.length(text)) if whole else DIGITS, "0")
    mark = struct.pack(">H", len(PREFIX) + DIGITS) + (PREFIX + "0" * DIGITS).encode()
    size = F.lpad(F.hex(F.length(digits) + len(PREFIX)), 4, "0")
    content = F.unhex(F.replace(F.lit(class_file().hex().upper()), F.lit(mark.hex().upper()), F.concat(size, F.hex(F.concat(F.lit(PREFIX), digits)))))
    return rows.select(F.col(package).alias("package"), F.concat(F.lit("/r/classes/"), F.lit(PREFIX), digits, F.lit(".class")).alias("path"), content.alias("content"))


def archives(files: DataFrame) -> DataFrame:
    """An archive (path, content) of each file, which holds a note as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr(path.rpartition("/")[2], content)
                    z.writestr("note.txt", "no class")
                made.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([f"{p}.jar" for p in batch.column("path").to_pylist()]), pa.array(made, pa.binary())], ["path", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary")
