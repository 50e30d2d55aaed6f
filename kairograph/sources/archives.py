"""Zip archives as tables: a directory of their members, and members read by as many tasks as their bytes ask for.

Reading has two steps. `members` reads only the directory at the end of each archive: a row for each member with its place
and size, to filter before anything is unpacked. `contents` then cuts each archive into splits of so many bytes by the
members' places, and a task reads its members in their order in the archive, one at a time, so one large archive is
the work of many tasks and no task holds more than one member. A lost task reads its own splits again.

Defined cases: folders in archives are left out; empty archives and empty files give no members; a file that isn't a zip archive, a
member that is encrypted or packed otherwise than by storing or deflating, and one whose bytes don't match its checksum raise
an error that names it; a name that comes twice gives two rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT_BYTES = 32 << 20
_MEMBERS = "path string, entry string, place long, packed long, size long, crc long, method int, encrypted boolean"


def opened(path: str):
    """A random-access file at any address that Arrow's file systems know."""
    from urllib.parse import quote

    from pyarrow.fs import FileSystem, LocalFileSystem

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, inner = FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_file(inner)


class _Directory:
    """What reading a directory needs of a file; a place before its start is the OSError that zipfile looks for, which Arrow's isn't."""

    def __init__(self, file):
        self.file, self.read, self.tell = file, file.read, file.tell

    def seekable(self) -> bool:
        return True

    def seek(self, to: int, whence: int = 0) -> int:
        at = to + (0, self.file.tell(), self.file.size())[whence]
        if at < 0:
            raise OSError("before the start of the file")
        return self.file.seek(at)


def members(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, entry, place, packed, size, crc, method, encrypted): the members of the archives below `path` that match a pattern of file names,
    from their directories only."""

    def listed(batches: Iterator) -> Iterator:
        import zipfile

        import pandas as pd

        for frame in batches:
            for where, length in zip(frame["path"], frame["length"], strict=True):
                if not length:
                    continue
                with opened(where) as file:
                    try:
                        found = [m for m in zipfile.ZipFile(_Directory(file)).infolist() if not m.is_dir()]
                    except zipfile.BadZipFile as error:
                        raise ValueError(f"{where}: {error}") from error
                rows = [(where, m.filename, m.header_offset, m.compress_size, m.file_size, m.CRC, m.compress_type, bool(m.flag_bits & 1)) for m in found]
                for start in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[start : start + 10_000], columns=["path", "entry", "place", "packed", "size", "crc", "method", "encrypted"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.mapInPandas(listed, _MEMBERS)


def contents(chosen: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, entry, content) of chosen rows of `members`, content as bytes. Splits are dealt to tasks by archive and place."""

    def unpacked(batches: Iterator) -> Iterator:
        import struct
        import zlib

        import pandas as pd

        for frame in batches:
            for where, own in frame.sort_values(["path", "place"]).groupby("path", sort=False):
                with opened(where) as file:
                    for m in own.itertuples():
                        if m.encrypted or m.method not in (0, 8):
                            raise ValueError(f"{where}: {m.entry} is encrypted or packed by method {m.method}")
                        file.seek(m.place)
                        head = file.read(30)
                        file.seek(m.place + 30 + sum(struct.unpack("<HH", head[26:30])))
                        data = file.read(m.packed)
                        if m.method == 8:
                            try:
                                data = zlib.decompress(data, -15)
                            except zlib.error as error:
                                raise ValueError(f"{where}: {m.entry}: {error}") from error
                        if len(data) != m.size or zlib.crc32(data) != m.crc:
                            raise ValueError(f"{where}: the bytes of {m.entry} don't match its checksum")
                        yield pd.DataFrame({"path": [where], "entry": [m.entry], "content": [data]})

    split = F.floor(F.col("place") / split_bytes)
    ends = chosen.groupBy("path").agg(F.max(split).alias("last"))
    tasks = ends.agg(F.coalesce(F.sum(F.col("last") + 1), F.lit(1))).first()[0]
    dealt = chosen.select("path", "entry", "place", "packed", "size", "crc", "method", "encrypted").repartition(max(1, min(tasks, 100_000)), F.col("path"), split)
    return dealt.mapInPandas(unpacked, "path string, entry string, content binary")
