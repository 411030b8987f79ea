"""Text lines of files: plain, compressed or in archives, with file name and 1-based line number.

Plain files of any size are read by byte ranges, as are large bz2 files: each range counts its lines, the counts before a
range are summed over the file, and no Python runs. gz, xz and small bz2 files and compressed tar archives are unpacked as
streams, one task each. Zip and tar archives are cut along their directory: the task that holds the archive hands on each
member's bytes as they are, in slices, and all cores unpack members. What is unpacked leaves a task in chunks of whole
lines that know the number of their first line.

Only newlines end lines; a byte order mark at the start of a file is no text. A file with a NUL in its first 4096 bytes is
binary and has no lines. A damaged file or member keeps the lines before the damage and says why it ends there. A file that
is packed and larger than 2 GB, or nested deeper than DEEPEST, is an error of its own. Archives without a name that tells
are known by their first bytes.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions.tables import bounded_batches, few, persisted

DEEPEST = 8
HEAD_BYTES = 4096
#: Bytes of unpacked text that a row holds, about, and packed bytes of a member that a row holds.
CHUNK, SLICE = 1 << 20, 4 << 20
#: bz2 files above this size are read by ranges.
SPLIT_BZ2 = 64 << 20
MOST_PACKED = (1 << 31) - 64
PACKED = r"(?i)\.(gz|bz2|xz|zip|tar|tgz|tbz2?|txz)$"
ARCHIVE = r"(?i)\.(zip|tar)$"
BOM = b"\xef\xbb\xbf"

FILES = "src_file string, bytes long, file_year int, error string, binary boolean"
PIECES = "src_file string, first_line int, value binary, bytes long, file_year int, error string, binary boolean"
SLICES = "src_file string, member int, seq int, value binary, method string, crc long, bytes long, file_year int, error string"


def root_of(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The folder that labels are relative to: the path itself if it is a folder, else the folder it lies in; and whether the path is one file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = fs.makeQualified(hadoop)
    if re.search(r"[*?\[{]", path):
        return re.split(r"[*?\[{]", whole.toString())[0].rsplit("/", 1)[0], False
    folder = fs.getFileStatus(whole).isDirectory()
    return (whole if folder else whole.getParent()).toString(), not folder


def path_of(url: Column) -> Column:
    """Metadata has paths as URLs, with one slash or three before a local one."""
    return F.regexp_replace(F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def label_of(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(F.substring_index(path, "/", -1))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(files, lines) below path: a row for each file or archive member; src_file, line_no, line, file_year of each line."""
    root, _ = root_of(spark, path)
    name, size = F.col("_metadata.file_name"), F.col("_metadata.file_size")
    where = path_of(F.col("_metadata.file_path"))
    plain = ~name.rlike(PACKED) | name.rlike(r"(?i)\.bz2$") & ~name.rlike(r"(?i)\.tar\.bz2$") & (size > SPLIT_BZ2)
    year = F.year("_metadata.file_modification_time").alias("file_year")

    def under(kind: str) -> DataFrame:
        return spark.read.format(kind).option("recursiveFileLookup", "true").option("lineSep", "\n").load(path)

    # names decide at planning which files a read opens
    text = under("text").where(plain).select(where.alias("path"), F.col("_metadata.file_block_start").alias("block"), year, "value", F.monotonically_increasing_id().alias("pos"))
    raw = persisted(text.withColumn("src_file", label_of(F.col("path"), root)), "text")
    listed = under("binaryFile").where(plain).select(label_of(where, root).alias("src_file"), F.col("length").alias("bytes"), year)
    splits, flags = _splits(raw)
    unnamed = [r["path"] for r in flags.where("archive").select("path").collect()]  # archives that only their first bytes tell
    bounded_batches(spark)
    columns = [label_of(where, root).alias("src_file"), F.col("length").alias("bytes"), year, F.when(F.col("length") <= MOST_PACKED, F.col("content")).alias("content")]
    direct = under("binaryFile").where(~plain & ~name.rlike(ARCHIVE)).select(*columns)
    archives = under("binaryFile").where(~plain & name.rlike(ARCHIVE)).select(*columns)
    if unnamed:
        archives = archives.unionByName(spark.read.format("binaryFile").load(unnamed).select(*columns))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = archives.mapInArrow(_sliced, SLICES).repartition(n, "src_file", "member").sortWithinPartitions("src_file", "member", "seq")
    pieces = persisted(direct.mapInArrow(_unpacked_files, PIECES).unionByName(slices.mapInArrow(_unpacked_members, PIECES)), "pieces")

    lines = _numbered(raw, splits, flags).unionByName(_lines_of_pieces(pieces))
    files = listed.join(flags.select("src_file", "binary", "archive"), "src_file", "left").where("archive is null or not archive")
    files = files.select("src_file", "bytes", "file_year", F.lit(None).cast("string").alias("error"), F.coalesce("binary", F.lit(False)).alias("binary"))
    return files.unionByName(pieces.where("value is null").select("src_file", "bytes", "file_year", "error", "binary")).unionByName(_empty(under("binaryFile"), where, root)), lines


def _empty(every: DataFrame, where: Column, root: str) -> DataFrame:
    """Files without content, which reads leave out: those that the listing has and no read does."""
    listed = every.sparkSession.createDataFrame([(x,) for x in every.inputFiles()], "path string").select(path_of(F.col("path")).alias("path"))
    none = listed.join(every.select(where.alias("path")), "path", "left_anti")
    return none.select(label_of(F.col("path"), root).alias("src_file"), F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("int").alias("file_year"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("binary"))


def numbered(raw: DataFrame) -> DataFrame:
    """Lines of what a text read gave, written already: src_file, path, block (of the byte range), pos (rising in a range), value, file_year."""
    return _numbered(raw, *_splits(raw))


def _numbered(raw: DataFrame, splits: DataFrame, flags: DataFrame) -> DataFrame:
    keys = ["src_file", "block"]
    starts = splits.join(flags.where("binary or archive").select("src_file"), "src_file", "left_anti").select(*keys, "first", "before")
    d = raw.join(few(starts), keys)
    return d.select("src_file", (F.col("pos") - F.col("first") + F.col("before") + 1).cast("int").alias("line_no"), F.make_valid_utf8("value").alias("line"), "file_year")


def _splits(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each byte range its first position and the lines before it; of each file whether its first bytes are binary or an archive."""
    at = Window.partitionBy("src_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    n = raw.groupBy("src_file", "path", "block").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    splits = persisted(n.withColumn("before", F.coalesce(F.sum("n").over(at), F.lit(0))), "splits")
    # no more lines than bytes can begin in the first bytes of a file
    start = splits.where("block = 0").select("src_file", "first")
    head = raw.where("block = 0").join(few(start), "src_file").where(F.col("pos") - F.col("first") < HEAD_BYTES)
    data = F.col("value").cast("binary")
    before = Window.partitionBy("src_file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    head = head.select("src_file", "path", "pos", "first", F.substring(data, 1, HEAD_BYTES).alias("data"), F.coalesce(F.sum(F.octet_length("value") + 1).over(before), F.lit(0)).alias("at")).where(F.col("at") < HEAD_BYTES)
    seen = F.decode(F.expr(f"substring(data, 1, cast({HEAD_BYTES} - at as int))"), "ISO-8859-1")
    zipped = (F.col("at") == 0) & (F.substring(seen, 1, 4) == "PK\x03\x04")
    tarred = (F.col("at") <= 257) & (F.expr("substring(decode(data, 'ISO-8859-1'), cast(258 - at as int), 5)") == "ustar")
    flags = head.groupBy("src_file", "path").agg(F.max(F.instr(seen, "\0") > 0).alias("binary"), F.max(zipped | tarred).alias("archive"))
    return splits, persisted(flags, "heads")


def _lines_of_pieces(pieces: DataFrame) -> DataFrame:
    """Lines of chunks that end at a newline or at the end of their file."""
    text = F.make_valid_utf8(F.col("value").cast("string"))
    parts = F.split(text, "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    out = pieces.where("value is not null").select("src_file", "first_line", "file_year", F.posexplode(parts).alias("_i", "line"))
    return out.select("src_file", (F.col("first_line") + F.col("_i")).alias("line_no"), "line", "file_year")


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[f for f, _ in fields])


def _pieces(label: str, blocks: Iterable[bytes], size: int, year: int) -> Iterator[pa.RecordBatch]:
    """Chunks of whole lines, then the row of the file."""
    held: list[bytes] = []
    line, error, binary, first = 1, None, False, True
    try:
        for data in blocks:
            if first:
                first, binary = False, b"\0" in data[:HEAD_BYTES]
                data = data.removeprefix(BOM)
            if binary:
                break
            cut = data.rfind(b"\n") + 1
            if not cut:
                held.append(data)
                continue
            out = b"".join([*held, data[:cut]])
            held = [data[cut:]]
            yield _batch(PIECES, [(label, line, out, size, year, None, False)])
            line += out.count(b"\n")
    except Exception as e:  # a damaged file is reported and ends nothing but itself
        error = _said(e)
    if any(held):
        yield _batch(PIECES, [(label, line, b"".join(held), size, year, None, False)])
    yield _batch(PIECES, [(label, 0, None, size, year, error, binary)])


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:200]


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes | None, int, int]]:
    for b in batches:
        for i in range(b.num_rows):
            content = b.column("content")[i].as_buffer()
            yield b.column("src_file")[i].as_py(), None if content is None else content.to_pybytes(), b.column("bytes")[i].as_py(), b.column("file_year")[i].as_py()


TOO_LARGE = "packed files above 2 GB cannot be read"


def _unpacked_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for label, content, size, year in _files(batches):
        if content is None:
            yield _batch(PIECES, [(label, 0, None, size, year, TOO_LARGE, False)])
            continue
        try:
            for name, blocks in opened(label, content):
                yield from _pieces(name, blocks, size, year)
        except Exception as e:
            yield _batch(PIECES, [(label, 0, None, size, year, _said(e), False)])


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of zip and tar archives as they are stored, in slices."""
    for label, content, size, year in _files(batches):
        if content is None:
            yield _batch(SLICES, [(label, 0, 0, None, "", None, size, year, TOO_LARGE)])
            continue
        try:
            for k, (name, data, method, crc) in enumerate(_members(label, content)):
                for seq, at in enumerate(range(0, max(1, len(data)), SLICE)):
                    yield _batch(SLICES, [(name, k, seq, bytes(data[at : at + SLICE]), method, crc, size, year, None)])
        except Exception as e:
            yield _batch(SLICES, [(label, 0, 0, None, "", None, size, year, _said(e))])


def _members(label: str, content: bytes) -> Iterator[tuple[str, memoryview, str, int | None]]:
    """(label, stored bytes, method, checksum) of each regular member, by the archive's directory."""
    view = memoryview(content)
    if content[:4] == b"PK\x03\x04" or not _is_tar(label, content):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for m in z.infolist():
                if m.is_dir() or not _safe(m.filename):
                    continue
                name = f"{label}!/{m.filename}"
                if m.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) and not m.flag_bits & 1:
                    at = m.header_offset  # the local header's name and extra field precede the data
                    at += 30 + int.from_bytes(view[at + 26 : at + 28], "little") + int.from_bytes(view[at + 28 : at + 30], "little")
                    yield name, view[at : at + m.compress_size], "deflate" if m.compress_type == zipfile.ZIP_DEFLATED else "stored", m.CRC
                else:
                    yield name, memoryview(z.read(m)), "stored", None
        return
    with tarfile.open(fileobj=io.BytesIO(content)) as t:
        for m in t:
            if m.isfile() and _safe(m.name):
                yield f"{label}!/{m.name}", memoryview(t.extractfile(m).read()) if m.issparse() else view[m.offset_data : m.offset_data + m.size], "stored", None


def _unpacked_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted slices, member by member."""
    rows = (r for b in batches for r in b.to_pylist())
    row = next(rows, None)
    while row is not None:
        head = row

        def stored() -> Iterator[bytes]:
            nonlocal row
            while row is not None and (row["src_file"], row["member"]) == (head["src_file"], head["member"]):
                if row["value"]:
                    yield row["value"]
                row = next(rows, None)

        if head["error"]:
            yield _batch(PIECES, [(head["src_file"], 0, None, head["bytes"], head["file_year"], head["error"], False)])
            for _ in stored():
                pass
            continue
        label, source = head["src_file"], stored()
        blocks = inflated(source, head["method"], head["crc"])
        try:
            first = next(blocks, b"")
            if _nested(label, first):  # needs its own directory, so it is held whole
                for name, inner in opened(label, b"".join([first, *blocks]), 1):
                    yield from _pieces(name, inner, head["bytes"], head["file_year"])
            else:
                yield from _pieces(label, _then(first, blocks), head["bytes"], head["file_year"])
        except Exception as e:
            yield _batch(PIECES, [(label, 0, None, head["bytes"], head["file_year"], _said(e), False)])
        for _ in source:  # what a damaged member leaves
            pass


def _then(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    if first:
        yield first
    yield from rest


def inflated(slices: Iterator[bytes], method: str, crc: int | None) -> Iterator[bytes]:
    """The bytes of a member in blocks of at most CHUNK, checked at the end."""
    engine, sum_ = (zlib.decompressobj(-zlib.MAX_WBITS) if method == "deflate" else None), 0
    for data in slices:
        while data:
            if engine:
                out, data = engine.decompress(data, CHUNK), engine.unconsumed_tail
            else:
                out, data = data[:CHUNK], data[CHUNK:]
            sum_ = zlib.crc32(out, sum_)
            if out:
                yield out
    if engine:
        out = engine.flush()
        sum_ = zlib.crc32(out, sum_)
        if out:
            yield out
        if not engine.eof:
            raise EOFError("the member ends too early")
    if crc is not None and crc != sum_:
        raise ValueError("the member's checksum differs")


def is_binary(content: Column) -> Column:
    """A NUL in the first 4096 bytes."""
    return F.instr(F.decode(F.substring(content, 1, HEAD_BYTES), "ISO-8859-1"), "\0") > 0


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines below path."""
    return read(spark, path)[1]


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """files, bytes below path as they lie on disk; nothing is read."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return b.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def _is_tar(name: str, data: bytes) -> bool:
    return name.lower().endswith((".tar.gz", ".tgz", ".tar.bz2", ".tbz", ".tbz2", ".tar.xz", ".txz", ".tar")) or data[257:262] == b"ustar"


def _nested(name: str, first: bytes) -> bool:
    return first[:4] == b"PK\x03\x04" or _is_tar(name, first) or name.lower().endswith((".gz", ".bz2", ".xz"))


def opened(name: str, data: bytes, depth: int = 0) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(logical name, blocks): archives give archive!/inner for each regular file, nested ones too; unsafe member names are skipped. Blocks must be taken before the next file."""
    zipped = data[:4] == b"PK\x03\x04"
    if zipped or _is_tar(name, data):
        if depth >= DEEPEST:
            raise ValueError(f"archives nested deeper than {DEEPEST}")
        if zipped:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for m in z.infolist():
                    if not m.is_dir() and _safe(m.filename):
                        with z.open(m) as f:
                            yield from _inside(f"{name}!/{m.filename}", f, depth)
        else:
            with tarfile.open(fileobj=io.BytesIO(data), mode="r|*") as t:
                for m in t:
                    if m.isfile() and _safe(m.name):
                        yield from _inside(f"{name}!/{m.name}", t.extractfile(m), depth)
        return
    low = name.lower()
    for suffix, stream in ((".gz", gzip.GzipFile), (".bz2", bz2.BZ2File), (".xz", lzma.LZMAFile)):
        if low.endswith(suffix):
            with stream(io.BytesIO(data)) if suffix != ".gz" else stream(fileobj=io.BytesIO(data)) as f:
                yield name, _blocks(f)
            return
    yield name, iter([data] if data else [])


def _inside(name: str, f: io.BufferedIOBase, depth: int) -> Iterator[tuple[str, Iterator[bytes]]]:
    first = f.read(CHUNK)
    if _nested(name, first):
        yield from opened(name, first + f.read(), depth + 1)
    else:
        yield name, _then(first, _blocks(f))


def _blocks(f: io.BufferedIOBase) -> Iterator[bytes]:
    return iter(lambda: f.read(CHUNK), b"")


def unpacked(name: str, data: bytes) -> list[tuple[str, bytes]]:
    """Names and whole contents of a small file, sorted by name."""
    return sorted((n, b"".join(blocks)) for n, blocks in opened(name, data))


def _safe(name: str) -> bool:
    return not name.startswith(("/", "\\")) and ".." not in name.replace("\\", "/").split("/")
