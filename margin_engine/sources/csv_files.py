"""CSV files of any size, encoding and header order, read in splits.

A quoted cell may hold line breaks, so a line is not always a record, and a task that starts in the middle of
a file does not know whether it starts inside a cell.  Spark's own answer is one task a file.  Here:

1. One splittable scan of the lines (raw bytes) counts the quotes of every file block, notes lines with an odd number
   of quotes and the number of each file's first line, which a second scan fetches.
2. The parities of a file's blocks, summed in order, say which blocks start inside a quoted cell (one small row a block).
3. Files are grouped by header; groups without odd lines go to Spark's line-splitting CSV reader as they are.
4. In the others each task, told its blocks' parities by a checked broadcast, puts lines together to records while it streams over
   them (all records of a batch at once).  Only records that cross a block's edge meet in a small shuffle.
   ``from_csv`` parses the records.
5. Groups are united by name; a column that a file lacks is null.

Encodings whose bytes below 0x40 stand for themselves (GBK, GB18030, Big5, Latin, Windows pages) take step 4 with a
decoding in the task; UTF-16 and UTF-32 files are read by Spark's reader, a task a file.

Defined cases: a byte-order mark is dropped; blank lines are skipped; an empty file adds nothing; a repeated heading gets the
suffix .1, .2, an empty one is ``Unnamed: <index>``; a row with fewer or more cells than its header, undecodable bytes and a file with
an odd number of quotes fail the read.  Quotes follow RFC 4180 (a quote inside a cell is doubled and the cell quoted); a file
with stray quotes in unquoted cells can be read with ``multi_line=False`` (no cell holds a line break).
"""

from __future__ import annotations

import codecs
import csv
import io
import re
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import bounded_broadcast
from ..plans.materialize import materialize

#: The dialect of every CSV read and write (batch, streaming and exports).
DIALECT = {"quote": '"', "escape": '"'}
_PIECES = "path string, start bigint, seq bigint, kind int, first boolean, text string"
_WHOLE, _BEGUN, _CONTINUED = 0, 1, 2
_HEADER_BYTES = 1 << 16


def header_names(line: str, sep: str = ",") -> list[str]:
    """Column names of a header record; repeated and empty headings are made distinct."""
    cells = next(csv.reader(io.StringIO(line.lstrip("﻿"), newline=""), delimiter=sep, strict=False), [])
    names, seen = [], {}
    for i, cell in enumerate(cells):
        name = cell if cell != "" else f"Unnamed: {i}"
        while name in seen:
            seen[cell] = seen.get(cell, 0) + 1
            name = f"{cell}.{seen[cell]}"
        seen.setdefault(name, 0)
        names.append(name)
    return names


def _file(uri: str) -> str:
    """A reader's path of a file: the metadata column holds an escaped URI, and readers take glob patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(uri))


def _lines(spark: SparkSession, paths) -> DataFrame:
    """(path, start, seq, line as bytes, quotes): a split's lines in order."""
    text = spark.read.option("lineSep", "\n").text(paths)
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                       F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("line"), quotes.alias("quotes"),
                       (F.trim("value", F.lit("\r\t ")) == "").alias("blank"))


def _survey(lines: DataFrame) -> DataFrame:
    """One row per file block: quotes, odd (a line has an odd number), the number of the first line that is not blank.

    Numbers alone are kept, so the lines are hashed, not sorted."""
    return lines.groupBy("path", "start").agg(
        F.sum("quotes").alias("quotes"), F.max(F.col("quotes") % 2).alias("odd"), F.min(F.when(~F.col("blank"), F.col("seq"))).alias("head_seq"))


def _heads(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(path, head, ...): ``files`` with the line of their number ``head_seq``; a second scan of the same files numbers lines alike."""
    known, _ = bounded_broadcast(files.select(F.col("path").alias("h_path"), "head_seq"))
    line = lines.select("path", "seq", F.struct("line", "quotes").alias("head"))
    found = line.join(known, (F.col("path") == F.col("h_path")) & (F.col("seq") == F.col("head_seq"))).select("path", "head")
    return files.drop("head_seq").join(found, "path")


def _block_parity(blocks: DataFrame) -> DataFrame:
    """(path, start, inside, crosses): whether a block starts inside a quoted cell, and whether a record crosses its edge."""
    order = Window.partitionBy("path").orderBy("start")
    before = F.coalesce(F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.select("path", "start", (before % 2 == 1).alias("inside"),
                         ((before % 2 == 1) | ((before + F.col("quotes")) % 2 == 1)).alias("crosses"))


def _assembler(encoding: str, edges: bool = False):
    """A task function: lines of whole blocks, in order, to records and to the pieces that cross block edges (``edges``: to these alone)."""
    def run(batches):
        block, inside, parts, at, begun, first = None, False, [], 0, False, False
        out = {k: [] for k in ("path", "start", "seq", "kind", "first", "text")}

        def close(open_end):
            """End the record in hand; its kind says whether this block holds its begin and its end."""
            nonlocal parts, first
            if parts:
                kind = _CONTINUED if not begun else _BEGUN if open_end else _WHOLE
                data = b"\n".join(parts)
                is_first = begun and first and bool(data.strip())
                if not edges or kind != _WHOLE:
                    for name, value in zip(out, (*block, at, kind, is_first, data.decode(encoding))):
                        out[name].append(value)
                first = first and not is_first
                parts = []

        def whole(records, seqs):
            """A batch of records that this block holds from begin to end."""
            nonlocal first
            flags = np.zeros(len(records), dtype=bool)
            if first:
                k = next((k for k, r in enumerate(records) if r.strip()), None)
                if k is not None:
                    flags[k], first = True, False
            if edges:
                return None
            text = pa.array(records, pa.binary()).cast(pa.string()) if encoding == "utf-8" else pa.array([r.decode(encoding) for r in records], pa.string())
            n = len(records)
            return pa.RecordBatch.from_arrays(
                [pa.repeat(block[0], n), pa.array(np.full(n, block[1], np.int64)), pa.array(seqs.astype(np.int64)),
                 pa.array(np.full(n, _WHOLE, np.int32)), pa.array(flags), text], names=list(out))

        for batch in batches:
            path, start = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            seq, line = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3)
            odd = batch.column(4).to_numpy(zero_copy_only=False) % 2
            begins_inside = batch.column(5).to_numpy(zero_copy_only=False)
            n = batch.num_rows
            new_block = np.flatnonzero((start[1:] != start[:-1]) | np.array([a != b for a, b in zip(path[1:], path[:-1])], dtype=bool)) + 1
            cuts = [0, *new_block.tolist(), n] if n else []
            for i, end in zip(cuts, cuts[1:]):
                if block != (path[i], int(start[i])):
                    close(inside)
                    block, inside = (path[i], int(start[i])), bool(begins_inside[i])
                    begun, first = not inside, start[i] == 0
                    at = int(seq[i])
                lines = line.slice(i, end - i).to_pylist()
                after = (np.cumsum(odd[i:end]) + inside) % 2 == 1  # whether a cell is open after each line
                ends = np.flatnonzero(~after) + 1
                done = 0
                if inside and len(ends):  # the record in hand ends here
                    done = int(ends[0])
                    parts += lines[:done]
                    close(False)
                    ends = ends[1:]
                if len(ends):
                    begins = np.append(done, ends[:-1])
                    records = [lines[b] if e == b + 1 else b"\n".join(lines[b:e]) for b, e in zip(begins.tolist(), ends.tolist())]
                    begun, done = True, int(ends[-1])
                    made = whole(records, seq[i + begins])
                    if made is not None:
                        yield made
                if done < len(lines):
                    if not parts and (done or not inside):
                        begun, at = True, int(seq[i + done])
                    parts += lines[done:]
                inside = bool(after[-1])
            yield _piece_batch(out)
        if block is not None:
            close(inside)
            yield _piece_batch(out)
    return run


def _piece_batch(out: dict) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))
    for v in out.values():
        v.clear()
    return batch


def _records(spark: SparkSession, paths, blocks: DataFrame, encoding: str) -> DataFrame:
    """(path, start, seq, first, text): the records of files with line breaks in cells or of another encoding."""
    def pieces(of, edges):
        lines = _lines(spark, of).select("path", "start", "seq", "line", "quotes")
        known, small = bounded_broadcast(blocks.select(F.col("path").alias("b_path"), F.col("start").alias("b_start"), "inside"))
        met = lines.join(known, (F.col("path") == F.col("b_path")) & (F.col("start") == F.col("b_start"))).drop("b_path", "b_start")
        if not small:  # more blocks than a broadcast may hold: the lines are brought in order by a shuffle
            met = met.repartition("path", "start").sortWithinPartitions("path", "start", "seq")
        return met.mapInArrow(_assembler(encoding, edges), _PIECES)

    out = pieces(paths, False).filter(F.col("kind") == _WHOLE).drop("kind")
    crossing = [_file(r.path) for r in blocks.filter("crosses").select("path").distinct().collect()]  # names of files
    if crossing:
        order = Window.partitionBy("path").orderBy("start", "seq")
        edges = pieces(crossing, True).filter(F.col("kind") != _WHOLE).withColumn("record", F.sum((F.col("kind") == _BEGUN).cast("int")).over(order))
        joined = edges.groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("start", "seq", "text"))).alias("p"), F.max("first").alias("first"))
        out = out.unionByName(joined.select("path", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["seq"].alias("seq"), "first",
                                            F.array_join("p.text", "\n").alias("text")))
    text = F.when(F.col("text").endswith("\r"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    return out.withColumn("text", text).filter(F.trim("text", F.lit("\t ")) != "")


def _place(path, start, row):
    return F.struct(path.alias("path"), start.alias("start"), row.alias("row"))


def _parse(records: DataFrame, names: list[str], types: dict, sep: str, position: str | None) -> DataFrame:
    fields = [f"c{i} {types.get(n, T.StringType()).simpleString()}" for i, n in enumerate(names)]
    options = {**DIALECT, "sep": sep, "mode": "FAILFAST", "multiLine": "true"}
    rows = records.filter(~F.col("first")).withColumn("cells", F.from_csv("text", ", ".join(fields), options))
    cells = [F.col(f"cells.c{i}").alias(n) for i, n in enumerate(names)]
    return rows.select(*cells, *([_place(F.col("path"), F.col("start"), F.col("seq")).alias(position)] if position else []))


def _by_reader(spark, paths, names, types, sep, position, **more) -> DataFrame:
    schema = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
    reader = spark.read.schema(schema).options(**DIALECT, header=True, sep=sep, mode="FAILFAST", **more)
    rows = reader.csv(paths)
    if not position:
        return rows
    return rows.select("*", _place(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias(position))


def _first_record(text: str) -> str:
    """The first record of a text that may hold line breaks in cells, with its line end's carriage return."""
    lines, quotes = [], 0
    for line in text.split("\n"):
        if not lines and not line.strip("﻿\r\t "):
            continue
        lines.append(line)
        quotes += line.count('"')
        if quotes % 2 == 0:
            break
    return "\n".join(lines)


def _wide_groups(spark, paths, encoding):
    """Files of an encoding with two or four bytes a unit, by header: a bounded piece of each file is looked at."""
    files = (spark.read.format("binaryFile").load(paths).filter("length > 0")
             .select(F.col("_metadata.file_path").alias("path"), F.substring("content", 1, _HEADER_BYTES).alias("head")).groupBy("head").agg(F.sort_array(F.collect_list("path")).alias("paths")))
    groups = {}
    for row in files.collect():
        text = codecs.getincrementaldecoder(encoding)(errors="strict").decode(bytes(row["head"]))
        groups.setdefault(_first_record(text), []).extend(row["paths"])
    return [(header, sorted(of), False) for header, of in groups.items() if header]


def _line_groups(spark, lines: DataFrame, blocks: DataFrame, parity: DataFrame, encoding: str, multi_line: bool):
    """(header, files, whether records need assembling) of each header; only headers and file names reach the driver."""
    first = F.min_by("head_seq", F.when(F.col("head_seq").isNotNull(), F.col("start")))
    files = blocks.groupBy("path").agg(first.alias("head_seq"), F.max("odd").alias("odd"), (F.sum("quotes") % 2).alias("left")).filter("head_seq is not null")
    files = _heads(lines, files)
    rows = files.groupBy("head.line", F.col("head.quotes").alias("quotes"), "odd", "left").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    broken = [r["paths"][0] for r in rows if r["left"] and multi_line]
    if broken:
        raise ValueError(f"odd number of quotes in {broken[0]}")
    groups = {}
    for r in rows:
        assemble = multi_line and (bool(r["odd"]) or encoding != "utf-8")
        header = bytes(r["line"]).decode(encoding).removesuffix("\r")
        if multi_line and r["quotes"] % 2:  # a heading with a line break: its record is assembled
            own = parity.filter(F.col("path").isin(r["paths"]))
            for rec in _records(spark, [_file(x) for x in r["paths"]], own, encoding).filter("first").collect():
                groups.setdefault((rec["text"], True), []).append(rec["path"])
        else:
            groups.setdefault((header, assemble), []).extend(r["paths"])
    return [(header, sorted(of), assemble) for (header, assemble), of in groups.items()]


def read_csv(spark: SparkSession, path, schema: T.StructType | None = None, sep: str = ",", multi_line: bool = True,
             encoding: str = "UTF-8", position: str | None = None) -> DataFrame:
    """All rows of the CSV files under ``path`` (a path or a list), united by name; text columns unless ``schema`` types them.

    ``multi_line=False`` states that no cell holds a line break.  ``position`` adds a column with a row's place: (path, start, row)."""
    paths = [path] if isinstance(path, str) else list(path)
    code = codecs.lookup(encoding).name.replace("utf_", "utf-")
    code = "utf-8" if code in ("ascii", "utf-8-sig") else code
    wide = code.startswith(("utf-16", "utf-32"))
    types = {f.name: f.dataType for f in schema.fields} if schema else {}
    if wide:
        groups, parity = _wide_groups(spark, paths, code), None
    else:
        blocks = materialize(_survey(_lines(spark, paths)), "csv-blocks")
        parity = materialize(_block_parity(blocks), "csv-parity")
        groups = _line_groups(spark, _lines(spark, paths), blocks, parity, code, multi_line or code != "utf-8")
    groups.sort(key=lambda g: (g[1][0], g[2]))
    frames = []
    for header, files, assemble in groups:
        names = header_names(header.removesuffix("\r"), sep)
        of = paths if len(groups) == 1 else [_file(x) for x in files]
        if assemble:
            own = parity if len(groups) == 1 else parity.filter(F.col("path").isin(files))
            frames.append(_parse(_records(spark, of, own, code), names, types, sep, position))
        elif wide:
            frames.append(_by_reader(spark, of, names, types, sep, position, multiLine=True, encoding=code.upper().replace("-LE", "LE").replace("-BE", "BE"),
                                     lineSep="\r\n" if header.endswith("\r") else "\n"))
        else:
            frames.append(_by_reader(spark, of, names, types, sep, position, multiLine=False))
    if not frames:
        names = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields] if schema else []
        place = [f"`{position}` struct<path:string,start:bigint,row:bigint>"] if position else []
        return spark.createDataFrame([], ", ".join(names + place) or T.StructType([]))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if schema:
        out = out.select(*[(F.col(f"`{f.name}`") if f.name in out.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields],
                         *([position] if position else []))
    elif position:
        out = out.select(*[F.col(f"`{c}`") for c in out.columns if c != position], position)
    return out
