"""CSV in splits: line breaks, encodings, by-name union, broken files."""

import csv
import random
import tempfile

import pytest

from margin_engine.sources import csv_files as X
from margin_engine.sources.readers import load_pair, read_table

CELLS = ["", "a", "x,y", 'q"q', "two\nlines", "crlf\r\nhere", "中文“引”", "  sp ", '"', "\n\n", "long " * 60, " \n", ",", "é"]


@pytest.fixture()
def small_splits(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def write(path, rows, encoding="utf-8", end="\n"):
    with open(path, "w", encoding=encoding, newline="") as f:
        csv.writer(f, lineterminator=end).writerows(rows)


def told(rows):
    return sorted((tuple(None if v == "" else v for v in r) for r in rows), key=str)


def some_rows(n, width, seed=1):
    rng = random.Random(seed)
    keep = [c for c in CELLS if "é" not in c]
    return [[f"O{i}", *[rng.choice(keep) for _ in range(width - 1)]] for i in range(n)]


@pytest.mark.parametrize("encoding,end", [("utf-8", "\n"), ("utf-8-sig", "\r\n"), ("gb18030", "\r\n"), ("gbk", "\n"), ("utf-16", "\n"),
                                          ("utf-16", "\r\n"), ("utf-16-be", "\n")])
def test_cells_survive_splits_and_encodings(spark, small_splits, encoding, end):
    base = tempfile.mkdtemp(prefix="me-csv ä[1]-")
    rows = some_rows(400, 3)
    if encoding.startswith("utf-16"):  # Spark's reader turns line ends inside cells into \n
        rows = [[v.replace("\r\n", "\n") for v in r] for r in rows]
    path = f"{base}/订单 1.csv"
    write(path, [["订单号", "备注\n第二", "c,3"], *rows], encoding, end)
    plain = path.replace("[", "\\[").replace("]", "\\]")
    df = read_table(spark, plain, "csv", encoding=encoding)
    assert df.columns == ["订单号", "备注\n第二", "c,3"]
    assert told(tuple(r) for r in df.collect()) == told(rows)
    if not encoding.startswith("utf-16"):
        assert df.rdd.getNumPartitions() > 5


def test_cells_longer_than_a_split(spark, small_splits):
    base = tempfile.mkdtemp(prefix="me-csv-")
    rows = [["O1", "x\n" * 9000], ["O2", "b"], ["O3", ("y" * 100 + "\n") * 200 + "end"], ["O4", 'z"\n"'] ]
    write(f"{base}/a.csv", [["k", "v"], *rows])
    assert told(tuple(r) for r in read_table(spark, base, "csv").collect()) == told(rows)


def test_shuffled_way_beyond_the_broadcast_bound(spark, small_splits, monkeypatch):
    monkeypatch.setattr(X, "bounded_broadcast", lambda df: (df, False))
    base = tempfile.mkdtemp(prefix="me-csv-")
    rows = some_rows(300, 2, 3)
    write(f"{base}/a.csv", [["k", "v"], *rows])
    assert told(tuple(r) for r in read_table(spark, base, "csv").collect()) == told(rows)


def test_files_are_united_by_name(spark):
    base = tempfile.mkdtemp(prefix="me-csv-")
    write(f"{base}/a.csv", [["订单号", "备注"], ["O1", "x"]])
    write(f"{base}/b.csv", [["备注", "订单号", "店铺"], ["y\nz", "O2", "S"]])
    write(f"{base}/c.csv", [["订单号", "备注"], ["O3", "a\nb"]])
    write(f"{base}/d.csv", [["备注"], ["only"]])
    open(f"{base}/e.csv", "w").close()
    df = read_table(spark, base, "csv")
    assert df.columns == ["订单号", "备注", "店铺"]
    assert told(tuple(r) for r in df.collect()) == told([("O1", "x", None), ("O2", "y\nz", "S"), ("O3", "a\nb", None), (None, "only", None)])


def test_headings(spark):
    assert X.header_names("﻿a,b,a,,a,\"x\ny\"") == ["a", "b", "a.1", "Unnamed: 3", "a.2", "x\ny"]
    assert X.header_names("a.1,a,a") == ["a.1", "a", "a.2"]
    base = tempfile.mkdtemp(prefix="me-csv-")
    with open(f"{base}/a.csv", "w") as f:
        f.write("\n  \na,a\n\n1,2\n   \n3,4")
    df = read_table(spark, base, "csv")
    assert df.columns == ["a", "a.1"] and sorted(map(tuple, df.collect())) == [("1", "2"), ("3", "4")]


def test_broken_files_fail(spark):
    def load(text, **options):
        base = tempfile.mkdtemp(prefix="me-csv-")
        with open(f"{base}/a.csv", "wb") as f:
            f.write(text)
        return read_table(spark, base, "csv", **options).collect()

    for bad in (b"a,b\n1\n", b"a,b\n1,2,3\n", b'a,b\n"x\n1",2\n"y\nz"\n'):
        with pytest.raises(Exception, match="(?i)malformed"):
            load(bad)
    with pytest.raises(ValueError, match="odd number of quotes"):
        load(b'a,b\n1,2"\n')
    assert [tuple(r) for r in load(b'a,b\n1,2"\n', multi_line=False)] == [("1", '2"')]
    with pytest.raises(Exception, match="(?i)codec"):
        load(b"a,b\n\xff\xff,1\n", encoding="gbk")


def test_schema_types_and_missing_columns(spark):
    from pyspark.sql import types as T
    base = tempfile.mkdtemp(prefix="me-csv-")
    write(f"{base}/a.csv", [["n", "t"], ["1", "x\ny"]])
    write(f"{base}/b.csv", [["t"], ["z"]])
    schema = T.StructType().add("t", "string").add("n", "integer").add("none", "double")
    df = read_table(spark, base, "csv", schema)
    assert df.schema == schema
    assert sorted(map(tuple, df.collect()), key=str) == [("x\ny", 1, None), ("z", None, None)]
    assert read_table(spark, tempfile.mkdtemp(prefix="me-csv-") if False else f"{base}/b.csv", "csv", schema).count() == 1


def test_positions_follow_the_file(spark, small_splits):
    base = tempfile.mkdtemp(prefix="me-csv-")
    rows = [[f"O{i}", "a\nb" if i % 7 == 0 else "c"] for i in range(900)]
    write(f"{base}/o.csv", [["订单号", "备注"], *rows])
    write(f"{base}/p.csv", [["商家编码", "成本"], ["A", "1"]])
    pair = load_pair(spark, f"{base}/p.csv", f"{base}/o.csv")
    assert pair.orders.columns == ["订单号", "备注"]
    place = pair.positioned_orders.columns[-1]
    assert [r[0] for r in pair.positioned_orders.orderBy(place).collect()] == [r[0] for r in rows]


def test_lines_are_surveyed_without_a_sort_and_edges_alone_are_made_twice(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"k,v\n" + b"".join(b'%d,"x\ny"\n%d,z\n' % (i, i) for i in range(50)))
    plan = X._survey(X._lines(spark, str(tmp_path)))._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    import pyarrow as pa
    lines = [b'q",1', b"a,1", b'b,"2', b'3"', b"", b'c,"4']  # a block that begins and ends inside a cell
    columns = [["f"] * 6, [9] * 6, list(range(6)), lines, [x.count(b'"') for x in lines], [True] * 6]
    for cut in range(1, 6):  # however the lines are dealt over batches
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list("abcdef"))
        for edges, want in ((False, [(0, 2, 'q",1'), (1, 0, "a,1"), (2, 0, 'b,"2\n3"'), (4, 0, ""), (5, 1, 'c,"4')]), (True, [(0, 2, 'q",1'), (5, 1, 'c,"4')])):
            got = [r for b in X._assembler("gb18030", edges)([batch.slice(0, cut), batch.slice(cut)]) for r in b.to_pylist()]
            assert sorted((r["seq"], r["kind"], r["text"]) for r in got) == want
