"""CSV source/sink behaviour."""

import tempfile

import pytest

from tripsense import schema as S
from tripsense.operators.labels import last_label
from tripsense.sources.csv import read_csv_folder, read_experiments, union_by_name, write_csv, write_predictions


def test_csv_folder_nan_becomes_null_and_file_order(spark):
    root = tempfile.mkdtemp(prefix="tripsense-csv-")
    header = ",".join([S.KEY, *S.RAW_CHANNELS])
    rows_a = ["7," + ",".join(["1.0"] * 9 + ["NaN"]), "7," + ",".join(["2.0"] * 10)]
    rows_b = ["8," + ",".join(["3.0"] * 10)]
    for name, rows in (("part01.csv", rows_a), ("part02.csv", rows_b)):
        with open(f"{root}/{name}", "w") as f:
            f.write("\n".join([header, *rows]) + "\n")
    df = read_csv_folder(spark, root, with_file_order=True)
    got = sorted(((r[S.KEY], r["Speed"], r["_file"]) for r in df.collect()), key=lambda t: (t[0], t[1] is not None, t[1] or 0))
    assert got == [(7, None, "part01.csv"), (7, 2.0, "part01.csv"), (8, 3.0, "part02.csv")]
    assert dict(df.dtypes)[S.KEY] == "bigint"


def _folder(**files):
    root = tempfile.mkdtemp(prefix="tripsense-csv-")
    for name, text in files.items():
        with open(f"{root}/{name}.csv", "w") as f:
            f.write(text)
    return root


def test_csv_is_read_by_header_name(spark):
    root = _folder(a="bookingID,Accuracy,second,Speed\n1,5.0,0,7.0\n", b="bookingID,Speed,second,Accuracy\n2,9.0,1,\n",
                   c="Speed,bookingID,second\nNaN,3,2\n", d="")
    rows = {r[S.KEY]: r for r in read_csv_folder(spark, root).collect()}
    assert [(rows[k]["Accuracy"], rows[k]["second"], rows[k]["Speed"], rows[k]["gyro_x"]) for k in (1, 2, 3)] == [
        (5.0, 0.0, 7.0, None), (None, 1.0, 9.0, None), (None, 2.0, None, None)]
    with pytest.raises(ValueError):
        read_csv_folder(spark, _folder(a="bookingID,extra\n1,2\n"))
    with pytest.raises(FileNotFoundError):
        read_csv_folder(spark, _folder())
    inferred = read_csv_folder(spark, _folder(a="x,y\n1,NaN\n", b="y,x\n2.5,3\n"), None)
    assert sorted((r["x"], r["y"]) for r in inferred.collect() if r["y"]) == [(3, 2.5)] and inferred.filter("y IS NULL").count() == 1


def test_labels_may_be_written_as_floats(spark):
    root = _folder(a="bookingID,label\n1,1.0\n1,0\n2,\n3,NaN\n", b="label,bookingID\n0.0,4\n")
    lab = read_csv_folder(spark, root, S.LABEL_SCHEMA, with_file_order=True)
    assert dict(lab.dtypes)["label"] == "int"
    last = {r[S.KEY]: r["label"] for r in last_label(lab, order=["_file", "_block", "_row"]).collect()}
    assert last == {1: 0, 2: None, 3: None, 4: 0}
    with pytest.raises(Exception, match="fraction"):
        read_csv_folder(spark, _folder(a="bookingID,label\n1,0.5\n"), S.LABEL_SCHEMA).collect()


def test_headers_come_from_one_job(spark):
    """Many files, some of several splits, an empty one and one without a header line; one pattern stands for files of one header."""
    from tripsense.sources import csv as C
    files = {f"part{k:02d}": "bookingID,Speed\n" + f"{k},1.5\n" * (1 if k else 3000) for k in range(30)}
    root = _folder(**files, empty="")
    assert C._headers(spark, root) == {("bookingID", "Speed"): [f"{root}/*.csv"]}
    found = {r["path"].rsplit("/", 1)[1]: r["header"] for r in C.headers(spark, f"{root}/*.csv").collect()}
    assert found == {f"{n}.csv": "bookingID,Speed" for n in files}
    split = spark.newSession()
    split.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # the first file has several splits
    assert {r["path"].rsplit("/", 1)[1]: r["header"] for r in C.headers(split, f"{root}/*.csv").collect()} == found
    assert read_csv_folder(spark, root).count() == 3029
    mixed = C._headers(spark, _folder(a="bookingID,Speed\n1,2\n", b="Speed,bookingID\n3,4\n", c="bookingID,Speed\n", d="\n"))
    assert {k: [f.rsplit("/", 1)[1] for f in v] for k, v in mixed.items()} == {("bookingID", "Speed"): ["a.csv", "c.csv"], ("Speed", "bookingID"): ["b.csv"]}


def test_header_scan_reads_on_where_files_share_a_task(spark):
    import pyarrow as pa

    from tripsense.sources.csv import _first_lines
    rows = [("a", 0, "h1"), ("a", 0, "x"), ("b", 0, "h2"), ("b", 0, "y"), ("c", 900, "z"), ("d", 0, "h4")]
    batches = [pa.RecordBatch.from_pylist([{"path": p, "start": s, "value": v} for p, s, v in rows[k:k + 2]]) for k in (0, 2, 4)]
    batches.insert(1, pa.RecordBatch.from_pylist([{"path": "a", "start": 0, "value": "more"}]))
    assert [r["header"] for b in _first_lines(False)(iter(batches)) for r in b.to_pylist()] == ["h1", "h2", "h4"]
    assert [r["header"] for b in _first_lines(True)(iter(batches)) for r in b.to_pylist()] == ["h1"]


def test_whole_numbers_in_any_form(spark):
    big = 2**60 + 1
    df = read_csv_folder(spark, _folder(a=f"bookingID,label\n403726925929.0,1\n{big},0\n 7 ,\n"), S.LABEL_SCHEMA)
    assert sorted((r[S.KEY], r["label"]) for r in df.collect() if r["label"] is not None) == [(403726925929, 1), (big, 0)]
    assert df.filter("label IS NULL").first()[S.KEY] == 7
    for text, what in (("bookingID,label\n1.5,1\n", "fraction"), ("bookingID,label\nx,1\n", "no number")):
        with pytest.raises(Exception, match=what):
            read_csv_folder(spark, _folder(a=text), S.LABEL_SCHEMA).collect()


def test_experiment_table_and_single_file_sink(spark):
    out = tempfile.mkdtemp(prefix="tripsense-exp-") + "/e"
    runs = spark.createDataFrame([(1, "a", 0.7, 0.6), (2, "b", None, 0.8)], S.EXPERIMENT_SCHEMA)
    write_csv(runs, out)
    assert sorted(map(tuple, read_experiments(spark, out).collect())) == sorted(map(tuple, runs.collect()))


def test_union_by_name_and_prediction_sink(spark):
    a = spark.createDataFrame([(1, 0.5)], "bookingID long, x double")
    b = spark.createDataFrame([(2, 0.7)], "bookingID long, y double")
    u = union_by_name([a, b]).orderBy(S.KEY).collect()
    assert [(r["bookingID"], r["x"], r["y"]) for r in u] == [(1, 0.5, None), (2, None, 0.7)]
    out = tempfile.mkdtemp(prefix="tripsense-pred-") + "/p"
    pred = spark.createDataFrame([(1, 0.25), (2, 0.75)], "bookingID long, probability double")
    write_predictions(pred, out, single_file=True)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == [S.KEY, "probability"] and back.count() == 2
