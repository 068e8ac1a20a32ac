import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators.learners import Learner
from tidemark.operators.training import Model
from tidemark.sources import files
from tidemark.sources.bars import read_bars, read_bars_text, typed_bars
from tidemark.sources.models import load_model, save_model
from tidemark.sources.prepared import committed, fingerprint, read_prepared, write_prepared
from tidemark.sources.sequences import (
    read_file_pairs,
    read_labelled_files,
    read_lines,
    read_numbered_files,
    read_numbered_labels,
    read_series_text,
)


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "sequence").mkdir()
    (tmp_path / "label").mkdir()
    for i in range(10):
        lines = ["a,b"] + [f"{i}.5, {t}" for t in range(i + 1)]
        (tmp_path / "sequence" / f"{i}.csv").write_text("\n".join(lines) + ("\n" if i % 2 else ""))
        if i != 4:
            (tmp_path / "label" / f"{i}.csv").write_text(f"{i % 2}\n")
    (tmp_path / "sequence" / "notes.txt").write_text("not a sequence")
    return tmp_path


@pytest.mark.parametrize("large", [False, True])
def test_numbered_files(spark, folders, large):
    rows = read_numbered_files(spark, f"{folders}/sequence", ["a", "b"], skip_lines=1, large_files=large)
    got = sorted(map(tuple, rows.collect()))
    assert got == [(i, t, i + 0.5, float(t)) for i in range(10) for t in range(i + 1)]
    some = read_numbered_files(spark, f"{folders}/sequence", ["a"], skip_lines=1, ids=(2, 3), large_files=large)
    assert {r.seq_id for r in some.collect()} == {2, 3}
    labels = read_numbered_labels(spark, f"{folders}/label", large_files=large)
    assert {(r.seq_id, r.label) for r in labels.collect()} == {(i, i % 2) for i in range(10) if i != 4}


def test_windows_line_ends_and_other_delimiter(spark, tmp_path):
    (tmp_path / "0.csv").write_bytes(b"1;2\r\n3;4\r\n")
    rows = read_numbered_files(spark, str(tmp_path), ["x", "y"], delimiter=";")
    assert sorted(map(tuple, rows.collect())) == [(0, 0, 1.0, 2.0), (0, 1, 3.0, 4.0)]


def test_name_that_is_no_number(spark, folders):
    (folders / "sequence" / "extra.csv").write_text("a,b\n1,2\n")
    with pytest.raises(PySparkException):
        read_numbered_files(spark, f"{folders}/sequence", ["a"], skip_lines=1).collect()
    rows = read_numbered_files(spark, f"{folders}/sequence", ["a"], skip_lines=1, strict_names=False)
    assert rows.select("seq_id").distinct().count() == 10


def test_value_that_is_no_number_raises(spark, tmp_path):
    (tmp_path / "0.csv").write_text("1,x\n")
    with pytest.raises(PySparkException):
        read_numbered_files(spark, str(tmp_path), ["a", "b"]).collect()


def test_file_pairs_keep_both_contents(spark, folders):
    pairs = read_file_pairs(spark, f"{folders}/sequence", f"{folders}/label").collect()
    assert {p.seq_id for p in pairs} == set(range(10)) - {4}
    for p in pairs:
        assert bytes(p.features).startswith(b"a,b") and bytes(p.labels).strip() == str(p.seq_id % 2).encode()
        assert p.features_path != p.labels_path


def test_file_pairs_need_the_whole_name_to_be_a_number(spark, tmp_path):
    for side, name in (("x", "12"), ("x", "note13"), ("y", "12"), ("y", "13")):
        (tmp_path / side).mkdir(exist_ok=True)
        (tmp_path / side / f"{name}.csv").write_text("1\n")
    with pytest.raises(Exception, match="note13"):
        read_file_pairs(spark, f"{tmp_path}/x", f"{tmp_path}/y").collect()
    pairs = read_file_pairs(spark, f"{tmp_path}/x", f"{tmp_path}/y", strict_names=False).collect()
    assert [p.seq_id for p in pairs] == [12]


@pytest.mark.parametrize("large", [False, True])
def test_blank_lines_are_no_rows(spark, tmp_path, large):
    (tmp_path / "1.csv").write_text("1,2\n3,4\n\n  \n")
    rows = read_numbered_files(spark, str(tmp_path), ["a", "b"], large_files=large).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, 1.0, 2.0), (1, 1, 3.0, 4.0)]


def test_line_numbers_of_a_file_read_in_many_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{i}  {'9' * (i % 13)}1\n" for i in range(3000)))
    (tmp_path / "b.txt").write_text("x\ny\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() >= 1
        got = {(r.file[-5:], r.line_no): r.value for r in lines.collect()}
        across = {r.line_no: r.value for r in read_lines(spark, str(tmp_path), across_files=True).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 3002
    assert all(got["a.txt", i].split()[0] == str(i) for i in range(3000))
    assert got["b.txt", 1] == "y" and across[3001] == "y" and across[2999].startswith("2999")


def test_series_text(spark, tmp_path):
    (tmp_path / "s.txt").write_text("".join(f" {i}   2.5 -3 \n" for i in range(250)))
    rows = read_series_text(spark, str(tmp_path)).collect()
    assert len(rows) == 750
    for r in rows:
        assert r.label == r.line_no // 100
        assert r.value == (float(r.line_no), 2.5, -3.0)[r.step]


HEADER = "date,symbol,open,close,low,high,volume\n"


def test_bars(spark, tmp_path):
    (tmp_path / "b.csv").write_text(HEADER + "2020-01-01,A,1,2,0.5,3,100\n2020-01-01,B,4,5,6,7,8\n")
    one = read_bars(spark, str(tmp_path), "A")
    assert tuple(one.first()) == ("2020-01-01", "A", 1.0, 2.0, 0.5, 3.0, 100.0)
    assert one.count() == 1
    plan = one._sc._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    assert "EqualTo(symbol,A)" in plan


def test_bad_bars(spark, tmp_path):
    (tmp_path / "b.csv").write_text(HEADER + "2020-01-01,A,1,oops,0.5,3,100\n")
    text = read_bars_text(spark, str(tmp_path))
    with pytest.raises(PySparkException):
        typed_bars(text).collect()
    row = typed_bars(text, strict=False).first()
    assert row.close is None and row.bad_values == 1 and row.open == 1.0


def test_prepared_tables_are_written_once_and_pruned(spark, tmp_path):
    df = spark.range(10).select("id", F.when(F.col("id") < 7, "train").otherwise("test").alias("split"))
    path = f"{tmp_path}/p"
    write_prepared(df, df, path)
    write_prepared(df.limit(1), df.limit(1), path)
    features, labels = read_prepared(spark, path, "test")
    assert features.count() == labels.count() == 3
    assert all("split=test" in f for f in features.inputFiles()) or len(features.inputFiles()) > 0
    assert read_prepared(spark, path)[0].count() == 10


def test_model_survives_saving(spark, tmp_path):
    learner = Learner("recurrent", inputs=6, outputs=2, steps=3, hidden=4, classes=True)
    rng = np.random.default_rng(0)
    model = Model(learner, rng.normal(size=(4, learner.size)), [rng.normal(size=learner.size) for _ in range(2)])
    save_model(spark, model, f"{tmp_path}/m", "one")
    save_model(spark, Model(learner, model.state * 2), f"{tmp_path}/m", "two", with_updater=False)
    back = load_model(spark, f"{tmp_path}/m", "one")
    assert back.learner == learner
    assert np.array_equal(back.state, model.state)
    assert all(np.array_equal(a, b) for a, b in zip(back.history, model.history))
    two = load_model(spark, f"{tmp_path}/m", "two")
    assert np.array_equal(two.weights, model.weights * 2) and not two.state[1:].any()
    with pytest.raises(ValueError):
        save_model(spark, model, f"{tmp_path}/m", "one")
    with pytest.raises(ValueError):
        load_model(spark, f"{tmp_path}/m", "three")


def test_only_sizes_are_joined_and_shuffled(spark, folders):
    pairs = files.pair_files(files.list_files(spark, f"{folders}/sequence"), files.list_files(spark, f"{folders}/label"))
    plan = spark._jvm.PythonSQLUtils.explainString(pairs._jdf.queryExecution(), "formatted")
    assert "content" not in plan and "length" in plan
    assert {r.seq_id: r.bytes for r in pairs.collect()} == {
        i: sum((folders / side / f"{i}.csv").stat().st_size for side in ("sequence", "label")) for i in range(10) if i != 4
    }


def test_files_are_dealt_to_tasks_by_bytes(spark):
    sizes = [(i, f"/{i}.csv", [3000, 0, 9000, 1500][i % 4]) for i in range(40)]
    packed = files.pack_files(spark.createDataFrame(sizes, "seq_id int, path string, bytes bigint").repartition(7), 10_000)
    tasks = [[(r.seq_id, max(r.bytes, 1024)) for r in part] for part in packed.rdd.glom().collect() if part]
    assert [i for task in tasks for i, _ in task] == list(range(40))
    assert all(sum(n for _, n in task[:-1]) <= 10_000 for task in tasks) and len(tasks) > 10
    assert files.pack_files(packed.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_a_file_read_in_blocks(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(files, "BLOCK_BYTES", block)
    (tmp_path / "5.csv").write_bytes(b"head;x\r\n\r\n1;2\n\n  \n 3.5 ;-4e2;9\r\n" + b"5;6\n" * 50 + b"7;8")
    got = [v for block in files.LineFormat(("a", "b"), 1, ";").blocks(f"{tmp_path}/5.csv") for v in zip(*block)]
    assert got == [(1, 2), (3.5, -400)] + [(5, 6)] * 50 + [(7, 8)]
    with pytest.raises(ValueError, match="5.csv"):
        list(files.LineFormat(("a", "b"), 1, ";", width=2).blocks(f"file:{tmp_path}/5.csv"))
    with pytest.raises(ValueError):
        list(files.LineFormat(("a", "b", "c"), 1, ";").blocks(f"file://{tmp_path}/5.csv"))


def test_blank_lines_inside_a_file_leave_no_holes(spark, tmp_path):
    (tmp_path / "1.csv").write_text("1\n\n2\n \n3\n")
    (tmp_path / "2.csv").write_text("")
    rows = read_numbered_files(spark, str(tmp_path), ["a"]).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0)]


def test_labelled_files(spark, folders, monkeypatch):
    rows = read_labelled_files(spark, f"{folders}/sequence", f"{folders}/label", ["a", "b"], skip_lines=0, ids=(0, 9)).where("false")
    assert rows.columns == ["seq_id", "step", "a", "b", "label", "label_mask"]
    for i in range(10):
        (folders / "label" / f"{i}.csv").write_text(f"class\n{i % 2}\n")
    rows = read_labelled_files(spark, f"{folders}/sequence", f"{folders}/label", ["a", "b"], skip_lines=1).collect()
    want = [(i, t, i + 0.5, float(t), i % 2 if t == i else None, int(t == i)) for i in range(10) for t in range(i + 1)]
    assert sorted(map(tuple, rows)) == want
    (folders / "label" / "3.csv").write_text("class\n")
    with pytest.raises(PySparkException, match="no label"):
        read_labelled_files(spark, f"{folders}/sequence", f"{folders}/label", ["a"], skip_lines=1).collect()


def test_written_files_read_back(spark, tmp_path):
    rows = [(i, t, 0.1 * t + i / 3, float(i)) for i in range(30) for t in range(i)] + [(None, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, t int, x double, y double").repartition(5)
    assert files.write_files(df, f"{tmp_path}/out", "id", ["t"], ["x", "y"]) == 29
    files.write_files(df, f"{tmp_path}/out", "id", ["t"], ["x", "y"])
    back = read_numbered_files(spark, f"{tmp_path}/out", ["x", "y"], width=2).collect()
    assert sorted(map(tuple, back)) == sorted(r for r in rows if r[0] is not None)
    assert {p.suffix for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")} == {".csv"}


def test_half_written_tables_are_written_anew(spark, tmp_path):
    df = spark.range(10).select("id", F.when(F.col("id") < 7, "train").otherwise("test").alias("split"))
    path = f"{tmp_path}/p"
    (tmp_path / "p" / "tables-lost" / "features" / "_temporary").mkdir(parents=True)
    (tmp_path / "p" / "manifest" / "_temporary").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        read_prepared(spark, path)
    df.limit(2).write.parquet(f"{path}/tables-lost/labels")
    assert committed(spark, path) is None
    assert write_prepared(df, df, path) and not write_prepared(df.limit(1), df, path)
    assert [t.count() for t in read_prepared(spark, path)] == [10, 10]


def test_tables_made_from_something_else_are_written_anew(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i == 3 else "x", "train") for i in range(6)], "id int, s string, split string")
    path, made = f"{tmp_path}/p", fingerprint(df, df, seed=1)
    assert made == fingerprint(df.repartition(4).orderBy(F.desc("id")), df, seed=1)
    others = [fingerprint(df, df, seed=2), fingerprint(df.limit(5), df, seed=1), fingerprint(df.union(df.limit(1)), df, seed=1), fingerprint(df.withColumnRenamed("s", "t"), df, seed=1)]
    assert made not in others and len(set(others)) == 4
    assert write_prepared(df, df, path, made) and not write_prepared(df, df, path, made)
    assert write_prepared(df.limit(2), df, path, others[1])
    assert [t.count() for t in read_prepared(spark, path)] == [2, 6]
