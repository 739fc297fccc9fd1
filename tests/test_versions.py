"""Tables that a pointer replaces, aggregates that carry on, fingerprints made in tasks."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import tables, versions
from sparkloom.streaming import carried


def ids(df) -> list[int]:
    return sorted(r["id"] for r in df.collect())


def test_replace_and_restore(spark, tmp_path):
    base = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.current(spark, base)
    first = versions.replace(spark.range(5), base, notes={"by": "me"})
    assert (first.number, first.rows, first.notes) == (1, 5, {"by": "me"})
    versions.replace(versions.current(spark, base).filter("id > 2"), base)  # reads what it replaces
    assert ids(versions.current(spark, base)) == [3, 4] and ids(versions.current(spark, base, 1)) == [0, 1, 2, 3, 4]
    assert versions.restore(spark, base, 1).number == 3 and ids(versions.current(spark, base)) == [0, 1, 2, 3, 4]
    with pytest.raises(FileNotFoundError):
        versions.restore(spark, base, 9)
    with pytest.raises(OSError):
        versions.replace(spark.range(7), base, expect=8)
    assert versions.current(spark, base).count() == 5 and versions.replace(spark.range(7), base, expect=7).rows == 7


def test_a_failure_between_the_writes_leaves_the_old_table(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "t")
    versions.replace(spark.range(5), base)
    reader = versions.current(spark, base)

    def broken(*_):
        assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("version-")]) == 2  # the new files are there
        assert ids(versions.current(spark, base)) == ids(reader) == [0, 1, 2, 3, 4]
        raise OSError("the writer died")

    with monkeypatch.context() as m:
        m.setattr(versions, "_point", broken)
        with pytest.raises(OSError):
            versions.replace(spark.range(50), base)
    assert ids(versions.current(spark, base)) == [0, 1, 2, 3, 4] and len(versions.versions(spark, base)) == 1
    with pytest.raises(Exception):
        versions.replace(spark.range(5).select(F.raise_error(F.lit("bad row")).alias("id")), base)
    assert ids(versions.current(spark, base)) == [0, 1, 2, 3, 4]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("version-")]) == 1


def test_pointers_that_were_cut_off_are_passed_over(spark, tmp_path):
    base = str(tmp_path / "t")
    versions.replace(spark.range(3), base)
    (tmp_path / "t" / "_pointers" / f"{2:012d}").write_text('{"folder": "version-')
    assert ids(versions.current(spark, base)) == [0, 1, 2]
    assert versions.replace(spark.range(4), base).number == 3 and versions.current(spark, base).count() == 4


def test_two_writers_do_not_share_a_number(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "t")
    versions.replace(spark.range(3), base)
    monkeypatch.setattr(versions, "_numbers", lambda *_: [])
    with pytest.raises(Exception):
        versions.replace(spark.range(4), base)
    monkeypatch.undo()
    assert ids(versions.current(spark, base)) == [0, 1, 2]


def test_old_versions_go(spark, tmp_path):
    base = str(tmp_path / "t")
    for n in range(1, 6):
        versions.replace(spark.range(n), base, keep=2)
    assert [v.number for v in versions.versions(spark, base)] == [4, 5]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("version-")]) == 2


ROWS = [("a", 1.0), ("a", None), ("b", 2.0), (None, 3.0), ("a", 5.0), ("c", None)]


def carried_rows(spark, base) -> dict:
    return {r["k"]: (r["n"], r["n_values"], r["total"]) for r in versions.current(spark, base).collect()}


def test_a_restart_in_the_middle_gives_the_same_table(spark, tmp_path, monkeypatch):
    for i, row in enumerate(ROWS):
        spark.createDataFrame([row], "k string, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    base, calls = str(tmp_path / "out"), []
    replace = versions.replace

    def dies_after_the_third(*args, **more):
        made = replace(*args, **more)
        calls.append(made.notes["batch"])
        if len(calls) == 3:
            raise OSError("lost before the batch was committed")
        return made

    def run():
        stream = spark.readStream.schema("k string, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        carried.carry_on(stream, base, "k", "v", str(tmp_path / "checkpoint")).awaitTermination()

    with monkeypatch.context() as m:
        m.setattr(versions, "replace", dies_after_the_third)
        with pytest.raises(Exception):
            run()
        assert calls == [0, 1, 2] and sum(n for n, _, _ in carried_rows(spark, base).values()) == 3
    run()
    want = {"a": (3, 2, 6.0), "b": (1, 1, 2.0), None: (1, 1, 3.0), "c": (1, 0, None)}
    assert carried_rows(spark, base) == want
    run()  # nothing new
    assert carried_rows(spark, base) == want and versions.current_version(spark, base).notes == {"batch": 5}
    found = {r["k"]: r["mean_rating"] for r in carried.means(versions.current(spark, base), "k").collect()}
    assert found == {"a": 3.0, "b": 2.0, None: 3.0, "c": None}


def test_fingerprints_are_made_in_tasks(spark, tmp_path, monkeypatch):
    files = {"x/a.csv": b"abc", "x/y/b.bin": bytes(range(256)) * 40, "x/_SUCCESS": b"", "x/_h/c": b"hidden", "x/long.txt": b"z" * 5_000, "x/empty": b""}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(tables, "WHOLE_FILE", 4_000)
    df = tables.fingerprint(spark, str(tmp_path / "x"))
    assert "binaryfile" in df._jdf.queryExecution().executedPlan().toString().lower()
    got = {r["path"].split("/x/")[1]: (r["length"], r["sha256"]) for r in df.collect()}
    assert got == {n[2:]: (len(d), hashlib.sha256(d).hexdigest()) for n, d in files.items()}
