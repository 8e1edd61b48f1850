import pytest

from postloom.operators import store
from postloom.sources import tables as tb
from postloom.storage import cut, fits_broadcast
from tests.conftest import rows


def test_upsert_is_idempotent_and_new_rows_win(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    once = store.upsert(old, new, ["k"])
    assert rows(once) == [(1, "a"), (2, "B"), (3, "c")]
    assert rows(store.upsert(once, new, ["k"])) == rows(once)
    assert rows(store.upsert(old.limit(0), new.limit(0), ["k"])) == []


def test_insert_new_keeps_first_of_a_key_and_nulls_never_conflict(spark):
    old = spark.createDataFrame([(1, "x")], "id int, h string")
    new = spark.createDataFrame([(5, "y"), (4, "y"), (6, "x"), (7, None), (8, None)], "id int, h string")
    assert rows(store.insert_new(old, new, "h", "id")) == [(4, "y"), (7, None), (8, None)]


def test_update_replace_next_missing(spark):
    t = spark.createDataFrame([("s", 1, None), ("s", 2, "b"), ("u", 3, "c")], "g string, k int, v string")
    ch = spark.createDataFrame([(1, "z"), (1, "y"), (3, None)], "k int, v string")
    assert rows(store.update_column(t, ch, ["k"], "v")) == [("s", 1, "y"), ("s", 2, "b"), ("u", 3, "c")]
    assert rows(store.replace_slice(t, spark.createDataFrame([("s", 9, "n")], t.schema), "g")) == [("s", 9, "n"), ("u", 3, "c")]
    assert store.next_id(t, "k").first()[0] == 3 and store.next_id(t.limit(0), "k").first()[0] == 1
    assert rows(store.missing_rows(t.select("k"), ch, "k", "k")) == [(2,)]


def test_snapshots_swap_and_check_keys(spark, tmp_path):
    s = store.Snapshots(spark, f"file://{tmp_path}")
    s.write("t", spark.range(3), ["id"])
    s.write("t", spark.range(5), ["id"])
    assert s.read("t").count() == 5
    with pytest.raises(ValueError):
        s.write("t", spark.range(2).union(spark.range(2)), ["id"])
    assert s.read("t").count() == 5


def test_csv_terms_keys_and_dimension(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,source,text,hash,created_at,updated_at,section,text_clean\n1,s,"a ""q"",\nb",h,2024-01-01 00:00:00,,,x\n', encoding="utf-8")
    got = tb.read_posts_csv(spark, str(tmp_path / "a.csv")).collect()
    assert len(got) == 1 and got[0]["text"] == 'a "q",\nb' and got[0]["section"] is None
    (tmp_path / "t.txt").write_text("# note\n\n one \ntwo\n", encoding="utf-8")
    assert rows(tb.read_terms(spark, str(tmp_path / "t.txt"))) == [("one",), ("two",)]
    bad = tb.check_keys(spark.createDataFrame([(1,), (1,), (None,)], "k int"), ["k"])
    assert rows(bad) == [(1, 2), (None, 1)]
    v = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<float>")
    assert tb.check_dimension(v, "v", 2).count() == 2
    with pytest.raises(Exception, match="not 3 values"):
        tb.check_dimension(v, "v", 3).collect()


def test_cut_and_size_check(spark):
    assert cut(spark.range(4)).count() == 4
    assert fits_broadcast(spark.range(4), 4) and not fits_broadcast(spark.range(5), 4)
    assert "LocalTableScan" not in cut(spark.range(4))._jdf.queryExecution().toString() and "parquet" in cut(spark.range(4))._jdf.queryExecution().toString().lower()


def test_release_deletes_what_was_cut(spark):
    from postloom import storage

    storage.release(spark)
    df = storage.cut(spark.range(5), "t")
    assert df.count() == 5 and storage.release(spark) == 1 and storage.release(spark) == 0
