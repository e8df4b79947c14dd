"""Session epochs, the streamed index, published versions, the bucketed log
and the landing data source."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lectern.operators import sessionlog as SL
from lectern.operators import sessions as S
from lectern.operators.aggregates import running_sums
from lectern.runtime import scratch_path
from lectern.sources import files as FS
from lectern.sources import landing as LD
from lectern.sources import versions as V
from lectern.streaming import ingest as ST

MESSAGES = "conv_id long, turn long, text string"


def _brute(rows):
    out, state = [], {}
    for conv, turn, text in sorted(r for r in rows if r[0] is not None):
        epoch, n = state.get(conv, (0, 0))
        low = (text or "").lower()
        if "@resetear_sesion" in low:
            out.append((conv, turn, "reset", epoch, None))
            state[conv] = (epoch + 1, 0)
        elif "@ver_historial" in low:
            out.append((conv, turn, "history", epoch, None))
        else:
            out.append((conv, turn, "agent" if "usa el agente para" in low else "retrieve", epoch, n + 1))
            state[conv] = (epoch, n + 1)
    return out


def _messages(n=400):
    texts = ["hola", "@Resetear_Sesion ya", "@ver_historial", "Usa el agente para x", "otra", ""]
    rows = [(1, t, texts[(t * t + 3 * t) % 6]) for t in range(n)]
    rows += [(c, t, texts[(c * 7 + t * 5) % 6]) for c in range(2, 12) for t in range(c)]
    return rows + [(50, 0, "@resetear_sesion"), (50, 1, "@resetear_sesion"), (50, 2, "x"), (51, 5, "solo")]


def _rows(df):
    return sorted(map(tuple, df.select("conv_id", "turn", "route", "epoch", "turn_no").collect()))


def test_session_epochs_equal_brute_force(spark):
    rows = _messages()
    df = spark.createDataFrame([*rows, (None, 1, "nobody")], MESSAGES).repartition(7)
    assert _rows(S.session_epochs(df)) == _brute(rows)
    assert S.session_epochs(df.limit(0)).collect() == []


def test_stream_epochs_over_batches_and_a_replayed_one(spark):
    rows = _messages(60)
    landing, sink, ckpt = (scratch_path(spark, n) for n in ("t_landing", "t_sink", "t_ckpt"))
    for lo, hi in ((0, 2), (2, 7), (7, 99)):
        part = [r for r in rows if lo <= r[1] < hi]
        spark.createDataFrame(part, MESSAGES).coalesce(1).write.mode("append").parquet(landing)
        if lo:  # the stream stops between the batches and goes on
            schema = spark.read.parquet(landing).schema
            ST.stream_session_epochs(spark, landing, schema, sink, ckpt, max_files=1)
    ST.stream_session_epochs(spark, landing, schema, sink, ckpt, max_files=1)  # nothing new
    assert _rows(spark.read.parquet(f"{sink}/batch_id=*")) == _brute(rows)
    batch = spark.read.parquet(f"{sink}/batch_id=1")
    again = batch.collect()
    ST.write_log_batch(spark.createDataFrame(again, batch.schema), sink, 1)
    assert _rows(spark.read.parquet(f"{sink}/batch_id=*")) == _brute(rows)


def test_running_sums_spread_one_group(spark):
    df = spark.range(3000).select(F.lit("g").alias("g"), (F.lit(3000) - F.col("id")).alias("o"), (F.col("id") % 3).alias("x"))
    got = running_sums(df, ["g"], ["o"], {"s": "x"}).orderBy("o").collect()
    total, want = 0, []
    for o in range(1, 3001):
        total += (3000 - o) % 3
        want.append(total)
    assert [r["s"] for r in got] == want


def test_stream_index_holds_each_chunk_once(spark):
    page = "<title>t</title>" + "palabra " * 200
    pages = [(1, "u/1", page), (2, "u/2", page), (3, "u/3", "<p>corto</p>"), (4, "u/4", "")]
    landing, index, ckpt = (scratch_path(spark, n) for n in ("t_pages", "t_index", "t_index_ckpt"))
    schema = "page_id long, url string, html string"
    embed = lambda df, text, out: df.withColumn(out, F.array(F.length(text).cast("double")))
    for part in (pages[:2], pages[1:], pages):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landing)
        ST.stream_index(spark, landing, spark.read.parquet(landing).schema, index, ckpt, embed, max_files=1)
    got = spark.read.parquet(f"{index}/batch_id=*").collect()
    texts = [r["page_content"] for r in got]
    assert len(texts) == len(set(texts)) and all(r["embedding"] == [float(len(r["page_content"]))] for r in got)
    assert {t.rsplit("\nURL: ", 1)[1] for t in texts} == {"u/1", "u/2", "u/3"}


def test_versions_publish_read_and_refuse(spark):
    root = scratch_path(spark, "t_versions")
    df = spark.range(5)
    assert V.current(spark, root) == 0
    with pytest.raises(FileNotFoundError):
        V.load(spark, root)
    assert V.save(df, root, expected=0) == 1
    assert V.save(df.where("id > 1"), root, expected=1) == 2
    with pytest.raises(V.VersionConflict):  # started from an older version
        V.save(df, root, expected=1)
    spark.range(1).write.parquet(V.new_data_path(root))  # half-written: no manifest
    with open(f"{root}/versions/3.json", "w"):  # a manifest being written
        pass
    assert V.current(spark, root) == 2
    assert V.load(spark, root).count() == 3 and V.load(spark, root, 1).count() == 5
    with pytest.raises(FileNotFoundError):
        V.load(spark, root, 9)
    path = V.new_data_path(root)
    df.write.parquet(path)
    with pytest.raises(V.VersionConflict):  # another writer has begun the same one
        V.publish(spark, root, path, expected=2)


def test_one_session_reads_one_bucket(spark):
    root = scratch_path(spark, "t_log")
    schema = "session_id string, seq long, prompt string"
    rows = [(f"s{i % 30}", i, f"p {i}") for i in range(300)] + [("", 1, "empty id"), ("ü", 1, None)]
    for lo in range(0, 302, 60):
        SL.append(spark.createDataFrame(rows[lo : lo + 60], schema), root, buckets=8)
    assert sorted(map(tuple, SL.read(spark, root).select("session_id", "seq", "prompt").collect()), key=repr) == sorted(rows, key=repr)
    one = SL.one_session(spark, root, "s7", buckets=8)
    assert [tuple(r) for r in one.select("session_id", "seq", "prompt").collect()] == [r for r in rows if r[0] == "s7"]
    # the scan lists the one bucket's folder: its filter is on the partition column
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    read = SL.one_session(spark, root, "s7", buckets=8).select(F.input_file_name().alias("f"))
    assert len({os.path.dirname(r["f"]) for r in read.collect()}) == 1
    before = len(SL.files(spark, root))
    assert SL.compact(spark, root, buckets=8) == 2
    assert len(SL.files(spark, root)) <= 8 < before
    SL.append(spark.createDataFrame([("s7", 999, "late")], schema), root, buckets=8)
    assert [r["seq"] for r in SL.one_session(spark, root, "s7", buckets=8).collect()][-1] == 999
    assert SL.read(spark, root).count() == 303


def test_a_compaction_that_raced_with_an_append_raises(spark, monkeypatch):
    root = scratch_path(spark, "t_race")
    one = spark.createDataFrame([("a", 1, "x")], "session_id string, seq long, prompt string")
    SL.append(one, root, buckets=2)
    seen = iter([["before"], ["after"]])
    monkeypatch.setattr(SL, "files", lambda *a: next(seen))
    with pytest.raises(V.VersionConflict):
        SL.compact(spark, root, buckets=2)
    assert V.current(spark, root) == 1


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_byte_ranges_give_each_line_once(tmp_path, size):
    lines = [json.dumps({"page_id": i, "html": "x" * (i * 13 % 50) + "é"}) for i in range(40)]
    (tmp_path / "a.json").write_text("\n".join(lines) + "\n\n")
    (tmp_path / "b.json").write_text(lines[0])  # no line end
    (tmp_path / "_hidden").write_text("not json")
    (tmp_path / "empty.json").write_text("")
    parts = LD.ranges(LD.landed(str(tmp_path)), str(tmp_path), size)
    got = [json.loads(line)["page_id"] for p in parts for line in LD.lines_of(p)]
    assert sorted(got) == sorted([*range(40), 0])


def test_landing_source_in_batch_and_over_a_restart(spark):
    LD.register(spark)
    folder, sink, ckpt = (scratch_path(spark, n) for n in ("t_land", "t_land_sink", "t_land_ckpt"))
    for lo in (0, 100):
        rows = spark.range(lo, lo + 100).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("html"))
        rows.coalesce(2).write.mode("append").json(folder)
        stream = spark.readStream.format("landing").option("path", folder).option("rangeBytes", 500).load()
        query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
        query.trigger(availableNow=True).start().awaitTermination()
    df = spark.read.format("landing").option("path", folder).option("rangeBytes", 500).load()
    assert df.rdd.getNumPartitions() > 4
    want = [(i, "u", None) for i in range(200)]
    assert sorted(map(tuple, df.collect())) == want
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == want
    empty = scratch_path(spark, "t_land_empty")
    os.makedirs(empty)
    assert spark.read.format("landing").option("path", empty).load().collect() == []


def test_json_array_files_and_the_probe(spark):
    path = scratch_path(spark, "t_array")
    df = spark.createDataFrame([(i, f'a "{i}"\n', None) for i in range(50)], "id int, t string, n string")
    FS.write_json_array(df.repartition(3), path, "id")
    files = sorted(f for f in os.listdir(path) if f.endswith(".txt"))
    read = [r for f in files if os.path.getsize(f"{path}/{f}") for r in json.load(open(f"{path}/{f}", encoding="utf-8"))]
    assert [r["id"] for r in read] == list(range(50)) and read[3] == {"id": 3, "t": 'a "3"\n', "n": None}
    back = FS.read_json_records(spark, path, df.schema, array_file=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    log = scratch_path(spark, "t_probe")
    S.append_log(spark.createDataFrame([("a", 1, "x")], "session_id string, seq long, prompt string"), log)
    assert S.probe(S.read_log(spark, log)) and not S.probe(S.read_log(spark, log).limit(0))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.probe(S.read_log(spark, log + "-missing"))
