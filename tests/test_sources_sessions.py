"""File sinks and scans, sessions, routing, tool calls, feedback, JSON."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import jsonfn as J
from lectern.operators import aggregates as A
from lectern.operators import sessions as S
from lectern.runtime import scratch_path
from lectern.sources import files as FS


def test_pipe_csv_roundtrip_edge_rows(spark):
    rows = [
        ("u|1", "t\"q\"", "", "a|b\nline2 \\ back"),
        ("u2", None, "", "  lead and trail  "),
    ]
    df = spark.createDataFrame(rows, FS.NOTICE_SCHEMA)
    path = scratch_path(spark, "csv_test")
    FS.write_pipe_csv(df, path, mode="errorifexists")
    FS.write_pipe_csv(df, path, mode="append")  # a second file with the same rows
    back = FS.read_pipe_csv(spark, path)
    got = sorted(tuple(r) for r in back.collect())
    # an empty field reads back as NULL, as the pandas reader gives NaN
    expected = [tuple(None if v == "" else v for v in r) for r in rows]
    assert got == sorted(expected * 2)


def test_pipe_csv_index_column_and_header_only(spark, tmp_path):
    p = tmp_path / "d_20240101.csv"
    p.write_text('|url|titulo|texto|resumen\n0|u|"a ""b"""||"x\nURL: u"\n', encoding="utf-8")
    (tmp_path / "e_20240102.csv").write_text("|url|titulo|texto|resumen\n", encoding="utf-8")
    back = FS.read_pipe_csv(spark, str(tmp_path), index_column=True).collect()
    assert [tuple(r) for r in back] == [("u", 'a "b"', None, "x\nURL: u")]


def test_landed_files_read_whole(spark):
    from lectern.sources import pages as P

    rows = [(1, "<html>\n<p>a</p>\n</html>"), (2, "line one\nline two"), (3, "x")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    path = scratch_path(spark, "landing_test")
    P.land_files(df, path, "page_id", "html")
    back = P.scan_files(spark, path)
    got = sorted((int(r["page_id"]), r["html"][:-1]) for r in back.collect())  # writer adds one newline
    assert got == rows
    assert all(r["url"].endswith(".txt") for r in back.collect())


def test_missing_csv_gives_empty_table(spark, tmp_path):
    df = FS.read_pipe_csv(spark, str(tmp_path / "none" / "*.csv"))
    assert df.count() == 0 and df.columns == ["url", "titulo", "texto", "resumen"]


def test_missing_paths_leave_the_others_and_repeats_count(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(f"url|titulo|texto|resumen\n{name}|t||r\n", encoding="utf-8")
    good, other = str(tmp_path / "a.csv"), str(tmp_path / "b.csv")
    rows = FS.read_pipe_csv(spark, [good, str(tmp_path / "missing.csv"), other, good]).collect()
    assert sorted(r["url"] for r in rows) == ["a", "a", "b"]


def test_json_array_metadata_file(spark, tmp_path):
    recs = [{"url": "https://x.example/a|b", "title": "Administración", "text_resume": "ñ"}] * 2
    (tmp_path / "metadata.json").write_text(json.dumps(recs, ensure_ascii=False), encoding="utf-8")
    back = FS.read_json_records(spark, str(tmp_path / "metadata.json"), array_file=True).collect()
    assert [r.asDict() for r in back] == recs


def test_vector_versions(spark):
    df = spark.createDataFrame([(1, [0.5, 1.5])], "chunk_id long, embedding array<float>")
    root = scratch_path(spark, "vec_test")
    p1 = FS.save_vectors(df, root, "1")
    with pytest.raises(Exception):
        FS.save_vectors(df, root, "1")  # never overwritten in place
    assert FS.load_vectors(spark, p1).first()["embedding"] == [0.5, 1.5]
    with pytest.raises(Exception):
        FS.load_vectors(spark, os.path.join(root, "v=missing")).collect()


def test_union_and_documents(spark):
    a = spark.createDataFrame([(1, "x", "s")], "id int, text string, source string")
    b = spark.createDataFrame([(2, "y")], "id int, text string")
    u = FS.union_all([a, b]).orderBy("id").collect()
    assert [(r["id"], r["source"]) for r in u] == [(1, "s"), (2, None)]
    docs = FS.to_documents(a, "text", ["source"]).first()
    assert docs["page_content"] == "x" and docs["metadata"] == {"source": "s"}
    assert FS.to_documents(a, "text").first()["metadata"] == {}


def test_routing_first_match_wins(spark):
    msgs = ["@RESETEAR_SESION y @ver_historial", "ver @Ver_Historial", "Usa el agente para X", "hola", "\n  hola  "]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(msgs)], "seq int, text string")
    out = S.route_messages(df).orderBy("seq").collect()
    assert [r["route"] for r in out] == ["reset", "history", "agent", "retrieve", "retrieve"]
    assert out[4]["clean_text"] == "hola"
    assert [r["seq"] for r in S.loggable(S.route_messages(df)).collect()] == [2, 3, 4]


def test_session_history_two_levels(spark):
    rows = [("s'1", i, f"p{i}") for i in range(10)] + [("s2", 0, "only")]
    log = spark.createDataFrame(rows, "session_id string, seq long, prompt string")
    hist = {r["session_id"]: r for r in S.session_history(log, bucket_width=3).collect()}
    assert hist["s'1"]["history"] == "\n".join(f"p{i}" for i in range(10))
    assert hist["s'1"]["n_prompts"] == 10 and hist["s2"]["history"] == "only"
    one = S.session_messages(log, "s'1").count()
    assert one == 10 and S.session_messages(log, "unknown").count() == 0


def test_ordered_concat_null_group(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (2, 1, "a")], "g int, o int, v string")
    for width in (None, 1):
        out = {r["g"]: r["s"] for r in A.ordered_concat(df, ["g"], "o", "v", ",", "s", bucket_width=width).collect()}
        assert out == {1: None, 2: "a"}


def test_tool_call_parsing(spark):
    rows = [
        'Thought: t\nAction: ObtenerTexto["http://x/a.pdf"]',
        'Action: Finish["El texto"]',
        'Action: Desconocida["a"]',
        'Action: Buscar["a", "b"]',
        'Action: Buscar["a")',
        "Observation: nada",
        'Action: A["x\ry"]',
        'Action: A["x\u2028y\x85"]',
        "first\nAction: A[x][z] \n \n",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "step int, text string")
    out = S.tool_calls(df).orderBy("step").collect()
    assert [(r["tool"], r["tool_input"], r["finished"]) for r in out] == [
        ("ObtenerTexto", '"http://x/a.pdf"', False),
        ("Finish", '"El texto"', True),
        ("Desconocida", '"a"', False),
        ("Buscar", '"a", "b"', False),
        (None, None, False),
        (None, None, False),
        ("A", '"x\ry"', False),
        ("A", '"x\u2028y\x85"', False),
        ("A", "x", False),
    ]
    registry = spark.createDataFrame([("ObtenerTexto",), ("Buscar",)], "name string")
    unknown = [r["tool"] for r in S.unknown_tools(S.tool_calls(df), registry).collect()]
    assert sorted(unknown) == ["A", "A", "A", "Desconocida"]


def test_feedback_flags(spark):
    df = spark.createDataFrame([("Incorrecto",), ("Ofensivo",), ("otro",), (None,)], "flag string")
    out = {r["flag"]: r["valid"] for r in S.check_feedback(df).collect()}
    assert out == {"Incorrecto": True, "Ofensivo": True, "otro": False, None: False}


def test_session_tokens_shape(spark):
    df = spark.createDataFrame([(i,) for i in range(20)], "s int")
    toks = [r["token"] for r in S.session_tokens(df, "s", 7).collect()]
    assert len(toks) == 20 and all(len(t) == 32 and t.isalnum() and t.isascii() for t in toks)


def test_session_tokens_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "s int")
    runs = [dict(map(tuple, S.session_tokens(df.repartition(n), "s", 7).collect())) for n in (2, 5)]
    assert runs[0] == runs[1] and len(set(runs[0].values())) == 50


def test_feedback_is_stored_with_its_text(spark):
    rows = [("s", 1, "a\nb", "Ofensivo"), ("s", 2, "c", "otro"), ("s", 3, None, None)]
    path = scratch_path(spark, "feedback_test")
    S.store_feedback(spark.createDataFrame(rows, "session_id string, idx int, text string, flag string"), path)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == rows[:1]


def test_a_replayed_log_batch_leaves_no_duplicate(spark):
    from lectern.streaming.ingest import write_log_batch

    path = scratch_path(spark, "log_test")
    rows = spark.createDataFrame([("s", 1, "p", "agent")], "session_id string, seq int, prompt string, route string")
    for batch in (0, 1, 1, 0):
        write_log_batch(rows, path, batch)
    assert spark.read.parquet(path).count() == 2


def test_turns_are_numbered_by_time_then_sequence(spark):
    log = spark.createDataFrame([("a", 5, 1), ("a", 4, 9), ("a", 5, 0), ("b", 1, 1)], "s string, ts int, seq int")
    out = {(r["s"], r["ts"], r["seq"]): r["turn_no"] for r in S.number_turns(log, "s", "ts", "seq").collect()}
    assert out == {("a", 4, 9): 1, ("a", 5, 0): 2, ("a", 5, 1): 3, ("b", 1, 1): 1}


def test_a_cluster_without_a_shared_folder_is_refused():
    from lectern.runtime import ensure_checkpoint_dir

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_forecast_noon_entry(spark):
    payload = {
        "list": [
            {"dt_txt": "2024-05-02 09:00:00", "main": {"temp": 10.0}, "weather": [{"description": "nubes"}]},
            {"dt_txt": "2024-05-02 12:00:00", "main": {"temp": 15.5}, "weather": [{"description": "sol"}]},
        ]
    }
    rows = [(1, json.dumps(payload)), (2, json.dumps({"list": payload["list"][:1]})), (3, "{bad")]
    df = spark.createDataFrame(rows, "id int, body string")
    schema = "list array<struct<dt_txt string, main struct<temp double>, weather array<struct<description string>>>>"
    parsed = df.select("id", J.parse("body", schema).alias("j"))
    noon = parsed.select("id", J.first_where("j.list", lambda x: x["dt_txt"] == "2024-05-02 12:00:00").alias("n"))
    out = {r["id"]: r["n"] for r in noon.collect()}
    assert out[1]["main"]["temp"] == 15.5 and out[1]["weather"][0]["description"] == "sol"
    assert out[2] is None and out[3] is None
