import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.sources import files, sinks
from answerloom.streaming import streams as st


def test_decode(spark):
    rows = [(1, "第一段\n\n第二段".encode("gb18030")), (2, b"\xef\xbb\xbfabc"), (3, "é".encode()), (4, b"\xff\xff\xff"), (5, None)]
    got = {r.i: (r.text, r.encoding, r.decode_error) for r in files.decode_text(spark.createDataFrame(rows, "i int, bytes binary")).collect()}
    assert got == {1: ("第一段\n\n第二段", "gb18030", None), 2: ("abc", "utf-8-sig", None), 3: ("é", "utf-8", None), 4: (None, None, "DOCUMENT_ENCODING_UNSUPPORTED"), 5: (None, None, None)}


def test_read_cases(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"case_id":"a","question":"q"}\n{"case_id":"a","question":"r"}\n')
    with pytest.raises(ValueError):
        files.read_cases(spark, str(p), "case_id string, question string")


@pytest.mark.parametrize("raw, code", [('{"a":1}', None), ('{"a":1}}', "invalid_json"), ('{"a":1},{"a":2}', "invalid_json"), ("x", "invalid_json"), ("[1]", "schema_validation_failed"),
                                       ('{"a":1,"b":2}', "schema_validation_failed"), ('{"a":"t"}', "schema_validation_failed"), ("{}", "schema_validation_failed")])
def test_structured(spark, raw, code):
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert files.parse_structured(spark.createDataFrame([(raw,)], "raw string"), "raw", schema, ["a"]).first().error_code == code


@pytest.mark.parametrize("raw, code", [('{"a":{"b":1},"l":[{"c":"x"}]}', None), ('{"a":{"b":1,"z":2}}', "schema_validation_failed"), ('{"l":[{"c":"x"},{"d":1}]}', "schema_validation_failed"), ('{"a":null,"l":[]}', None)])
def test_unknown_nested_keys(spark, raw, code):
    schema = T.StructType([T.StructField("a", T.StructType([T.StructField("b", T.LongType())])), T.StructField("l", T.ArrayType(T.StructType([T.StructField("c", T.StringType())])))])
    assert files.parse_structured(spark.createDataFrame([(raw,)], "raw string"), "raw", schema).first().error_code == code


def test_empty_reparse_removes_rows(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = lambda *x: spark.createDataFrame(list(x), "version string, n int")
    sinks.replace_versions(rows(("a", 1), ("a", 2), ("b", 3), ("c", 4)), path, "version", buckets=3)
    sinks.replace_versions(rows(("a", 9)), path, "version", rows(("a", 0), ("b", 0)), buckets=3)
    assert sorted((r.version, r.n) for r in spark.read.parquet(path).collect()) == [("a", 9), ("c", 4)]


def test_publish_reuses_complete_generation(spark, tmp_path):
    df = spark.range(3)
    assert sinks.publish_generation(df, str(tmp_path), "g1") and not sinks.publish_generation(df, str(tmp_path), "g1")
    sinks.publish_generation(spark.range(5), str(tmp_path), "g2")
    assert sinks.read_generation(spark, str(tmp_path)).count() == 5


def test_stream_resumes_without_doubling(spark, tmp_path):
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    turn = lambda t, k: spark.createDataFrame([(1, t, False, [k], [k])], "conv_id long, turn long, reset boolean, topic_keys array<string>, entity_values array<string>")
    for i, (t, k) in enumerate([(1, "a"), (2, "b"), (1, "old")]):
        turn(t, k).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
        st.topic_state_stream(stream, out, ck)
    row = st.newest_view(spark, out, "conv_id").first()
    assert row.context_version == 2 and row.topics[0] == "b"


def test_late_turns_count_as_in_order(spark, tmp_path):
    schema = "conv_id long, turn long, reset boolean, topic_keys array<string>, entity_values array<string>"
    rows = [(1, 2, False, ["b"], ["y"]), (1, 1, False, ["a"], ["x"]), (1, 4, False, ["c", "a"], ["x"]), (1, 3, True, ["d"], [])]
    want = [r for r in st.topic_view(spark.createDataFrame(rows, schema)).collect()]
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(src)
        st.topic_state_stream(spark.readStream.schema(schema).parquet(src), out, ck)
    got = st.newest_view(spark, out, "conv_id").collect()
    assert got == want and got[0].topics == ["a", "c", "d"] and got[0].confirmed == ["x", "y"] and got[0].context_version == 4


def test_history_starts_anew_after_silence(spark):
    rows = [(1, f"2024-01-01 00:{m:02d}:00", m, f"m{m}") for m in (0, 10, 26, 30, 45)] + [(2, "2024-01-01 00:00:00", 0, "x")]
    df = spark.createDataFrame(rows, "conv_id long, ts string, turn long, text string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.conv_id: r.messages for r in st.history_view(df, limit=2).collect()}
    assert got == {1: ["m30", "m45"], 2: ["x"]}
    assert {r.conv_id: r.messages for r in st.history_view(df).collect()}[1] == ["m26", "m30", "m45"]


def test_dedupe_stream_across_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for rows in ([("d", "h1"), ("d", "h1"), ("e", "h1")], [("d", "h1"), ("d", "h2")], [("d", "h2")]):
        df = spark.createDataFrame(rows, "document_id string, sha256 string")
        df.coalesce(1).write.mode("append").parquet(src)
        st.dedupe_stream(spark.readStream.schema(df.schema).parquet(src), out, ck)
    assert sorted((r.document_id, r.sha256) for r in spark.read.parquet(out).collect()) == [("d", "h1"), ("d", "h2"), ("e", "h1")]


def test_incremental_index(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.md").write_text("# T\n第一句。", encoding="utf-8")
    (land / "b.txt").write_bytes("甲。\n\n乙。".encode("gb18030"))
    (land / "c.exe").write_bytes(b"x")
    st.incremental_index(spark, str(land), str(tmp_path / "out"), str(tmp_path / "ck"))
    chunks = st.indexed_chunks(spark, str(tmp_path / "out"))
    assert sorted(r.content for r in chunks.where("kind = 'child'").collect()) == ["T：第一句。", "乙。", "甲。"]
    bad = spark.read.parquet(str(tmp_path / "out" / "progress")).where(F.col("error_code").isNotNull()).collect()
    assert [r.filename for r in bad] == ["c.exe"]


def test_incremental_index_decodes_a_batch_once(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    for i in range(3):
        (land / f"{i}.txt").write_text(f"one {i}.\n\ntwo {i}.", encoding="utf-8")
    (land / "c.exe").write_bytes(b"x")
    for many in (1, 1000):
        out = str(tmp_path / f"out{many}")
        st.incremental_index(spark, str(land), out, str(tmp_path / f"ck{many}"), many)
        staged = spark.read.parquet(f"{out}/staged")
        assert staged.count() == min(many, 4) and "content" not in staged.columns and "bytes" not in staged.columns
        assert st.indexed_chunks(spark, out).where("kind = 'child'").count() == 6
        rows = spark.read.parquet(f"{out}/progress")
        assert sorted((r.filename, r.total, r.error_code) for r in rows.collect()) == [
            ("0.txt", 2, None), ("1.txt", 2, None), ("2.txt", 2, None), ("c.exe", 0, "UNSUPPORTED_DOCUMENT_TYPE")]


def test_files_are_rejected_before_they_are_read(spark, tmp_path):
    for name, body in {"a/x.MD": b"# t", "a/b/y.pdf": b"%PDF-1", "z.docx": b"no zip", "empty.txt": b"", "big.txt": b"x" * 101, "q.exe": b"MZ", "noext": b"n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    df = files.read_files(spark, str(tmp_path), max_bytes=100)
    got = {r.filename: (r.error_code, r.signature_ok, r.bytes is not None, r.size) for r in df.collect()}
    assert got == {"x.MD": (None, None, True, 3), "y.pdf": (None, True, True, 6), "z.docx": (None, False, True, 6),
                   "big.txt": ("FILE_TOO_LARGE", None, False, 101), "q.exe": ("UNSUPPORTED_DOCUMENT_TYPE", None, False, 2), "noext": ("UNSUPPORTED_DOCUMENT_TYPE", None, False, 1)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,100)" in plan
