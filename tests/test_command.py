"""The command line, and the generated log with its known segments and survivors."""

import runpy

import pytest
from pyspark.sql import functions as F

from tidelog.__main__ import main
from tidelog.operators import compaction


def test_commands(spark, tmp_path):
    root = str(tmp_path)
    made = main(["generate", root, "demo", "24", "700"], spark)
    assert [(r["segment_base"], r["n_batches"]) for r in made.collect()] == [(0, 7), (7, 7), (14, 7), (21, 3)]
    main(["create", root, "empty", "2"], spark)
    assert [tuple(r) for r in main(["describe", root], spark).collect()] == [("demo", 0, 0, 24, 24)]
    got = main(["consume", root, "demo", "0", "21"], spark).collect()
    assert [(r["log_offset"], r["rec_key"]) for r in got] == [(21, "user1"), (22, "user2"), (23, "user3")]
    assert main(["consume", root, "demo", "0", "latest"], spark).count() == 0
    assert [(r["segment_base"], r["n_records"], r["n_holes"]) for r in main(["dump", root], spark).collect()] == [(0, 7, 0), (7, 7, 0), (14, 7, 0), (21, 3, 0)]
    (tmp_path / "lines.txt").write_text("one\n\ntwo\n")
    for k in range(2):
        assert tuple(main(["produce", root, "empty", "1", f"{tmp_path}/lines.txt"], spark).first()) == (3, 3 * k, 3 * k + 2)
    got = main(["consume", root, "empty", "1"], spark).collect()
    assert [(r["log_offset"], r["rec_key"], r["rec_value"]) for r in got] == [(k, "null", v) for k, v in enumerate(["one", "", "two"] * 2)]
    with pytest.raises(SystemExit):
        main(["nothing"], spark)


def test_all_rows_are_printed(spark, tmp_path, monkeypatch, capsys):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    main(["generate", str(tmp_path), "demo", "1200", "70000"], spark)
    monkeypatch.setattr("sys.argv", ["tidelog", "consume", str(tmp_path), "demo", "0"])
    capsys.readouterr()
    try:
        runpy.run_module("tidelog", run_name="__main__")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    said = capsys.readouterr().out
    assert "user1" in said and "\n1199\t" in said and said.count("\n") == 1201


def test_generated_log_compacted(spark, tmp_path):
    main(["generate", str(tmp_path), "demo", "24", "700"], spark)
    from tidelog.__main__ import read

    r = read(spark, str(tmp_path)).withColumn("ts", F.lit(None).cast("timestamp"))
    tomb = spark.createDataFrame([("demo", 0, 24, b"user3", None, 21)], "topic string, partition_id int, log_offset bigint, rec_key binary, rec_value binary, segment_base bigint").withColumn("ts", F.lit(None).cast("timestamp"))
    all_ = r.select(tomb.columns).unionByName(tomb)
    segs = all_.groupBy("topic", "partition_id", F.col("segment_base").alias("base_offset")).agg((F.max("log_offset") + 1).alias("next_offset")).withColumn("sealed", F.col("base_offset") < 21)
    meta = spark.createDataFrame([("demo", 1, 1000)], "topic string, cleanup tinyint, delete_retention_ms bigint")
    judged = compaction.judged(all_, segs, meta, 10**13)
    assert sorted(x["log_offset"] for x in judged.where("retained").collect()) == list(range(11, 25))
    report = compaction.pass_report(judged).first()
    assert (report["n_dropped"], report["n_keys"], report["n_rewritten"], report["n_removed"]) == (11, 10, 1, 1)
