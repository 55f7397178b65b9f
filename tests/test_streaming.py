from fieldfold.streaming.follow import follow_srt

BLOCK = "1\n00:00:01,000 --> 00:00:02,000\n[latitude: -33.5] [longitude: 151.2] [rel_alt: 60.0]\n"


def test_new_logs_are_taken_once(spark, tmp_path):
    logs, out, state = (str(tmp_path / n) for n in ("logs", "out", "state"))
    (tmp_path / "logs").mkdir()
    for name in ("a.SRT", "b.srt"):
        (tmp_path / "logs" / name).write_text(BLOCK)
        follow_srt(spark, logs, out, state, once=True).awaitTermination(60)
    got = spark.read.parquet(out).collect()
    assert sorted(r.track for r in got) == ["a.SRT", "b.srt"] and {r.batch for r in got} == {0, 1}
