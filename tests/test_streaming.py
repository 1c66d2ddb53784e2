import json

from loomspark.streaming import ingest as S


def test_ingest_is_incremental(spark, tmp_path):
    def write(name, *minutes):
        (tmp_path / "logs" / "p").mkdir(parents=True, exist_ok=True)
        rows = [json.dumps({"type": "assistant", "timestamp": f"2026-01-01T10:{m:02}:00Z", "message": {"usage": {"output_tokens": m}}}) for m in minutes]
        (tmp_path / "logs" / "p" / f"{name}.jsonl").write_text("\n".join([*rows, "{broken"]))

    def run():
        S.ingest(S.log_stream(spark, str(tmp_path / "logs")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
        return spark.read.parquet(str(tmp_path / "out"))

    write("a", 1, 2)
    assert sorted((r.session_id, r.tokens) for r in run().collect()) == [("a", 1), ("a", 2)]
    write("b", 30)
    out = run()
    assert out.count() == 3
    assert sorted((r.n, r.tokens) for r in S.token_windows(out).collect()) == [(1, 30), (2, 3)]
