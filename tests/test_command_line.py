from chronoweave.__main__ import main


def test_from_text_to_metrics(spark, tmp_path, capsys):
    lines = "".join(f"{100 + i % 7} {200 + i * 3 % 5} {1000 + i}\n" for i in range(120))
    (tmp_path / "raw.txt").write_text("src dst time\n" + lines)
    main(["etl", "--txt", str(tmp_path / "raw.txt"), "--out", str(tmp_path / "edges")], spark)
    rows = spark.read.parquet(str(tmp_path / "edges")).orderBy("eid").collect()
    assert [r.eid for r in rows] == list(range(120)) and [r.time for r in rows] == list(range(120))
    assert {r.src for r in rows} == set(range(7)) and {r.dst for r in rows} == set(range(7, 12))
    assert [sum(r.ext_roll == s for r in rows) for s in (0, 1, 2)] == [84, 18, 18]
    main(["evaluate", "--edges", str(tmp_path / "edges"), "--neighbor_num", "3", "--batch_size", "6", "--rand_node_features", "4"], spark)
    assert "auc" in capsys.readouterr().out
