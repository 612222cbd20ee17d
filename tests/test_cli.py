import pytest

from quillon import cli, cli_topics

LINES = "Alex\tPop\t10\tR&B\t6\tRock\t4\nBob\tJazz\t8\tReggae\t9\nDave\tClassic\t4\tWorld\t4\nTed\tJazz\t9\tMetal\t2\tReggae\t6\nFred\tPop\t4\tRock\t3\tHip-hop\t3\nSam\tClassic\t8\tRock\t1\n"


def test_cluster_then_classify(spark, tmp_path):
    source, out, cents, found = (str(tmp_path / x) for x in ("in.tsv", "out", "cents", "found"))
    (tmp_path / "in.tsv").write_text(LINES)
    cli.main([source, out, "-n", "3", "-p", "-c", cents, "--clvector-size", "5"], spark)
    lines = [r["value"].split("\t") for r in spark.read.text(out).collect()]
    assert sorted(x for line in lines for x in line[1::2]) == ["Alex", "Bob", "Dave", "Fred", "Sam", "Ted"]
    cli.main([source, found, "-C", cents, "--classify-size", "1"], spark)
    best = {v[0]: v[1] for v in (r["value"].split("\t") for r in spark.read.text(found).collect())}
    assert best == {x: line[0] for line in lines for x in line[1::2]}
    with pytest.raises(SystemExit):
        cli.main([source, out], spark)


def test_errors_come_before_work(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli.tsv, "read_vectors", lambda *a, **k: pytest.fail("work began"))
    source = tmp_path / "in.tsv"
    source.write_text(LINES)
    (tmp_path / "file").write_text("no folder")
    (tmp_path / "there").mkdir()
    for argv, message in (
        ([str(tmp_path / "none.tsv"), str(tmp_path / "o"), "-n", "2"], "File not found"),
        ([str(source), str(tmp_path / "o"), "-C", str(tmp_path / "none")], "File not found"),
        ([str(source), str(tmp_path / "there"), "-n", "2"], "Output exists"),
        ([str(source), str(tmp_path / "o"), "-n", "2", "-c", str(tmp_path / "file" / "x")], "Cannot write"),
    ):
        assert cli.main(argv, spark) == 1 and message in capsys.readouterr().err
    assert cli_topics.main(["plsi", str(tmp_path / "none.tsv"), str(tmp_path / "o"), "-n", "2"], spark) == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["file", "in.tsv", "there"]


def test_topics(spark, tmp_path):
    (tmp_path / "in.tsv").write_text(LINES + "Nobody\n")
    source = str(tmp_path / "in.tsv")
    for name, options in (("plain", []), ("normal", ["--normalize", "-b", "0.9", "-i", "4"])):
        assert cli_topics.main(["plsi", source, str(tmp_path / name), "-n", "2", "-i", "3", *options], spark) == 0
    lines = [r["value"].split("\t") for r in spark.read.text(str(tmp_path / "normal")).collect()]
    assert {x[0] for x in lines} == {"Alex", "Bob", "Dave", "Ted", "Fred", "Sam", "Nobody"}
    assert all(len(x) == 3 and abs(sum(map(float, x[1:])) - (x[0] != "Nobody")) < 1e-5 for x in lines)
    plain = [r["value"].split("\t") for r in spark.read.text(str(tmp_path / "plain")).collect()]
    assert sum(float(v) for x in plain for v in x[1:]) == pytest.approx(1, abs=1e-4)
    assert cli_topics.main(["lda", source, str(tmp_path / "lda"), "-n", "3", "-i", "2", "-a", "0.5", "-b", "0.1", "--phi", str(tmp_path / "phi")], spark) == 0
    theta = {x[0]: list(map(float, x[1:])) for x in (r["value"].split("\t") for r in spark.read.text(str(tmp_path / "lda")).collect())}
    assert len(theta) == 7 and all(sum(x) == pytest.approx(1, abs=1e-5) for x in theta.values()) and theta["Nobody"] == pytest.approx([1 / 3] * 3, abs=1e-6)
    phi = [r["value"].split("\t") for r in spark.read.text(str(tmp_path / "phi")).collect()]
    assert [x[0] for x in phi] == ["0", "1", "2"] and all(x[1::2] == phi[0][1::2] and sum(map(float, x[2::2])) == pytest.approx(1, abs=1e-4) for x in phi)
