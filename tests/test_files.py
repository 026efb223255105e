import pytest
from pyspark.sql import functions as F

from tractwise.operators import histograms
from tractwise.sources import files, sinks


@pytest.fixture
def folder(tmp_path):
    header = "".join(f"header {i}\n" for i in range(6))
    tabbed = "".join(f"{i}\t{i * i}\n" for i in range(51))
    texts = {
        "s1_d0.rest.histogram": header + tabbed,
        "s1_d42.per.histogram": header + tabbed,
        "untreated_1.csv": "1,2\n2,4,9\n3,8\n",
        "day42_1.csv": "1,2\r\n2,4\r\n",
        "semi_d0.txt": "1;2\n2;4\n3;5\n",
        "junk_d0.csv": "1,2\nx,3\n2,abc\n\n3,NaN\n4,inf\n5,7\n",
        "const_d0.csv": "1,5\n2,5\n",
        "empty_d0.csv": "a,b\n",
        "t_d0.tsv": "1\t2\n2\t9\n",
        "notes.md": "1,2\n2,3\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    return str(tmp_path)


@pytest.mark.parametrize("whole_bytes", [files.WHOLE_FILE_BYTES, 0])
def test_histogram_files(spark, folder, whole_bytes):
    rows = files.read_histograms(spark, folder, whole_bytes=whole_bytes)
    got = {}
    for r in rows.orderBy("sample", "pos").collect():
        got.setdefault((r["grp"], r["sample"]), []).append((r["pos"], r["repeat_length"], r["reads"]))
    squares = [(i, float(i), float(i * i)) for i in range(51)]
    assert got[("Day0", "s1_d0")] == squares and got[("treated", "s1_d42")] == squares
    assert got[("treated", "untreated_1")] == [(0, 1.0, 2.0), (1, 2.0, 4.0), (2, 3.0, 8.0)]
    assert got[("Day0", "day42_1")] == [(0, 1.0, 2.0), (1, 2.0, 4.0)]
    assert got[("Day0", "semi_d0")] == [(0, 1.0, 2.0), (1, 2.0, 4.0), (2, 3.0, 5.0)]
    assert got[("Day0", "t_d0")] == [(0, 1.0, 2.0), (1, 2.0, 9.0)]
    assert [r[1] for r in got[("Day0", "junk_d0")]] == [1.0, 4.0, 5.0]
    assert ("Day0", "empty_d0") not in got and ("Day0", "notes") not in got
    valid = {r["sample"] for r in histograms.valid_samples(rows).collect()}
    assert valid == {"s1_d0", "s1_d42", "untreated_1", "day42_1", "semi_d0", "t_d0"}


def test_single_file_path(spark, folder):
    rows = files.read_histograms(spark, [f"{folder}/t_d0.tsv", f"{folder}/day42_1.csv"],
                                 default_group="treated")
    assert {(r["sample"], r["grp"]) for r in rows.collect()} == {("t_d0", "Day0"), ("day42_1", "treated")}


def test_named_files_need_no_known_extension(spark, folder, tmp_path):
    other = tmp_path / "more"
    other.mkdir()
    (other / "x_d0.dat").write_text("1,2\n2,3\n")
    rows = files.read_histograms(spark, [str(other / "x_d0.dat"), folder])
    assert {"x_d0", "s1_d0"} <= {r["sample"] for r in rows.collect()}
    assert "notes" not in {r["sample"] for r in rows.collect()}


def test_delta_files(spark, tmp_path):
    (tmp_path / "strict.csv").write_text('"repeat length","Day0_a, b",delta\n2,1,0.5\n1,1,-0.25\n3,9,\n')
    (tmp_path / "loose a.csv").write_text("len, Delta \n5,1e-3\n")
    (tmp_path / "none.csv").write_text("len,other\n5,1\n")
    strict = files.read_delta_files(spark, str(tmp_path))
    assert [(r["dataset"], r["pos"], r["x"], r["delta"]) for r in
            files.delta_series(strict).orderBy("pos").collect()] == [
        ("strict", 1, 2.0, 0.5), ("strict", 2, 1.0, -0.25)]
    assert {r["file"] for r in files.skipped_files(strict).collect()} == {"loose a.csv", "none.csv"}
    loose = files.read_delta_files(spark, str(tmp_path), loose=True)
    assert files.delta_series(loose).filter("dataset = 'loose a'").first()["delta"] == 0.001
    assert [r["file"] for r in files.skipped_files(loose).collect()] == ["none.csv"]


def test_fasta(spark, tmp_path):
    (tmp_path / "a_d0.fa").write_text(">r1 some > text\nACG\nT\n>r2\nGG\n")
    (tmp_path / "b_D42.FASTA").write_text("\n>r3\r\nCAG\r\nCAG\r\n", newline="")
    (tmp_path / "c.txt").write_text(">r4\nAA\n")
    got = {(r["file"], r["grp"], r["read_id"], r["seq"])
           for r in files.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {("a_d0.fa", "Day0", "r1", "ACGT"), ("a_d0.fa", "Day0", "r2", "GG"),
                   ("b_D42.FASTA", "treated", "r3", "CAGCAG")}


def hist(spark):
    rows = [(d, g, "a", i, float(i), float(i * 3 + 1)) for d in ("x#1 y", "z") for g in ("Day0", "treated")
            for i in range(5)]
    return spark.createDataFrame(
        rows, "dataset string, grp string, sample string, pos int, repeat_length double, reads double")


def test_histogram_sink_round_trip(spark, tmp_path):
    path = sinks.write_histograms(hist(spark), str(tmp_path / "out"), "permissive")
    back = files.read_histograms(spark, path, F.regexp_extract("file", "^(.*)_(Day0|treated)_", 1),
                                 F.regexp_extract("path", "/grp=([^/]+)/", 1), nested=True)
    want = {(r["dataset"], r["grp"], r["pos"], r["reads"]) for r in hist(spark).collect()}
    assert {(r["dataset"], r["grp"], r["pos"], r["reads"]) for r in back.collect()} == want
    assert all(r["sample"].endswith("_a") for r in back.collect())
    names = [p.name for p in (tmp_path / "out" / "grp=Day0").iterdir()]
    assert all(n.endswith(".per.histogram") for n in names) and len(names) == 2


def test_delta_sink_names_second_sets(spark, tmp_path):
    wide = spark.createDataFrame([("d", 1, 2.0, 0.5), ("d", 2, 2.0, 0.25), ("d", 1, 1.0, 0.75)],
                                 "dataset string, set_id int, `repeat length` double, delta double")
    path = sinks.write_delta_csv(wide, str(tmp_path / "csv"), F.col("set_id") == 2)
    back = files.delta_series(files.read_delta_files(spark, path, nested=True))
    assert {tuple(r) for r in back.collect()} == {
        ("d", 1, 1.0, 0.75), ("d", 2, 2.0, 0.5), ("d_set2", 1, 2.0, 0.25)}


def test_results_text_rounds_half_even_and_appends(spark, tmp_path):
    table = spark.createDataFrame([("d", "Day0", "s", 17.0, 0.125, -0.375, 0.5)],
                                  "dataset string, grp string, sample string, mode double, "
                                  "instability_index double, contraction_index double, expansion_index double")
    text = sinks.results_text(table).first()["value"]
    assert text.split("\n") == ["Sample: s", "Mode: 17.0", "Instability Index: 0.12",
                                "Contraction Index: -0.38", "Expansion Index: 0.5", "__________"]
    for _ in range(2):
        sinks.write_results(table, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 12


def test_csv_sink(spark, tmp_path):
    path = sinks.write_csv(hist(spark), str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(path).count() == 20


def test_line_ends_and_numbers(spark, tmp_path):
    from tractwise.functions.columns import to_number
    from tractwise.sources.files import numbered_lines
    from pyspark.sql import functions as F

    (tmp_path / "a.csv").write_bytes(b"1,2\r3,4\r5,6 \r\n7,8")
    for limit in (1 << 20, 0):
        rows = numbered_lines(spark, str(tmp_path), whole_bytes=limit).collect()
        assert [r.line for r in sorted(rows, key=lambda r: r.line_no)] == ["1,2", "3,4", "5,6", "7,8"]
    texts = spark.createDataFrame([("12d",), ("1f",), (" 1.5e3 ",), ("-2",), ("x",)], "t string")
    assert [r[0] for r in texts.select(to_number(F.col("t"))).collect()] == [None, None, 1500.0, -2.0, None]


@pytest.mark.parametrize("whole_bytes", [files.WHOLE_FILE_BYTES, 0])
def test_blank_lines_do_not_count(spark, tmp_path, whole_bytes):
    head = "h\n\n\nh\n\nh\n"
    (tmp_path / "s_d0.rest.histogram").write_text(head + "\n10\t1\n\n11\t5\nx\t1\n \n12\t3\n")
    rows = files.read_histograms(spark, str(tmp_path), whole_bytes=whole_bytes)
    got = sorted((r["pos"], r["repeat_length"], r["reads"]) for r in rows.collect())
    assert got == [(0, 10.0, 1.0), (1, 11.0, 5.0), (3, 12.0, 3.0)]
    assert abs(histograms.instability(rows).first()["instability_index"] - (-1 * 1 + 2 * 3) / 9) < 1e-12


@pytest.mark.parametrize("whole_bytes", [files.WHOLE_FILE_BYTES, 0])
def test_delta_header_is_the_first_line_not_blank(spark, tmp_path, whole_bytes):
    (tmp_path / "a.csv").write_text("\n\nlen,delta\n\n2,1\n1,0.5\n")
    (tmp_path / "b.csv").write_text("len,other\n2,1\n3,1\n")
    read = files.read_delta_files(spark, str(tmp_path), whole_bytes=whole_bytes)
    assert sorted((r["pos"], r["x"], r["delta"]) for r in files.delta_series(read).collect()) == [
        (1, 2.0, 1.0), (2, 1.0, 0.5)]
    assert [r["file"] for r in files.skipped_files(read).collect()] == ["b.csv"]


def test_blank_delta_file_is_skipped_by_name(spark, tmp_path):
    (tmp_path / "none.csv").write_text("\n \n")
    read = files.read_delta_files(spark, str(tmp_path))
    assert [r["file"] for r in files.skipped_files(read).collect()] == ["none.csv"]


@pytest.mark.parametrize("names, samples", [
    (["s1_d0.rest.histogram", "s1_d0.per.histogram"], {"s1_d0.rest.histogram", "s1_d0.per.histogram"}),
    (["a.csv", "a.tsv"], {"a.csv", "a.tsv"}),
    (["x/a.csv", "y/a.csv"], None),
    (["a.csv", "b.csv"], {"a", "b"}),
])
def test_every_file_is_a_sample(spark, tmp_path, names, samples):
    for i, name in enumerate(names):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        sep = "," if name.endswith(".csv") else "\t"
        head = "h\n" * 6 if name.endswith(".histogram") else ""
        (tmp_path / name).write_text(head + f"1{sep}2\n2{sep}{i + 4}\n")
    rows = files.read_histograms(spark, str(tmp_path), nested=True)
    per_sample = {r["sample"]: r["count"] for r in rows.groupBy("sample").count().collect()}
    assert list(per_sample.values()) == [2, 2]
    assert samples is None or set(per_sample) == samples


def test_small_files_need_no_shuffle(spark, folder, capsys):
    read = files.whole_files(spark, folder)
    read.explain()
    assert "Exchange" not in capsys.readouterr().out
