"""Edge preparation, files and reports."""

import io

import pytest
from pyspark.sql import functions as F

from spreadlab import session
from spreadlab.operators import prep, sampling
from spreadlab.plans import commands, experiments
from spreadlab.sources import edges as E
from spreadlab.sources import results as R


def lines(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "line long, value string")


def test_clean_keeps_pairs_only(spark):
    got = prep.clean(lines(spark, ["# a b", "1 2", " 3\t4 ", "5", "6 7 8", None, "", "9 % 1", "x y"])).orderBy("line").collect()
    assert [(r.s, r.t) for r in got] == [("1", "2"), ("3", "4"), ("x", "y")]
    assert prep.clean(lines(spark, ["1 2", "# x", "3 4", "5 6"]), skip=1).count() == 2


def test_dense_ids_follow_first_appearance(spark):
    pairs = prep.clean(lines(spark, ["10 700", "700 10", "3 10", "8 3"]))
    ids = {r.key: r.id for r in prep.dense_ids(pairs).collect()}
    assert ids == {"10": 0, "700": 1, "3": 2, "8": 3}


def test_prepare_undirected_and_parallel(spark):
    got = {(r.s, r.t): (r.c, r.w) for r in prep.prepare(lines(spark, ["0 1", "0 1", "0 1", "0 0"]), ("p", 0.01), is_undirected=True).collect()}
    assert got == {(0, 1): (3, round(1 - 0.99**3, 4)), (1, 0): (3, round(1 - 0.99**3, 4)), (0, 0): (2, round(1 - 0.99**2, 4))}
    for weighting in (("U", 0.0, 0.1), ("N", 0.05, 0.025), ("N", 0.05)):
        ws = [r.w for r in prep.prepare(lines(spark, ["0 1", "1 2"]), weighting, fix_ids=True).collect()]
        assert len(ws) == 2 and all(0 <= w <= 1 for w in ws)


def test_empty_edges(spark):
    none = prep.prepare(lines(spark, ["# none"]), ("p", 0.1))
    assert none.count() == 0
    assert prep.summary(none).first() == (None, 0)


def test_csr_offsets_have_sinks(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (3, 0), (70000, 1)], "s long, t long")
    ids = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 70000)], "id long")
    got = {r.id: (r.degree, r.first) for r in prep.csr_offsets(edges, ids).collect()}
    assert got == {0: (2, 0), 1: (0, 2), 2: (0, 2), 3: (1, 2), 70000: (1, 3)}


def test_weighted_files_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([(3, 4, 0.05), (0, 1, 0.01)], "s long, t long, w double")
    E.write_weighted(edges, f"{tmp_path}/e")
    back, header = E.read_prepared(spark, f"{tmp_path}/e")
    assert sorted((r.s, r.t, round(r.w, 4)) for r in back.collect()) == [(0, 1, 0.01), (3, 4, 0.05)]
    assert header.first() == (5, 2)


def test_csr_files_round_trip(spark, tmp_path):
    rows = [(0, 1, 5), (0, 3, 6), (3, 0, 7), (2, 3, 8)]
    E.write_csr_file(spark.createDataFrame(rows, "u long, v long, thr long"), f"{tmp_path}/g.bin")
    for block in (1, 3, 100):
        assert sorted(map(tuple, E.read_csr(spark, f"{tmp_path}/g.bin", block).collect())) == sorted(rows)


def test_seed_lists(spark, tmp_path):
    assert R.parse_seeds(" 1 2\n33 x 4") == [1, 2, 33]
    result = spark.createDataFrame([(0, 14949, 5.72, 3.454, 0.0), (1, 33, 11.4, 3.45, 2.0)], R.RESULT)
    R.write_seeds(result, f"{tmp_path}/s")
    assert [r.value for r in spark.read.text(f"{tmp_path}/s").collect()] == ["14949\t5.72\t3.45\t0", "33\t11.40\t3.45\t2"]


def test_report(spark, tmp_path):
    for name, text in {"ca-HepPh_0.01_sketch_50_0.3_256_0": "1\nfillrate:0.25\n", "ca-HepPh_0.01_sketch_50_0.3_256_1": "fillrate:0.75", "bad_0.01_sketch_50_0.3_256_1": "oops", "amazon0302.x_0.01_sketch_50_0.3_256_0": "fillrate:0.5"}.items():
        (tmp_path / f"{name}.txt").write_text(text)
    rows = experiments.named(experiments.chosen(R.read_fill_rates(spark, f"{tmp_path}/*.txt")))
    got = {(r.Dataset, r.Approach): r.rate for r in experiments.pivot_means(rows, "Approach", "rate", "Fillrate").collect()}
    assert got == {("NetPhy", "Naive"): 0.25, ("NetPhy", "Sorted"): 0.75, ("Amazon", "Naive"): 0.5, ("Mean", "Naive"): 0.375, ("Mean", "Sorted"): 0.75}
    table = experiments.wide(experiments.pivot_means(rows, "Approach", "rate", "Fillrate"), "Approach", "rate", ["0.01 Naive", "0.01 Sorted"])
    latex = experiments.to_latex(table)
    assert r"\tt{Amazon} & 50\% & - \\" in latex and latex.index("Amazon") < latex.index("Mean")


def test_rules_sweep_and_combinations(spark):
    assert experiments.rules("data/com-dblp.ungraph.txt") == {"is_undirected": True, "fix_ids": False}
    assert experiments.rules("ca-HepPh.txt") == {"is_undirected": True, "fix_ids": True}
    grid = experiments.combinations(spark, k=[1, 2], r=[8, 16, 32])
    assert grid.count() == 6
    assert experiments.sweep([{"k": 1}, {"k": 2}], lambda p: {"x": p["k"] * 2}, lambda p: p["k"] == 1) == [{"k": 2, "x": 4}]
    assert grid.where(F.col("k") == 1).count() == 3


def test_lines_of_several_files_keep_their_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("7 8\n")
    (tmp_path / "b.txt").write_text("".join(f"{i} {i + 1}\n" for i in range(2000)))
    rows = E.raw_lines(spark, str(tmp_path)).orderBy("line").collect()
    assert [r.line for r in rows] == list(range(2001)) and [r.value for r in rows[:3]] == ["7 8", "0 1", "1 2"]
    ids = {r.key: r.id for r in prep.dense_ids(prep.clean(E.raw_lines(spark, str(tmp_path)))).collect()}
    assert (ids["7"], ids["8"], ids["0"]) == (0, 1, 2)


def test_blocks_of_one_file_keep_their_order(spark, tmp_path):
    (tmp_path / "c.txt").write_text("".join(f"{i:05d} x\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = E.raw_lines(spark, str(tmp_path)).orderBy("line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in rows] == [f"{i:05d} x" for i in range(5000)] and [r.line for r in rows] == list(range(5000))


def test_folder_is_prepared_by_its_rules(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    (raw / "x.ungraph.txt").write_text("# c\n0 1\n")
    (raw / "ego-twitter.txt").write_text("70 9\n9 70\n")
    done = experiments.prepare_folder(spark, str(raw), str(out), ("0.005", "0.1"), (("0", "0.1"),), (("0.05", "0.025"),))
    assert {f.rsplit("/", 1)[-1]: len(t) for f, t in done.items()} == {"ego-twitter.txt": 4, "x.ungraph.txt": 4}
    back, header = E.read_prepared(spark, f"{out}/x.ungraph_0.1.txt")
    assert sorted((r.s, r.t, round(r.w, 4)) for r in back.collect()) == [(0, 1, 0.1), (1, 0, 0.1)] and header.first() == (2, 2)
    assert sorted((r.s, r.t) for r in E.read_prepared(spark, f"{out}/ego-twitter_N0.05.txt")[0].collect()) == [(0, 1), (1, 0)]


def test_commands(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "raw.txt").write_text("# star\n" + "".join(f"0 {i}\n" for i in range(1, 8)) + "8 9\n")
    out = [f"{tmp_path}/p1", f"{tmp_path}/u"]
    assert commands.main(["prepare", f"{tmp_path}/raw.txt", "-p", "1", "-pf", out[0], "-U", "0", "0.1", "-Uf", out[1]], spark) == sorted(out)
    with pytest.raises(ValueError, match="2 weightings"):
        commands.main(["prepare", f"{tmp_path}/raw.txt", "-p", "1", "0.5", "-pf", out[0]], spark)
    with pytest.raises(ValueError, match="pairs"):
        commands.main(["prepare", f"{tmp_path}/raw.txt", "-N", "1", "-Nf", out[0]], spark)
    lines = commands.main(["select", out[0], "-M", "COMPONENTS", "-K", "2", "-R", "4"], spark)
    assert [x.split("\t")[:2] for x in lines] == [["0", "8.00"], ["8", "10.00"]]
    lines = commands.main(["select", out[0], "-K", "2", "-R", "16", "-o", f"{tmp_path}/seeds.txt"], spark)
    assert (tmp_path / "seeds.txt").read_text().splitlines() == lines and lines[0].startswith("0\t8.00") and lines[0].endswith("%")
    assert len(commands.main(["parts", out[0], "-K", "2", "-R", "8", "-g", "2"], spark)[0].split("\t")) == 3
    monkeypatch.setattr("sys.stdin", io.StringIO("0 8 x"))
    assert commands.main(["select", out[0], "-M", "oracle", "-R", "4"], spark) == ["10.00"]


def test_fill_rate_experiment_resumes(spark, tmp_path):
    arcs = sampling.graph(spark.createDataFrame([(i, (i * 7 + k) % 20, 0.5) for i in range(20) for k in range(3)], "s long, t long, w double"))
    written = experiments.fill_rate_run(spark, {"toy.x_0.1": arcs}, str(tmp_path), k=2, n_sims=(32,), rounds=3)
    assert [p.rsplit("/", 1)[-1] for p in written] == ["toy.x_0.1_Registers_2_0.3_32_0.txt", "toy.x_0.1_Registers_2_0.3_32_1.txt"]
    assert experiments.fill_rate_run(spark, {"toy.x_0.1": arcs}, str(tmp_path), k=2, n_sims=(32,)) == []
    rates = R.read_fill_rates(spark, f"{tmp_path}/*.txt").collect()
    assert sorted((r.Dataset, r.Setting, r.R, r.Approach) for r in rates) == [("toy", "0.1", 32, "Naive"), ("toy", "0.1", 32, "Sorted")] and all(0 < r.Fillrate < 1 for r in rates)


def test_catalogue(spark, tmp_path):
    assert experiments.catalogue(spark).where("small").count() == 3
    (tmp_path / "list").write_text("https://example.org/a/x.ungraph.txt.gz\n\nhttps://example.org/amazon0302.txt.gz\n")
    got = {r.file: (r.small, r.is_undirected) for r in experiments.catalogue(spark, f"{tmp_path}/list").collect()}
    assert got == {"x.ungraph.txt.gz": (False, True), "amazon0302.txt.gz": (True, True)}


def test_shared_folder_is_required_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session())
    Context.master = "local[2]"
    assert session.shared_dir(Session()).startswith("file://")
