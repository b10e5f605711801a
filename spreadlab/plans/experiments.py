"""Parameter sweeps and the reports made of their results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlab.operators import prep, sampling, select, sketch
from spreadlab.session import spool
from spreadlab.sources import edges, results

# Display names of data sets.
NAMES = {
    "amazon0302": "Amazon",
    "com-youtube": "Youtube",
    "soc-LiveJournal1": "LiveJournal",
    "soc-pokec-relationships": "Pokec",
    "com-orkut": "Orkut",
    "ca-HepPh": "NetPhy",
    "ca-HepTh": "NetHEP",
    "com-dblp": "DBLP",
    "ego-twitter": "Twitter",
    "soc-Epinions1": "Epinions",
    "soc-Slashdot0811": "Slashdot0811",
    "soc-Slashdot0902": "Slashdot0902",
    "com-friendster": "Friendster",
}
SETTINGS = ("0.005", "0.01", "0.1")
# Files of the data sets that are studied, and of those in the small selection.
CATALOGUE = (
    "com-orkut.ungraph.txt.gz",
    "soc-LiveJournal1.txt.gz",
    "soc-Epinions1.txt.gz",
    "soc-Slashdot0902.txt.gz",
    "soc-Slashdot0811.txt.gz",
    "com-dblp.ungraph.txt.gz",
    "com-youtube.ungraph.txt.gz",
    "amazon0302.txt.gz",
    "soc-pokec-relationships.txt.gz",
    "com-friendster.ungraph.txt.gz",
)
SMALL = ("soc-Epinions1.txt.gz", "soc-Slashdot0902.txt.gz", "amazon0302.txt.gz")
# Data sets that are undirected or need new ids though their names do not say so.
UNDIRECTED, RELABELLED = ("amazon0302", "ca-HepPh", "ca-HepTh"), ("ca-HepPh", "ca-HepTh", "ego-twitter")


def catalogue(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(file, small, is_undirected, fix_ids) of the known data sets, or of those that the lines of a list name by URL."""
    files = CATALOGUE if path is None else [r.value.strip().rsplit("/", 1)[-1] for r in spark.read.text(path).where("trim(value) != ''").collect()]  # a list of a few names
    return spark.createDataFrame([(f, f in SMALL, *rules(f.removesuffix(".gz")).values()) for f in files], "file string, small boolean, is_undirected boolean, fix_ids boolean")


def rules(file_name: str) -> dict:
    """How a raw file is prepared: undirected if its name has the part ``ungraph`` or is listed, new ids if listed."""
    stem = file_name.rsplit("/", 1)[-1].removesuffix(".txt")
    parts = file_name.rsplit("/", 1)[-1].split(".")
    return {"is_undirected": "ungraph" in parts or stem in UNDIRECTED, "fix_ids": parts[0] in RELABELLED}


def prepare_files(lines: DataFrame, outputs: dict[str, tuple], is_undirected: bool = False, fix_ids: bool = False, skip: int = 0) -> None:
    """One run, many outputs: edges are cleaned and counted once, then weighted and written to each path of {path: weighting}.

    weighting: ("p", p), ("U", a, b) or ("N", mean, deviation).
    """
    counted = spool(prep.count(lines, is_undirected, fix_ids, skip))
    n = prep.summary(counted).first().n or 0
    for path, weighting in outputs.items():
        edges.write_weighted(prep.weigh(counted, weighting), path, n)


def outputs_of(weightings: list[tuple], paths: list[str], what: str) -> dict[str, tuple]:
    """Weightings with their paths; there must be as many of both."""
    if len(weightings) != len(paths):
        raise ValueError(f"{len(weightings)} weightings of {what}, but {len(paths)} output files")
    return dict(zip(paths, weightings, strict=True))


def prepare_folder(spark: SparkSession, folder: str, out: str, constants: tuple = ("0.005",), uniform: tuple = (), normal: tuple = ()) -> dict[str, dict]:
    """Prepares each .txt file of a folder by its rules; gives {file: {output: weighting}}.

    Outputs are named by the file, then _p, _U and the upper bound, or _N and the mean.
    """
    files = sorted(r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path").collect())  # names alone
    done = {}
    for file in files:
        stem = f"{out}/{file.rsplit('/', 1)[-1].removesuffix('.txt')}"
        targets = {f"{stem}_{p}.txt": ("p", float(p)) for p in constants}
        targets |= {f"{stem}_U{b}.txt": ("U", float(a), float(b)) for a, b in uniform}
        targets |= {f"{stem}_N{m}.txt": ("N", float(m), float(d)) for m, d in normal}
        prepare_files(edges.raw_lines(spark, file), targets, **rules(file))
        done[file] = targets
    return done


def combinations(spark: SparkSession, **values: list) -> DataFrame:
    """A row for each combination of parameter values; the lists are the caller's."""
    tables = [spark.createDataFrame([(x,) for x in v], [k]) for k, v in values.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), tables)


def sweep(rows: list[dict], run: Callable[[dict], dict], done: Callable[[dict], bool] = lambda _: False) -> list[dict]:
    """run() for each parameter set that is not done yet; results carry their parameters."""
    return [p | run(p) for p in rows if not done(p)]


def fill_rate_run(spark: SparkSession, graphs: dict[str, DataFrame], out: str, method: str = "Registers", k: int = 50, n_sims: tuple = (256,), eps: float = 0.3, in_order: tuple = (0, 1), rounds: int = 20) -> list[str]:
    """The fill-rate experiment: for each graph {name_p: arcs}, number of simulations and order of seeds, a result file that read_fill_rates reads.

    Files are named name_p_method_k_eps_sims_order.txt; those that have k lines already are left alone.  Gives the paths written.
    """
    written = []
    for name, arcs in graphs.items():
        arcs = spool(arcs)
        ids = spool(arcs.selectExpr("explode(array(u, v)) as id").distinct())
        for sims in n_sims:
            for ordered in in_order:
                path = f"{out}/{name}_{method}_{k}_{eps:g}_{sims}_{ordered}.txt"
                if complete(spark, path, k):
                    continue
                seeds = sampling.seeds(spark, sims, in_order=bool(ordered))
                result = select.sketch_greedy(arcs, ids, seeds, k, eps)
                rate = sampling.fill_rate_of_rounds(sketch.registers(ids, seeds, sims), sampling.live_edges(arcs, seeds), rounds).first().fill_rate
                results.write_result_file(result, path, fill_rate=rate)
                written.append(path)
    return written


def complete(spark: SparkSession, path: str, least: int = 50) -> bool:
    """A result file is there and has ``least`` lines."""
    from pyspark.errors import AnalysisException

    try:
        return len(spark.read.text(path).head(least)) >= least
    except AnalysisException:
        return False


def named(rows: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Dataset by its display name, where it has one."""
    names = NAMES if names is None else names
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return rows.withColumn("Dataset", F.coalesce(F.try_element_at(table, F.col("Dataset")), F.col("Dataset")))


def chosen(rows: DataFrame, n_sims: int | None = 256, settings: tuple = SETTINGS) -> DataFrame:
    """Rows of one number of simulations (if they tell it) and of the settings reported."""
    if n_sims is not None and "R" in rows.columns:
        rows = rows.where(F.col("R") == n_sims).drop("R")
    return rows.where(F.col("Setting").isin(*settings))


def pivot_means(rows: DataFrame, by: str, column: str, value: str) -> DataFrame:
    """(Dataset, Setting, by, column) in long form: means for each data set, and margins ``Mean`` over the raw rows."""
    rolled = rows.rollup("Setting", by, "Dataset").agg(F.avg(value).alias(column), F.grouping_id().alias("level"))
    return rolled.where("level <= 1").select(F.when(F.col("level") == 1, "Mean").otherwise(F.col("Dataset")).alias("Dataset"), "Setting", by, column)


def wide(means: DataFrame, by: str, column: str, order: list[str]) -> DataFrame:
    """A row for each data set, then Mean; a column for each (setting, by)."""
    out = means.withColumn("key", F.concat_ws(" ", "Setting", by)).groupBy("Dataset").pivot("key", order)
    return out.agg(F.first(column)).orderBy(F.col("Dataset") == "Mean", "Dataset")


def clipped(column: str):
    """A share within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(column)))


def to_latex(table: DataFrame) -> str:
    """A small report table as LaTeX: whole percents, - for none, data sets in typewriter letters."""
    rows = table.collect()  # a row for each data set
    head = " & ".join(c.replace("_", r"\_") for c in table.columns) + r" \\"
    lines = [rf"\begin{{tabular}}{{{'c' * len(table.columns)}}}", r"\toprule", head, r"\midrule"]
    for r in rows:
        name = r[0] if r[0] == "Mean" else rf"\tt{{{r[0]}}}"
        lines.append(" & ".join([name, *("-" if x is None else rf"{x:.0%}".replace("%", r"\%") for x in r[1:])]) + r" \\")
    return "\n".join([*lines, r"\bottomrule", r"\end{tabular}"])
