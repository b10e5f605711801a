"""Seeds in, results out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What each method prints after seed, score and seconds.
RESULT = "step int, seed long, score double, elapsed double, diag double"
REPORT = "tag string, Split int, Naive double, Sorted double"


def parse_seeds(text: str) -> list[int]:
    """Integers parted by white space, up to the first token that is none."""
    out = []
    for token in text.split():
        if not re.fullmatch(r"[+-]?\d+", token):
            break
        out.append(int(token))
    return out


def write_seeds(result: DataFrame, path: str, columns: int = 4, percent: bool = False) -> None:
    """Tab rows by step: seed, score, elapsed with two places and, of four columns, the diagnostic."""

    def two(c: str):
        return F.format_string("%.2f", F.col(c))

    tail = [F.concat(two("diag"), F.lit("%"))] if percent else [F.format_string("%.0f", F.col("diag"))]
    parts = [F.col("seed").cast("string"), two("score"), two("elapsed"), *(tail if columns == 4 else [])]
    result.orderBy("step").select(F.concat_ws("\t", *parts).alias("value")).coalesce(1).write.mode("overwrite").text(path)  # K rows


def result_lines(result: DataFrame, columns: int = 4, percent: bool = False) -> list[str]:
    """The K rows of a result as write_seeds writes them."""
    out = []
    for r in result.orderBy("step").collect():  # K rows
        tail = [f"{r.diag:.2f}%" if percent else f"{r.diag:.0f}"] if columns == 4 else []
        out.append("\t".join([str(r.seed), f"{r.score:.2f}", f"{r.elapsed:.2f}", *tail]))
    return out


def write_result_file(result: DataFrame, path: str, columns: int = 4, percent: bool = True, fill_rate: float | None = None) -> None:
    """One text file: a row for each seed and, if a fill rate is given, ``fillrate:`` with it as the last line."""
    from spreadlab.sources.files import open_binary

    lines = result_lines(result, columns, percent) + ([] if fill_rate is None else [f"fillrate:{fill_rate:.9g}"])
    with open_binary(path, "w") as f:
        f.write("".join(f"{x}\n" for x in lines).encode())


def read_fill_rates(spark: SparkSession, glob: str) -> DataFrame:
    """(Dataset, Setting, R, Approach, Fillrate) of files dataset_p_method_K_eps_R_sorted.txt whose last line is key:value.

    Files with another name or last line are left out.
    """
    lines = spark.read.text(glob, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("name"), F.split(F.regexp_replace("value", r"\s+$", ""), "\n").alias("x"))
    parts, last = F.split("name", "_"), F.split(F.element_at("x", -1), ":")
    rows = lines.where(F.size(parts) == 7).select(F.split(parts[0], r"\.")[0].alias("Dataset"), parts[1].alias("Setting"), F.expr("try_cast(split(name, '_')[5] as int)").alias("R"), F.when(parts[6] == "0", "Naive").when(parts[6] == "1", "Sorted").alias("Approach"), F.when(F.size(last) == 2, F.try_element_at(last, F.lit(2))).alias("rate"))
    return rows.withColumn("Fillrate", F.expr("try_cast(trim(rate) as double)")).drop("rate").where("Fillrate is not null and R is not null and Approach is not null")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Rows (tag, Split, Naive, Sorted) parted by blanks, without a header, with Dataset and Setting from the tag."""
    rows = spark.read.csv(path, sep=" ", schema=REPORT)
    tag = F.split("tag", "_")
    return rows.withColumn("Dataset", F.split(tag[0], r"\.")[0]).withColumn("Setting", F.get(tag, F.lit(1)))
