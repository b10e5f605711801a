"""The registered queries on graphs, each over whole tables, and DuckDB SQL for the same rows.

The graph is customers and suppliers: an arc each way for every (customer, supplier) that share a line item, weighted by
how often they do.  Customers are kept apart by an offset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlab.functions import hashing as H
from spreadlab.operators import chains, contraction, packed, prep, sampling, select, sketch
from spreadlab.operators import spread as S
from spreadlab.plans import experiments
from spreadlab.session import spool

OFFSET, P, SIMS, SEEDS = 1_000_000, 0.002, 8, (1, 2, 3)
#: Line items for each task that joins or counts pairs.
ROWS = 1_000_000

# ---- Spark ----------------------------------------------------------------------------------


def tasks(spark: SparkSession, d: str) -> int:
    """So many tasks that each has about ROWS line items, however many there are."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").count()  # from the files' footers
    return max(spark.sparkContext.defaultParallelism, -(-lines // ROWS))


def pairs(spark: SparkSession, d: str, parts: int | None = None) -> DataFrame:
    """(line, s, t) of each line item; parts: so many tasks share the join, ``tasks`` if not given."""
    parts = tasks(spark, d) if parts is None else parts
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey").repartition(parts, "o_orderkey")
    items = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_linenumber").repartition(parts, "l_orderkey")
    return orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), (F.col("o_custkey") + OFFSET).alias("s"), F.col("l_suppkey").alias("t"))


def half(spark: SparkSession, d: str) -> DataFrame:
    """(s, t, c) of each pair once, joined and counted by ``tasks``."""
    parts = tasks(spark, d)
    return prep.unordered(pairs(spark, d, parts), parts)


def counted(spark: SparkSession, d: str, known: DataFrame | None = None) -> DataFrame:
    return prep.both_ways(half(spark, d) if known is None else known)


def arcs(spark: SparkSession, d: str, p: float = P, known: DataFrame | None = None) -> DataFrame:
    return sampling.graph(prep.weigh_constant(counted(spark, d, known), p))


def vertices(spark: SparkSession, d: str, known: DataFrame | None = None) -> DataFrame:
    return (pairs(spark, d) if known is None else known).select(F.explode(F.array("s", "t")).alias("id")).distinct()


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Arcs and vertices (a written table) of pairs that are joined and counted once; arcs are made as they are read, from half as many rows."""
    known = spool(half(spark, d), "pairs")
    return arcs(spark, d, known=known), spool(vertices(spark, d, known), "vertices")


def live(spark: SparkSession, d: str, p: float = P, n: int = SIMS, in_order: bool = False) -> DataFrame:
    return sampling.live_edges(arcs(spark, d, p), sampling.seeds(spark, n, in_order=in_order))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    comment = F.when(F.col("l_linenumber") == 1, "# ").when((F.col("l_linenumber") == 2) & (F.col("l_returnflag") == "R"), "% ").otherwise(" ")
    value = F.concat(comment, F.col("l_suppkey").cast("string"), F.lit("\t "), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") == 3, " 7").otherwise(" "))
    return rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), value.alias("value"))


def _relabelled(spark: SparkSession, d: str) -> DataFrame:
    parts = tasks(spark, d)
    known = pairs(spark, d, parts)
    return prep.multiplicity(prep.relabel(known, prep.dense_ids(known)), parts)


def _greedy(result: DataFrame) -> DataFrame:
    return result.select("step", "seed", F.round("score", 6).alias("score"))


def _select(method: Callable, k: int = 3, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _greedy(method(*graph(spark, d), sampling.seeds(spark, SIMS), k, **options))


def _labels(spark: SparkSession, d: str, both_ways: bool = False) -> DataFrame:
    return S.min_labels(live(spark, d), both_ways)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    labels = spool(_labels(spark, d))
    return S.vertex_gains(labels, S.component_sizes(labels), vertices(spark, d), SIMS)


def _registers(spark: SparkSession, d: str, kind: Callable = sketch.registers) -> DataFrame:
    return kind(spool(vertices(spark, d)), sampling.seeds(spark, SIMS), SIMS)


def _words(spark: SparkSession, d: str, n: int = SIMS) -> DataFrame:
    return spool(packed.live_words(arcs(spark, d), sampling.seeds(spark, n)), "words")


def _cascade_words(spark: SparkSession, d: str) -> DataFrame:
    """128 simulations in two words from first round to last."""
    start = packed.pack(S.at_seeds(list(SEEDS), sampling.seeds(spark, 128)), "v")
    out = packed.cascade(packed.adjacency(_words(spark, d, 128)), start)
    return out.select("v", F.col("grp").cast("long").alias("grp"), "word", F.bit_count("word").cast("long").alias("sims"))


def _estimates_lanes(spark: SparkSession, d: str) -> DataFrame:
    """256 registers of a vertex in four rows; the mask has every third simulation."""
    edges, ids = graph(spark, d)
    words = spool(packed.live_words(edges, sampling.seeds(spark, 256)), "words")
    reg = packed.propagate(packed.registers(ids, 256), packed.adjacency(words, "v", "u"), "max")
    return packed.estimates(reg, {r: 4 for r in range(0, 256, 3)}, 256)


def _registers_again(spark: SparkSession, d: str) -> DataFrame:
    """Registers without what a first seed and then two more reach, made anew where these can matter."""
    edges, ids = graph(spark, d)
    words = spool(packed.live_words(edges, sampling.seeds(spark, SIMS)), "words")
    first, forward, back = spool(packed.registers(ids, SIMS)), packed.adjacency(words), packed.adjacency(words, "v", "u")
    reg, gone = packed.propagate(first, back, "max"), None
    for seeds in (SEEDS[:1], SEEDS[1:]):
        before = gone
        gone = packed.cascade(forward, packed.pack(S.at_seeds(list(seeds), sampling.seeds(spark, SIMS)), "v"), before)
        reg, _ = packed.rebuilt(reg, first, forward, back, packed.newly(gone, before), gone)
    return packed.to_rows(reg, "max", "int")


def _propagated(spark: SparkSession, d: str, blocked: tuple = ()) -> DataFrame:
    edges = spool(live(spark, d))
    gone = S.cascade(edges, S.at_seeds(list(blocked), sampling.seeds(spark, SIMS))) if blocked else None
    return sketch.propagate_registers(_registers(spark, d), edges, gone)


def _cascade(spark: SparkSession, d: str, seeds: tuple, rounds: int | None = None) -> DataFrame:
    return S.cascade(spool(live(spark, d)), S.at_seeds(list(seeds), sampling.seeds(spark, SIMS)), max_rounds=rounds)


def _lanes(sims: DataFrame) -> DataFrame:
    """sims, with the 32 that a simulation is one of."""
    return sims.withColumn("g", F.floor(F.col("r") / 32))


def _both_orders(spark: SparkSession, n: int) -> DataFrame:
    """(r, x, g, Approach): n simulations as they come, and by their numbers."""
    naive, ordered = (_lanes(sampling.seeds(spark, n, in_order=k)) for k in (False, True))
    return naive.withColumn("Approach", F.lit("Naive")).unionByName(ordered.withColumn("Approach", F.lit("Sorted")))


def _fill(spark: SparkSession, d: str, in_order: bool) -> DataFrame:
    sims = _lanes(sampling.seeds(spark, 64, in_order=in_order))
    return sampling.fill_rates(sampling.filled_groups(arcs(spark, d, 0.01), sims, "g")).select("filled", "taken", F.round("fill_rate", 9).alias("fill_rate"))


def _fill_table(spark: SparkSession, d: str) -> DataFrame:
    """(Dataset, Setting, R, Approach, Fillrate): fill rates of the arcs of each nation's suppliers."""
    edges = arcs(spark, d, 0.01)
    nation = spark.read.parquet(f"{d}/supplier.parquet").join(F.broadcast(spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("u"), F.col("n_name").alias("Dataset"))
    own = edges.join(nation.hint("shuffle_hash"), "u")  # a task holds its suppliers, and edges pass by unsorted, whatever their number
    rates = sampling.fill_rates(sampling.filled_groups(own, _both_orders(spark, 64), "Approach", "g"), "Dataset", "Approach").where("taken > 0")
    return rates.select("Dataset", F.lit("0.01").alias("Setting"), F.lit(64).alias("R"), "Approach", F.col("fill_rate").alias("Fillrate"))


def _pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = experiments.named(experiments.chosen(_fill_table(spark, d), 64), {"FRANCE": "Frankreich", "GERMANY": "Deutschland"})
    return experiments.pivot_means(rows, "Approach", "rate", "Fillrate").withColumn("rate", F.round(experiments.clipped("rate"), 9))


def _pruned(spark: SparkSession, d: str) -> DataFrame:
    return sampling.prune(arcs(spark, d), sampling.seeds(spark, SIMS), 4)


def _packed(spark: SparkSession, d: str) -> DataFrame:
    word = F.bit_or(F.expr("shiftleft(1L, r)"))
    return _cascade(spark, d, SEEDS).groupBy("v").agg(word.alias("word")).select("v", "word", F.bit_count("word").cast("long").alias("sims"))


def _live_by_seed(spark: SparkSession, d: str, sims: DataFrame) -> DataFrame:
    """(r, x, n): the edges that are live for each number."""
    n = sampling.live_edges(arcs(spark, d), sims).groupBy("r").agg(F.count("*").alias("n"))
    return sims.join(n, "r", "left").select("r", "x", F.coalesce("n", F.lit(0)).alias("n"))


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    """The fill rate for each combination of two numbers of simulations and two orders."""
    edges = spool(arcs(spark, d, 0.01))

    def run(p: dict) -> dict:
        return {"filled": sampling.fill_rate(sampling.live_edges(edges, sampling.seeds(spark, p["n_sims"], in_order=bool(p["in_order"])))).first().filled}

    rows = experiments.sweep([r.asDict() for r in experiments.combinations(spark, n_sims=[32, 64], in_order=[0, 1]).collect()], run)  # the caller's four
    return spark.createDataFrame(rows, "n_sims long, in_order long, filled long").coalesce(1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_lines": lambda s, d: prep.clean(_lines(s, d)),
    "edge_multiplicity": lambda s, d: (lambda n: prep.multiplicity(pairs(s, d, n), n))(tasks(s, d)),
    "undirected_edges": counted,
    "dense_relabel": lambda s, d: prep.dense_ids(pairs(s, d)),
    "relabelled_edges": _relabelled,
    "graph_summary": lambda s, d: prep.summary(counted(s, d)),
    "weights_const": lambda s, d: prep.weigh_constant(counted(s, d), 0.05),
    "weights_uniform": lambda s, d: prep.weigh_uniform(counted(s, d), 0.0, 0.1),
    "weights_normal": lambda s, d: prep.weigh_normal(counted(s, d), 0.05, 0.025),
    "csr_offsets": lambda s, d: prep.csr_offsets(counted(s, d), vertices(s, d)),
    "edge_hash": lambda s, d: H.with_edge_hash(counted(s, d).select("s", "t"), "h", F.col("s"), F.col("t")),
    "edge_hash_symmetric": lambda s, d: H.with_edge_hash_undirected(counted(s, d).select("s", "t"), "h", F.col("s"), F.col("t")),
    "edge_hash_crc32c": lambda s, d: H.with_edge_hash_crc32c(counted(s, d).select("s", "t"), "h", F.col("s"), F.col("t")),
    "thresholds": lambda s, d: prep.weigh_constant(counted(s, d), P).select("s", "t", sampling.threshold(F.col("w")).alias("thr")),
    "seeds_sorted": lambda s, d: _live_by_seed(s, d, sampling.seeds(s, 256, in_order=True)),
    "live_edges": live,
    "partition_prune": lambda s, d: _pruned(s, d).select("part", "u", "v"),
    "sampled_ratio": lambda s, d: sampling.sampled_ratio(_pruned(s, d), arcs(s, d)).select("part", F.round("ratio", 9).alias("ratio")),
    "fill_rate_naive": lambda s, d: _fill(s, d, False),
    "fill_rate_sorted": lambda s, d: _fill(s, d, True),
    "cascade_single": lambda s, d: _cascade(s, d, SEEDS[:1]),
    "cascade_multi_seed": lambda s, d: _cascade(s, d, SEEDS),
    "cascade_by_hop": lambda s, d: _cascade(s, d, SEEDS, 2),
    "cascade_packed": _packed,
    "spread_oracle": lambda s, d: select.oracle(spool(arcs(s, d)), sampling.seeds(s, SIMS), list(SEEDS)),
    "label_propagation": _labels,
    "label_propagation_both_ways": lambda s, d: _labels(s, d, True),
    "component_sizes": lambda s, d: S.component_sizes(_labels(s, d)),
    "vertex_scores": _scores,
    "greedy_components_k3": _select(select.component_greedy),
    "greedy_components_reset_k3": _select(select.component_greedy, by_reset=True, batch=8),
    "registers_init": _registers,
    "registers_harmonic": lambda s, d: _registers(s, d, sketch.registers_harmonic).withColumn("val", F.round("val", 9)),
    "register_propagation": _propagated,
    "register_propagation_blocked": lambda s, d: _propagated(s, d, SEEDS),
    "sketch_estimates": lambda s, d: sketch.estimates(_propagated(s, d), {r: 3 for r in range(0, SIMS, 2)}, SIMS),
    "sketch_estimates_harmonic": lambda s, d: sketch.estimates_harmonic(_registers(s, d, sketch.registers_harmonic)).withColumn("estimate", F.round("estimate", 9)),
    "sketch_argmax": lambda s, d: sketch.estimates(_propagated(s, d), {}, SIMS).orderBy(F.desc("total"), "u").limit(1),
    "sketch_greedy_k3": _select(select.sketch_greedy),
    "sketch_greedy_always_rebuild_k3": _select(select.sketch_greedy, rebuild="always"),
    "sketch_greedy_partitioned_k3": _select(select.sketch_greedy, rebuild="always", early_stop=1.001, parts=4),
    "mix_greedy_k3": _select(select.mix_greedy),
    "fillrate_pivot_margins": _pivot,
    "param_sweep": _sweep,
    "cascade_by_rounds": _cascade_words,
    "labels_by_rounds": lambda s, d: packed.min_labels(_words(s, d)),
    "labels_by_rounds_both_ways": lambda s, d: packed.min_labels(_words(s, d), True),
    "labels_by_contraction": lambda s, d: contraction.weak_labels(spool(live(s, d))),
    "labels_by_chains": lambda s, d: chains.directed_labels(spool(live(s, d))),
    "sketch_estimates_by_rounds": _estimates_lanes,
    "registers_rebuilt": _registers_again,
    "greedy_components_by_rounds_k3": _select(select.component_greedy, local=False),
    "greedy_components_index_k3": _select(select.component_greedy_indexed),
    "sketch_greedy_by_rounds_k3": _select(select.sketch_greedy, local=False),
    "mix_greedy_by_rounds_k3": _select(select.mix_greedy, local=False),
}

# ---- DuckDB ---------------------------------------------------------------------------------


def sql_fmix64(x: str) -> str:
    """fmix64 of an SQL expression, as UBIGINT."""
    h = f"({x})::UBIGINT"
    for k in H.FMIX:
        h = f"((xor({h}, {h} >> 33))::UHUGEINT * {k}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"xor({h}, {h} >> 33)"


def sql_fmix31(x: str) -> str:
    return f"(({sql_fmix64(x)}) & 2147483647)::BIGINT"


def sql_edge(u: str, v: str) -> str:
    return f"{u}::UBIGINT * 4294967296 + {v}::UBIGINT"


def sql_crc32c(u: str, v: str) -> str:
    table = f"[{', '.join(map(str, H.crc32c_table()))}]"

    def step(c: str) -> str:
        return f"list_transform([{c}], lambda q: xor({table}[(q & 255)::INT + 1]::BIGINT, q >> 8))[1]"

    c = f"xor(0::BIGINT, {u}::BIGINT)"
    for _ in range(4):
        c = step(c)
    c = f"xor({c}, {v}::BIGINT)"
    for _ in range(4):
        c = step(c)
    return f"({c}) >> 1"


def _weight(p: str) -> str:
    return f"round(1.0 - pow(1.0 - ({p}), c::DOUBLE), 4)"


def _thr(w: str) -> str:
    return f"least(floor(({w})::FLOAT::DOUBLE * 2147483648.0), 2147483648)::BIGINT"


PAIRS = f"pairs AS (SELECT l_orderkey * 8 + l_linenumber AS line, o_custkey + {OFFSET} AS s, l_suppkey AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
COUNTED = f"{PAIRS}, counted AS (SELECT s, t, count(*) AS c FROM (SELECT s, t FROM pairs UNION ALL SELECT t, s FROM pairs) GROUP BY s, t)"
VERTICES = "vertices AS (SELECT DISTINCT s AS id FROM counted)"


def _arcs(p: float = P) -> str:
    return f"{COUNTED}, arcs AS (SELECT s AS u, t AS v, {_thr(_weight(str(p)))} AS thr, {sql_fmix31(sql_edge('s', 't'))} AS h FROM counted)"


def _sims(n: int = SIMS, in_order: bool = False) -> str:
    x = sql_fmix31("r + 1")
    order = "row_number() OVER (ORDER BY x) - 1" if in_order else "r"
    return f"sims AS (SELECT ({order})::INT AS r, x FROM (SELECT r, {x} AS x FROM range({n}) q(r)))"


def _live(p: float = P, n: int = SIMS, in_order: bool = False) -> str:
    return f"{_arcs(p)}, {_sims(n, in_order)}, live AS (SELECT u, v, r FROM arcs JOIN sims ON xor(x, h) < thr)"


#: reach (src, v, r): v is reached from src, each vertex from itself.
REACH = f"""{_live()}, {VERTICES},
walk AS (SELECT DISTINCT u AS src, u AS v, r FROM live UNION SELECT walk.src, live.v, walk.r FROM walk JOIN live ON walk.v = live.u AND walk.r = live.r),
reach AS (SELECT src, v, r FROM walk UNION SELECT id, id, r FROM vertices, sims)"""
LABELS = f"{REACH}, labels AS (SELECT v, r, min(src) AS label FROM reach GROUP BY v, r), sizes AS (SELECT r, label, count(*) AS cnt FROM labels GROUP BY r, label)"
#: Vertices with a live edge, which alone have rows in the sparse tables.
ENDS = "ends AS (SELECT u AS v, r FROM live UNION SELECT v, r FROM live)"
REG = f"{REACH}, reg0 AS (SELECT id AS x, r, (CASE WHEN h = 0 THEN 64 ELSE 64 - length(bin(h)) END)::INT AS val FROM (SELECT id, r, {sql_fmix64(f'18446744073709551615 - (id * {SIMS} + r + {SIMS})::UBIGINT')} AS h FROM vertices, sims)), reg AS (SELECT src AS x, reach.r, max(val) AS val FROM reach JOIN reg0 ON reg0.x = reach.v AND reg0.r = reach.r GROUP BY src, reach.r)"


def _seed_list(seeds: tuple) -> str:
    return ", ".join(map(str, seeds))


def _reg_of(n: int) -> str:
    """REG with n simulations, from what each vertex reaches."""
    return f"""{_live(P, n)}, {VERTICES},
walk AS (SELECT DISTINCT u AS src, u AS v, r FROM live UNION SELECT walk.src, live.v, walk.r FROM walk JOIN live ON walk.v = live.u AND walk.r = live.r),
reg0 AS (SELECT id AS x, r, (CASE WHEN h = 0 THEN 64 ELSE 64 - length(bin(h)) END)::INT AS val FROM (SELECT id, r, {sql_fmix64(f'18446744073709551615 - (id * {n} + r + {n})::UBIGINT')} AS h FROM vertices, sims)),
reg AS (SELECT x, r, max(val) AS val FROM (SELECT x, r, val FROM reg0 UNION ALL SELECT src, walk.r, val FROM walk JOIN reg0 ON reg0.x = walk.v AND reg0.r = walk.r) GROUP BY x, r)"""


def _from_seeds(n: int) -> str:
    """walk (v, r): what SEEDS reach in each of n simulations."""
    return f"{_live(P, n)}, walk AS (SELECT s::BIGINT AS v, r FROM (SELECT unnest([{_seed_list(SEEDS)}]) AS s), sims UNION SELECT live.v, live.r FROM walk JOIN live ON walk.v = live.u AND walk.r = live.r)"


def _harmonic() -> str:
    chain = [f"SELECT id, r, 0 AS k, 18446744073709551615 - (id * {SIMS} + r + {SIMS})::UBIGINT AS h FROM vertices, sims"]
    chain += [f"SELECT id, r, {k} AS k, {sql_fmix64('h')} AS h FROM h{k - 1}" for k in range(1, sketch.CHAIN + 1)]
    parts = ", ".join(f"h{k} AS ({q})" for k, q in enumerate(chain))
    every = " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(1, sketch.CHAIN + 1))
    return f"{COUNTED}, {VERTICES}, {_sims()}, {parts}, z AS (SELECT id, r, CASE WHEN h = 0 THEN 64 ELSE 64 - length(bin(h)) END AS z FROM ({every})), reg AS (SELECT id AS x, r, CASE WHEN min(z) = 0 THEN 0.0 ELSE {sketch.CHAIN} / sum(CASE WHEN z > 0 THEN 1.0::DOUBLE / z END) END AS val FROM z GROUP BY id, r)"


def _greedy_sql(prefix: str, gain: Callable[[int], str], after: Callable[[int], str], k: int = 3) -> str:
    """Unrolled greedy: gain(i) selects (v, total) given what after(j < i) has built; ties go to the least v."""
    parts = [prefix]
    for i in range(1, k + 1):
        taken = "".join(f" AND v <> (SELECT v FROM s{j})" for j in range(1, i))
        parts.append(f"s{i} AS (SELECT v, total FROM ({gain(i)}) WHERE true{taken} ORDER BY total DESC, v LIMIT 1)")
        parts.append(after(i))
    return f"WITH RECURSIVE {', '.join(x for x in parts if x)} "


def _components_k3() -> str:
    def gain(i: int) -> str:
        covered = "" if i == 1 else f" AND NOT EXISTS (SELECT 1 FROM covered{i - 1} k WHERE k.r = l.r AND k.label = l.label)"
        return f"SELECT q.id AS v, coalesce(total, 0) AS total FROM vertices q LEFT JOIN (SELECT l.v, sum(cnt) AS total FROM labels l JOIN sizes z ON l.r = z.r AND l.label = z.label WHERE true{covered} GROUP BY l.v) t ON q.id = t.v"

    def after(i: int) -> str:
        return f"covered{i} AS (SELECT r, label FROM labels WHERE v IN ({', '.join(f'(SELECT v FROM s{j})' for j in range(1, i + 1))}))"

    out = " UNION ALL ".join(f"SELECT {i - 1}::INT AS step, (SELECT v FROM s{i}) AS seed, round(({' + '.join(f'(SELECT total FROM s{j})' for j in range(1, i + 1))}) / {SIMS}.0, 6) AS score" for i in (1, 2, 3))
    return _greedy_sql(LABELS, gain, after) + out


def _mix_k3() -> str:
    def gain(i: int) -> str:
        seen = "" if i == 1 else f" WHERE NOT EXISTS (SELECT 1 FROM reach k WHERE k.r = a.r AND k.v = a.v AND k.src IN ({', '.join(f'(SELECT v FROM s{j})' for j in range(1, i))}))"
        return f"SELECT src AS v, count(*) AS total FROM reach a{seen} GROUP BY src"

    out = " UNION ALL ".join(f"SELECT {i - 1}::INT AS step, (SELECT v FROM s{i}) AS seed, round(({' + '.join(f'(SELECT total FROM s{j})' for j in range(1, i + 1))}) / {SIMS}.0, 6) AS score" for i in (1, 2, 3))
    return _greedy_sql(REACH, gain, lambda i: "") + out


def _sketch_k3(rebuild: str, k: int = 3) -> str:
    """Visited sets are closed under reachability, so what is blocked simply drops out of reach at both ends."""

    def gain(i: int) -> str:
        free = "" if i == 1 else f" WHERE NOT EXISTS (SELECT 1 FROM blocked{i - 1} b WHERE b.r = a.r AND (b.v = a.src OR b.v = a.v))"
        mask = "(SELECT 0::INT AS r, 0 AS low WHERE false)" if i == 1 else f"mask{i - 1}"
        reg = f"SELECT a.src AS x, a.r, max(val) AS val FROM reach a JOIN reg0 ON reg0.x = a.v AND reg0.r = a.r{free} GROUP BY a.src, a.r"
        return f"SELECT id AS v, sum(greatest(coalesce(val, 0), coalesce(low, 0))) AS total FROM vertices CROSS JOIN sims LEFT JOIN ({reg}) g ON g.x = id AND g.r = sims.r LEFT JOIN {mask} m ON m.r = sims.r GROUP BY id"

    def after(i: int) -> str:
        chosen = ", ".join(f"(SELECT v FROM s{j})" for j in range(1, i + 1))
        base = "0.0" if i == 1 else f"(SELECT base FROM st{i - 1})"
        est = f"pow(2.0, (SELECT total FROM s{i}) / {SIMS}.0)"
        rule = "true" if rebuild == "always" else f"({est} - (score - {base})) / (score - {base}) > 0.3 AND abs({est} - (score - {base})) / score > 0.01"
        before = "" if i == 1 else f" UNION ALL SELECT v, r FROM blocked{i - 1} WHERE NOT (SELECT again FROM st{i})"
        free = "" if i == 1 else f" AND NOT EXISTS (SELECT 1 FROM blocked{i - 1} b WHERE b.r = a.r AND (b.v = a.src OR b.v = a.v))"
        own = f"SELECT a.r, max(val) AS low FROM reach a JOIN reg0 ON reg0.x = a.v AND reg0.r = a.r WHERE a.src = (SELECT v FROM s{i}){free} GROUP BY a.r"
        old = "" if i == 1 else f" UNION ALL SELECT r, low FROM mask{i - 1}"
        return (
            f"vis{i} AS (SELECT DISTINCT v, r FROM reach WHERE src IN ({chosen})), "
            f"st{i} AS (SELECT score, {rule} AS again, CASE WHEN {rule} THEN score ELSE {base} END AS base FROM (SELECT count(*) / {SIMS}.0 AS score FROM vis{i})), "
            f"blocked{i} AS (SELECT v, r FROM vis{i} WHERE (SELECT again FROM st{i}){before}), "
            f"mask{i} AS (SELECT r, max(low) AS low FROM ({own}{old}) WHERE NOT (SELECT again FROM st{i}) GROUP BY r)"
        )

    out = " UNION ALL ".join(f"SELECT {i - 1}::INT AS step, (SELECT v FROM s{i}) AS seed, round((SELECT score FROM st{i}), 6) AS score" for i in range(1, k + 1))
    return _greedy_sql(REG, gain, after, k) + out


def _fill_sql(in_order: bool) -> str:
    return f"WITH {_live(0.01, 64, in_order)}, g AS (SELECT count(*) AS c FROM live GROUP BY u, v, r // 32) SELECT sum(c)::BIGINT AS filled, (count(*) * 32)::BIGINT AS taken, round(sum(c)::DOUBLE / (count(*) * 32), 9) AS fill_rate FROM g"


def _pivot_sql() -> str:
    live_two = f"{_arcs(0.01)}, {_sims(64)}, ordered AS (SELECT (row_number() OVER (ORDER BY x) - 1)::INT AS r, x FROM sims)"
    part = " UNION ALL ".join(f"SELECT '{name}' AS Approach, u, v, r // 32 AS g, count(*) AS c FROM arcs JOIN {table} q ON xor(x, h) < thr GROUP BY u, v, r // 32" for name, table in (("Naive", "sims"), ("Sorted", "ordered")))
    return f"""WITH {live_two}, groups AS ({part}),
rates AS (SELECT CASE n_name WHEN 'FRANCE' THEN 'Frankreich' WHEN 'GERMANY' THEN 'Deutschland' ELSE n_name END AS Dataset, '0.01' AS Setting, Approach, sum(c)::DOUBLE / (32 * count(*)) AS rate
  FROM groups JOIN supplier ON u = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)
SELECT Dataset, Setting, Approach, round(greatest(0.0, least(1.0, rate)), 9) AS rate FROM rates
UNION ALL SELECT 'Mean', Setting, Approach, round(greatest(0.0, least(1.0, avg(rate))), 9) FROM rates GROUP BY Setting, Approach"""


_PARTS = f"SELECT DISTINCT (r // {SIMS // 4})::INT AS part, u, v FROM live"
_UNIT = "({}) / 2147483648.0"
_HASHED = {k: _UNIT.format(sql_fmix31(f"xor({sql_edge('s', 't')}, {k}::UBIGINT)")) for k in (42, 43)}
_IDS = "pos AS (SELECT key, min(p) AS p FROM (SELECT s AS key, 2 * line AS p FROM pairs UNION ALL SELECT t, 2 * line + 1 FROM pairs) GROUP BY key), ids AS (SELECT key, row_number() OVER (ORDER BY p, key) - 1 AS id FROM pos)"


def _reached(seeds: tuple) -> str:
    return f"SELECT DISTINCT v, r FROM reach WHERE src IN ({_seed_list(seeds)})"


ORACLE_SQL: dict[str, str] = {
    "clean_lines": r"""WITH raw AS (SELECT l_orderkey * 8 + l_linenumber AS line, CASE WHEN l_linenumber = 1 THEN '# ' WHEN l_linenumber = 2 AND l_returnflag = 'R' THEN '% ' ELSE ' ' END || l_suppkey || chr(9) || ' ' || l_partkey || CASE WHEN l_linenumber = 3 THEN ' 7' ELSE ' ' END AS value FROM lineitem),
x AS (SELECT line, string_split(trim(regexp_replace(value, '\s+', ' ', 'g')), ' ') AS x FROM raw WHERE NOT regexp_matches(value, '[#%]')) SELECT line, x[1] AS s, x[2] AS t FROM x WHERE len(x) = 2""",
    "edge_multiplicity": f"WITH {PAIRS} SELECT s, t, count(*) AS c FROM pairs GROUP BY s, t",
    "undirected_edges": f"WITH {COUNTED} SELECT s, t, c FROM counted",
    "dense_relabel": f"WITH {PAIRS}, {_IDS} SELECT key, id FROM ids",
    "relabelled_edges": f"WITH {PAIRS}, {_IDS} SELECT a.id AS s, b.id AS t, count(*) AS c FROM pairs JOIN ids a ON s = a.key JOIN ids b ON t = b.key GROUP BY 1, 2",
    "graph_summary": f"WITH {COUNTED} SELECT greatest(max(s), max(t)) + 1 AS n, count(*) AS m FROM counted",
    "weights_const": f"WITH {COUNTED} SELECT s, t, c, {_weight('0.05')} AS w FROM counted",
    "weights_uniform": f"WITH {COUNTED} SELECT s, t, c, {_weight(f'greatest(0.0, least(0.1, 0.0 + 0.1::DOUBLE * {_HASHED[42]}))')} AS w FROM counted",
    "weights_normal": f"WITH {COUNTED} SELECT s, t, c, {_weight(f'greatest(0.0, least(1.0, 0.05::DOUBLE + 0.025::DOUBLE * sqrt(-2.0 * ln(1.0::DOUBLE - {_HASHED[42]})) * cos(2.0 * pi() * {_HASHED[43]})))')} AS w FROM counted",
    "csr_offsets": f"WITH {COUNTED}, {VERTICES}, d AS (SELECT id, coalesce(degree, 0) AS degree FROM vertices LEFT JOIN (SELECT s, count(*) AS degree FROM counted GROUP BY s) ON id = s) SELECT id, degree, (sum(degree) OVER (ORDER BY id) - degree)::BIGINT AS first FROM d",
    "edge_hash": f"WITH {COUNTED} SELECT s, t, {sql_fmix31(sql_edge('s', 't'))} AS h FROM counted",
    "edge_hash_symmetric": f"WITH {COUNTED} SELECT s, t, {sql_fmix31(sql_edge('least(s, t)', 'greatest(s, t)'))} AS h FROM counted",
    "edge_hash_crc32c": f"WITH {COUNTED} SELECT s, t, {sql_crc32c('s', 't')} AS h FROM counted",
    "thresholds": f"WITH {COUNTED} SELECT s, t, {_thr(_weight(str(P)))} AS thr FROM counted",
    "seeds_sorted": f"WITH {_live(P, 256, True)} SELECT sims.r, x, count(u) AS n FROM sims LEFT JOIN live ON sims.r = live.r GROUP BY sims.r, x",
    "live_edges": f"WITH {_live()} SELECT u, v, r FROM live",
    "partition_prune": f"WITH {_live()} {_PARTS}",
    "sampled_ratio": f"WITH {_live()}, p AS ({_PARTS}) SELECT part, round(count(*)::DOUBLE / (SELECT count(*) FROM arcs), 9) AS ratio FROM p GROUP BY part",
    "fill_rate_naive": _fill_sql(False),
    "fill_rate_sorted": _fill_sql(True),
    "cascade_single": f"WITH RECURSIVE {REACH} {_reached(SEEDS[:1])}",
    "cascade_multi_seed": f"WITH RECURSIVE {REACH} {_reached(SEEDS)}",
    "cascade_by_hop": f"WITH RECURSIVE {_live()}, h0 AS (SELECT s AS v, r FROM (SELECT unnest([{_seed_list(SEEDS)}]) AS s), sims), h1 AS (SELECT v, r FROM h0 UNION SELECT live.v, live.r FROM h0 JOIN live ON h0.v = live.u AND h0.r = live.r), h2 AS (SELECT v, r FROM h1 UNION SELECT live.v, live.r FROM h1 JOIN live ON h1.v = live.u AND h1.r = live.r) SELECT v::BIGINT AS v, r FROM h2",
    "cascade_packed": f"WITH RECURSIVE {REACH}, x AS ({_reached(SEEDS)}) SELECT v, bit_or(1::BIGINT << r) AS word, count(*) AS sims FROM x GROUP BY v",
    "spread_oracle": f"WITH RECURSIVE {REACH}, x AS ({_reached(SEEDS)}) SELECT count(*) / {SIMS}.0::DOUBLE AS spread FROM x",
    "label_propagation": f"WITH RECURSIVE {LABELS}, {ENDS} SELECT labels.v, labels.r, label FROM labels JOIN ends USING (v, r)",
    "label_propagation_both_ways": f"WITH RECURSIVE {_live()}, sym AS (SELECT u, v, r FROM live UNION SELECT v, u, r FROM live), walk AS (SELECT DISTINCT u AS src, u AS v, r FROM sym UNION SELECT walk.src, sym.v, walk.r FROM walk JOIN sym ON walk.v = sym.u AND walk.r = sym.r) SELECT v, r, min(src) AS label FROM walk GROUP BY v, r",
    "component_sizes": f"WITH RECURSIVE {LABELS}, {ENDS} SELECT r, label, count(*) AS cnt FROM labels JOIN ends USING (v, r) GROUP BY r, label",
    "vertex_scores": f"WITH RECURSIVE {LABELS} SELECT v, sum(cnt)::BIGINT AS total FROM labels JOIN sizes USING (r, label) GROUP BY v",
    "greedy_components_k3": _components_k3(),
    "greedy_components_reset_k3": _components_k3(),
    "registers_init": f"WITH RECURSIVE {REG} SELECT x, r, val FROM reg0",
    "registers_harmonic": f"WITH {_harmonic()} SELECT x, r, round(val, 9) AS val FROM reg",
    "register_propagation": f"WITH RECURSIVE {REG} SELECT x, r, val FROM reg",
    "register_propagation_blocked": f"WITH RECURSIVE {REG}, gone AS ({_reached(SEEDS)}) SELECT src AS x, a.r, max(val) AS val FROM reach a JOIN reg0 ON reg0.x = a.v AND reg0.r = a.r WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = a.r AND (gone.v = a.src OR gone.v = a.v)) GROUP BY src, a.r",
    "sketch_estimates": f"WITH RECURSIVE {REG} SELECT x AS u, sum(greatest(val, CASE WHEN r % 2 = 0 THEN 3 ELSE 0 END))::BIGINT AS total FROM reg GROUP BY x",
    "sketch_estimates_harmonic": f"WITH {_harmonic()} SELECT x AS u, CASE WHEN min(val) = 0 THEN 0.0 ELSE round(count(*) / sum(CASE WHEN val > 0 THEN 1.0::DOUBLE / val END), 9) END AS estimate FROM reg GROUP BY x",
    "sketch_argmax": f"WITH RECURSIVE {REG} SELECT x AS u, sum(val)::BIGINT AS total FROM reg GROUP BY x ORDER BY total DESC, u LIMIT 1",
    "sketch_greedy_k3": _sketch_k3("error"),
    "sketch_greedy_always_rebuild_k3": _sketch_k3("always"),
    "sketch_greedy_partitioned_k3": _sketch_k3("always"),
    "mix_greedy_k3": _mix_k3(),
    "fillrate_pivot_margins": _pivot_sql(),
    "param_sweep": " UNION ALL ".join(f"SELECT {n}::BIGINT AS n_sims, {order}::BIGINT AS in_order, (SELECT count(*) FROM (WITH {_live(0.01, n, bool(order))} SELECT u FROM live)) AS filled" for n in (32, 64) for order in (0, 1)),
    "cascade_by_rounds": f"WITH RECURSIVE {_from_seeds(128)} SELECT v, (r // 64)::BIGINT AS grp, (sum(CASE WHEN r % 64 = 63 THEN -9223372036854775808::HUGEINT ELSE (1::BIGINT << (r % 64))::HUGEINT END))::BIGINT AS word, count(*) AS sims FROM walk GROUP BY v, r // 64",
    "sketch_estimates_by_rounds": f"WITH RECURSIVE {_reg_of(256)} SELECT x AS u, sum(greatest(val, CASE WHEN r % 3 = 0 THEN 4 ELSE 0 END))::BIGINT AS total FROM reg GROUP BY x",
    "greedy_components_by_rounds_k3": _components_k3(),
    "greedy_components_index_k3": _components_k3(),
    "sketch_greedy_by_rounds_k3": _sketch_k3("error"),
    "mix_greedy_by_rounds_k3": _mix_k3(),
}
ORACLE_SQL |= {"labels_by_rounds": ORACLE_SQL["label_propagation"], "labels_by_rounds_both_ways": ORACLE_SQL["label_propagation_both_ways"], "labels_by_contraction": ORACLE_SQL["label_propagation_both_ways"], "labels_by_chains": ORACLE_SQL["label_propagation"], "registers_rebuilt": ORACLE_SQL["register_propagation_blocked"]}
