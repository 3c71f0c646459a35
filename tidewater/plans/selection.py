"""Selections under budgets: three parts of each brand, at most two of one type.

Prices are whole tenths, values whole hundredths of the mean quantity sold.  The
DuckDB statements try all triples, so they check the solver by brute force.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decision, selection
from ..session import table

SIZE, CAP, BUDGET = 3, 2, 28000
#: The kinds that the caps name.
KINDS = ["ECONOMY", "SMALL", "STANDARD", "MEDIUM", "LARGE", "PROMO"]


def pool(spark: SparkSession, sf_dir: str, risk: float = 0.0) -> DataFrame:
    """Parts with their mean quantity less ``risk`` standard deviations; parts that were never sold have no value."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_quantity").alias("mean"), F.coalesce(F.stddev_samp("l_quantity"), F.lit(0.0)).alias("sd"))
    value = F.round(F.round(100 * (F.col("mean") - risk * F.col("sd")), 4)).cast("long")
    return table(spark, sf_dir, "part").join(sold, "p_partkey").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("item"), F.col("p_type").alias("kind"), F.round(F.col("p_retailprice") * 10).cast("long").alias("price"), value.alias("value"))


def rules(items: DataFrame, size: int = SIZE, cap: int = CAP, budget=BUDGET) -> DataFrame:
    return items.select("grp").distinct().select("grp", F.lit(size).alias("size"), F.lit(cap).alias("cap"), (budget if not isinstance(budget, int) else F.lit(budget)).cast("long").alias("budget"))


def _listed() -> list:
    return [F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "value", "price"]


def select_budget_caps(spark, sf_dir):
    items = pool(spark, sf_dir)
    return selection.select(items, rules(items)).select("grp", "status", *_listed())


def infeasible_safe(spark, sf_dir):
    """The budget falls with the length of the brand's name; where none fits, the status says so and nothing is selected."""
    items = pool(spark, sf_dir)
    tight = F.when(F.length("grp") == 7, 20000).otherwise(BUDGET)
    return selection.select(items, rules(items, budget=tight)).select("grp", "status", *_listed())


def solver_record(spark, sf_dir):
    """What a selection has to say of itself; run times are left out, as they differ from run to run."""
    items = pool(spark, sf_dir)
    found = selection.select(items, rules(items))
    fixed = {"objective": "sum of values", "risk_measure": "none", "horizon": "1", "constraints": f"size {SIZE}, cap {CAP}, budget {BUDGET}", "solver": selection.SOLVER, "forecast": "mean quantity"}
    return found.select("grp", *[F.lit(v).alias(k) for k, v in fixed.items()], "status", F.when(F.col("status") == "optimal", 0.0).alias("gap"), "value")


SCENARIOS = [("base", 0.0, BUDGET), ("cautious", 0.5, BUDGET), ("rich", 0.0, 29900)]


def selection_sensitivity(spark, sf_dir):
    """The same selection under other risk and budget: which items change against the base."""
    runs = []
    for name, risk, budget in SCENARIOS:
        items = pool(spark, sf_dir, risk)
        runs.append(selection.select(items, rules(items, budget=budget)).select("grp", F.lit(name).alias("scenario"), "items", "value"))
    whole = reduce(DataFrame.unionByName, runs)
    base = runs[0].select("grp", F.col("items").alias("base"))
    return whole.join(base, "grp").select("grp", "scenario", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "value", F.size(F.array_except("items", "base")).cast("long").alias("changed"))


def selection_feasible(spark, sf_dir):
    """The solver's picks held against the rules by a query of its own: units, kinds and price of each group, and no row if all hold."""
    items = pool(spark, sf_dir)
    found = selection.select(items, rules(items)).filter("items is not null")
    picked = found.select("grp", F.explode("items").alias("item")).join(items, ["grp", "item"])
    facts = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), g.alias("grp"), x.alias("x")) for k, g, x in (("size", F.lit("all"), F.lit(1).cast("long")), ("kind", F.col("kind"), F.lit(1).cast("long")), ("price", F.lit("all"), F.col("price")))]))
    bounds = [("v1", "size", "all", SIZE, SIZE), ("v1", "price", "all", 0, BUDGET), *(("v1", "kind", k, 0, CAP) for k in KINDS)]
    broken = decision.broken_rules(picked.select(F.col("grp").alias("squad"), facts.alias("f")).select("squad", "f.*"), spark.createDataFrame(bounds, "rule_version string, kind string, grp string, lo long, hi long"), "squad")
    return found.join(broken.select(F.col("squad").alias("grp"), F.lit(1).alias("bad")).distinct(), "grp", "left").select("grp", F.col("bad").isNull().alias("feasible"))


def cvar_objective(spark, sf_dir):
    """Of each part the mean quantity, the mean less half a deviation, and the mean of its lowest fifth of sales."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_partkey").orderBy("l_quantity")
    sales = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", F.percent_rank().over(w).alias("r"))
    found = sales.groupBy(F.col("l_partkey").alias("item")).agg(F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("sd"), F.avg(F.when(F.col("r") <= 0.2, F.col("l_quantity"))).alias("cvar"))
    return found.select("item", F.round("mean", 6).alias("mean"), F.round(F.col("mean") - 0.5 * F.col("sd"), 6).alias("robust"), F.round("cvar", 6).alias("cvar"))


def bruteforce_triples(spark, sf_dir):
    """The solver against all triples on tiny instances: the nations of each region, all of them."""
    items = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("grp"), F.col("n_nationkey").cast("long").alias("item"), F.substring("n_name", 1, 1).alias("kind"), (F.col("n_nationkey") * 7 % 11 + 3).cast("long").alias("price"), (F.col("n_nationkey") * 5 % 13).cast("long").alias("value"))
    one, two, three = (items.select("grp", *[F.col(c).alias(f"{c}{k}") for c in ("item", "kind", "price", "value")]) for k in (1, 2, 3))
    triples = one.join(two, "grp").filter("item1 < item2").join(three, "grp").filter("item2 < item3 and price1 + price2 + price3 <= 24 and not (kind1 = kind2 and kind2 = kind3)")
    best = triples.groupBy("grp").agg(F.min(F.struct((-(F.col("value1") + F.col("value2") + F.col("value3"))).alias("v"), (F.col("price1") + F.col("price2") + F.col("price3")).alias("p"), F.array("item1", "item2", "item3").alias("items"))).alias("best"))
    solved = selection.select(items, rules(items, budget=24)).select("grp", "status", F.col("items").alias("chosen"))
    return solved.join(best, "grp", "left").select("grp", "status", F.array_join(F.col("best.items").cast("array<string>"), ",").alias("items"), F.col("chosen").eqNullSafe(F.col("best.items")).alias("agree"))


QUERIES = {f.__name__: f for f in (select_budget_caps, infeasible_safe, solver_record, selection_sensitivity, selection_feasible, cvar_objective, bruteforce_triples)}


def _pool(risk: float) -> str:
    return f"(SELECT p_brand AS grp, p_partkey AS item, p_type AS kind, round(p_retailprice * 10)::BIGINT AS price, round(round(100 * (mean - {risk} * sd), 4))::BIGINT AS value FROM part JOIN (SELECT l_partkey, avg(l_quantity) AS mean, coalesce(stddev_samp(l_quantity), 0) AS sd FROM lineitem GROUP BY 1) s ON l_partkey = p_partkey)"


def _best(name: str, risk: float = 0.0, budget: str = str(BUDGET)) -> str:
    return f"""{name}_i AS {_pool(risk)}, {name}_t AS (SELECT a.grp, a.item::VARCHAR || ',' || b.item || ',' || c.item AS items, a.value + b.value + c.value AS value, a.price + b.price + c.price AS price, a.item AS x, b.item AS y, c.item AS z
      FROM {name}_i a JOIN {name}_i b ON a.grp = b.grp AND a.item < b.item JOIN {name}_i c ON b.grp = c.grp AND b.item < c.item WHERE NOT (a.kind = b.kind AND b.kind = c.kind) AND a.price + b.price + c.price <= {budget}),
      {name} AS (SELECT grp, items, value, price FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY value DESC, price, x, y, z) AS r FROM {name}_t) q WHERE r = 1)"""


_ALL = "SELECT g.grp, CASE WHEN b.grp IS NULL THEN 'infeasible' ELSE 'optimal' END AS status, items, value::BIGINT AS value, price::BIGINT AS price FROM (SELECT DISTINCT grp FROM b_i) g LEFT JOIN b USING (grp)"
ORACLE = {
    "select_budget_caps": f"WITH {_best('b')} {_ALL}",
    "infeasible_safe": f"WITH {_best('b', budget='CASE WHEN length(a.grp) = 7 THEN 20000 ELSE 28000 END')} {_ALL}",
    "solver_record": f"WITH {_best('b')}, s AS ({_ALL}) SELECT grp, 'sum of values' AS objective, 'none' AS risk_measure, '1' AS horizon, 'size {SIZE}, cap {CAP}, budget {BUDGET}' AS constraints, '{selection.SOLVER}' AS solver, 'mean quantity' AS forecast, status, CASE WHEN status = 'optimal' THEN 0.0::DOUBLE END AS gap, value FROM s",
    "selection_sensitivity": "WITH " + ", ".join(_best(f"s{k}", risk, str(budget)) for k, (_, risk, budget) in enumerate(SCENARIOS)) + ", w AS (" + " UNION ALL ".join(f"SELECT grp, '{name}' AS scenario, items, value FROM s{k}" for k, (name, _, _) in enumerate(SCENARIOS)) + ") SELECT w.grp, scenario, w.items, w.value::BIGINT AS value, len(list_filter(string_split(w.items, ','), lambda x: NOT list_contains(string_split(s0.items, ','), x)))::BIGINT AS changed FROM w JOIN s0 USING (grp)",
    "selection_feasible": f"WITH {_best('b')} SELECT grp, true AS feasible FROM b",
    "cvar_objective": "WITH s AS (SELECT l_partkey, l_quantity, percent_rank() OVER (PARTITION BY l_partkey ORDER BY l_quantity) AS r FROM lineitem) SELECT l_partkey AS item, round(avg(l_quantity), 6) AS mean, round(avg(l_quantity) - 0.5 * stddev_samp(l_quantity), 6) AS robust, round(avg(l_quantity) FILTER (r <= 0.2), 6) AS cvar FROM s GROUP BY 1",
    "bruteforce_triples": "WITH i AS (SELECT n_regionkey::VARCHAR AS grp, n_nationkey AS item, n_name[1] AS kind, n_nationkey * 7 % 11 + 3 AS price, n_nationkey * 5 % 13 AS value FROM nation), t AS (SELECT a.grp, a.item::VARCHAR || ',' || b.item || ',' || c.item AS items, row_number() OVER (PARTITION BY a.grp ORDER BY a.value + b.value + c.value DESC, a.price + b.price + c.price, a.item, b.item, c.item) AS r FROM i a JOIN i b ON a.grp = b.grp AND a.item < b.item JOIN i c ON b.grp = c.grp AND b.item < c.item WHERE a.price + b.price + c.price <= 24 AND NOT (a.kind = b.kind AND b.kind = c.kind)) SELECT g.grp, CASE WHEN t.grp IS NULL THEN 'infeasible' ELSE 'optimal' END AS status, items, true AS agree FROM (SELECT DISTINCT grp FROM i) g LEFT JOIN t ON t.grp = g.grp AND r = 1",
}
