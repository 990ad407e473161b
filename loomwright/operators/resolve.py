"""What imported names stand for: exports through re-exports to a fixed point, and the targets of calls, by equi-joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.operators.graph import _cut


def exports(symbols: DataFrame, reexports: DataFrame, rounds: int = 1000) -> DataFrame:
    """Every name that a module gives: module, name, origin, origin_name (where it is declared).

    symbols: module, name, of what each module declares itself. reexports: module, target (a module), name (`*` for all), local.
    A round hands names on by one re-export; a name that a module has keeps its first origin, so circles end, and a module's own name beats any that it
    hands on, as does one that it names beside one that comes with all. Of origins found in one round the least counts. All but `default` goes with `*`.
    """
    at = symbols.select("module", "name").distinct().select("module", "name", F.col("module").alias("origin"), F.col("name").alias("origin_name"))
    known = fresh = _cut(at)
    links = _cut(reexports.where("module <> target").select("module", "target", "name", "local").distinct())
    named = links.where("name <> '*'").select(F.col("module").alias("to"), "target", F.col("name").alias("wanted"), "local").hint("merge")
    whole = links.where("name = '*'").select(F.col("module").alias("to"), "target").hint("merge")
    for k in range(rounds):
        given = fresh.withColumnRenamed("module", "target")
        one = given.join(named, "target").where(F.col("name") == F.col("wanted")).select(F.col("to").alias("module"), F.col("local").alias("name"), "origin", "origin_name", F.lit(0).alias("rank"))
        all_of = given.where("name <> 'default'").join(whole, "target").select(F.col("to").alias("module"), "name", "origin", "origin_name", F.lit(1).alias("rank"))
        found = one.unionByName(all_of).groupBy("module", "name").agg(F.min(F.struct("rank", "origin", "origin_name")).alias("o"))
        found = _cut(found.select("module", "name", "o.origin", "o.origin_name"))
        if found.isEmpty():
            return known
        had = known.select("module", "name").join(found.select("module", "name"), ["module", "name"], "left_semi")  # later rounds find little, which is then all that is sent about
        fresh = _cut(found.join(had, ["module", "name"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
        if k % 10 == 9:
            known = _cut(known)
    raise RuntimeError("re-exports did not settle")


def targets(calls: DataFrame, symbols: DataFrame, imports: DataFrame, exported: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """calls: module, callee (a dotted name) and others. Adds target_module, target, found: the first of

    local (the module declares the name), import (a named or default import of it, followed to its origin; `assumed` at the imported module where that gives no such
    name), namespace (a member of a module that is imported whole; one that it doesn't give is looked up among all, else assumed), global (one module for each name: of
    this batch before those stored, the least), and null. imports: module, target, name, local. stored: module, name, of modules outside the batch.
    """
    steps = F.split("callee", r"\.")
    asked = calls.withColumn("_root", steps[0])
    own = symbols.select("module", F.col("name").alias("_root"), F.lit(True).alias("_own")).distinct()
    asked = asked.join(own, ["module", "_root"], "left")
    given = imports.groupBy("module", F.col("local").alias("_root")).agg(F.min(F.struct("target", "name")).alias("_i"))
    asked = asked.join(given, ["module", "_root"], "left").withColumns({"_name": F.col("_i.name"), "_from": F.col("_i.target")})
    return settled(asked, calls.columns, symbols, exported, stored)


def settled(asked: DataFrame, columns: list[str], symbols: DataFrame, exported: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The last steps of `targets`, which returns `columns` and its own. asked: module, callee, _own (whether the module declares the callee's root), _from and _name (module and name of the import that gives the root, null if none does)."""
    index = symbols.select("module", "name", F.lit(0).alias("rank"))
    if stored is not None:
        index = index.unionByName(stored.select("module", "name", F.lit(1).alias("rank")))
    index = index.groupBy("name").agg(F.min(F.struct("rank", "module")).alias("g")).select(F.col("name").alias("g_name"), F.col("g.module").alias("g_module"))
    steps = F.split("callee", r"\.")
    plain, root, last = F.size(steps) == 1, steps[0], F.element_at(steps, -1)
    wanted = F.when(F.col("_name") == "*", F.when(~plain, last)).when(plain, F.col("_name"))
    asked = asked.withColumn("_wanted", wanted)
    of = exported.select(F.col("module").alias("_from"), F.col("name").alias("_wanted"), "origin", "origin_name").hint("merge")
    met = asked.where("_wanted IS NOT NULL AND _from IS NOT NULL").join(of, ["_from", "_wanted"], "left")
    met = met.unionByName(asked.where("_wanted IS NULL OR _from IS NULL"), allowMissingColumns=True)
    known, whole = F.col("origin").isNotNull(), F.coalesce(F.col("_name") == "*", F.lit(False))
    local, asks = F.coalesce("_own", F.lit(False)) & plain, F.col("_wanted").isNotNull()
    met = _cut(met.withColumn("found", F.when(local, "local").when(asks & known & whole, "namespace").when(asks & known, "import").when(asks & ~whole, "assumed")))
    # what is left is looked up among all names
    rest = met.where("found IS NULL").join(index.hint("merge"), last == F.col("g_name"), "left")
    rest = rest.withColumn("found", F.when(F.col("g_module").isNotNull(), "global").when(asks, "assumed"))
    found = F.col("found")
    pick = lambda l, o, a, g: F.when(found == "local", l).when(found.isin("namespace", "import"), o).when(found == "assumed", a).when(found == "global", g)  # noqa: E731, E741
    met = met.where("found IS NOT NULL").unionByName(rest, allowMissingColumns=True)
    return met.select(*columns, pick(F.col("module"), F.col("origin"), F.col("_from"), F.col("g_module")).alias("target_module"), pick(root, F.col("origin_name"), F.col("_wanted"), last).alias("target"), "found")
