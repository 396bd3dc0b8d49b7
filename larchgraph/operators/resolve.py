"""Calls to the functions they name: guarded joins over the facts of extract.facts.

A call keeps its first applicable rule and gives no edge where that rule has several answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchgraph.functions import paths as P
from larchgraph.functions.tables import stored
from larchgraph.operators import names as N
from larchgraph.operators.joins import unique_ids

CALL = ["project_id", "path", "pos"]


def functions(facts: DataFrame) -> DataFrame:
    """(project_id, id, name, file, line, complexity, and what resolution reads) of all definitions."""
    defs = facts.filter("fact = 'def'").withColumn("_base", F.concat("path", F.lit("#"), "display"))
    df = unique_ids(defs, ["project_id", "path"], "_base", "line", ["pos"], bounded=True)
    return df.select("project_id", F.col("uid").alias("id"), "name", F.col("path").alias("file"), "line", "complexity", "body", "owner", "display", "lang", "pos")


def python_modules(facts: DataFrame) -> DataFrame:
    """(project_id, path, package, module): each Python file's names: dotted path, and the part of it
    below the last folder that is no package. package is the folder part of the latter."""
    files = facts.filter("fact = 'file' and lang = 'python'").select("project_id", "path")
    packages = files.filter(F.col("path").rlike(r"(^|/)__init__\.pyi?$")).select("project_id", P.dir_of(F.col("path")).alias("dir")).distinct().withColumn("is_package", F.lit(True))
    parts = F.filter(F.split(P.dir_of(F.col("path")), "/"), lambda x: x != "")
    up = files.select("project_id", "path", parts.alias("parts"), F.explode(F.sequence(F.lit(0), F.size(parts))).alias("n"))
    up = up.withColumn("dir", F.array_join(F.slice("parts", 1, F.col("n")), "/")).join(packages, ["project_id", "dir"], "left")
    # folders below the deepest one that is no package (the root never is) make the package
    top = up.filter("is_package is null").groupBy("project_id", "path").agg(F.max("n").alias("n"), F.first("parts").alias("parts"))
    stem = F.regexp_replace(P.basename(F.col("path")), r"\.pyi?$", "")
    package = F.slice("parts", F.col("n") + 1, F.size("parts"))
    tail = F.when(stem == "__init__", F.array().cast("array<string>")).otherwise(F.array(stem))
    names = F.array_distinct(F.array(F.array_join(F.concat(package, tail), "."), F.array_join(F.concat("parts", tail), ".")))
    return top.select("project_id", "path", package.alias("package"), F.explode(names).alias("module"))


def _only(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and dst, null where several targets compete."""
    return df.groupBy(*keys).agg(F.when(F.count_distinct("dst") == 1, F.min("dst")).alias("dst"))


def links(facts: DataFrame) -> DataFrame:
    """The links of scripts among the facts, as operators.names reads them."""
    return facts.filter("fact = 'link'").select("project_id", "path", F.col("owner").alias("kind"), "pos", "name", F.col("bound_module").alias("spec"), F.col("bound_name").alias("symbol"))


def script_calls(facts: DataFrame, c: DataFrame, target: DataFrame) -> DataFrame:
    """(CALL, dst) of the calls c of scripts. A name stands for what its scope says, over imports,
    re-exports and aliases of any length; `this` and a class or its instance for the class's method, or
    for that of a class which it extends. A call that names nothing known goes to the project's only
    function of the name, else to the first one of its file; methods do not count there."""
    mine = target.filter("t_lang = 'js'")
    link = stored(links(facts))
    files = facts.filter("fact = 'file'").select("project_id", "path").distinct()
    away = c.filter("bound_name is not null").select(*CALL, "name", "receiver", N.node("L", "path", "bound_name").alias("node"))
    found = N.ends(link, files)
    # ns.f(): ns leads to a module, whose export f is looked up in turn
    led = stored(N.at_end(away, "node", found))
    members = led.filter("kind = 'M' and receiver is not null").select(*CALL, N.node("E", "at", "name").alias("node"))
    if members.limit(1).count():
        more = N.ends(link, files, members)
        led = led.filter("kind <> 'M' or receiver is null").drop("node").unionByName(N.at_end(members.withColumns({"name": F.lit(None).cast("string"), "receiver": F.lit(None).cast("string")}), "node", more).drop("node"))
    whole = led.filter("kind = 'M' and receiver is null").select(*CALL, "name", "receiver", N.node("E", "at", F.lit("default")).alias("node"))
    led = led.filter("kind <> 'M'").select(*CALL, "name", "receiver", "kind", "at", "of").unionByName(N.at_end(whole, "node", found).select(*CALL, "name", "receiver", "kind", "at", "of"))
    plain = mine.filter("t_owner is null").groupBy("project_id", "t_path", "t_name").agg(F.min_by("dst", "t_pos").alias("dst"))
    place = [F.col("at") == F.col("t_path"), F.col("of") == F.col("t_name"), led["project_id"] == plain["project_id"]]
    named = led.filter("receiver is null and kind <> 'M'").join(plain, place).select(*[led[k] for k in CALL], "dst")
    # methods: of the class that `this` or the receiver's name stands for, or of a class above it
    methods = mine.filter("t_owner is not null").groupBy("project_id", F.col("t_path").alias("b"), F.col("t_owner").alias("_class"), F.col("t_name").alias("name")).agg(F.min_by("dst", "t_pos").alias("dst"))
    methods = methods.select("project_id", N.node("L", "b", "_class").alias("b"), "name", "dst")
    own = c.filter("receiver = 'this' and owner is not null").select(*CALL, "name", N.node("L", "path", "owner").alias("a"))
    own = own.unionByName(led.filter("receiver is not null and kind = 'L'").select(*CALL, "name", N.node("L", "at", "of").alias("a")))
    based = N.at_end(link.filter("kind = 'base'").select("project_id", N.node("L", "path", "name").alias("a"), N.node("L", "path", "symbol").alias("node")), "node", found)
    above = N.closure(based.filter("kind = 'L'").select("project_id", "a", N.node("L", "at", "of").alias("b"), F.lit(0).alias("n")))
    up = own.select(*CALL, "name", "a", F.col("a").alias("b"), F.lit(0).alias("_steps")).unionByName(own.join(above, ["project_id", "a"]).select(*CALL, "name", "a", "b", F.size("way").alias("_steps")))
    method = up.join(methods, ["project_id", "b", "name"]).groupBy(*CALL).agg(F.min_by("dst", F.struct("_steps", "dst")).alias("dst"))
    sure = named.unionByName(method.select(*CALL, "dst")).groupBy(*CALL).agg(F.min("dst").alias("far"))
    here = mine.select("project_id", F.col("t_path").alias("path"), F.col("t_pos").alias("target"), F.col("dst").alias("near"))
    anywhere = mine.groupBy("project_id", F.col("t_display").alias("name")).agg(F.when(F.count("*") == 1, F.min("dst")).alias("only"))
    first = mine.groupBy("project_id", F.col("t_path").alias("path"), F.col("t_display").alias("name")).agg(F.min_by("dst", "t_pos").alias("first"))
    out = c.join(here, ["project_id", "path", "target"], "left").join(sure, CALL, "left").join(anywhere, ["project_id", "name"], "left").join(first, ["project_id", "path", "name"], "left")
    return out.select(*CALL, F.coalesce("near", "far", "only", "first").alias("dst"))


def calls(facts: DataFrame) -> DataFrame:
    """(project_id, src, dst, kind, resolution, pos) of every call that is resolved."""
    fns = functions(facts)
    c = facts.filter("fact = 'call'").select(*CALL, "lang", "caller", "owner", "name", "receiver", "bound_module", "bound_name", "level", "target", "awaited")
    src = fns.select("project_id", F.col("file").alias("path"), F.col("pos").alias("caller"), F.col("id").alias("src"))
    c = c.join(src, ["project_id", "path", "caller"])
    target = fns.select("project_id", F.col("file").alias("t_path"), F.col("name").alias("t_name"), F.col("display").alias("t_display"), F.col("owner").alias("t_owner"), F.col("lang").alias("t_lang"), F.col("pos").alias("t_pos"), F.col("id").alias("dst"))
    js, py = F.col("lang") == "js", F.col("lang") == "python"
    own = F.coalesce(F.col("receiver").isin("this", "self"), F.lit(False))

    a = script_calls(facts, c.filter(js), target).withColumn("resolution", F.lit(None).cast("string"))

    # other languages: Owner.name or receiver.name, the file's only one, else the only one at all
    other = c.filter(~js & ~py)
    qualified = F.when(own | F.col("receiver").isNull(), F.concat_ws(".", "owner", "name")).otherwise(F.concat_ws(".", "receiver", "name"))
    named = other.withColumn("t_display", F.when(F.col("owner").isNotNull() | F.col("receiver").isNotNull(), qualified)).join(target.filter("t_owner is not null and t_lang <> 'js'"), ["project_id", "t_display"])
    near = _only(named.filter("path = t_path"), CALL).withColumnRenamed("dst", "near")
    far = _only(named, CALL).withColumnRenamed("dst", "far")
    bare = _only(other.filter("receiver is null").join(target, (F.col("path") == F.col("t_path")) & (F.col("name") == F.col("t_name")) & (other["project_id"] == target["project_id"])).select(*[other[k] for k in CALL], "dst"), CALL).withColumnRenamed("dst", "bare")
    b = other.join(near, CALL, "left").join(far, CALL, "left").join(bare, CALL, "left")
    b = b.select(*CALL, F.coalesce("near", "far", "bare").alias("dst"), F.when(F.coalesce("near", "far").isNotNull(), "exact").otherwise("same-file").alias("resolution"))

    # Python: self, then this module, then what an import binds, then a class of this module
    p = c.filter(py)
    mine = target.filter("t_lang = 'python'")
    rule = (
        F.when(own, F.concat_ws(".", "owner", "name")).when(F.col("receiver").isNull(), F.col("name")).otherwise(F.concat_ws(".", "receiver", "name"))
    )
    local = p.withColumn("t_display", rule).join(mine, ["project_id", "t_display"]).filter("path = t_path")
    local = _only(local, CALL).withColumnRenamed("dst", "local")
    modules = python_modules(facts)
    packages = modules.select("project_id", "path", "package").distinct()
    bound = p.filter("bound_module is not null").join(packages, ["project_id", "path"])
    climbed = F.when(F.col("level") > 0, F.slice("package", 1, F.greatest(F.size("package") - F.col("level") + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    base = F.when(F.col("level") <= F.size("package") + F.when(F.col("level") > 0, 0).otherwise(1), F.concat_ws(".", F.array_join(climbed, "."), F.nullif(F.col("bound_module"), F.lit(""))))
    bound = bound.withColumn("_full", F.split(F.concat(F.regexp_replace(base, r"^\.", ""), F.when(F.col("bound_name").startswith("."), F.col("bound_name")).otherwise(F.concat(F.lit("."), "bound_name"))), r"\."))
    bound = bound.withColumn("_n", F.explode(F.sequence(F.lit(1), F.greatest(F.size("_full") - 1, F.lit(1)))))
    # `import a.b` binds a module: only its own functions count; `from m import s` may bind either
    free = F.col("bound_name").startswith(".")
    bound = bound.filter(~free | (F.col("_n") == F.size(F.split(F.col("bound_module"), r"\."))))
    bound = bound.select(*CALL, F.array_join(F.slice("_full", 1, F.col("_n")), ".").alias("module"), F.array_join(F.slice("_full", F.col("_n") + 1, F.size("_full")), ".").alias("t_display"))
    there = mine.join(modules.select("project_id", F.col("path").alias("t_path"), "module"), ["project_id", "t_path"])
    imported = _only(bound.join(there, ["project_id", "module", "t_display"]), CALL).withColumnRenamed("dst", "imported")
    d = p.join(local, CALL, "left").join(imported, CALL, "left")
    by_import = F.col("bound_module").isNotNull() & ~own & (F.col("receiver").isNotNull() | F.col("local").isNull())
    d = d.select(*CALL, F.when(by_import, F.col("imported")).otherwise(F.col("local")).alias("dst"), F.when(by_import, "import").when(F.col("receiver").isNull(), "same-file").otherwise("exact").alias("resolution"))

    found = a.unionByName(b).unionByName(d).filter("dst is not null")
    out = c.select(*CALL, "src", "awaited").join(found, CALL)
    kind = F.when(F.col("src") == F.col("dst"), "recursive").when(F.col("awaited"), "async").otherwise("call")
    return out.select("project_id", "src", "dst", kind.alias("kind"), "resolution", "path", "pos")


def edges(resolved: DataFrame) -> DataFrame:
    """One row for each pair: cnt, and kind and resolution of its first call."""
    first = F.struct("path", "pos")
    return resolved.groupBy("project_id", "src", "dst").agg(F.count("*").alias("cnt"), F.min_by("kind", first).alias("kind"), F.min_by(F.struct("resolution"), first).alias("_r")).select("project_id", "src", "dst", "cnt", "kind", F.col("_r.resolution").alias("resolution"))
