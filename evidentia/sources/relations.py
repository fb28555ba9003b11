"""The relations that the operators work on, derived from the given tables by integer arithmetic only.

findings_prev, findings_cur   two scans of findings (orders)
potentials                    checks per detector (orders)
zones, files                  paths with their zone (documents)
code_lines, script_lines      numbered source lines of synthetic files (lineitem)
edges                         a dependency graph (lineitem)
history                       one scan per day (events)
assessments, review_findings  review results (labels with documents; conversations)
ledger                        an append-only hash chain (events)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Detectors by number.
DETECTORS = ["structural", "unused", "smells", "security", "cycles", "dupes", "test_coverage", "coupling", "orphaned", "naming", "review", "signature"]
SMELLS = ["long_params", "deep_nesting", "mutable_global", "bare_except"]
#: Zones by o_custkey % 10; the last has none.
ZONES = ["test", "script", "vendor", "generated", "config", "production", "production", "production", "production"]

#: Line templates of the synthetic files; {k} is replaced by a number. The position is the rule's number.
TEMPLATES = [
    "import os_{k}",
    "from pkg{k}.mod import name_{k}",
    "from .sibling_{k} import thing",
    "def func_{k}(a, b):",
    "    return a + {k}",
    "def wide_{k}(a, b, c, d, e, f):",
    "class Class{k}(Base):",
    "    def method_{k}(self):",
    "        if a and b or c and d:",
    "            for i in range({k}):",
    "                if value > {k}:",
    "                    while True:",
    "    try:",
    "        except ValueError:",
    "# a comment with password = 'abcdefgh{k}'",
    "",
    "password = 'hunter2hunter{k}'",
    "api_key = 'abcdefghijklmnopqrstuvwx{k}'",
    "token: 'abcdefghijklmnopqrstuvwx{k}'",
    "secret = 'short{k}'",
    "x = random.randint(1, {k})",
    "y = Math.random() * {k}",
    "digest = md5(data_{k})",
    "requests.get(url, verify=False)  # {k}",
    "print('user password is', pw_{k})",
    "GLOBAL_{k} = []",
    "cache_{k} = {}",
    "name_{k}(1, 2)",
    "console.log('[tag{k}] started')",
    "console.warn(value_{k})",
    "eval('code{k}')",
    "element.innerHTML = html{k}",
    "document.write('x{k}')",
    "const f = new Function('a', 'return a + {k}')",
    "} catch (e) { }",
    "let v{k}: any = 3",
    "// @ts-ignore",
    "value{k}!.field",
    "// TODO: item {k}",
    "if (count > 4096) {",
    "}",
    "useEffect(() => {})",
    "items.map(x => x + {k})",
    "<Row key={x} />",
    "<B onClick={() => go({k})} onHover={() => stop({k})} onBlur={() => x()}>",
    "const load{k} = async () => {",
    "    await fetch(url{k})",
    "val, _ := compute{k}()",
    "_ = discard{k}(x)",
    "go func() { run({k}) }()",
    'var c = new SqlCommand("select " + id{k})',
    "var f = new BinaryFormatter();",
    "print('dart {k}')",
    "d['alpha'] = d['beta{k}']",
    "e['gamma'] + e['delta']",
    "deprecated_call_{k}()  # deprecated",
    "logger.info('step {k}')",
    "name_{k} = func_{k}(2, 3)",
    "x = load(\"res://scene{k}.tscn\")",
    "router.get('/path{k}', handler)",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of a table to a task where rows are dealt by key: some 100 MB of sort and hash tables.
DEALT = 500_000


def tasks(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Tasks that a table's rows are dealt over: as many as its rows ask for, so that a task's share, and the memory it takes, does not grow with the table. The count is read from the
    files' footers."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, name).count() // DEALT))


def pick(values: list[str], place: Column) -> Column:
    """The value at a place counted from 0; null beyond the end."""
    return F.try_element_at(F.array(*map(F.lit, values)), (place + 1).cast("int"))


def _all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(k % 13 == 0, "auto_resolved").when(k % 11 == 0, "false_positive").otherwise(
        F.when(F.col("o_orderstatus") == "F", "fixed").when(F.col("o_orderstatus") == "P", "wontfix").otherwise("open")
    )
    confidence = F.when(F.col("o_orderpriority").rlike("^[12]"), "high").when(F.col("o_orderpriority").rlike("^3"), "medium").otherwise("low")
    part = F.floor(k / 12)
    orders = table(spark, sf_dir, "orders").select(
        k.alias("key"),
        pick(DETECTORS, k % 12).alias("detector"),
        F.concat(F.lit("cust/"), c % 97, F.lit(".py")).alias("file"),
        (1 + part % 4).cast("int").alias("tier"),
        confidence.alias("confidence"),
        F.concat(F.lit("finding "), k % 50).alias("summary"),
        (k % 5 + 1).cast("int").alias("loc_weight"),
        pick(SMELLS, k % 4).alias("smell_id"),
        (k % 400).cast("int").alias("loc"),
        (k % 50 == 0).alias("holistic"),
        status.alias("status"),
        F.greatest(k % 5 - 1, F.lit(0)).cast("int").alias("reopen_count"),
        (k % 17 == 0).alias("suppressed"),
        pick(ZONES, c % 10).alias("zone"),
        F.when(k % 7 < 5, "python").otherwise("typescript").alias("lang"),
        (part % 3).cast("int").alias("third"),
    )
    out = orders.withColumn("id", F.concat_ws("::", "detector", "file", F.col("key").cast("string")))
    detail = F.concat(F.lit('{"loc_weight":'), "loc_weight", F.lit(',"smell_id":"'), "smell_id", F.lit('","loc":'), "loc", F.lit(',"holistic":'), F.col("holistic").cast("string"), F.lit("}"))
    return out.withColumn("detail", detail)


def findings_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_findings(spark, sf_dir).where("third <> 0").drop("third")


def findings_cur(spark: SparkSession, sf_dir: str) -> DataFrame:
    cur = _all_findings(spark, sf_dir).where("third <> 1").where(~F.col("detector").isin("naming", "orphaned"))
    fresh = {"status": F.lit("open"), "reopen_count": F.lit(0), "suppressed": F.lit(False)}
    return cur.withColumns(fresh).withColumn("summary", F.concat("summary", F.lit("!"))).drop("third")


def potentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signature has none; orphaned did not run."""
    weight = reduce(lambda acc, x: acc.when(F.col("detector") == x[1], x[0]), enumerate(DETECTORS), F.when(F.lit(False), 0))
    n = table(spark, sf_dir, "orders").select(pick(DETECTORS, F.col("o_orderkey") % 12).alias("detector")).groupBy("detector").agg(F.count("*").alias("n"))
    potential = F.when(F.col("detector") == "signature", 0).otherwise(F.col("n") * (weight + 2)).cast("long")
    return n.where("detector <> 'orphaned'").select("detector", potential.alias("potential"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"))


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About 30 lines for a part's file, 600 for a supplier's. Numbers follow an order that is unique."""
    item = table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    keep = [*order, "l_linenumber"]
    ext = pick(["py", "ts", "go", "cs", "dart", "gd", "tsx", "py"], F.col("l_partkey") % 8)
    small = item.select(*keep, F.concat(F.lit("pkg"), F.col("l_partkey") % 7, F.lit("/mod_"), "l_partkey", F.lit("."), ext).alias("path"))
    big = item.where("l_suppkey % 10 = 0").select(*keep, F.concat(F.lit("big/sup_"), "l_suppkey", F.lit(".py")).alias("path"))
    text = pick(TEMPLATES, (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7 + F.col("l_partkey")) % len(TEMPLATES))
    filled = F.replace(text, F.lit("{k}"), (F.col("l_orderkey") % 20).cast("string"))
    line = F.row_number().over(Window.partitionBy("path").orderBy(*order))
    return small.union(big).select("path", line.alias("line"), filled.alias("text"))


#: Line templates of the script files.
SCRIPT_TEMPLATES = [
    "import { use{k}, Other as alias{k} } from 'lib'",
    "import type { type Shape{k} } from 'shapes'",
    "import Main{k} from 'main'",
    "import React from 'react'",
    "const v = use{k}(alias{k})",
    "return Main{k}",
    "// uses Shape{k}",
    "  if (ready) {",
    "  for (const x of xs) { useItem(x) }",
    "  useState({k})",
    "}",
    "} else {",
    "useEffect(() => { }, [])",
    "} catch (e) { }",
    "print('x{k}')",
    "Future load{k}(BuildContext context) async {",
    "  await fetch{k}();",
    "  Navigator.of(context as BuildContext)",
    'var s = load("res://a{k}.tscn")',
    'const S{k} = preload("res://b.tscn")',
    'x = load("res://c{k}.tscn")',
    'get_node("A/B").go({k})',
    "$Root/Branch/Leaf{k}.hide()",
    "# print('x')",
    "import _thread, app{m}._unit_{k} as u",
    "from app{m}._unit_{k} import run, _hidden as h",
    "from ._unit_{k} import __init__, value",
    "from app{m} import _unit_{k}",
    "window.location = req.query.next{k}",
    "const secret = 'abcdefghij{k}'",
    'cmd.CommandText = "select " + id{k}',
    "var t = new Random().Next(); // token {k}",
    'var conn = "Server=x;Password=p{k}"',
    'db.execute(f"select {k}")',
    "subprocess(cmd{k})",
    "pickle.loads(data{k})",
    "yaml.load(text{k})",
    "import { part{k} } from '../{s}'",
    "export * from '../{s}'",
    "const late{k} = await import('../{s}')",
    "const old{k} = require( '../{s}' )",
    "import '../{s}'",
    "import { bare{k} } from 'bare-{k}'",
    "import {d}",
    "from {d} import part{k}",
    "def run_{k}(self):",
    "    import {d}",
    "    from {d} import deep{k}",
    "        return deep{k}",
    "async def wait_{k}(self):",
    "    # a note on part{k}",
    "    ",
    "done = run_{k}(part{k})",
    "try:",
    "except ImportError:",
    "if TYPE_CHECKING:",
    "    from lib import part{k}",
    "__all__ = [",
    "    'part{k}', \"deep{k}\",",
    "]",
    "from lib import run_{k} as deep{k}, (other{k})  # why",
    "from lib import noisy{k}  # noqa",
    "from __future__ import part{k}",
    "other{k} = deep{k}  # part{k}",
    "console.log(part{k})",
    "  console.warn(part{k})",
]


def _unit(part: Column) -> Column:
    """The path of a part's script file, without its extension."""
    folder = F.concat(F.lit("app"), part % 5, F.when(part % 11 == 0, "/test").otherwise(""), F.when(part % 3 == 0, "/_unit_").otherwise("/unit_"))
    return F.concat(folder, part)


def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of parts in eight kinds, some in test folders, some private; they import parts of the same kind nearby ({s}, dotted {d})."""
    item, order, part = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"], F.col("l_partkey")
    path = F.concat(_unit(part), F.lit("."), pick(["py", "ts", "gd", "cs", "dart", "gd", "tsx", "py"], part % 8))
    other = _unit(F.greatest(part + 8 * (F.col("l_linenumber") - 4), part % 8))
    k = F.col("l_orderkey") % 40
    filled = pick(SCRIPT_TEMPLATES, (F.col("l_orderkey") * 17 + F.col("l_linenumber") * 5 + F.col("l_suppkey")) % len(SCRIPT_TEMPLATES))
    for mark, value in (("{k}", k.cast("string")), ("{m}", (k % 5).cast("string")), ("{s}", other), ("{d}", F.translate(other, "/", "."))):
        filled = F.replace(filled, F.lit(mark), value)
    placed = item.select(path.alias("path"), filled.alias("text"), *order)
    return placed.select("path", F.row_number().over(Window.partitionBy("path").orderBy(*order)).alias("line"), "text")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part of an order imports the part with the next key in it, over all of lineitem; every 500th order also imports back, which closes cycles."""
    own = Window.partitionBy("l_orderkey").orderBy("l_partkey")
    n = tasks(spark, sf_dir, "lineitem")
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition(n, "l_orderkey").select("l_orderkey", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(own).alias("dst"))
    ways = F.when(F.col("l_orderkey") % 500 == 0, F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).otherwise(F.array(F.struct("src", "dst")))
    both = item.where("src <> dst").select(F.inline(ways))
    return both.repartition(n, "src", "dst").distinct().withColumn("deferred", (F.col("src") + F.col("dst")) % 9 == 0)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("total"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"))
    strict = F.round(1000 * (1 - F.col("errors") / F.col("total"))) / 10
    seq = F.row_number().over(Window.orderBy("day"))  # one row a day
    return days.select(seq.alias("seq"), F.col("day").cast("string").alias("day"), strict.alias("strict"), "total", "errors")


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return joined.select((F.col("doc_id") % 8).cast("int").alias("batch"), F.col("source").alias("dimension"), (60 + F.col("quality") * 30 - F.col("toxic") * 20).cast("double").alias("score"), "doc_id")


def review_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        (t % 8).cast("int").alias("batch"),
        F.concat(F.lit("c"), "conv_id").alias("identifier"),
        F.concat(F.lit("src"), F.col("conv_id") % 20).alias("dimension"),
        pick(["high", "medium", "low"], t % 3).alias("confidence"),
        F.when(F.col("role") == "user", "module").when(F.col("role") == "assistant", "local").otherwise("codebase").alias("impact_scope"),
        pick(["single_edit", "multi_file_refactor", "architectural_change", "other"], t % 4).alias("fix_scope"),
        "turn",
    )


GENESIS = "0" * 64


def ledger(spark: SparkSession, sf_dir: str, tampered: bool = False) -> DataFrame:
    """seq follows event_id over the whole table: numbered per range of ids, with the ranges' counts carried over."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "props").withColumn("span", F.floor(F.col("event_id") / 4096)).repartition(tasks(spark, sf_dir, "events"), "span")
    counts = events.groupBy("span").agg(F.count("*").alias("n"), F.max_by("props", "event_id").alias("tail"))
    ahead = Window.orderBy("span")
    before = counts.select(
        "span",
        F.coalesce(F.sum("n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.lag("tail").over(ahead).alias("tail_before"),
    )
    inside = Window.partitionBy("span").orderBy("event_id")
    rows = events.join(before, "span").select(
        (F.row_number().over(inside) + F.col("before")).alias("seq"),
        F.concat(F.lit("evt-"), "event_id").alias("event_id"),
        F.lit(1).alias("schema"),
        F.coalesce(F.sha2(F.coalesce(F.lag("props").over(inside), "tail_before"), 256), F.lit(GENESIS)).alias("prev_hash"),
        F.sha2("props", 256).alias("payload_hash"),
        F.col("ts").alias("at"),
        F.col("event_type").alias("kind"),
        F.col("props").alias("payload"),
        F.col("event_id").alias("number"),
    )
    if tampered:
        rows = rows.withColumn("payload", F.when(F.col("number") % 1000 == 7, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    return rows.drop("number")


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tampered chain for each range of 256 event ids, so that ledgers grow in number and not in length."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 256).alias("span"), "event_id", "props")
    own = Window.partitionBy("span").orderBy("event_id")
    return e.select(
        F.concat(F.lit("ledger-"), "span").alias("ledger"),
        F.row_number().over(own).cast("long").alias("seq"),
        F.coalesce(F.sha2(F.lag("props").over(own), 256), F.lit(GENESIS)).alias("prev_hash"),
        F.sha2("props", 256).alias("payload_hash"),
        F.when(F.col("event_id") % 1000 == 7, F.concat("props", F.lit(" "))).otherwise(F.col("props")).alias("payload"),
    )
