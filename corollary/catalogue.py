"""Queries over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import Engine
from .functions.builtins import install
from .functions.reach import reach
from .plans.ir import ArgType
from .plans.modules import RuleLanguage
from .plans.vocabulary import Builtin, Vocabulary
from .sources.sources import CITES, FrameSource
from .values import N, S, Value

#: Slim relations: path, table, expressions, argument names.
SLIM = [
    ("region.name", "region", "r_regionkey, r_name", "rk name"),
    ("nation.name", "nation", "n_nationkey, n_name", "nk name"),
    ("nation.region", "nation", "n_nationkey, n_regionkey", "nk rk"),
    ("customer.nation", "customer", "c_custkey, c_nationkey", "c nk"),
    ("customer.balance", "customer", "c_custkey, c_acctbal", "c balance"),
    ("customer.segment", "customer", "c_custkey, c_mktsegment", "c segment"),
    ("supplier.nation", "supplier", "s_suppkey, s_nationkey", "s nk"),
    ("supplier.balance", "supplier", "s_suppkey, s_acctbal", "s balance"),
    ("order.customer", "orders", "o_orderkey, o_custkey", "o c"),
    ("order.total", "orders", "o_orderkey, o_totalprice", "o total"),
    ("order.status", "orders", "o_orderkey, o_orderstatus", "o status"),
    ("order.priority", "orders", "o_orderkey, o_orderpriority", "o priority"),
    ("order.date", "orders", "o_orderkey, o_orderdate", "o date"),
    ("line.item", "lineitem", "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice", "o line p s q x"),
    ("line.part", "lineitem", "l_partkey, l_quantity", "p q"),
    ("line.revenue", "lineitem", "l_partkey, l_extendedprice * (1 - l_discount)", "p x"),
    ("line.flag", "lineitem", "l_orderkey, l_returnflag, l_quantity", "o flag q"),
    ("part.brand", "part", "p_partkey, p_brand", "p brand"),
    ("part.size", "part", "p_partkey, p_size", "p size"),
    ("part.stated", "part", "p_partkey, nullif(p_size, 1)", "p size"),
    ("part.name", "part", "p_partkey, p_name", "p name"),
    ("event.of", "events", "event_id, user_id, event_type, value", "e user type value"),
    ("doc.text", "documents", "doc_id, text", "d text"),
    ("doc.lang", "documents", "doc_id, lang", "d lang"),
    ("doc.source", "documents", "doc_id, source", "d source"),
    ("label", "labels", "doc_id, quality, toxic", "d quality toxic"),
    ("bench.text", "benchmark", "item_id, text", "i text"),
    ("page.url", "pages", "page_id, url", "p url"),
    ("turn", "conversations", "conv_id, turn, role", "conv turn role"),
]
TABLES = "region nation customer supplier part orders lineitem events documents labels benchmark pages conversations".split()
#: Keys, which are never absent.
KEYS = "rk nk c s o p e d i conv turn line user parent child a b".split()
NUMBERS = {"balance": "", "total": "", "q": "", "x": "", "size": "", "value": ""}

MODULE = """
# Customers by the name of their region.
of_region(?c, ?r) :- _region_key(?c, ?k), region.name(?k, ?r);
_region_key(?c, ?k) :- customer.nation(?c, ?n), nation.region(?n, ?k);
# How many customers a region has.
region_size(?r, count(?c)) :- of_region(?c, ?r);
"""


def source(spark: SparkSession, sf_dir: str) -> FrameSource:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    out = FrameSource()
    for path, table, columns, labels in SLIM:
        names = labels.split()
        types = [ArgType(type="number") if n in NUMBERS else ArgType() for n in names]

        def slim(table=table, columns=columns, names=names):
            d = read(table)
            if table == "orders":
                d = d.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
            return d.selectExpr(*[f"{c.strip()} AS {n}" for c, n in zip(_columns(columns), names, strict=True)])

        out.add(path, slim, names, types, required=KEYS)
    for t in TABLES:
        df = read(t)
        out.add(f"table.{t}", df, df.columns, required=[c for c in df.columns if c.endswith("key")])
    # Part numbers as a heap-shaped tree, and each user's events in order.
    out.add("tree.edge", lambda: read("part").filter("p_partkey > 0").selectExpr("CAST(floor((p_partkey - 1) / 2) AS BIGINT) AS parent", "p_partkey AS child"), ["parent", "child"], required=KEYS)
    # All parts in heaps of fifteen at most, whose generations stay small.
    out.add("heaps.edge", lambda: read("part").filter("p_partkey % 15 > 0").selectExpr("CAST(p_partkey - p_partkey % 15 + floor((p_partkey % 15 - 1) / 2) AS BIGINT) AS parent", "p_partkey AS child"), ["parent", "child"], required=KEYS)
    order = Window.partitionBy("user_id").orderBy("ts")
    out.add("event.next", lambda: read("events").select(F.col("event_id").alias("a"), F.lead("event_id").over(order).alias("b")).filter("b IS NOT NULL"), ["a", "b"], required=KEYS)
    # Relations whose rows cite the keys they come from.
    cited = lambda t, name, key, a, b: read(t).select(F.col(a), F.col(b), F.array(F.concat(F.lit(f"{name}:"), F.col(key).cast("string"))).alias(CITES))
    out.add("cited.region", lambda: cited("region", "region", "r_regionkey", "r_regionkey", "r_name"), ["rk", "name"], required=KEYS)
    out.add("cited.nation", lambda: cited("nation", "nation", "n_nationkey", "n_nationkey", "n_regionkey"), ["nk", "rk"], required=KEYS)
    heap = lambda: read("part").filter("p_partkey % 15 > 0").selectExpr("CAST(p_partkey - p_partkey % 15 + floor((p_partkey % 15 - 1) / 2) AS BIGINT) AS parent", "p_partkey AS child", f"array(concat('edge:', p_partkey)) AS {CITES}")
    out.add("cited.edge", heap, ["parent", "child"], required=KEYS)
    # A status is one of three letters.
    out.add("order.state", lambda: read("orders").select("o_orderkey", "o_orderstatus"), ["o", "state"], [ArgType(), ArgType(domain=("F", "O", "P"))], required=KEYS)
    # Patterns that are data: a glob and a regular expression from each region's name.
    out.add("pattern", lambda: read("region").selectExpr("r_regionkey", "concat('*', lower(substr(r_name, 2, 1)), '* *[', lower(substr(r_name, 1, 1)), '-z]')", "concat('^', lower(substr(r_name, 1, 1)), '.*', lower(substr(r_name, 2, 1)), '$')").toDF("rk", "glob", "regex"), ["rk", "glob", "regex"], required=KEYS)
    out.add("neighbour_text", lambda: read("region").selectExpr("CAST(r_regionkey AS STRING) AS t", "CAST(r_regionkey AS STRING) AS size"), ["t", "size"])
    # Supplier numbers under 12 as one ring, each leading to the next and the last back; with fewer suppliers it stays open.
    out.add("ring.edge", lambda: read("supplier").filter("s_suppkey < 12").select(F.col("s_suppkey").alias("a"), F.pmod(F.col("s_suppkey") + 1, F.lit(12)).alias("b")), ["a", "b"], required=KEYS)
    # All suppliers in rings of twelve at most: each leads to the next of its ring, the last to the first.
    ring = Window.partitionBy(F.floor(F.col("s_suppkey") / 12)).orderBy("s_suppkey")
    after = F.coalesce(F.lead("s_suppkey").over(ring), F.first("s_suppkey").over(ring))
    out.add("rings.edge", lambda: read("supplier").select(F.col("s_suppkey").alias("a"), after.alias("b")), ["a", "b"], required=KEYS)
    return out


def _columns(text: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def neighbours() -> Builtin:
    """A generator in Python: the whole numbers on either side of one."""

    def gen(context, args: list[Value | None]):
        x = args[0].num
        yield [args[0], N(x - 1)], [S(f"below:{args[0].s}").s]
        yield [args[0], N(x + 1)], [S(f"above:{args[0].s}").s]

    return Builtin(2, ["of", "is"], doc="the whole numbers on either side", gen=gen, modes=[(True, False)])


def digits(args: list[Value]) -> bool:
    """A host's test in Python: the digits of a whole number add up to an even number; read from the number, whose text has an exponent from 1e6."""
    x = args[0].num
    return x is not None and x.is_integer() and sum(map(int, str(abs(int(x))))) % 2 == 0


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    s = source(spark, sf_dir)
    v = install(Vocabulary(s))
    v.add_predicate("tree.under", reach("tree.edge"))
    v.add_predicate("neighbour", neighbours())
    v.add_predicate("even", Builtin(1, ["x"], doc="a whole number that 2 divides", column=lambda c: c.num % 2 == 0))
    v.add_predicate("even_digits", Builtin(1, ["x"], doc="a whole number whose digits add up to an even number", holds=digits))
    v.add_language(RuleLanguage())
    v.add_module("market", "rules", MODULE, "catalogue")
    return Engine(spark, v, s, **options)


@dataclass
class Item:
    program: str
    sql: str | None
    names: dict[str, str] = field(default_factory=dict)
    bind: dict | None = None
    rounded: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)
    cites: bool = False
    holds: bool = False  # an answer without columns, given as whether it has a row


TREE = "under(?a, ?b) :- tree.edge(?a, ?b); under(?a, ?c) :- under(?a, ?b), tree.edge(?b, ?c);\n"
TREE_SQL = """WITH RECURSIVE e AS (SELECT CAST((p_partkey - 1) // 2 AS BIGINT) AS a, p_partkey AS b FROM part WHERE p_partkey > 0),
under(a, b) AS (SELECT a, b FROM e UNION SELECT u.a, e.b FROM under u JOIN e ON u.b = e.a) """
RING_SQL = """WITH RECURSIVE e AS (SELECT s_suppkey AS a, (s_suppkey + 1) % 12 AS b FROM supplier WHERE s_suppkey < 12),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) """
RINGS_SQL = """WITH RECURSIVE e AS (SELECT s_suppkey AS a, coalesce(lead(s_suppkey) OVER w, first_value(s_suppkey) OVER w) AS b FROM supplier WINDOW w AS (PARTITION BY s_suppkey // 12 ORDER BY s_suppkey)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) """
GROWING_SQL = """WITH RECURSIVE e AS (SELECT p.p_partkey AS a, c.p_partkey AS b FROM part p JOIN part c ON c.p_partkey > 0 AND (c.p_partkey - 1) // 2 = p.p_partkey AND p.p_size < c.p_size),
up(a, b) AS (SELECT a, b FROM e UNION SELECT up.a, e.b FROM up JOIN e ON up.b = e.a) """
HEAPS_SQL = """WITH RECURSIVE e AS (SELECT CAST(p_partkey - p_partkey % 15 + (p_partkey % 15 - 1) // 2 AS BIGINT) AS a, p_partkey AS b FROM part WHERE p_partkey % 15 > 0),
sg(x, y) AS (SELECT f.b, g.b FROM e f JOIN e g ON f.a = g.a UNION SELECT f.b, g.b FROM sg JOIN e f ON sg.x = f.a JOIN e g ON sg.y = g.a) """
CITED_SQL = """WITH RECURSIVE e AS (SELECT CAST(p_partkey - p_partkey % 15 + (p_partkey % 15 - 1) // 2 AS BIGINT) AS a, p_partkey AS b FROM part WHERE p_partkey % 15 > 0),
below(a, b, cites) AS (SELECT a, b, ['edge:' || b] FROM e UNION ALL SELECT r.a, e.b, list_append(r.cites, 'edge:' || e.b) FROM below r JOIN e ON r.b = e.a) """
CUSTOMER_REGION = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"

ITEMS: dict[str, Item] = {
    # scans, projection, filters
    "scan_project": Item("nation.name(?nk, ?name) => ?name, ?nk", "SELECT DISTINCT n_name AS name, n_nationkey AS nk FROM nation"),
    "scan_table": Item("table.nation(?nk, ?name, ?rk) => ?name, ?rk", "SELECT DISTINCT n_name AS name, n_regionkey AS rk FROM nation"),
    "default_projection": Item("nation.region(?nk, ?rk), region.name(?rk, ?name)", "SELECT DISTINCT n_nationkey AS nk, n_regionkey AS rk, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "const_filter": Item('customer.segment(?c, "BUILDING") => ?c', "SELECT DISTINCT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "const_number": Item('part.size(?p, "7") => ?p', "SELECT DISTINCT p_partkey AS p FROM part WHERE p_size = 7"),
    "repeated_var": Item("table.orders(?o, ?o, _, _, _, _) => ?o", "SELECT DISTINCT o_orderkey AS o FROM orders WHERE o_orderkey = o_custkey"),
    "wildcard": Item("line.item(_, _, ?p, _, _, _) => ?p", "SELECT DISTINCT l_partkey AS p FROM lineitem"),
    "ground_goal": Item('region.name(_, "ASIA"), region.name(?rk, ?name) => ?rk', "SELECT DISTINCT r_regionkey AS rk FROM region WHERE EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA')"),
    "cmp_lt": Item("part.size(?p, ?size), ?size < 5 => ?p, ?size", "SELECT DISTINCT p_partkey AS p, p_size AS size FROM part WHERE p_size < 5"),
    "cmp_range": Item("order.total(?o, ?total), ?total >= 1000, ?total <= 50000 => ?o, ?total", "SELECT DISTINCT o_orderkey AS o, o_totalprice AS total FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000"),
    "cmp_neq": Item('order.status(?o, ?s), ?s != "F" => ?o, ?s', "SELECT DISTINCT o_orderkey AS o, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'F'"),
    "cmp_text_order": Item('order.date(?o, ?date), ?date >= "1995-01-01", ?date < "1996-01-01" => ?o, ?date', "SELECT DISTINCT o_orderkey AS o, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01'"),
    "cmp_number_like_text": Item('part.size(?p, ?size), neighbour_text(?t, ?size) => ?p, ?t', "SELECT DISTINCT p_partkey AS p, t FROM part JOIN (SELECT CAST(r_regionkey AS VARCHAR) AS t FROM region) ON CAST(p_size AS VARCHAR) = t"),
    "cmp_constant_reads_number": Item('part.size(?p, ?size), ?size = "12" => ?p', "SELECT DISTINCT p_partkey AS p FROM part WHERE p_size = 12"),
    # joins
    "join_two": Item("order.customer(?o, ?c), order.status(?o, ?s) => ?c, ?s", "SELECT DISTINCT o_custkey AS c, o_orderstatus AS s FROM orders"),
    "join_chain": Item('customer.nation(?c, ?n), nation.region(?n, ?r), region.name(?r, "ASIA") => ?c', f"SELECT DISTINCT c_custkey AS c FROM {CUSTOMER_REGION} WHERE r_name = 'ASIA'"),
    "join_five": Item('line.item(?o, _, ?p, ?s, _, _), order.customer(?o, ?c), customer.nation(?c, ?n), supplier.nation(?s, ?n), nation.name(?n, ?name), part.size(?p, 1) => ?name, ?c', "SELECT DISTINCT n_name AS name, c_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = l_partkey WHERE p_size = 1"),
    "self_join_theta": Item("supplier.nation(?a, ?n), supplier.nation(?b, ?n), ?a < ?b => ?a, ?b", "SELECT DISTINCT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey"),
    "range_join": Item("supplier.balance(?s, ?x), supplier.balance(?t, ?y), ?x < ?y, supplier.nation(?s, ?n), supplier.nation(?t, ?n) => ?s, ?t", "SELECT DISTINCT a.s_suppkey AS s, b.s_suppkey AS t FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal"),
    "cross_small": Item("region.name(_, ?a), region.name(_, ?b) => ?a, ?b", "SELECT DISTINCT x.r_name AS a, y.r_name AS b FROM region x, region y"),
    "semi_probe": Item("customer.segment(?c, ?segment), order.customer(_, ?c) => ?c, ?segment", "SELECT DISTINCT c_custkey AS c, c_mktsegment AS segment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "join_number_text": Item("order.customer(?o, ?c), event.of(?c, _, ?type, _) => ?o, ?type", "SELECT DISTINCT o_orderkey AS o, event_type AS type FROM orders JOIN events ON o_custkey = event_id"),
    # negation
    "anti_join": Item('doc.source(?d, ?source), not label(?d, _, _) => ?d, ?source', "SELECT DISTINCT doc_id AS d, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"),
    "anti_existential": Item('part.brand(?p, ?brand), not line.item(_, 1, ?p, ?s, _, _) => ?p', "SELECT DISTINCT p_partkey AS p FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linenumber = 1)"),
    "anti_two": Item('doc.lang(?d, ?lang), not label(?d, 1, _), not label(?d, _, 1) => ?d, ?lang', "SELECT DISTINCT doc_id AS d, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)"),
    "ground_not": Item('region.name(?rk, ?name), not region.name(_, "ATLANTIS") => ?name', "SELECT DISTINCT r_name AS name FROM region WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_name = 'ATLANTIS')"),
    "not_filter": Item('nation.name(?n, ?name), not str.contains(?name, "1") => ?name', "SELECT DISTINCT n_name AS name FROM nation WHERE NOT contains(n_name, '1')"),
    "not_derived": Item('big(?p) :- part.size(?p, ?size), ?size > 25; part.brand(?p, ?brand), not big(?p) => ?p, ?brand', "SELECT DISTINCT p_partkey AS p, p_brand AS brand FROM part WHERE p_size <= 25"),
    # set operations
    "union_rules": Item('n(?x) :- supplier.nation(_, ?x); n(?x) :- customer.nation(_, ?x); n(?x) => ?x', "SELECT s_nationkey AS x FROM supplier UNION SELECT c_nationkey FROM customer"),
    "intersect": Item("supplier.nation(?s, ?n), customer.nation(?s, ?n) => ?s, ?n", "SELECT s_suppkey AS s, s_nationkey AS n FROM supplier INTERSECT SELECT c_custkey, c_nationkey FROM customer"),
    "except_not": Item("customer.nation(?s, ?n), not supplier.nation(?s, ?n) => ?s, ?n", "SELECT c_custkey AS s, c_nationkey AS n FROM customer EXCEPT SELECT s_suppkey, s_nationkey FROM supplier"),
    # aggregates
    "count_bindings": Item("line.flag(?o, ?flag, ?q) => ?flag, count(?q)", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1", {"count(q)": "n"}),
    "count_multiplied": Item("order.customer(?o, ?c), line.flag(?o, ?flag, ?q) => ?flag, count(?c)", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1", {"count(c)": "n"}),
    "count_distinct": Item("line.flag(?o, ?flag, ?q) => ?flag, count(distinct ?o)", "SELECT l_returnflag AS flag, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1", {"count(distinct o)": "n"}),
    "sum_min_max": Item("customer.nation(?c, ?nk), customer.balance(?c, ?x) => ?nk, sum(?x), min(?x), max(?x)", "SELECT c_nationkey AS nk, round(sum(c_acctbal), 2) AS s, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1", {"sum(x)": "s", "min(x)": "lo", "max(x)": "hi"}, rounded=("s",)),
    "sum_distinct": Item("part.size(?p, ?size), part.brand(?p, ?brand) => ?brand, sum(distinct ?size)", "SELECT p_brand AS brand, CAST(sum(DISTINCT p_size) AS DOUBLE) AS s FROM part GROUP BY 1", {"sum(distinct size)": "s"}),
    "min_of_text": Item("customer.segment(?c, ?segment) => min(?segment), count(?c)", "SELECT CAST(NULL AS DOUBLE) AS lo, count(*) AS n FROM customer", {"min(segment)": "lo", "count(c)": "n"}),
    "list_agg": Item("nation.region(?n, ?rk), nation.name(?n, ?name) => ?rk, list(?name)", "SELECT n_regionkey AS rk, string_agg(n_name, ' ' ORDER BY n_name) AS names FROM nation GROUP BY 1", {"list(name)": "names"}),
    "list_distinct": Item("customer.nation(?c, ?nk), customer.segment(?c, ?segment) => ?nk, list(distinct ?segment)", "SELECT nk, string_agg(s, ' ' ORDER BY s) AS segments FROM (SELECT DISTINCT c_nationkey AS nk, c_mktsegment AS s FROM customer) GROUP BY 1", {"list(distinct segment)": "segments"}),
    "list_numbers": Item("part.brand(?p, ?brand), part.size(?p, ?size) => ?brand, list(distinct ?size)", "SELECT brand, string_agg(CAST(s AS VARCHAR), ' ' ORDER BY s) AS sizes FROM (SELECT DISTINCT p_brand AS brand, p_size AS s FROM part) GROUP BY 1", {"list(distinct size)": "sizes"}),
    "global_empty_count": Item('region.name(?rk, "ATLANTIS"), nation.region(?n, ?rk) => count(?n), sum(?n)', "SELECT count(*) AS n, CAST(sum(n_nationkey) AS DOUBLE) AS s FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_name = 'ATLANTIS'", {"count(n)": "n", "sum(n)": "s"}),
    "multi_key": Item("order.customer(?o, ?c), order.status(?o, ?status), customer.segment(?c, ?segment) => ?status, ?segment, count(?o)", "SELECT o_orderstatus AS status, c_mktsegment AS segment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2", {"count(o)": "n"}),
    "having_selected": Item("order.customer(?o, ?c) => ?c, count(?o) having count(?o) >= 12", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12", {"count(o)": "n"}),
    "having_unselected": Item("order.customer(?o, ?c), order.total(?o, ?x) => ?c having max(?x) > 400000, count(?o) > 3", "SELECT o_custkey AS c FROM orders GROUP BY 1 HAVING max(o_totalprice) > 400000 AND count(*) > 3"),
    "having_group_key": Item("part.brand(?p, ?brand), part.size(?p, ?size) => ?size, count(?p) having count(?p) > ?size", "SELECT p_size AS size, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > p_size", {"count(p)": "n"}),
    "head_agg": Item("spent(?c, sum(?x)) :- order.customer(?o, ?c), order.total(?o, ?x); customer.segment(?c, ?segment), spent(?c, ?x), ?x > 1000000 => ?segment, count(?c)", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer JOIN (SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 1000000) ON o_custkey = c_custkey GROUP BY 1", {"count(c)": "n"}),
    "head_agg_filter": Item("deg(?c, count(?o)) :- order.customer(?o, ?c); deg(?c, ?n), ?n >= 20 => ?c, ?n", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 20"),
    "head_agg_constant": Item('total("all", count(?o)) :- order.status(?o, _); total(?k, ?n) => ?k, ?n', "SELECT 'all' AS k, count(*) AS n FROM orders"),
    "zero_count_idiom": Item("deg(?c, count(?o)) :- order.customer(?o, ?c); n(?c, ?k) :- deg(?c, ?k); n(?c, 0) :- customer.segment(?c, _), not order.customer(_, ?c); n(?c, ?k) => ?k, count(?c)", "SELECT k, count(*) AS n FROM (SELECT c_custkey, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) GROUP BY 1", {"count(c)": "n"}),
    "agg_over_recursion": Item(TREE + "under(?a, ?b) => ?a, count(?b)", TREE_SQL + "SELECT a, count(*) AS n FROM under GROUP BY 1", {"count(b)": "n"}),
    # order and pages
    "order_desc_limit": Item("order.total(?o, ?total) => ?o, ?total order by ?total desc limit 10", "SELECT DISTINCT o_orderkey AS o, o_totalprice AS total FROM orders ORDER BY total DESC, o LIMIT 10"),
    "page_offset": Item("customer.balance(?c, ?x) => ?c, ?x order by ?x limit 7 offset 20", "SELECT DISTINCT c_custkey AS c, c_acctbal AS x FROM customer ORDER BY x, c LIMIT 7 OFFSET 20"),
    "tie_default_order": Item("part.size(?p, ?size) => ?size, ?p order by ?size desc limit 25", "SELECT DISTINCT p_size AS size, p_partkey AS p FROM part ORDER BY size DESC, p LIMIT 25"),
    "order_by_aggregate": Item("order.customer(?o, ?c) => ?c, count(?o) order by count(?o) desc, ?c limit 5", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, c LIMIT 5", {"count(o)": "n"}),
    # recursion
    "closure_all": Item(TREE + "under(?a, ?b) => ?a, ?b", TREE_SQL + "SELECT a, b FROM under"),
    "closure_from_const": Item(TREE + "under(1, ?b) => ?b", TREE_SQL + "SELECT b FROM under WHERE a = 1"),
    "closure_to_const": Item(TREE + "under(?a, 90) => ?a", TREE_SQL + "SELECT a FROM under WHERE b = 90"),
    "right_linear": Item("r(?a, ?b) :- tree.edge(?a, ?b); r(?a, ?c) :- tree.edge(?a, ?b), r(?b, ?c); r(2, ?x) => ?x", TREE_SQL + "SELECT b AS x FROM under WHERE a = 2"),
    "nonlinear_closure": Item("r(?a, ?b) :- tree.edge(?a, ?b); r(?a, ?c) :- r(?a, ?b), r(?b, ?c); r(?a, ?b), ?b < 40 => ?a, ?b", TREE_SQL + "SELECT a, b FROM under WHERE b < 40"),
    "nonlinear_closure_all": Item("r(?a, ?b) :- tree.edge(?a, ?b); r(?a, ?c) :- r(?a, ?b), r(?b, ?c); r(?a, ?b) => ?a, ?b", TREE_SQL + "SELECT a, b FROM under"),
    "mutual_even_odd": Item("odd(?a, ?b) :- tree.edge(?a, ?b); odd(?a, ?c) :- even_(?a, ?b), tree.edge(?b, ?c); even_(?a, ?c) :- odd(?a, ?b), tree.edge(?b, ?c); even_(0, ?b) => ?b", TREE_SQL.replace("under(a, b)", "under(a, b, d)").replace("SELECT a, b FROM e UNION SELECT u.a, e.b FROM", "SELECT a, b, 1 FROM e UNION SELECT u.a, e.b, 1 - u.d FROM") + "SELECT b FROM under WHERE a = 0 AND d = 0"),
    "same_generation": Item("sg(?x, ?y) :- tree.edge(?p, ?x), tree.edge(?p, ?y); sg(?x, ?y) :- tree.edge(?p, ?x), sg(?p, ?q), tree.edge(?q, ?y); sg(20, ?y) => ?y", "WITH RECURSIVE g AS (SELECT p_partkey AS k, CAST(floor(log2(p_partkey + 1)) AS INT) AS d FROM part) SELECT k AS y FROM g WHERE d = 4"),
    "same_generation_all": Item("sg(?x, ?y) :- heaps.edge(?p, ?x), heaps.edge(?p, ?y); sg(?x, ?y) :- heaps.edge(?p, ?x), sg(?p, ?q), heaps.edge(?q, ?y); sg(?x, ?y) => ?x, count(?y)", HEAPS_SQL + "SELECT x, count(*) AS n FROM sg GROUP BY 1", {"count(y)": "n"}),
    "cyclic_closure": Item("r(?a, ?b) :- ring.edge(?a, ?b); r(?a, ?c) :- r(?a, ?b), ring.edge(?b, ?c); r(?a, ?b) => ?a, ?b", RING_SQL + "SELECT a, b FROM r"),
    "cyclic_closure_all": Item("r(?a, ?b) :- rings.edge(?a, ?b); r(?a, ?c) :- r(?a, ?b), rings.edge(?b, ?c); r(?a, ?b) => ?a, ?b", RINGS_SQL + "SELECT a, b FROM r"),
    "recursion_then_not": Item(TREE + "tree.edge(_, ?b), not under(3, ?b) => ?b", TREE_SQL + "SELECT DISTINCT b FROM e WHERE b NOT IN (SELECT b FROM under WHERE a = 3)"),
    "recursion_compare": Item("up(?a, ?b) :- tree.edge(?a, ?b), ?b < 500; up(?a, ?c) :- up(?a, ?b), tree.edge(?b, ?c), ?c < 500; up(?a, ?b) => ?a, ?b", TREE_SQL + "SELECT a, b FROM under WHERE b < 500"),
    "recursion_compare_all": Item("up(?a, ?b) :- tree.edge(?a, ?b), part.size(?a, ?x), part.size(?b, ?y), ?x < ?y; up(?a, ?c) :- up(?a, ?b), tree.edge(?b, ?c), part.size(?b, ?x), part.size(?c, ?y), ?x < ?y; up(?a, ?b) => ?a, ?b", GROWING_SQL + "SELECT a, b FROM up"),
    "user_paths": Item("before(?a, ?b) :- event.next(?a, ?b); before(?a, ?c) :- before(?a, ?b), event.next(?b, ?c); before(?a, ?b) => count(?a)", "SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM events GROUP BY user_id)", {"count(a)": "n"}),
    # predicates
    "str_contains": Item('part.name(?p, ?name), str.contains(?name, "l b") => ?p, ?name', "SELECT DISTINCT p_partkey AS p, p_name AS name FROM part WHERE contains(p_name, 'l b')"),
    "str_prefix": Item('part.name(?p, ?name), str.prefix(?name, "red ") => ?p, ?name', "SELECT DISTINCT p_partkey AS p, p_name AS name FROM part WHERE starts_with(p_name, 'red ')"),
    "str_suffix": Item('part.name(?p, ?name), str.suffix(?name, "gear") => ?p, ?name', "SELECT DISTINCT p_partkey AS p, p_name AS name FROM part WHERE ends_with(p_name, 'gear')"),
    "str_glob": Item('part.name(?p, ?name), str.glob(?name, "[a-m]?? *[^tr]") => ?p, ?name', "SELECT DISTINCT p_partkey AS p, p_name AS name FROM part WHERE regexp_full_match(p_name, '[a-m].. .*[^tr]')"),
    "str_match": Item('part.name(?p, ?name), str.match(?name, "^(red|blue).*(t|g$)") => ?p, ?name', "SELECT DISTINCT p_partkey AS p, p_name AS name FROM part WHERE regexp_matches(p_name, '^(red|blue).*(t|g$)')"),
    "str_of_number": Item('part.size(?p, ?size), str.suffix(?size, "7") => ?p, ?size', "SELECT DISTINCT p_partkey AS p, p_size AS size FROM part WHERE ends_with(CAST(p_size AS VARCHAR), '7')"),
    "contamination_join": Item("doc.text(?d, ?t), bench.text(?i, ?b), str.contains(?t, ?b) => ?d, ?i", "SELECT DISTINCT doc_id AS d, item_id AS i FROM documents d JOIN benchmark b ON contains(d.text, b.text)"),
    "absent_test": Item("part.stated(?p, ?size), absent(?size) => ?p", "SELECT DISTINCT p_partkey AS p FROM part WHERE nullif(p_size, 1) IS NULL"),
    "not_absent": Item("part.stated(?p, ?size), not absent(?size) => ?p, ?size", "SELECT DISTINCT p_partkey AS p, p_size AS size FROM part WHERE nullif(p_size, 1) IS NOT NULL"),
    "absent_joins_absent": Item("part.stated(?p, ?size), part.stated(?q, ?size), absent(?size), ?p < ?q => ?p, ?q", "SELECT DISTINCT a.p_partkey AS p, b.p_partkey AS q FROM part a JOIN part b ON a.p_partkey < b.p_partkey WHERE a.p_size = 1 AND b.p_size = 1"),
    "host_filter": Item("part.size(?p, ?size), even(?size) => ?p", "SELECT DISTINCT p_partkey AS p FROM part WHERE p_size % 2 = 0"),
    # host options, modules, generators
    "bind_param": Item("customer.segment(?c, ?segment), customer.nation(?c, ?nk) => ?segment, ?nk, count(?c)", "SELECT 'BUILDING' AS segment, c_nationkey AS nk, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 2", {"count(c)": "n"}, bind={"segment": "BUILDING"}),
    "module_member": Item('market.of_region(?c, "EUROPE") => ?c', f"SELECT DISTINCT c_custkey AS c FROM {CUSTOMER_REGION} WHERE r_name = 'EUROPE'"),
    "module_aggregate": Item("market.region_size(?r, ?n) => ?r, ?n", f"SELECT r_name AS r, count(*) AS n FROM {CUSTOMER_REGION} GROUP BY 1"),
    "reach_predicate": Item("tree.under(5, ?b) => ?b", TREE_SQL + "SELECT b FROM under WHERE a = 5"),
    "reach_backward": Item("tree.under(?a, 150) => ?a", TREE_SQL + "SELECT a FROM under WHERE b = 150"),
    "generator_udtf": Item("region.name(?rk, _), neighbour(?rk, ?x), region.name(?x, ?name) => ?rk, ?name", "SELECT DISTINCT a.r_regionkey AS rk, b.r_name AS name FROM region a JOIN region b ON abs(a.r_regionkey - b.r_regionkey) = 1"),
    # provenance: citations of a row, of a join, of groups, of rule heads with aggregates, of derived and recursive rows
    "cites_row": Item("cited.region(?rk, ?name) => ?name", "SELECT r_name AS name, ['region:' || r_regionkey] AS cites FROM region", cites=True),
    "cites_join": Item("cited.nation(?nk, ?rk), cited.region(?rk, ?name) => ?nk, ?name", "SELECT n_nationkey AS nk, r_name AS name, ['nation:' || n_nationkey, 'region:' || r_regionkey] AS cites FROM nation JOIN region ON n_regionkey = r_regionkey", cites=True),
    "cites_group": Item("cited.nation(?nk, ?rk), cited.region(?rk, ?name) => ?name, count(?nk)", "SELECT r_name AS name, count(*) AS n, list_sort(list('nation:' || n_nationkey) || ['region:' || r_regionkey]) AS cites FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey", {"count(nk)": "n"}, cites=True),
    "cites_head_aggregate": Item("size(?rk, count(?nk)) :- cited.nation(?nk, ?rk); size(?rk, ?n), ?n > 4 => ?rk, ?n", "SELECT n_regionkey AS rk, count(*) AS n, list_sort(list('nation:' || n_nationkey)) AS cites FROM nation GROUP BY 1 HAVING count(*) > 4", cites=True),
    "cites_derived": Item("in_region(?nk, ?name) :- cited.nation(?nk, ?rk), cited.region(?rk, ?name); in_region(?nk, ?name) => ?nk", "SELECT n_nationkey AS nk, ['nation:' || n_nationkey, 'region:' || r_regionkey] AS cites FROM nation JOIN region ON n_regionkey = r_regionkey", cites=True),
    "cites_recursion": Item("below(?a, ?b) :- cited.edge(?a, ?b); below(?a, ?c) :- below(?a, ?b), cited.edge(?b, ?c); below(?a, ?b) => ?a, ?b", CITED_SQL + "SELECT a, b, list_sort(cites) AS cites FROM below", cites=True),
    # answers without columns, closed domains, host filters in Python, patterns that are data
    "no_columns": Item('region.name(_, "ASIA"), not region.name(_, "ATLANTIS"), nation.region(_, 2)', "SELECT count(*) > 0 AS holds FROM region, nation WHERE r_name = 'ASIA' AND n_regionkey = 2 AND NOT EXISTS (SELECT 1 FROM region WHERE r_name = 'ATLANTIS')", holds=True),
    "closed_domain": Item('order.state(?o, "P") => ?o', "SELECT DISTINCT o_orderkey AS o FROM orders WHERE o_orderstatus = 'P'"),
    "host_filter_python": Item("part.size(?p, ?size), even_digits(?p) => ?p", "SELECT DISTINCT p_partkey AS p FROM part WHERE list_sum([CAST(d AS INT) FOR d IN string_split(CAST(p_partkey AS VARCHAR), '')]) % 2 = 0"),
    "glob_from_data": Item("part.name(?p, ?name), pattern(?rk, ?glob, _), str.glob(?name, ?glob) => ?p, ?rk", "SELECT DISTINCT p_partkey AS p, r_regionkey AS rk FROM part JOIN region ON regexp_full_match(p_name, '.*' || lower(substr(r_name, 2, 1)) || '.* .*[' || lower(substr(r_name, 1, 1)) || '-z]')"),
    "match_from_data": Item("part.name(?p, ?name), pattern(?rk, _, ?regex), str.match(?name, ?regex) => ?p, ?rk", "SELECT DISTINCT p_partkey AS p, r_regionkey AS rk FROM part JOIN region ON regexp_matches(p_name, '^' || lower(substr(r_name, 1, 1)) || '.*' || lower(substr(r_name, 2, 1)) || '$')"),
    "rollup": Item(TREE + "qty(?p, sum(?q)) :- line.part(?p, ?q); under(?a, ?b), qty(?b, ?q) => ?a, sum(?q)", TREE_SQL + "SELECT a, sum(q) AS qty FROM under JOIN (SELECT l_partkey AS p, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON p = b GROUP BY 1", {"sum(q)": "qty"}),
}


def run(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    item = ITEMS[name]
    a = engine(spark, sf_dir, **options).query(item.program, bind=item.bind, cites=item.cites)
    df = a.raw.agg((F.count("*") > 0).alias("holds")) if item.holds else a.df
    for old, new in item.names.items():
        df = df.withColumnRenamed(old, new)
    for c in item.rounded:
        df = df.withColumn(c, F.round(c, 2))
    return df


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sold quantity rolled up the part hierarchy."""
    return run(spark, sf_dir, "rollup")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, name=name: run(spark, sf_dir, name)) for name in ITEMS}


def oracle_sql() -> dict[str, str]:
    return {name: item.sql for name, item in ITEMS.items() if item.sql}
