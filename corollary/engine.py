"""The engine: a vocabulary over a source, and queries asked of it."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import threading
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import QueryError, Stopped
from .operators import chains
from .operators.answers import COUNT, grouped, ordered, projected
from .operators.bodies import CITES, WITNESS, WITNESSES, Provenance, Rel, fact_text
from .operators.fixpoint import Deriver, Work
from .operators.lanes import Cell, Lane, lane_of, literal
from .plans import rewrite
from .plans.ir import Query, Term
from .plans.parse import parse
from .plans.tools import prepare
from .plans.vocabulary import Vocabulary
from .shipping import ship
from .values import ABSENT, Value, number_text, value_of


@dataclass
class Answer:
    """An answer: a DataFrame in answer order, with a column for each label (and `cites`, `witness`).

    In the DataFrame absent values and aggregates without input are NULL and mixed columns are text; `rows()`
    tells them apart.
    """

    raw: DataFrame
    lanes: list[Lane]
    columns: list[Term]
    work: int = 0
    rounds: int = 0

    @property
    def labels(self) -> list[str]:
        return [t.label for t in self.columns]

    @property
    def df(self) -> DataFrame:
        out = []
        for k, (t, lane) in enumerate(zip(self.columns, self.lanes, strict=True)):
            c = Cell(F.col(f"c{k}"), lane)
            out.append((F.when(~c.absent, c.text) if lane.any else c.c).alias(t.label))
        return self.raw.select(*out, *[c for c in (CITES, "witness") if c in self.raw.columns])

    def rows(self) -> list[dict[str, Value]]:
        """All rows at the driver, in order; for answers known to be small."""
        out = []
        for r in self.raw.collect():
            row = {}
            for k, (t, lane) in enumerate(zip(self.columns, self.lanes, strict=True)):
                x = r[f"c{k}"]
                if lane.any:
                    row[t.label] = ABSENT if x is None or x["absent"] else Value(x["s"] or "", x["num"], unit=x["unit"] or "")
                elif x is None:
                    row[t.label] = Value() if lane.blank else ABSENT
                elif lane.kind == "num":
                    row[t.label] = Value(number_text(float(x)), float(x), unit=lane.unit)
                else:
                    row[t.label] = Value(x)
            out.append(row)
        return out

    def texts(self) -> list[list[str]]:
        return [[v.s for v in r.values()] for r in self.rows()]

    def holds(self) -> bool:
        return not self.raw.isEmpty()


class Engine:
    """Answers programs over a source's relations.  One engine serves many threads.

    `squaring` evaluates plain transitive closures in log-many rounds; `rewriting` off runs programs as written.
    """

    with_cites = Provenance(cites=True)

    def __init__(self, spark: SparkSession, vocabulary: Vocabulary, source, *, rewriting: bool = True, squaring: bool = True, persist: bool = False):
        self.spark, self.vocabulary, self.source = spark, vocabulary, source
        self.rewriting, self.squaring, self.persist = rewriting, squaring, persist
        self._lock, self._read = threading.Lock(), {}
        self.work = 0  # rows that queries with a budget have derived
        served = set(source.relations())
        for path in vocabulary.base_order:
            if path not in served:
                raise QueryError(f'the source does not serve "{path}"')
            theirs = source.schema(path)
            if theirs is None or theirs.arity != vocabulary.schema(path).arity:
                raise QueryError(f'the source does not serve "{path}" with {vocabulary.schema(path).arity} args')
        ship(spark)

    def ensure_checkpoints(self) -> None:
        """Rows of recursive rounds go to the folder in spark.checkpoint.dir; local runs without it get their own."""
        sc = self.spark.sparkContext
        if sc.getCheckpointDir():
            return
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = tempfile.mkdtemp(prefix="corollary-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        sc.setCheckpointDir(where)

    def base(self, path: str, provenance: Provenance) -> Rel:
        """A base relation, read once; a read that fails is tried again by the next query."""
        with self._lock:
            if path not in self._read:
                try:
                    df = self.source.frame(self.spark, path)
                except QueryError:
                    raise
                except Exception as e:
                    raise QueryError(f"reading {path}: {e}") from e
                self._read[path] = df.persist() if self.persist else df
            df = self._read[path]
        schema = self.vocabulary.schema(path)
        lanes = []
        for k in range(schema.arity):
            unit = schema.types[k].unit if k < len(schema.types) else ""
            column = df.schema[f"c{k}"]
            lanes.append(replace(lane_of(column.dataType, unit), sure=not column.nullable or schema.label(k) in schema.required))
        columns = [f"c{k}" for k in range(schema.arity)]
        if not provenance.any:
            return Rel(df.select(*columns), lanes)
        df = df.select(*columns, CITES)
        if provenance.witnesses:
            df = df.withColumn(WITNESS, fact_text(path, [Cell(F.col(c), lane) for c, lane in zip(columns, lanes, strict=True)], F.col(CITES)))
        return Rel(df, lanes)

    def query(self, q: Query | str, *, bind: dict | None = None, budget: int | None = None, cites: bool = False, witnesses: bool = False, cancelled: Callable[[], bool] | None = None) -> Answer:
        """Answers a query.  Recursive relations are derived now; the answer's DataFrame runs when it is used.

        `bind` gives goal variables values; `budget` limits the rows derived; `cites` adds each row's citations and
        `witnesses` a proof as JSON; `cancelled` is asked between steps.
        """
        q = parse(q) if isinstance(q, str) else q
        bound = {k.lstrip("?"): value_of(v) for k, v in (bind or {}).items()}
        q, select, columns, checker = prepare(q, self.vocabulary, bound)
        provenance = Provenance(cites or witnesses, witnesses)
        q = rewrite.unreached(q)
        if provenance.any:
            q = rewrite.tagged(q)
        elif self.rewriting:
            q = rewrite.restrict(q, checker)
            if self.squaring:
                q = rewrite.squared(q)
        work = Work(budget, cancelled)
        work.step()
        if self.rewriting and budget is None and not (provenance.any or bound) and (a := self._counted(q, list(columns), type(checker), work)):
            return a
        checker = type(checker)(self.vocabulary, q.rules)
        deriver = Deriver(self, checker, provenance, work)
        deriver.run()
        return self._answer(q, list(select), list(columns), bound, deriver, provenance)

    def _counted(self, q: Query, columns: list[Term], checking: type, work: Work) -> Answer | None:
        """The answer of a goal that only counts a closure's pairs, where they can be counted without being derived."""
        found = rewrite.counted_closure(replace(q, select=tuple(columns)))
        if not found:
            return None
        deriver = Deriver(self, checking(self.vocabulary, found[1].rules), Provenance(), work)
        if deriver.predicate(found[0]):
            return None
        deriver.run()
        edges = deriver.relation(found[0])
        if edges is None or (counted := chains.steps(self, edges, work)) is None:
            return None
        df = self.spark.range(1).select(*[F.lit(counted[0]).cast("bigint").alias(f"c{k}") for k in range(len(columns))])
        lanes = [COUNT] * len(columns)
        return Answer(ordered(df, lanes, columns, list(q.order_by), q.limit, q.offset), lanes, columns, work.used, counted[1])

    def _answer(self, q: Query, select: list[Term], columns: list[Term], bound: dict[str, Value], deriver: Deriver, provenance: Provenance) -> Answer:
        aggregating = bool(q.having) or any(t.agg for t in select)
        needed = {t.agg.var if t.agg else t.var for t in [*select, *(h.left for h in q.having)]} - {""}
        b = deriver.planner.plan(q.goal, needed, not aggregating)
        if b is None:
            b = self._nothing(q, deriver, needed, provenance)
        if deriver.work.budget is not None:
            deriver.work.step(b.df.count())
        if aggregating:
            df, lanes = grouped(b, select, list(q.having))
        else:
            df, lanes = projected(b, select)
            if provenance.witnesses:
                children = F.array_join(F.transform(F.array_sort(F.col(WITNESSES)), lambda x: x["w"]), ",")
                df = df.withColumn("witness", F.concat(F.lit("["), children, F.lit("]"))).drop(WITNESSES)
        if bound and len(select) < len(columns):
            df, lanes = self._fill(df, lanes, columns, bound)
        df = ordered(df, lanes, columns, list(q.order_by), q.limit, q.offset)
        with self._lock:
            self.work += deriver.work.used
        if not provenance.cites and CITES in df.columns:
            df = df.drop(CITES)
        return Answer(df, lanes, columns, deriver.work.used, deriver.rounds)

    def _nothing(self, q: Query, deriver: Deriver, needed: set[str], provenance: Provenance):
        """No solutions, with columns for the needed variables: some relation has no rows that could ever hold."""
        one = deriver.planner._one_row()
        b = type(deriver.planner.plan((), set(), True))(one)
        df = one.limit(0)
        names, lanes = {}, {}
        for k, v in enumerate(sorted(needed)):
            names[v], lanes[v] = f"n{k}", Lane("text")
            df = df.withColumn(names[v], F.lit(None).cast("string"))
        return replace(b, df=df, names=names, lanes=lanes)

    def _fill(self, df: DataFrame, lanes: list[Lane], columns: list[Term], bound: dict[str, Value]) -> tuple[DataFrame, list[Lane]]:
        """Columns of bound variables, with the host's value in every row."""
        out, filled, k = [], [], 0
        for at, t in enumerate(columns):
            if not t.agg and t.var in bound:
                cell = literal(bound[t.var])
                out.append(cell.c.alias(f"c{at}"))
                filled.append(cell.lane)
            else:
                out.append(F.col(f"c{k}").alias(f"c{at}"))
                filled.append(lanes[k])
                k += 1
        return df.select(*out, *[c for c in (CITES, "witness") if c in df.columns]), filled

    def explain(self, q: Query | str, **options) -> str:
        """The physical plan of the answer."""
        return self.query(q, **options).df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def run_json(spark: SparkSession, spec: str) -> str:
    """A fact text, rules and a query in JSON; columns, rows and citations, or an error, in JSON."""
    from .functions.builtins import install
    from .sources.sources import facts_source

    try:
        s = json.loads(spec)
        source = facts_source(s.get("facts", ""))
        engine = Engine(spark, install(Vocabulary(source)), source)
        a = engine.query(f"{s.get('program', '')}\n{s.get('query', '')}", bind=s.get("bind"), budget=s.get("budget"), cites=True)
        cites = [r[CITES] for r in a.raw.select(CITES).collect()] if CITES in a.raw.columns else []
        return json.dumps({"columns": a.labels, "rows": a.texts(), "cites": cites})
    except (QueryError, Stopped, ValueError) as e:
        return json.dumps({"error": str(e)})
