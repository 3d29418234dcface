"""K operators: the meaning of the logical-form language as DataFrame plans.

The reference compiles a logical form into SPARQL text; here each construct
is a DataFrame operator over a triples table ``(s, p, o, o_kind, o_datatype,
o_lang)``.  A query is a chain of operators over a *bindings* DataFrame:

* ``x``       the focus variable (the answer),
* ``x_lang``  language tag when ``x`` is a literal taken from an object
              position, else null (used by the language filter, K22),
* ``v1..vn``  intermediate variables, kept because the answer must differ
              from every other bound variable (K21) before DISTINCT.

Every operator is lazy.  Predicates are constants, so ``KG.T(p)`` prunes to
one predicate (a partition of a Parquet copy partitioned by ``p``, or one
branch of a ``to_triples`` union).  Joins are equi-joins on strings and are
left to Catalyst/AQE: sort-merge with skew splitting for hub nodes, runtime
broadcast when a side turns out small.  No operator collects.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgflow.session import ensure_checkpoint_dir, shared_path
from kgflow.sources.triples import OTHER, PART, PART_PREFIX, partition_of, read_layout

X, XLANG = "x", "x_lang"
TRIPLE_SCHEMA = "s string, p string, o string, o_kind string, o_datatype string, o_lang string"
TYPE_P = "type.object.type"
NUMERIC_TYPES = ("integer", "int", "long", "float", "double", "decimal")
# Fixed value: the reference's stand-in for "now" in time constraints.
COMPAT_NOW = "2015-08-10"
# Fixed value: how ids of the open domain begin.
ENTITY_PREFIXES = ("m.", "g.")
OPS = {"le": "<=", "lt": "<", "ge": ">=", "gt": ">"}


def _cmp(a: Column, op: str, b: Column) -> Column:
    sym = OPS.get(op, op)
    return {"<=": a <= b, "<": a < b, ">=": a >= b, ">": a > b,
            "=": a == b, "!=": a != b}[sym]


def short_datatype(dt: str | None) -> str:
    """``http://...#date`` / ``xsd:date`` / ``date`` -> ``date``; any other type
    without a prefix reads as ``dateTime`` (forward branch)."""
    if not dt:
        return ""
    if "#" in dt:
        return dt.split("#", 1)[1]
    if "xsd:" in dt:
        return dt.split("xsd:", 1)[1]
    return dt if dt in ("integer", "float", "date") else "dateTime"


def normalise_literal(value: str, datatype: str, keep=("integer", "float", "dateTime", "date")) -> str:
    """K5 literal normalisation: known types keep the value, any other type
    gets the ``-08:00`` zone suffix the reference appends."""
    return value if short_datatype(datatype) in keep else value + "-08:00"


def infer_value_type(v) -> str:
    """Datatype of a bare comparison value: integer, float, date or string."""
    if isinstance(v, bool):
        return "string"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "float"
    s = str(v)
    if re.fullmatch(r"-?\d+", s):
        return "integer"
    if re.fullmatch(r"-?\d+\.\d*([eE]-?\d+)?", s):
        return "float"
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", s):
        return "date"
    return "string"


def typed(col: Column, vtype: str) -> Column:
    if vtype == "integer":        # decimals of the data compare with an integer bound, too
        return col.try_cast("decimal(38,10)")
    if vtype == "float":
        return col.try_cast("double")
    if vtype == "date":
        return col.try_cast("date")
    return col


def typed_lit(v, vtype: str) -> Column:
    if vtype == "integer":
        return F.lit(str(int(v))).cast("decimal(38,10)")
    if vtype == "float":
        return F.lit(float(v))
    if vtype == "date":
        return F.lit(str(v)).cast("date")
    return F.lit(str(v))


def end_property(p_from: str) -> tuple[str, str]:
    """Interval start property -> (start property, end property), on the
    last dotted token only.  ``from``->``to``; ``end_date`` is read as the pair
    ``start_date``/``end_date``; ``start_date``->``end_date``; anything else
    ends in ``to_date``."""
    head, _, last = p_from.rpartition(".")
    pre = head + "." if head else ""
    if last == "from":
        return p_from, pre + "to"
    if last in ("end_date", "start_date"):
        return pre + "start_date", pre + "end_date"
    return p_from, pre + "to_date"


def end_property_col(c: Column) -> Column:
    """K14 as a Column function over a column of start properties (end side)."""
    last = F.substring_index(c, ".", -1)
    pre = F.regexp_extract(c, r"^(.*\.)[^.]*$", 1)
    return (F.when(last == "from", F.concat(pre, F.lit("to")))
            .when(last.isin("end_date", "start_date"), F.concat(pre, F.lit("end_date")))
            .otherwise(F.concat(pre, F.lit("to_date"))))


KIND = "__kind"


@dataclass(frozen=True)
class Lit:
    """A literal as a constant of a graph pattern."""

    text: str
    lang: str = ""


class KG:
    """A triples table with predicate-pruned access.

    ``triples`` is any DataFrame with the six triple columns: a Parquet copy
    partitioned by ``p`` (``read_triples``) or the lazy union of
    ``to_triples`` branches.
    """

    def __init__(self, triples: DataFrame | None = None, sources: dict | None = None, spark=None, by_object: DataFrame | None = None):
        if triples is None and sources is None:
            raise ValueError("give a triples DataFrame or per-predicate sources")
        self._triples = triples
        self._by_object = by_object
        self._sources = sources
        self._spark = spark if spark is not None else (triples.sparkSession if triples is not None else None)
        self._branch: dict[str, DataFrame] = {}

    @classmethod
    def at_rest(cls, spark, path: str) -> "KG":
        """The two copies that ``write_layouts`` made: hops that look objects up read the one sorted by object."""
        return cls(read_layout(spark, path, "s"), by_object=read_layout(spark, path, "o"))

    def T(self, p: str, by: str = "s") -> DataFrame:
        """Triples of one predicate (partition / branch pruning), from the copy sorted by ``by`` where there are two."""
        if self._sources is None:
            t = self._by_object if by == "o" and self._by_object is not None else self._triples
            if PART in t.columns:
                t = t.filter(F.col(PART).isin(PART_PREFIX + p, OTHER)).drop(PART)
            return t.filter(F.col("p") == F.lit(p))
        if p not in self._branch:
            parts = [b() for b in self._sources.get(p, [])]
            self._branch[p] = (reduce(DataFrame.union, parts) if parts
                               else self._spark.createDataFrame([], TRIPLE_SCHEMA))
        return self._branch[p]

    @property
    def triples(self) -> DataFrame:
        """The whole table."""
        if self._triples is None:
            self._triples = reduce(DataFrame.union, [self.T(p) for p in sorted(self._sources)])
        return self._triples

    def triples_for(self, preds: list[str] | None) -> DataFrame:
        """The triples of the given predicates (all when None)."""
        if preds is None:
            return self.triples
        if self._sources is None:
            return self._triples.filter(F.col("p").isin(*preds))
        known = [p for p in preds if p in self._sources]
        if not known:
            return self._spark.createDataFrame([], TRIPLE_SCHEMA)
        return reduce(DataFrame.union, [self.T(p) for p in known])

    # -- starting points ---------------------------------------------------
    def having(self, r: str, e: str) -> "Bindings":
        """K1 / K6: ``?x r e`` (subjects whose ``r`` is the node ``e``; a literal of the same
        text is not that node, see K7)."""
        df = self.T(r, by="o").filter((F.col("o") == F.lit(e)) & (F.col("o_kind") == "iri")).select(F.col("s").alias(X))
        return Bindings(self, df.withColumn(XLANG, F.lit(None).cast("string")), narrow=True)

    having_class_object = having

    def of(self, r: str, e: str) -> "Bindings":
        """K2: ``e r ?x`` (objects of the constant ``e``)."""
        df = self.T(r).filter(F.col("s") == F.lit(e)).select(
            F.col("o").alias(X), _lang_of_object().alias(XLANG))
        return Bindings(self, df, narrow=True)

    def having_value(self, r: str, value: str, datatype: str) -> "Bindings":
        """K5: ``?x r "value"^^datatype`` with the reference's normalisation."""
        dt = short_datatype(datatype)
        v = normalise_literal(value, datatype)
        df = (self.T(r, by="o").filter((F.col("o") == F.lit(v)) & (F.col("o_datatype") == F.lit(dt)))
              .select(F.col("s").alias(X)))
        return Bindings(self, df.withColumn(XLANG, F.lit(None).cast("string")))

    def of_value(self, r: str, value: str, datatype: str) -> "Bindings":
        """K5, reverse branch: ``"value"^^datatype r ?x``, objects of a typed literal in subject position (as inverse
        relations over literals have it).  Here ``date`` is no known type, so a date gets the zone suffix, too."""
        v = normalise_literal(value, datatype, keep=("integer", "float", "dateTime"))
        return self.of(r, v)

    def having_text(self, r: str, text: str, lang: str = "") -> "Bindings":
        """K7: ``?x r "multi word text"@lang``; a node of the same text is not that literal."""
        df = (self.T(r, by="o").filter((F.col("o") == F.lit(text)) & (F.col("o_kind") == "literal") & (F.coalesce("o_lang", F.lit("")) == F.lit(lang)))
              .select(F.col("s").alias(X)))
        return Bindings(self, df.withColumn(XLANG, F.lit(None).cast("string")))

    def value_startswith(self, r: str, prefix: str) -> "Bindings":
        """K8: ``?x r ?st FILTER(SUBSTR(STR(?st),1,STRLEN(v)) = v)``.  ``?st`` is
        not an intermediate for K21 (the reference adds it after the filters)."""
        df = (self.T(r, by="o").filter(F.col("o").startswith(F.lit(prefix)))
              .select(F.col("s").alias(X)))
        return Bindings(self, df.withColumn(XLANG, F.lit(None).cast("string")))

    def instances(self, cls: str) -> "Bindings":
        """``?x type.object.type cls``."""
        return self.having(TYPE_P, cls)

    def compare(self, r: str, op: str, value, datatype: str | None = None) -> "Bindings":
        """``?x r ?y FILTER(?y op value)``, typed by ``datatype`` or by the
        form of ``value`` (integer, float, date, else string order)."""
        vt = datatype or infer_value_type(value)
        df = (self.T(r).filter(_cmp(typed(F.col("o"), vt), op, typed_lit(value, vt)))
              .select(F.col("s").alias(X), F.col("o").alias("v1")))
        return Bindings(self, df.withColumn(XLANG, F.lit(None).cast("string")))

    def compare2(self, r1: str, r2: str, op: str, value, reverse1: bool = False,
                 reverse2: bool = False, datatype: str | None = None) -> "Bindings":
        """Two hops through a mediator, ``?x r1 ?cvt . ?cvt r2 ?y`` and the
        filter on ``?y``; ``reverse1`` reads ``?cvt r1 ?x``, ``reverse2`` reads
        ``?y r2 ?cvt``.  The mediator is ``v1``, ``?y`` is ``v2``.  Each call gets its own mediator; two comparisons of one
        mediator: ``Bindings.compare2(..., shared_mediator=)``."""
        vt = datatype or infer_value_type(value)
        cvt_col, y_col = ("o", "s") if reverse2 else ("s", "o")
        t2 = self.T(r2).filter(F.col("o_kind") == "iri") if reverse2 else self.T(r2)
        second = (t2.filter(_cmp(typed(F.col(y_col), vt), op, typed_lit(value, vt)))
                  .select(F.col(cvt_col).alias("v1"), F.col(y_col).alias("v2")))
        x_col, c_col = ("o", "s") if reverse1 else ("s", "o")
        t1 = self.T(r1) if reverse1 else self.T(r1).filter(F.col("o_kind") == "iri")     # the mediator is a node
        first = t1.select(F.col(x_col).alias(X), F.col(c_col).alias("v1"), (_lang_of_object() if reverse1 else F.lit(None).cast("string")).alias(XLANG))
        return Bindings(self, first.join(second, "v1").select(X, "v1", "v2", XLANG))

    def argmax_class(self, cls: str, r: str) -> "Bindings":
        """K16 (ARGMAX): instances of ``cls`` with the largest ``r``."""
        return self.instances(cls).argmax(r)

    def argmin_class(self, cls: str, r: str) -> "Bindings":
        return self.instances(cls).argmin(r)

    # -- pattern and batch forms ---------------------------------------------
    def _pattern(self, s, p: str, o, nodes: set[str]) -> DataFrame:
        """Columns: the pattern's variables, and ``<name>__kind`` of an object that may be a literal."""
        if p.startswith("?"):
            raise ValueError("variable predicates are not supported")
        if isinstance(s, Lit):
            raise ValueError("a literal is no subject")
        df = self.T(p)
        cols = []
        if s.startswith("?"):
            cols.append(F.col("s").alias(s[1:]))
        else:
            df = df.filter(F.col("s") == F.lit(s))
        iri = F.col("o_kind") == "iri"
        if isinstance(o, Lit):
            df = df.filter((F.col("o") == F.lit(o.text)) & ~iri & (F.coalesce("o_lang", F.lit("")) == F.lit(o.lang)))
        elif not o.startswith("?"):
            df = df.filter((F.col("o") == F.lit(o)) & iri)
        elif o == s:
            df = df.filter((F.col("s") == F.col("o")) & iri)
        elif o[1:] in nodes:
            df, cols = df.filter(iri), [*cols, F.col("o").alias(o[1:])]
        else:
            kind = F.when(iri, F.lit("iri")).otherwise(F.concat(F.lit("@"), F.coalesce("o_lang", F.lit(""))))
            cols += [F.col("o").alias(o[1:]), kind.alias(o[1:] + KIND)]
        return df.select(*cols)

    @staticmethod
    def _vars(item) -> set[str]:
        if isinstance(item, tuple):
            return {t[1:] for t in (item[0], item[2]) if isinstance(t, str) and t.startswith("?")}
        return set().union(*[KG._vars(i) for i in item])

    @staticmethod
    def _subjects(item) -> set[str]:
        """Variables that stand for a subject somewhere: only nodes fit them."""
        if isinstance(item, tuple):
            return {item[0][1:]} if item[0].startswith("?") else set()
        return set().union(*[KG._subjects(i) for i in item])

    def match(self, patterns: list, filters: Iterable[Column] = (), select: list[str] | None = None,
              distinct: bool = False) -> DataFrame:
        """Basic graph pattern.

        Terms starting with ``?`` are variables, ``Lit(text, lang)`` is a literal, anything else a
        node; predicates are constants.  A variable unifies terms, not texts: a literal and a node of
        equal text differ.  Patterns are joined in the given order,
        each next one chosen as the first that shares a variable with what is
        joined so far (a disconnected pattern is an error: it would be a
        product).  A nested list is a sub-pattern joined on its own first
        (a bushy plan).  With ``select``, variables needed neither later nor
        in the output are projected away after each join, and with
        ``distinct`` duplicates are dropped there too (set semantics), which
        keeps intermediates at the size of the distinct bindings.  Triangles and
        four-cycles without wedges: ``kgflow.operators.cycles``.
        """
        out = self._match(list(patterns), list(filters), set(select) if select else None, distinct, self._subjects(list(patterns)))
        out = out.drop(*[c for c in out.columns if c.endswith(KIND)])
        return out.distinct() if select and distinct else out

    def _match(self, items: list, filters: list, keep: set[str] | None, distinct: bool, nodes: set[str]) -> DataFrame:
        def build(item, needed):
            if isinstance(item, tuple):
                return self._pattern(*item, nodes)
            inner = self._match(list(item), [], needed & self._vars(item), distinct, nodes)
            return inner.distinct() if distinct else inner

        rest = list(items)
        first = rest.pop(0)
        seen = self._vars(first)
        if not seen and rest:          # a constant pattern first: it is a test on the others
            return self._match([*rest, first], filters, keep, distinct, nodes)
        later = set().union(*[self._vars(i) for i in rest]) if rest else set()
        out = build(first, (keep or seen) | later)
        while rest:
            idx = next((i for i, it in enumerate(rest) if self._vars(it) & seen or not self._vars(it)), None)
            if idx is None:
                raise ValueError("disconnected graph pattern: refusing a cartesian product")
            item = rest.pop(idx)
            vs = self._vars(item)
            if not vs:                 # two constants: an existence test, one row at most
                there = build(item, set()).limit(1).select(F.lit(1).alias("_there"))
                out = out.withColumn("_there", F.lit(1)).join(F.broadcast(there), "_there", "left_semi").drop("_there")
                continue
            later = set().union(*[self._vars(i) for i in rest]) if rest else set()
            right = build(item, (keep if keep is not None else vs) | later | seen)
            out = out.join(right, [c for c in right.columns if c in out.columns])
            seen |= vs
            if keep is not None:
                need = [c for c in out.columns if (v := c.removesuffix(KIND)) in keep or v in later]
                if len(need) < len(out.columns):
                    out = out.select(*need)
                    if distinct and rest:
                        out = out.distinct()
        for f in filters:
            out = out.filter(f)
        if keep is not None:
            out = out.select(*[c for c in out.columns if c.removesuffix(KIND) in keep])
        return out

    def _round_views(self, steps: DataFrame) -> tuple[int, set[int], Callable[[int, bool], DataFrame | None]]:
        """Rounds of a step table (``step`` without gaps, ``last`` of its query), the rounds in which a query ends, and the triples that
        a round reads in one direction.

        Branches (``sources``) are chosen by the predicates that the step table names among the graph's own: at most rounds x 2 x branches
        rows, whatever the batch.  A table is pruned when the query runs: the predicates of a round and direction, a small staged table, are the build
        side of the join on the partition column, so only their partitions are read."""
        named = steps.groupBy("step", "inverse", "p").agg(F.max(F.col("step") == F.col("last")).alias("ends"))
        if self._sources is not None:
            rows = named.withColumn("p", F.when(F.col("p").isin(*self._sources), F.col("p"))).groupBy("step", "inverse", "p").agg(F.max("ends").alias("ends")).collect()
            by: dict = {}
            for r in rows:
                by.setdefault((int(r.step), bool(r.inverse)), set()).add(r.p)
            return (max((int(r.step) for r in rows), default=0), {int(r.step) for r in rows if r.ends},
                    lambda k, inverse: self.triples_for(sorted(by[k, inverse] - {None})) if (k, inverse) in by else None)
        path = shared_path(steps.sparkSession, "path-predicates")
        named.write.parquet(path)
        table = steps.sparkSession.read.schema(named.schema).parquet(path)
        per = table.groupBy("step").agg(F.max("ends").alias("ends"), F.collect_set("inverse").alias("ways")).collect()        # one row a round
        ways = {int(r.step): set(r.ways) for r in per}

        def read(k: int, inverse: bool) -> DataFrame | None:
            if inverse not in ways[k]:
                return None
            preds = table.filter((F.col("step") == k) & (F.col("inverse") == inverse)).select("p")
            if PART not in self._triples.columns:
                return self._triples.join(preds, "p", "left_semi")
            # a predicate is in a partition of its own or in that of the rare ones
            parts = preds.select(F.explode(F.array(partition_of(F.col("p")), F.lit(OTHER))).alias(PART), F.col("p").alias("_p"))
            copy = self._by_object if inverse and self._by_object is not None else self._triples
            return copy.join(parts, (copy[PART] == parts[PART]) & (copy["p"] == parts["_p"]), "left_semi")
        return max(ways, default=0), {int(r.step) for r in per if r.ends}, read

    def answer_paths(self, seeds: DataFrame, steps: DataFrame, max_steps: int | None = None,
                     checkpoint_every: int = 4) -> DataFrame:
        """Multi-hop paths for a batch of queries in one job.

        ``seeds(query_id, x)``, ``steps(query_id, step, p, inverse)`` with steps
        numbered 1..n per query.  Returns the distinct ``(query_id, x)`` reached
        after each query's last step.  Each round joins the frontier with the
        triples of the predicates (and directions) that round names, on
        ``(p, s)`` forward or ``(p, o)`` inverse; the frontier is de-duplicated
        per round so it never exceeds the distinct node set of a query.  A literal may be an answer; it has no further hop, and an inverse
        step starts at nodes only (as K3 and K4).  The
        lineage is cut every ``checkpoint_every`` rounds (reliable checkpoint).
        The number of rounds is read from ``steps``; ``max_steps`` only guards it.
        """
        # steps are renumbered without gaps, so a query moves in every round up to its last
        own = Window.partitionBy("query_id")
        steps = steps.select("query_id", F.dense_rank().over(own.orderBy("step")).alias("step"), "p", "inverse").withColumn("last", F.max("step").over(own))
        ends = steps.groupBy("query_id").agg(F.max("last").alias("last"))
        longest, ending, read = self._round_views(steps)
        if max_steps is not None and longest > max_steps:
            raise ValueError(f"a query has {longest} steps, more than {max_steps}")
        frontier = (seeds.select("query_id", X).distinct().join(ends, "query_id", "left")
                    .select("query_id", X, F.coalesce("last", F.lit(0)).alias("last"), F.lit(False).alias("lit")))
        done = [frontier.filter("last = 0")]
        for k in range(1, longest + 1):
            sk = steps.filter(F.col("step") == k).select("query_id", "p", "inverse")
            views = []
            for inverse in (False, True):
                t = read(k, inverse)
                if t is None:
                    continue               # no query takes this direction in this round
                iri = F.col("o_kind") == "iri"
                key, val = (F.col("o"), F.col("s")) if inverse else (F.col("s"), F.col("o"))
                t = t.filter(iri) if inverse else t
                views.append(t.select(key.alias("_k"), "p", F.lit(inverse).alias("inverse"), val.alias("_v"), (F.lit(False) if inverse else ~iri).alias("_lit")))
            # an inner join, so that AQE can split a hub's edges as well as a large frontier
            moving = frontier.filter((F.col("last") >= k) & ~F.col("lit")).drop("lit").join(sk, "query_id")
            edges = reduce(DataFrame.unionByName, views)
            step = moving.join(edges, (moving[X] == edges["_k"]) & (moving["p"] == edges["p"]) & (moving["inverse"] == edges["inverse"]))
            # a text reached as a node and as a literal is a node for the next round
            frontier = step.filter(F.col("_v").isNotNull()).groupBy("query_id", F.col("_v").alias(X), "last").agg(F.min("_lit").alias("lit"))
            if checkpoint_every and k % checkpoint_every == 0 and k < longest:
                ensure_checkpoint_dir(frontier.sparkSession)
                frontier = frontier.checkpoint()   # reliable, in spark.checkpoint.dir
            if k in ending:
                done.append(frontier.filter(F.col("last") == k))
        return reduce(DataFrame.unionByName, done).select("query_id", X)

    def participants(self, start: "Bindings", hops: list, end: "Bindings | None" = None) -> list[DataFrame]:
        """K3 / K4 as a chain reduced by semi-joins only: for the start and after every hop -- a relation, or ``("R", relation)`` for K4 -- the
        distinct nodes ``x`` that lie on a whole chain (to a term of ``end``, if given).

        First every set is reduced by the one before it, then, backwards, by the one after it.  No pair of
        nodes is ever made, so a hub costs its edges, not its combinations.  Forward sets are read twice: they are checkpointed."""
        ensure_checkpoint_dir(start.df.sparkSession)
        sets = [start.df.filter(_node()).select(X).distinct().checkpoint()]
        for i, hop in enumerate(hops):
            rev, name = (True, hop[1]) if isinstance(hop, (tuple, list)) else (False, hop)
            t = self.T(name) if rev else self.T(name, by="o")
            last = i == len(hops) - 1
            t = t if rev and last else t.filter(F.col("o_kind") == "iri")
            key, val = ("s", "o") if rev else ("o", "s")
            step = t.join(sets[-1].select(F.col(X).alias(key)), key, "left_semi").select(F.col(val).alias(X)).distinct()
            if last and end is not None:
                step = step.join(end.df.select(X), X, "left_semi")
            sets.append(step.checkpoint())
        for i in range(len(hops) - 1, -1, -1):
            rev, name = (True, hops[i][1]) if isinstance(hops[i], (tuple, list)) else (False, hops[i])
            key, val = ("s", "o") if rev else ("o", "s")
            t = self.T(name, by="o" if rev else "s")
            useful = t.join(sets[i + 1].select(F.col(X).alias(val)), val, "left_semi").select(F.col(key).alias(X))
            sets[i] = sets[i].join(useful, X, "left_semi").checkpoint()
        return sets


def _lang_of_object() -> Column:
    """Null for a node, the tag (or the empty string) for a literal."""
    return F.when(F.col("o_kind") == "literal", F.coalesce("o_lang", F.lit(""))).cast("string")


HEX, XEH = "0123456789ABCDEFg", "FEDCBA9876543210g"


def _falling(c: Column) -> Column:
    """A text that orders against ``c``: its bytes' complements, with an end above all of them."""
    return F.concat(F.translate(F.hex(c), HEX, XEH), F.lit("g"))


def _risen(c: Column) -> Column:
    return F.decode(F.unhex(F.translate(F.rtrim(c, F.lit("g")), XEH, HEX)), "UTF-8")


def _node(lang: str = XLANG) -> Column:
    """Whether the bound term is a node: literals have no hops of their own."""
    return F.col(lang).isNull()


def _var_cols(df: DataFrame) -> list[str]:
    return [c for c in df.columns if re.fullmatch(r"v\d+", c)]


def _fresh(df: DataFrame, n: int = 1) -> list[str]:
    used = [int(c[1:]) for c in _var_cols(df)]
    start = max(used, default=0) + 1
    return [f"v{start + i}" for i in range(n)]


class Bindings:
    """A solution sequence with focus column ``x`` (see module doc).  ``narrow``: a constant lookup that is cheap to run
    twice.  ``whole`` is False once a hop has dropped its intermediate (``keep=False``)."""

    def __init__(self, kg: KG, df: DataFrame, narrow: bool = False, whole: bool = True):
        self.kg = kg
        self.df = df
        self.narrow = narrow
        self.whole = whole

    def _wrap(self, df: DataFrame, whole: bool = True) -> "Bindings":
        return Bindings(self.kg, df, whole=self.whole and whole)

    def _hop(self, r: str, reverse: bool, keep: bool) -> "Bindings":
        (v,) = _fresh(self.df)
        prev = self.df.filter(_node()).drop(XLANG).withColumnRenamed(X, v)
        t = self.kg.T(r, by="o" if reverse else "s")
        key = "o" if reverse else "s"
        if self.narrow and self.kg._by_object is not None:
            # one row is read first: the least and the greatest node of a constant lookup, as constants of the scan, so that row groups outside are skipped
            a, z = prev.agg(F.min(v), F.max(v)).first()
            t = t.filter(F.col(key).between(F.lit(a), F.lit(z)))
        if reverse:   # ?x r ?prev
            t = t.filter(F.col("o_kind") == "iri").select(F.col("o").alias(v), F.col("s").alias(X), F.lit(None).cast("string").alias(XLANG))
        else:         # ?prev r ?x
            t = t.select(F.col("s").alias(v), F.col("o").alias(X), _lang_of_object().alias(XLANG))
        if keep:
            return self._wrap(prev.join(t, v))
        return self._wrap(t.join(prev.select(v), v, "left_semi").drop(v), whole=False)

    def step_in(self, r: str, keep: bool = True) -> "Bindings":
        """K3: ``?x r ?prev``.  ``keep=False`` drops ``?prev`` (and all before it): a semi-join of the edges, which makes no row per
        pair; K21 can't be asked after it."""
        return self._hop(r, True, keep)

    def step_out(self, r: str, keep: bool = True) -> "Bindings":
        """K4: ``?prev r ?x``; ``keep`` as in ``step_in``."""
        return self._hop(r, False, keep)

    def intersect_on_x(self, other: "Bindings") -> "Bindings":
        """K9: AND of two sets of terms; solutions agreeing on ``x`` as a term (a literal is no node of the same
        text, nor a literal of another language).  Intermediates of both sides are kept (renamed apart)."""
        a = self.df
        b = other.df
        bv = _var_cols(b)
        fresh = _fresh(a, len(bv))
        for old, new in zip(bv, fresh):
            b = b.withColumnRenamed(old, new)
        b = b.withColumnsRenamed({X: "_x", XLANG: "_lang"})
        return self._wrap(a.join(b, F.col(X).eqNullSafe(F.col("_x")) & F.col(XLANG).eqNullSafe(F.col("_lang"))).drop("_x", "_lang"))

    def semi_intersect(self, other: "Bindings") -> "Bindings":
        """K9 without the other side's intermediates (``left_semi``)."""
        b = other.df.select(F.col(X).alias("_x"), F.col(XLANG).alias("_lang"))
        return self._wrap(self.df.join(b, F.col(X).eqNullSafe(F.col("_x")) & F.col(XLANG).eqNullSafe(F.col("_lang")), "left_semi"))

    def is_a(self, cls: str) -> "Bindings":
        """``?x type.object.type cls`` as a semi-join."""
        members = self.kg.T(TYPE_P, by="o").filter((F.col("o") == F.lit(cls)) & (F.col("o_kind") == "iri")).select(F.col("s").alias(X))
        return self._wrap(self.df.filter(_node()).join(members, X, "left_semi"))

    def compare(self, r: str, op: str, value, datatype: str | None = None) -> "Bindings":
        """K11 on existing bindings: keep solutions with ``?x r ?y`` and ``?y op v``."""
        other = self.kg.compare(r, op, value, datatype)
        return self.intersect_on_x(other)

    def compare2(self, r1: str, r2: str, op: str, value, shared_mediator: str | None = None, **kw) -> "Bindings":
        """K12 on existing bindings.  With ``shared_mediator`` (an intermediate of these bindings, ``v1`` after a first
        ``KG.compare2``) both comparisons hold for the same mediator; without it each has its own."""
        other = self.kg.compare2(r1, r2, op, value, **kw)
        if shared_mediator is None:
            return self.intersect_on_x(other)
        if shared_mediator not in _var_cols(self.df):
            raise ValueError(f"{shared_mediator} is no intermediate of these bindings")
        (y,) = _fresh(self.df)
        b = other.df.select(F.col(X).alias("_x"), F.col(XLANG).alias("_lang"), F.col("v1").alias("_cvt"), F.col("v2").alias(y))
        same = F.col(X).eqNullSafe(F.col("_x")) & F.col(XLANG).eqNullSafe(F.col("_lang")) & (F.col(shared_mediator) == F.col("_cvt"))
        return self._wrap(self.df.join(b, same).drop("_x", "_lang", "_cvt"))

    def valid_during(self, p_from: str, at: str | int = "NOW", now: str = COMPAT_NOW) -> "Bindings":
        """Time constraint on an optional interval.

        Keep ``x`` if (no start OR some start <= hi) AND (no end OR some end >= lo);
        a year Y gives hi = Y-12-31 and lo = Y-01-01, ``NOW`` gives ``now`` for
        both.  Written as one left join with the subjects' sides; a value that does not parse as a date still counts as present and
        never satisfies.  Many instants at once: ``kgflow.operators.intervals``.
        """
        start_p, end_p = end_property(p_from)
        if str(at).upper() == "NOW":
            hi = lo = now
        else:
            y = str(at).split("^^")[0]
            hi, lo = f"{y}-12-31", f"{y}-01-01"
        day, when = F.col("o").try_cast("date"), {True: (start_p, lambda d: d <= F.lit(hi).cast("date")), False: (end_p, lambda d: d >= F.lit(lo).cast("date"))}
        sides = [self.kg.T(p).select(F.col("s").alias(X), F.lit(first).alias("first"), F.coalesce(fits(day), F.lit(False)).alias("fits"))
                 for first, (p, fits) in when.items()]
        # one row a subject, both sides in one aggregate; the bindings are planned once
        sides = sides[0].unionByName(sides[1]).groupBy(F.col(X).alias("_x")).agg(F.max(F.when(F.col("first"), F.col("fits"))).alias("_starts"),
                                                                               F.max(F.when(~F.col("first"), F.col("fits"))).alias("_ends"))
        held = self.df.join(sides, _node() & (F.col(X) == F.col("_x")), "left")
        return self._wrap(held.filter(F.coalesce("_starts", F.lit(True)) & F.coalesce("_ends", F.lit(True))).drop("_x", "_starts", "_ends"))

    def _ranked(self, path: list) -> tuple[DataFrame, str, Column]:
        """Bindings joined along the chain: the frame, its last variable and that one's numeric value (null if it has none).
        Only nodes are walked on from."""
        df = self.df.filter(_node()).drop(XLANG)
        cur = X
        for i, rel in enumerate(path):
            rev = isinstance(rel, (tuple, list)) and rel[0] == "R"
            name = rel[1] if rev else rel
            (nxt,) = _fresh(df)
            t = self.kg.T(name)
            last = i == len(path) - 1
            if rev or not last:
                t = t.filter(F.col("o_kind") == "iri")
            if rev:
                t = t.select(F.col("o").alias(cur), F.col("s").alias(nxt), *(
                    [F.lit("").alias("_dt")] if last else []))
            else:
                t = t.select(F.col("s").alias(cur), F.col("o").alias(nxt), *(
                    [F.col("o_datatype").alias("_dt")] if last else []))
            df = df.join(t, cur)
            cur = nxt
        return df, cur, F.when(F.col("_dt").isin(*NUMERIC_TYPES), F.col(cur).try_cast("double"))

    def _arg(self, path: list, descending: bool) -> "Bindings":
        df, cur, num = self._ranked(path)
        order = ([num.desc_nulls_last(), F.col(cur).desc()] if descending
                 else [num.asc_nulls_last(), F.col(cur).asc()])
        top = df.orderBy(*order, F.col(X).asc()).limit(1).drop("_dt")
        return self._wrap(top.withColumn(XLANG, F.lit(None).cast("string")))

    def arg_per(self, group: str, r, descending: bool = True) -> DataFrame:
        """K15 / K17 per group: of every value of ``group`` (a variable of these bindings, or any column that rides along with them)
        the best ``x`` along the relation or chain ``r`` -> ``group``, ``x``, ``arg``.

        Values order as in ``argmax``: numbers by value before any text, ties to the smallest ``x``.  One aggregate holds one candidate a
        group and task: a hot group sends one row a task, and nothing is ranked, windowed or joined back."""
        path = r if isinstance(r, list) else [r]
        df, cur, num = self._ranked(path)
        # numbers come before text, whichever end is asked for
        if descending:
            best = F.max(F.struct(num.isNotNull().alias("k"), num.alias("n"), F.col(cur).alias("a"), _falling(F.col(X)).alias("x")))
        else:
            best = F.min(F.struct(num.isNull().alias("k"), num.alias("n"), F.col(cur).alias("a"), F.col(X).alias("x")))
        out = df.groupBy(group).agg(best.alias("_b"))
        x = _risen(F.col("_b.x")) if descending else F.col("_b.x")
        return out.select(group, x.alias("x"), F.col("_b.a").alias("arg"))

    def argmax_per(self, group: str, r) -> DataFrame:
        return self.arg_per(group, r, True)

    def argmin_per(self, group: str, r) -> DataFrame:
        return self.arg_per(group, r, False)

    def argmax(self, r) -> "Bindings":
        """``?x r ?arg0 ORDER BY DESC(?arg0) LIMIT 1``; ``r`` may be a
        relation chain ``[r1, ("R", r2), ..., rn]``.  Numeric datatypes order
        numerically; ties go to the smallest ``x``.  Planned as a top-1
        (``TakeOrderedAndProject``): one candidate per partition, no sort."""
        return self._arg(r if isinstance(r, list) else [r], True)

    def argmin(self, r) -> "Bindings":
        return self._arg(r if isinstance(r, list) else [r], False)

    argmax_path = argmax
    argmin_path = argmin

    def exclude_entities(self, entities: list[str]) -> "Bindings":
        """``FILTER(?x != e)`` for every mentioned entity."""
        if not entities:
            return self
        return self._wrap(self.df.filter(~F.col(X).isin(*entities)))

    def exclude_mentioned(self, terms: list[str]) -> "Bindings":
        """K20 as a form's own terms give it: of all ``terms`` that it mentions, those that name entities of the open
        domain (``m.`` / ``g.`` ids) are excluded; closed-domain ids, classes and literals are not."""
        return self.exclude_entities([t for t in terms if t.startswith(ENTITY_PREFIXES)])

    def exclude_intermediates(self) -> "Bindings":
        """``FILTER(?x != ?v)`` for every other bound variable."""
        if not self.whole:
            raise ValueError("an intermediate was dropped by keep=False: K21 can't be asked")
        vs = _var_cols(self.df)
        if not vs:
            return self
        cond = reduce(lambda a, b: a & b, [F.col(X) != F.col(v) for v in vs])
        return self._wrap(self.df.filter(cond))

    def lang(self, tag: str = "en") -> "Bindings":
        """Keep non-literals, untagged literals and ``tag`` / ``tag-*``."""
        ok = (F.col(XLANG).isNull() | (F.col(XLANG) == "")
              | F.lower(F.col(XLANG)).rlike(f"^{re.escape(tag.lower())}(-.*)?$"))
        return self._wrap(self.df.filter(ok))

    def answer(self) -> DataFrame:
        """``SELECT DISTINCT ?x``."""
        return self.df.select(X).distinct()

    def count(self, approx: bool = False) -> DataFrame:
        """``COUNT DISTINCT ?x`` as a one-row DataFrame ``n``."""
        agg = F.approx_count_distinct(X) if approx else F.count_distinct(X)
        return self.df.agg(agg.cast("bigint").alias("n"))


def with_inverses(triples: DataFrame, inverse: DataFrame, limit: int = 100000) -> DataFrame:
    """Add ``o p_inv s`` for every IRI triple whose ``p`` has an inverse.

    A copy at rest (``read_layout``) is pruned when the query runs: the pairs are the build side of joins on its partition column, however many
    they are, and nothing is read on the driver.  Of any other table ``inverse(p, p_inv)``, schema-sized (one row per predicate), is read
    once and, up to ``limit`` pairs, applied as a map literal, so the predicate
    test reaches the triples' branches; a longer table is joined.  A predicate
    may have several inverses.  Only the new triples are de-duplicated
    against the existing triples of the inverse predicates, so the bulk of
    the graph is not shuffled.
    """
    if PART in triples.columns:
        return _with_inverses_at_rest(triples, inverse)
    iris = triples.filter(F.col("o_kind") == "iri")
    pairs = [(r.p, r.p_inv) for r in inverse.select("p", "p_inv").distinct().limit(limit + 1).collect()]
    if len(pairs) > limit:            # not schema-sized: an ordinary join
        inv = inverse.select(F.col("p").alias("_p"), "p_inv").distinct()
        flipped = iris.join(inv, F.col("p") == F.col("_p")).withColumn("_to", F.col("p_inv"))
        existing = triples
    else:
        to: dict[str, list[str]] = {}
        for a, b in sorted(pairs):
            to.setdefault(a, []).append(b)
        if not to:
            return triples
        inv = F.create_map(*[x for a, bs in to.items() for x in (F.lit(a), F.array(*[F.lit(b) for b in bs]))])
        flipped = iris.filter(F.col("p").isin(*to)).withColumn("_to", F.explode(F.element_at(inv, F.col("p"))))
        existing = triples.filter(F.col("p").isin(*sorted({b for _, b in pairs})))
    added = flipped.select(F.col("o").alias("s"), F.col("_to").alias("p"), F.col("s").alias("o"), "o_kind", "o_datatype", "o_lang").distinct()
    new = added.join(existing.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
    return triples.unionByName(new.select(*triples.columns))


def _with_inverses_at_rest(triples: DataFrame, inverse: DataFrame) -> DataFrame:
    columns = [c for c in triples.columns if c != PART]
    # staged, so that the planner sees how small they are; a predicate is in a partition of its own or among the rare ones
    path = shared_path(triples.sparkSession, "inverse-pairs")
    named = inverse.select(F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("p").alias("_q"), "p_inv"),
                                             F.struct(F.lit(2).alias("side"), F.col("p_inv").alias("_q"), F.lit(None).cast("string").alias("p_inv")))).alias("e")).select("e.*")
    named = named.select("side", "_q", "p_inv", F.explode(F.array(partition_of(F.col("_q")), F.lit(OTHER))).alias("_part")).distinct()
    named.write.parquet(path)
    named = triples.sparkSession.read.schema(named.schema).parquet(path)

    def read(side: int, how: str) -> DataFrame:
        some = named.filter(F.col("side") == side)
        return triples.join(some, (F.col(PART) == F.col("_part")) & (F.col("p") == F.col("_q")), how)

    flipped = read(1, "inner").filter(F.col("o_kind") == "iri")
    added = flipped.select(F.col("o").alias("s"), F.col("p_inv").alias("p"), F.col("s").alias("o"), "o_kind", "o_datatype", "o_lang").distinct()
    new = added.join(read(2, "left_semi").select("s", "p", "o"), ["s", "p", "o"], "left_anti")
    return triples.select(*columns).unionByName(new.select(*columns))


def classify_terms(df: DataFrame, term: str, types: DataFrame, relations: DataFrame,
                   out: str = "term_kind") -> DataFrame:
    """``^^`` -> literal, known type -> class, known relation -> relation,
    non-empty -> entity (precedence in that order); null/empty -> null.
    ``types(t)`` and ``relations(r)`` are ontology tables joined by key."""
    t = types.select(F.col(types.columns[0]).alias("_t")).distinct().withColumn("_is_t", F.lit(True))
    r = relations.select(F.col(relations.columns[0]).alias("_r")).distinct().withColumn("_is_r", F.lit(True))
    j = (df.join(t, F.col(term) == F.col("_t"), "left").join(r, F.col(term) == F.col("_r"), "left"))
    kind = (F.when(F.col(term).contains("^^"), "literal")
            .when(F.col("_is_t"), "class")
            .when(F.col("_is_r"), "relation")
            .when(F.length(F.col(term)) > 0, "entity"))
    return j.withColumn(out, kind).drop("_t", "_is_t", "_r", "_is_r")


def narrow_class(df: DataFrame, subtype: DataFrame, cls: str, relation_cls: str,
                 out: str = "narrowed") -> DataFrame:
    """When the node's class is a super type of the class the relation
    implies, take the relation's (narrower) class; otherwise keep the node's.
    ``subtype(t, super)`` lists (sub, super) pairs."""
    st = subtype.select(F.col("t").alias("_sub"), F.col("super").alias("_sup")).distinct()
    j = df.join(st, (F.col(relation_cls) == F.col("_sub")) & (F.col(cls) == F.col("_sup")), "left")
    return (j.withColumn(out, F.when(F.col("_sub").isNotNull(), F.col(relation_cls)).otherwise(F.col(cls)))
            .drop("_sub", "_sup"))


def explicit_class(explicit, explicit_kind, other, other_kind) -> Column:
    """K27 for AND / ARG: of two class nodes that become one, the class that the form names
    (the first) wins; otherwise the other node stays as it is."""
    a, ak, b, bk = (F.col(c) if isinstance(c, str) else c for c in (explicit, explicit_kind, other, other_kind))
    return F.when((ak == "class") & (bk == "class"), a).otherwise(b)


def subtype_closure(subtype: DataFrame, max_rounds: int = 64) -> DataFrame:
    """K27 over chains: all pairs ``(t, super)`` that direct pairs ``(t, super)`` imply; a cycle implies each of its
    classes above the others (and none above itself).

    Semi-naive: a round extends only the pairs that the last round added, by one direct pair, and drops the known ones.  Every round's new pairs
    are checkpointed, so the plan stays flat; it ends when a round adds nothing."""
    ensure_checkpoint_dir(subtype.sparkSession)
    direct = subtype.select("t", "super").where("t <> super").distinct().checkpoint()
    known = delta = direct
    up = direct.select(F.col("t").alias("super"), F.col("super").alias("above"))
    for _ in range(max_rounds):
        further = delta.join(up, "super").select("t", F.col("above").alias("super")).where("t <> super").distinct()
        delta = further.join(known, ["t", "super"], "left_anti").checkpoint()
        if delta.isEmpty():
            return known
        known = known.unionByName(delta).checkpoint()
    raise ValueError(f"subtype chains are longer than {max_rounds}")
