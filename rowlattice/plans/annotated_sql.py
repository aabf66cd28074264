"""SQL in which the notes of registered rules travel with the rows.

``sql`` reads a query with Spark's own parser and says it again over frames
that carry annotations: a rule called anywhere in a select list, also below
other functions, notes the column it is in; filters, joins, unions, groups,
common tables, sorts and limits hand the notes on. A view that has an
``annotations`` column brings its own. Each rule call runs once a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlattice.operators.versions import quoted
from rowlattice.plans import quality as qa


def sql(spark: SparkSession, text: str) -> qa.QualityFrame:
    """The result of a query and its annotations.

    What a frame cannot say (subqueries within expressions, lateral views,
    windows by name and the like) raises NotImplementedError.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    return qa.QualityFrame(_Reader(spark).frame(plan))


def _items(found: object) -> Iterator:
    """The elements of a Scala sequence."""
    for i in range(found.size()):
        yield found.apply(i)


def _kind(node: object) -> str:
    return node.getClass().getSimpleName()


class _Reader:
    """Turns parsed plans into frames whose last column has the notes."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tables, self.calls = spark, {}, 0

    def frame(self, plan: object) -> DataFrame:
        say: Callable | None = getattr(self, "_" + _kind(plan).lower(), None)
        if say is None:
            raise NotImplementedError(f"{_kind(plan)} in annotated SQL")
        return say(plan)

    # -- expressions

    def staged(self, df: DataFrame, e: object) -> tuple[DataFrame, str, list[tuple[str, list[str]]]]:
        """The frame with a column for each rule call in an expression, the
        expression that uses these, and the calls' columns and input fields."""
        text, found = e.sql(), []
        for call in self._rule_calls(e):
            name = f"__q{self.calls}"
            self.calls += 1
            arguments = ", ".join(x.sql() for x in _items(call.arguments()))
            df = df.withColumn(name, F.expr(f"qa_raw_{self._name(call)}({arguments})"))
            text = text.replace(call.sql(), f"{name}.value", 1)
            found.append((name, sorted(set(self._fields(call)))))
        return df, text, found

    @staticmethod
    def _name(call: object) -> str:
        return list(_items(call.nameParts()))[-1].lower()

    def _rule_calls(self, e: object) -> Iterator:
        if "SubqueryExpression" in _kind(e) or _kind(e) in ("ScalarSubquery", "Exists", "InSubquery"):
            raise NotImplementedError("a subquery in an expression of annotated SQL")
        if _kind(e) == "UnresolvedFunction" and self._name(e) in qa.registered(self.spark):
            yield e
            return
        for child in _items(e.children()):
            yield from self._rule_calls(child)

    def _fields(self, e: object) -> Iterator[str]:
        if _kind(e) == "UnresolvedAttribute":
            yield list(_items(e.nameParts()))[-1]
        for child in _items(e.children()):
            yield from self._fields(child)

    @staticmethod
    def _named(e: object) -> tuple[str, object]:
        if _kind(e) == "Alias":
            return e.name(), e.child()
        if _kind(e) == "UnresolvedAttribute":
            return list(_items(e.nameParts()))[-1], e
        inner = e.child() if _kind(e) == "UnresolvedAlias" else e
        return inner.sql(), inner

    @staticmethod
    def _said(found: list[tuple[str, list[str]]], name: str) -> list[Column]:
        return [qa.located(F.col(call)[qa.NAME], name, fields) for call, fields in found]

    @staticmethod
    def _with_notes(df: DataFrame, notes: list[Column]) -> Column:
        return qa.fuse(F.concat(F.col(qa.NAME), *notes)) if notes else F.col(qa.NAME)

    # -- plans

    def _unresolvedrelation(self, plan: object) -> DataFrame:
        parts = list(_items(plan.multipartIdentifier()))
        if len(parts) == 1 and parts[0].lower() in self.tables:
            return self._renamed(self.tables[parts[0].lower()], parts[0])
        return self._renamed(qa.QualityFrame(self.spark.table(".".join(map(quoted, parts)))).df, parts[-1])

    @staticmethod
    def _renamed(df: DataFrame, alias: str) -> DataFrame:
        """Known by an alias; the notes are no column of it."""
        return df.alias(alias).withColumn(qa.NAME, F.col(qa.NAME) if qa.NAME in df.columns else qa.none())

    def _subqueryalias(self, plan: object) -> DataFrame:
        return self._renamed(self.frame(plan.child()), plan.alias())

    def _unresolvedwith(self, plan: object) -> DataFrame:
        before = dict(self.tables)
        for pair in _items(plan.cteRelations()):
            self.tables[pair._1().lower()] = self.frame(pair._2())
        out = self.frame(plan.child())
        self.tables = before
        return out

    def _project(self, plan: object) -> DataFrame:
        df = self.frame(plan.child())
        out: list[Column] = []
        names: list[str] = []
        notes: list[Column] = []
        for e in _items(plan.projectList()):
            if _kind(e) == "UnresolvedStar":
                target = ".".join(quoted(p) for p in _items(e.target().get())) + "." if e.target().isDefined() else ""
                taken = df.drop(*[c for c in df.columns if c.startswith("__q")]).selectExpr(f"{target}*").columns
                for name in [c for c in taken if c != qa.NAME]:
                    out.append(F.col(f"{target}{quoted(name)}").alias(f"__out{len(out)}"))
                    names.append(name)
                continue
            name, inner = self._named(e)
            df, text, found = self.staged(df, inner)
            out.append(F.expr(text).alias(f"__out{len(out)}"))
            names.append(name)
            notes += self._said(found, name)
        return df.select(*out, self._with_notes(df, notes).alias("__notes")).toDF(*names, qa.NAME)

    def _filter(self, plan: object) -> DataFrame:
        df, text, found = self.staged(self.frame(plan.child()), plan.condition())
        return df.where(F.expr(text)).drop(*[name for name, _ in found])

    def _join(self, plan: object) -> DataFrame:
        left, right = (self.frame(side).withColumnRenamed(qa.NAME, name) for side, name in ((plan.left(), "__qleft"), (plan.right(), "__qright")))
        kind = plan.joinType()
        on: object = None
        if _kind(kind) == "UsingJoin":
            on, kind = list(_items(kind.usingColumns())), kind.tpe()
        elif plan.condition().isDefined():
            if any(True for _ in self._rule_calls(plan.condition().get())):
                raise NotImplementedError("a rule in a join condition of annotated SQL")
            on = F.expr(plan.condition().get().sql())
        how = kind.sql().lower().replace(" ", "")
        joined = left.crossJoin(right) if on is None else left.join(right, on, how)
        if how in ("leftsemi", "leftanti"):
            return joined.withColumnRenamed("__qleft", qa.NAME)
        merged = qa.fuse(F.concat(F.coalesce("__qleft", qa.none()), F.coalesce("__qright", qa.none())))
        return joined.withColumn(qa.NAME, merged).drop("__qleft", "__qright")

    def _aggregate(self, plan: object, having: object | None = None) -> DataFrame:
        df = self.frame(plan.child())
        wanted = [self._named(e) for e in _items(plan.aggregateExpressions())]
        keys: list[str] = []
        for e in _items(plan.groupingExpressions()):
            text = e.sql()
            if _kind(e) == "UnresolvedOrdinal":
                text = wanted[e.ordinal() - 1][1].sql()
            elif _kind(e) == "UnresolvedAttribute" and text.strip("`") not in df.columns:
                text = next((x.sql() for name, x in wanted if name == text.strip("`")), text)
            keys.append(text)
        notes: list[Column] = []
        aggregates: dict[str, Column] = {}
        places: list[str] = []
        key_notes: dict[str, list] = {}
        for name, e in wanted:
            text = e.sql()
            if text in keys:
                places.append(f"__g{keys.index(text)}")
                df, used, found = self.staged(df, e)
                key_notes.setdefault(text, [used, []])[1] += found
                notes += self._said(found, name)
                continue
            df, text, found = self.staged(df, e)
            notes += self._said(found, name)
            places.append(f"__a{len(aggregates)}")
            aggregates[places[-1]] = F.expr(text)
        if having is not None:
            df, text, _ = self.staged(df, having)
            aggregates["__having"] = F.expr(text)
        for i, text in enumerate(keys):
            df = df.withColumn(f"__g{i}", F.expr(key_notes[text][0] if text in key_notes else text))
        df = df.withColumn(qa.NAME, self._with_notes(df, notes))
        out = qa.QualityFrame(df).group_by(*[f"__g{i}" for i in range(len(keys))]).agg(**aggregates).df
        if having is not None:
            out = out.where("__having")
        return out.select(*[F.col(p).alias(f"__out{i}") for i, p in enumerate(places)], qa.NAME).toDF(*[name for name, _ in wanted], qa.NAME)

    def _unresolvedhaving(self, plan: object) -> DataFrame:
        return self._aggregate(plan.child(), plan.havingCondition())

    def _distinct(self, plan: object) -> DataFrame:
        frame = qa.QualityFrame(self.frame(plan.child()))
        return frame.group_by(*frame.columns).agg().df

    def _union(self, plan: object) -> DataFrame:
        return reduce(DataFrame.union, [self.frame(p) for p in _items(plan.children())])

    def _sort(self, plan: object) -> DataFrame:
        order = []
        for o in _items(plan.order()):
            how = f"{o.direction().sql()}_{o.nullOrdering().sql()}".lower().replace(" ", "_")
            order.append(getattr(F.expr(o.child().sql()), how)())
        return self.frame(plan.child()).orderBy(*order)

    def _globallimit(self, plan: object) -> DataFrame:
        return self.frame(plan.child()).limit(int(plan.limitExpr().sql()))

    def _locallimit(self, plan: object) -> DataFrame:
        return self.frame(plan.child())

    def _onerowrelation(self, plan: object) -> DataFrame:
        return self.spark.range(1).select(qa.none().alias(qa.NAME))
