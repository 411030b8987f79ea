"""Which SQL may run over a case: decided on the parsed plan and again on the analysed one, never on the text.

What is not listed is refused: plan nodes, expressions and table functions by name, other functions unless they are built
in and stay inside the query. Names of common table expressions count where they are in scope and nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Nodes of parsed plans that only read.
NODES = frozenset(
    "Project Filter Aggregate UnresolvedHaving Sort GlobalLimit LocalLimit Offset Tail SubqueryAlias UnresolvedSubqueryColumnAliases Join AsOfJoin LateralJoin Union Distinct Deduplicate Intersect Except UnresolvedWith"
    " UnresolvedRelation UnresolvedInlineTable ResolvedInlineTable LocalRelation OneRowRelation WithWindowDefinition Window Generate Pivot Unpivot UnresolvedTableValuedFunction ExplainCommand DescribeRelation UnresolvedTableOrView"
    " UnresolvedHint Sample PipeOperator RepartitionByExpression".split()
)
#: Expressions that the parser makes of operators, literals, names and clauses.
EXPRESSIONS = frozenset(
    "Add AggregateExpression Alias And AnyValue AttributeReference BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Coalesce Collate Concat CreateNamedStruct Cube CurrentRow$ Divide EqualNullSafe EqualTo Exists First"
    " FunctionTableSubqueryArgumentExpression GreaterThan GreaterThanOrEqual GroupingSets ILike If In InSubquery IntegralDivide IsNotNull IsNull LambdaFunction Last LateralSubquery LessThan LessThanOrEqual Like LikeAll LikeAny ListQuery"
    " Literal Multiply MultiAlias NamedArgumentExpression NamedParameter Not NotLikeAll NotLikeAny Or Overlay PipeExpression PosParameter RLike Remainder Rollup ScalarSubquery SemiStructuredExtract ShiftLeft ShiftRight ShiftRightUnsigned"
    " SortOrder SpecifiedWindowFrame StringLocate StringTrim StringTrimLeft StringTrimRight Substring Subtract TimestampAdd TimestampDiff UnaryMinus UnaryPositive UnboundedFollowing$ UnboundedPreceding$ UnresolvedAlias UnresolvedAttribute"
    " UnresolvedCollation UnresolvedExtractValue UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedRegex UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedStarWithColumns UnresolvedWindowExpression UnspecifiedFrame$"
    " WindowExpression WindowSpecDefinition".split()
)
SUBQUERIES = frozenset("ScalarSubquery Exists ListQuery LateralSubquery FunctionTableSubqueryArgumentExpression".split())
#: Table functions that make rows out of their arguments.
TABLES = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())
#: Built-in functions that reach out of the query.
OUTSIDE = frozenset("java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length".split())
#: Functions that the engine adds.
OWN = frozenset(["ip_in_cidr"])
#: Leaves of analysed plans that read nothing from outside.
OWN_LEAVES = frozenset("OneRowRelation LocalRelation Range CTERelationRef UnionLoopRef".split())
#: Expressions of analysed plans that call what is not built in, or reach out.
CALLS = frozenset("CallMethodViaReflection TryReflect InputFileName InputFileBlockStart InputFileBlockLength ScalaUDF ScalaUDAF ScalaAggregator HiveSimpleUDF HiveGenericUDF HiveGenericUDTF HiveUDAFFunction StaticInvoke Invoke ApplyFunctionExpression V2Aggregator".split())


def _seq(x) -> Iterator:
    return (x.apply(i) for i in range(x.size()))


def check(spark: SparkSession, text: str, views: set[str]) -> None:
    """Raises PermissionError unless a statement only reads the views, by built-in functions that stay inside the query.

    Text that does not parse is left to the engine's own error.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text.rstrip().rstrip(";"))
    plans = [(plan, frozenset(v.lower() for v in views))]  # with the names in scope
    while plans:
        p, known = plans.pop()
        kind = p.getClass().getSimpleName()
        if kind not in NODES:
            raise PermissionError(f"only reading is allowed, not {kind}")
        if kind in ("UnresolvedRelation", "UnresolvedTableOrView"):
            name = [str(x) for x in _seq(p.multipartIdentifier())]
            if len(name) != 1 or name[0].lower() not in known:
                raise PermissionError(f"there is no table {'.'.join(name)} here")
        elif kind == "UnresolvedTableValuedFunction":
            _table_function([str(x) for x in _seq(p.name())])
        elif kind == "UnresolvedWith":
            for x in _seq(p.cteRelations()):  # each sees those before it, and itself where it is recursive
                name = str(x._1()).lower()
                plans.append((x._2(), known | {name} if p.allowRecursion() else known))
                known = known | {name}
        elif kind == "ExplainCommand":
            plans.append((p.logicalPlan(), known))
        plans += [(c, known) for c in _seq(p.children())]
        expressions = list(_seq(p.expressions()))
        while expressions:
            e = expressions.pop()
            kind = e.getClass().getSimpleName()
            if kind == "UnresolvedFunction":
                _function(spark, [str(x) for x in _seq(e.nameParts())])
            elif kind == "UnresolvedGenerator":
                _table_function(str(e.name().unquotedString()).split("."))
            elif kind not in EXPRESSIONS:
                raise PermissionError(f"{kind} is not allowed here")
            if kind in SUBQUERIES:
                plans.append((e.plan(), known))
            expressions += list(_seq(e.children()))


def check_analysed(df: DataFrame, views: set[str]) -> None:
    """Raises PermissionError if the analysed plan reads anything but the views, or calls what is not built in."""
    known = {v.lower() for v in views}
    plans = [df._jdf.queryExecution().analyzed()]
    while plans:
        p = plans.pop()
        kind = p.getClass().getSimpleName()
        if kind == "ExplainCommand":  # explained, not run, and checked as parsed
            continue
        if kind == "View":
            name = p.desc().identifier()
            if name.database().isDefined() or str(name.table()).lower() not in known:
                raise PermissionError(f"there is no table {name.unquotedString()} here")
            continue  # what the view reads is the case
        children = list(_seq(p.children()))
        if not children and kind not in OWN_LEAVES and not kind.startswith("Describe") and kind != "CommandResult":
            raise PermissionError(f"{kind} is not allowed here")
        plans += children + list(_seq(p.innerChildren()))  # those of subqueries, too
        expressions = list(_seq(p.expressions()))
        while expressions:
            e = expressions.pop()
            kind = e.getClass().getSimpleName()
            if kind in CALLS or kind == "PythonUDF" and str(e.name()) not in OWN:
                raise PermissionError(f"{kind} is not allowed here")
            expressions += list(_seq(e.children()))


def _table_function(name: list[str]) -> None:
    if len(name) != 1 or name[0].lower() not in TABLES:
        raise PermissionError(f"{'.'.join(name)} is not allowed here")


def _function(spark: SparkSession, name: list[str]) -> None:
    low = name[-1].lower()
    if len(name) > 1 or low in OUTSIDE or low not in OWN and not spark.sql(f"SHOW SYSTEM FUNCTIONS LIKE '{low}'").count() and low not in ("||", "count", "cast"):
        raise PermissionError(f"{'.'.join(name)} is not allowed here")
