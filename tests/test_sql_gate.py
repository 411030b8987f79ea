import pytest

from tracewell.engine import Case
from tracewell.plans import readonly
from tracewell.schema import EVENT_SCHEMA


@pytest.fixture(scope="module")
def case(spark):
    for other in ("zz", "x"):  # other views of the session
        spark.range(3).createOrReplaceTempView(other)
    return Case(spark.createDataFrame([], EVENT_SCHEMA), False)


CALL = "'java.lang.System', 'getProperty', 'user.home'"
REFUSED = [
    f"select IDENTIFIER('java_method')({CALL})",
    f"select id from events where host = IDENTIFIER('reflect')({CALL})",
    f"select transform(array(1), v -> java_method({CALL}))",
    f"select sum(id) over (order by java_method({CALL})) from events",
    f"select * from events lateral view java_method({CALL}) t as k",
    f"select case when true then try_reflect({CALL}) end",
    f"select * from range(reflect({CALL}))",
    f"from events |> extend java_method({CALL}) as k",
    f"select system.builtin.java_method({CALL})",
    "select identifier('id') from events",
    "select * from identifier('zz')",
    "select * from zz",
    "table zz",
    "describe zz",
    "explain select * from zz",
    "select * from events where id in (select id from zz)",
    "from events |> where id in (select id from zz)",
    "select * from zz |> select id",
    "select * from (with zz as (select 1) select 1) a, zz",
    "select (with zz as (select 1) select 1), id from zz",
    "with a as (with zz as (select 1) select * from zz) select * from zz",
    "with x as (select * from x) select * from x",
    "with y as (select * from zz), zz as (select 1) select * from y",
    "select * from events where id in (with zz as (select 1 as q) select q from zz) and id in (select id from zz)",
    "select transform(id) using 'cat' as (a) from events",
    "select input_file_name() from events",
    "select * from read_files('x')",
    "execute immediate 'select 1'",
    "cache table events",
    "refresh table events",
    "analyze table events compute statistics",
    "create table t as select * from events",
    "from events insert into zz select id",
    "call system.x()",
    "declare v int",
    "show tables",
    "use other",
]
ALLOWED = [
    "select /*+ broadcast(e) */ e.id from events e join events f on e.id = f.id",
    "select id, t.k from events lateral view explode(array(1, 2)) t as k",
    "select id, p, k from events lateral view outer posexplode(array(1, 2)) t as p, k",
    "from events |> where id > 1 |> extend id + 1 as k |> aggregate count(*) as n group by k |> order by n |> limit 3",
    "select * from events tablesample (10 percent)",
    "with zz as (select 1 as a) select * from zz",
    "with x as (select id from events), y as (select * from x) select * from y union all select * from x",
    "with recursive r(n) as (select 1 union all select n + 1 from r where n < 3) select * from r",
    "select a.* from (with q as (select id from events) select * from q) a",
    "describe events",
    "select id, (select max(id) from events) as m, row_number() over w as r from events window w as (partition by source order by id)",
    "select * from events pivot (count(id) for source in ('a', 'b'))",
    "select x.id from events x, lateral (select x.id + 1)",
    "select * except (raw) from events",
    "select id from events distribute by id sort by id",
    "select struct(id, ts), extract(year from ts), trim(both 'x' from host), try_cast(host as int), id between 1 and 2, host is distinct from 'a', ~id from events",
    "select count(distinct user) filter (where id > 1), percentile_cont(0.5) within group (order by bytes) from events group by grouping sets ((source), ())",
    "select host like any ('a', 'b'), host rlike 'x', -id % 3, host || 'a', if(id > 1, 'a', 'b') from events group by all",
    "values (1, 2)",
]


@pytest.mark.parametrize("text", REFUSED)
def test_refused(case, text):
    with pytest.raises(PermissionError):
        case.sql(text)


@pytest.mark.parametrize("text", ALLOWED)
def test_allowed(case, text):
    case.sql(text).collect()


def test_every_expression_class_that_names_a_function_is_refused_or_looked_up(spark):
    """The parser's classes for what is called by name: only those that check() looks into may pass."""
    jvm = spark.sparkContext._jvm
    for kind in ("ExpressionWithUnresolvedIdentifier", "UnresolvedDeserializer", "UnresolvedTVFAliases", "UnresolvedFunctionName", "CallMethodViaReflection", "UnresolvedTranspose"):
        assert kind not in readonly.EXPRESSIONS and kind not in readonly.NODES
    assert not readonly.EXPRESSIONS & {"UnresolvedFunction", "UnresolvedGenerator"} and jvm is not None


def test_the_analysed_plan_is_checked_by_itself(spark, case):
    case.sql("select 1")
    for text in ("select * from zz", f"select java_method({CALL})", "select * from range(3) where id in (select id from zz)", "with q as (select * from zz) select * from q"):
        with pytest.raises(PermissionError):
            readonly.check_analysed(spark.sql(text), {"events"})
    readonly.check_analysed(spark.sql("with q as (select id from events) select * from q where id in (select id from events)"), {"events"})
