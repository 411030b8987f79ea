import pytest

from tracewell.plans.search import And, Compare, Fields, Not, Or, QueryError, Text, compile_query, parse, token_for, tokenize
from tracewell.schema import EVENT_SCHEMA

FIELDS = Fields(["k", "a.b"])


def tree(q):
    return parse(q, FIELDS)[0]


def test_precedence_and_symbols():
    t = tree("a OR b c")
    assert isinstance(t, Or) and isinstance(t.parts[1], And)
    assert tree("a || b && ! c") == tree("a or b and not c")


def test_and_or_is_read_as_or():
    assert tree("a AND OR b") == tree("a OR b")


def test_terms():
    c = tree("EventType:x")
    assert isinstance(c, Compare) and c.field.name == "event" and c.op == ":"
    assert tree("user != 5") == Not(Compare(FIELDS.resolve("user"), "=", "5"))
    assert tree("user contains 5") == Compare(FIELDS.resolve("user"), ":", "5")
    assert tree('"two words"') == Text("two words", True)
    assert tree("/a (b)/") == Text("/a (b)/")
    assert tree("x:a.b=1").field.name == "a.b"


def test_negation_binds_to_one_term():
    assert tree("-a b") == And((Not(Text("a")), Text("b")))
    assert [t.kind for t in tokenize("-(a)")][:1] == ["term"]


def test_unknown_field_is_text_with_a_warning():
    t, warnings = parse("nosuch:1", FIELDS)
    assert t == Text("nosuch:1") and warnings
    assert parse("C:\\x", FIELDS) == (Text("C:\\x"), [])


@pytest.mark.parametrize("q", ["", "()", "(a", "a)x )", "user:", "'open", "AND a", "a OR", "pid>x"])
def test_errors(q):
    with pytest.raises(QueryError):
        compile_query(q, FIELDS)


@pytest.mark.parametrize(
    ("q", "ids"),
    [
        ("user=ann", [1]),
        ("-user=ann", [2, 3]),
        ("user:-", [3]),
        ("user:*", [1, 2]),
        ("user:a*n", [1]),
        ("100%", [2]),
        ("pid:7,9", [1, 2]),
        ("pid>7", [2]),
        ("x:a.b=v", [3]),
        ("ts:2024-02", [1]),
        ("ts>=2024-03-01", [2]),
        ("-ts:2024-02", [2, 3]),
        ("/^L.n/", [1]),
        ("BOB OR lin", [1, 2]),
        ("path:/bin/", [2]),
    ],
)
def test_semantics(spark, q, ids):
    import datetime as dt

    base = dict.fromkeys(EVENT_SCHEMA.names)
    rows = [
        base | {"id": 1, "user": "Ann", "pid": 7, "ts": dt.datetime(2024, 2, 29, 1), "raw": "line one"},
        base | {"id": 2, "user": "bob", "pid": 9, "ts": dt.datetime(2024, 3, 1), "message": "at 100% load", "path": "/bin/x"},
        base | {"id": 3, "extra": '{"a.b": "v"}'},
    ]
    df = spark.createDataFrame([tuple(r[n] for n in EVENT_SCHEMA.names) for r in rows], EVENT_SCHEMA)
    assert sorted(r["id"] for r in df.where(compile_query(q, FIELDS)[0]).collect()) == ids


def test_token_for():
    assert token_for("user", "ann") == "user=ann"
    assert token_for("user", None, False) == "-user:-"
    assert tree(token_for("user", 'a "b"')) == Compare(FIELDS.resolve("user"), "=", 'a "b"')
