import pytest
from tests.oracle import connect, same

from tracewell.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(name, spark, sf_dir, con):
    same(catalogue.QUERIES[name](spark, sf_dir), con, catalogue.ORACLE_SQL[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_imports_nothing_from_the_corpus_subpackage():
    import ast
    from pathlib import Path

    root = Path(catalogue.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            for node in ast.walk(ast.parse(f.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in n for n in names), f


def test_filters_reach_the_scan(spark, sf_dir):
    plan = catalogue.QUERIES["search_time_day"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "value" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_rollover_covers_every_month(spark, sf_dir, con):
    months = con.execute("SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders ORDER BY m").fetchall()
    got = catalogue.QUERIES["parse_year_rollover"](spark, sf_dir).orderBy("line_no").collect()
    assert [(r["ts"].year, r["ts"].month) for r in got] == [(m.year, m.month) for (m,) in months]
    assert len({r["ts"].year for r in got}) > 1


def test_short_form_of_version_6_addresses(spark):
    import ipaddress

    import numpy as np
    from pyspark.sql import functions as F

    from tracewell.operators import ioc

    rng = np.random.default_rng(4)
    texts = ["::1", "2001:db8::", "1::8", "::", "1:2:3:4:5:6:7:8", "1:0:0:4:0:0:7:8", "0:0:3:0:0:0:7:8", "fe80::00ab:0", "1::2::3", "12345::", ":1:2", "1:2:3", "1:2:3:4:5:6:7::", "a:b:c:d:e:f:0:0"]
    texts += [":".join(f"{x:x}" for x in rng.choice([0, 0, 1, 0xAB, 0xFFFF], 8)) for _ in range(300)]
    want = []
    for t in texts:
        try:
            a = ipaddress.IPv6Address(t)
            want.append([] if a.is_unspecified else [a.compressed])
        except ValueError:
            want.append([])
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r["x"] for r in df.orderBy("i").select(ioc.compressed_ipv6(F.array("t")).alias("x")).collect()] == want


IOC_TEXT = {
    "ipv4": ["10.1.2.3", "8.8.8.8"],
    "email": ["ann.b+c@mail.example.com"],
    "domain": ["evil.example.net", "example.org"],
    "unixpath": ["/usr/lib/x.so"],
    "winpath": ["C:\\Users\\a\\b.exe"],
    "registry": ["HKLM\\Software\\Run"],
    "pipe": ["\\\\host\\pipe\\svc"],
    "md5": ["d41d8cd98f00b204e9800998ecf8427e"],
    "sha1": ["da39a3ee5e6b4b0d3255bfef95601890afd80709"],
    "imphash": ["f34d5f2d4577ed6d9ceec516c1f5a744"],
    "sha256": ["e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"],
}


def test_documents_give_every_indicator_type(spark, tmp_path):
    import re

    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tracewell.operators import ioc

    shown = {k: [f"IMPHASH={v}" for v in vs] if k == "imphash" else vs for k, vs in IOC_TEXT.items()}
    every = " ".join(v for vs in shown.values() for v in vs)
    texts = [every, every.replace(" ", ", "), *(f"see {v} {v}\n{v}." for vs in shown.values() for v in vs), "see www.w3.org here", "1.2.3 999.1.1.1 a@b x.exe 1.2.3.4.5 " + "a" * 33, "https://u@example.com/x?y=1. then ftp://10.9.8.7/z", None, ""]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    query = catalogue.QUERIES["ioc_documents"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    same(query, con, catalogue.ORACLE_SQL["ioc_documents"])
    got = {(r["id"], r["type"], r["value"]) for r in query.collect()}
    want = {(0, k, v) for k, vs in IOC_TEXT.items() for v in vs}
    assert want <= got and {(i, "url") for i, k, _ in got if k == "url"} == {(len(texts) - 3, "url")}
    plain = {(i, k, v) for k in ("unixpath", "winpath", "registry", "pipe") for i, t in enumerate(texts) for v in re.findall(ioc.PATTERNS[k], re.sub(ioc.URL, " ", t or ""))}
    plain |= {(i, k, v.lower()) for k in ("md5", "sha1", "sha256", "imphash") for i, t in enumerate(texts) for v in re.findall(ioc.PATTERNS[k], t or "")}
    assert {x for x in got if x[1] not in ("url", "ipv4", "email", "domain")} == plain
    assert {x[2] for x in got if x[1] == "ipv4"} == {*IOC_TEXT["ipv4"], "10.9.8.7"} and {x[2] for x in got if x[1] == "email"} == set(IOC_TEXT["email"])
