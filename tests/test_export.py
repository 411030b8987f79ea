import csv
import json

import pytest

from tracewell import __main__ as cli
from tracewell import engine, export
from tracewell.operators import ioc
from tracewell.operators.marks import Marks
from tracewell.plans import rules as R

ODD = [(1, 'a,"b"', None, ["x", "y"]), (2, "two\nlines", "", None), (3, " kept ", "é", [])]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "id long, text string, note string, many array<string>").coalesce(1)


def test_csv_quotes_only_what_needs_it(odd, tmp_path):
    want = [["id", "text", "note", "many"], ["1", 'a,"b"', "", '["x","y"]'], ["2", "two\nlines", "", ""], ["3", " kept ", "é", "[]"]]
    assert list(csv.reader(export.csv_text(odd).splitlines(True))) == want
    sheet = export.csv_text(odd, 1, spreadsheet=True)
    assert sheet.startswith("\ufeffid,text") and sheet.endswith("\r\n") and sheet.count("\r\n") == 2
    export.write_csv(odd, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("*.csv")
    assert list(csv.reader(part.open(newline=""))) == want
    export.write_json(odd, str(tmp_path / "json"))
    assert [json.loads(x)["id"] for x in next((tmp_path / "json").glob("*.json")).read_text().splitlines()] == [1, 2, 3]


def test_report_escapes_and_says_what_is_missing(spark, odd):
    page = export.report("<t>", spark.createDataFrame([("<script>", 1)], "a string, n long"), findings=odd.where("id < 0"), marks=odd)
    assert "<script>" not in page and "&lt;script&gt;" in page and "&lt;t&gt;" in page
    assert "Nothing found." in page and "Not part of this report." in page and "x, y" in page
    assert "Only the first 2 are shown." in export.section("h", odd, 2)


def test_windows_indicators_on_request(spark):
    text = r"set HKLM\Software\Run and \\srv\pipe\spool \pipe\x1 C:\Temp\a.exe"
    df = spark.createDataFrame([(1, None, text)], "id long, ts timestamp_ntz, text string")
    found = {(r["type"], r["value"]) for r in ioc.extracted(df, df["text"], ipv6=False, windows=True).collect()}
    assert {("registry", r"HKLM\Software\Run"), ("pipe", r"\\srv\pipe\spool"), ("pipe", r"\pipe\x1"), ("winpath", r"C:\Temp\a.exe")} <= found
    assert not any(r["type"] in ("registry", "pipe") for r in ioc.extracted(df, df["text"], ipv6=False).collect())
    rolled = json.loads(export.grouped_json(ioc.rolled_up(ioc.extracted(df, df["text"], ipv6=False))))
    assert rolled["winpath"][0]["n"] == 1


RULE = "title: failed <logins>\nlogsource: {product: linux, service: sshd}\ndetection: {a: {event: ssh_failed}, condition: a}\n"


def test_a_case_from_files_to_report(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "logs").mkdir()
    (tmp_path / "rules").mkdir()
    lines = [f"Jan  2 03:04:0{i} h sshd[1]: Failed password for joe from 10.1.2.{i} port 22 ssh2" for i in range(5)]
    (tmp_path / "logs" / "auth.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "logs" / "app.log").write_text('level=info user=ann event=x\n{"a": [1]}\n')
    (tmp_path / "rules" / "r.yml").write_text(RULE)
    case = str(tmp_path / "case")

    def run(*argv):
        assert cli.main(list(argv)) == 0
        return list(csv.reader(capsys.readouterr().out.splitlines(True)))

    assert run("detect", str(tmp_path / "logs"))[2][1] == "auth"
    assert sorted(int(x[2]) for x in run("ingest", str(tmp_path / "logs"), "--case", case, "--year", "2024")[1:]) == [2, 5]
    assert run("sql", "SELECT count(*) AS n FROM events", "--case", case) == [["n"], ["7"]]
    assert len(run("search", "event=ssh_failed", "--case", case, "--limit", "3")) == 4
    assert ["auth", "5"] in [x[:2] for x in run("stats", "--case", case)]
    assert run("rules", str(tmp_path / "rules"), "--case", case)[1][2] == "5"
    run("report", str(tmp_path / "r.html"), "--case", case, "--rules", str(tmp_path / "rules"))
    page = (tmp_path / "r.html").read_text()
    assert "failed &lt;logins&gt;" in page and "10.1.2.4" in page
    assert cli.main(["sql", "DROP TABLE events", "--case", case]) == 2 and "allowed" in capsys.readouterr().err

    c = engine.Case.open(spark, case)
    first = c.events.where("event = 'ssh_failed'").orderBy("id").first()
    shot = c.snapshot(first["id"], 1)
    assert any(x.startswith(">") and "10.1.2.0" in x for x in shot.split("\n")) and 2 <= len(shot.split("\n")) <= 3
    raw = c.events.where("raw like '{%'").first()
    assert c.record_text(raw["id"]) == '{\n  "a": [\n    1\n  ]\n}' and c.record_text(-1) is None
    m = Marks(spark, str(tmp_path / "marks"))
    m.add(first["id"], "TP", context=shot)
    assert "10.1.2.0" in c.report(marks=m.current())
    (got,) = R.applicability(c.events, R.load_text(RULE)).collect()
    assert got["events"] == 5 and got["skipped"] is None and "ilike" in got["predicate"]


def test_command_line_switches_for_types(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "auth.log").write_text("a=1 b=2\nc=3 d=4\n")
    (tmp_path / "in" / "prose").write_text("one\ntwo\nthree\n")
    assert cli.main(["detect", str(tmp_path / "in"), "--prefer", "content", "--no-catch-all"]) == 0
    assert capsys.readouterr().out.split() == ["src_file,type", "auth.log,logfmt", "prose,"]
    assert cli.main(["detect", str(tmp_path / "in")]) == 0
    assert capsys.readouterr().out.split() == ["src_file,type", "auth.log,auth", "prose,raw"]
    assert cli.main(["ingest", str(tmp_path / "in" / "prose"), "--case", str(tmp_path / "case"), "--no-catch-all"]) == 2
    assert "cannot be told" in capsys.readouterr().err and not (tmp_path / "case").exists()
