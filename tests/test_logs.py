import bz2
import gzip
import io
import json
import lzma
import random
import re
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewell import engine
from tracewell.operators.binaries import catalogue, executed
from tracewell.operators.marks import Marks
from tracewell.plans import rules as R
from tracewell.sources import parsers
from tracewell.sources.detect import by_name, detected
from tracewell.sources.lines import unpacked
from tracewell.sources.parsers import Options, parse


def parsed(spark, kind, text, **options):
    rows = [("f", i + 1, line, 2024) for i, line in enumerate(text.split("\n"))]
    df = spark.createDataFrame(rows, "src_file string, line_no int, line string, file_year int")
    return [r.asDict() for r in parse(df, kind, Options(**options)).orderBy("line_no").collect()]


def test_syslog_year_rolls_over_and_zone_is_taken_off(spark):
    got = parsed(spark, "syslog", "Dec 31 23:59:59 h cron[1]: a\nJan  1 00:00:01 h cron: b\n<x> none\n2024-05-06T07:08:09+02:00 h p[3]: c", base_year=2023, offset_minutes=60)
    assert [str(r["ts"]) for r in got] == ["2023-12-31 22:59:59", "2023-12-31 23:00:01", "None", "2024-05-06 05:08:09"]
    assert got[0]["pid"] == 1 and got[3]["message"] == "c"


def test_impossible_dates_give_no_time(spark):
    assert parsed(spark, "syslog", "Feb 30 00:00:00 h p: x", base_year=2023)[0]["ts"] is None


def test_access_variants(spark):
    via, junk = parsed(spark, "access", '10.0.0.1 -> 10.0.0.2 - joe [01/Feb/2024:10:00:00 +0100] [77] "GET /x HTTP/1.1" 503 -\nnonsense')
    assert (str(via["ts"]), via["pid"], via["severity"], via["bytes"]) == ("2024-02-01 09:00:00", 77, "error", None)
    assert json.loads(via["extra"]) == {"dst": "10.0.0.2"} and junk["message"] == "nonsense"


def test_weberror_forms(spark):
    n, a = parsed(spark, "weberror", '2024/01/02 03:04:05 [error] 9#1: *1 open() failed, client: 1.2.3.4, request: "GET /a HTTP/1.1"\n[Wed Sep 30 22:14:05.123456 2026] [core:error] [pid 12] [client 1.2.3.4:55] boom')
    assert (n["src_ip"], n["path"], n["pid"], str(n["ts"])) == ("1.2.3.4", "/a", 9, "2024-01-02 03:04:05")
    assert (a["src_ip"], a["message"], str(a["ts"])) == ("1.2.3.4", "boom", "2026-09-30 22:14:05")


def test_history_marks_time_the_next_command_only(spark):
    got = parsed(spark, "bash_history", "#1700000000\nls -l\npwd", user="joe")
    assert [(r["message"], str(r["ts"]), r["user"]) for r in got] == [("ls -l", "2023-11-14 22:13:20", "joe"), ("pwd", "None", "joe")]


def test_applog_levels(spark):
    a, b = parsed(spark, "applog", "2024-01-02 03:04:05,250 ERROR: broken\nno time here", offset_minutes=60)
    assert (str(a["ts"]), a["severity"], a["message"]) == ("2024-01-02 02:04:05.250000", "error", "broken")
    assert b["ts"] is None and b["message"] == "no time here"


def test_logfmt_last_key_wins_and_bad_numbers_stay(spark):
    (r,) = parsed(spark, "logfmt", "ts=2024-01-02T03:04:05Z level=warning pid=x z=1 z=2")
    assert r["severity"] == "warn" and r["pid"] is None
    assert json.loads(r["extra"]) == {"pid": "x", "z": "2"}


def test_types_by_content(spark):
    iso = "2024-01-02T03:04:05Z h {}: x\n"
    files = {
        "auth": iso.format("sshd-session[1]") * 2 + iso.format("app") * 2 + "\nodd\n",  # half of the lines with a program
        "kern": iso.format("kernel") * 7 + iso.format("p") * 2 + "odd\nodd\nodd",
        "cron": iso.format("CRON[1]") * 3,
        "syslog": iso.format("cronie") * 3 + iso.format("suid") * 2,
        "csv": "id,Dst IP,note\n1,x,\"a, b, c\"\n2,y,z\n3,y",
        "raw": "1,2,3\n4,5,6\n7,8,9",  # no header
        "bash_history": "#1700000000\nls -l\n# 17\ncat x\n./run",
        "udev": "  UDEV [1.0] add /a\nA=1\n\n  UDEV [2.0] add /b",
        "applog": "x 2024/01/02 03:04:05\nprose, here\nmore: prose",
        "logfmt": "ts=2024-01-02T03:04:05Z a=1\nb=2 c=3",
    }
    rows = [(k, i + 1, line) for k, t in files.items() for i, line in enumerate(t.split("\n"))]
    lines = spark.createDataFrame(rows, "src_file string, line_no int, line string").withColumn("src_file", F.concat(F.lit("f_"), F.translate("src_file", "aeiouy", "012345")))
    got = {r["src_file"]: r["type"] for r in detected(lines).collect()}
    assert got == {"f_" + k.translate(str.maketrans("aeiouy", "012345")): k for k in files}


def test_values_of_each_parser(spark):
    def one(kind, line, **options):
        return {k: v for k, v in parsed(spark, kind, line, **options)[-1].items() if v is not None and k not in ("raw", "line_no", "src_file", "sigma_ok", "sigma_logsource")}

    r = one("logfmt", 'time=2024-01-02T03:04:05Z SrcIP=1.2.3.4 ip=5.6.7.8 acct="" user=joe status=abc code=404 verb=GET event=login Length=7 lvl=Odd msg="a b" k=1 k=2')
    assert (r["src_ip"], r["user"], r["status"], r["method"], r["bytes"], r["severity"], r["message"], str(r["ts"])) == ("1.2.3.4", "joe", 404, "GET", 7, "Odd", "a b", "2024-01-02 03:04:05")
    assert json.loads(r["extra"]) == {"ip": "5.6.7.8", "status": "abc", "event": "login", "k": "2"} and "event" not in r
    r = one("csv", "Event Time,Time,User,Dst IP,Note,Note\nx,bad,joe,9.9.9.9,1,2,more")
    assert r["user"] == "joe" and json.loads(r["extra"]) == {"Event Time": "x", "Time": "bad", "Dst IP": "9.9.9.9", "Note": "2", "col7": "more"}
    assert str(one("csv", "date,time\nnone,2024-01-02T03:04:05Z")["ts"]) == "2024-01-02 03:04:05"
    assert json.loads(one("csv", "a,1b\n3,4")["extra"]) == {"col1": "3", "col2": "4"}
    assert one("dmesg", "[ 1.5] x") == {"source": "dmesg", "program": "kernel", "event": "kernel", "message": "x", "extra": '{"ktime":1.5}'}
    assert one("fontconfig", "/usr/f: caching, x") == {"source": "fontconfig", "event": "fontconfig", "path": "/usr/f", "message": "/usr/f: caching, x"}
    assert one("bash_history", "# 12 \nls") | {"ts": 0} == {"ts": 0, "source": "bash_history", "program": "bash", "event": "command", "message": "ls"}
    assert one("weberror", "odd 2024/01/02 03:04:05") == {"source": "weberror", "event": "web_error", "message": "odd 2024/01/02 03:04:05"}
    r = one("access", '- - - [01/Feb/2024:10:00:00 +0000] "junk" 200 1')
    assert r["path"] == "junk" and "src_ip" not in r and "method" not in r and r["severity"] == "info"
    r = one("access", "2024-01-02 03:04:05 logfile turned over")
    assert str(r["ts"]) == "2024-01-02 03:04:05" and set(r) == {"ts", "source", "message"}
    r = one("auth", "Jan  2 03:04:05 h sshd[1]: Accepted publickey for joe from 1.2.3.4 port 22 ssh2", base_year=2024)
    assert (r["event"], r["severity"], r["user"], r["src_port"]) == ("ssh_accepted", "accept", "joe", 22)
    r = one("auth", "Jan  2 03:04:05 h sudo: joe : TTY=x ; PWD=/ ; USER=root ; COMMAND=/bin/ls", base_year=2024)
    assert (r["event"], r["severity"], r["user"]) == ("sudo", "info", "joe") and "exe" not in r
    assert set(one("syslog", "Foo  2 03:04:05 h p: at 2024-01-02 03:04:05", base_year=2024)) == {"source", "message"}
    assert one("syslog", "Jan  2 03:04:05 <auth.warning> h p: x", base_year=2024)["severity"] == "warn"
    assert "severity" not in one("syslog", "Jan  2 03:04:05 <fatal> h p: x", base_year=2024)
    assert one("applog", "2024-01-02 03:04:05 ERROR")["message"] == "ERROR"


def test_audit_values_that_took_decoding(spark):
    got = parsed(spark, "auditd", """type=EXECVE msg=audit(1.0:5): argc=2 a0="id" a1=2D75
type=CWD msg=audit(1.0:5): cwd=2F746D702F61
type=PROCTITLE msg=audit(1.0:5): proctitle="plain"
type=USER_X msg=audit(1.0:6): uid=1 res=1 msg='no pairs'""")
    run, user = json.loads(got[0]["extra"]), got[3]
    assert (run["cwd"], run["proctitle"], run["_dec"]) == ("/tmp/a", "plain", "cmd,cwd") and got[0]["program"] == "auditd"
    assert user["severity"] is None and json.loads(user["extra"])["msg"] == "no pairs"


def test_blocks_of_lines_are_found_once(spark, monkeypatch):
    written, kept = {}, parsers.persisted
    monkeypatch.setattr(parsers, "persisted", lambda df, label: written.setdefault(label, kept(df, label)))
    assert len(parsed(spark, "udev", "UDEV  [1.5] add /devices/x (usb)\nDEVPATH=/devices/x\n\nout")) == 2
    assert written["blocks"].where("_in").count() == 2


def test_audit_lines_are_dealt_out_without_their_pairs(spark, monkeypatch):
    written, kept = {}, parsers.persisted
    monkeypatch.setattr(parsers, "persisted", lambda df, label: written.setdefault(label, kept(df, label)))
    head = "type={} msg=audit(1700000000.5:{}): {}"
    lines = [head.format("SYSCALL", 1, 'pid=7 ppid=1 exe="/bin/sh"'), head.format("SYSCALL", 2, 'pid=8 ppid=7 exe="/bin/ls"'), head.format("EXECVE", 2, 'argc=2 a0="ls" a1=2D6C'), head.format("USER_AUTH", 3, "pid=9 msg='op=x acct=\"joe\" res=failed'"), "none"]
    got = parsed(spark, "auditd", "\n".join(lines))
    assert [r["message"] for r in got][2:] == ["ls -l", "x", "none"] and got[3]["user"] == "joe" and got[3]["severity"] == "fail"
    assert json.loads(got[2]["extra"])["parent_exe"] == "/bin/sh" and got[2]["exe"] == "/bin/ls" and got[4]["extra"] is None
    assert written["audit"].count() == 5 and not any(kind.startswith("array") for _, kind in written["audit"].dtypes)


def test_audit_lines_are_taken_once_and_long_groups_stay_in_many_tasks(spark, monkeypatch):
    head = "type={} msg=audit(1700000000.5:{}): {}"
    lines = [head.format("SYSCALL", 1, 'pid=7 ppid=1 exe="/bin/sh"')]
    lines += [head.format("SYSCALL", 2, 'pid=8 ppid=7 exe="/bin/ls"'), *[head.format("PATH", 2, f"item={i}") for i in range(20)], head.format("EXECVE", 2, 'argc=2 a0="ls" a1=2D6C'), head.format("CWD", 2, 'cwd="/tmp"'), head.format("SOCKADDR", 2, "saddr=020000350A0100010000000000000000")]
    lines += ["none", head.format("EXECVE", 2, 'argc=1 a0="id"'), head.format("SYSCALL", 3, "pid=9 ppid=8"), head.format("EXECVE", 3, "argc=1 a0=x a0=y cwd=z serial=0"), head.format("SOCKADDR", 3, "saddr=020000350A0100020000000000000000"), "none", "none"]
    lines += [head.format("EXECVE", 4, "argc=0"), head.format("SOCKADDR", 4, "saddr=020000350A0100030000000000000000"), head.format("SYSCALL", 4, 'exe="/bin/id" ppid=8'), head.format("SOCKADDR", 4, "saddr=020000350A0100040000000000000000")]

    def facts(kept, extra=lambda r: json.loads(r["extra"] or "{}")):
        return [(r["line_no"], r["exe"], r["message"], *[extra(r).get(k) for k in ("serial", "ppid", "cwd", "parent_exe", "dst_ip", "_dec")]) for r in kept]

    whole = facts(parsed(spark, "auditd", "\n".join(lines)))
    assert whole[22] == (23, "/bin/ls", "ls -l", "2", "7", "/tmp", "/bin/sh", None, "cmd") and whole[1][7] == "10.1.0.1"
    assert whole[26] == (27, None, "id", "2", None, None, None, None, None)
    assert whole[28] == (29, None, "y", "3", "8", "z", "/bin/ls", None, None) and whole[27][7] == "10.1.0.2"
    assert whole[32] == (33, "/bin/id", "argc=0", "4", "8", None, "/bin/ls", None, None) and whole[34][7] == whole[35][7] == "10.1.0.4"
    taken, written, kept = spark.sparkContext.accumulator(0), {}, parsers.persisted

    def counted(rows):
        for r in rows:
            taken.add(1)
            yield r

    monkeypatch.setattr(parsers, "persisted", lambda df, label: written.setdefault(label, kept(df, label)))
    rows = [("f.log", i + 1, x, 2024) for i, x in enumerate(lines)]
    source = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4).mapPartitions(counted), "src_file string, line_no int, line string, file_year int")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for size in (1, 7):
            monkeypatch.setattr(parsers, "BLOCK_LINES", size)
            written.clear()
            before = taken.value
            assert facts(parse(source, "auditd").orderBy("line_no").collect()) == whole, size
            assert taken.value - before == len(lines), size
            assert written["audit"].where("_serial = '2'").select(F.input_file_name()).distinct().count() > 1, size
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_lines_of_one_csv_file_stay_in_many_tasks(spark):
    rows = [("f", i, "time,user" if not i else f"x,u{i}", 2024) for i in range(800)]
    lines = spark.createDataFrame(rows, "src_file string, line_no int, line string, file_year int").repartition(8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = [r["count"] for r in parse(lines, "csv").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(parts) == 799 and max(parts) < 200


def test_csv_with_and_without_header(spark):
    got = parsed(spark, "csv", 'time,user,note\n2024-01-02T03:04:05Z,joe,"a, b"')
    assert len(got) == 1 and got[0]["user"] == "joe" and json.loads(got[0]["extra"])["note"] == "a, b"
    got = parsed(spark, "csv", "1,2,3\n4,5,6")
    assert [json.loads(r["extra"])["col1"] for r in got] == ["1", "4"]


def test_dmesg_fontconfig_raw(spark):
    d = parsed(spark, "dmesg", "[   12.5] usb 1-1: new")[0]
    assert json.loads(d["extra"]) == {"ktime": 12.5} and d["message"] == "usb 1-1: new"
    assert parsed(spark, "fontconfig", "/usr/share/fonts: caching, new")[0]["path"] == "/usr/share/fonts"
    assert str(parsed(spark, "raw", "x Wed Sep 30 22:14:05 UTC 2026 y", offset_minutes=60)[0]["ts"]) == "2026-09-30 22:14:05"


def test_apt_blocks(spark):
    got = parsed(spark, "apt", "before\nLog started: 2024-01-02  03:04:05\nUnpacking a\nSetting up a\nLog ended: 2024-01-02  03:05:00\nLog started: 2024-01-03  00:00:00\nbody")
    assert [r["message"] for r in got] == ["before", "Unpacking a; Setting up a", "body"]
    assert str(got[1]["ts"]) == "2024-01-02 03:04:05" and json.loads(got[1]["extra"])["actions"] == 2


    assert [(r["event"], r["program"]) for r in got] == [("dpkg", "dpkg")] * 3 and json.loads(got[1]["extra"])["log_ended"] == "2024-01-02 03:05:00"


def test_udev_blocks(spark):
    a, n, b = parsed(spark, "udev", "UDEV  [1700000000.5] add /dev/x\nDEVPATH=/dev/y\nA=1\n A = 2 \n\nnoise\nUEVENT[1700000001.0] remove /dev/z")
    assert (a["event"], a["path"], a["message"], str(a["ts"])) == ("udev", "/dev/y", "UDEV add /dev/x", "2023-11-14 22:13:20.500000")
    assert json.loads(a["extra"]) == {"DEVPATH": "/dev/y", "A": "2"} and b["path"] is None and b["event"] == "uevent"
    assert (n["message"], n["event"], n["ts"], n["line_no"]) == ("noise", "udev", None, 6)


def block_fold(lines, start, end):
    """(first line number, in a block, lines) by a plain loop."""
    out, held = [], None
    for n, line in enumerate(lines, 1):
        if start(line):
            out += [held] if held else []
            held = (n, True, [line])
        elif end(line):
            if held:
                out.append((held[0], True, held[2] + ([line] if line.strip() else [])))
            elif line.strip():
                out.append((n, False, [line]))
            held = None
        elif held and line.strip():
            held[2].append(line)
        elif line.strip():
            out.append((n, False, [line]))
    return out + ([held] if held else [])


def test_blocks_of_any_length_equal_a_plain_fold(spark, monkeypatch):
    from tracewell.sources import parsers

    monkeypatch.setattr(parsers, "BLOCK_LINES", 7)
    rng = random.Random(4)
    for kind, words, start, end in (
        ("apt", ["Log started: 2024-01-02  03:04:05", "Log ended: 2024-01-02  03:05:00", "Unpacking " + "p" * 300, "Setting up b", " Unpacking no verb", "", "text"] + ["text"] * 6 + ["Removing c"] * 9, lambda x: x.startswith("Log started"), lambda x: x.startswith("Log ended")),
        ("udev", ["UDEV [1.5] add /a (b)", "", "A=1", "B=x=y", "DEVPATH=/p", "odd"] + [f"K{i}={i}" for i in range(14)], lambda x: x.startswith("UDEV"), lambda x: not x.strip()),
    ):
        lines = [rng.choice(words) for _ in range(400)]
        want = block_fold(lines, start, end)
        got = sorted(parsed(spark, kind, "\n".join(lines)), key=lambda r: r["line_no"])
        assert [(r["line_no"], r["raw"]) for r in got] == [(n, "\n".join(ls)) for n, _, ls in want]
        for r, (_, inside, ls) in zip(got, want, strict=True):
            extra = json.loads(r["extra"] or "{}")
            if kind == "apt":
                verbs = [x for x in ls if re.match(parsers.DPKG, x)]
                assert r["message"] == (("; ".join(verbs) if verbs else (ls[1:] or ls)[0])[:2000] if inside else ls[0])
                assert extra.get("actions", 0) == (len(verbs) if inside else 0) and ("log_ended" in extra) == end(ls[-1])
            else:
                kv = dict(x.split("=", 1) for x in ls[1:] if "=" in x) if inside else {}
                assert extra == kv and r["path"] == kv.get("DEVPATH")
                assert r["message"] == ("UDEV add /a (b)" if inside else ls[0])
        # in parts: nothing is lost, each part is bounded, and the first carries what the whole block says
        monkeypatch.setattr(parsers, "BLOCK_CHARS", 1000)
        parts = sorted(parsed(spark, kind, "\n".join(lines)), key=lambda r: r["line_no"])
        monkeypatch.setattr(parsers, "BLOCK_CHARS", 8_000_000)
        assert len(parts) > len(got) and max(len(r["raw"].split("\n")) for r in parts) <= 1000 // 64 + 1
        assert "\n".join(r["raw"] for r in parts) == "\n".join(r["raw"] for r in got)
        first = {r["line_no"]: r for r in parts}
        assert all(first[r["line_no"]]["message"] == r["message"] and first[r["line_no"]]["ts"] == r["ts"] for r in got)
        if kind == "apt":
            assert all(first[r["line_no"]]["extra"] == r["extra"] for r in got)


AUDIT = """type=USER_AUTH msg=audit(1700000000.1:1): pid=50 uid=0 auid=7 msg='op=login acct="joe" exe="/usr/sbin/sshd" addr=1.2.3.4 res=failed'
type=SYSCALL msg=audit(1700000001.9:2): success=yes ppid=50 pid=60 comm="sh" exe="/bin/sh"
type=EXECVE msg=audit(1700000001.9:2): argc=3 a0="sh" a1="-c" a2=6C73202D6C
type=CWD msg=audit(1700000001.9:2): cwd="/root"
type=SYSCALL msg=audit(1700000002.0:3): success=yes ppid=60 pid=61 exe="/usr/bin/nc"
type=SOCKADDR msg=audit(1700000002.0:3): saddr=0200115CCB0071370000000000000000
type=EXECVE msg=audit(1700000002.0:3): argc=2 a0="nc" a1="4444"
"""


def test_auditd_records_are_stitched(spark):
    got = parsed(spark, "auditd", AUDIT)
    assert len(got) == 7
    auth, _, run, _, sys2, sock, nc = got
    assert (auth["user"], auth["src_ip"], auth["severity"], str(auth["ts"])) == ("joe", "1.2.3.4", "fail", "2023-11-14 22:13:20")
    assert run["message"] == "sh -c ls -l" and run["exe"] == "/bin/sh" and run["sigma_logsource"] == "linux/process_creation"
    extra = json.loads(run["extra"])
    assert (extra["ppid"], extra["cwd"], extra["parent_exe"], extra["_dec"]) == ("50", "/root", "/usr/sbin/sshd", "cmd")
    for r in (sys2, sock):
        assert json.loads(r["extra"])["dst_ip"] == "203.0.113.55" and json.loads(r["extra"])["dst_port"] == "4444"
    assert nc["message"] == "nc DD" and json.loads(nc["extra"])["parent_exe"] == "/bin/sh"


def test_archives_nest_and_unsafe_members_are_skipped():
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a.log", "one")
        z.writestr("../evil", "no")
    outer = io.BytesIO()
    with tarfile.open(fileobj=outer, mode="w") as t:
        for name, data in (("in.zip", inner.getvalue()), ("b.gz", gzip.compress(b"two"))):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    assert list(unpacked("x.tar", outer.getvalue())) == [("x.tar!/b.gz", b"two"), ("x.tar!/in.zip!/a.log", b"one")]


def test_ingest_a_folder(spark, tmp_path):
    (tmp_path / "auth.log.1").write_bytes(b"Jan  2 03:04:05 h sshd[1]: Failed password for joe from 1.2.3.4 port 5 ssh2\r\n\xff bad\n")
    (tmp_path / "syslog.gz").write_bytes(gzip.compress(b"Jan  2 03:04:05 h p: x\n"))
    (tmp_path / "cron.bz2").write_bytes(bz2.compress(b"Jan  2 03:04:05 h CRON[1]: x\n"))
    (tmp_path / "app.xz").write_bytes(lzma.compress(b"a=1 b=2\nc=3 d=4\n"))
    (tmp_path / "blob").write_bytes(b"\0\1")
    events, manifest = engine.ingest(spark, str(tmp_path), options=Options(base_year=2024))
    (got,) = [r for r in manifest.collect() if r["status"] == "skipped"]
    assert (got["src_file"], got["reason"], got["events"]) == ("blob", "binary", 0)
    kinds = {r["src_file"]: (r["type"], r["events"]) for r in manifest.where("status = 'ok'").collect()}
    assert kinds == {"auth.log.1": ("auth", 2), "syslog.gz": ("syslog", 1), "cron.bz2": ("cron", 1), "app.xz": ("logfmt", 2)}
    ids = engine.numbered(events).orderBy("id").select("id", "src_file", "line_no").collect()
    assert [r["id"] for r in ids] == list(range(6)) and [r["src_file"] for r in ids][:2] == ["app.xz", "app.xz"]
    case = engine.Case(engine.numbered(events))
    assert case.search("event=ssh_failed ip=1.2.3.4").count() == 1
    assert case.context(2, 1, 1).count() >= 1
    assert case.sql("-- note\nSELECT count(*) AS n FROM events").first()["n"] == 6
    for bad in (
        "DROP TABLE x",
        "INSERT INTO x VALUES (1)",
        "SELECT * FROM parquet.`/etc`",
        "select * from `text`.`/etc/passwd`",
        "select * from text/**/.`/etc/passwd`",
        "select java_method('java.lang.System', 'getProperty', 'user.home')",
        "select * from events where host = (select reflect('java.lang.System', 'getProperty', 'user.home'))",
        "with x as (select * from csv.`/etc/passwd`) select * from x",
        "with x as (select 1) insert into events select * from x",
        "select * from events where id in (select id from other)",
        "explain select * from text.`/etc/passwd`",
        "set spark.sql.shuffle.partitions = 1",
        "create temporary view v as select 1",
        "select system.builtin.reflect('a', 'b')",
    ):
        with pytest.raises(PermissionError):
            case.sql(bad)
    for good in (
        "with x as (select src_file, count(*) as n from events group by src_file having count(*) > 0) select * from x order by n",
        "select e.id from events e join events f using (id) where exists (select 1 from events g where g.id = e.id) union select 1",
        "select upper(host) || '-' as h, row_number() over (partition by source order by id) as r, case when id > 1 then 'a' end as c from events where host like 'h%'",
        "select ip_in_cidr(src_ip, '1.2.0.0/16') as x, ip_in_cidr('2001:db8::1', '2001:db8::/32') as y, ip_in_cidr('no', '::/0') as z from events where src_ip is not null",
        "select * from (values (1), (2)) as t(a) cross join range(3)",
        "explain select * from events",
    ):
        assert case.sql(good).collect(), good
    assert tuple(case.sql("select ip_in_cidr(src_ip, '1.2.0.0/16'), ip_in_cidr('2001:db8::1', '2001:db8::/32'), ip_in_cidr('no', '::/0') from events where src_ip is not null").first()) == (True, True, False)
    case.save(str(tmp_path / "cases" / "one"))
    assert engine.Case.open(spark, str(tmp_path / "cases" / "one")).stats().count() == 4
    assert engine.Case.saved(spark, str(tmp_path / "cases")) == ["one"] and engine.Case.saved(spark, str(tmp_path / "none")) == []


def test_two_hosts_with_files_of_one_name_stay_apart(spark, tmp_path):
    for host, exe in (("a", "/bin/a"), ("b", "/bin/b")):
        (tmp_path / host / "audit").mkdir(parents=True)
        (tmp_path / host / "audit" / "audit.log").write_text(AUDIT.replace("/usr/sbin/sshd", exe))
        (tmp_path / host / "audit" / "syslog").write_text(f"Dec 31 23:59:59 {host} p: x\nJan  1 00:00:00 {host} p: y\n")
    events, manifest = engine.ingest(spark, str(tmp_path), options=Options(base_year=2023))
    got = {r["src_file"]: (r["type"], r["events"], r["status"], r["base_year"]) for r in manifest.collect()}
    assert got == {f"{h}/audit/{n}": (t, k, "ok", 2023) for h in "ab" for n, t, k in (("audit.log", "auditd", 7), ("syslog", "syslog", 2))}
    rows = events.orderBy("src_file", "line_no").collect()
    assert len(rows) == 18
    for h in "ab":
        runs = [json.loads(r["extra"])["parent_exe"] for r in rows if r["src_file"] == f"{h}/audit/audit.log" and r["event"] == "execve"]
        assert runs == [f"/bin/{h}", "/bin/sh"]
        assert [str(r["ts"]) for r in rows if r["src_file"] == f"{h}/audit/syslog"] == ["2023-12-31 23:59:59", "2024-01-01 00:00:00"]
    one, listed = engine.ingest(spark, str(tmp_path / "a" / "audit" / "syslog"), options=Options(base_year=2023))
    assert one.count() == 2 and listed.first()["src_file"] == "syslog"


def test_a_damaged_file_ends_nothing_but_itself(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "bad.gz").write_bytes(b"\x1f\x8bnonsense")
    (tmp_path / "x" / "bad.zip").write_bytes(b"PK\x03\x04nonsense")
    (tmp_path / "syslog").write_text("Jan  2 03:04:05 h p: x\n")
    (tmp_path / "prose").write_text("one\ntwo\nthree\nfour\nfive\n")
    events, manifest = engine.ingest(spark, str(tmp_path), options=Options(base_year=2024), catch_all=False)
    got = {r["src_file"]: r for r in manifest.collect()}
    assert events.count() == 1 and {k: r["status"] for k, r in got.items()} == {"x/bad.gz": "error", "x/bad.zip": "error", "syslog": "ok", "prose": "skipped"}
    assert got["x/bad.gz"]["reason"] and got["prose"]["preview"] == "one\ntwo\nthree\nfour" and got["prose"]["events"] == 0
    from tracewell.sources.lines import sizes

    assert sizes(spark, str(tmp_path)).first()["files"] == 4


def test_only_newlines_end_a_line(spark):
    got = parsed(spark, "syslog", "Jan  2 03:04:05 h p[1]: a\u2028b\r\nJan  2 03:04:06 h p: c\rd\u0085e\n\r\n\t\n\u2003\n\u2028", base_year=2024)
    assert [(r["program"], r["message"], str(r["ts"])) for r in got] == [("p", "a\u2028b\r", "2024-01-02 03:04:05"), ("p", "c\rd\u0085e", "2024-01-02 03:04:06")]
    (r,) = parsed(spark, "access", '1.2.3.4 - - [01/Feb/2024:10:00:00 +0100] "GET /x HTTP/1.1" 200 5\r')
    assert r["status"] == 200 and r["raw"].endswith("\r")
    (r,) = parsed(spark, "auditd", "type=PATH msg=audit(1700000000.1:1): item=0 name=\u2028x\r")
    assert r["event"] == "path"
    assert [(r["message"], str(r["ts"])) for r in parsed(spark, "bash_history", "#1700000000\r\nls")] == [("ls", "2023-11-14 22:13:20")]


def test_state_passes_from_block_to_block(spark, monkeypatch):
    from tracewell.sources import parsers

    year = [f"{m} {d:2d} 00:00:00 h p: {m}" for m in parsers.MONTHS for d in (1, 15)]
    text = "\n".join(year * 3)
    whole = {k: parsed(spark, k, t, base_year=2020) for k, t in (("syslog", text), ("auditd", AUDIT * 4), ("bash_history", "#1700000000\nls\npwd\n#1700000001\nid"), ("udev", "UDEV [1.0] add /a\nA=1\nB=2\n\nx\nUDEV [2.0] add /b\nC=3"), ("apt", "x\nLog started: 2024-01-02  03:04:05\nUnpacking a\nSetting up b\nLog ended: 2024-01-02  03:05:00\ny"))}
    monkeypatch.setattr(parsers, "BLOCK_LINES", 2)
    for k, t in (("syslog", text), ("auditd", AUDIT * 4), ("bash_history", "#1700000000\nls\npwd\n#1700000001\nid"), ("udev", "UDEV [1.0] add /a\nA=1\nB=2\n\nx\nUDEV [2.0] add /b\nC=3"), ("apt", "x\nLog started: 2024-01-02  03:04:05\nUnpacking a\nSetting up b\nLog ended: 2024-01-02  03:05:00\ny")):
        assert parsed(spark, k, t, base_year=2020) == whole[k], k
    assert [r["ts"].year for r in whole["syslog"]] == [2020] * 24 + [2021] * 24 + [2022] * 24


def test_last_values_of_a_key_pass_from_block_to_block(spark, monkeypatch):
    import random

    from tracewell.sources import parsers

    rng = random.Random(3)
    rows = [(rng.choice("aab"), i // 2, i % 2, rng.choice([None, None, f"v{i}"])) for i in range(500)]
    want, held = {}, {}
    for k, p, q, v in rows:
        held[k] = v or held.get(k)
        want[p, q] = held[k]
    df = spark.createDataFrame(rows, "k string, p long, q long, v string").repartition(7)
    for length in (1, 7, 100, 10_000):
        monkeypatch.setattr(parsers, "BLOCK_LINES", length)
        got = parsers.keyed_last(df, ["k"], F.col("p"), ["p", "q"], "v")
        assert {(r["p"], r["q"]): r["_last"] for r in got.collect()} == want
    monkeypatch.setattr(parsers, "BLOCK_LINES", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # one key with all rows: its blocks are dealt to all tasks
        got = parsers.keyed_last(df.withColumn("k", F.lit("one")), ["k"], F.col("p"), ["p", "q"], "v")
        assert got.select(F.spark_partition_id().alias("t")).distinct().count() >= 6
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_saved_sources_are_many_files_and_lookups_skip_them(spark, tmp_path):
    from tracewell.schema import conform

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ev = conform(spark.range(40_000).selectExpr("id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) as ts", "'one' as source", "concat('10.', id div 5000, '.', id % 250, '.', id % 7) as src_ip"))
        engine.Case(ev, False).save(str(tmp_path / "c"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    saved = spark.read.parquet(str(tmp_path / "c"))
    assert len(saved.inputFiles()) == 8 and saved.count() == 40_000
    found = saved.where("src_ip = '10.3.17.3'")
    n = found.count()
    plan = found.select("id")._jdf.queryExecution()
    plan.toRdd().count()
    leaf = plan.executedPlan().collectLeaves().head()
    assert 0 < n < 100 and leaf.metrics().apply("numOutputRows").value() <= 5100  # of 40,000 rows, those of one file


def test_queries_look_up_only_the_keys_they_name(spark, monkeypatch):
    from tracewell.operators import analytics
    from tracewell.schema import conform

    ev = conform(spark.createDataFrame([(1, '{"dst_ip":"1.2.3.4","other":"x"}'), (2, '{"k9":"v"}')], "id long, extra string"))
    asked = []
    real = analytics.extra_keys
    monkeypatch.setattr(analytics, "extra_keys", lambda rows: asked.append(1) or real(rows))
    case = engine.Case(ev, False)
    assert [r["id"] for r in case.matching("DstIp=1.2.3.4").collect()] == [1] and case._keys["dstip"] == "dst_ip" and "other" not in case._keys.values()
    assert [r["id"] for r in case.matching("extra.K9=v").collect()] == [2]
    n = len(asked)
    case.matching("dst-ip=1.2.3.4")  # known by now
    case.matching("words only")
    case.matching("user=joe")
    assert len(asked) <= n + 1


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in ("audit.log.2.gz", "secure", "x.csv", "dmesg", "plain")], "n string")
    assert [r[0] for r in df.select(by_name(F.col("n"))).collect()] == ["auditd", "auth", "csv", "dmesg", None]


def test_content_types(spark):
    texts = {"a": 'x 1\nUEVENT[1.0] add /a\nUDEV [2.0] add /b', "b": "a,b,c\n1,2,3\n4,5,6", "c": "prose\nmore prose", "d": "Jan  2 03:04:05 h kernel: x\nJan  2 03:04:06 h kernel: y"}
    rows = [(f, i, line, 2024) for f, t in texts.items() for i, line in enumerate(t.split("\n"), 1)]
    got = detected(spark.createDataFrame(rows, "src_file string, line_no int, line string, file_year int"))
    assert {r["src_file"]: r["type"] for r in got.collect()} == {"a": "udev", "b": "csv", "c": "raw", "d": "kern"}


def test_rule_conditions_and_skips(spark):
    text = """
title: t
logsource: {product: linux, service: auth}
detection:
  a: {user|base64offset|contains: joe}
  b: {message|windash|contains: ' -x'}
  c: {src_ip|cidr: 10.0.0.0/8}
  d: {user: null}
  f: {message|contains: 'a\\*b'}
  condition: (1 of a* or b or c) and not d or f
---
title: broken
logsource: {product: linux}
detection: {a: {b: 1}, condition: a and nothing}
"""
    rules = R.load_text(text)
    good, skipped = R.split(rules)
    assert [r.title for r, _ in good] == ["t"] and "nothing" in skipped[0][1]
    rows = [(1, "auth", "u", "run /x", None), (2, "auth", "u", "y", "10.9.9.9"), (3, "auth", None, "y", "10.9.9.9"), (4, "auth", None, "a*b", None), (5, "auth", "em9lIGpvZQ==", "aXb", None), (6, "cron", "u", "run /x", None)]
    from tracewell.schema import conform

    ev = conform(spark.createDataFrame(rows, "id long, source string, user string, message string, src_ip string"))
    assert sorted(r["id"] for r in R.hits(ev, rules).collect()) == [1, 2, 4, 5]


def test_findings_tell_what_matched(spark):
    text = """
title: same title
id: one
level: low
logsource: {product: linux, service: auth}
tags: [attack.t1110]
detection: {a: {user: joe, src_ip|startswith: '10.'}, condition: a}
---
title: same title
id: two
level: critical
logsource: {product: linux, service: auth}
tags: [attack.t1110, attack.credential_access]
detection: {a: {user: [joe, ann]}, condition: a}
---
title: windows
logsource: {product: windows}
detection: {a: {b: 1}, condition: a}
---
title: burst
level: high
tags: [attack.t1110]
correlation: {type: event_count, rules: [two], group-by: [user], timespan: 5m, condition: {gte: 2}}
"""
    from datetime import datetime

    from tracewell.schema import conform

    rules = R.load_text(text)
    rows = [(i, datetime(2024, 1, 1, 0, i), "auth", u, ip) for i, (u, ip) in enumerate((("joe", "10.0.0.1"), ("ann", "10.0.0.2"), ("joe", "11.0.0.1"), ("bob", "10.0.0.1")))]
    ev = conform(spark.createDataFrame(rows, "id long, ts timestamp_ntz, source string, user string, src_ip string"))
    found = {r["rule_id"]: r for r in R.findings(ev, rules, 2).collect()}
    assert (found["one"]["n"], found["two"]["n"], found["two"]["sample_ids"]) == (1, 3, [0, 1])
    assert found["one"]["matched"] == ["user=joe · src_ip=10.0.0.1"] and found["two"]["matched"] == ["user=joe", "user=ann"]
    d = R.detect(ev, rules)
    assert (d.applied, [x[0].title for x in d.skipped], d.total()) == (3, ["windows"], 4)
    assert [r["rule_id"] for r in d.findings.collect()] == ["two", "one"]
    assert [(r["user"], r["n"]) for r in d.correlations["burst"].collect()] == [("joe", 2)]
    m = {(r["tactic"], r["technique"]): r for r in R.matrix(d.findings, rules, d.correlations).collect()}
    assert m["credential-access", "T1110"]["level"] == "critical" and m["credential-access", "T1110"]["sample_ids"] == [0, 1, 2]
    assert m["other", "T1110"]["n"] == 3 and m["other", "T1110"]["level"] == "high"


@pytest.mark.parametrize("source,key", [(("linux", "process_creation", ""), "linux/process_creation"), (("linux", "", "sshd"), "linux/sshd"), (("linux", "", "odd"), "linux"), (("", "webserver", ""), "webserver"), (("nginx", "", ""), "webserver"), (("", "", "apache"), "webserver"), (("modsecurity", "", ""), "linux/modsecurity"), (("", "application", ""), "application"), (("windows", "", ""), None), (("django", "application", ""), None)])
def test_log_sources(source, key):
    assert R.logsource_key(dict(zip(("product", "category", "service"), source, strict=True))) == key


def test_addresses_of_both_versions(spark):
    from tracewell.functions.columns import ip_class, ip_key, net_bounds

    want = {"127.0.0.1": "loopback", "10.1.1.1": "internal", "169.254.1.1": "internal", "203.0.113.9": "documentation", "224.0.0.1": "multicast", "8.8.8.8": "external", "::1": "loopback", "2001:db8::5": "documentation", "fe80::1": "internal", "fc00::9": "internal", "ff02::1": "multicast", "2a00:1450::1": "external", "x": None, "1.2.3": None}
    df = spark.createDataFrame([(k,) for k in want], "ip string")
    assert {r["ip"]: r["c"] for r in df.select("ip", ip_class(F.col("ip")).alias("c")).collect()} == want
    import ipaddress

    keys = {r["ip"]: r["k"] for r in df.select("ip", ip_key(F.col("ip")).alias("k")).collect()}
    for ip in want:
        try:
            a = ipaddress.ip_address(ip)
            assert keys[ip] == ("4" if a.version == 4 else "6") + a.packed.hex(), ip
        except ValueError:
            assert keys[ip] is None
    from tracewell.operators.analytics import enrich_any

    nets = spark.createDataFrame([(*net_bounds(n), o) for n, o in (("10.0.0.0/8", "ten"), ("2001:db8::/33", "doc"), ("2001:db8:8000::/33", "other"))], "net_start string, net_end string, org string")
    got = {r["ip"]: r["org"] for r in enrich_any(df.unionByName(spark.createDataFrame([("2001:db8:ffff::1",)], "ip string")), F.col("ip"), nets).collect()}
    assert (got["10.1.1.1"], got["2001:db8::5"], got["2001:db8:ffff::1"], got["8.8.8.8"], got["x"]) == ("ten", "doc", "other", None, None)


def test_marks(spark, tmp_path):
    m = Marks(spark, str(tmp_path / "marks"))
    a, b = m.add(5, "TP", note="n"), m.add(None)
    m.update(a, state="FP")
    m.delete(b)
    assert [(r["mid"], r["state"], r["note"]) for r in m.current().collect()] == [(a, "FP", "n")]
    with pytest.raises(ValueError):
        m.add(1, "odd")


def test_binaries(spark):
    from tracewell.operators.binaries import check
    from tracewell.schema import conform

    pages = {
        "nc": "---\nfunctions:\n  file-read:\n    - code: |\n        cat <<x\n        -----BEGIN KEY-----\n      comment: reads\n      contexts: {sudo: null, suid: null}\n  shell:\n    - code: x\n    - comment: no code\n...\n# prose --- here\n",
        "vi": "functions: {sudo: [{code: a, contexts: sudo}, {code: b}]}",
        "none": "functions: {shell: [{comment: x}]}",
        "broken": "functions: [",
        "sh": "functions: {shell: [{code: sh}]}",
    }
    known = catalogue(spark, pages)
    by = {r["bin"]: r["functions"] for r in known.collect()}
    assert set(by) == {"nc", "vi", "sh"} and set(by["nc"]) == {"file-read", "shell"}
    assert tuple(by["nc"]["file-read"][0]) == ("cat <<x\n-----BEGIN KEY-----", "reads", ["sudo", "suid"]) and by["vi"]["sudo"][0]["contexts"] == ["sudo"] and by["vi"]["sudo"][1]["contexts"] == []
    rows = [
        (1, "auditd", "execve", "/usr/bin/nc", "nc", "joe", '{"euid":"0","auid":"7"}'),
        (2, "bash_history", None, None, "vi /x", "joe", None),
        (3, "auth", "sudo", None, "joe : USER=root ; COMMAND=/usr/bin/vi x", "joe", None),
        (4, "auditd", "syscall", "/bin/SH", "x", "joe", '{"uid":"5","auid":"0"}'),
        (5, "syslog", None, None, 'user x sh_command="sh -c id"', None, None),
        (6, "auditd", "execve", "/usr/bin/ls", "ls", "joe", None),
    ]
    ev = conform(spark.createDataFrame(rows, "id long, source string, event string, exe string, message string, user string, extra string"))
    got = {r["bin"]: r for r in executed(ev, known).collect()}
    assert set(got) == {"nc", "vi", "sh"}
    assert got["nc"]["danger"] and got["nc"]["auids"] == ["7"] and got["nc"]["escalated"] and got["nc"]["n_root"] == 1
    assert (got["vi"]["n"], got["vi"]["by_sudo"], got["vi"]["as_root"], got["vi"]["samples"]) == (2, True, False, [2, 3])
    assert (got["sh"]["n"], got["sh"]["n_root"], got["sh"]["by_appliance"], got["sh"]["as_root"], got["sh"]["danger"]) == (2, 0, True, True, True)
    assert set(got["nc"]["functions"]) == {"file-read", "shell"} and executed(ev, known, 1).where("bin = 'vi'").first()["samples"] == [2]
    assert tuple(check(ev, known).first()) == (4, 3, 3)


def test_stream(spark, tmp_path):
    from tracewell.streaming.live import bursts, read_stream

    (tmp_path / "in").mkdir()
    lines = [f"ts=2024-01-02T03:00:0{i}Z level=error user=joe event=x" for i in range(6)] + ["ts=2024-01-02T09:00:00Z level=info user=ann event=x"]
    (tmp_path / "in" / "a.log").write_text("\n".join(lines))
    ev = read_stream(spark, str(tmp_path / "in"), "logfmt")
    q = bursts(ev, F.col("severity") == "error", "user").writeStream.format("memory").queryName("bursts").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["user"], r["n"]) for r in spark.table("bursts").collect()] == [("joe", 6)]
    with pytest.raises(ValueError):
        read_stream(spark, str(tmp_path), "auditd")


@pytest.mark.parametrize("kind,text", [("auditd", AUDIT * 3), ("syslog", "".join(f"{m}  1 00:00:00 h p[1]: x\n" for m in ("Nov", "Dec", "Jan", "Feb", "Dec", "Jan"))), ("apt", "Log started: 2024-01-02  03:04:05\nUnpacking a\nSetting up b\nLog ended: 2024-01-02  03:05:00\n")])
def test_streamed_files_give_the_rows_of_a_batch(spark, tmp_path, kind, text):
    from tracewell.streaming.live import ingest_stream

    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", str(tmp_path / "checkpoint")
    folder.mkdir()

    def run():
        ingest_stream(spark, str(folder), kind, str(out), checkpoint, Options(base_year=2020)).awaitTermination()

    (folder / "one").write_text(text)
    run()
    for name in ("two", "three"):  # later files, after a restart from the checkpoint
        (folder / name).write_text(text)
    run()
    run()  # nothing new
    got = spark.read.parquet(str(out))
    assert got.select("batch").distinct().count() == 2
    want = engine.ingest(spark, str(folder), kind, Options(base_year=2020))[0]
    columns = [c for c in want.columns if c != "id"]
    rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert rows(got) == rows(want) and got.count() % 3 == 0 < got.count()
