"""Log type of a file by its name, else by its first lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.sources import parsers as P

#: Name patterns in order; the first that is found decides.
NAMES = [
    (r"audit\.log|auditd|audit", "auditd"),
    (r"auth\.log|secure", "auth"),
    (r"kern\.log|\bkern\b", "kern"),
    (r"cron", "cron"),
    (r"syslog|messages", "syslog"),
    (r"error[._-]?log|error_log", "weberror"),
    (r"access[._-]?log|access", "access"),
    (r"bash_history|\.history", "bash_history"),
    (r"\.csv$", "csv"),
    (r"dmesg", "dmesg"),
    (r"term\.log|dpkg|apt.*term|apt/history", "apt"),
    (r"fontconfig|fc-cache", "fontconfig"),
    (r"udev(adm)?(monitor)?", "udev"),
]
#: Programs of authentication logs, besides all that begin with sshd.
AUTH_PROGRAMS = "sudo su login sshd systemd-logind polkitd polkit unix_chkpwd gdm-password gdm passwd useradd usermod groupadd sshd-session".split()
#: Non-blank lines that a type is told by, and those of them that must fit a header.
HEAD, CSV_HEAD = 200, 80


def by_name(name: Column) -> Column:
    """By the last part of a path; folders say nothing."""
    n = F.lower(F.regexp_replace(F.substring_index(name, "/", -1), r"(?i)\.(gz|bz2|xz)$", ""))
    n = F.regexp_replace(n, r"\.\d+$", "")
    out = F.when(n.rlike(NAMES[0][0]), NAMES[0][1])
    for pattern, kind in NAMES[1:]:
        out = out.when(n.rlike(pattern), kind)
    return out


def by_content(lines: DataFrame) -> DataFrame:
    """src_file, by_content: decided by the shares of the first 200 non-blank lines that fit each format."""
    head = P._lines(lines).withColumn("_r", F.row_number().over(Window.partitionBy("src_file").orderBy("line_no"))).where(F.col("_r") <= HEAD)
    line = F.col("line")
    head = head.withColumn("_cells", F.size(P.cells("line"))).withColumn("_h", F.when(F.col("_r") == 1, P.cells("line")))
    # at most HEAD rows of a file
    first = Window.partitionBy("src_file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = head.withColumn("_first", F.max(F.when(P.is_header("_h"), F.col("_cells"))).over(first))
    fits = (F.col("_cells") >= 2) & (F.abs(F.col("_cells") - F.col("_first")) <= 1)

    def share(p: Column, name: str) -> Column:
        return F.avg(F.coalesce(p, F.lit(False)).cast("double")).alias(name)

    plain, dated = line.rlike(P.SYSLOG), line.rlike(P.SYSLOG_ISO)
    syslog = plain | dated
    program = F.when(plain, F.regexp_extract(line, P.SYSLOG, 6)).when(dated, F.regexp_extract(line, P.SYSLOG_ISO, 4))
    command = line.rlike(P.HISTORY_MARK) | (~plain & ~line.rlike(P.ACCESS) & line.rlike(r"(?U)^\s*[\w./~-]+(\s|$)"))
    s = head.groupBy("src_file").agg(
        share(line.rlike(P.AUDIT), "auditd"),
        share(line.rlike(P.NGINX_ERROR) | line.rlike(P.APACHE_ERROR), "weberror"),
        share(line.rlike(P.ACCESS) | line.rlike(P.ACCESS_VIA), "access"),
        F.max("_first").alias("width"),
        F.avg(F.when((F.col("_r") > 1) & (F.col("_r") <= CSV_HEAD), F.coalesce(fits, F.lit(False)).cast("double"))).alias("csv"),
        share(line.rlike(P.DMESG), "dmesg"),
        F.sum(P._trimmed(line).rlike(P.UDEV).cast("int")).alias("udev"),
        F.max(P._trimmed(line).rlike(P.LOG_START)).alias("apt_start"),
        F.sum(line.rlike(P.DPKG).cast("int")).alias("apt"),
        share(line.rlike(P.FONTCONFIG), "fontconfig"),
        share(syslog, "syslog"),
        # of the lines with a program
        F.avg((program == "kernel").cast("double")).alias("kern"),
        F.avg(program.isin("CRON", "cron").cast("double")).alias("cron"),
        F.avg((program.isin(AUTH_PROGRAMS) | program.startswith("sshd")).cast("double")).alias("auth"),
        share(F.size(F.regexp_extract_all(line, F.lit(P.PAIR), F.lit(1))) >= 2, "logfmt"),
        share(line.rlike(P.TS_ANY), "applog"),
        F.sum(line.rlike(P.HISTORY_MARK).cast("int")).alias("marks"),
        share(command, "commands"),
    )
    c = F.col
    kind = (
        F.when(c("auditd") >= 0.6, "auditd")
        .when(c("weberror") >= 0.6, "weberror")
        .when(c("access") >= 0.6, "access")
        .when((c("width") >= 3) & (c("csv") >= 0.8), "csv")
        .when(c("dmesg") >= 0.6, "dmesg")
        .when(c("udev") >= 2, "udev")
        .when(c("apt_start") & (c("apt") >= 2), "apt")
        .when(c("fontconfig") >= 0.6, "fontconfig")
        .when((c("syslog") >= 0.6) & (c("kern") >= 0.7), "kern")
        .when((c("syslog") >= 0.6) & (c("cron") >= 0.7), "cron")
        .when((c("syslog") >= 0.6) & (c("auth") >= 0.4), "auth")
        .when(c("syslog") >= 0.6, "syslog")
        .when(c("logfmt") >= 0.6, "logfmt")
        .when(c("applog") >= 0.3, "applog")
        .when((c("marks") >= 1) & (c("commands") >= 0.7), "bash_history")
    )
    return s.select("src_file", kind.alias("by_content"))


def detected(lines: DataFrame, prefer_content: bool = False, catch_all: bool = True) -> DataFrame:
    """src_file, type: name first, content else; unknown files are raw, or have no type without catch_all."""
    files = lines.select("src_file").distinct().withColumn("by_name", by_name(F.col("src_file")))
    both = files.join(by_content(lines), "src_file", "left")
    order = ("by_content", "by_name") if prefer_content else ("by_name", "by_content")
    return both.select("src_file", F.coalesce(*order, *([F.lit("raw")] if catch_all else [])).alias("type"))
