"""Binaries of a catalogue that events show being run, and with what privilege."""

from __future__ import annotations

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions.columns import basename, extra

CATALOGUE = "bin string, functions map<string,array<struct<code:string,comment:string,contexts:array<string>>>>"
#: Signs that a binary ran.
SIGNS = ("exe", "history", "sudo", "appliance")


def _document(text: str) -> dict:
    """The first YAML document of a page that names functions; what follows it may be anything."""
    try:
        for doc in yaml.safe_load_all(text):
            if isinstance(doc, dict) and "functions" in doc:
                return doc
    except yaml.YAMLError:
        pass
    return {}


def _examples(entries) -> list[tuple[str, str | None, list[str]]]:
    """code, comment and contexts of the examples that have code."""
    out = []
    for x in entries or []:
        code = str(x.get("code") or "").strip() if isinstance(x, dict) else ""
        if code:
            where = x.get("contexts")
            out.append((code, str(x.get("comment") or "").strip() or None, [str(k) for k in where] if isinstance(where, (dict, list)) else [str(where)] if where else []))
    return out


def catalogue(spark: SparkSession, pages: dict[str, str]) -> DataFrame:
    """bin, functions (technique -> examples), from pages by binary name; a binary without an example is left out."""
    rows = []
    for name, text in sorted(pages.items()):
        found = {str(k): e for k, v in (_document(text).get("functions") or {}).items() if (e := _examples(v))}
        if found:
            rows.append((name.lower(), found))
    return spark.createDataFrame(rows, CATALOGUE)


def _first(text: Column) -> Column:
    return basename(F.regexp_extract(F.trim(text), r"^(\S+)", 1))


def signals(events: DataFrame) -> DataFrame:
    """bin, sign, id, ts, source, user, auid, root, text: one row for each sign that a binary ran; an event may show several."""
    m = F.coalesce("message", F.lit(""))
    signs = {
        "exe": F.when(F.col("exe") != "", basename(F.col("exe"))),
        "history": F.when(F.col("source") == "bash_history", _first(m)),
        "sudo": F.when(m.contains("COMMAND="), _first(F.regexp_extract(m, r"COMMAND=(\S+)", 1))),
        "appliance": F.when(m.contains("sh_command=") | m.contains("shell_command="), basename(F.regexp_extract(m, r"sh(?:ell)?_command=\W?([A-Za-z0-9._/-]+)", 1))),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("sign"), v.alias("bin")) for k, v in signs.items()])
    root = F.coalesce((extra("euid") == "0") | (extra("uid") == "0"), F.lit(False))
    out = events.select(F.inline(F.filter(rows, lambda x: x["bin"].isNotNull() & (x["bin"] != ""))), "id", "ts", "source", "user", extra("auid").alias("auid"), root.alias("root"), F.coalesce("message", "raw", "exe").alias("text"))
    return out.select("bin", "sign", "id", "ts", "source", "user", "auid", "root", "text")


def executed(events: DataFrame, known: DataFrame, samples: int = 200) -> DataFrame:
    """Catalogued binaries that ran, dangerous ones first.

    bin, n (signs), n_root, n_sudo, n_appliance, as_root, by_sudo, by_appliance, escalated (root with another login),
    auids (those logins), danger, functions, samples (ids of the first events that show it). Signs are counted in the
    tasks that read them and meet the catalogue once; samples are the first by time, then id.
    """
    found = signals(events).join(F.broadcast(known.select("bin")), "bin")  # the catalogue came from the driver
    own = F.col("sign") == "exe"
    login = F.when(own & F.col("root") & ~F.col("auid").isin("0", "4294967295", "-1", "unset"), F.col("auid"))
    n = found.groupBy("bin").agg(
        F.count("*").alias("n"),
        F.count_if(own & F.col("root")).alias("n_root"),
        F.count_if(F.col("sign") == "sudo").alias("n_sudo"),
        F.count_if(F.col("sign") == "appliance").alias("n_appliance"),
        F.array_sort(F.collect_set(login)).alias("auids"),
    )
    rank = F.row_number().over(Window.partitionBy("bin").orderBy(F.col("ts").asc_nulls_last(), "id"))
    shown = found.select("bin", "id", "ts").distinct().withColumn("_r", rank).where(F.col("_r") <= samples)
    shown = shown.groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("_r", "id"))).alias("_s"))
    flags = {"as_root": (F.col("n_root") > 0) | (F.col("n_appliance") > 0), "by_sudo": F.col("n_sudo") > 0, "by_appliance": F.col("n_appliance") > 0, "escalated": F.size("auids") > 0}
    out = n.withColumns(flags).withColumn("danger", F.col("as_root") | F.col("by_sudo") | F.col("escalated"))
    out = out.join(shown, "bin").join(F.broadcast(known), "bin").withColumn("samples", F.transform("_s", lambda x: x["id"])).drop("_s")
    return out.orderBy(F.desc("danger"), F.desc("n"), "bin")


def check(events: DataFrame, known: DataFrame) -> DataFrame:
    """One row: binaries that ran, those of them in the catalogue, and the catalogue's size."""
    ran = signals(events).select("bin").distinct().join(F.broadcast(known.select("bin", F.lit(True).alias("_known"))), "bin", "left")
    return ran.agg(F.count("*").alias("checked"), F.count_if("_known").alias("matched")).crossJoin(F.broadcast(known.agg(F.count("*").alias("catalogue"))))
