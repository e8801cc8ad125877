"""Product states, approvals and content-versioned publication.

States are one row per dam: the published and the latest product.  A passing result
replaces both, a held one only the latest, so what was published stays.  Versions are
content hashes; an approval names a version and goes stale with it.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillframe.operators import relate, rules

STATE = "dam_id string, published_version string, published_method string, latest_version string, latest_status string, latest_codes array<string>"


def canonical(value: object) -> bytes:
    """JSON with sorted keys and no spaces, in UTF-8."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()


def content_version(value: dict, without: tuple[str, ...] = ("version",)) -> str:
    """First twelve digits of the SHA-256 of the content."""
    return hashlib.sha256(canonical({k: v for k, v in value.items() if k not in without})).hexdigest()[:12]


def apply_results(states: DataFrame, results: DataFrame) -> DataFrame:
    """New states from judged results (dam_id, version, method, status, block_codes); dams without a result keep theirs."""
    r = results.select("dam_id", F.struct("version", "method", "status", "block_codes").alias("r"))
    passed = F.col("r.status") == "pass"
    fresh = F.col("r").isNotNull()
    pick = lambda when, new, old: F.when(when, F.col(new)).otherwise(F.col(old)).alias(old)
    return states.join(r, "dam_id", "full_outer").select(
        "dam_id", pick(fresh & passed, "r.version", "published_version"), pick(fresh & passed, "r.method", "published_method"),
        pick(fresh, "r.version", "latest_version"), pick(fresh, "r.status", "latest_status"), pick(fresh, "r.block_codes", "latest_codes"))


def strays(registered: DataFrame, states: DataFrame, approvals: DataFrame, holds: DataFrame) -> DataFrame:
    """(dam_id, list): entries of a list whose dam isn't registered; publication needs this to be empty."""
    out = None
    for name, df in (("state", states), ("approval", approvals), ("hold", holds)):
        one = relate.unknown_keys(df.select("dam_id"), registered, ["dam_id"]).select("dam_id", F.lit(name).alias("list"))
        out = one if out is None else out.unionByName(one)
    return out


def release_index(states: DataFrame, approvals: DataFrame, holds: DataFrame) -> DataFrame:
    """(dam_id, version, release_status) of every candidate: held, not_exact, unapproved, stale or approved."""
    a = approvals.select("dam_id", F.col("version").alias("approved_version"))
    h = holds.select("dam_id", F.lit(True).alias("held"))
    rows = states.where("published_version is not null").join(a, "dam_id", "left").join(h, "dam_id", "left")
    status = rules.release_status(F.coalesce("held", F.lit(False)), F.col("published_method"), F.col("approved_version"), F.col("published_version"))
    return rows.select("dam_id", F.col("published_version").alias("version"), status.alias("release_status"))


def table_version(df: DataFrame, key: str) -> str:
    """Version of a table's content, independent of row order: hashes are summed by the engine, one row comes back."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.sum(F.conv(F.substring(row, at, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    r = df.agg(F.count(key).alias("n"), *[part(1 + 8 * i).alias(f"h{i}") for i in range(8)]).first()
    return hashlib.sha256("|".join(str(x) for x in r).encode()).hexdigest()[:12]


#: The release states, in the order in which they are listed.
RELEASES = ("approved", "unapproved", "stale", "held", "not_exact")


def release_lists(index: DataFrame, dams: DataFrame) -> DataFrame:
    """(release_status, n, place, dam_id): the candidates of every state in registry order; a state without any is one row of zero.

    A row a candidate, so that no list has to fit into one.
    """
    rows = index.join(dams.select("dam_id", "ord"), "dam_id")
    place = Window.partitionBy("release_status").orderBy("ord", "dam_id")
    listed = rows.select("release_status", F.row_number().over(place).alias("place"), "dam_id")
    counts = rows.groupBy("release_status").agg(F.count("*").alias("n"))
    states = rows.sparkSession.createDataFrame([(s,) for s in RELEASES], "release_status string")
    return states.join(counts, "release_status", "left").join(listed, "release_status", "left").select(
        "release_status", F.coalesce("n", F.lit(0)).alias("n"), "place", "dam_id")


def flow_faults(states: DataFrame, flows: DataFrame) -> DataFrame:
    """(dam_id, fault) of states (dam_id, published_version) and flow records (dam_id, version, content): absent, another version, changed content, orphan.

    Anything here stops a publication; an orphan may be set aside instead.
    """
    both = states.where("published_version is not null").join(flows, "dam_id", "full_outer")
    fault = (F.when(F.col("published_version").isNull(), "orphan").when(F.col("version").isNull(), "absent")
             .when(F.col("version") != F.col("published_version"), "other_version")
             .when(F.substring(F.sha2("content", 256), 1, 12) != F.col("version"), "changed"))
    return both.select("dam_id", fault.alias("fault")).where("fault is not null")


def assemble(dams: DataFrame, states: DataFrame, approvals: DataFrame, holds: DataFrame, notes: DataFrame, flows: DataFrame,
             prune: bool = False) -> dict[str, DataFrame]:
    """The tables of a publication, nothing written: candidates, public, orphans; a stray entry or a fault is an error.

    ``approvals`` names versions, ``holds`` reasons and ``notes`` texts by dam.  Public are
    the approved candidates, without a word of why others are held.  Orphans are set
    aside with ``prune`` and stop the publication without.
    """
    wrong = strays(dams, states, approvals, holds.unionByName(notes.select("dam_id"), allowMissingColumns=True)).limit(5).collect()
    if wrong:
        raise ValueError("not registered: " + ", ".join(f"{r['list']} {r['dam_id']}" for r in wrong))
    faults = flow_faults(states, flows)
    stop = faults if not prune else faults.where("fault <> 'orphan'")
    bad = stop.orderBy("dam_id").limit(5).collect()
    if bad:
        raise ValueError("flow records: " + ", ".join(f"{r['dam_id']} {r['fault']}" for r in bad))
    index = release_index(states, approvals, holds).join(dams.select("dam_id", "ord"), "dam_id").join(notes.select("dam_id", "note"), "dam_id", "left")
    candidates = index.join(holds.select("dam_id", F.col("reason").alias("hold_reason")), "dam_id", "left")
    return {"candidates": candidates, "public": index.where("release_status = 'approved'").drop("release_status"),
            "orphans": faults.where("fault = 'orphan'").select("dam_id")}


def publish(spark: SparkSession, df: DataFrame, root: str, name: str, key: str) -> tuple[str, bool]:
    """Write the table under its version and point to it; (version, whether anything was written).

    The data go to a new folder first, the pointer is switched by one rename, and an
    unchanged table writes nothing.  Readers follow the pointer and never see a mix.
    """
    version = table_version(df, key)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    pointer = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.current")
    fs = pointer.getFileSystem(conf)
    if fs.exists(pointer) and read_pointer(spark, root, name) == version:
        return version, False
    df.write.mode("overwrite").parquet(f"{root}/{name}/{version}")
    draft = jvm.org.apache.hadoop.fs.Path(f"{root}/.{name}.{version}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    # one rename that replaces the old pointer: a crash leaves either of the two
    way = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    replace = spark.sparkContext._gateway.new_array(way, 1)
    replace[0] = way.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), conf).rename(draft, pointer, replace)
    return version, True


def read_pointer(spark: SparkSession, root: str, name: str) -> str:
    return spark.read.text(f"{root}/{name}.current").first()["value"]


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/{read_pointer(spark, root, name)}")
