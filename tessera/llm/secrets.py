"""Secret scans over an incremental blob ledger, in DataFrame operations alone."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern (leftmost, non-overlapping) whose group has least characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base kinds, in the order in which spans at one place are listed.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),  # the runs of 16 or more are all that [0-9a-f]+ leaves
)
#: What the method adds to the base.
MORE = (
    # the whole key: header lines, lines of base64, and the last one with the end; without an end, as far as lines go
    Rule(
        "pem",
        2,
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\r\n]+[A-Za-z0-9-]+: [^\r\n]*)*(?:[\x20\t\r\n]+[A-Za-z0-9+/]{20,}={0,2})*(?:(?:[\x20\t\r\n]+[A-Za-z0-9+/]{1,76}={0,2})?[\x20\t\r\n]*-----END [A-Z ]*PRIVATE KEY-----)?",
        0,
        1,
    ),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)
RULES = BASE + MORE
LEDGER = "blob binary, rules array<string>, spans array<struct<kind:string,start:long,end:long>>"
#: The setting that names a ledger to keep; without it a run keeps one of its own.
SETTING = "tessera.secrets.ledger"


def _matches(text, rule: Rule):
    """For each match its place among them, its length, that of the text between it and the one before, and whether it
    holds. The pieces between matches and the matches together are the text, so running sums give the places."""
    found, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    each = F.transform(F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("p"), held.alias("g")), lambda x, i: F.struct(F.lit(rule.kind).alias("kind"), i.alias("i"), F.length(x["m"]).cast("long").alias("m"), F.length(x["p"]).cast("long").alias("p"), (F.length(x["g"]) >= rule.least).alias("ok")))
    return each


def scan(blobs: DataFrame, rules=RULES, ledger: DataFrame | None = None) -> DataFrame:
    """A ledger's new rows for blobs (blob binary, text string; one row a blob): those (blob, rule version) pairs are
    scanned that the ledger doesn't have, and a row tells which they were and what they gave (maybe nothing)."""
    if ledger is not None:
        seen = ledger.select(F.col("blob").alias("_blob"), F.explode("rules").alias("rule")).groupBy("_blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, F.col("blob") == F.col("_blob"), "left").select("blob", "text", F.coalesce("seen", F.array().cast("array<string>")).alias("seen"))
        blobs = blobs.where(~F.forall(F.array(*(F.lit(r.key) for r in rules)), lambda k: F.array_contains("seen", k)))
        todo = {r: ~F.array_contains("seen", r.key) for r in rules}
    else:
        todo = {r: F.lit(True) for r in rules}
    none = F.array().cast("array<struct<kind:string,i:int,m:bigint,p:bigint,ok:boolean>>")
    hits = F.concat(*(F.when(todo[r] & F.col("text").rlike(r.pattern), _matches(F.col("text"), r)).otherwise(none) for r in rules))
    done = F.filter(F.array(*(F.when(todo[r], F.lit(r.key)) for r in rules)), lambda x: x.isNotNull())
    rows = blobs.select("blob", done.alias("rules"), F.explode_outer(hits).alias("h")).select("blob", "rules", "h.*")
    before = Window.partitionBy("blob", "kind").orderBy("i")
    at = (F.sum(F.col("m") + F.col("p")).over(before) - F.col("m")).alias("start")
    spans = rows.select("blob", "rules", "kind", "ok", "m", at)
    span = F.when(F.col("ok"), F.struct("kind", "start", (F.col("start") + F.col("m")).alias("end")))
    return spans.groupBy("blob").agg(F.first("rules").alias("rules"), F.collect_list(span).alias("spans"))


def _listed(spans, rules):
    """kind:start:end by start, then by the rules' order, comma-joined."""
    rank = lambda s: F.array_position(F.array(*(F.lit(r.kind) for r in rules)), s["kind"])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.concat_ws(",", F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def blob_of(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger kept at path, empty if there is none yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def ledger_path(spark) -> str:
    """The ledger that the session names, or a new one in the shared folder."""
    return spark.conf.get(SETTING, None) or f"{C.shared_dir(spark)}/secrets-{uuid.uuid4().hex}"


def scan_new(docs: DataFrame, path: str, rules=RULES) -> DataFrame:
    """Brings the ledger at path up to docs (text) and returns it: every distinct text that it hasn't under some rule
    version is scanned for those alone, and what that gave is appended. A run that fails has appended nothing."""
    spark = docs.sparkSession
    blobs = docs.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    scan(blobs, rules, read_ledger(spark, path)).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def spans_of(ledger: DataFrame, rules=RULES) -> DataFrame:
    """(blob, spans) of the blobs in which the asked rule versions found any: of kinds in the ledger under other
    versions nothing counts, and what was scanned twice counts once."""
    keys = F.array(*(F.lit(r.key) for r in rules))
    kinds = F.filter(F.array(*(F.when(F.array_contains("rules", r.key), F.lit(r.kind)) for r in rules)), lambda k: k.isNotNull())
    known = ledger.where((F.size("spans") > 0) & F.arrays_overlap("rules", keys)).select("blob", F.filter("spans", lambda s: F.array_contains(kinds, s["kind"])).alias("spans"))
    known = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    return known.where(F.size("spans") > 0)


def find_secrets(docs: DataFrame, path: str | None = None, rules=RULES, base=BASE) -> DataFrame:
    """Findings for docs (doc_id, text), through the ledger at path (by default that of ledger_path).

    One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans (the string), and found: the spans
    as structs (code points, end exclusive). Every version of a text is addressed by its SHA-256; each distinct text is
    scanned once for each rule version that the ledger lacks, what is found is written there and read again, and
    findings go to all rows that have the text, by the address: a text that a third of the rows share is scanned once.
    A second run with the same ledger scans nothing; a changed rule gets a new version and is scanned alone.

    Null texts count as empty; repeated rows, null doc_ids and rows that share a text keep their rows; no rows give
    none."""
    known = spans_of(scan_new(docs, path or ledger_path(docs.sparkSession), rules), rules).select(F.col("blob").alias("_blob"), "spans")
    docs = docs.select("doc_id", blob_of(F.col("text")).alias("blob"))
    out = docs.select("doc_id", "blob").join(known, F.col("blob") == F.col("_blob"), "left")
    found = F.coalesce("spans", F.array().cast("array<struct<kind:string,start:long,end:long>>"))
    base_kinds = [r.kind for r in base]
    of_base = F.filter("found", lambda s: s["kind"].isin(base_kinds))
    out = out.select("doc_id", found.alias("found")).select(
        "doc_id",
        *(F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{k}") for k in base_kinds),
        F.sha2(_listed(of_base, rules), 256).alias("base_sha256"),
        _listed(F.col("found"), rules).alias("spans"),
        "found",
    )
    return out


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    return find_secrets(C.table(spark, sf_dir, "documents")).drop("found")


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({i}, {quoted(r.kind)}, {quoted(r.pattern)}, {r.least})" for i, r in enumerate(RULES))
    held = "case rank " + " ".join(f"when {i} then regexp_extract_all(t, {quoted(r.pattern)}, {r.group})" for i, r in enumerate(RULES)) + " end"
    full = "case rank " + " ".join(f"when {i} then regexp_extract_all(t, {quoted(r.pattern)}, 0)" for i, r in enumerate(RULES)) + " end"
    cut = "case rank " + " ".join(f"when {i} then regexp_split_to_array(t, {quoted(r.pattern)})" for i, r in enumerate(RULES)) + " end"
    counts = ", ".join(f"cast(count(*) filter (kind = '{r.kind}') as bigint) as n_{r.kind}" for r in BASE)
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    return f"""
with rules(rank, kind, pattern, least) as (values {rules}),
docs as (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents),
lists as (select k, rank, kind, least, {full} as m, {held} as g, {cut} as p from docs, rules where regexp_matches(t, pattern)),
each_match as (select k, rank, kind, least, m, g, p, unnest(range(1, len(m) + 1)) as i from lists),
spans as (select k, rank, kind, length(m[i]) as n, length(g[i]) >= least as ok,
    coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as start from each_match),
kept as (select k, rank, kind, cast(start as bigint) as start, kind || ':' || cast(start as bigint) || ':' || cast(start + n as bigint) as s from spans where ok),
found as (select k, {counts}, coalesce(string_agg(s, ',' order by start, rank) filter (kind in ({base})), '') as b, string_agg(s, ',' order by start, rank) as spans from kept group by k)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE)}, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join found using (k)"""


ORACLE_SQL = _sql()
