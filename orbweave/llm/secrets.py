"""Secret scans with an incremental blob ledger. All of it is DataFrame and SQL functions.

A text version is addressed by its content (SHA-256). The ledger holds, for each blob, the rule versions that have scanned
it, and what each of them found. A scan hashes all rows, looks up their blobs, and runs only the rule versions that have not
seen a blob, on one row for each such blob; findings then join back to every row that holds the blob. Findings carry the name
of their rule and its version, so those of a superseded version stay in the ledger as history and are in no report.
update() keeps a ledger as tables in shared storage, to which each scan appends only what is new.

Places come without any user function: a text split at a rule's matches gives the lengths between them, and running sums
of these and the matches' lengths are the places, in code points.

Joins by blob have one row for each blob on one side. The other may have a hot blob, whose rows Spark's skew join handling
can split.

Defined cases. Null text: the empty blob, which holds nothing. Null ids and repeated rows: reported one by one. Overlapping
spans of several kinds are all reported; redact() joins them first. Other columns are kept by redact(), whatever their names.
An empty table: no rows, and an empty ledger. Very long texts: scanned whole, each in the one row that holds it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, saved, table


class Rule(NamedTuple):
    kind: str
    pattern: str
    version: int = 1
    #: A group of the pattern and its least length; shorter matches are dropped, but take up their place.
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: A private key goes to its END line if no other line of dashes comes first (up to 200 runs of up to four dashes between), else over the
#: headers and base64 lines that follow; of these, a last one may be short, which the line
#: break after it tells; a span ends before a match's last line breaks. The SQL engine knows neither possessive repeats nor looking ahead, so no pattern has them.
KEY_BEGIN = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
KEY_TO_END = r"[^-]*(?:-{1,4}[^-]+){0,200}-----END [A-Z ]{0,40}PRIVATE KEY-----"
LINES = "{1,1000}"
KEY_LINES = r"(?:\s+[A-Z][A-Za-z-]{2,40}:\x20[^\r\n]*){0,9}(?:\s+[A-Za-z0-9+/]{16,}={0,2})" + LINES + r"(?:\r?\n[A-Za-z0-9+/]{1,15}={0,2}(?:\r?\n|\z))?"
#: The first BASE rules are the agreed ones; the others only add spans.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", KEY_BEGIN + r"(?:" + KEY_TO_END + r"|" + KEY_LINES + r")?", 3),
)
BASE = 3
MARK = "[REDACTED]"
SEEN, FOUND = "blob string, rules array<string>", "blob string, rule string, start long, end long"


class Ledger(NamedTuple):
    """seen: blob, rules (names with versions that have scanned it). found: blob, rule (name with version), start, end."""

    seen: DataFrame
    found: DataFrame

    def current(self, rules: tuple[Rule, ...]) -> DataFrame:
        """found by these rule versions: blob, kind (place in rules), start, end."""
        places = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)))
        return self.found.where(F.col("rule").isin([r.name for r in rules])).select("blob", F.element_at(places, F.col("rule")).alias("kind"), "start", "end")


def empty_ledger(spark: SparkSession) -> Ledger:
    return Ledger(spark.createDataFrame([], SEEN), spark.createDataFrame([], FOUND))


def load(spark: SparkSession, path: str) -> Ledger:
    """The ledger that update() keeps at path. Findings that an update cut short has written twice count once."""
    seen = spark.read.schema(SEEN).parquet(f"{path}/seen")
    seen = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"))  # rule versions: bounded
    return Ledger(seen, spark.read.schema(FOUND).parquet(f"{path}/found").distinct())


def append(new: Ledger, path: str) -> None:
    """Adds a ledger's rows to that at path (a folder in shared storage). Findings go first: a blob that is told to be seen has its findings there."""
    new.found.write.mode("append").parquet(f"{path}/found")
    new.seen.write.mode("append").parquet(f"{path}/seen")


def _blob(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256)


def _matches(text: Column, rule: Rule, number: int) -> Column:
    """Null without a match, else kind and an array of (before, length, ok, tail); tail: line breaks at a match's end."""
    pattern = F.lit(rule.pattern)
    size = lambda x: F.char_length(x).cast("long")
    before = F.transform(F.split(text, rule.pattern, -1), size)
    whole = F.regexp_extract_all(text, pattern, 0)
    length, tail = F.transform(whole, size), F.transform(whole, lambda x: size(x) - size(F.rtrim(x, F.lit("\r\n"))))
    ok = F.transform(F.regexp_extract_all(text, pattern, rule.group), lambda x: F.char_length(x) >= rule.least) if rule.group else F.transform(length, lambda x: x >= rule.least)
    return F.when(text.rlike(rule.pattern), F.struct(F.lit(number).alias("kind"), F.arrays_zip(before.alias("before"), length.alias("length"), ok.alias("ok"), tail.alias("tail")).alias("m")))


def scan_new(docs: DataFrame, ledger: Ledger | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> Ledger:
    """What a scan of docs adds to the ledger: the pairs of a blob and a rule version that it has not, and their findings."""
    names = [r.name for r in rules]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("blob", _blob("text"))
    blobs = rows.groupBy("blob").agg(F.min(F.struct("id")).getField("id").alias("id"))
    every = F.array(*map(F.lit, names))
    if ledger is None:
        blobs = blobs.withColumn("todo", every)
    else:
        blobs = blobs.join(ledger.seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("rules", F.array().cast("array<string>")))).where(F.size("todo") > 0).drop("rules")
    blobs = saved(blobs, "secret-blobs")
    unseen = rows.alias("r").join(blobs.alias("b"), (F.col("r.blob") == F.col("b.blob")) & F.col("r.id").eqNullSafe(F.col("b.id"))).select("r.blob", "r.text", "b.todo")
    text = F.col("text")
    each = F.array(*(F.when(F.array_contains("todo", r.name), _matches(text, r, i)) for i, r in enumerate(rules)))
    hits = unseen.select("blob", F.explode(F.array_compact(each)).alias("h")).select("blob", "h.kind", F.posexplode("h.m").alias("nth", "m")).where("m.length is not null")
    running = Window.partitionBy("blob", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.distinct().withColumn("end", F.sum(F.expr("m.before + m.length")).over(running)).where("m.ok")  # a blob may be met twice, if rows repeat
    found = hits.select("blob", F.element_at(every, F.col("kind") + 1).alias("rule"), F.expr("end - m.length").alias("start"), F.expr("end - m.tail").alias("end"))
    return Ledger(blobs.select("blob", F.col("todo").alias("rules")), saved(found, "secret-findings"))


def scan(docs: DataFrame, ledger: Ledger | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> Ledger:
    """The ledger after a scan of docs: unseen pairs of a blob and a rule version are scanned, others taken from ledger."""
    new = scan_new(docs, ledger, id_col, text_col, rules)
    if ledger is None:
        return new
    seen = ledger.seen.unionByName(new.seen).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"))
    return Ledger(seen, ledger.found.unionByName(new.found))


def update(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> Ledger:
    """Scans docs with the ledger at path, appends what is new, and gives the whole. The first call makes the folder."""
    spark = docs.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/seen")
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    append(scan_new(docs, load(spark, path) if there else None, id_col, text_col, rules), path)
    return load(spark, path)


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, ledger: Ledger, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each row of docs: id, counts and spans by start, then kind; base_sha256 is the hash of the base rules' list."""
    per = ledger.current(rules).groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))  # a blob's findings: bounded by its text
    per = per.select("blob", "all", F.filter("all", lambda x: x["kind"] < BASE).alias("base"))
    counts = [F.size(F.expr(f"filter(base, x -> x.kind = {i})")).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules[:BASE])]
    per = per.select("blob", *counts, F.sha2(_listed(F.col("base"), rules).cast("binary"), 256).alias("base_sha256"), _listed(F.col("all"), rules).alias("spans"))
    per = saved(per, "secret-reports")  # so that the join's stage only joins, and a hot blob's rows can be split
    none = {f"n_{r.kind}": F.lit(0).cast("long") for r in rules[:BASE]} | {"base_sha256": F.sha2(F.lit("").cast("binary"), 256), "spans": F.lit("")}
    rows = docs.select(F.col(id_col), _blob(text_col).alias("blob")).join(per, "blob", "left")
    return rows.select(id_col, *(F.coalesce(c, v).alias(c) for c, v in none.items()))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", ledger: Ledger | None = None) -> DataFrame:
    """docs with MARK in place of each secret. size_col, if there, is set to the new length of a text that changes."""
    names, plain = docs.columns, docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {n: f"c{i}" for i, n in enumerate(names)}
    text = at[text_col]
    found = scan(plain, ledger, at[id_col], text).current(RULES)
    order = Window.partitionBy("blob").orderBy("start", "end")
    apart = F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    islands = found.withColumn("new", apart.cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy("blob", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    before = F.coalesce(F.lag("end").over(Window.partitionBy("blob").orderBy("start")), F.lit(0))
    cuts = islands.withColumn("from", before).groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "from", "end"))).alias("cuts"))
    cuts = saved(cuts, "secret-cuts")  # as in report()
    part = lambda a, b: F.substr(F.col(text), (a + 1).cast("int"), (b - a).cast("int"))
    clean = F.concat(F.array_join(F.transform("cuts", lambda x: F.concat(part(x["from"], x["start"]), F.lit(MARK))), ""), part(F.element_at("cuts", -1)["end"], F.char_length(text)))
    rows = plain.withColumn("blob", _blob(text)).join(cuts, "blob", "left").withColumn("clean", F.when(F.col("cuts").isNotNull(), clean))
    new = {text_col: F.coalesce("clean", text)}
    if size_col in at:
        new[size_col] = F.when(F.col("clean").isNotNull(), F.char_length("clean").cast(docs.schema[size_col].dataType)).otherwise(F.col(at[size_col]))
    return rows.select(*(new.get(n, F.col(at[n])).alias(n) for n in names))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the corpus, one after the other: half of the rows, then all. The second scan takes the first one's blobs from the ledger."""
    docs, path = table(spark, sf_dir, "documents"), new_path(spark, "secret-ledger")
    update(docs.where(F.xxhash64("text").bitwiseAND(F.lit(1)) == 0), path)
    return report(docs, update(docs, path))


def _folded(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _oracle() -> str:
    # The SQL engine bounds nested repeats, so there a key's lines aren't counted.
    patterns = [r.pattern.replace(LINES, "+").replace("(?i:password|passwd|secret|token|api_?key)", _folded("password|passwd|secret|token|api_?key")).replace("'", "''") for r in RULES]
    each = "\nunion all\n".join(
        f"select doc_id, {i} as kind, '{r.kind}' as name, unnest(string_split_regex(text, '{p}')) as piece, unnest(regexp_extract_all(text, '{p}')) as hit, unnest(regexp_extract_all(text, '{p}', {r.group})) as part, generate_subscripts(string_split_regex(text, '{p}'), 1) as nth, {r.least} as least from d where regexp_matches(text, '{p}')"
        for i, (r, p) in enumerate(zip(RULES, patterns, strict=True))
    )
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
h as ({each}),
s as (select *, cast(sum(length(piece) + length(hit)) over (partition by doc_id, kind order by nth) as bigint) as stop from h where hit is not null),
f as (select doc_id, kind, name || ':' || (stop - length(hit)) || ':' || (stop - length(hit) + length(rtrim(hit, chr(13) || chr(10)))) as span, stop - length(hit) as start from s where length(part) >= least),
a as (
  select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
         string_agg(span, ',' order by start, kind) filter (kind < {BASE}) as base, string_agg(span, ',' order by start, kind) as spans
  from f group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (doc_id)
"""


ORACLE = _oracle()
