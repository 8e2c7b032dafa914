"""Secret scans by an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its text.  A ledger row says
that one blob was scanned under one rule version and what was found, so a run scans only the
(blob, rule version) pairs that the ledger lacks, each blob once however many paths hold it, and
joins findings back to all paths.  A blob that many paths hold is dealt to several tasks there.

Defined cases: a null text is the empty one; repeated rows are paths of the same blob; a null
path or ``doc_id`` is kept; spans that begin together come by kind; an empty table gives an empty
result; columns other than those named are ignored or carried, and a column ``blob`` or ``spans``
that is there already keeps its name (the new one has ``_`` behind it).  Texts of any length are
scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causelake.llm.common import doc_texts, free_name, materialise, spread_join, table


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; one stays if ``group`` (0: all) has ``least`` characters or more."""

    name: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# The rules' patterns and lengths.  Where a shorter match cannot hide a longer one
# the least length stands in the pattern itself.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
#: What the query's first run knew: an older version of one rule, whose findings no longer count.
OLDER_RULES = (*RULES[:2], Rule("hex", 0, r"[0-9a-f]{40,}", 0, 40))
#: Unseen blobs up to which their ids are broadcast, so that only their texts are exchanged.
FEW_BLOBS = 200_000

LEDGER_SCHEMA = "blob binary, rule string, spans array<struct<start:int,end:int>>"
NO_SPANS = "cast(array() as array<struct<start:int,end:int>>)"


def blob_id(text: Column) -> Column:
    """SHA-256 of the text's UTF-8."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _matches(rule: Rule) -> Column:
    """What one rule matches in ``text``: its order, the gap before it, its length, whether it stays."""
    # split() gives the gaps between the same leftmost matches that regexp_extract_all() gives
    pattern = F.lit(rule.pattern)
    gaps = F.split("text", rule.pattern, -1)
    columns = [F.regexp_extract_all("text", pattern, F.lit(0)).alias("m"), gaps.alias("gap")]
    if rule.group:
        columns.append(F.regexp_extract_all("text", pattern, F.lit(rule.group)).alias("g"))
    return F.transform(
        F.arrays_zip(*columns),
        lambda z, i: F.struct(
            F.lit(rule.key).alias("rule"), i.alias("i"), F.length(z["gap"]).alias("gap"),
            F.length(F.coalesce(z["m"], F.lit(""))).alias("length"), (F.length(z["g" if rule.group else "m"]) >= rule.least).alias("stays"),
        ),
    )


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, text, missing``: each blob once, with the rule versions the ledger lacks for it.

    Where few blobs are unseen their ids are broadcast and no other text is exchanged.
    """
    own = versions.select(blob_id(F.col("text")).alias("blob"), "text")
    # pre-aggregated before the shuffle, so a hot blob is one row a task
    once = lambda rows: rows.groupBy("blob").agg(F.first("text").alias("text"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        return once(own).withColumn("missing", keys)
    seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    missing = F.when(F.col("seen").isNull(), keys).otherwise(F.array_except(keys, "seen"))
    todo = materialise(own.select("blob").distinct().join(seen, "blob", "left").select("blob", missing.alias("missing")).where(F.size("missing") > 0), "unseen")
    if todo.count() <= FEW_BLOBS:
        return once(own.join(F.broadcast(todo.select("blob")), "blob", "left_semi")).join(F.broadcast(todo), "blob").select("blob", "text", "missing")
    return once(own).join(todo, "blob").select("blob", "text", "missing")


def found(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, rule, spans`` of the pairs in which something was found; offsets in code points."""
    none = F.expr("cast(array() as array<struct<rule:string,i:int,gap:int,length:int,stays:boolean>>)")
    each = [F.when(F.array_contains("missing", r.key) & F.col("text").rlike(r.pattern), _matches(r)).otherwise(none) for r in rules]
    rows = blobs.select("blob", F.inline(F.concat(*each)))
    order = Window.partitionBy("blob", "rule").orderBy("i")
    end = F.sum(F.col("gap") + F.col("length")).over(order)
    spans = rows.select("blob", "rule", "stays", (end - F.col("length")).cast("int").alias("start"), end.cast("int").alias("end"))
    return spans.where("stays").groupBy("blob", "rule").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (``blob, rule, spans``), also for pairs in which nothing was found.

    ``versions`` has a ``text`` for every historical version of every path.  Append the
    result to the ledger; the next run then skips these pairs.
    """
    todo = unseen(versions, ledger, rules)
    pairs = todo.select("blob", F.explode("missing").alias("rule"))
    return pairs.join(found(todo, rules), ["blob", "rule"], "left").select("blob", "rule", F.coalesce("spans", F.expr(NO_SPANS)).alias("spans"))


def _by_blob(ledger_rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, spans`` of the blobs in which current rules found something."""
    kind = F.lit(0)
    for i, rule in enumerate(rules):
        kind = F.when(F.col("rule") == rule.key, i).otherwise(kind)
    current = ledger_rows.where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
    return (
        current.select("blob", kind.alias("kind"), F.explode("spans").alias("s"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("kind"), F.col("s.end").alias("end")))).alias("spans"))
    )


NO_KINDS = "cast(array() as array<struct<start:int,kind:int,end:int>>)"


def findings(versions: DataFrame, ledger_rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows of ``versions`` with ``blob`` and ``spans`` (``start, kind, end`` by start, then kind as listed)."""
    own, spread = [F.col(f"`{c}`") for c in versions.columns], _spread(versions)
    rows = versions.select(F.struct(*own).alias("row"), spread.alias("spread"), blob_id(F.coalesce("text", F.lit(""))).alias("blob"))
    joined = spread_join(rows, _by_blob(ledger_rows, rules), "blob", "spread")
    blob = free_name("blob", versions.columns)
    return joined.select("row.*", F.col("blob").alias(blob), F.coalesce("spans", F.expr(NO_KINDS)).alias(free_name("spans", [*versions.columns, blob])))


def _spread(rows: DataFrame) -> Column:
    """A number by which the paths of one blob are dealt out: a hash of what else the row holds."""
    others = [F.col(f"`{c}`") for c, kind in rows.dtypes if c != "text" and "map" not in kind and kind != "variant"]
    return F.xxhash64(*others) if others else F.lit(0).cast("long")


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span replaced; spans come by start, and overlapping ones count as one."""
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def cut(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        kept = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.when(apart, kept).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(spans, first, cut, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))


def redacted(documents: DataFrame, ledger_rows: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``documents`` with every secret in ``text`` replaced and ``n_chars``, if there, counted anew.

    Without given ledger rows all texts are scanned first.  A null text stays null.
    """
    text = F.coalesce("text", F.lit(""))
    if ledger_rows is None:
        ledger_rows = materialise(scan(documents.select(text.alias("text")), None, rules), "ledger")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), _spread(documents).alias("spread"), blob_id(text).alias("blob"))
    rows = spread_join(rows, _by_blob(ledger_rows, rules), "blob", "spread")
    hit, own = F.col("spans").isNotNull(), F.col("row.text")
    new = {"text": F.when(hit, redact(own, F.col("spans"))).otherwise(own)}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(hit, F.length(new["text"])).otherwise(F.col("row.n_chars")).cast(documents.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns])


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one ledger: the first sees half of the paths and an older rule; the second all paths, and scans what the ledger lacks."""
    versions = doc_texts(table(spark, sf_dir, "documents"))
    early = versions.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    ledger = materialise(scan(early, None, OLDER_RULES), "ledger")
    ledger = ledger.unionByName(materialise(scan(versions, ledger), "ledger"))
    rows = findings(versions, ledger).select("doc_id", "spans")
    base = spans_text(F.col("spans"))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), base.alias("spans"),
    )


def _oracle_kind(kind: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
      select doc_id, {kind} as kind, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
        s := list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(m[:i-1], lambda g: length(g))), 0),
        n := length(m[i]), ok := length(p[i]) >= {rule.least}))) as x
      from (select doc_id, regexp_extract_all(t, '{pattern}', 0) m, regexp_extract_all(t, '{pattern}', {rule.group}) p,
                   regexp_split_to_array(t, '{pattern}') gaps
            from (select doc_id, coalesce(text, '') t from documents) where regexp_matches(t, '{pattern}'))"""


ORACLE_SQL = f"""
with found as ({" union all ".join(_oracle_kind(i, r) for i, r in enumerate(RULES))}),
spans as (
  select doc_id, kind, cast(x.s as bigint) as a, cast(x.s + x.n as bigint) as b,
         ['assign', 'access', 'hex'][kind + 1] || ':' || cast(x.s as bigint) || ':' || cast(x.s + x.n as bigint) as said
  from found where x.ok),
docs as (
  select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
         string_agg(said, ',' order by a, kind) as spans
  from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join docs using (doc_id)
"""
