"""Secret scans with Spark expressions only, and corpus-wide ownership of what they find.

Three fixed patterns give the base spans. Longer token-like strings with both letters and digits
are further candidates. Each candidate's hash is counted over all documents, by distinct
repositories and owners: what many owners or many repositories hold is an example that was copied;
what one owner alone holds, in few repositories, looks live. Base spans are always reported; candidates
that look live are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, documents, join_with_hot

#: Fixed patterns of the base kinds, in order; a match of assign counts if group 2 has 6 characters or more.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_MIN = 6
#: Further candidates.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")

_SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"
#: Elements that running() takes one by one.
STRETCH = 256
_MOST = 2**31 - 1


def running(values, op, start: int):
    """op(start, v0), op(op(start, v0), v1), ...: an array as long as `values`, an array of int.

    An array can only grow by a copy of all of it, so this goes by stretches of STRETCH elements, and then once over their
    totals: the copies of a text of n matches are n x STRETCH and (n / STRETCH)**2 numbers, halved.
    """
    none = F.array().cast("array<int>")
    onward = lambda acc, x: F.concat(acc, F.array(op(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(start)), x)))
    # Elements by their place: a slice would copy the whole array first.
    stretch = lambda v, b: F.transform(F.sequence(b * STRETCH, F.least((b + 1) * STRETCH, F.size(v)) - 1), lambda i: F.get(v, i))
    stretches = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STRETCH).cast("int")), lambda b: F.aggregate(stretch(v, b), none, onward))
    before = lambda each: F.concat(F.array(F.lit(start)), F.aggregate(F.transform(each, lambda s: F.element_at(s, -1)), none, onward))
    joined = lambda each: F.flatten(F.zip_with(each, F.slice(before(each), 1, F.size(each)), lambda s, base: F.transform(s, lambda x: op(base, x))))
    # Arrays of one element keep what they hold from being made anew for each use.
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    return F.when(F.size(values) > 0, once(values, lambda v: once(stretches(v), joined))).otherwise(none)


def _matches(text, pattern: str, when, value: int = 0):
    """What the pattern finds: struct of the reported values, the lengths of the matches, and those of each match with the gap before it."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    size = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    # Without the text's last gap, which no match follows.
    steps = F.zip_with(size, F.slice(gaps, 1, F.size(gaps) - 1), lambda m, g: m + g)
    return F.when(when, F.struct(values.alias("values"), size.alias("size"), steps.alias("steps")))


def _spans(found: str, kind: int, least: int = 0):
    """Spans of a column of _matches(), in code points; values shorter than `least` are left out."""
    stops = running(F.col(f"{found}.steps"), lambda a, b: a + b, 0)
    ends = F.zip_with(stops, F.col(f"{found}.size"), lambda e, m: F.struct(e.alias("stop"), (e - m).alias("start")))
    span = F.zip_with(ends, F.col(f"{found}.values"), lambda e, v: F.struct(e["start"].alias("start"), F.lit(kind).alias("kind"), e["stop"].alias("stop"), v.alias("value")))
    return F.when(F.col(found).isNull(), F.array().cast(_SPAN)).otherwise(F.filter(span, lambda s: F.length(s["value"]) >= least)).cast(_SPAN)


def find_candidates(docs: DataFrame, id_col="doc_id", text_col="text", owner_col="source", repo_col="doc_id") -> DataFrame:
    """Per row: doc_id, owner, repo, base and more: arrays of (start, kind, stop, value), each sorted by start. No value in `more` overlaps one in `base`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), text.alias("text"))
    # The cheap tests in front are implied by the patterns.
    d = d.select(
        "doc_id", "owner", "repo",
        _matches(F.col("text"), ASSIGN, F.col("text").rlike("[:=]"), 2).alias("assign"),
        _matches(F.col("text"), ACCESS, F.contains("text", F.lit("AKIA"))).alias("access"),
        _matches(F.col("text"), HEX, F.col("text").rlike("[0-9a-f]{24}")).alias("hex"),
        _matches(F.col("text"), TOKEN, F.col("text").rlike(r"[A-Za-z0-9+/_=-]{20}")).alias("token"),
    )
    base = F.sort_array(F.concat(_spans("assign", 0, ASSIGN_MIN), _spans("access", 1), _spans("hex", 2)))
    mixed = F.filter(_spans("token", 3), lambda c: c["value"].rlike("[0-9]") & c["value"].rlike("[A-Za-z]"))
    d = d.select("doc_id", "owner", "repo", base.alias("base"), mixed.alias("more"))
    # In order of their starts, a candidate overlaps a base span if one before it ends later than it starts, or one after it starts before it ends.
    d = d.withColumn("every", F.when((F.size("base") > 0) & (F.size("more") > 0), F.sort_array(F.concat("base", "more"))))
    of_base = lambda field, other: F.transform("every", lambda s: F.when(s["kind"] < 3, s[field]).otherwise(F.lit(other)))
    d = d.withColumns({"reach": running(of_base("stop", 0), lambda a, b: F.greatest(a, b), 0), "ahead": F.reverse(running(F.reverse(of_base("start", _MOST)), lambda a, b: F.least(a, b), _MOST))})
    around = F.arrays_zip(F.col("every").alias("s"), F.col("reach").alias("reach"), F.col("ahead").alias("ahead"))
    apart = F.filter(around, lambda x: (x["s"]["kind"] == 3) & (x["reach"] <= x["s"]["start"]) & (x["ahead"] >= x["s"]["stop"]))
    more = F.when(F.col("every").isNull(), F.col("more")).otherwise(F.transform(apart, lambda x: x["s"]))
    return d.select("doc_id", "owner", "repo", "base", more.alias("more"))


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate hash over the whole corpus: value_hash, n_rows, n_owners, n_repos. A null owner or repository counts in neither."""
    each = found.select("owner", "repo", F.explode(F.concat("base", "more")).alias("c")).select("owner", "repo", F.xxhash64("c.value").alias("value_hash"))
    # The first step is pre-aggregated by all three keys, so that a string that is everywhere doesn't meet in one task.
    once = each.groupBy("value_hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("value_hash").agg(F.sum("n").alias("n_rows"), F.count_distinct("owner").alias("n_owners"), F.count_distinct("repo").alias("n_repos"))


def scan_secrets(docs: DataFrame, *, live_owners: int = 1, example_owners: int = 3, live_repos: int = 4, example_repos: int = 10, **columns) -> DataFrame:
    """One row per input row: doc_id, base (array of spans), owned (array of added spans), n_live,
    n_example (of all its candidates, how many are live or copied).

    Live: held by at most `live_owners` (1) owners and at most `live_repos` (4) repositories. Copied: held
    by `example_owners` (3) owners or more, or by `example_repos` (10) repositories or more. What lies
    between is neither. A repository is a document unless `repo_col` names another column.

    A null text counts as empty. Rows may repeat, and an id too: each row is scanned by itself.
    Empty and clean texts have empty arrays. No rows in: no rows out.
    """
    found = cut(find_candidates(docs, **columns).withColumn("row", F.monotonically_increasing_id()))
    some = F.size("base") + F.size("more") > 0
    each = found.filter(some).select("row", F.explode(F.concat("base", "more")).alias("c")).withColumn("value_hash", F.xxhash64("c.value"))
    known = join_with_hot(each, ownership(found), "value_hash", "n_rows")
    live = (F.col("n_owners") <= live_owners) & (F.col("n_repos") <= live_repos)
    copied = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    per_row = known.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when((F.col("c.kind") == 3) & live, F.col("c")))).alias("owned"),
        F.count_if(live).alias("n_live"),
        F.count_if(copied).alias("n_example"),
    )
    out = found.join(per_row, "row", "left")
    return out.select("doc_id", "base", F.coalesce("owned", F.array().cast(_SPAN)).alias("owned"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))))


def query(spark, sf_dir: str) -> DataFrame:
    out = scan_secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "owned"))).alias("spans"),
        "n_live",
        "n_example",
    )
