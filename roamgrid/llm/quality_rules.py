"""Quality rules: an ordered decision list, learned by sequential covering, over statistics of each text.

Each rule is a conjunction of thresholds. A rule grows by the threshold with the best gain on two thirds of
the labelled rows and is pruned, last threshold first, on the rest; the rows that it covers go, and the
next one is grown. Counts come from Spark aggregations, and the list is a chain of Spark conditionals.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, documents
from .quality import graded

#: White space between words, symbols, words of a window, and the base rules' limits.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Labelled rows that rules are learned from, at most: those with the smallest hash of their id.
MAX_TRAIN_ROWS = 20_000
#: A word is a flag if at least FLAG_ROWS of the labelled rows hold it (as a share) and FLAG_PURITY of these are rejected; at most FLAGS.
FLAG_ROWS, FLAG_PURITY, FLAGS = 0.002, 0.95, 128
#: Cut points of a statistic, thresholds of a rule, rules of a list; a rule must be right on this share of the rows it is pruned on, and a list ends when less than LEFT of the rejected rows are open.
CUTS, CONDITIONS, RULES, PRECISION, LEFT = 48, 4, 16, 0.97, 0.003
#: Statistics that rules may test, from the counts of a text.
STATISTICS = {
    "word_length": "word_chars / n_words",
    "symbols": "n_symbols / n_words",
    "marks": "n_marks / n_words",
    "capitals": "n_capitals / word_chars",
    "repeated_lines": "n_dup_lines / n_lines",
    "repeated_words": "n_repeat_words / n_words",
    "distinct_words": "n_distinct / n_words",
    "words": "n_words",
    "flags": "n_flags",
}


def _count(text, pattern: str):
    """Characters in matches of pattern."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def text_statistics(docs: DataFrame, flags: list[str] = (), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_lines,
    n_distinct, n_capitals, n_marks, n_flags (occurrences of words of `flags`, in lower case).

    Time grows with the length of a text, times its logarithm where windows repeat. Hashes order a text's
    windows; the words of neighbours decide. A null text has no words and no lines.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    has_word = lambda s: F.length(s) > 0
    d = d.withColumn("words", F.filter(F.split("text", SPACE, -1), has_word))
    d = d.withColumn("lines", F.when(F.contains("text", F.lit("\n")), F.filter(F.split("text", "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))))
    last = F.size("words") - WINDOW
    window = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    hashes = F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), window))
    some = "(?<![\\p{L}])(?:" + "|".join(re.escape(w) for w in flags) + ")(?![\\p{L}])"
    d = d.select(
        "doc_id", "words", hashes.alias("hashes"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count("text", SYMBOLS).alias("n_symbols"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size("lines"), F.when(F.size("words") > 0, 1).otherwise(0)).cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        _count("text", "[A-Z]+").alias("n_capitals"),
        _count("text", "!+").alias("n_marks"),
        (F.regexp_count(F.lower("text"), F.lit(some)) if flags else F.lit(0)).cast("long").alias("n_flags"),
    )
    # Only texts in which a hash repeats are looked at again: windows by hash, neighbours compared word by word.
    again = F.coalesce(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.lit(False))
    ordered = F.when(again, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at")))))
    d = d.withColumn("ordered", ordered).drop("hashes")
    at = lambda i: F.get("ordered", i)["at"]
    equal = lambda i: (F.get("ordered", i)["h"] == F.get("ordered", i + 1)["h"]) & F.forall(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: F.get("words", at(i) + k) == F.get("words", at(i + 1) + k))
    twins = F.filter(F.sequence(F.lit(0), F.size("ordered") - 2), equal)
    starts = F.when(F.col("ordered").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.transform(twins, lambda i: F.array(at(i), at(i + 1)))))))
    d = d.withColumn("starts", starts).drop("ordered", "words")
    # Each start covers WINDOW words, or as many as there are up to the next start.
    covered = F.aggregate(F.sequence(F.lit(0), F.size("starts") - 1), F.lit(0), lambda n, i: n + F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - F.get("starts", i), F.lit(WINDOW))))
    d = d.withColumn("n_repeat_words", F.when(F.size("starts") > 0, covered).otherwise(0).cast("long"))
    return d.drop("starts")


def base_failed():
    """The fixed rule in front of the learned ones."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def statistic(name: str):
    return F.coalesce(F.expr(re.sub(r"(\w+) / (\w+)", r"try_divide(\1, \2)", STATISTICS[name])).cast("double"), F.lit(0.0))


def find_flags(rows: DataFrame) -> list[str]:
    """Words of rows(text, bad) that many rows hold, nearly all of them bad."""
    n = rows.count()
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+", -1))
    held = rows.select("bad", F.explode(words).alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("t"))
    good = held.filter((F.col("n") >= max(10, FLAG_ROWS * n)) & (F.col("t") >= FLAG_PURITY * F.col("n")))
    return [r["word"] for r in good.orderBy(F.desc("n"), "word").limit(FLAGS).collect()]


def _met(conditions):
    """Whether a row meets all of [(statistic, above, cut)]."""
    out = F.lit(True)
    for name, above, at in conditions:
        out = out & ((F.col(name) > at) if above else (F.col(name) <= at))
    return out


def _gain(p: int, n: int, before: float) -> float:
    return p * (math.log2(p / (p + n)) - before) if p else 0.0


def _bin(name: str, cuts: list):
    """How many of the cuts a row lies above."""
    return F.struct(F.lit(name).alias("name"), F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(name))).alias("bin"))


def _grow(rows: DataFrame, cuts: dict) -> list:
    """The conditions of one rule, each by one aggregation: rows by statistic and cut, rejected and not."""
    rule: list = []
    while len(rule) < CONDITIONS:
        seen = {name: [[0, 0] for _ in range(len(at) + 1)] for name, at in cuts.items()}
        for r in rows.filter(_met(rule)).select("bad", F.explode("bins").alias("b")).groupBy("b.name", "b.bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect():
            seen[r["name"]][r["bin"]] = [r["p"], r["n"]]
        every = next(iter(seen.values()))
        p, n = (sum(x[k] for x in every) for k in (0, 1))
        if not p or not n:
            break
        before, best = math.log2(p / (p + n)), (0.0, None)
        for name, counts in seen.items():
            low_p = low_n = 0
            for i, at in enumerate(cuts[name]):
                low_p, low_n = low_p + counts[i][0], low_n + counts[i][1]
                for above, (q, m) in ((False, (low_p, low_n)), (True, (p - low_p, n - low_n))):
                    best = max(best, (_gain(q, m, before), (name, above, at)), key=lambda x: x[0])
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def learn(rows: DataFrame) -> list[list[tuple[str, bool, float]]]:
    """Rules, each a list of (statistic, above, cut), in order, from rows(doc_id, bad, and a column for each of STATISTICS).

    A row that a rule covers is rejected. No rows, or none of one kind: no rules.
    """
    names = list(STATISTICS)
    share = [i / CUTS for i in range(CUTS + 1)]
    found = rows.agg(*[F.percentile_approx(c, share, 10_000).alias(c) for c in names]).first()
    cuts = {c: sorted(set(found[c]))[:-1] for c in names if found[c]}
    cuts = {c: at for c, at in cuts.items() if at}
    if not cuts:
        return []
    rows = cut(rows.withColumn("bins", F.array(*[_bin(c, at) for c, at in cuts.items()])))
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    grown, tested = rows.filter(~part), rows.filter(part)
    total = rows.filter("bad").count()
    rules: list = []
    covered = F.lit(False)
    while len(rules) < RULES:
        rule = _grow(grown.filter(~covered), cuts)
        if not rule:
            break
        kept = [rule[: k + 1] for k in range(len(rule))]
        of = tested.filter(~covered).agg(*[F.count_if((F.col("bad") == F.lit(bad)) & _met(r)).alias(f"{'np'[bad]}{k}") for k, r in enumerate(kept) for bad in (False, True)]).first()
        worth = lambda k: (of[f"p{k}"] - of[f"n{k}"]) / max(1, of[f"p{k}"] + of[f"n{k}"])
        k = max(range(len(kept)), key=lambda k: (worth(k), -k))
        if of[f"p{k}"] < PRECISION * (of[f"p{k}"] + of[f"n{k}"]) or not of[f"p{k}"]:
            break
        rules.append(kept[k])
        covered = covered | _met(kept[k])
        if rows.filter("bad").filter(~covered).count() <= LEFT * total:
            break
    return rules


def verdict(rules: list):
    """The number of the first rule (from 1) that covers a row, else null, as one chain of conditionals."""
    out = F
    for i, rule in enumerate(rules):
        out = out.when(_met(rule), i + 1)
    return out.otherwise(None) if rules else F.lit(None).cast("int")


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """One row per input row: doc_id, the counts of text_statistics(), base_failed, rule (number of the learned
    rule that rejects it, or null) and kept. labels(doc_id, quality, toxic): 0 for quality or 1 for toxic rejects.

    A null text counts as empty and fails, as any text of fewer than LEAST_WORDS words. Rows and ids may
    repeat: each row is judged by itself; of an id's labels the lowest grade counts, and labels with nulls
    are left out, as is a null id. Without labels only the base rule rejects. No rows in: no rows out.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = cut(graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    known = F.broadcast(chosen)  # max_rows rows of two numbers
    sample = cut(d.filter("text is not null").join(known, "doc_id").select("doc_id", "text", "grade"))
    flags = find_flags(sample.select("text", (F.col("grade") < 2).alias("bad")))
    with_statistics = lambda df: df.select("*", *[statistic(c).alias(c) for c in STATISTICS])
    counted = cut(text_statistics(d, flags))
    rows = counted.filter(~base_failed()).join(known, "doc_id")
    rules = learn(with_statistics(rows).select("doc_id", (F.col("grade") < 2).alias("bad"), *STATISTICS))
    out = with_statistics(counted).select(*counted.columns, base_failed().alias("base_failed"), verdict(rules).alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def query(spark, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
