"""Statistics of texts against a plain version, and rules on rows whose verdict is known."""

import random
import re
import time
from collections import Counter

import pytest

from roamgrid.llm import quality_rules

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [s for s in text.split("\n") if re.search(WORD, s)]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def fails(text):
    n, *_, repeated = plain(text)
    return n < 10 or 100 * repeated > 20 * n


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def texts():
    rng = random.Random(4)
    some = [" ".join(rng.choices("abcdefg", k=rng.randrange(60))) for _ in range(60)]
    some += ["\n".join(rng.choices(["x y", "x  y", "", " \t", "z #|<", "é ü😀"], k=12)) for _ in range(40)]
    return [*some, None, "", " \n\x0b\x0c\r", "a a a a a", "a a a a a a", "a b c d", " x   y", "one\x1ftwo\x85three", "end\n", "\nend\nend"]


def test_statistics(spark):
    given = texts()
    rows = quality_rules.text_statistics(spark.createDataFrame([(i, t, "c", 5) for i, t in enumerate(given)], "doc_id long, text string, words string, n_words long")).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in rows} == {i: plain(t) for i, t in enumerate(given)}


def test_long_texts(spark):
    """Time grows as the text: a million words, of which windows repeat everywhere, nowhere, or in lines."""
    rng = random.Random(1)
    given = ["For " * 1_000_000, " ".join(map(str, range(1_000_000))), "\n".join(f"line {rng.randrange(1000)} of some more words" for _ in range(150_000))]
    began = time.time()
    rows = quality_rules.text_statistics(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in rows} == {i: plain(t) for i, t in enumerate(given)}
    assert time.time() - began < 60


def rated(n=1500, seed=2):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" * rng.randrange(1, 4) for a in "bdglm" for b in "aeiou" for c in "nrst"]
    out = []
    for i in range(n):
        text = rng.choices(words, k=rng.randrange(20, 80))
        kind = "symbols" if i % 7 == 0 else "flag" if i % 11 == 0 else "capitals" if i % 13 == 0 else ""
        if kind == "symbols":
            text = [w + rng.choice("#$%") for w in text]
        elif kind == "flag":
            text[3] = rng.choice(["Awful,", "terrible"])
        elif kind == "capitals":
            text = [w.upper() + "!!" for w in text]
        out.append((i, " ".join(text), kind))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = rated()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows] + [(9000, None, "x", 1), (9001, "", None, None), (None, rows[1][1], "x", 1), (3, rows[3][1], "x", 1)], "doc_id long, text string, kept string, rule int")
    labels = [(i, int(k not in ("symbols", "capitals")), int(k == "flag")) for i, _, k in rows if i % 3] + [(None, 1, 0), (1, None, 1), (2, 1, 0), (2, 1, 0)]
    return rows, docs.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learned_list(tables):
    rows, docs, labels = tables
    got = quality_rules.judge(docs, labels).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    for i, text, kind in rows:
        assert tuple(by[i][c] for c in COUNTS) == plain(text)
        assert by[i]["base_failed"] == fails(text)
        assert by[i]["kept"] == (not kind and not fails(text)), (i, kind, text)
    assert not by[9000]["kept"] and by[9001]["base_failed"] and by[None]["kept"]
    assert len({r["rule"] for r in got} - {None}) >= 3


def test_rules_are_conditions(tables, spark):
    """Two bounds of one statistic, and a rule that pruning shortens: noise doesn't make rules."""
    rng = random.Random(3)
    names = list(quality_rules.STATISTICS)
    made = [(i, {c: rng.random() for c in names}) for i in range(3000)]
    rows = [(i, 0.4 < s["symbols"] < 0.6 and s["marks"] > 0.5, *[s[c] for c in names]) for i, s in made]
    df = spark.createDataFrame(rows, "doc_id long, bad boolean, " + ", ".join(f"{c} double" for c in names))
    rules = quality_rules.learn(df)
    caught = df.withColumn("rule", quality_rules.verdict(rules))
    assert rules and caught.filter("bad and rule is null").count() <= 0.15 * df.filter("bad").count()
    assert caught.filter("not bad and rule is not null").count() <= 0.02 * len(rows)
    noise = spark.createDataFrame([(i, rng.random() < 0.2, *r[2:]) for i, r in enumerate(rows)], df.schema)
    assert quality_rules.learn(noise) == []


def test_no_labels(tables, spark):
    rows, docs, labels = tables
    got = quality_rules.judge(docs, labels.filter("false")).collect()
    assert len(got) == docs.count() and all(r["kept"] == (not r["base_failed"]) and r["rule"] is None for r in got)
    assert quality_rules.judge(docs.filter("false"), labels).collect() == []


def test_registered_query(tables, spark, tmp_path):
    rows, docs, labels = tables
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = quality_rules.query(spark, str(tmp_path)).collect()
    texts_of = {i: t for i, t, _ in rows} | {9000: None, 9001: "", None: rows[1][1]}
    assert all(tuple(r[c] for c in COUNTS) == plain(texts_of[r["doc_id"]]) and r["base_failed"] == fails(texts_of[r["doc_id"]]) for r in got) and len(got) == len(rows) + 4
