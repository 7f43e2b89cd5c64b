"""The registered secret scan, all its columns, against a plain version; long texts in time that grows with their length."""

import hashlib
import random
import re
import time

from roamgrid.llm import secret_scan

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
KINDS = ("assign", "access", "hex", "owned")
DOCS = "doc_id long, text string, source string, lang string, base string, spans string, row int, owner int"


def spans(text):
    text = text or ""
    base = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    base += [(m.start(), 1, m.end(), m.group()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    base += [(m.start(), 2, m.end(), m.group()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    more = [(m.start(), 3, m.end(), m.group()) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text) if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group())]
    taken = bytearray(len(text))
    for a, _, b, _ in base:
        taken[a:b] = b"\1" * (b - a)
    return sorted(base), [c for c in more if not any(taken[c[0] : c[2]])]


def plain(rows):
    """Per row what the query returns, in order of the rows."""
    found = [spans(t) for _, t, _ in rows]
    held = {}
    for (i, _, s), (base, more) in zip(rows, found, strict=True):
        for c in base + more:
            held.setdefault(c[3], []).append((s, i))
    distinct = {v: (len({s for s, _ in h} - {None}), len({i for _, i in h} - {None})) for v, h in held.items()}
    live = {v for v, (o, r) in distinct.items() if o <= 1 and r <= 4}
    copied = {v for v, (o, r) in distinct.items() if o >= 3 or r >= 10}
    text = lambda cs: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in cs)
    out = []
    for (i, _, _), (base, more) in zip(rows, found, strict=True):
        n = [sum(c[1] == k for c in base) for k in range(3)]
        every = sorted(base + [c for c in more if c[3] in live])
        out.append((i, *n, hashlib.sha256(text(base).encode()).hexdigest(), text(every), sum(c[3] in live for c in base + more), sum(c[3] in copied for c in base + more)))
    return out


def made():
    rng = random.Random(3)
    token = lambda n: "".join(rng.choice("abcdef0123456789") for _ in range(n))
    shared = ["zz" + token(22) + "Q1", "yy" + token(30), "password=" + "Zx9" * 8]
    rows = []
    for i in range(150):
        parts = [rng.choice(["plain words", "password: hunter2x", f'api_key="{token(8)}"', "AKIA" + "Q7" * 9, "AKIA" + "Q7" * 9 + "ü", token(24), "token=abc", "ü😀" + token(25) + "Zé", "secret=" + token(40), token(30) + "Zz" + token(5), *shared]) for _ in range(rng.randrange(12))]
        rows.append((i, rng.choice([" ~ ", "\n", ""]).join(parts), rng.choice("stu")))
    return [*rows, (900, None, "s"), (901, "", None), (5, rows[5][1], "s"), (5, rows[5][1], "s"), (None, shared[0], None)]


def ask(spark, rows, path):
    spark.createDataFrame([(i, t, s, "en", "b", "p", 1, 2) for i, t, s in rows], DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return sorted(map(tuple, secret_scan.query(spark, str(path)).collect()), key=str)


def test_registered_query(spark, tmp_path):
    rows = made()
    assert ask(spark, rows, tmp_path) == sorted(plain(rows), key=str)


def test_many_matches_in_one_text(spark, tmp_path):
    """5 MB of hex strings, with candidates between them, and as many assignments: some seconds, not hours."""
    rng = random.Random(1)
    hexes = " ".join("%032x" % rng.getrandbits(128) if k % 3 else "Qz%030x-" % rng.getrandbits(120) for k in range(150_000))
    assigns = " ".join(f"token={rng.getrandbits(60):x}" for _ in range(60_000))
    rows = [(1, hexes, "a"), (2, assigns, "b"), (3, "For " * 1_000_000, "b")]
    want = sorted(plain(rows), key=str)
    began = time.time()
    got = ask(spark, rows, tmp_path)
    assert time.time() - began < 90
    assert got == want


def test_running(spark):
    """Sums and maxima over arrays around the length of a stretch."""
    from pyspark.sql import functions as F

    n = secret_scan.STRETCH
    rows = [(k, [(i * 7919) % 101 for i in range(k)]) for k in (0, 1, 2, n - 1, n, n + 1, 5 * n, 5 * n + 3)]
    df = spark.createDataFrame(rows, "k int, v array<int>")
    got = df.select("k", secret_scan.running(F.col("v"), lambda a, b: a + b, 0), secret_scan.running(F.col("v"), lambda a, b: F.greatest(a, b), -1)).collect()
    for k, sums, most in got:
        v = dict(rows)[k]
        assert sums == [sum(v[: i + 1]) for i in range(k)] if k < 600 else sums[-1] == sum(v) and len(sums) == k
        assert most == [max(v[: i + 1]) for i in range(k)] if k < 600 else most[-1] == max(v)


def test_no_rows(spark, tmp_path):
    assert ask(spark, [], tmp_path) == []
