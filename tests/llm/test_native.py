"""URL filter, line dedup and sharding."""

import hashlib
import os
import random
import time

import pytest
from compare import assert_same
from pyspark.sql import functions as F

from sigloom.llm import line_dedup as L
from sigloom.llm import queries as Q
from sigloom.llm import sharding as S
from sigloom.llm import url_filter as U
from sigloom.llm._common import Stage


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    assert_same(Q.QUERIES[name](spark, sf_dir), sf_dir, Q.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["op2_url_filter", "op5_line_dedup", "op10_sharding"])
def test_no_python_on_the_way(spark, sf_dir, name):
    plan = Q.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# ---- urls ---------------------------------------------------------------------------------------------------
def test_hosts_paths_and_rules(spark):
    urls = {
        "HTTP://A.Example.ORG:80/es/x?q#f": ("a.example.org:80", "/es/x", None),
        "https://a.Example.org/es/x?q": ("a.example.org", "/es/x", "example.org/es/"),
        "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/"),
        "https://badexample.org/es/": ("badexample.org", "/es/", "org/"),
        "x://y.com/de/a://b": ("y.com", "/de/a://b", "com/de/"),
        "x://y.com?/de/": ("y.com", "", None),
        "x://y.com#a": ("y.com", "", None),
        "://": ("", "", None), "no scheme": ("", "", None), "": ("", "", None), "h://ÉA/É": ("Éa", "/É", None), "x://org/": ("org", "/", "org/"), "x://org": ("org", "", None),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, None])], "page_id long, url string")
    out = {r.page_id: r for r in U.filter_urls(df, U.listed_frame(spark, ("y.com",))).collect()}
    for i, (u, (host, path, rule)) in enumerate(urls.items()):
        said = {t: v for v, t in U.RULES}.get(rule) or ("block" if host == "y.com" else "allow")
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == (host, path, rule, said), u
    assert (out[len(urls)].host, out[len(urls)].verdict) == ("", "allow")


@pytest.mark.parametrize("listed,others", [(300, 5000), (1, 3), (50, 0), (0, 20)])
def test_cascade_is_exact(spark, listed, others):
    keys = [f"host-{i}.example" for i in range(listed + others)]
    inside = spark.createDataFrame([(k,) for k in keys[:listed]], "key string")
    universe = spark.createDataFrame([(k,) for k in keys[listed // 2 :]], "key string")
    c = U.cascade(inside, universe)
    got = {r.key: r.hit for r in universe.union(inside).distinct().select("key", c.holds(F.col("key")).alias("hit")).collect()}
    assert got == {k: k in set(keys[:listed]) for k in keys[: listed] + keys[listed // 2 :]}
    if listed == 300:
        assert len(c.levels) > 1 and sum(x.bits for x in c.levels) < 300 * 16


def test_a_list_beyond_the_cascade(spark, sf_dir, odd, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for df in (pages, odd.selectExpr("doc_id as page_id", "text as url", "*", "true as hit")):
        with monkeypatch.context() as m:
            rows = sorted(U.filter_urls(df, U.listed_frame(spark)).collect(), key=repr)
            m.setattr(U, "MOST_LISTED", 2)
            assert U.cascade(U.listed_frame(spark), spark.range(1).select(F.lit("a").alias("key"))) is None
            assert sorted(U.filter_urls(df, U.listed_frame(spark)).collect(), key=repr) == rows


def test_a_level_of_many_hashes(spark):
    key = F.col("id").cast("string")
    level = U.bloom(spark.range(2000).select(key.alias("key")), 2000, 64.0)
    plan = spark.range(1).select(level.holds(key).alias("h"))._jdf.queryExecution().analyzed().toString()
    assert level.hashes > 40 and plan.count("array(") == 1  # the bits are bound once, not once a hash
    assert spark.range(2500).where(level.holds(key)).count() == 2000


def test_url_odd_rows(spark, odd):
    pages = odd.selectExpr("doc_id as page_id", "text as url", "*")
    assert U.filter_urls(pages, U.listed_frame(spark)).count() == odd.count()
    assert U.filter_urls(pages.limit(0), U.listed_frame(spark)).count() == 0


# ---- lines --------------------------------------------------------------------------------------------------
def brute_lines(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip("\t\n\x0b\x0c\r ").translate(fold)
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or len(held.get(key(x), ())) < 3 or max(held[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def got_lines(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=repr)


def test_lines_against_brute_force(docs, texts):
    assert got_lines(L.dedup_lines(docs)) == brute_lines(texts)


def test_lines_odd_rows(odd, empty):
    assert got_lines(L.dedup_lines(odd)) == brute_lines([(r.doc_id, r.text) for r in odd.collect()])
    assert L.dedup_lines(empty).count() == 0
    kept = L.dedup_lines(odd, keep=("lang", "source"))
    assert kept.columns == ["doc_id", "lang", "source", "n_lines", "n_dropped", "text"] and kept.count() == odd.count()
    clash = odd.selectExpr("doc_id", "text", "lang as `drop`", "source as doc", "n_chars as stay", "n_chars as n_lines0", "`a.b`")
    kept = L.dedup_lines(clash, keep=("drop", "doc", "stay", "a.b"))
    assert sorted(((r["doc_id"], r["drop"], r["doc"], r["stay"], r["a.b"]) for r in kept.collect()), key=repr) == sorted(((r["doc_id"], r["drop"], r["doc"], r["stay"], r["a.b"]) for r in clash.collect()), key=repr)


def test_many_lines(spark):
    rng = random.Random(2)
    pool = [f"A Common Line number {i} of the pool" for i in range(40)] + ["short", "", "exactly twenty chars"]
    rows = [(d, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str.lower, str])(rng.choice(pool)) + rng.choice(["", "\r"]) for _ in range(rng.randint(0, 9)))) for d in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows)
    assert got_lines(L.dedup_lines(df)) == want
    named = df.select("doc_id", "text")
    for batches, fanout in ((1, 2), (7, 2), (5, 4)):
        drops = L.repeated_lines(named, Stage(spark, "t"), batches, fanout)
        assert drops.agg(F.sum(F.size("drop"))).first()[0] == L.repeated_lines(named, Stage(spark, "t")).agg(F.sum(F.size("drop"))).first()[0]


def test_runs_are_levelled_and_compacted(spark):
    store = L.LineRuns(Stage(spark, "t"), 2)
    for k in range(7):
        store.add(spark.createDataFrame([(h, 0, k) for h in range(k, k + 3)], "h1 long, h2 long, doc long"))
    assert len(store.levels) > 1 and all(len(x) <= 2 for x in store.levels)
    keys = [(r.h1, r.h2) for run in store.runs() for r in run.collect()]
    assert len(keys) == len(set(keys))  # the anti-join leaves a line in one run only
    got = {r.h1: (r.n, r.last) for r in store.totals().collect()}
    want = {h: (len([k for k in range(7) if k <= h < k + 3]), max(k for k in range(7) if k <= h < k + 3)) for h in range(9)}
    assert got == want


def test_runs_are_merged_without_an_exchange(spark):
    stage = Stage(spark, "t")
    store = L.LineRuns(stage, 4)
    lines = lambda k: spark.range(2000).select((F.col("id") * 7 + k).alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(k).cast("long").alias("doc"))
    for k in range(3):
        store.add(lines(k % 2))
    own = store._write(lines(5).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last")))
    for df in (store.fresh(own), store.known(own)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert "LeftAnti" in store.fresh(own)._jdf.queryExecution().executedPlan().toString()
    assert store.fresh(own).count() == 2000 and store.known(own).count() == 0


@pytest.mark.parametrize("distinct", [200_000, 50])
def test_a_document_of_many_lines(spark, distinct):
    line = [f"this is line number {i % distinct:07d} of a long text" for i in range(200_000)]
    rows = [(1, "\n".join(line)), (2, "\n".join(line[::2])), (3, "\n".join(line[:100_000]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    L.dedup_lines(df.limit(0)).count()
    began = time.perf_counter()
    got = got_lines(L.dedup_lines(df))
    took = time.perf_counter() - began
    assert got == brute_lines(rows) and took < 60


def test_halving(spark):
    rows = [([], 1), ([5], 5), ([5], 4), ([5], 6), ([1, 3, 5, 7, 9], 9), ([1, 3, 5, 7, 9], 1), ([1, 3, 5, 7, 9], 4), (list(range(0, 2000, 2)), 1998), (list(range(0, 2000, 2)), 999), (list(range(0, 2048, 2)), 2046), (list(range(0, 2048, 2)), 2047)]
    df = spark.createDataFrame(rows, "a array<int>, x int").withColumn("hit", L._within(F.col("a"), F.col("x")))
    assert all(r.hit == (r.x in r.a) for r in df.collect())


# ---- shards -------------------------------------------------------------------------------------------------
def test_table_is_even_and_moves_little():
    table = S.fill()
    share = [table.count(i) for i in range(len(S.SHARDS))]
    assert len(table) == S.SLOTS and max(share) - min(share) <= 1
    fewer = S.fill(S.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True)) / S.SLOTS
    assert 1 / 16 <= moved < 0.2
    for bad in ((("a", "a"), 7), (("a",), 8), ((), 7)):
        with pytest.raises(ValueError):
            S.fill(*bad)


def test_placement(odd, empty):
    table = S.fill()
    for r in S.place(odd).collect():
        slot = 0 if r.doc_id is None else int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % S.SLOTS
        assert (r.slot, r.shard) == (slot, table[slot])
    assert S.place(empty).count() == 0


def test_written_shards(spark, docs, tmp_path):
    S.write_shards(docs, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    want = {r.doc_id: r.shard for r in S.place(docs).collect()}
    assert {r.doc_id: r.shard for r in back.select("doc_id", "shard").collect()} == want


def test_small_stages_start_few_processes(spark, docs, texts, monkeypatch):
    """A file with a checksum file beside it costs four chmod processes of the executor, a plain one costs one; small runs have few files."""
    monkeypatch.setattr(Stage, "drop", lambda self, *frames: None)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        stage = Stage(spark, "files")
        lost = L.repeated_lines(docs.select("doc_id", "text"), stage).agg(F.sum(F.size("drop"))).first()[0]
        files = [f for _, _, names in os.walk(stage.root.removeprefix("file://")) for f in names]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert lost == L.repeated_lines(docs.select("doc_id", "text"), Stage(spark, "files")).agg(F.sum(F.size("drop"))).first()[0]
    assert not [f for f in files if f.endswith(".crc")]
    assert len(files) < 300
