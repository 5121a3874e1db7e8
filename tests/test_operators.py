from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.functions import text as X
from loomstone.operators import distributions, merges, ordering, relational, results, schedule, text_metrics
from loomstone.sources import readers, sinks


def test_detokenise(spark):
    cases = {
        "he said , \" hi there \" and left .": "he said, \"hi there\" and left.",
        "it 's http : / / x.y ( a b ) [ c ] $ 5": "it's http://x.y (a b) [c] $5",
        "what ? no ! yes ; so : it": "what? no! yes; so: it",
        "": "", "  ": "",
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "t string").select("t", X.detokenise(F.col("t")).alias("x"))
    got = {r.t: r.x for r in df.collect()}
    assert got == {**cases, None: ""}


def test_newlines_and_letters(spark):
    r = spark.createDataFrame([("\r\na\rb\n ",)], "t string").select(X.normalise_newlines(F.col("t")).alias("n"), X.letters_only(F.lit("Ab_c-9 é")).alias("l")).head()
    assert (r.n, r.l) == ("a\nb", "ab c    ")


def test_entropy_and_repetition(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b"],), (["x"],), ([],)], "w array<string>")
    h = [round(r.h, 9) for r in df.select(text_metrics.unigram_entropy(F.col("w")).alias("h")).collect()]
    assert h == [round(math.log(2), 9), 0.0, 0.0]
    assert text_metrics.repetition(df, F.col("w"), 2).head()["rep_2"] == pytest.approx(100 / 3)
    assert text_metrics.distinctness(df, F.col("w"), 2).head()["distinct_2"] == pytest.approx(200 / 3)


def test_word_error_rate_counts_words(spark):
    df = spark.createDataFrame([("A b c", "a x c d"), ("", "z"), ("é è", "è")], "r string, h string")
    r = text_metrics.word_error_rate(df, "r", "h", []).head()
    assert (r.edits, r.words) == (4, 5)
    assert text_metrics.word_error_rate(spark.createDataFrame([("", "a")], "r string, h string"), "r", "h", []).head().wer is None


def test_perplexity_without_tokens(spark):
    r = text_metrics.perplexity(spark.createDataFrame([("g", None)], "g string, x double"), "x", ["g"]).head()
    assert math.isinf(r.perplexity) and math.isinf(r.bits_per_token)


def test_windows_score_every_token_once(spark):
    lengths = [0, 1, 2, 255, 256, 257, 384, 385, 1000]
    df = text_metrics.scoring_windows(spark.createDataFrame([(n,) for n in lengths], "n int"), "n", 256, 128)
    scored: dict[int, list[int]] = {}
    for r in df.collect():
        assert r.end - r.begin <= 256
        scored.setdefault(r.n, []).extend(range(r["first"], r.end))
    assert scored == {n: list(range(1, n)) for n in lengths if n >= 2}


def test_schedule_is_a_distribution(spark):
    rows = [(0.5, 1.0), (1.0, 2.0), (float("nan"), 1.0), (1.0, float("inf")), (1e9, 3.0)]
    s = schedule.density(schedule.rate_bins(spark.createDataFrame(rows, "s double, m double"), "s", "m", 0.002, 80.0, 12)).orderBy("bin").collect()
    cdf = [r.cdf for r in s]
    assert cdf == sorted(cdf) and cdf[-1] == 1.0 and sum(r.pdf for r in s) == pytest.approx(1.0)
    flat = schedule.density(schedule.rate_bins(spark.createDataFrame([(0.5, 0.0)], "s double, m double"), "s", "m", 0.002, 80.0, 4)).collect()
    assert [r.pdf for r in flat] == [0.25] * 4


def test_upsert_is_idempotent(spark):
    cols = "checkpoint string, split string, tag string, metric string, view string, cache_key string, value double, o int"
    old = spark.createDataFrame([("c", None, "t", "m", "v", "k", 1.0, 0)], cols)
    new = spark.createDataFrame([("c", None, "t", "m", "v", "k", 2.0, 1), ("d", None, "t", "m", "v", "k", 3.0, 3), ("d", None, "t", "m", "v", "k", 4.0, 2)], cols)
    once = results.upsert(old, new, "o")
    twice = results.upsert(once, new, "o")
    assert sorted(r.value for r in once.collect()) == sorted(r.value for r in twice.collect()) == [1.0, 4.0]


def test_sweeps_refuse_bad_settings(spark):
    g = results.sweep(spark, {"s": ["a", "a"]})
    with pytest.raises(Exception, match="occurs twice"):
        results.check_unique(g, "s").collect()
    with pytest.raises(Exception, match="s_churn"):
        results.validate(spark.createDataFrame([(True, 0.0)], "stochastic boolean, s_churn double")).collect()


def test_general_format(spark):
    df = spark.createDataFrame([(0.08,), (1e-9,), (123456789.0,), (None,)], "v double")
    assert [r.t for r in df.select(X.general_format(F.col("v")).alias("t")).collect()] == ["0.08", "1e-09", "1.2345679e+08", "none"]


def test_picks(spark):
    rows = [("a", 1, 2.0), ("a", 2, 3.5), ("a", 3, 3.5), ("b", 4, 1.0), ("b", 5, 2.0)]
    df = spark.createDataFrame(rows, "s string, i int, d double")
    assert sorted((r.s, r.i) for r in relational.held_out_pick(df, "s", "d", "i", 3.0).collect()) == [("a", 2), ("b", 5)]
    saves = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 4.0), (4, 4.0), (5, 3.0)], "i int, m double")
    assert [r.i for r in relational.kept_by_improvement(saves, "i", "m", 2).collect()] == [5, 3]
    assert sorted((r.id, r.shard) for r in relational.ordered_shards(spark.range(10), ["id"], 3).collect()) == [(i, s) for i, s in zip(range(10), [0] * 4 + [1] * 3 + [2] * 3, strict=True)]


def test_ranks(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101, i % 3 == 0) for i in range(300)], "i int, v int, f boolean")
    got = {r.i: r.r for r in ordering.ranks(df, ["f", "v", "i"], "r").collect()}
    want = sorted(range(300), key=lambda i: (i % 3 == 0, (i * 37) % 101, i))
    assert got == {i: k for k, i in enumerate(want)}


def test_merges_follow_the_counts(spark):
    docs = spark.createDataFrame([(["low"] * 5 + ["lower"] * 2 + ["newest"] * 6 + ["widest"] * 3,)], "w array<string>")
    got = [(r["left"], r["right"], r.n) for r in merges.learn_merges(docs, F.col("w"), 3).orderBy("rank").collect()]
    assert got == [("e", "s", 9), ("es", "t", 9), ("l", "o", 7)]
    enc = spark.range(1).select(merges.encode_words(F.split(F.lit("aaa"), ""), [("a", "a")]).alias("x")).head().x
    assert [s for s in enc if s] == ["aa", "a"]


def test_orders_of_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 4)) * np.array([5, 1, 1, 1])
    df = spark.createDataFrame([(0, i, [float(v) for v in r]) for i, r in enumerate(x)], "g int, i int, v array<double>")
    place = {r.i: r.place for r in ordering.principal_order(df, "i", "v", 4).collect()}
    axis = np.linalg.eigh(np.cov(x.T))[1][:, -1]
    axis *= np.sign(axis[np.abs(axis).argmax()])
    assert [i for i, _ in sorted(place.items(), key=lambda t: t[1])] == np.argsort((x @ axis).round(9), kind="stable").tolist()
    path = ordering.greedy_order(df, "g", "i", "v").collect()
    assert sorted(r.i for r in path) == list(range(40)) and sorted(r.place for r in path) == list(range(40))


def test_distances_of_distributions(spark):
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((60, 3)), rng.standard_normal((50, 3)) * 2 + 1
    df = spark.createDataFrame([(g, [float(v) for v in r]) for g, m in (("a", a), ("b", b)) for r in m], "g string, v array<double>")
    got = distributions.frechet_distance(df, "g", "v", 3, "a", "b").head().distance
    ca, cb = np.cov(a.T), np.cov(b.T)
    root = np.sqrt(np.maximum(np.linalg.eigvals(ca @ cb).real, 0)).sum()
    assert got == pytest.approx(((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * root, rel=1e-9)
    assert distributions.frechet_distance(df, "g", "v", 3, "a", "a").head().distance == pytest.approx(0, abs=1e-9)


def test_files_of_rows(spark, tmp_path):
    """Executors write one file a row: text, bytes, empty for null; a row without a name is an error."""
    rows = spark.createDataFrame([("a/x.txt", b"one\ntwo"), ("b.bin", bytes(range(256))), ("none", None), ("", None)], "name string, content binary")
    assert sinks.write_files(rows.where("name <> ''"), f"{tmp_path}/out", "name", "content") == 3
    assert (tmp_path / "out/a/x.txt").read_bytes() == b"one\ntwo"
    assert (tmp_path / "out/b.bin").read_bytes() == bytes(range(256))
    assert (tmp_path / "out/none").read_bytes() == b""
    assert sinks.write_files(rows.where("name = 'z'"), f"{tmp_path}/out", "name", "content") == 0
    with pytest.raises(Exception, match="no name"):
        sinks.write_files(spark.createDataFrame([(None, "x")], "name string, content string"), f"{tmp_path}/out", "name", "content")
    manifests = spark.createDataFrame([("k1", "n", None)], "key string, b string, a string")
    assert sinks.write_manifests(manifests, f"{tmp_path}/m", "key", ["b", "a"]) == 1
    assert json.loads((tmp_path / "m/k1.json").read_text()) == {"key": "k1", "settings": {"a": None, "b": "n"}}


def test_readers(spark, tmp_path):
    (tmp_path / "d.csv").write_text("id,seconds\na,0\nb,32\nc,32.1\nd\ne,x\n")
    assert sorted((r.sample_id, r.seconds) for r in readers.read(spark, "durations", f"{tmp_path}/d.csv").collect()) == [("a", 0.0), ("b", 32.0)]
    (tmp_path / "h.csv").write_text("s,1\nt,2\ns,3\n")
    assert sorted(map(tuple, readers.read_held_out(spark, f"{tmp_path}/h.csv").collect())) == [("s", "3"), ("t", "2")]
    (tmp_path / "l.txt").write_text(" a \n\n \nb\n")
    assert [r.text for r in readers.read_lines(spark, f"{tmp_path}/l.txt").collect()] == ["a", "b"]
    np.arange(12, dtype="<u2").tofile(tmp_path / "b.bin")
    assert [list(r.ids) for r in readers.read_blocks(spark, f"{tmp_path}/b.bin", 4).orderBy("seq_id").collect()] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]
    (tmp_path / "m.json").write_text(json.dumps({"3": 0, "5": 1}))
    assert sorted(map(tuple, readers.read_id_map(spark, f"{tmp_path}/m.json").collect())) == [(3, 0), (5, 1)]
    (tmp_path / "t.json").write_text(json.dumps({"model": {"type": "BPE", "merges": ["a b", "ab c"]}}))
    assert [r.merge for r in readers.read_merges(spark, f"{tmp_path}/t.json").collect()] == ["a b", "ab c"]
    run = tmp_path / "c" / "test" / "k"
    run.mkdir(parents=True)
    (run / "tag.jsonl").write_text(json.dumps({"_meta": {"n": "1"}}) + "\n" + json.dumps({"prompt": "p", "suffix": "s", "gen_tokens": [1, 2]}) + "\n")
    rows, meta = readers.read_records(spark, str(tmp_path / "c"))
    found = results.path_columns(rows, "path").head()
    assert (found.tag, found.cache_key, found.split, found.checkpoint, found.gen_tokens) == ("tag", "k", "test", "c", [1, 2]) and meta.head().meta == {"n": "1"}
    assert readers.list_files(spark, str(tmp_path), "*.jsonl").count() == 1
    with pytest.raises(FileNotFoundError):
        readers.read_schedule(spark, f"{tmp_path}/none")
    with pytest.raises(KeyError):
        readers.read(spark, "nothing")
    with pytest.raises(FileNotFoundError):
        readers.first_readable(spark, [f"{tmp_path}/none"])


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    assert sinks.write_once(df, f"{tmp_path}/t") and not sinks.write_once(df, f"{tmp_path}/t") and sinks.write_once(df, f"{tmp_path}/t", force=True)
    assert "&lt;b&gt;" in sinks.html_report(spark.createDataFrame([("<b>",)], "x string"), ["x"], "t")
    with pytest.raises(Exception, match="longer"):
        sinks.checked_lengths(spark.createDataFrame([([1, 2],)], "i array<int>"), "i", 1).collect()
    rows = spark.createDataFrame([("m", 1.0)], "metric string, value double")
    sinks.append_results(rows, f"{tmp_path}/r")
    sinks.append_results(rows, f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").count() == 2
    sinks.rewrite_results(spark.read.parquet(f"{tmp_path}/r").distinct(), f"{tmp_path}/r", f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/r").count() == 1


def test_refreshed_schedule(spark, tmp_path):
    from loomstone.streaming.state import schedule_refresher

    refresh = schedule_refresher(str(tmp_path), "s", "m", 0.002, 80.0, 8, capacity=5, least=4)
    batch = lambda a, b: spark.createDataFrame([(i, 0.5 + i, 1.0) for i in range(a, b)], "seq long, s double, m double")
    refresh(batch(0, 3), 0)
    assert not (tmp_path / "schedule-0").exists()
    refresh(batch(3, 8), 1)
    assert sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/samples-1").collect()) == [3, 4, 5, 6, 7]
    assert spark.read.parquet(f"{tmp_path}/schedule-1").count() == 8


def test_distinct_ngrams_move_as_hashes(spark):
    """Counts are those of the texts, repeats within and across documents included; no n-gram is joined or shuffled as text."""
    from loomstone.operators import text_metrics

    rows = [("a", ["x", "y", "z", "x", "y", "z"]), ("a", ["y", "z", "x"]), ("b", ["x", "y"]), ("b", ["xy", "z", "w"]), ("b", ["x", "yz", "w"]), ("b", []), ("b", None)]
    df = spark.createDataFrame(rows, "lang string, w array<string>")
    for n in (2, 3):
        grams = {g: [tuple(w[i : i + n]) for lang, w in rows if lang == g and w for i in range(len(w) - n + 1)] for g in "ab"}
        out = text_metrics.distinctness(df, F.col("w"), n, ["lang"])
        assert {r[0]: round(r[1], 6) for r in out.collect()} == {g: round(100 * len(set(x)) / len(x), 6) for g, x in grams.items()}
        assert "array_join" not in out._jdf.queryExecution().executedPlan().toString()
    counts = df.select(text_metrics.ngram_count(F.col("w"), 2).alias("n"), F.size(text_metrics.ngrams(F.col("w"), 2)).alias("m")).where("w is not null").collect()
    assert all(r.n == r.m for r in counts)


def test_blocks_are_read_many_runs_at_a_time(spark, tmp_path):
    """Runs of seven rows of several files come in batches, in Arrow; rows and their places are those of the files."""
    want = set()
    for k, n in enumerate((1, 7, 5000)):
        x = np.arange(2 * n, dtype="<u4").reshape(n, 2) + 100_000 * k
        (tmp_path / f"{k}.bin").write_bytes(x.tobytes())
        want |= {(f"{k}.bin", i, *row) for i, row in enumerate(x.tolist())}
    out = readers.read_blocks(spark, str(tmp_path), 2, 4, rows_each=7)
    assert {(r.file.rsplit("/", 1)[1], r.seq_id, *r.ids) for r in out.collect()} == want and out.count() == len(want)
    assert "MapInPandas" not in out._jdf.queryExecution().executedPlan().toString()
