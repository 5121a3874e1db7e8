"""What is written is read back: readers and sinks over files made from the tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomstone.plans.base import Plans
from loomstone.session import scratch, table
from loomstone.sources import readers, sinks

plans = Plans()

_STRIP = r"regexp_replace({}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"


@plans.add("lines_of_files", f"WITH l AS (SELECT unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS v FROM documents) SELECT md5({_STRIP.format('v')}) AS digest, count(*) AS n FROM l WHERE {_STRIP.format('v')} <> '' GROUP BY 1")
def lines_of_files(spark, sf):
    """Text files read as stripped lines that are not blank; a line ends with either mark or both."""
    path = scratch(spark, "files-lines")
    table(spark, sf, "documents").select("text").write.text(path)
    return readers.read(spark, "lines", path).groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@plans.add("decoded_bytes", "SELECT doc_id, md5(text) AS digest, length(text)::BIGINT AS n FROM documents")
def decoded_bytes(spark, sf):
    """A binary column read as UTF-8."""
    path = scratch(spark, "files-bytes")
    table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("text")).write.parquet(path)
    return readers.read(spark, "bytes", path, "text").select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


_DURATIONS = "r AS (SELECT event_id, 's' || (event_id // 3) AS sample_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS seconds FROM events)"


def _duration_file(spark, sf):
    path = scratch(spark, "files-durations")
    e = table(spark, sf, "events")
    row = F.concat(F.lit(" s"), F.floor(F.col("event_id") / 3).cast("string"), F.lit(" , "), F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("value").cast("string")))
    rows = e.select("event_id", F.when(F.col("event_id") % 13 == 0, F.concat(row, F.lit(",more"))).otherwise(row).alias("value"))
    head = spark.createDataFrame([(-2, "sample_id,seconds"), (-1, "alone")], "event_id long, value string")
    rows.unionByName(head).repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return path


@plans.add("durations_of_files", f"WITH {_DURATIONS} SELECT sample_id, count(*) AS n, round(sum(seconds), 6) AS seconds FROM r WHERE seconds BETWEEN 0 AND 320 GROUP BY 1")
def durations_of_files(spark, sf):
    """Rows of two columns and a number within an inclusive range; a header and malformed rows are passed over."""
    rows = readers.read(spark, "durations", _duration_file(spark, sf), most=320.0)
    return rows.groupBy("sample_id").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 6).alias("seconds"))


@plans.add("first_distinct_durations", f"WITH {_DURATIONS}, v AS (SELECT * FROM r WHERE seconds BETWEEN 0 AND 320), f AS (SELECT sample_id, min(event_id) AS s FROM v GROUP BY 1 ORDER BY s LIMIT 100) SELECT sample_id, count(*) AS n FROM v WHERE event_id <= (SELECT max(s) FROM f) GROUP BY 1")
def first_distinct_durations(spark, sf):
    """Rows in order of the file until 100 distinct ids have been seen."""
    rows = readers.read(spark, "durations", _duration_file(spark, sf), most=320.0, first=100)
    return rows.groupBy("sample_id").agg(F.count("*").alias("n"))


@plans.add("held_out_file", "SELECT 'u' || user_id AS speaker_id, 'e' || max(event_id) AS sample_id FROM events GROUP BY user_id")
def held_out_file(spark, sf):
    """Of several rows of a speaker the last in the file counts."""
    path = scratch(spark, "files-held")
    rows = table(spark, sf, "events").select("event_id", F.concat_ws(",", F.concat(F.lit("u"), "user_id"), F.concat(F.lit("e"), "event_id")).alias("value"))
    rows.repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return readers.read(spark, "held_out", path)


@plans.add("records_of_files", "SELECT conv_id % 3 AS checkpoint, CASE WHEN turn % 2 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n, sum(length(text))::BIGINT AS chars, sum(turn)::BIGINT AS tokens FROM conversations GROUP BY ALL")
def records_of_files(spark, sf):
    """Generation records written by checkpoint and split, read back with the parts that the folders name."""
    path = scratch(spark, "files-records")
    c = table(spark, sf, "conversations")
    split = F.when(F.col("turn") % 2 == 0, "val").otherwise("train")
    rows = c.select((F.col("conv_id") % 3).alias("checkpoint"), split.alias("split"), F.col("text").alias("suffix"), F.array(F.col("turn").cast("int")).alias("gen_tokens"))
    sinks.write_records(rows, path)
    for file in ("a", "b"):
        sinks.write_bytes(spark, f"{path}/checkpoint={file}/split=none/head.jsonl", b'{"_meta": {"made": "today"}}\n')
    found = spark.read.schema(readers.RECORD).json(path).where("_meta is null")
    place = F.col("_metadata.file_path")
    found = found.select(F.regexp_extract(place, "checkpoint=([0-9]+)", 1).cast("long").alias("checkpoint"), F.regexp_extract(place, "split=([a-z]+)", 1).alias("split"), "suffix", "gen_tokens")
    return found.groupBy("checkpoint", "split").agg(F.count("*").alias("n"), F.sum(F.length("suffix")).alias("chars"), F.sum(F.element_at("gen_tokens", 1)).alias("tokens"))


@plans.add("record_headers", "SELECT 'm' || s_suppkey AS made, s_name AS suffix FROM supplier")
def record_headers(spark, sf):
    """Files of records that begin with a header, one a supplier: headers and records, put together by file."""
    path = scratch(spark, "files-headers")
    head = F.to_json(F.struct(F.struct(F.concat(F.lit("m"), "s_suppkey").alias("made")).alias("_meta")))
    rows = table(spark, sf, "supplier").select(F.format_string("f%d.jsonl", "s_suppkey").alias("name"), F.concat_ws("\n", head, F.to_json(F.struct(F.col("s_name").alias("suffix")))).alias("content"))
    sinks.write_files(rows, path, "name", "content")
    records, heads = readers.read(spark, "records", path)
    return records.select("path", "suffix").join(heads, "path").select(F.col("meta")["made"].alias("made"), "suffix")


@plans.add("listed_files", "SELECT 'f' || s_suppkey || '.txt' AS name, (length(s_name) + s_suppkey % 100)::BIGINT AS length FROM supplier")
def listed_files(spark, sf):
    """Names and lengths of files, contents not read."""
    path = scratch(spark, "files-listed")
    content = F.concat("s_name", F.repeat(F.lit("x"), (F.col("s_suppkey") % 100).cast("int")))
    sinks.write_files(table(spark, sf, "supplier").select(F.format_string("f%d.txt", "s_suppkey").alias("name"), content.alias("content")), path, "name", "content")
    return readers.list_files(spark, path, "*.txt").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").cast("long").alias("length"))


def _id_files(spark, sf, path: str, bytes_each: int, each: int = 1000) -> int:
    """Raw little-endian matrices of four ids an order, ``<number>.bin`` for each ``each`` keys, written by executors; how
    many orders there are."""
    o = table(spark, sf, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(65_536)).alias("a"), F.pmod("o_custkey", F.lit(65_536)).alias("b"))
    ids = (F.col("a"), F.col("b"), F.pmod(F.col("a") * F.col("b"), F.lit(65_536)), 65_535 - F.col("a"))

    def little(x):
        digits = F.lpad(F.hex(x), 2 * bytes_each, "0")
        return F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(bytes_each, 0, -1)])

    rows = o.select(F.floor(F.col("o_orderkey") / each).alias("file"), F.struct("o_orderkey", F.concat(*[little(x) for x in ids]).alias("row")).alias("r"))
    whole = rows.groupBy("file").agg(F.array_sort(F.collect_list("r")).alias("rows"))  # at most ``each`` rows
    sinks.write_files(whole.select(F.format_string("%d.bin", "file").alias("name"), F.unhex(F.array_join("rows.row", "")).alias("content")), path, "name", "content")
    return o.count()


_IDS = """WITH o AS (SELECT o_orderkey // 1000 AS file, row_number() OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) - 1 AS seq_id, o_orderkey % 65536 AS a, o_custkey % 65536 AS b FROM orders)"""
_MATRIX = f"{_IDS} SELECT file::VARCHAR AS file, seq_id, a || ',' || b || ',' || a * b % 65536 || ',' || 65535 - a AS ids FROM o"

def _file():
    return F.regexp_extract("file", r"([0-9]+)\.bin$", 1).alias("file")


@plans.add("blocks_of_files", _MATRIX)
def blocks_of_files(spark, sf):
    """Raw matrices of 16-bit ids, a thousand orders a file, and a JSON sidecar that tells their width."""
    path = scratch(spark, "files-blocks")
    n = _id_files(spark, sf, f"{path}/ids", 2)
    sinks.write_bytes(spark, f"{path}/ids.json", json.dumps({"shape": [n, 4], "dtype": "uint16"}).encode())
    return readers.read(spark, "shaped_blocks", f"{path}/ids", f"{path}/ids.json").select(_file(), "seq_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@plans.add("wide_blocks_of_files", _MATRIX)
def wide_blocks_of_files(spark, sf):
    """The same in 32 bits, read seven rows at a time."""
    path = scratch(spark, "files-wide")
    _id_files(spark, sf, path, 4)
    return readers.read_blocks(spark, path, 4, 4, rows_each=7).select(_file(), "seq_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@plans.add("flat_ids_of_files", f"{_IDS} SELECT file::VARCHAR AS file, seq_id * 4 + k AS seq_id, [a, b, a * b % 65536, 65535 - a][k + 1] AS id FROM o, range(0, 4) t(k)")
def flat_ids_of_files(spark, sf):
    """Files of one dimension: one id a row."""
    path = scratch(spark, "files-flat")
    n = _id_files(spark, sf, f"{path}/ids", 2)
    sinks.write_bytes(spark, f"{path}/ids.json", json.dumps({"shape": [4 * n]}).encode())
    return readers.read_shaped(spark, f"{path}/ids", f"{path}/ids.json").select(_file(), "seq_id", F.element_at("ids", 1).alias("id"))


@plans.add("id_map_of_file", "SELECT s_suppkey::INT AS old_id, (100000 - s_suppkey)::INT AS new_id FROM supplier")
def id_map_of_file(spark, sf):
    """Maps between ids from JSON objects with text keys, one file for 64 ids."""
    path = scratch(spark, "files-map")
    entry = F.struct(F.col("s_suppkey").cast("string").alias("key"), (100_000 - F.col("s_suppkey")).alias("value"))
    maps = table(spark, sf, "supplier").groupBy(F.floor(F.col("s_suppkey") / 64).alias("file")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("content"))  # 64 entries
    sinks.write_files(maps.withColumn("name", F.format_string("%d.json", "file")), path, "name", "content")
    return readers.read(spark, "id_map", path)


@plans.add("merges_of_file", "SELECT (s_suppkey // 64)::VARCHAR AS file, (row_number() OVER (PARTITION BY s_suppkey // 64 ORDER BY s_suppkey) - 1)::INT AS rank, lower(s_name[1:1]) || ' ' || lower(s_name[2:]) AS merge FROM supplier")
def merges_of_file(spark, sf):
    """Merges in order from tokenizer files of 64 merges each."""
    path = scratch(spark, "files-merges")
    name = F.lower("s_name")
    merge = F.struct("s_suppkey", F.concat_ws(" ", F.substring(name, 1, 1), F.expr("substring(lower(s_name), 2)")).alias("merge"))
    lists = table(spark, sf, "supplier").groupBy(F.floor(F.col("s_suppkey") / 64).alias("file")).agg(F.array_sort(F.collect_list(merge)).alias("m"))
    model = F.to_json(F.struct(F.struct(F.lit("BPE").alias("type"), F.col("m.merge").alias("merges")).alias("model")))
    sinks.write_files(lists.select(F.format_string("%d.json", "file").alias("name"), model.alias("content")), path, "name", "content")
    return readers.read(spark, "merges", path).select(F.regexp_extract("path", r"([0-9]+)\.json$", 1).alias("file"), "rank", "merge")


@plans.add("schedule_of_file", "SELECT (event_id % 97)::INT AS bin, count(*) AS n FROM events GROUP BY 1")
def schedule_of_file(spark, sf):
    """A stored schedule, found at the second of two places."""
    path = scratch(spark, "files-schedule")
    rows = table(spark, sf, "events").groupBy((F.col("event_id") % 97).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    assert sinks.write_once(rows, path) and not sinks.write_once(rows, path)
    return readers.first_readable(spark, [f"{path}-missing", path])


@plans.add("audio_subsets", "SELECT 'first' AS subset, event_id, value FROM events WHERE event_type = 'view' UNION ALL SELECT 'second', event_id, value FROM events WHERE event_type = 'click'")
def audio_subsets(spark, sf):
    """The same columns of several subsets under their names."""
    e = table(spark, sf, "events")
    return readers.project_audio({"first": e.where("event_type = 'view'"), "second": e.where("event_type = 'click'")}, ["event_id", "value"])


@plans.add("split_slices", """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r, count(*) OVER () AS n FROM events)
SELECT 'head' AS part, event_id FROM r WHERE r < 100 UNION ALL SELECT 'tail', event_id FROM r WHERE r >= n - 100 UNION ALL SELECT 'rest', event_id FROM r WHERE r < n - 100 UNION ALL SELECT 'share', event_id FROM r WHERE r >= round_even(n * 0.1, 0) AND r < round_even(n * 0.15, 0)""")
def split_slices(spark, sf):
    """Slices of a split: from either end and in per cent."""
    parts = {"train": table(spark, sf, "events").select("event_id")}
    out = None
    for name, spec in (("head", "train[:100]"), ("tail", "train[-100:]"), ("rest", "train[:-100]"), ("share", "train[10%:15%]")):
        part = readers.read_split(parts, spec, "event_id").select(F.lit(name).alias("part"), "event_id")
        out = part if out is None else out.unionByName(part)
    return out


@plans.add("packed_files", "SELECT (event_id // 64)::BIGINT AS seq_id, count(*)::BIGINT AS n, 'words' AS tokenizer, (SELECT count(*) FROM events) AS n_rows FROM events GROUP BY 1")
def packed_files(spark, sf):
    """Packed blocks and the statistics and settings beside them."""
    path = scratch(spark, "files-packed")
    e = table(spark, sf, "events")
    blocks = e.groupBy(F.floor(F.col("event_id") / 64).alias("seq_id")).agg(F.collect_list("event_id").alias("ids"))
    sinks.write_packed(sinks.checked_lengths(blocks, "ids", 64), e.agg(F.count("*").alias("n_rows")), path, tokenizer="words")
    meta = F.broadcast(spark.read.schema("n_rows long, tokenizer string").json(f"{path}/meta"))  # one row
    return spark.read.parquet(f"{path}/blocks").select("seq_id", F.col("length").cast("long").alias("n")).crossJoin(meta)


@plans.add("rewritten_results", "SELECT event_type AS metric, count(*) + 2 AS n, round(sum(value), 4) AS value FROM events GROUP BY 1")
def rewritten_results(spark, sf):
    """Results appended by metric, then replaced by rows computed from themselves, twice."""
    path = scratch(spark, "files-results")
    rows = table(spark, sf, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    sinks.append_results(rows.where("metric < 'p'"), path)
    sinks.append_results(rows.where("metric >= 'p'"), path)
    for _ in range(2):
        sinks.rewrite_results(spark.read.parquet(path).withColumn("n", F.col("n") + 1), path)
    return spark.read.parquet(path).select("metric", "n", "value")


@plans.add("summary_files", "SELECT n_regionkey::BIGINT AS region, count(*) AS n, 2::BIGINT AS copies FROM nation GROUP BY 1")
def summary_files(spark, sf):
    """A summary as CSV and as JSON: both hold the same rows."""
    path = scratch(spark, "files-summary")
    sinks.write_summary(table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")), path)
    schema = "n long, n_regionkey long"
    both = spark.read.schema(schema).option("header", "true").csv(f"{path}/csv").unionByName(spark.read.schema(schema).json(f"{path}/json"))
    return both.groupBy(F.col("n_regionkey").alias("region"), "n").agg(F.count("*").alias("copies"))


@plans.add("manifest_of_key", "SELECT 'k' || s_suppkey AS key, s_name AS name FROM supplier")
def manifest_of_key(spark, sf):
    """Settings that cache keys stand for, from the manifests beside the data, which executors write."""
    path = scratch(spark, "files-manifest")
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("k"), "s_suppkey").alias("key"), F.col("s_name").alias("name"))
    sinks.write_manifests(rows, path, "key", ["name"])
    return spark.read.schema("key string, settings struct<name:string>").json(path).select("key", "settings.name")


@plans.add("wave_durations", "SELECT user_id::VARCHAR AS name, count(*) * 50 AS frames, (8000 + user_id % 3 * 4000)::INT AS rate, round(count(*) * 50 / (8000 + user_id % 3 * 4000)::DOUBLE, 9) AS seconds, 44::BIGINT AS bytes_read FROM events GROUP BY user_id")
def wave_durations(spark, sf):
    """Sound files, one a user, written by executors; their durations from headers alone, with the bytes looked at."""
    from loomstone.sources import wave

    path = scratch(spark, "files-wave")
    played = table(spark, sf, "events").groupBy("user_id").agg(F.flatten(F.collect_list(F.array_repeat(F.coalesce(F.col("value"), F.lit(0.0)) / 1000, 50))).alias("x"))
    wave.write_waves(played.withColumn("rate", 8000 + F.pmod("user_id", F.lit(3)) * 4000), path, "user_id", "x", "rate").write.format("noop").mode("overwrite").save()
    found = wave.read_headers(spark, path)
    return found.select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("name"), "frames", "rate", F.round("seconds", 9).alias("seconds"), (F.col("bytes_read")).alias("bytes_read"))


@plans.add("resumed_build", r"SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '\S+')) AS n_words FROM documents")
def resumed_build(spark, sf):
    """Work on shards that is broken off after two batches, taken up again and checked to be complete."""
    from loomstone.functions.text import words
    from loomstone.streaming import resumable

    path = scratch(spark, "build")
    resumable.lay_out(table(spark, sf, "documents").select("doc_id", "text"), path, "doc_id", 12)
    count = lambda rows: rows.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), "shard")
    resumable.run(spark, path, count, each=2, most=2)
    resumable.run(spark, path, count, each=6)
    return resumable.finish(spark, path)


@plans.add("published_versions", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def published_versions(spark, sf):
    """A table published in two versions, the second computed from the first, read through its pointer."""
    from loomstone.sources.published import Published

    events = table(spark, sf, "events")
    place = Published(spark, scratch(spark, "published"))
    first = place.replace(events.where("event_type = 'view'"))
    place.replace(place.read().unionByName(events.where("event_type <> 'view'")), first)
    return place.read().groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
