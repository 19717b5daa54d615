import gzip
import json
import random
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from textloom import cli, session
from textloom.dashboard import server
from textloom.operators import near, rules, summaries
from textloom.operators.decide import decided, stateless
from textloom.policy import Policy, resolved
from textloom.profiles import PROFILES, get_profile
from textloom.run import run_audit
from textloom.sources.lines import from_table, infer_format, read_lines
from textloom.streaming.audit import audited, first_arrivals

GENERIC = PROFILES["generic"]
FOX = "The quick brown fox jumps over the lazy dog near the river bank today"


def codes(spark, texts, profile="generic", **policy):
    made, found = resolved({"profile": profile, **policy})
    df = spark.createDataFrame(list(enumerate(texts, 1)), "record long, text string")
    rows = stateless(from_table(df, "record", "text"), found, made).orderBy("record").collect()
    return [[f.code for f in r.findings] for r in rows]


def decide(spark, texts, **policy):
    df = spark.createDataFrame(list(enumerate(texts, 1)), "record long, text string")
    return decided(from_table(df, "record", "text"), GENERIC, Policy(**policy))


def test_normalizes_composes_and_keeps_astral(spark):
    df = spark.createDataFrame([(1, "Café \x1c\x85 text\n"), (2, None), (3, ""), (4, "a　😀b"), (5, "STRASSE ß")], "record long, text string")
    got = rules.normalized(df).orderBy("record").collect()
    assert [r.norm for r in got] == ["Café text", "", "", "a 😀b", "STRASSE ß"]
    assert got[4].folded == "strasse ss"


def test_each_stateless_rule_at_its_edges(spark):
    many = " ".join(f"w{k}" for k in range(30))
    texts = [
        "", "abcd", "abcde", "x" * 14 + " some more words", "x" * 15 + " some more words", "go go go go now", "go go go go go now", "a � b cd", "Ã© broken",
        "privacy policy only here", "privacy policy and design in here", "http://a.com http://a.com", "www.a.example here is a long enough text to read",
        "a b " * 12, many, "please mail me@example.org about all the other things of today", "!" * 60,
    ]
    got = codes(spark, texts)
    want = [["empty"], ["too_short"], [], [], ["character_spam"], [], ["word_spam"], ["broken_encoding"], ["broken_encoding"], [], ["boilerplate"], ["url_spam"], [], ["high_word_repetition", "repeated_ngram"], [], ["email_detected"], ["high_symbol_ratio", "character_spam"]]
    assert got == want


def test_scripts_and_ratios(spark):
    assert codes(spark, ["यह हिन्दी का वाक्य है"], "bn") == [["low_target_script_ratio", "unexpected_script_ratio"]]
    assert codes(spark, ["বাংলা ভাষার একটি বাক্য।"], "bn") == [[]]
    assert codes(spark, ["12345 67890"], "bn") == [["low_target_script_ratio"]]
    df = spark.createDataFrame([(1, "ກขไทย аб AÉ 漢かカ 한 ªß")], "record long, text string")
    policy, profile = resolved({"profile": "en"})
    row = rules.signals(from_table(df, "record", "text"), profile, policy).first()
    assert row.scripts == {"Thai": 4, "Cyrillic": 2, "Latin": 3, "Han": 1, "Hiragana": 1, "Katakana": 1, "Hangul": 1, "Other": 2}
    assert row.script_ratio == 3 / 15


def test_exact_duplicates_keep_the_first_and_skip_rejected(spark):
    made = decide(spark, ["!" * 80, "same text here", "same  text here", "!" * 80, "other text here"]).records
    assert {r.record: r.first_record for r in made.where("first_record is not null").collect()} == {3: 2}
    row = summaries.totals(made).first()
    assert (row.records_read, row.records_kept, row.records_rejected) == (5, 2, 3)


def test_near_duplicates_match_the_sequential_rule(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(400)}" for _ in range(40)] for _ in range(12)]
    texts = []
    for _ in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(40)] = f"w{rng.randrange(400)}"
        texts.append(" ".join(words))
    texts += ["tiny", "日本語の文章です", "日本語の文章です!"]
    policy = Policy(exact_dedup=False, near_dedup=True)
    kept, index, want, looked = {}, {}, {}, 0
    for record, text in enumerate(texts, 1):
        have = near.shingles(text, 3)
        if not have:
            continue
        signed = near.signature(near.np.array(sorted(have), near.np.uint64), 32)
        keys = list(enumerate(near.bands(signed, 4)))
        match = None
        for other in sorted({r for key in keys for r in index.get(key, ())}):
            looked += 1
            score = len(have & kept[other]) / len(have | kept[other])
            if score >= 0.85:
                match = other
                break
        if match is None:
            kept[record] = have
            for key in keys:
                index.setdefault(key, []).append(record)
        else:
            want[record] = match
    made = decide(spark, texts, exact_dedup=False, near_dedup=True)
    assert {r.record: r.near_match for r in made.records.where("near_match is not null").collect()} == want and want
    assert near.comparisons(made.matched, made.sketches, made.pairs).first()[0] == looked
    assert policy.near_duplicate_threshold == 0.85


def test_minhash_products_are_exact():
    np = near.np
    a, b = near.coefficients(3)
    assert (int(a[0]), int(b[0])) == (888315200261588942, 2052762717387312300)
    values = [0, 1, near.PRIME - 1, near.PRIME, (1 << 64) - 1, 123456789012345678]
    for v in values:
        want = [(int(x) * (v % near.PRIME) + int(y)) % near.PRIME for x, y in zip(a, b)]
        assert near.signature(np.array([v], np.uint64), 3).tolist() == want


def test_greedy_keeps_both_ends_of_a_chain(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "u long, v long")
    assert {r.record: r.kept for r in near.greedy(links).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_empty_table(spark):
    made = decided(from_table(spark.createDataFrame([], "record long, text string"), "record", "text"), GENERIC, Policy(near_dedup=True))
    row = summaries.totals(made.records).first()
    assert (row.records_read, row.characters_read) == (0, 0)
    assert summaries.lengths(made.records).first()["count"] == 0


@pytest.mark.parametrize("name,asked,want", [("a.jsonl.gz", "auto", "jsonl"), ("a.NDJSON.GZ", "auto", "jsonl"), ("a.txt.gz", "auto", "txt"), ("a", "auto", "txt"), ("a.txt", "jsonl", "jsonl")])
def test_formats(name, asked, want):
    assert infer_format(name, asked) == want


def test_text_lines_keep_carriage_returns_marks_and_bad_bytes(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_bytes(b"\xef\xbb\xbfone\r\ntw\ro\n\nfo\xffur")
    rows = read_lines(spark, str(path)).orderBy("record").collect()
    assert [(r.record, r.raw, r.byte_length) for r in rows] == [(1, "﻿one", 8), (2, "tw\ro", 5), (3, "", 1), (4, "fo�ur", 5)]
    assert [r.record for r in read_lines(spark, str(path), max_records=2).collect()] == [1, 2]


def test_numbers_follow_the_file_over_many_partitions(spark, tmp_path):
    path = tmp_path / "n.txt"
    path.write_text("".join(f"{k}\n" for k in range(1, 40_001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_lines(spark, str(path))
        assert rows.rdd.getNumPartitions() > 4
        assert rows.where(F.col("record") != F.col("raw").cast("long")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_clean_jsonl_end_to_end(spark, tmp_path):
    path = tmp_path / "in.jsonl.gz"
    lines = ['{"id":7,"content":"useful  text","z":[1]}', "not json", "[1]", '{"content": 5}', '{"content":"mail a@b.org please"}', '{"content":"useful text","a":1}', '{"content":"bad \\ud800 half"}']
    with gzip.open(path, "wt") as file:
        file.write("\n".join(lines) + "\n")
    policy, profile = resolved({"profile": "hi"})
    tables = len(session.WRITTEN)
    report = run_audit(spark, str(path), tmp_path / "out", "clean", policy, profile, text_field="content")
    assert (report["records_read"], report["records_kept"], report["records_rejected"], report["reconciliation_ok"]) == (7, 2, 5, True)
    assert report["findings_by_code"]["malformed_record"] == 4 and report["findings_by_code"]["exact_duplicate"] == 1
    assert report["emails_masked"] == 1 and report["input_compression"] == "gzip"
    kept = [line for part in sorted((tmp_path / "out/cleaned.jsonl").glob("part*")) for line in part.read_text().splitlines()]
    assert kept == ['{"id": 7, "content": "useful text", "z": [1]}', '{"content": "mail <EMAIL> please"}']
    gone = [json.loads(line) for part in sorted((tmp_path / "out/rejected.jsonl").glob("part*")) for line in part.read_text().splitlines()]
    assert [x["record"] for x in gone] == [2, 3, 4, 6, 7] and gone[3]["findings"][-1]["threshold"] == "first_record" and gone[3]["findings"][-1]["value"] == 1
    assert "&lt;" not in (tmp_path / "out/report.html").read_text()[:200]
    assert len(session.WRITTEN) == tables  # its intermediate tables are gone
    with pytest.raises(ValueError):
        run_audit(spark, str(path), tmp_path / "out", "analyze", policy, profile)


def test_policy_resolution_and_validation():
    assert resolved({"profile": "Bangla"})[0].min_script_ratio == 0.20
    assert resolved({"profile": "bn", "min_script_ratio": None})[0].min_script_ratio is None
    assert resolved({"min_characters": 9}, min_characters=3)[0].min_characters == 3
    for bad in ({"nope": 1}, {"min_characters": True}, {"max_symbol_ratio": 2}, {"near_duplicate_threshold": 0}, {"exact_dedup": 1}, {"low_script_action": "drop"}, {"min_characters": 9, "max_characters": 3}, {"profile": "xx"}, {"consecutive_word_run": 1}, {"lsh_rows": 0}):
        with pytest.raises(ValueError):
            resolved(bad)
    assert get_profile("TAMIL").key == "ta" and len(PROFILES) == 27


def test_cli_lists_profiles_and_reports_errors(capsys):
    assert cli.main(["profiles"]) == 0 and "unrestricted" in capsys.readouterr().out
    with pytest.raises(SystemExit) as stopped:
        cli.main(["analyze", "/no/such/file"])
    assert stopped.value.code == 2


def test_dashboard(spark, tmp_path):
    path = tmp_path / "in.txt"
    path.write_text("a first line\na first line\nanother line here\n")
    running = server(0, tmp_path / "runs")
    threading.Thread(target=running.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{running.server_address[1]}"

    def call(where, body=None, **headers):
        request = urllib.request.Request(base + where, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
        try:
            with urllib.request.urlopen(request) as answer:
                return answer.status, answer.read()
        except urllib.error.HTTPError as error:
            return error.code, error.read()

    try:
        assert call("/")[0] == 200 and call("/api/meta")[0] == 200
        assert call("/api/start", {"input": str(path), "mode": "clean", "min_characters": -1})[0] == 400
        assert call("/api/start", {"input": str(path), "mode": "clean"}, Origin="http://evil.example")[0] == 403
        assert call("/api/start", {"input": str(path), "mode": "clean"}, **{"Content-Type": "text/plain"})[0] == 415
        assert call("/api/start", {"input": str(path), "mode": "clean"})[0] == 202
        for _ in range(600):
            state = json.loads(call("/api/status")[1])
            if state["state"] != "running":
                break
            threading.Event().wait(0.1)
        assert state["state"] == "done" and state["result"]["records_kept"] == 2
        assert call("/report")[0] == 200 and call("/download/report")[0] == 200 and call("/download/../x")[0] == 404
    finally:
        running.shutdown()


def test_stream(spark, tmp_path):
    rows = [(1, "one good line", "one good line", 14, None), (2, "one good line", "one good line", 14, None), (3, "x", "x", 2, None)]
    source = spark.createDataFrame(rows, "record long, text string, raw string, byte_length long, source_error string")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    kept = first_arrivals(audited(stream, GENERIC, Policy())).select("record", "output")
    run = kept.writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    run.awaitTermination()
    assert [r.output for r in spark.table("kept").collect()] == ["one good line"]


def test_greedy_by_rounds_and_at_once_agree(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)} | {(k, k + 1) for k in range(100, 140)}
    links = spark.createDataFrame(sorted(pairs), "u long, v long")
    kept: dict[int, bool] = {}
    for node in sorted({n for p in pairs for n in p}):
        kept[node] = not any(kept[u] for u, v in pairs if v == node)
    assert {r.record: r.kept for r in near.greedy(links).collect()} == kept
    assert {r.record: r.kept for r in near.greedy(links, at_once=30).collect()} == kept


def test_crowded_buckets_lose_no_pair(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(9999)}" for _ in range(60)]
    texts = []
    for k in range(40):
        words = list(base)
        words[rng.randrange(60)] = f"x{k}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "record long, text string")
    policy = Policy(near_dedup=True)
    sets = near.sketches(stateless(from_table(df, "record", "text"), GENERIC, policy), policy)
    want = {(r.u, r.v) for r in near.verified(near.candidates(sets, 0.85), sets, 0.85).collect()}
    assert len(want) > 50 and {(r.u, r.v) for r in near.verified(near.candidates(sets, 0.85, large=3), sets, 0.85).collect()} == want


def test_preview_reads_the_beginning_and_byte_counts_of_gzip(spark, tmp_path):
    path = tmp_path / "a.txt.gz"
    with gzip.open(path, "wb") as file:
        file.write(b"\xef\xbb\xbfone\ntwo\nthree")
    assert [(r.raw, r.byte_length) for r in read_lines(spark, str(path)).orderBy("record").collect()] == [("﻿one", 7), ("two", 4), ("three", 5)]
    assert [(r.raw, r.byte_length) for r in read_lines(spark, str(path), max_records=2).orderBy("record").collect()] == [("﻿one", 7), ("two", 4)]
    (tmp_path / "empty.txt").write_bytes(b"")
    assert read_lines(spark, str(tmp_path / "empty.txt")).count() == 0
