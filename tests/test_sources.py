"""File sources and sinks on small folders."""

import json

from pyspark.sql import functions as F

from verbascope.sources import lines as li
from verbascope.sources import transcripts as so


def test_pairs_manifest_and_transcripts(spark, tmp_path):
    for vid in ("a", "b"):
        (tmp_path / f"{vid}_ground_truth.txt").write_text("hello world")
    (tmp_path / "a_transcript.json").write_text(json.dumps({"text": "hello word", "segments": [{"id": 0, "start": 0.0, "end": 1.0, "text": "hello word", "words": [{"word": "hello", "start": 0.0, "end": 0.5}]}]}))
    (tmp_path / "a_asr.txt").write_text("hello word")
    pairs = so.read_eval_pairs(spark, str(tmp_path), "d").collect()
    assert [(r.dataset, r.file_id, r.gt_text, r.sa_text) for r in pairs] == [("d", "a", "hello world", "hello word")]
    t = so.read_transcripts(spark, str(tmp_path), "_transcript.json")
    assert t.first().file_id == "a"
    from verbascope.operators.transcripts import explode_words

    w = explode_words(t).first()
    assert (w.word, w.probability) == ("hello", 1.0)
    curated = spark.createDataFrame([("z", "t", "x", "y")], "video_id string, title string, accent string, domain string")
    m = so.manifest(spark, str(tmp_path), curated).collect()
    assert [(r.video_id, r.title, r.accent, r.ground_truth_chars) for r in m] == [("a", "a", "unknown", 11)]


def test_vocab_both_shapes(spark, tmp_path):
    terms = [{"term": "Groq", "category": "company_name", "known_errors": ["grok"]}, {"term": "RAG"}]
    for name, doc in (("a.json", {"terms": terms}), ("b.json", terms)):
        p = tmp_path / name
        p.write_text(json.dumps(doc))
        rows = so.read_vocab(spark, str(p)).orderBy("pos").collect()
        assert [(r.term, r.category, list(r.known_errors)) for r in rows] == [("Groq", "company_name", ["grok"]), ("RAG", "unknown", [])]


def test_examples_round_trip(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"messages":[{"role":"user","content":"é"}],"metadata":{"term":"T","is_negative":true}}\n\nnot json\n')
    d = so.read_examples(spark, str(p))
    rows = d.select("metadata.term", "_raw").collect()
    assert sorted([(r.term, r._raw) for r in rows], key=str) == sorted([("T", None), (None, "not json")], key=str)
    out = str(tmp_path / "out")
    so.write_jsonl(d.where("_raw IS NULL").select("messages", "metadata"), out)
    assert "é" in "".join(r.value for r in spark.read.text(out).collect())


def test_line_readers(spark, tmp_path):
    (tmp_path / "m1.A.xml").write_text('<r><w id="1">so</w><w>we &amp; I</w></r>')
    (tmp_path / "m1.B.xml").write_text("<r><w>go</w></r>")
    assert {(r.meeting_id, r.text) for r in li.read_word_xml(spark, str(tmp_path)).collect()} == {("m1", "so we & I go")}
    (tmp_path / "s.trans.txt").write_text("u-1 HELLO THERE\n\nu-2\nu-3 X\n")
    assert {(r.utt_id, r.text) for r in li.read_utterances(spark, str(tmp_path)).collect()} == {("u-1", "HELLO THERE"), ("u-3", "X")}
    (tmp_path / "v.vtt").write_text("WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000 align:start\n<c>hi</c>\nhi\nthere\n")
    assert li.read_subtitles(spark, str(tmp_path)).first().text == "hi there"
    (tmp_path / "t.log").write_text("Iter 10: Train loss 2.9, It/sec 0.4, Tokens/sec 170.5, Peak mem 19.05 GB\nIter 10: Val loss 1.5, Val took 2s\nnoise\n")
    got = {(r.iter, r.series, r.value) for r in li.read_training_log(spark, str(tmp_path / "t.log")).collect()}
    assert got == {(10, "train", 2.9), (10, "throughput", 170.5), (10, "memory", 19.05), (10, "val", 1.5)}


def test_sentence_chunks_cover_the_text(spark):
    text = "One two. " * 2000 + "tail without end" * 50
    d = spark.createDataFrame([(1, text), (2, "short")], "id int, text string")
    rows = li.sentence_chunks(d, ["id"], "text").orderBy("id", "chunk_no").collect()
    mine = [r for r in rows if r.id == 1]
    assert mine[0].start == 0 and mine[-1].end == len(text)
    assert all(a.end - 200 == b.start for a, b in zip(mine, mine[1:]))
    assert all(r.text == (text if r.id == 1 else "short")[r.start : r.end] for r in rows)


def test_result_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.5)], "file_id string, wer double")
    so.write_results(d, d, d.select(F.struct("wer").alias("s")), str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o/per_file")).count() == 1
