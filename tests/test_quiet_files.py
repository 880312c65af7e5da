"""The rules stand in for a silent detector: only its silent files' words are to be compared."""

from verbascope.operators import detection as de


def test_rules_read_only_quiet_files(spark, monkeypatch):
    seen, near_miss = [], de.near_miss_terms

    def spy(words, *args, **kwargs):
        seen.append({r.word for r in words.select("word").collect()})
        return near_miss(words, *args, **kwargs)

    monkeypatch.setattr(de, "near_miss_terms", spy)
    texts = {1: "the dashbord is seen", 2: "a dashbaord was shown", 3: "nothing here"}
    words = [(f, 0, p, w, 0.0, 4.0, 0.9) for f, x in texts.items() for p, w in enumerate(x.split())]
    w = spark.createDataFrame(words, "file_id long, segment_id int, pos int, word string, start_s double, end_s double, probability double")
    s = spark.createDataFrame([(f, 0, 0.0, 4.0, x) for f, x in texts.items()], "file_id long, segment_id int, start_s double, end_s double, text string")
    v = spark.createDataFrame([("dashboard", "dashboard", "feature", [], 0)], "term string, term_key string, category string, known_errors array<string>, pos int")
    loud = spark.createDataFrame([(1,)], "file_id long")
    got = de.rules_of_quiet_files(loud, w, s, v).collect()
    want = de.detect_errors_rules(w, s, v)[1].where("file_id <> 1").collect()
    assert sorted(got) == sorted(want) and [(r.file_id, r.error_found, r.char_position) for r in got] == [(2, "dashbaord", 2)]
    assert "dashbord" not in seen[0] and "dashbaord" in seen[0] and "dashbord" in seen[1]
