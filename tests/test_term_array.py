"""Array answers are cut by the places of their brackets, not by patterns that walk the whole text."""

import random
import re

from pyspark.sql import functions as F

from verbascope.functions import answers


def parts(raw):
    """The texts that are parsed, in order, by the patterns that define them."""
    bare = re.sub(r"^```(?:json)?\s*|\s*```$", "", raw.strip(), flags=re.M)
    boxed, open_end = re.search(r"(?s)\[.*\]", bare), re.search(r"(?s)\[.*\}", bare)
    cut = boxed and re.search(r"(?s)^.*\}", boxed[0])
    return [boxed[0] if boxed else open_end and open_end[0] + "]", cut and cut[0] + "]"]


def test_term_arrays_of_odd_answers(spark):
    rng = random.Random(8)
    pieces = ["[", "]", '{"term":"a"}', '{"term":"b","category":"c"}', ",", "\n", " ", "```json\n", "```", "\n```\n", "{", "}", "text", '{"term":"cut', "[1]"]
    raws = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    raws += ['[{"term":"a"}]', '```json\n[{"term":"a"}\n]\n```', 'So: [{"term":"a"},{"term":"b"', '[{"term":"a"},{"term":"cut]', '[{"term":"a"}\n```\n,{"term":"b"}]', ""]
    rows = [(k, x, *parts(x)) for k, x in enumerate(raws)]
    d = spark.createDataFrame([*rows, (len(rows), None, None, None)], "k int, raw string, one string, two string")
    parse = lambda c: F.from_json(F.concat(F.lit('{"a":'), F.col(c), F.lit("}")), "a array<struct<term:string,category:string,type:string>>")["a"]
    x = d.select("raw", answers.term_array("raw").alias("got"), F.coalesce(parse("one"), parse("two")).alias("want")).collect()
    assert [(r.raw, r.got) for r in x if r.got != r.want] == [] and sum(bool(r.want) for r in x) > 50


def test_no_pattern_walks_an_answer_for_its_brackets(spark):
    assert "regexp_extract" not in str(answers.term_array(F.col("raw")))
