"""Reading model replies: the brace scan against a plain stack, and what counts as a report."""

import random
import re

from oddsframe.operators import audit
from pyspark.sql import functions as F


def plain_scan(raw):
    """From every `{`, read on its own, to its matching brace."""
    found = []
    escaped = False
    for start, first in enumerate(raw):
        if escaped:
            escaped = False
            continue
        escaped = first == "\\"
        if first != "{":
            continue
        depth, quoted, skip = 0, False, False
        for at in range(start, len(raw)):
            ch = raw[at]
            if skip:
                skip = False
            elif ch == "\\":
                skip = True
            elif ch == '"':
                quoted = not quoted
            elif not quoted and ch in "{}":
                depth += 1 if ch == "{" else -1
                if depth == 0:
                    found.append(raw[start : at + 1])
                    break
    return [t for t in found if re.match(r'\{[ \t\r\n]*["}]', t)]


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return {r.id: r.found for r in df.select("id", audit.balanced_objects()("text").alias("found")).collect()}


def test_brace_scan_against_a_plain_stack(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice('{{}}""\\ a\né💡:') for _ in range(rng.randrange(60))) for _ in range(1500)]
    got = scanned(spark, texts)
    assert all(got[k] == plain_scan(t) for k, t in enumerate(texts))
    assert sum(map(len, got.values())) > 500


def test_brace_scan_edges(spark):
    got = scanned(spark, ["", None, "{}", "\\", "{\\", "}{", '{ \n"a":1}', "{x}"])
    assert got == {0: [], 1: [], 2: ["{}"], 3: [], 4: [], 5: [], 6: ['{ \n"a":1}'], 7: []}


def test_brace_scan_is_linear_when_nested(spark):
    """200,000 braces inside one another: none but the innermost starts as an object."""
    got = scanned(spark, ["{" * 100_000 + "}" * 100_000])
    assert got == {0: ["{}"]}


def test_replies_are_parsed_once_a_text(rows, capsys):
    df = rows([(1, "top10_ai_ranking", "{}")], "id int, workflow string, structured string")
    audit.validate_outputs(df).explain()
    plan = capsys.readouterr().out
    assert plan.count("parseJson") == 1 and "Python" not in plan and "get_json_object" not in plan


def test_points_by_type(rows):
    """Null, false, zero and empty text hold nothing; the texts 0 and false do."""
    values = {"null": 0, "false": 0, "0": 0, "0.0": 0, '""': 0, '"0"': 10, '"false"': 10, "[]": 10, "{}": 10, "1.5": 10, "true": 10}
    df = rows([(k, '{"recommendation":%s}' % k) for k in values], "k string, t string")
    got = {r.k: r.p for r in df.select("k", audit.candidate_points(F.try_parse_json("t")).alias("p")).collect()}
    assert got == values


def test_wrong_types_are_no_report(rows):
    df = rows([(1, "top10_ai_ranking", '{"top10":{"0":1},"top3Candidates":"[1]","dataQuality":null}'), (2, "top10_ai_ranking", "[1]"), (3, "top10_ai_ranking", None)],
              "id int, workflow string, structured string")
    got = {r.id: (r.level, sorted(r.missing)) for r in audit.validate_outputs(df).collect()}
    assert got == {1: ("error", ["top10", "top3Candidates"]), 2: ("error", ["structured_json"]), 3: ("error", ["structured_json"])}
