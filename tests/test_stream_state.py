"""Logs that arrive in any order give the rows of the batch rules, over restarts too."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import logs
from tallyforge.streaming import state

SCHEMA = "at long, sample string, reviewer string, status string, note string"


def rows():
    rng = random.Random(3)
    return [{"at": k, "sample": f"s{rng.randrange(12) if k % 3 else 0}", "reviewer": f"r{rng.randrange(3)}", "status": rng.choice(["complete", "complete", "draft", "error"]), "note": None if k % 7 == 0 else f"n{k}"} for k in range(300)]


def ok():
    return F.col("status") == "complete"


RULES = {
    "latest": (lambda s: state.greatest(s, ["sample", "reviewer"], ["at"]), ["sample", "reviewer"], lambda d: logs.latest(d, ["sample", "reviewer"], "at")),
    "filtered": (lambda s: state.greatest(s.where(ok()), ["sample"], ["at"]), ["sample"], lambda d: logs.then_latest(d, ["sample"], "at", ok())),
    "success": (lambda s: state.greatest(s.withColumn("ok", ok().cast("int")), ["sample"], ["ok", "at"]), ["sample"], lambda d: logs.success_and_residue(d, ["sample"], "at", ok()).withColumn("ok", F.col("succeeded").cast("int")).drop("succeeded")),
    "winner": (lambda s: state.review_winners(s, ["sample"], "reviewer", "at", ok()), ["sample"], lambda d: logs.review_winner(d, ["sample"], "reviewer", "at", ok())),
}


@pytest.mark.parametrize("name", RULES)
def test_any_order_of_files_gives_the_batch_rule(spark, tmp_path, name):
    rule, key, batch = RULES[name]
    files, out, checkpoint = (str(tmp_path / x) for x in ("files", "out", "checkpoint"))
    (tmp_path / "files").mkdir()
    parts = [rows()[k : k + 30] for k in range(0, 300, 30)]
    random.Random(name).shuffle(parts)
    seen = []
    for turn in range(3):  # a new query each time, which goes on from the checkpoint
        for n, part in enumerate(parts[turn::3]):
            (tmp_path / "files" / f"{turn}-{n}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in part))
            seen += part
        got = state.followed(spark, files, SCHEMA, rule, key, out, checkpoint, files_a_batch=2)
        wanted = batch(spark.createDataFrame([tuple(r.values()) for r in seen], SCHEMA))
        columns = sorted(wanted.columns)
        assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, wanted.select(columns).collect()))


def test_a_draft_takes_the_only_review_back(spark, tmp_path):
    files = tmp_path / "files"
    files.mkdir()
    rule = RULES["winner"][0]
    for n, (at, status, held) in enumerate([(5, "complete", 1), (9, "draft", 0), (7, "complete", 0), (11, "complete", 1)]):
        (files / f"{n}.jsonl").write_text(json.dumps({"at": at, "sample": "s", "reviewer": "r", "status": status, "note": None}) + "\n")
        got = state.followed(spark, str(files), SCHEMA, rule, ["sample"], str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        assert got.count() == held
