"""What blocks are told is dealt by block once and doesn't travel again."""

import plain
import pytest

from strophic.llm import katz


def test_answers_do_not_travel_with_each_step(docs, rows):
    run = katz._Run(docs, "doc_id", "text", 3, 1, 5, 0, False)
    plan = run.scores()._jdf.queryExecution().executedPlan().toString()
    run.drop()
    assert "hashpartitioning" not in plan.lower()


def test_blocks_without_contexts_to_ask_for(spark):
    """One block: all its contexts are its own, no range weighs any."""
    rows = [(k, t) for k, t in enumerate(["a b c a b", None, "", "a b d", "x"])]
    found = {r.doc_id: (r.n_tokens, r.n_known, r.score) for r in katz.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    want, _ = plain.katz(rows, cutoff=0)
    for k, (_, n, known, _, _, score) in want.items():
        assert found[k][:2] == (n, known) and found[k][2] == pytest.approx(score, abs=1e-6)
