"""What the join on word n-grams writes and shuffles, seen on small tables."""

from __future__ import annotations

import contextlib
import io

from kairograph.llm import jaccard_join


def test_entries_of_one_set_are_not_written_and_texts_without_copies_not_shuffled(spark, monkeypatch):
    """Of many unlike texts only those that share an entry go on; and a filter of fixed size lets the others stay where they are, also where
    the table of copies is too large to be broadcast."""
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words), " ".join([*words[:-1], "other"])]
    alone = [" ".join(f"x{k}y{i}" for i in range(40)) for k in range(50)]
    rows = [(i, t) for i, t in enumerate(near + alone)] + [(None, near[0]), (60, alone[0]), (60, alone[0]), (61, ""), (61, ""), (62, None)]
    written, kept_as = {}, jaccard_join.materialize

    def noted(df, name="step", **options):
        written[name] = kept_as(df, name, **options)
        return written[name]

    monkeypatch.setattr(jaccard_join, "materialize", noted)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        kept = jaccard_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), words=5, similarity=(80, 100))
        with contextlib.redirect_stdout(plan := io.StringIO()):
            kept.explain()
        plan = plan.getvalue()
        assert {r["node"] for r in written["entries"].collect()} == {r["node"] for r in written["live"].collect()} and written["live"].count() == 2
        # the first branch holds the texts that stay where they are: no shuffle of theirs, only the filter comes
        assert "BroadcastHashJoin" in plan[plan.index("Union") : plan.index("SortMergeJoin")]
        assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted([("0", near[0]), *((str(k + 2), t) for k, t in enumerate(alone)), ("61", ""), ("61", ""), ("62", "")])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
