"""Classes that cannot have a link leave wide buckets before these are split."""

from __future__ import annotations

from churnkit.llm import jaccard_join as J


def test_lone_classes_are_not_split(spark, monkeypatch):
    levels, keep = [], J.written

    def written(df, name):
        out = keep(df, name)
        if name == "join-level":
            levels.append(out.count())
        return out

    monkeypatch.setattr(J, "written", written)
    shared = " ".join(f"shared{i}" for i in range(30))
    rows = [(i, shared + " " + " ".join(f"own{i}x{j}" for j in range(60))) for i in range(120)]
    rows += [(1000 + i, f"{rows[i][1]} tail{i}") for i in range(5)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"])
           for r in J.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), leaf=16).collect()}
    for i in range(120):
        assert got[i] == (i, int(i < 5))
    assert all(got[1000 + i] == (i, 1) for i in range(5))
    assert len(levels) > 1 and sum(levels[1:]) < 120 * 4
