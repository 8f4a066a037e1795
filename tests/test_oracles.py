"""Every query with SQL against DuckDB on the smallest tables."""
import json

import duckdb
import numpy as np
import pytest

from siftline.operators import significance
from siftline.plans import evaluate
from siftline.plans.queries import ORACLES, QUERIES
from siftline.sources import files

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    df = QUERIES[name](spark, small)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    cur = db.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows_of(cols, cur.fetchall())


def test_statistics_record_is_whole(spark, small, monkeypatch):
    """The written record holds both models' values of all their topics, and intervals and p of them with all replicates."""
    kept, write = [], files.write_lines
    monkeypatch.setattr(files, "write_lines", lambda rows, path: (kept.extend(rows.collect()), write(rows, path)))
    QUERIES["statistics_json"](spark, small)
    record = json.loads(kept[0].value)
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    b = significance.REPLICATES
    assert record["repetitions"] == b and set(record["individual_intervals"]) == set(record["per_topic"]) == {"model_a", "model_b"}
    for model, run, dims in (("model_a", "og", 64), ("model_b", "ch", 32)):
        sql = f"WITH {evaluate._run_sql(run, 20, dims)}, {evaluate._metrics_sql(run, 'm', (20,))}, t AS (SELECT label, ndcg_cut_20, map_cut_20 FROM m JOIN embeddings ON vec_id = qid)"
        for metric, of in (("ndcg", "avg(ndcg_cut_20)"), ("map", "avg(map_cut_20) FILTER (map_cut_20 > 0)")):
            topics, x = zip(*db.execute(f"{sql} SELECT * FROM (SELECT label, {of} AS v FROM t GROUP BY 1) WHERE v IS NOT NULL ORDER BY 1").fetchall())
            assert {int(t): v[metric] for t, v in record["per_topic"][model].items() if metric in v} == pytest.approx(dict(zip(topics, x)))
            x, reps, got = np.array(x), np.arange(b), record["individual_intervals"][model][metric]
            extreme = np.count_nonzero(abs(significance.flipped(np.broadcast_to(x, (b, len(x))), reps, 32).mean(axis=1)) >= abs(x.mean()) - 1e-15)
            assert got["bootstrap_95_ci"] == pytest.approx(np.percentile(significance.drawn(x, reps, 31).mean(axis=1), [2.5, 97.5]).tolist())
            assert (got["n_topics"], got["mean"]) == (len(x), pytest.approx(x.mean()))
            assert got["sign_flip_p_two_sided_vs_zero"] == pytest.approx((1 + extreme) / (b + 1))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_imports_without_the_corpus_operators(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert set(QUERIES) <= set(found)
    assert __spark_entry__.entry(spark).collect()[0].n_queries > 0


def test_entry_without_the_package_of_corpus_operators(tmp_path):
    """The entry of a copy without the package and the pipeline lists the other queries; a missing dependency is not hidden."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/siftline", tmp_path / "siftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    assert run().stdout.split() == sorted(QUERIES)
    (tmp_path / "siftline" / "llm").mkdir()
    (tmp_path / "siftline" / "llm" / "__init__.py").write_text("")
    (tmp_path / "siftline" / "llm" / "queries.py").write_text("import no_such_dependency\n")
    assert "no_such_dependency" in run().stderr
