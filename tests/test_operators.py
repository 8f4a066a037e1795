"""Hand-computed values, edge cases and properties of the operators."""
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.functions.rng import draw
from siftline.functions.schemas import FILTERED, GENERATED
from siftline.functions.stem import stemmed
from siftline.functions.vector import dot, last_token, normalised, with_end
from siftline.operators import bm25, dedup, dense, ranking, records, results, sampling, selection, significance, split
from siftline.sources import commits, external, files, registries, retrieval
from siftline.streaming import flows, requests


def col(df, name):
    return [r[name] for r in df.collect()]


def test_keyed_draws(spark):
    got = col(spark.createDataFrame([(1,), (2,), (3,)], "k int").select(F.round(draw(42, "k"), 6).alias("u")), "u")
    assert got == [0.347867, 0.468102, 0.247181]


def test_metrics_by_hand(spark):
    run = ranking.ranked(spark.createDataFrame([("q1", "d1", 0.9), ("q1", "d2", 0.8), ("q1", "d3", 0.7), ("q1", "d4", 0.6), ("q2", "d1", 1.0)], "qid string, docid string, score double"))
    qrels = spark.createDataFrame([("q1", "d1", 1), ("q1", "d3", 1), ("q1", "d5", 1), ("q3", "d1", 1)], "qid string, docid string, rel int")
    rows = ranking.per_query(run, qrels, (2, 4)).collect()
    assert len(rows) == 1  # queries in both only
    r = rows[0]
    assert r.P_2 == 0.5 and round(r.recall_2, 6) == 0.333333 and round(r.map_cut_4, 6) == 0.555556 and round(r.ndcg_cut_4, 6) == 0.703918


def test_rank_score_and_antisymmetry(spark):
    pairs = [(1.0, 10.0), (10.0, 1.0), (5.0, 5.0), (3.0, 7.0)]
    df = spark.createDataFrame(pairs, "o double, n double")
    got = col(df.select(ranking.rank_score(F.col("o"), F.col("n")).alias("s")), "s")
    back = col(df.select(ranking.rank_score(F.col("n"), F.col("o")).alias("s")), "s")
    assert [round(x, 6) for x in got[:3]] == [0.9, -0.9, 0.0]
    assert got == [-x for x in back]


def test_pmrr_by_hand(spark):
    old = [("q1", f"d{i}", float(-i)) for i in range(1, 6)] + [("q2", f"d{i}", float(-i)) for i in range(1, 6)]
    new = [("q1", "d2", 9.0), ("q1", "d3", 8.0), ("q1", "d1", 7.0), ("q1", "d4", 1.0), ("q1", "d5", 0.0)] + [("q2", f"e{i}", float(-i)) for i in range(1, 6)]
    kind = "qid string, docid string, score double"
    diff = spark.createDataFrame([("q1", "d1"), ("q1", "d2"), ("q2", "d4"), ("q9", "d1")], "qid string, docid string")
    per = ranking.pmrr(ranking.rank_shift(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), diff))
    assert {r.qid: round(r.p_mrr, 6) for r in per.collect()} == {"q1": 0.083333, "q2": 0.333333}
    assert round(ranking.pmrr_macro(per).first().p_mrr, 6) == 0.208333
    assert ranking.pmrr_macro(per.where("false")).first().p_mrr == 0.0


def test_bm25_by_hand(spark):
    corpus = spark.createDataFrame([("A", "red apple"), ("B", "red red pear"), ("C", "green pear tree")], "docid string, text string")
    q = spark.createDataFrame([("q", "red pear")], "qid string, text string")
    got = {r.docid: r.score for r in bm25.topk(bm25.scores(q, corpus), 5).collect()}
    assert got == {"A": 0.211833, "B": 0.436189, "C": 0.17799}


def test_infonce_by_hand(spark):
    q = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0])], "batch int, i int, v array<float>")
    p = spark.createDataFrame([(0, 0, 0, [1.0, 0.0]), (0, 0, 1, [0.0, 1.0]), (0, 1, 0, [0.6, 0.8]), (0, 1, 1, [0.8, -0.6])], "batch int, i int, position int, v array<float>")
    assert round(sampling.infonce(q, p, 0.5).first().loss, 6) == 0.913195


def test_percentile_and_p(spark):
    means = spark.createDataFrame([("m", float(x)) for x in (1, 2, 4, 8, 16)], "metric string, mean double")
    r = significance.interval(means).first()
    assert round(r.low, 6) == 1.1 and round(r.high, 6) == 15.2
    null = spark.createDataFrame([("m", s) for s in (0.25 / 3, -0.25 / 3, 0.05, 0.0)], "metric string, mean double")
    obs = spark.createDataFrame([("m", 0.25 / 3)], "metric string, mean double")
    assert significance.p_values(obs, null, 4).first().p == 3 / 5


def test_draws_do_not_depend_on_partitions(spark):
    v = spark.createDataFrame([("m", i, float(i % 7)) for i in range(40)], "metric string, topic int, diff double")
    a = sorted(significance.bootstrap_means(v, 20, 1).collect())
    b = sorted(significance.bootstrap_means(v.repartition(7), 20, 1).collect())
    assert [(r.rep, round(r.mean, 9)) for r in a] == [(r.rep, round(r.mean, 9)) for r in b]


def test_fingerprint():
    assert results.fingerprint({"b": {"x": 2}, "a": 1}) == results.fingerprint({"a": 1, "b": {"x": 2}}) == "bc36c99f614e12ddf5538b67e1cea070b7e67acf8bddf33cdd79c298d5ef1981"


def test_answers(spark):
    texts = ["ДА", "нет", "потому что…\nДА", "ДА или НЕТ", "возможно", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.parse_answer(F.col("t")).alias("a")).orderBy("i").collect()
    assert [r.a.answer for r in rows] == [True, False, True, False, None, None, None]
    assert rows[2].a.reasoning == "потому что…" and rows[4].a.status == "error"


def test_triples_first_wins_then_validates(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("7\t1\t2\n7\t3\t4\n8\t1\t99\n8\t1\t2\nshort\t1\nx\t1\t2\n9\t1\t2\n")
    t = files.triples(spark, str(tmp_path / "t.tsv"))
    q = spark.createDataFrame([(i, f"q{i}") for i in (7, 8, 9)], "qid long, query string")
    c = spark.createDataFrame([(i, f"d{i}") for i in (1, 2, 3, 4)], "docid long, text string")
    e = dedup.enrich_triples(t, q, c)
    assert sorted((r.qid, r.pos_id) for r in e.collect()) == [(7, 1), (9, 1)]
    a, b = dedup.window_of(e, 0, 1).collect(), dedup.window_of(e, 1, None).collect()
    assert [r.qid for r in a + b] == [7, 9]  # disjoint windows


def test_id_texts_last_line_wins(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("1\tone\n 2\ttwo \nbad\n1\tuno\n")
    assert {r.id: r.text for r in files.id_texts(spark, str(tmp_path / "c.tsv")).collect()} == {1: "uno", 2: "two"}


def test_passage_variants(spark):
    rows = spark.createDataFrame([([None, ("5", None, None)],)], "p array<struct<id:string,text:string,title:string>>")
    assert [tuple(x) for x in rows.select(records.passages_dropping(F.col("p"), fallback=True).alias("a")).first().a] == [("5", "", "")]
    named = rows.select(F.transform("p", lambda x: F.when(x.isNotNull(), F.struct(x["id"].alias("docid"), x["text"].alias("text"), x["title"].alias("title")))).alias("p"))
    assert [tuple(x) for x in named.select(records.passages_keeping(F.col("p")).alias("a")).first().a] == [("", "", ""), ("5", "", "")]
    assert named.select(records.passages_dropping(F.lit(None).cast("array<struct<docid:string,text:string,title:string>>")).alias("a")).first().a == []


def test_cyrillic_tokens_and_stems(spark):
    df = spark.createDataFrame([("Привет мир, the cat",)], "t string")
    assert df.select(T.tokens(F.col("t")).alias("x")).first().x == ["привет", "мир", "the", "cat"]


# words and stems of the published vocabulary
STEMS = """вавиловка вавиловк вагнера вагнер вагон вагон вагонам вагон важная важн важнее важн важнейшие важн важнейшими важн важничал важнича важно важн важного важн важность важност
валентиновна валентиновн валерианович валерианович валетом валет валяются валя валялась валя п п па па пава пав павел павел павлиний павлин падает пада падай пада падаль падал падать пада
падеж падеж падении паден паденье паден падет падет падут падут пакости пакост пакостно пакостн пали пал палочкой палочк пальцев пальц радость радост красивейшая красив в в""".split()


def test_russian_stems(spark):
    words = list(zip(STEMS[::2], STEMS[1::2]))
    rows = stemmed(spark.createDataFrame(words, "term string, want string")).collect()
    assert [r.term for r in rows] == [r.want for r in rows] and len(rows) == len(words)
    long = stemmed(spark.createDataFrame([("а" + "б" * 3000 + "ами",), ("ёлка",)], "term string")).collect()
    assert [len(r.term) for r in long] == [3001, 3] and long[1].term == "елк"  # whole words, however long


def test_stemmed_bm25(spark):
    corpus = spark.createDataFrame([("A", "важная книга и вагон"), ("B", "падать вагонам"), ("C", "и не он")], "docid string, text string")
    q = spark.createDataFrame([("q", "важного вагона")], "qid string, text string")
    got = {r.docid: r["rank"] for r in bm25.topk(bm25.scores(q, corpus, stopwords=T.RUSSIAN_STOPWORDS, stem=True), 5).collect()}
    assert got == {"A": 1, "B": 2}
    assert bm25.topk(bm25.scores(q, corpus), 5).count() == 0


def test_bm25_best_equals_all_scores(spark, small):
    """A bounded search gives the rows of the whole one, for short, long, repeated, unknown and empty queries, and reads fewer postings."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    corpus = spark.createDataFrame([(f"d{i}", text(rng.choice([0, 5, 30, 200]))) for i in range(1500)] + [("e", None), ("f", "w7 " * 50)], "docid string, text string").repartition(3)
    asked = [(i, text(rng.randint(1, 12))) for i in range(60)] + [(100, "w7 w7 w7 w250"), (101, ""), (102, None), (103, "unknown"), (104, " ".join(words)), (105, "w299")]
    q = spark.createDataFrame(asked, "qid int, text string")
    at = bm25.index(corpus, [q])
    for k in (3, 5000):
        report = {}
        got, want = bm25.best(q, at, k, report=report, bounded=0), bm25.topk(bm25.score(q, at), k)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == sorted(map(tuple, bm25.best(q, at, k).collect()))
        assert k > 3 or report["joined"] < 0.7 * report["postings"]
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("docid"), "text")
    whole = bm25.index(docs, stem=True)  # every term of the corpus
    q = spark.read.parquet(f"{small}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")
    assert sorted(map(tuple, bm25.best(q, whole, 7, bounded=0).collect())) == sorted(map(tuple, bm25.topk(bm25.score(q, bm25.index(docs, [q], stem=True)), 7).collect()))


def test_prefixes(spark):
    df = spark.createDataFrame([("  text  ",)], "t string")
    put = lambda role: df.select(T.prefixed(F.col("t"), F.lit(role), "query:  ", "passage: ").alias("x")).first().x
    assert put("query") == "query:  text" and put("passage") == "passage: text" and put("other") == "  text  "
    title = spark.createDataFrame([("Title", "body"), (None, "body only"), ("", "x")], "a string, b string").select(T.passage(F.col("a"), F.col("b")).alias("x"))
    assert col(title, "x") == ["Title. body", "body only", "x"]
    role = df.select(T.role_of(F.lit(None), F.lit("document")).alias("a"), T.role_of(F.lit("query"), F.lit("document")).alias("b"), T.role_of(F.lit(None), F.lit("x")).alias("c")).first()
    assert (role.a, role.b, role.c) == ("passage", "query", None)


def test_split_is_disjoint_and_complete(spark):
    ids = spark.range(200).withColumnRenamed("id", "q")
    a = {r.q: r.split for r in split.split_ids(ids, "q", 1, 20, 30).collect()}
    b = {r.q: r.split for r in split.split_ids(ids.repartition(5), "q", 1, 20, 30).collect()}
    assert a == b and len(a) == 200
    assert [sum(v == s for v in a.values()) for s in ("val", "test", "train")] == [20, 30, 150]


def test_stratified_zero_selects_nothing(spark):
    df = spark.createDataFrame([(i, i % 2 == 0) for i in range(20)], "q int, has_instruction boolean")
    for end in (False, True):
        got = split.stratified(df, "has_instruction", "q", 3, {True: 4, False: 0}, from_end=end).collect()
        assert len(got) == 4 and all(r.has_instruction for r in got)
    first = {r.q for r in split.stratified(df, "has_instruction", "q", 3, {True: 5}).collect()}
    last = {r.q for r in split.stratified(df, "has_instruction", "q", 3, {True: 5}, from_end=True).collect()}
    assert first.isdisjoint(last)


def test_numbers_are_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(6)
    rows = dedup.numbered(df, "k").collect()
    assert all(r.k == r.rn for r in rows)


def test_candidate_validation_finds_a_removed_document(spark):
    full = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "a")], "qid string, docid string")
    got = {r.qid: r for r in ranking.validate_candidates(full.where("docid <> 'b'"), full).collect()}
    assert not got["q"].valid and got["q"].missing == 1 and got["r"].valid


def test_decision_table(spark):
    none = "array<struct<violates:boolean>>"
    rows = [(1, False, True, None, [(True,), (False,)]), (2, False, False, True, []), (3, False, False, False, []), (4, True, True, True, []), (5, None, None, None, [])]
    got = {r.qid: r for r in records.decide(spark.createDataFrame(rows, f"qid int, failed boolean, pos_relevant boolean, synth_relevant boolean, negatives {none}")).collect()}
    assert [got[i].decision for i in range(1, 6)] == ["kept", "kept", "discarded", "failed", "discarded"]
    assert got[1].positive_id == "1" and len(got[1].kept_negatives) == 1 and got[2].positive_id == "2_synth" and got[2].kept_negatives == []


def test_flatten_matches_names(spark):
    doc = json.dumps([{"task_name": "T", "scores": {"test": [{"p-MRR": 0.1854, "hf_subset": "x", "sub": {"ndcg_at_10": 1}}, {"p-MRR": 0.2}], "default": 3, "ok": True, "main_score": 9}}])
    rows = spark.createDataFrame([(doc,), (None,)], "j string").lateralJoin(results.FlattenMetrics(F.col("j").outer()))
    got = {r.m: r.value for r in rows.select(results.metric_name(F.col("name")).alias("m"), "value").collect()}
    assert got == {"T.p_mrr": 0.2, "T.sub.ndcg_cut_10": 1.0, "T.default": 3.0, "T.ok": 1.0}
    shown = spark.createDataFrame([("a.p_mrr", 0.1854), ("ndcg", 0.5)], "m string, v double").select(results.shown(F.col("m"), F.col("v")).alias("s"))
    assert col(shown, "s") == ["18.54", "0.5000"]


def test_concurrency_in_moscow(spark):
    times = ["2024-01-05 14:59:00", "2024-01-05 15:00:00", "2024-01-08 03:59:00", "2024-01-08 04:30:00", "2024-01-08 05:00:00", "2024-01-08 16:00:00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string").withColumn("c", results.concurrency(F.to_timestamp("t"))).orderBy("i")
    assert col(df, "c") == [3, 9, 9, 6, 3, 6]


def test_negative_mix_fills_and_pads(spark):
    rows = [("a", True, ["h1", "h2"], ["s1", "s2", "s3", "s4"]), ("b", False, [], ["s1"]), ("c", True, None, None)]
    got = {r.query_id: r.negatives for r in sampling.negative_mix(spark.createDataFrame(rows, "query_id string, has_instruction boolean, hard array<string>, special array<string>")).collect()}
    assert len(got["a"]) == 7 and sorted(got["a"]) == ["", "h1", "h2", "s1", "s2", "s3", "s4"]
    assert got["b"] == got["c"] == [""] * 7
    # a text of both lists is removed from a list's rest only by that list's own sample
    both = [("d", True, ["x", "h"], ["x"])]
    one = sampling.negative_mix(spark.createDataFrame(both, "query_id string, has_instruction boolean, hard array<string>, special array<string>"), total=3).first().negatives
    assert sorted(one) == ["h", "x", "x"]


def test_dense_blocks_agree(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float((i * k) % 5) + 0.1 for k in range(1, 5)]) for i in range(30)], "docid long, v array<float>")
    q = v.withColumnRenamed("docid", "qid")
    one = sorted(tuple(r) for r in dense.topk(q, v, 3).collect())
    monkeypatch.setattr(dense, "BLOCK", 7)
    assert sorted(tuple(r) for r in dense.topk(q, v, 3).collect()) == one


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [[1.0], [2.0], [3.0]], [1, 1, 0])], "a array<float>, s array<array<double>>, m array<int>").select(
        normalised(F.col("a")).alias("n"), dot(F.col("a"), F.col("a")).alias("d"), last_token(F.col("s"), F.col("m")).alias("l"), with_end(F.sequence(F.lit(1), F.lit(20)), 9, 12).alias("e")).first()
    assert [round(x, 6) for x in r.n] == [0.6, 0.8] and r.d == 25.0 and r.l == [2.0]
    assert r.e == [*range(1, 12), 9, 0, 0, 0, 0]


def test_jsonl_fails_on_bad_lines_and_skips_deleted(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"query_id": 1, "status": "success"}\n\n{"query_id": 2, "status": "failed"}\n')
    (tmp_path / "deleted_a.jsonl").write_text('{"query_id": 3}\n')
    assert sorted(col(files.jsonl(spark, str(tmp_path), GENERATED, skip_deleted=True), "query_id")) == [1, 2]
    (tmp_path / "b.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        files.jsonl(spark, str(tmp_path / "b.jsonl"), GENERATED).collect()


def test_raw_records_number_all_documents(spark):
    docs = [{"matches_both": False, "passage": "p0", "title": "t"}, {"matches_both": True, "passage": "p1"}, {"matches_both": False, "passage": "p2"}]
    rec = {"query_id": 5, "original_query": "o", "status": "success", "instruction_data": {"instruction": "i"}, "mining_data": {"documents": docs}}
    df = spark.read.schema(GENERATED).json(spark.sparkContext.parallelize([json.dumps(rec)]))
    r = records.normalised_raw(df).first()
    assert [n.id for n in r.valid_synthetic_negatives] == ["5_0", "5_2"] and r.rewritten_query == "o"


def test_unknown_names_are_errors(spark):
    with pytest.raises(ValueError):
        retrieval.load("nothing")
    with pytest.raises(ValueError):
        retrieval.retrieve("nothing", None, None, 1)
    with pytest.raises(ValueError):
        retrieval.select_names(["a"], ["b"])
    with pytest.raises(Exception):
        files.training_split(spark, "/nowhere", "validation").collect()


def test_adapters(spark):
    c = retrieval.corpus(spark.createDataFrame([("1", "t", None)], "_id string, text string, title string")).first()
    assert tuple(c) == ("1", "t", "")
    q = spark.createDataFrame([("q", "d", 1, 0), ("q", "d", 2, 1)], "`query-id` string, `corpus-id` string, score int, line int")
    assert [tuple(r) for r in retrieval.qrels(q, order="line").collect()] == [("q", "d", 2)]
    assert retrieval.qrels(q.drop("score")).first().rel == 1


def test_external_calls_retry_and_record_failures(spark):
    def client():
        left = {"n": 2}

        def call(prompt):
            if prompt == "never":
                raise RuntimeError("down")
            if left["n"]:
                left["n"] -= 1
                raise RuntimeError("busy")
            return "ДА"

        return call

    rows = spark.createDataFrame([("1", "x"), ("2", "never")], "record_id string, prompt string").coalesce(1)
    got = {r.record_id: (r.answer, r.status) for r in external.verdicts(rows, client, sleep=lambda s: None).collect()}
    assert got == {"1": (True, "ok"), "2": (None, "error")}
    enc = external.encoder(external.hashing_encoder(8), 8)
    v = rows.select(enc(F.col("prompt")).alias("v")).collect()
    assert len(v[0].v) == 8 and abs(sum(x * x for x in v[0].v) - 1) < 1e-6


def test_retries_back_off_and_reconnect():
    waits, made = [], []

    def client():
        made.append(len(made))

        def call(prompt):
            if len(waits) < 6:
                raise ConnectionError("Connection reset") if len(waits) == 2 else RuntimeError("busy")
            return "ok"

        return call

    assert external.Caller(client, sleep=waits.append)("p") == "ok"
    assert waits == [5.0, 5.0, 5.0, 8.0, 16.0, 30.0] and len(made) == 2
    with pytest.raises(RuntimeError):
        external.Caller(lambda: lambda p: (_ for _ in ()).throw(RuntimeError("down")), attempts=3, sleep=waits.append)("p")
    with pytest.raises(ValueError):
        external.read_passages('{"reasoning": "", "documents": [{"matches_both": true, "error_type": "odd", "explanation": "", "title": "", "passage": ""}]}')


def test_append_new_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (5, 8, 8):
        flows.append_new(spark.range(n).select(F.col("id").alias("k")), "k", path)
        assert spark.read.parquet(path).count() == n


def test_late_events_are_dropped(spark, tmp_path):
    """What comes behind the watermark (of the batch before) does not change a window that is closed; what comes in time does."""
    import os

    day = "2026-01-01 "
    batches = [[("a", "10:01:00", 1.0), ("a", "10:02:00", 1.0)], [("a", "11:00:00", 1.0)], [("a", "11:01:00", 1.0)], [("a", "10:03:00", 5.0), ("a", "10:55:00", 1.0)]]
    for i, rows in enumerate(batches):
        at = tmp_path / f"parts{i}"
        spark.createDataFrame([(e, day + t, v) for e, t, v in rows], "event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(at))
        (part,) = [f for f in os.listdir(at) if f.startswith("part-")]
        os.makedirs(tmp_path / "events", exist_ok=True)
        os.rename(at / part, tmp_path / "events" / f"{i}.parquet")
        os.utime(tmp_path / "events" / f"{i}.parquet", (1000 + i, 1000 + i))
    stream = flows.event_stream(spark, f"{tmp_path}/events/*.parquet", files_per_batch=1)
    got = sorted((str(r.w_start)[11:16], r.n, r.total) for r in flows.finished(flows.windows(stream, "10 minutes"), ("w_start", "event_type")).collect())
    assert got == [("10:00", 2, 2.0), ("10:50", 1, 1.0), ("11:00", 2, 2.0)]


def test_shards_are_files_of_the_readers_names(spark, tmp_path):
    rows = spark.range(25).select(F.col("id").cast("string").alias("query_id"))
    assert files.write_sharded(records.as_training(rows), str(tmp_path), "val", 10) == 3
    assert files.listed(spark, f"{tmp_path}/data") == [f"val-0000{i}-of-00003.parquet" for i in range(3)]
    got = files.training_split(spark, str(tmp_path), "validation")
    assert sorted(r["count"] for r in got.groupBy("_metadata.file_name").count().collect()) == [5, 10, 10] and got.count() == 25
    assert files.write_sharded(records.as_training(rows.where("false")), str(tmp_path), "test", 10) == 0
    with pytest.raises(ValueError):
        files.write_sharded(records.as_training(rows.where("false")), str(tmp_path), "test", 10, empty=False)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from siftline.sources.scratch import scratch

    spark = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None)))
    with pytest.raises(RuntimeError):
        scratch(spark("spark://host:7077", None))
    assert scratch(spark("spark://host:7077", "file:///shared")).startswith("file:///shared/siftline-")
    assert scratch(spark("local[2]", None)).startswith("file://")


def test_configuration_and_manifest(tmp_path):
    (tmp_path / "c.yaml").write_text("models: [a]\nseed: 1\n")
    assert files.config(str(tmp_path / "c.yaml"), ("models",)) == {"models": ["a"], "seed": 1}
    with pytest.raises(ValueError):
        files.config(str(tmp_path / "c.yaml"), ("datasets",))
    body = json.loads(files.manifest({"a": 1}, files.package_versions(["pyspark", "no-such-package"]), "t", *files.code_state(str(tmp_path))))
    assert body["packages"]["no-such-package"] == "not-installed" and body["git_revision"] is None and body["device"] == {"available": False}


def test_retrievers_of_all_types(spark):
    q = spark.createDataFrame([(1, "red pear"), (2, "green tree")], "qid long, text string")
    c = spark.createDataFrame([(1, "red pear", ""), (2, "tree", "green")], "docid long, text string, title string")
    enc = external.encoder(external.hashing_encoder(32), 32)
    for kind in ("encoder", "causal_lm", "qwen3_embedding", "giga_embedding"):
        got = {(r.qid, r.docid) for r in retrieval.retrieve(kind, q, c, 1, encode=enc, separator=" ").collect()}
        assert got == {(1, 1), (2, 2)}
        with pytest.raises(ValueError):
            retrieval.retrieve(kind, q, c, 1)
    assert retrieval.retrieve("bm25", q, c, 1).count() == 2


def test_loaders_check_layouts_and_revisions(spark, tmp_path):
    with pytest.raises(ValueError):
        retrieval.task_tables(spark, str(tmp_path))
    (tmp_path / "revision").write_text("abc\n")
    with pytest.raises(ValueError):
        retrieval.load("mfollowir", spark, str(tmp_path), {"revision": "other"})
    with pytest.raises(ValueError):
        retrieval.check_fields({"data_path": "x"}, ("data_path", "revision"))


def test_tasks_by_name_and_subset(spark, tmp_path):
    """Unknown tasks and subsets are errors; every subset is read; a corpus with text ids is searched by every kind of retriever."""
    for path, of in (("one/{k}/test", ""), ("two/{k}/ru/test", "r"), ("two/{k}/en/test", "e")):
        for kind, rows_ in (("corpus", [{"_id": f"{of}a", "title": "", "text": "red pear"}, {"_id": f"{of}b", "title": "green", "text": "tree"}]),
                            ("queries", [{"_id": "q1", "text": "red pear"}, {"_id": "q2", "text": "green tree"}]),
                            ("qrels", [{"query-id": "q1", "corpus-id": f"{of}a", "score": 1}])):
            spark.createDataFrame(rows_).write.parquet(f"{tmp_path}/{path.format(k=kind)}")
    root = str(tmp_path)
    got = retrieval.load("rumteb", spark, root, {"task_names": ["two", "one"]})
    assert list(got) == ["one", "two/en", "two/ru"]
    assert [sorted(col(c, "docid")) for c, _, _ in got.values()] == [["a", "b"], ["ea", "eb"], ["ra", "rb"]]
    assert list(retrieval.load("en_mteb", spark, root, {"task_names": ["two"], "subsets": ["ru"]})) == ["two/ru"]
    for config in ({"task_names": ["none"]}, {"task_names": ["two"], "subsets": ["fr"]}):
        with pytest.raises(ValueError, match="unknown"):
            retrieval.load("rumteb", spark, root, config)
    with pytest.raises(ValueError, match="named"):
        retrieval.task_tables(spark, f"{root}/two")
    c, q, _ = got["one"]
    enc = external.encoder(external.hashing_encoder(32), 32)
    for kind in ("bm25", "encoder", "causal_lm", "qwen3_embedding", "giga_embedding"):
        found = {(r.qid, r.docid) for r in retrieval.retrieve(kind, q, c, 1, encode=enc, separator=" ", stem=False).collect()}
        assert found == {("q1", "a"), ("q2", "b")}, kind


def test_tasks_of_json_lines(spark, tmp_path):
    """JSON lines are read under declared columns; whole numbers may be written with a point."""
    for kind, line in (("corpus", {"_id": "a", "text": "x"}), ("queries", {"_id": "q", "text": "y"}), ("qrels", {"query-id": "q", "corpus-id": "a", "score": 2.0})):
        (tmp_path / kind / "test").mkdir(parents=True)
        (tmp_path / kind / "test" / "part.jsonl").write_text(json.dumps(line) + "\n")
    c, q, j = retrieval.task_tables(spark, str(tmp_path))
    assert [tuple(r) for r in c.collect()] == [("a", "x", "")] and [tuple(r) for r in q.collect()] == [("q", "y")] and [tuple(r) for r in j.collect()] == [("q", "a", 2)]


def test_dense_index_equals_all_scores(spark):
    """Groups are passed over only where they cannot matter: ties, text ids, few documents, vectors of all lengths."""
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 4
    data = [(f"d{i:04d}", [float(x) for x in np.round(centres[i % 12] + rng.normal(size=16) * 0.2, 2)]) for i in range(1500)]
    data += [(f"x{i}", data[0][1]) for i in range(30)] + [("z", [0.0] * 16)]
    corpus = spark.createDataFrame(data, "docid string, v array<double>").repartition(4)
    q = spark.createDataFrame([*data[::150], ("new", [1.0] * 16), ("zero", [0.0] * 16)], "qid string, v array<double>")
    at = dense.index(corpus, groups=24)
    for k, self_ in ((1, True), (10, True), (40, False)):
        report = {}
        got = dense.search(q, at, k, without_self=self_, report=report)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, dense.topk(q, corpus, k, without_self=self_).collect()))
        assert report["compared"] + report["skipped"] == 13 * 1531 and (k == 40 or report["skipped"] > 0.4 * 13 * 1531)
    few = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "docid long, v array<float>")
    one = spark.createDataFrame([(1, [1.0])], "qid long, v array<float>")
    assert [tuple(r) for r in dense.search(one, dense.index(few), 5).collect()] == [(1, 2, 2.0, 1)]
    assert dense.search(one, dense.index(few.where("false")), 5).count() == 0 and dense.search(one.where("false"), dense.index(few), 5).count() == 0


def test_order_statistics_equal_a_sort(spark, monkeypatch):
    """Thresholds by counts of digits select what a sort selects, from both ends, with repeated and null keys."""
    monkeypatch.setattr(selection, "LISTED", 3)
    rows_ = [(i, i % 3, f"k{i}") for i in range(400)] + [(7, 1, "again")] * 5 + [(None, 2, "none")] + [(None, None, "stratum")]
    df = spark.createDataFrame(rows_, "id long, s int, name string").repartition(3).cache()
    u = {r.id: r.u for r in df.select("id", draw(3, "id").alias("u")).distinct().collect()}
    key = lambda i: (u[i], i is not None, i if i is not None else 0)
    for counts in ({0: 10, 1: 1, 2: 60}, {0: 1000, 1: 0, 2: 134}, {1: 30, None: 1}):
        for end in (False, True):
            want = {s: sorted((r[0] for r in rows_ if r[1] == s), key=key, reverse=end)[:n] for s, n in counts.items()}
            got = {s: [] for s in counts}
            for r in split.stratified(df, "s", "id", 3, counts, from_end=end).collect():
                got[r.s].append(r.id)
            assert {s: sorted(x, key=key) for s, x in got.items()} == {s: sorted(x, key=key) for s, x in want.items()}
    ids = sorted({r[0] for r in rows_}, key=key)
    for v, t in ((0, 0), (1, 1), (50, 100), (400, 10)):
        got = {r.id: r.split for r in split.split_ids(df, "id", 3, v, t).collect()}
        assert got == {x: "val" if i < v else "test" if i < v + t else "train" for i, x in enumerate(ids)}
    assert "Sort" not in split.split_ids(df, "id", 3, 5, 5)._jdf.queryExecution().executedPlan().toString()


def test_lines_keep_their_order_without_a_shuffle(spark, tmp_path):
    """Rows of files that are read in many splits are ordered by where they stand."""
    for f in range(3):
        (tmp_path / f"{f}.txt").write_text("".join(f"{f} {i}\n" for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows_ = files.lines(spark, str(tmp_path))
        assert rows_.rdd.getNumPartitions() > 3 and "Exchange" not in rows_._jdf.queryExecution().executedPlan().toString()
        got = [r.value for r in sorted(rows_.collect(), key=lambda r: tuple(r.line))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [f"{f} {i}" for f in range(3) for i in range(2000)]


def test_committed_appends(spark, tmp_path):
    """Failed and repeated batches leave no rows; two writers of one batch leave one; other ids and formats are errors."""
    path, rows_ = f"{tmp_path}/table", spark.range(10).select("id")
    assert commits.read(spark, path, "id bigint").count() == 0 and commits.swept(spark, path) == 0
    with pytest.raises(Exception, match="no luck"):
        commits.append(rows_.select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("no luck"))).alias("id")), path, "a")
    assert commits.committed(spark, path) == []
    assert commits.append(rows_, path, "a") and not commits.append(rows_, path, "a") and commits.append(rows_.where("id < 3"), path, "b")
    assert commits.read(spark, path, "id bigint").count() == 13 and commits.committed(spark, path) == ["a", "b"]
    class Slow:
        def __init__(self, df):
            self.sparkSession, self.df = df.sparkSession, df

        @property
        def write(self):  # another writer is quicker
            commits.append(rows_.where("id < 2"), path, "c")
            return self.df.write

    assert not commits.append(Slow(rows_), path, "c")
    assert commits.read(spark, path, "id bigint").count() == 15
    commits.swept(spark, path)
    assert commits.swept(spark, path) == 0 and commits.read(spark, path, "id bigint").count() == 15
    with pytest.raises(ValueError, match="letters"):
        commits.append(rows_, path, "a/b")
    with pytest.raises(ValueError, match="json"):
        commits.read(spark, path, "id bigint", kind="json")


def test_predictions_drop_metadata(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"s": {"test": {"q": {"d": 0.5, "e": 1}}}, "mteb_model_meta": {"name": "x"}}))
    assert sorted((r.subset, r.split, r.qid, r.docid, r.score) for r in files.predictions(spark, str(tmp_path / "p.json")).collect()) == [("s", "test", "q", "d", 0.5), ("s", "test", "q", "e", 1.0)]
    assert files.only_file(spark, str(tmp_path / "*.json")).endswith("p.json")
    with pytest.raises(FileNotFoundError):
        files.only_file(spark, str(tmp_path / "*.none"))


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "qid string, docid string, score double")
    assert ranking.ranked(empty).count() == 0
    assert bm25.topk(bm25.scores(spark.createDataFrame([], "qid string, text string"), spark.createDataFrame([], "docid string, text string")), 3).count() == 0
    assert dense.topk(spark.createDataFrame([], "qid long, v array<float>"), spark.createDataFrame([], "docid long, v array<float>"), 3).count() == 0
    assert split.shard_numbers(spark.createDataFrame([], "k long"), 10, "k").count() == 0
    assert spark.createDataFrame([], FILTERED).count() == 0


def test_pair_counts_and_checks(spark):
    kind = "query_id string, only_instruction string, new_negatives array<string>"
    rows = spark.createDataFrame([("1", "", []), ("1-instruct", "only x", ["a", "b"]), ("2", "", []), ("2-instruct", " ", ["c"]), ("3-instruct", "y", [])], kind)
    r = ranking.pair_counts(rows).first()
    assert (r.n_pairs, r.n_instructed, r.n_negatives) == (1, 2, 2)
    assert ranking.checked_pairs(rows).count() == 5
    with pytest.raises(ValueError):
        ranking.checked_pairs(rows.where("query_id = '1'"))


def test_prompts_are_filled(spark):
    r = spark.createDataFrame([("a{x}", None)], "x string, y string").select(T.filled("Q {x} / {y}.", x=F.col("x"), y=F.col("y")).alias("p")).first()
    assert r.p == "Q a{x} / ."


def test_checks_of_configurations():
    retrieval.check_mix(["rumteb", "en_mteb"])
    with pytest.raises(ValueError):
        retrieval.check_mix(["rumteb", "synthetic_test"])
    assert retrieval.check_fields({"a": 1}, ("a",)) == {"a": 1}
    with pytest.raises(ValueError):
        retrieval.check_fields({"a": ""}, ("a", "b"))


def test_results_are_stored_and_scanned(spark, tmp_path):
    at = str(tmp_path / "results")
    files.store_result(spark, at, "m", "d", {"x": 1}, "f1", {"top_k": 5}, "20240101_000000")
    files.store_result(spark, at, "m2", "d", {"x": 2}, "f2", {}, "20240101_000001")
    (tmp_path / "results" / "manifest.json").write_text('{"config": 1}')
    rows = spark.read.text(at).collect()
    assert len(rows) == 3
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "r.json").write_text(next(r.value for r in rows if '"m2"' in r.value))
    (tmp_path / "one" / "manifest.json").write_text('{"config": 1}')
    found = files.result_documents(spark, str(tmp_path / "one")).collect()
    assert [(r.model, r.fingerprint, json.loads(r.results)) for r in found] == [("m2", "f2", {"x": 2})]


def test_roles_of_models_that_know_few(spark):
    df = spark.createDataFrame([("passage",), ("query",)], "r string")
    got = lambda known: col(df.select(T.remapped_role(F.col("r"), known).alias("x")), "x")
    assert got(["query", "document"]) == ["document", "query"] and got(["query"]) == [None, "query"] and got(["passage"]) == ["passage", "query"]


def test_requests_are_retried_by_timers(spark, tmp_path):
    """A key that fails waits for its timer while the others are answered; what fails every time is told; closed partitions wait for the cap."""
    source = f"{tmp_path}/in"
    spark.createDataFrame([(str(i), f"p{i}") for i in range(12)] + [("1", "again")], "query_id string, prompt string").write.parquet(source)
    marks = tmp_path / "marks"
    marks.mkdir()

    def client():
        def call(prompt):
            seen = len(list(marks.glob(f"{prompt}.*")))
            (marks / f"{prompt}.{seen}").touch()
            if prompt == "p7" or prompt == "p3" and seen < 2:
                raise ValueError("not now")
            return prompt.upper()

        return call

    opens = time.time() + 3

    def cap(now):
        return 1 if now < 1000 * opens else 2

    stream = lambda: spark.readStream.schema("query_id string, prompt string").parquet(source)
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    assert requests.answered(stream(), client, out, checkpoint, attempts=3, least=0.1, most=0.2, cap=cap, recheck=0.2, every="100 milliseconds", partitions=2, seconds=120)
    got = {(r.query_id, r.response): (r.status, r.tries) for r in spark.read.schema(requests.ANSWER).parquet(out).collect()}
    assert got.pop(("7", None)) == ("failed", 3) and got.pop(("3", "P3")) == ("success", 3) and got.pop(("1", "AGAIN")) == ("success", 1)
    assert got == {(str(i), f"P{i}"): ("success", 1) for i in range(12) if i not in (3, 7)}
    assert requests.answered(stream(), client, out, checkpoint, every="100 milliseconds", partitions=2, seconds=120)  # nothing is left to do
    assert spark.read.schema(requests.ANSWER).parquet(out).count() == 13
    assert [requests.wait(n, 5, 30) for n in (1, 3, 4, 5, 6, 9)] == [5, 5, 8, 16, 30, 30]


def test_streams_into_committed_batches(spark, tmp_path):
    """A batch that is run again under a lost checkpoint is there once; new files are new batches."""
    source, path = f"{tmp_path}/in", f"{tmp_path}/table"
    spark.range(5).write.parquet(source)
    for run_ in range(2):
        flows.appended(spark.readStream.schema("id bigint").parquet(source), path, f"{tmp_path}/checkpoint{run_}", "ids")
    spark.range(5, 8).write.mode("append").parquet(source)
    flows.appended(spark.readStream.schema("id bigint").parquet(source), path, f"{tmp_path}/checkpoint1", "ids")
    assert sorted(col(commits.read(spark, path, "id bigint"), "id")) == list(range(8))


def test_fingerprints_of_a_table_are_those_of_documents(spark):
    df = spark.createDataFrame([('d é"1',), (None,)], "name string")
    got = df.select("name", results.protocol_column({"device": None, "retrieval_top_k": 5, "x": 1}, F.struct(F.lit("bm25").alias("type")), F.struct("name"), "r").alias("f")).collect()
    for r in got:
        assert r.f == results.fingerprint(results.protocol({"device": None, "retrieval_top_k": 5, "x": 1}, {"type": "bm25"}, {"name": r.name}, "r"))


def test_registries_stay_where_they_are(spark):
    """Joins with registries move the asked ids alone; ids that dangle go, and text ids and repeated asks are fine."""
    docs = registries.register(spark.createDataFrame([(f"d{i}", f"text {i}") for i in range(50)], "docid string, text string"), "docid")
    asked = spark.createDataFrame([(1, "d3"), (2, "d3"), (3, "none"), (4, None), (5, "d49")], "n int, id string")
    got = registries.looked_up(asked, docs, "docid", "id", {"text": "found"})
    assert sorted((r.n, r.id, r.found) for r in got.collect()) == [(1, "d3", "text 3"), (2, "d3", "text 3"), (5, "d49", "text 49")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.find("Initial Plan") if "Initial Plan" in plan else None].count("Exchange hashpartitioning") == 1 and "Broadcast" not in plan and "Bucketed: true" in plan


def test_a_split_of_the_view_opens_its_own_files(spark, tmp_path):
    for name, n in (("train", 25), ("val", 5), ("test", 8)):
        files.write_sharded(spark.range(n).withColumnRenamed("id", "query_id"), str(tmp_path), name, 5)
    rows = files.splits(spark, str(tmp_path), "query_id bigint").where("split = 'test'").select("query_id")
    assert sorted(col(rows, "query_id")) == list(range(8))
    plan = rows._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head() if hasattr(plan, "collectLeaves") else plan
    assert scan.metrics().apply("numFiles").value() == 2  # of eight
    assert files.splits(spark, str(tmp_path), "query_id bigint").where("split = 'none'").count() == 0


def test_dense_scores_are_held_in_bounded_pieces(monkeypatch):
    """A task holds the results and CELLS scores, not all of a batch's, and finds the same: ties, and numbers that are none."""
    import numpy as np

    rng = np.random.default_rng(3)
    q, v = np.round(rng.normal(size=(40, 8)), 1), np.round(rng.normal(size=(900, 8)), 1)
    v[100:160] = v[7]
    q[3] = np.nan
    monkeypatch.setattr(dense, "CELLS", 400)
    held = dense.Held(40, 5, 3)
    for a in range(0, 900, 300):
        held.add(np.arange(40), q, np.arange(a, a + 300), v[a : a + 300])
        assert held.gathered <= held.most
    got = held.batch(np.arange(40)).to_pydict()
    sims = np.round(q @ v.T, 3)
    for i in range(40):
        own = [d for n, d in zip(got["qid"], got["docid"]) if n == i]
        assert own == np.lexsort((np.arange(900), -sims[i]))[:5].tolist()


def test_mined_lists_equal_mined_negatives(spark):
    """Rows that ask the same and lack the same document share a list."""
    best = spark.createDataFrame([("a", f"d{i}", i) for i in range(1, 6)] + [("b", "d9", 1)], "qid string, docid string, rank int")
    asked = spark.createDataFrame([("a", "x", 1, "d2"), ("a", "y", 2, "none"), ("a", "z", 3, "d5"), ("a", "w", 4, "none"), ("b", "v", 5, "d9"), ("a", "u", 6, None)], "first string, query_id string, occurrence int, positive_id string")
    docs = spark.createDataFrame([(f"d{i}", f"t{i}", "") for i in range(10)], "docid string, text string, title string")
    which, lists = records.mined_lists(best, asked, docs, 3)
    got = {r.query_id: [p["docid"] for p in r.negative_passages or []] for r in which.join(lists, ["first", "skip"], "left").collect()}
    old = records.mined_negatives(best, asked.withColumnRenamed("first", "qid"), docs, 3).collect()
    want = {q: [r.docid for r in sorted((r for r in old if r.query_id == q), key=lambda r: r["rank"])] for q in "xyzwv"}
    assert got == want and lists.count() == 3


def test_lines_carry_no_paths(spark, tmp_path):
    """The order of lines is by file and place, and holds no more of a path than tells the files apart: rows that are sorted by it are narrow."""
    for name, text in (("b.txt", "3\n4\n"), ("a.txt", "1\n2\n"), ("c d.txt", "5\n")):
        (tmp_path / name).write_text(text)
    found = files.lines(spark, str(tmp_path))
    assert [(r.value, r.line.file) for r in found.orderBy("line").collect()] == [("1", "a"), ("2", "a"), ("3", "b"), ("4", "b"), ("5", "c")]
    assert found.where("file like '%/b.txt'").count() == 2
    for names in (["x"], ["part-00000-u", "part-00001-u", "part-00010-u"], ["a", "ab", "abc", "b"], ["ab", "a", "aé", "a🙂"], []):
        start, size = files._told_apart(names)
        assert sorted(names, key=lambda x: x[start - 1 : start - 1 + size]) == sorted(names) and len({x[start - 1 : start - 1 + size] for x in names}) == len(names)
