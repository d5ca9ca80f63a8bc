"""The maintained result equals the recomputed one after every transaction."""

import random

import pytest

from sluice.operators.batch import compile_plan
from sluice.plans.parser import parse
from sluice.streaming.engine import Engine
from sluice.streaming.zset import document

QUERIES = {
    "where_with": "(-> (from :users [tier score]) (where (> score 3)) (with {:d (* score 2)}))",
    "return": "(-> (from :users [tier region]) (return tier region))",
    "aggregate": "(-> (from :orders [uid amount status]) (aggregate :status {:n (row-count) :s (sum amount) :lo (min amount) :hi (max amount) :k (count-distinct uid)}))",
    "global": "(-> (from :orders [amount]) (without xt/id) (aggregate {:n (row-count) :s (sum amount)}))",
    "join": "(-> (from :orders [uid amount]) (join (from :users [tier]) {:uid :xt/id}) (aggregate tier {:n (row-count)}))",
    "joins": "(-> (from :users [region]) (join (from :orders [uid]) {:xt/id :uid}) (join (rel [{:region \"eu\" :tax 20} {:region nil :tax 0}]) {:region :region}))",
    "left_join": "(-> (from :users [tier]) (left-join (-> (from :orders [uid amount]) (where (> amount 20))) {:xt/id :uid}))",
    "unify": "(unify (from :users [region score]) (from :orders [region uid]) {:region :region :xt/id :uid})",
    "exists": "(-> (from :users [tier]) (exists :has (-> (from :orders [uid status]) (where (= status \"open\"))) {:xt/id :uid}))",
    "exists_local": "(-> (from :users [tags]) (exists :x (-> (unnest {:t tags}) (where (= t \"x\")))) (without tags))",
    "pull": "(-> (from :orders [uid amount]) (pull :u (from :users [tier]) {:uid :xt/id}))",
    "pull_star": "(-> (from :users [tier]) (pull* :os (from :orders [uid amount]) {:xt/id :uid}))",
    "unnest": "(-> (from :users [tags]) (unnest {:t tags}) (aggregate t {:n (row-count)}))",
    "limit": "(-> (from :users [tier]) (offset 1) (limit 3))",
}


def rows(df):
    return sorted(repr(sorted(document(r).items(), key=lambda x: x[0])) for r in df.collect())


def transactions(seed, n):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    for _ in range(n):
        ops = []
        for _ in range(rng.randint(1, 6)):
            kind = rng.random()
            if kind < 0.4:
                doc = {"_id": f"u{rng.randint(1, 6)}", "tier": pick("a", "b"), "score": rng.randint(0, 9), "region": pick("eu", "us", None), "tags": pick([], ["x"], ["x", "y"], None)}
                ops.append(("put-docs", "users", doc))
            elif kind < 0.75:
                doc = {"_id": f"o{rng.randint(1, 9)}", "uid": pick("u1", "u2", "u3", "u4", None), "amount": rng.randint(1, 5) * 10.0, "status": pick("open", "done"), "region": pick("eu", None)}
                ops.append(("put-docs", "orders", doc))
            elif kind < 0.87:
                ops.append(("delete-docs", "users", f"u{rng.randint(1, 6)}"))
            else:
                ops.append(("delete-docs", "orders", f"o{rng.randint(1, 9)}"))
        yield ops


@pytest.fixture(scope="module")
def history():
    return list(transactions(5, 4))


def test_incremental_equals_batch(spark, tmp_path, history):
    engine = Engine(spark, f"file://{tmp_path}/e", parallel=8)
    for name, text in QUERIES.items():
        engine.register_query(name, text)
    seen = {name: set() for name in QUERIES}
    for ops in history:
        done = engine.execute_tx(ops)
        assert not done.errors
        for name, change in done.changes.items():
            before = seen[name]
            added, removed = ({repr(sorted(r.items())) for r in side} for side in (change.added, change.removed))
            assert removed <= before and not added & before
            seen[name] = before - removed | added
    for name, text in QUERIES.items():
        want = rows(compile_plan(parse(text), engine.catalog()))
        assert rows(engine.query_results(name)) == want, name
        assert len(seen[name]) == len(want), name


def test_restart_goes_on(spark, tmp_path, history):
    path = f"file://{tmp_path}/e"
    text = QUERIES["aggregate"]
    first = Engine(spark, path)
    first.register_query("q", text)
    first.execute_tx(history[0])
    again = Engine(spark, path)
    again.register_query("q", text)
    again.execute_tx([op for ops in history[1:] for op in ops])
    assert rows(again.query_results("q")) == rows(compile_plan(parse(text), again.catalog()))


def test_update_and_delete_and_callbacks(spark, tmp_path):
    engine, told = Engine(spark, f"file://{tmp_path}/e"), []
    engine.register_query("adults", "(-> (from :users [age]) (where (> age 18)))", told.append)
    engine.register_query("late", "(from :users [age])")
    engine.register_query("bad", "(-> (from :users [age]) (where (> name 1)))")
    engine.register_query("other", "(from :things [a])", lambda c: told.append("never"))
    first = engine.execute_tx([("put-docs", "users", {"xt/id": 1, "age": 20}, {"xt/id": 2, "age": 10}), ("put-docs", "users", {"xt/id": 2, "age": 11})])
    assert (first.affected_query_count, first.callbacks_fired) == (3, 1)
    assert told[-1].added == [{"_id": 1, "age": 20}] and not told[-1].removed
    engine.execute_tx([("put-docs", "users", {"xt/id": 1, "age": 21, "name": "n"})])
    (m,) = told[-1].modified
    assert (m.id, m.changes) == (1, {"age": (20, 21)})
    engine.execute_tx([("put-docs", "users", {"xt/id": 2, "age": 12})])  # no change for adults
    assert len(told) == 2
    gone = engine.execute_tx([("delete-docs", "users", 1), ("delete-docs", "nothing", 5), ("sql", "ignored")])
    assert told[-1].removed == [{"_id": 1, "age": 21}] and gone.callbacks_fired == 1
    assert rows(engine.query_results("late")) == [repr([("_id", 2), ("age", 12)])]
    assert engine.list_queries() == ["adults", "bad", "late", "other"]
    assert engine.query_info("adults")["tables"] == ["users"] and engine.query_info("none") is None
    assert engine.registry_stats() == {"query_count": 4, "table_count": 2}
    assert engine.unregister_query("bad").id == "bad" and engine.unregister_query("bad") is None


def test_one_failing_query_or_callback_leaves_the_others(spark, tmp_path):
    engine, told = Engine(spark, f"file://{tmp_path}/e"), []

    def boom(_):
        raise RuntimeError("boom")

    engine.register_query("a", "(from :t [x])", boom)
    engine.register_query("b", "(-> (from :t [x]) (with {:y (/ 1 x)}))")
    engine.register_query("c", "(from :t [x])", told.append)
    done = engine.execute_tx([("put-docs", "t", {"_id": "k", "x": 0})])
    assert set(done.errors) == {"a", "b"} and len(told) == 1
    assert engine.query_results("b").columns == []


def test_backfill(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/e")
    engine.execute_tx([("put-docs", "t", {"_id": 1, "x": 1}, {"_id": 2, "x": 2})])
    engine.register_query("empty", "(from :t [x])")
    engine.register_query("full", "(from :t [x])", backfill=True)
    engine.register_query("inline", "(rel [{:a 1}])")
    assert engine.query_results("empty").count() == 0 and engine.query_results("full").count() == 2
    assert rows(engine.query_results("inline")) == [repr([("a", 1)])]
    with pytest.raises(ValueError):
        engine.register_query("", "(from :t [x])")


def test_stream_feeds_the_engine(spark, tmp_path):
    from sluice.streaming.stream import follow

    source = str(tmp_path / "in")
    schema = "_id long, _op string, _seq long, v string"
    spark.createDataFrame([(1, "put", 1, "a"), (1, "put", 2, "b"), (2, "put", 3, "c")], schema).coalesce(1).write.parquet(source)
    engine = Engine(spark, f"file://{tmp_path}/e")
    engine.register_query("q", "(-> (from :t [v]) (aggregate v {:n (row-count)}))")
    stream = spark.readStream.schema(schema).parquet(source)
    follow(engine, "t", stream, str(tmp_path / "cp")).awaitTermination()
    assert rows(engine.query_results("q")) == [repr([("group_key", v), ("n", 1)]) for v in "bc"]
    spark.createDataFrame([(2, "delete", 4, None)], schema).coalesce(1).write.mode("append").parquet(source)
    follow(engine, "t", stream, str(tmp_path / "cp")).awaitTermination()
    assert rows(engine.query_results("q")) == [repr([("group_key", "b"), ("n", 1)])]
    # A replayed batch is skipped.
    replay = spark.createDataFrame([(9, "put", 1, "z")], schema)
    (last,) = engine.batches.values()
    assert engine.apply_changes("t", replay, last, source=str(tmp_path / "cp")).affected_query_count == 0


def test_two_feeds_and_a_restart(spark, tmp_path):
    from sluice.streaming.stream import follow

    schema, path = "_id long, _op string, _seq long, v string", f"file://{tmp_path}/e"
    text = "(-> (from :a [v]) (join (-> (from :b [v]) (with {:w v}) (return xt/id w)) {:xt/id :xt/id}))"

    def run(engine):
        for table in ("a", "b"):
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / table))
            follow(engine, table, stream, str(tmp_path / f"cp_{table}")).awaitTermination()

    for table in ("a", "b"):
        spark.createDataFrame([(1, "put", 1, table), (2, "put", 1, table)], schema).write.parquet(str(tmp_path / table))
    engine = Engine(spark, path)
    engine.register_query("q", text)
    run(engine)
    assert set(engine.tables) == {"a", "b"} and engine.query_results("q").count() == 2
    spark.createDataFrame([(1, "delete", 2, None)], schema).write.mode("append").parquet(str(tmp_path / "b"))
    again = Engine(spark, path)
    again.register_query("q", text)
    run(again)
    assert rows(again.query_results("q")) == [repr([("_id", 2), ("v", "a"), ("w", "b")])]


def test_late_query_retracts_only_what_it_holds(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/e")
    put = lambda x: engine.execute_tx([("put-docs", "t", {"_id": 1, "x": x})])
    put(1)
    engine.register_query("late", "(from :t [x])")
    for x in (2, 1):
        put(x)
        assert rows(engine.query_results("late")) == [repr([("_id", 1), ("x", x)])]
    engine.execute_tx([("delete-docs", "t", 1)])
    assert engine.query_results("late").count() == 0
    assert engine.query_state("late")["partial"] and engine.query_state("late")["nodes"] == ("From", ())
    put(5)
    engine.reset_query("late")
    assert engine.query_results("late").count() == 0


def test_changes_reach_the_driver_only_when_asked_for(spark, tmp_path, monkeypatch):
    from sluice.streaming import zset

    engine = Engine(spark, f"file://{tmp_path}/e")
    engine.register_query("q", "(from :t [x])")
    reads = []
    monkeypatch.setattr(zset, "document", lambda r: reads.append(r) or dict(r.asDict()))
    done = engine.execute_tx([("put-docs", "t", {"_id": 1, "x": 1})])
    assert done.changes["q"] and not reads
    assert len(done.changes["q"].added) == 1 and len(reads) == 1


def test_old_files_go(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/e")
    engine.register_query("q", "(-> (from :t [x]) (aggregate {:n (sum x)}))")
    sizes = []
    for x in range(8):
        engine.execute_tx([("put-docs", "t", {"_id": 1, "x": x})])
        sizes.append(sum(1 for p in (tmp_path / "e").glob("*/*") if p.parent.name in ("tables", "overlays", "changes")))
    assert sizes[-1] == sizes[-2] == sizes[-3]
    assert len(list((tmp_path / "e").glob("manifest-*.json"))) == 2


def test_table_index():
    from sluice.streaming.index import TableIndex

    index = TableIndex()
    index.add("a", ["t", "u"])
    index.add("b", ["u"])
    assert index.find(["t"]) == {"a"} and index.find(["u", "x"]) == {"a", "b"} and index.find([]) == set()
    assert index.stats() == {"query_count": 2, "table_count": 2}
    index.add("a", ["v"])
    assert index.find(["t"]) == set() and index.find(["v"]) == {"a"}
    assert index.remove("a") and not index.remove("a") and index.stats() == {"query_count": 1, "table_count": 1}


def test_local_exists_has_no_join(spark):
    from sluice.operators.batch import rows as rows_of
    from sluice.sources.catalog import Catalog

    df = spark.createDataFrame([(1, ["x"]), (2, []), (3, None), (4, ["y"])], "_id long, tags array<string>")
    catalog = Catalog(spark).add("users", lambda: df, "_id")
    flagged = rows_of(parse(QUERIES["exists_local"]), catalog)
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert {(r["_id"], r["x"]) for r in flagged.collect()} == {(1, True), (2, False), (3, False), (4, False)}
