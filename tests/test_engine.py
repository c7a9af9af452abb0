import base64
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from hushdex.errors import EntryNotFound, IndexExists, IndexNotFound, InternalError, InvalidArgument, PolicyDenied, StoreError
from hushdex.functions import blind, invert, keys, tokens
from hushdex.operators.engine import Config, Engine
from hushdex.plans.guard import Capability, Decision, Guard


def b64(text):
    return base64.b64encode(text.encode()).decode()


def fill(engine, name, rows):
    engine.seed([name])
    return engine.put_frame(name, engine.spark.createDataFrame(rows, "entry_id string, text string")).collect()


def found(engine, name, query, mode="contains", **more):
    got = engine.search(name, query, mode, **more)
    n = got.stats.first()
    return [(r["entry_id"], r["score"]) for r in got.hits.collect()], n["scanned"], n["matched"]


WORDS = [("p1", "red chair"), ("p2", "red table lamp"), ("p3", "blue chair")]
SHAPES = [("e1", "planet"), ("e2", "plant"), ("e3", "lane"), ("e4", "play"), ("e5", "grape")]


def test_word_modes(engine):
    fill(engine, "i", WORDS)
    assert found(engine, "i", "red chair", "exact")[0] == [("p1", 1.0)]
    assert found(engine, "i", "chair", "exact")[0] == [("p1", 1.0), ("p3", 1.0)]
    assert found(engine, "i", "red chair") == ([("p1", 1.0), ("p2", 0.5), ("p3", 0.5)], 3, 3)
    assert found(engine, "i", "re", "prefix")[0] == []
    assert found(engine, "i", "red chair", limit=2) == ([("p1", 1.0), ("p2", 0.5)], 3, 3)
    assert found(engine, "i", "red chair", limit=0) == ([], 3, 3)
    assert found(engine, "i", "!!!", "exact") == found(engine, "i", "!!!") == ([], 0, 0)
    with pytest.raises(InvalidArgument):
        engine.search("i", "")
    with pytest.raises(InvalidArgument):
        engine.search("i", "x", "nearby")


def test_trigram_modes(engine):
    fill(engine, "i", SHAPES)
    third = pytest.approx(2 / 3)
    assert found(engine, "i", "plane", "fuzzy") == ([("e1", 1.0), ("e2", third), ("e3", third), ("e4", pytest.approx(1 / 3))], 4, 4)
    assert found(engine, "i", "plane", "prefix") == ([("e1", 1.0), ("e2", third), ("e3", third)], 4, 3)
    strict = Engine(engine.spark, engine.store.root, Config(fuzzy_threshold=1.5))
    assert found(strict, "i", "plane", "fuzzy") == ([], 4, 0)


def test_repeated_blind_tokens_count_each_time(engine):
    engine.create("i")
    key = blind.BlindKey.generate()
    (a,), _ = key.blind(["w:a"], [])
    (b,), _ = key.blind(["w:b"], [])
    engine.put("i", "x", blind.encode_set([a], []), is_blind=True)
    query = blind.encode_set([a, a, b], [])
    assert found(engine, "i", query, is_blind=True)[0] == [("x", pytest.approx(2 / 3))]
    assert found(engine, "i", blind.encode_set([a, a], []), "exact", is_blind=True)[0] == [("x", 1.0)]
    other = blind.BlindKey.generate().blind(["w:a"], [])[0]
    assert found(engine, "i", blind.encode_set(other, []), is_blind=True)[0] == []
    assert found(engine, "i", blind.encode_set(["not hex"], []), is_blind=True)[0] == []
    for bad in (blind.encode_set([], []), "%%%", b64("[]")):
        with pytest.raises(InvalidArgument):
            engine.search("i", bad, is_blind=True)
    with pytest.raises(InvalidArgument):
        engine.put("i", "y", blind.encode_set(["not hex"], []), is_blind=True)


def test_versions_overwrite_and_delete(engine):
    engine.create("i")
    assert engine.put("i", "a", b64("old words")) == 1
    assert engine.put("i", "a", b64("new words")) == 2
    assert engine.info("i").entry_count == 1
    assert found(engine, "i", "old") == ([], 0, 0) and found(engine, "i", "new")[0] == [("a", 1.0)]
    engine.delete("i", "a")
    assert engine.info("i").entry_count == 0 and found(engine, "i", "new") == ([], 0, 0)
    with pytest.raises(EntryNotFound):
        engine.delete("i", "a")
    assert engine.put("i", "a", b64("again")) == 1
    with pytest.raises(InvalidArgument):
        engine.put("i", "", b64("x"))
    with pytest.raises(InvalidArgument):
        engine.put("i", "b", "no base64!")
    with pytest.raises(IndexNotFound):
        engine.put("none", "b", b64("x"))


def test_json_put(engine):
    engine.create("i")
    doc = '{"who":"Ana","town":"Oslo","in":{"x":"deep"}}'
    engine.put("i", "a", b64(doc), "town")
    engine.put("i", "b", b64(doc))
    assert found(engine, "i", "oslo")[0] == [("a", 1.0), ("b", 1.0)]
    assert found(engine, "i", "ana")[0] == [("b", 1.0)] and found(engine, "i", "deep")[0] == []
    rows = engine.spark.createDataFrame([("c", bytearray(b'{"t":"kilo"}'))], "entry_id string, text binary")
    engine.put_frame("i", rows)
    assert found(engine, "i", "kilo")[0] == [("c", 1.0)]


def test_capacity(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/x", Config(max_entries_per_index=3))
    assert fill(e, "i", [("b", "x"), ("a", "x")]) == []
    refused = fill(e, "i", [("d", "x"), ("c", "x"), ("a", "y"), ("", "z"), (None, "z")])
    assert sorted((r["entry_id"] or "", r["reason"]) for r in refused) == [("", "entry id is empty"), ("", "entry id is empty"), ("d", "index is full")]
    assert e.info("i").entry_count == 3 and found(e, "i", "y")[0] == [("a", 1.0)]
    with pytest.raises(InvalidArgument):
        e.put("i", "z", b64("x"))
    assert e.put("i", "a", b64("x")) == 3


def test_last_row_of_an_id_wins(engine):
    engine.create("i")
    rows = engine.spark.createDataFrame([("a", "one", 1), ("a", "three", 3), ("a", "two", 2)], "entry_id string, text string, at int")
    engine.put_frame("i", rows, order=F.col("at"))
    assert found(engine, "i", "three")[0] == [("a", 1.0)] and found(engine, "i", "one two")[0] == []


def test_lifecycle(engine):
    info = engine.create("i")
    with pytest.raises(IndexExists):
        engine.create("i")
    fill(engine, "i", WORDS)
    key = engine.store.key("i")
    again, cleared = engine.reindex("i")
    assert (cleared, again.entry_count, again.created_at, engine.store.key("i")) == (3, 0, info.created_at, key)
    fill(engine, "i", WORDS)
    assert engine.rotate("i").entry_count == 0 and engine.store.key("i") != key
    assert found(engine, "i", "red") == ([], 0, 0)
    fill(engine, "i", WORDS)
    assert found(engine, "i", "red")[2] == 2
    assert engine.destroy("i") == 3 and engine.names() == []
    with pytest.raises(IndexNotFound):
        engine.info("i")
    engine.create("i")
    assert found(engine, "i", "red") == ([], 0, 0)


def test_reconcile(engine):
    fill(engine, "i", [("a", "x"), ("b", "x"), ("c", "x")])
    assert engine.reconcile("i", ["b"]) == 2
    assert found(engine, "i", "x") == ([("b", 1.0)], 1, 1) and engine.info("i").entry_count == 1
    with pytest.raises(InvalidArgument):
        engine.reconcile("i", [])
    assert engine.reconcile("i", [], allow_empty=True) == 1


@pytest.mark.parametrize("name", ["", "has space", "has.dot", "x" * 256, "a\n", "é", "../x"])
def test_bad_names(engine, name):
    with pytest.raises(InvalidArgument):
        engine.create(name)


def test_good_names(engine):
    for name in ("indexes", "A-b_9", "x" * 200):
        assert engine.create(name).name == name
    assert engine.names() == sorted(["indexes", "A-b_9", "x" * 200])


def test_state_outlives_the_engine(engine):
    fill(engine, "i", WORDS)
    other = Engine(engine.spark, engine.store.root)
    assert found(other, "i", "red chair") == found(engine, "i", "red chair")
    old = other.store.load("i")
    other.store._write(f"{other.store.root}/indexes/i/manifest.json", {"nonsense": 1})
    with pytest.raises(StoreError):
        Engine(engine.spark, engine.store.root)
    other.store._save(old)


def test_old_token_rules_need_a_reindex(engine):
    fill(engine, "i", WORDS)
    m = engine.store.load("i")
    m.tokenizer_version = 0
    engine.store._save(m)
    for call in (lambda: engine.search("i", "red"), lambda: engine.put("i", "a", b64("x")), lambda: engine.tokenize("i", b64("x"))):
        with pytest.raises(InvalidArgument, match="REINDEX"):
            call()
    engine.reindex("i")
    assert engine.put("i", "a", b64("x")) == 1


def test_many_writes_are_merged(engine):
    engine.create("i")
    for k in range(11):
        engine.put("i", f"e{k % 4}", b64(f"word{k} all"))
    assert len(engine.store.load("i").segments) <= 8 and engine.info("i").entry_count == 4
    assert found(engine, "i", "all")[1:] == (4, 4)
    assert found(engine, "i", "word10")[0] == [("e2", 1.0)] and found(engine, "i", "word2")[0] == []


def test_tokenize(engine):
    engine.create("i")
    key = blind.BlindKey(engine.store.key("i"))
    assert engine.tokenize("i", b64("Green lamp")) == key.tokenize("Green lamp")


def test_batch_equals_single_searches(engine):
    fill(engine, "i", WORDS + SHAPES)
    q = [(1, "red chair", "contains"), (2, "red chair", "EXACT"), (3, "plane", "fuzzy"), (4, "plane", "prefix"), (5, "re", "prefix"), (6, "!!!", "contains")]
    got = engine.search_frame("i", engine.spark.createDataFrame(q, "query_id int, query string, mode string"), 3).collect()
    for k, text, mode in q:
        mine = [(r["entry_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == k]
        assert mine == found(engine, "i", text, mode, limit=3)[0]


def test_random_texts_against_sets(engine):
    rng = random.Random(5)
    rows = [(f"d{k}", " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 6)))) for k in range(60)]
    fill(engine, "i", rows)
    sets = {d: tuple(map(set, tokens.plain_tokens(t))) for d, t in rows}
    for query in ("abc ab cab", "aab bca", "a b"):
        words, tris = map(set, tokens.plain_tokens(query))
        for mode, least in (("exact", None), ("contains", 0), ("prefix", 0.6), ("fuzzy", 0.3)):
            want, seen = [], 0
            for d, (w, t) in sets.items():
                use, own, bound = (tris, t, least) if mode in ("prefix", "fuzzy") and tris else (words, w, 0)
                n = len(use & own)
                if mode == "exact":
                    if use <= own:
                        want.append((d, 1.0))
                        seen += 1
                elif n:
                    seen += 1
                    if n / len(use) >= bound:
                        want.append((d, n / len(use)))
            want.sort(key=lambda x: (-x[1], x[0]))
            assert found(engine, "i", query, mode, limit=1000) == (want, seen, len(want))


def test_guard(spark, tmp_path):
    seen, events = [], []
    guard = Guard(Capability.enabled(lambda r: seen.append(r) or Decision(r.action != "delete", "no-deletes")), Capability.enabled(events.append))
    e = Engine(spark, f"file://{tmp_path}/g", Config(require_audit=True, require_policy=True), guard)
    e.create("i", "ana")
    e.put("i", "a", b64("x"), actor="ana")
    e.search("i", "x")
    with pytest.raises(PolicyDenied, match="no-deletes"):
        e.delete("i", "a", "bob")
    assert [(r.action, r.principal) for r in seen] == [("index_create", "ana"), ("put", "ana"), ("search", ""), ("delete", "bob")]
    assert [(v.operation, v.resource, v.actor) for v in events] == [("INDEX_CREATE", "i", "ana"), ("PUT", "i/a", "ana"), ("SEARCH", "i", "anonymous")]

    def broken(_):
        raise OSError("sink is down")

    bad = Engine(spark, f"file://{tmp_path}/g", guard=Guard(audit=Capability.enabled(broken)))
    for call in (lambda: bad.search("i", "x"), lambda: bad.put("i", "b", b64("y"))):
        with pytest.raises(InternalError, match="audit failed"):
            call()
    assert found(e, "i", "y")[0] == [("b", 1.0)]  # written before the audit failed
    for config in (Config(require_audit=True), Config(require_policy=True)):
        with pytest.raises(InternalError, match="required"):
            Engine(spark, f"file://{tmp_path}/g", config)


def test_writers_of_one_process_wait_in_line(engine):
    from concurrent.futures import ThreadPoolExecutor

    engine.create("i")
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda k: engine.put("i", f"e{k % 3}", b64(f"word{k}")), range(6)))
    assert sorted(versions) == [1, 1, 1, 2, 2, 2] and engine.info("i").entry_count == 3


def test_a_writer_with_an_old_record_fails(engine):
    engine.create("i")
    old = engine.store.load("i")
    engine.put("i", "a", b64("x"))
    rows = engine.spark.createDataFrame([("b", 1, False, ["w"], ["t"], None, False)], "entry_id string, version bigint, deleted boolean, words array<string>, trigrams array<string>, seq bigint, again boolean")
    with pytest.raises(StoreError, match="another writer"):
        engine.store.append(old, rows, 1)
    assert found(engine, "i", "x")[0] == [("a", 1.0)] and engine.info("i").entry_count == 1


def test_searches_read_no_entries(engine):
    fill(engine, "i", WORDS)
    fill(engine, "i", [("p9", "green chair")])
    plan = lambda: engine.search("i", "chair").hits._jdf.queryExecution().executedPlan().toString()
    assert "/entries" not in plan() and "/replaced" not in plan()
    fill(engine, "i", [("p1", "red stool")])  # an id written again: only such ids are looked up
    assert "/entries" not in plan() and found(engine, "i", "chair")[0] == [("p3", 1.0), ("p9", 1.0)]


def test_merges_keep_to_segments_of_like_size(engine):
    fill(engine, "i", [(f"d{k}", "all") for k in range(300)])
    big = engine.store.load("i").segments[0].name
    for k in range(9):
        fill(engine, "i", [(f"d{k}", f"all new{k}"), (f"x{k}", "all")])
    engine.delete("i", "d8")
    for k in range(9, 18):
        fill(engine, "i", [(f"x{k}", "all")])
    m = engine.store.load("i")
    assert m.segments[0].name == big and len(m.segments) <= 9
    assert engine.info("i").entry_count == 317 and found(engine, "i", "all", limit=0)[1] == 317
    assert found(engine, "i", "new3")[0] == [("d3", 1.0)] and found(engine, "i", "new8")[0] == []
    assert engine.store.entries(m).where("entry_id = 'd5'").first()["version"] == 2


def test_late_events_change_nothing(engine):
    engine.create("i")
    events = lambda *rows: engine.spark.createDataFrame(list(rows), "entry_id string, op string, text string, seq bigint")
    engine.apply_frame("i", events(("a", "put", "newest", 10), ("b", "put", "one", 1)))
    engine.apply_frame("i", events(("a", "put", "older", 3), ("b", "delete", None, 5), ("zz", "delete", None, 9)))
    engine.apply_frame("i", events(("b", "put", "late", 4), ("zz", "put", "late", 8), ("c", "put", "fresh", 1)))
    engine.apply_frame("i", events(("c", "put", "fresh", 1)))
    assert found(engine, "i", "newest older late one fresh", "contains", limit=9)[0] == [("a", 0.2), ("c", 0.2)]
    assert {r["entry_id"]: r["version"] for r in engine.store.entries(engine.store.load("i")).collect()} == {"a": 1, "c": 1}
    assert engine.info("i").entry_count == 2


def test_bulk_puts_by_field_and_order(engine):
    engine.create("i")
    rows = [("a", '{"t":"kilo","u":"metre"}', 2), ("a", '{"t":"old"}', 1), ("b", "no json", 1)]
    engine.put_frame("i", engine.spark.createDataFrame(rows, "entry_id string, text string, at int"), order=F.col("at"), field="t")
    assert found(engine, "i", "kilo metre old json")[0] == [("a", 0.25), ("b", 0.25)]
    key = blind.BlindKey.generate()
    sets = [("c", blind.encode_set(*key.tokenize(t)), k) for k, t in enumerate(("first", "second", "third"))]
    engine.put_blind_frame("i", engine.spark.createDataFrame(sets, "entry_id string, data string, at int"), order=-F.col("at"))
    assert found(engine, "i", blind.encode_set(*key.tokenize("first")), is_blind=True)[0] == [("c", 1.0)]
    q = engine.spark.createDataFrame([(1, blind.encode_set(*key.tokenize("first second")), "contains")], "query_id int, query string, mode string")
    assert [tuple(r) for r in engine.search_frame("i", q, is_blind=True).collect()] == [(1, "c", 0.5, 1)]


@pytest.mark.parametrize(("row", "what"), [((1, "x", "nearby"), "unknown match mode"), ((1, "", "fuzzy"), "empty"), ((1, None, "fuzzy"), "empty"), ((1, "x", None), "unknown match mode")])
def test_batch_search_checks_its_queries(engine, row, what):
    fill(engine, "i", WORDS)
    with pytest.raises(InvalidArgument, match=what):
        engine.search_frame("i", engine.spark.createDataFrame([(0, "red", "exact"), row], "query_id int, query string, mode string"))
    with pytest.raises(InvalidArgument, match="negative"):
        engine.search_frame("i", engine.spark.createDataFrame([(0, "red", "exact")], "query_id int, query string, mode string"), -1)


# -- postings by blocks ------------------------------------------------------------


def test_blocks_hold_every_token_of_every_entry():
    import pyarrow as pa

    key = bytes(range(32))
    texts = {f"e{k}": " ".join(f"word{(k * j) % 11} über{j}" for j in range(k % 9)) for k in range(40)}
    words = [sorted({w[2:] for w in tokens.plain_tokens(t)[0]}) for t in texts.values()]
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts)), pa.array(words, pa.list_(pa.string())), pa.array([None] * 40, pa.int64())], names=["entry_id", "words", "seq"])
    out = pa.Table.from_batches(invert._inverter(key, 30, 7, 5)([batch.slice(0, 13), batch.slice(13)])).to_pylist()
    lists = [r for r in out if r["part"] == 1]
    assert len({r["block"] for r in lists}) > 40 // 7 and max(len(r["entry_ids"]) for r in lists) <= 7
    got = sorted((r["kind"], r["token"], e) for r in lists for e in r["entry_ids"])
    want = [(k, keys.blind_token(key, t), e) for e, text in texts.items() for k, ts in zip("wt", tokens.plain_tokens(text), strict=True) for t in ts]
    assert got == sorted(want)
    assert {r["entry_id"]: (r["words"], r["trigrams"]) for r in out if r["part"] == 0} == {e: tuple(map(len, tokens.plain_tokens(t))) for e, t in texts.items()}


def test_no_row_holds_the_tokens_of_a_whole_text(engine):
    fill(engine, "i", [(f"d{k:03}", " ".join(f"w{j}" for j in range(k, k + 300))) for k in range(60)])
    m = engine.store.load("i")
    assert dict(engine.store.entries(m).dtypes) == {"entry_id": "string", "version": "bigint", "words": "bigint", "trigrams": "bigint", "seq": "bigint"}
    assert engine.store.lists(m).agg(F.max(F.size("entry_ids"))).first()[0] <= invert.BLOCK_ENTRIES
    rows = engine.store.lists(m).select(F.input_file_name().alias("f"), "kind", "token").collect()
    by_file = {f: [r[1:] for r in rows if r["f"] == f] for f in {r["f"] for r in rows}}
    assert by_file and all(v == sorted(v) for v in by_file.values())


def test_batch_search_counts_as_single_searches_do(engine, monkeypatch):
    from hushdex.operators import search as ops

    fill(engine, "i", [(f"d{k}", " ".join(w for j, w in enumerate(("red", "green", "chair", "table", "reddish")) if k >> j & 1)) for k in range(32)])
    fill(engine, "i", [("d3", "table"), ("x", "green chair"), ("d31", "none")])
    asked = [(k, q, mode) for k, (q, mode) in enumerate((q, mode) for q in ("red chair", "green", "reddish table", "none of it") for mode in ("exact", "contains", "prefix", "fuzzy"))]
    q = engine.spark.createDataFrame(asked, "query_id int, query string, mode string")
    want = sorted((k, r["entry_id"], r["score"], n + 1) for k, text, mode in asked for n, r in enumerate(engine.search("i", text, mode, limit=3).hits.collect()))
    assert sorted(map(tuple, engine.search_frame("i", q, 3).collect())) == want
    monkeypatch.setattr(ops, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, engine.search_frame("i", q, 3).collect())) == want


def test_an_index_of_another_layout_is_refused(engine):
    engine.create("i")
    engine.store._save(replace(engine.store.load("i"), layout=1))
    with pytest.raises(StoreError, match="layout"):
        engine.info("i")


def test_a_blind_put_works_out_its_data_once(engine, monkeypatch):
    engine.create("i")
    rows = engine.spark.createDataFrame([("a", "red chair", "i")], "entry_id string, text string, index string")
    sets = blind.blinded(rows, tokens.token_set(F.col("text")), blind.key_table(engine.spark, {"i": bytes(32)}))
    seen, add = [], engine._add
    monkeypatch.setattr(engine, "_add", lambda m, rows, *a, **b: seen.append(rows) or add(m, rows, *a, **b))
    engine.put_blind_frame("i", sets.select("entry_id", blind.wire(F.col("tokens")).alias("data")), order=F.lit(1))
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert engine.info("i").entry_count == 1


def test_ids_are_not_looked_up_in_a_union_of_shuffled_tables(spark, tmp_path, monkeypatch):
    """A union of tables dealt by id failed a join once Spark had split one of them anew."""
    from hushdex.operators.engine import Config, Engine
    from hushdex.sources.store import Store

    e = Engine(spark, f"file://{tmp_path}/index", Config(max_entries_per_index=3))
    e.create("talk")
    asked, latest = [], Store.latest

    def seen(self, m, ids=None, segments=None):
        if ids is not None:
            asked.append(ids._jdf.queryExecution().optimizedPlan().toString())
        return latest(self, m, ids, segments)

    monkeypatch.setattr(Store, "latest", seen)
    rows = lambda *r: spark.createDataFrame(r, "entry_id string, op string, text string, seq bigint")
    assert e.apply_frame("talk", rows(("a", "put", "one", 1), ("b", "put", "two", 1), ("c", "put", "six", 1))).collect() == []
    refused = e.apply_frame("talk", rows(("a", "delete", None, 2), ("x", "delete", None, 2), ("d", "put", "ten", 1), ("e", "put", "old", 1), ("b", "put", "new", 0))).collect()
    assert [r["entry_id"] for r in refused] == ["e"]
    assert e.info("talk").entry_count == 3
    # Rows that are read from files are dealt by nothing.
    assert asked and not [p for p in asked if "Union" in p and "parquet" not in p]
