"""Operators that the tables can't trigger, on small cases."""

import datetime
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.rules import ENTITY_STOP, GRAPH_STOP, HIT_STOP
from textloom.operators import chunks, code, deltas, graph, hooks, memory, outputs, prompts, retrieval
from textloom.sources import files
from textloom.streaming import memory as stream


# Command outputs


@pytest.mark.parametrize(
    ("command", "name"),
    [("git push origin", "git_push_pull"), ("git status", "git_status"), ("git log -3", "git_log"), ("git diff", "git_diff"), ("cargo test", "cargo_test"), ("python -m pytest", "pytest"), ("npm test", "vitest_jest"), ("go test ./...", "go_test"), ("ls -la", "ls_tree"), ("rg x", "grep"), ("find . -name x", "find"), ("docker ps", "docker_ps"), ("kubectl logs p", "docker_logs"), ("npm i", "npm_install"), ("pip install x", "pip_install"), ("terraform plan", "terraform_apply"), ("kubectl get pods", "kubectl_get"), ("kubectl describe pod", "kubectl_describe"), ("curl -v http://x", "curl_verbose"), ("curl http://x", "curl_json"), ("make", "generic")],
)
def test_commands_are_routed(command, name):
    assert outputs.route(command).name == name


def test_filters_do_what_they_say():
    text, name, used = outputs.compress("git status", "On branch main\n  (use \"git\" x)\n\tmodified:   a.py\n\nno changes added to commit\n")
    assert text == "\tmodified:   a.py" and used == ["filter"]
    text, _, used = outputs.compress("ls", "\n".join(f"f{i}.py" for i in range(6)) + "\nREADME")
    assert text == "README\n*.py: 6 files" and "group" in used
    text, _, _ = outputs.compress("docker ps", "ID   NAMES   STATUS\n1    web     Up\n2    db")
    assert text == "NAMES  STATUS\nweb  Up\ndb  "
    text, _, used = outputs.compress("curl x", '[1, 2, 3, 4, 5, 6, "' + "z" * 300 + '"]')
    assert used == ["json"] and "and 2 more items" in text
    text, _, used = outputs.compress("make", "a 1\nb\na 2\na 3\n")
    assert text == "a 1 (x3)\nb"
    text, _, used = outputs.compress("git push", "x -> y " * 400)
    assert used[-1] == "budget_cap" and len(text) <= 420


@given(st.lists(st.sampled_from(["a b c", "a b d", "x 1", "x 2", "", " ", "p q"]), max_size=12), st.sampled_from([0.5, 0.85, 1.0]))
def test_dedup_equals_a_scan_of_all_earlier_lines(lines, threshold):
    kept = []
    for line in lines:
        norm = outputs.normal(line)
        words = set(norm.split())
        for k in reversed(kept):
            union = k[2] | words
            if k[1] == norm or (len(k[2] & words) / len(union) if union else 1.0) >= threshold:
                k[3] += 1
                break
        else:
            kept.append([line, norm, words, 1])
    want = [k[0] if k[3] == 1 else f"{k[0]} (x{k[3]})" for k in kept]
    assert outputs.dedup(lines, threshold, "{line} (x{count})") == want


def test_compress_outputs_keeps_columns(spark):
    df = spark.createDataFrame([(1, "git status", "On branch x\n"), (2, None, None), (3, "x", "")], "id int, command string, output string")
    got = {r.id: r for r in outputs.compress_outputs(df).collect()}
    assert got[1].compressed == "" and got[2].filter_name == "generic" and got[3].ratio == 1.0
    names = {r.id: r.f for r in df.select("id", outputs.filter_name(F.coalesce("command", F.lit(""))).alias("f")).collect()}
    assert names == {1: "git_status", 2: "generic", 3: "generic"}


# Memory


def test_facts_and_supersession(spark):
    rows = [(1, 0, "user", "My name is Ada. I'm using Rust"), (1, 1, "assistant", "my name is Bot"), (1, 2, "user", "we switched to Go"), (1, 3, "user", "Please always test. my name is ada")]
    got = memory.facts(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    said = {r.content: r.superseded for r in got}
    assert said["User's name is Ada"] in (True, False) and said["Using Rust"] and not said["Using Go"]
    assert "User's name is Bot" not in said and not said["Instruction: Please always test."]


def test_history_budget(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"point {i} about things. more") for i in range(30)] + [(2, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for most in (10, 60, 2000):
        got = {r.conv_id: r for r in memory.compress_history(df, most).collect()}
        assert got[1].token_count <= max(most, 60) and got[1].original_count == 30
        assert list(got[2].recent) == ["hi"] if most > 20 else True
    assert memory.fit_budget("s" * 500, ["f"], ["r"], 1)[3] <= 120


def test_relative_dates(spark):
    df = spark.createDataFrame([("Yesterday we met, last Friday too", datetime.datetime(2024, 5, 15))], "t string, ts timestamp")
    assert df.select(T.relative_dates("t", "ts").alias("x")).first().x == "yesterday [2024-05-14] we met, last Friday [2024-05-10] too"


# Retrieval


def test_rrf_counts_a_document_once_a_ranking(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 5, 3)], "query_id long, doc_id long, rank int")
    got = {r.doc_id: r.score for r in retrieval.rrf([a, a.where("doc_id = 6")]).collect()}
    assert abs(got[5] - 1 / 61) < 1e-12 and abs(got[6] - 2 / 62) < 1e-12


def test_entity_bridges(spark):
    edges = spark.createDataFrame([(1, "ada"), (1, "rust"), (2, "rust"), (2, "bob"), (3, "rust")], "doc_id long, entity string")
    asked = spark.createDataFrame([(1, "ada"), (1, "bob")], "query_id long, entity string")
    assert {tuple(r) for r in retrieval.entity_bridges(edges, asked).collect()} == {(1, 1, 2, "rust", "ada"), (1, 2, 1, "rust", "bob")}
    text = spark.createDataFrame([("The Ada met BOBBY and Rust in NASA",)], "t string")
    assert text.select(T.entities("t", ENTITY_STOP).alias("e")).first().e == ["ada", "rust", "nasa"]


def test_names_by_their_lists(spark):
    df = spark.createDataFrame([("Hello (Alice), what did Marie-Louise, NASA and Bob say?",)], "t string")
    got = df.select(T.spaced_entities("t", HIT_STOP).alias("a"), T.entities("t", GRAPH_STOP, None).alias("b")).first()
    assert got.a == ["alice", "marie-louise", "nasa", "bob"] and got.b == ["hello", "alice", "marie", "louise", "nasa", "bob"]


def test_scores_that_are_no_number_come_last(spark):
    nan = float("nan")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [nan, 0.0]), (3, [0.5, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [r.doc_id for r in retrieval.vector_top_k(v, q, 5).orderBy("rank").collect()] == [1, 3, 2]
    assert [r.doc_id for r in retrieval.vector_top_k(v, q, 2).orderBy("rank").collect()] == [1, 3]


def test_bridges_count_only_where_direct_hits_cover_little(spark):
    docs = spark.createDataFrame([(1, "Ada uses Rust"), (2, "Rust and Bob"), (3, "Cyd likes Go"), (4, "Dan"), (5, "Eve")], "doc_id long, text string")
    far = spark.createDataFrame([(1, "Ada Bob Cyd Dan Eve")], "query_id long, text string")
    plain = {r.doc_id: r.score for r in retrieval.entity_scores(docs, far, [], bridges=0).collect()}
    got = {r.doc_id: r.score for r in retrieval.entity_scores(docs, far, []).collect()}
    assert abs(got[2] - 1.5 * plain[2]) < 1e-9 and abs(got[1] - 1.5 * plain[1]) < 1e-9 and got[3] == plain[3]
    near = spark.createDataFrame([(1, "Ada Bob")], "query_id long, text string")
    assert all(abs(r.score - plain[r.doc_id]) < 1e-9 for r in retrieval.entity_scores(docs, near, []).collect())


def shuffled_rows(plan):
    """Rows that the exchanges of a plan that has run have written."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled_rows(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(shuffled_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_bm25_shuffles_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "_BLOCK", 25, raising=False)  # three blocks of queries
    rnd = random.Random(5)
    texts = {i: " ".join(["the"] + [f"w{int(rnd.paretovariate(0.7)) % 90}" for _ in range(rnd.randrange(40))]) for i in range(400)}
    texts |= {i: "The same, the SAME w3" for i in range(400, 440)} | {440: "", 441: None, 442: "?!"}
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(texts.items()), 4), "doc_id long, text string")
    asked = {i: t for i, t in texts.items() if i % 8 == 0} | {1000: "nowhere", 1001: "w1 w2 w1 the"}
    hits = retrieval.bm25(docs, spark.createDataFrame(list(asked.items()), "query_id long, text string"))
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in hits.collect()}

    words = {i: re.findall(r"[a-z0-9]+", t.lower()) for i, t in texts.items() if t is not None}
    n, mean = len(texts), sum(map(len, words.values())) / len(words)
    df = Counter(w for own in words.values() for w in set(own))
    want = {}
    for q, t in asked.items():
        scores = []
        for i, own in words.items():
            tf = Counter(own)
            part = [math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w in set(re.findall(r"[a-z0-9]+", (t or "").lower())) & set(own)]
            scores += [(-round(sum(part), 8), i)] if part else []
        want |= {(q, rank): (i, -x) for rank, (x, i) in enumerate(sorted(scores)[:5], 1)}
    assert {at: i for at, (i, _) in got.items()} == {at: i for at, (i, _) in want.items()}
    assert all(abs(got[at][1] - x) < 1e-6 for at, (_, x) in want.items())
    assert shuffled_rows(hits._jdf.queryExecution().executedPlan()) <= 4 * 5 * len(asked)  # the best five of each query and task


def test_hash_embeddings_are_unit_vectors(spark):
    df = spark.createDataFrame([(1, "some words here"), (2, " "), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.embedding for r in retrieval.hash_embedding(df).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-5 and got[2] is None and got[3] is None


def test_retrieve_and_section_scores(spark):
    docs = spark.createDataFrame([(1, "a dog barks at night"), (2, "stock prices fell"), (3, "the puppy barks")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "dog barks")], "query_id long, text string")
    got = retrieval.retrieve(docs, q, k=2).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 3] and all(r.cosine > 0.15 for r in got)
    parts = spark.createDataFrame([(1, "x", "sorting lists in python"), (1, "y", "baking bread")], "prompt_id long, section_id string, content string")
    asked = spark.createDataFrame([(1, "sort a python list")], "prompt_id long, query string")
    scores = {r.section_id: r.score for r in retrieval.section_scores(parts, asked).collect()}
    assert scores["x"] > scores["y"]


# Prompts


def test_prompt_sections_and_choice(spark):
    text = "".join(f"<{n}>{c}</{n}>" for n, c in [("core_identity", "You are helpful."), ("code_formatting", "Use code blocks for code."), ("programming_python", "Python function advice"), ("creative_writing", "Tell a story or poem."), ("math_rules", "Show each equation")])
    df = spark.createDataFrame([(1, text, "Write a Python function to sort a list"), (2, "intro\n## One\na\n## Two\nb", ""), (3, "", None)], "prompt_id long, text string, query string")
    got = {r.prompt_id: r for r in prompts.compress_prompts(df, 100).collect()}
    assert "code_formatting" in got[1].included and "math_rules" in got[1].excluded and got[1].token_count <= 100
    assert got[2].included[0] == "one" and 3 not in got
    names = [r.section_id for r in prompts.sections(spark.createDataFrame([(1, "<a>x</a><a>y</a>")], "prompt_id long, text string")).orderBy("pos").collect()]
    assert names == ["a", "a_2"]
    scored = spark.createDataFrame([(1, "math_rules", 0.6), (1, "creative_writing", 0.5)], "prompt_id long, section_id string, score double")
    got = prompts.compress_prompts(df.where("prompt_id = 1"), 100, scores=scored).first()
    assert "math_rules" in got.included and "creative_writing" in got.excluded
    assert [n for n, _ in prompts.split_sections("RULE: be kind\nRULE: be brief")] == ["rule_1", "rule_2"]


# Chunks


def test_chunks(spark):
    df = spark.createDataFrame([(1, 0, "See:\n```py\nx = 1\n```\nDone. " + "Word " * 400), (1, 1, 'Tool call: f({"b": 1, "a": 2})'), (1, 2, '{"type": "tool_result", "content": [{"type": "text", "text": "ok"}]}'), (1, 3, "Same."), (2, 0, "Same."), (2, 1, None)], "conv_id long, turn long, text string")
    got = chunks.chunk_messages(df).collect()
    kinds = {(r.conv_id, r.turn, r.kind) for r in got}
    assert {(1, 0, "code"), (1, 0, "prose"), (1, 1, "tool_use"), (1, 2, "tool_result"), (1, 3, "prose")} <= kinds and (2, 0, "prose") not in kinds
    assert next(r.content for r in got if r.kind == "tool_use") == 'f({"a": 2, "b": 1})'


# Deltas


@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abc"), max_size=6))
def test_edit_rounds(a, b):
    text, error = deltas.edit("\n".join(["head", *a, "tail"]), [{"kind": "replace", "anchor": "head", "text": "\n".join(b)}])
    assert error is None and text.endswith("tail")


def test_edits_are_looked_up_first_and_by_symbol():
    text = "pub struct S {\n  x\n}\nclass C\nasync fn go() {\n  {\n  }\n}\nlast\n"
    edits = [{"kind": "delete", "anchor": "symbol struct S", "text": None}, {"kind": "insert_before", "anchor": "symbol function go", "text": "// a\n// b"}, {"kind": "insert_after", "anchor": "symbol function go", "text": "after"}, {"kind": "replace", "anchor": "lines 4-4", "text": "class D"}]
    assert deltas.edit(text, edits) == ("class D\n// a\n// b\nasync fn go() {\n  {\n  }\n}\nafter\nlast\n", None)
    for anchor, error in (("symbol enum S", "anchor not found"), ("lines 3-99", "lines out of range"), ("{", "anchor is not unique"), ("none", "anchor not found")):
        assert deltas.edit(text, [edits[0], {"kind": "delete", "anchor": anchor, "text": None}]) == (text, error)


def test_patch_round_trip(spark):
    texts = ["", "a", "a\nb", "a\nb\nc", "b\nc", "a\nx\nc", "a\na\na", "a\na", "x\n", "c\nb\na"]
    df = spark.createDataFrame([(x, y) for x in texts for y in texts], "old string, new string")
    got = deltas.with_diff(df, "old", "new").select("new", T.unlines(deltas.patch("old", F.col("d"))).alias("back"), T.unlines(T.lines("new")).alias("want")).collect()
    assert all(r.back == r.want for r in got)


def test_dictionary_coding_of_awkward_blocks(spark):
    shared = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"{shared}\n[[f:0123456789abcdef]]\n\\\\[[f:x"), (2, f"a\n{shared}"), (3, "")], "doc_id long, text string")
    words = deltas.fragments(docs)
    coded = deltas.encode(docs, words)
    assert words.count() == 1 and {r.doc_id: len(r.used) for r in coded.collect()} == {1: 1, 2: 1, 3: 0}
    back = {r.doc_id: r.text for r in deltas.decode(coded, words).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}


def test_delta_protocol(spark):
    snap = spark.createDataFrame([("p", 1, "a\nb"), ("p", 2, "a\nc")], "path string, version int, content string")
    req = spark.createDataFrame([("p", 1, None), ("p", 2, None), ("p", None, None), ("q", 1, None)], "path string, known_version int, known_hash string")
    got = {(r.path, r.known_version): r for r in deltas.read_delta(req, snap).collect()}
    assert [got[k].kind for k in (("p", 1), ("p", 2), ("p", None), ("q", 1))] == ["delta", "unchanged", "full", "missing"]
    assert list(got["p", 1].change.inserted) == ["c"]
    edits = spark.createDataFrame([("p", 2, "z"), ("p", 1, "z"), ("n", None, "z")], "path string, base_version int, content string")
    assert {(r.accepted, r.version) for r in deltas.write_delta(edits, snap).collect()} == {(True, 3), (False, 2), (True, 1)}


# Graph and code


def test_triples_merge_and_answer(spark):
    rows = [("Ada Lovelace", "Lives In", "London", "entity", 0.6, "m1", "2024-01-01"), ("ada lovelace", "lives in", "london", "entity", 0.9, "m2", "2024-02-01"), ("Bob", "likes", "tea", "literal", None, "m1", "2024-01-03")]
    t = spark.createDataFrame(rows, "subject string, predicate string, object string, object_kind string, confidence double, source string, ts string")
    facts, ents = graph.merge_facts(t), graph.merge_entities(t)
    f = {r.s: r for r in facts.collect()}
    assert len(f) == 2 and f["ada lovelace"].confidence == 0.9 and list(f["ada lovelace"].sources) == ["m1", "m2"] and f["bob"].confidence == 0.7
    names = spark.createDataFrame([(1, "Ada"), (1, "London"), (2, "bob")], "query_id long, name string")
    got = {(r.query_id, r.s): r for r in graph.query_facts(names, facts, ents).collect()}
    assert set(got) == {(1, "ada lovelace"), (2, "bob")} and abs(got[1, "ada lovelace"].score - 0.9 * 1.5) < 1e-6


def test_pagerank_sums_to_one_and_closure(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("b", "d"), ("a", "b")], "src string, dst string")
    got = {r.node: r.rank for r in graph.pagerank(nodes, edges, rounds=6, cut=3).collect()}
    assert abs(sum(got.values()) - 1) < 1e-6 and got["b"] > got["a"] and got["d"] > got["a"]
    reach = graph.closure(edges.toDF("a", "b"), nodes.where("node = 'a'"))
    assert {r.node for r in reach.collect()} == {"a", "b", "d"}


def test_symbols_and_navigation(spark):
    sources = [
        ("src/util.py", "class Store:\n    def put(self, x):\n        pass\n\ndef helper_fn(a):\n    return a\n"),
        ("src/a.py", "from util import helper_fn\nhelper_fn(1)\n"),
        ("src/b.py", "def main_b():\n    helper_fn(2)\n"),
        ("lib.rs", "pub fn run_all() {}\npub(crate) struct Engine;\nenum Kind {}\n"),
        ("m.go", "func (s *Srv) Serve(x int) {}\ntype Srv struct {}\n"),
        ("A.java", "public class Main {\n    public static void start(String[] a) {\n"),
        ("x.ts", "export interface Opt {}\nexport const make = 1\n"),
        ("n.txt", "def no(): pass"),
    ]
    df = spark.createDataFrame(sources, "path string, content string")
    got = {(r.path, r.kind, r.name) for r in code.symbols(df).collect()}
    assert {("src/util.py", "class", "Store"), ("src/util.py", "method", "put"), ("src/util.py", "function", "helper_fn"), ("lib.rs", "struct", "Engine"), ("m.go", "method", "Serve"), ("A.java", "method", "start"), ("x.ts", "interface", "Opt")} <= got
    assert not any(p == "n.txt" for p, *_ in got)
    top = code.navigate(df, "helper").orderBy("rank", "line").first()
    assert top.path == "src/util.py"


# Sources, hooks, streams


def test_scan_and_store(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name in ("a/x.py", "a/y.log", "node_modules/z.py", "big.py", "yarn.lock"):
        (tmp_path / name).write_text("x" * (50 if name != "big.py" else 5000))
    (tmp_path / ".gitignore").write_text("*.log\n# no\n")
    got = {r.path for r in files.scan(spark, str(tmp_path), max_bytes=1000).collect()}
    assert got == {"a/x.py"}  # Spark itself leaves hidden files out
    assert {r.path for r in files.listing(spark, str(tmp_path), ["py"]).collect()} == {"a/x.py", "big.py"}
    store, schema = str(tmp_path / "store"), "id string, v int"
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], schema)
    files.insert(spark, store, rows.where("id = 'a'").limit(1), "id", schema)
    files.insert(spark, store, rows, "id", schema)
    assert sorted(r.id for r in files.read_store(spark, store, schema).collect()) == ["a", "b"]
    files.clear(spark, store)
    assert files.insert(spark, store, rows, "id", schema).count() == 2


def test_hooks(spark):
    assert hooks.first_json('so {"a": "}"} end') == '{"a": "}"}' and hooks.first_json("{ no") is None
    assert hooks.ask(lambda p: '{"result": "r"}', "x") == "r" and hooks.ask(lambda p: 1 / 0, "x") is None and hooks.ask(None, "x") is None
    assert hooks.triples('{"triples": [{"subject": "a", "predicate": "b", "object": "c", "confidence": 3}, {"subject": ""}]}')[0]["confidence"] == 1.0
    assert hooks.variants("q", "1. one\n- two\nq") == ["q", "one", "two"] and hooks.rerank([0.1, 0.2], "8") == [0.8, 0.5]
    df = spark.createDataFrame([(1, "p")], "id int, prompt string")
    assert hooks.with_replies(df, "prompt", lambda p: p.upper()).first().reply == "P"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 else "assistant", f"turn {t}? of {c}. x") for c in (1, 2) for t in range(25)]
    schema = "conv_id long, turn int, role string, text string"
    want = {tuple(r) for r in stream.rolling_summary_batch(spark.createDataFrame(rows, schema), 10, 2, 2).collect()}
    for parts in (1, 3):
        source = tmp_path / f"in{parts}"
        for i in range(parts):
            cut = [r for r in rows if r[1] * parts // 25 == i] + ([r for r in rows if r[1] == 0] if i else [])
            spark.createDataFrame(cut, schema).coalesce(1).write.mode("append").parquet(str(source))
        df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        name = f"rolling{parts}"
        q = stream.rolling_summary(df, 10, 2, 2).writeStream.outputMode("update").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        last = {}
        for r in spark.table(name).collect():
            if r.conv_id not in last or r.seen >= last[r.conv_id].seen:
                last[r.conv_id] = r
        assert {tuple(r) for r in last.values()} == want


def test_windowed_stats(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert stream.windowed_stats(events).agg(F.sum("n")).first()[0] == events.count()
    assert stream.session_stats(events).agg(F.sum("events")).first()[0] == events.count()


# Queries and commands


def test_expressions_over_queries_and_commands(spark):
    from textloom.functions import asking

    q = spark.createDataFrame([(1, "my dog and Cat"), (2, "compare them"), (3, "why"), (4, "did Anna meet Boris")], "id int, q string")
    got = {r.id: r for r in q.select("id", asking.expand("q").alias("x"), asking.several_hops("q").alias("h")).collect()}
    assert got[1].x == "my dog and Cat pet puppy retriever breed kitten feline" and got[3].x == "why"
    assert [got[i].h for i in (2, 3, 4)] == [True, False, True]
    c = spark.createDataFrame([("git status",), ("git log | head",), ("make all",), ("kubectl get x",)], "c string")
    rows = c.select("c", asking.command_family("c").alias("f"), asking.wrap("c").alias("w")).collect()
    assert [r.f for r in rows] == ["git", "git", "build", "docker"]
    assert rows[0].w.rule == "git_status" and rows[0].w.command.endswith("exec -- git status") and rows[1].w.rule is None
    assert asking.register(spark)[0] == "tl_normal_line"
    assert tuple(spark.sql("select tl_tokens('abcde fg!'), tl_words('A b'), tl_normal_line(' x 12 ')").first()) == (4, ["a", "b"], "x <N>")


def test_trade_rank_takes_all_lines(spark, sf):
    from textloom.plans import relational

    read = {n: spark.read.parquet(f"{sf}/{n}.parquet").toPandas() for n in ("orders", "customer", "lineitem", "supplier", "nation")}
    o = read["orders"].merge(read["customer"], left_on="o_custkey", right_on="c_custkey")
    j = read["lineitem"].merge(read["supplier"], left_on="l_suppkey", right_on="s_suppkey").merge(o, left_on="l_orderkey", right_on="o_orderkey")
    links = {(a, b) for a, b in zip(j.c_nationkey, j.s_nationkey, strict=True) if a != b}
    nodes = sorted(set(read["nation"].n_nationkey))
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(10):
        lost = sum(rank[a] for a in nodes if not any(x == a for x, _ in links))
        given = {b: sum(rank[x] / sum(y == x for y, _ in links) for x, z in links if z == b) for b in nodes}
        rank = {b: 0.15 / len(nodes) + 0.85 * (given[b] + lost / len(nodes)) for b in nodes}
    got = {r.node: r["rank"] for r in relational.trade_rank(spark, sf).collect()}
    assert set(got) == set(nodes) and all(abs(got[n] - rank[n]) < 2e-6 for n in nodes)
