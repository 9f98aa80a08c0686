"""Search, pages, conversations and the pipeline."""

import json

import duckdb
import numpy as np
import pytest

from vectrail.llm import ann, extract, toolcalls


def test_search_finds_the_nearest(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(500, 12)) + 4 * c for c in rng.normal(size=(6, 12))]).astype(np.float32)
    x[100:140] = x[7]  # one vector many times
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(9001, None), (9002, [0.0] * 12), (9003, [float("nan")] * 12), (9004, [1.0, 2.0]), (9005, [None] * 12), (None, [1.0] * 12), (5, [float(v) for v in x[5]])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(4)
    vectors = ann.valid_vectors(table)
    assert vectors.count() == len(x)
    got = ann.search(vectors, where="vec_id % 50 = 0", sample_rows=1000, parts=12).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, len(x), 50):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and q not in [v for _, v, _ in own]
        s = u @ u[q]
        s[q] = -9
        for _, v, score in own:
            assert abs(score - s[v]) < 1e-12
        hit += sum(v in np.lexsort((np.arange(len(s)), -s))[:5] or s[v] >= np.sort(s)[-5] - 1e-12 for _, v, _ in own)
    assert hit / (5 * len(range(0, len(x), 50))) >= 0.9
    exact = ann.search(vectors, where="vec_id = 100", sample_rows=1000, parts=12, probes=12).orderBy("rank").collect()
    assert [r["vec_id"] for r in exact] == [7, 101, 102, 103, 104]
    assert ann.search(ann.valid_vectors(table.limit(0)), where="vec_id % 50 = 0").count() == 0
    few = ann.valid_vectors(table.filter("vec_id < 3"))
    assert ann.search(few, where="vec_id = 0").count() == 2


def test_balanced_parts_respect_the_capacity():
    x = ann.unit(np.random.default_rng(0).normal(size=(400, 8)))
    label = ann.balanced_parts(x, ann.neighbour_graph(x, 6), 8)
    assert np.bincount(label, minlength=8).max() <= int(np.ceil(1.1 * 400 / 8))


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var x="<p>no</p>";</script></head>
<body class="has-sidebar"><header>Site name</header><nav><ul><li><a href="/">Home</a></li><li>Menu</li></ul></nav>
<div class="cookie-notice">We use cookies.</div><!-- <p>no</p> -->
ARTICLE
<aside>Related</aside><form><p>Subscribe to us</p></form><section id="comments"><p>First! A long comment by a reader that has many words in it and more.</p></section>
<footer>&copy; 2020 Someone</footer></body></html>"""
BODY = """<h1>A &amp; B</h1><p>First <b>bold</b>
  paragraph&nbsp;text that is long enough to be an article, with <a href="x">a link</a> in it.</p><p>Short.</p>
<ul><li>Item one</li><li>Item two</li></ul><div class="ad">Buy now</div><p>Last &lt;words&gt; &#233;&#x41; of the article, again rather long so that it counts."""
WANT = "A & B\nFirst bold paragraph text that is long enough to be an article, with a link in it.\nShort.\nItem one\nItem two\nLast <words> éA of the article, again rather long so that it counts."


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", '<div class="content">{}</div>', "<article>{}"])
def test_main_text(around):
    assert extract.main_text(PAGE.replace("ARTICLE", around.format(BODY))).split("\n")[: WANT.count("\n") + 1] == WANT.split("\n")
    if "</" in around:
        assert extract.main_text(PAGE.replace("ARTICLE", around.format(BODY))) == WANT


def test_odd_pages(spark):
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<nav>x</nav>") == ""
    assert extract.main_text("plain words") == "plain words"
    assert extract.main_text("a < b and <p>c") == "a < b and\nc"
    assert extract.main_text('<p>broken <a href="x>text</p>') != ""
    long = "<p>" + "word " * 200_000 + "</p>"
    assert len(extract.main_text(long)) == 5 * 200_000 - 1
    rows = [(1, "u", "<article><p>x</p></article>", "n"), (1, "u", "<article><p>x</p></article>", "n"), (None, None, None, None)]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, "x", 1), (1, "x", 1)]


SCHEMAS = {
    "add": {"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["integer", "null"]}, "mode": {"enum": ["x", "y"]}, "of": {"type": "array", "maxItems": 2}}, "required": ["a"], "additionalProperties": False},
}


def linked(spark, rows):
    calls, results = toolcalls.messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    return {r["call_id"]: r for r in toolcalls.link(calls, results, SCHEMAS).collect()}


def call(turn, *calls):
    return (1, turn, "assistant", json.dumps({"tool_calls": [{"id": i, "function": {"name": n, "arguments": a if isinstance(a, str) else json.dumps(a)}, **({"depends_on": d} if d else {})} for i, n, a, d in calls]}))


def answer(turn, ident, content):
    return (1, turn, "tool", json.dumps({"tool_call_id": ident, "content": content}))


def brute_surges(weight, need, window=3):
    """Lines from a surge to its dive, line by line: joined are lines with no empty window between them."""
    n = len(weight)
    sums = [sum(weight[i : i + window]) for i in range(n)]
    runs, now = [], []
    for i in range(n):
        if not now and not weight[i]:
            continue
        if sums[i]:
            now.append(i)
        elif now:
            runs.append(now)
            now = []
    runs += [now] * bool(now)
    return [(r[0], r[-1] + 1) for r in runs if max(sums[i] for i in r) >= need]


@pytest.mark.parametrize("seed", range(5))
def test_surges_equal_a_brute_force_scan(seed):
    rng = np.random.default_rng(seed)
    weight = [int(w) for w in rng.integers(0, 120, 200) * (rng.random(200) < 0.4)]
    assert extract.surges(weight, 86) == brute_surges(weight, 86)
    assert extract.window_sums(weight) == [sum(weight[i : i + 3]) for i in range(200)]


def test_the_distribution_decides():
    """Without hints short stray lines go and every surge stays; with an article the text around it must outweigh it."""
    long = "many words of the article stand here, one after the other, in a line that is long enough"
    menu = "".join(f"<div>{w}</div>" for w in ("Home", "News", "Shop"))
    split = "<ul class='ad'><li>a</li><li>b</li><li>c</li><li>d</li></ul>"
    page = f"<div>{menu}</div>{split}<div><p>{long} 1</p><p>{long} 2</p>{split}<p>The end.</p></div>{split}<div>Contact</div>"
    assert extract.main_text(page) == f"{long} 1\n{long} 2\nThe end."
    two = f"<div><p>{long} 1</p></div>{split}<section><p>{long} 2</p></section>"
    assert extract.main_text(two) == f"{long} 1\n{long} 2"
    assert extract.main_text(f"<div>Tip of the day</div><article class='post category-legal'><p>{long}</p><p>Bye.</p></article>") == f"{long}\nBye."
    assert extract.main_text(f"<div class='with-sidebar'><main><p>{long}</p></main></div>") == long
    assert extract.main_text(f"<article><p>{long}</p></article><article class='comment'><p>{long * 9}</p></article>") == long
    near, far = extract.weights(extract.lines_of(f"<p>stray text</p><article><p>{long}</p></article>"))
    assert near == [0, len(long)] and far == [len("stray text") // extract.FAR, 0]


def test_empty_table_of_pages(spark):
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tool_calls(spark):
    got = linked(
        spark,
        [
            call(1, ("a", "add", {"b": None, "a": 1}, None), ("b", "add", {"a": 1.5, "z": 1}, ["c"]), ("bad", "add", "[1]", None), ("who", "none", {}, ["gone"])),
            call(3, ("c", "add", {"a": -1, "mode": "z", "of": [1, 2, 3]}, ["a"]), ("a", "add", {"a": 2}, None)),
            call(5, ("x", "add", {"a": 1}, ["y"]), ("y", "add", {"a": 1}, ["x"])),
            answer(2, "a", "one"),
            answer(4, "c", {"n": [1]}),
            answer(6, "lost", "?"),
            answer(7, "a", "two"),
            (1, None, "user", "x"),
            (None, 3, "user", "x"),
        ],
    )
    assert got["a"]["status"] == "linked" and got["a"]["n_results"] == 2 and got["a"]["errors"] == "repeated call"
    assert got["a"]["json"] == '{"arguments":{"a":1,"b":null},"call_id":"a","conv_id":1,"errors":["repeated call"],"name":"add","result":"one"}'
    assert got["b"]["errors"] == "a: type,arguments: additional" and got["bad"]["errors"] == "arguments"
    assert got["who"]["errors"] == "unknown dependency,unknown tool" and got["lost"]["status"] == "orphan"
    assert got["c"]["errors"] == "a: minimum,mode: enum,of: maxItems" and json.loads(got["c"]["json"])["result"] == '{"n":[1]}'
    order = lambda i: (got[i]["order_turn"], got[i]["order_step"])
    assert order("a") < order("c") < order("b") == (3, 1)
    assert got["x"]["order_turn"] is None and got["y"]["errors"] == "cycle"


def test_calls_without_identifier_and_unreadable_results(spark):
    rows = [
        (1, 0, "assistant", '{"tool_calls": [{"name": "add", "arguments": {"a": 1}}, {"id": "k", "name": "add", "arguments": {"a": 2}}]}', "z", 9),
        (1, 1, "tool", "not json", "z", 9),
        (1, 2, "tool", '{"content": "no id"}', "z", 9),
        (1, 3, "tool", None, "z", 9),
        (1, 4, "tool", json.dumps({"tool_call_id": "k", "content": "x" * 300_000}), "z", 9),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id string, errors long")
    calls, results = toolcalls.messages(table)
    got = {r["call_id"]: r for r in toolcalls.link(calls, results, SCHEMAS).collect()}
    assert got["?0.0"]["status"] == "unanswered" and "no identifier" in got["?0.0"]["errors"]
    assert {got[f"?{t}"]["status"] for t in (1, 2, 3)} == {"orphan"}
    assert got["k"]["status"] == "linked" and len(json.loads(got["k"]["json"])["result"]) == 300_000
    calls, results = toolcalls.messages(table.limit(0))
    assert toolcalls.link(calls, results, SCHEMAS).count() == 0


def _kahn(calls):
    """order_turn and order_step by the definition, for calls {id: (turn, deps)}."""
    done: dict = {}
    while True:
        ready = [i for i, (_, deps) in calls.items() if i not in done and all(d in done for d in deps if d in calls)]
        if not ready:
            return done
        for i in ready:
            turn, deps = calls[i]
            done[i] = max([(turn, 0), *((done[d][0], done[d][1] + 1) for d in deps if d in calls)])


@pytest.mark.parametrize("seed", range(2))
def test_order_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    calls = {f"c{i}": (int(rng.integers(0, 6)), [f"c{j}" for j in rng.integers(0, 16, rng.integers(0, 3)).tolist() if j != i]) for i in range(14)}
    table = spark.createDataFrame([(7, i, t, d) for i, (t, d) in calls.items()], "conv_id long, call_id string, turn long, depends_on array<string>")
    got = {r["call_id"]: r for r in toolcalls.topological_keys(table).collect()}
    want = _kahn(calls)
    back = any(calls[d][0] >= t for t, deps in calls.values() for d in deps if d in calls)
    assert back and {i: (r["order_turn"], r["order_step"]) for i, r in got.items() if r["order_turn"] is not None} == want
    assert {i for i, r in got.items() if r["missing"]} == {i for i, (_, deps) in calls.items() if any(d not in calls for d in deps)}


def test_calls_and_results_meet_in_a_hash_join(spark, sf_dir):
    plan = toolcalls.op8_tool_call_linking(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_plain_conversations(spark):
    calls, results = toolcalls.messages(spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (2, 5, "assistant", "?"), (1, 0, "user", "hi")], "conv_id long, turn long, role string, text string"))
    got = {(r["conv_id"], r["call_id"]): r for r in toolcalls.link(calls, results, toolcalls.ANSWER).collect()}
    assert got[1, "turn-0"]["status"] == "linked" and got[1, "turn-0"]["errors"] == "repeated call"
    assert got[1, "turn-2"]["status"] == "unanswered" and got[1, "turn-2"]["errors"] == "prompt: required"
    assert got[2, "turn-4"]["status"] == "orphan"
    assert toolcalls.link(calls.limit(0), results.limit(0), toolcalls.ANSWER).count() == 0


def test_conversations_equal_their_sql(spark, sf_dir):
    df = toolcalls.op8_tool_call_linking(spark, sf_dir)
    want = duckdb.sql(toolcalls.ORACLE.replace("FROM conversations", f"FROM '{sf_dir}/conversations.parquet'"))
    at = [want.columns.index(c) for c in sorted(df.columns)]
    rows = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    assert rows == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_pipeline_of_odd_documents(spark, tmp_path):
    """Nulls, copies, a null id, columns with names that the stages use, and an empty table."""
    import corpus_pipeline

    say = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, None, 1), (2, "", 2), (3, say, 3), (None, say + " again", 4), (4, say, 5), (5, "other words " * 9, 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, bucket long").selectExpr("doc_id", "text", "'en' lang", "bucket", "bucket score", "'x' found", "length(text) n_chars")
    labels = spark.createDataFrame([(3, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "other words other words")], "item_id long, text string")
    for n, docs in enumerate((table, table.limit(0))):
        where = str(tmp_path / f"t{n}")
        docs.write.parquet(f"{where}/documents.parquet")
        labels.write.parquet(f"{where}/labels.parquet")
        bench.write.parquet(f"{where}/benchmark.parquet")
        now = spark.read.parquet(f"{where}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, where)
            assert now.columns == table.columns
        kept = {r["doc_id"] for r in now.collect()}
        assert kept == ({1, 3} if not n else set())  # 2 is a copy of 1, 4 and the null id of 3, and 5 is of the benchmark
        assert {r["doc_id"] for r in corpus_pipeline.run(spark, where).collect()} == kept


def test_pipeline_equals_its_stages(spark, sf_dir):
    import corpus_pipeline
    from vectrail.llm import decontaminate, simhash, suffix, toxicity
    from vectrail.llm.common import read_table

    docs = read_table(spark, sf_dir, "documents")
    columns, now = docs.columns, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, sf_dir)
        assert after.columns == columns
        now = spark.createDataFrame(after.collect(), docs.schema)
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    scored, name = toxicity.score(docs, model)
    clean = [r for r in scored.collect() if r[name] < 0.3]
    prints = [(simhash.fingerprint(r["text"].encode()), r) for r in clean]
    kept, seen = [], []
    for f, r in sorted(prints, key=lambda x: x[1]["doc_id"]):  # components by growing groups
        groups = [g for g in seen if any((f ^ o).bit_count() <= 4 for o in g[0])]
        merged = (sum((g[0] for g in groups), [f]), min([r["doc_id"], *(g[1] for g in groups)]))
        seen = [g for g in seen if g not in groups] + [merged]
    first = {g[1] for g in seen}
    kept = [r for _, r in prints if r["doc_id"] in first]
    raw = [r["text"].encode() for r in kept]
    count: dict = {}
    for t in raw:
        for i in range(len(t) - 399):
            count[t[i : i + 400]] = count.get(t[i : i + 400], 0) + 1
    bench = decontaminate.Index([(str(r["item_id"]), (r["text"] or "").encode()) for r in read_table(spark, sf_dir, "benchmark").collect()], 13)
    want = {}
    for r, t in zip(kept, raw):
        gone = [(i, i + 400) for i in range(len(t) - 399) if count[t[i : i + 400]] > 1]
        spans = suffix._union(np.array([g[0] for g in gone], np.int64), np.array([g[1] for g in gone], np.int64)) if gone else []
        text = suffix.cut(t, suffix.whole_characters(t, spans))
        words = decontaminate.words_of(text)
        ids = np.array([bench.vocab.get(w, 0) for w in words], np.int32)
        hit = {i for a, b, _ in bench.find(ids) for i in range(a, b)}
        if not (hit and 20 * len(hit) >= len(words)):
            want[r["doc_id"]] = text.decode()
    assert {r["doc_id"]: r["text"] for r in now.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in now.collect())
    last = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in last.select("doc_id").collect()} == set(want)
