"""The queries of this subpackage against SQL where there is some, and their edges."""

import pytest
from compare import canonical, connection, same

from rankloom.llm import catalog, decontamination, licenses, mixing, toolcalls, warc
from rankloom.llm.common import words_of

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), ORACLE[name], sf_dir)


def against(df, sql, **tables):
    """Rows of a DataFrame against SQL over other DataFrames."""
    con = connection("/nowhere")
    for name, t in tables.items():
        con.register(name, t.toPandas().convert_dtypes())
    assert canonical(df.toPandas()) == canonical(con.execute(sql).df())


def test_odd_licenses(odd_docs, no_docs):
    against(licenses.scan(odd_docs).drop("spans"), licenses.oracle_sql(), documents=odd_docs.select("doc_id", "text"))
    assert licenses.scan(no_docs).count() == 0


def test_license_text_with_changes(spark):
    whole = dict(licenses.TEXTS)["mit"].split()
    changed = whole[:20] + ["inserted"] + whole[20:40] + whole[42:]
    docs = spark.createDataFrame([(1, "Intro. " + " ".join(whole)), (2, " ".join(changed)), (3, " ".join(whole[:9])), (4, " ".join(w + "x" for w in whole))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert [got[i]["labels"] for i in (1, 2, 3, 4)] == ["mit", "mit", "", ""]
    assert got[1]["spans"][0]["first"] == 1 and got[1]["spans"][0]["last"] == len(whole)
    assert got[1]["score"] == 1.0 and 0.7 < got[2]["score"] < 1.0 and len(got[2]["spans"]) == 1


def test_license_behind_its_own_words(spark):
    """Gram hits that lie before a license, on neighbouring diagonals, aren't part of its span."""
    whole = dict(licenses.TEXTS)["mit"].split()
    gap = ["filler"] * (licenses.WORD_GAP + 1)
    texts = {1: whole[:5] * 100 + whole, 2: whole, 3: whole[:5] * 100, 4: whole[:30] + gap + whole[30:], 5: whole + whole, 6: ["mit"] * 4 + ["license"] + ["mit", "license"] * 3, 7: whole[40:] + whole[:40]}
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert [got[i]["labels"] for i in range(1, 8)] == ["mit", "mit", "", "mit", "mit", "mit", "mit"]
    assert got[1]["score"] == got[2]["score"] == got[5]["score"] == 1.0 and got[6]["n_base"] == 4
    assert [(x["first"], x["last"]) for x in got[1]["spans"] if x["last"] - x["first"] > 20] == [(500, 500 + len(whole) - 1)]
    assert len(got[4]["spans"]) == len([x for x in got[5]["spans"] if x["last"] - x["first"] > 20]) == 2
    against(licenses.scan(docs).drop("spans"), licenses.oracle_sql(), documents=docs)


def test_verified_stretch_before_stray_hits(spark):
    """Words that are right here and there behind a verbatim stretch, on its own diagonal, don't cost it."""
    for label, text in licenses.TEXTS:
        words = text.split()
        loose = [w if i < 20 or i % 26 < 5 else f"x{i}" for i, w in enumerate(words)]
        texts = {1: words[:20], 2: loose, 3: [w if i % 26 < 5 else f"x{i}" for i, w in enumerate(words)], 4: ["y"] * 50 + loose + ["y"] * 50 + words}
        docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
        got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
        assert [got[i]["labels"] for i in (1, 2, 4)] == [label] * 3 and all(x["last"] - x["first"] < licenses.SPAN_WORDS for x in got[3]["spans"])
        assert got[2]["score"] >= got[1]["score"] > 0 and got[4]["score"] == 1.0
        against(licenses.scan(docs).drop("spans"), licenses.oracle_sql(), documents=docs)


def test_odd_mixing(odd_docs, no_docs):
    against(mixing.mix(odd_docs).drop("source", "budget"), mixing.MIX_SQL.format(docs="documents"), documents=odd_docs.select("doc_id", "text", "source"))
    assert mixing.mix(no_docs).count() == 0


def test_mix_meets_every_budget(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)  # many ranges a source
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs).toPandas()
    assert (rows["taken"] <= 3 * rows["size"]).all()
    by = rows.groupby("source").agg(taken=("taken", "sum"), budget=("budget", "first"), target=("target", "first"))
    assert (by["taken"] == by["budget"]).all() and ((by["budget"] - by["target"]).abs() <= 0.5).all()
    same(mixing.mix(docs).drop("source", "budget"), mixing.MIX_SQL.format(docs="documents"), sf_dir)


def test_mixed_documents_keep_their_columns(spark, odd_docs, no_docs):
    """Each row goes in with the words that the mix takes, rows that are equal share theirs out."""
    got = mixing.mixed(odd_docs)
    assert got.columns == [*odd_docs.columns, "size_", "taken"]
    rows = got.collect()
    want = sorted((str(r["doc_id"]), r["source"] or "", r["size"], r["taken"]) for r in mixing.mix(odd_docs).filter("taken > 0").collect())
    assert sorted((str(r["doc_id"]), r["source"] or "", r["size_"], r["taken"]) for r in rows) == want and len(want) > 3
    texts = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    assert all((r["doc_id"], r["text"]) in texts and r["size_"] == len(words_of(r["text"])) for r in rows)
    assert mixing.mixed(no_docs).count() == 0


def test_hot_ids_spread_over_key_ranges(spark, monkeypatch):
    """Rows without an id, and of one id, are dealt by their texts."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    docs = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN id WHEN id % 3 = 1 THEN 7L END AS doc_id", "concat('a b ', id) AS text", "'s' AS source")
    assert docs.select(mixing.random_key(docs["doc_id"], docs["text"]).alias("k")).distinct().count() == 900
    against(mixing.mix(docs).drop("source", "budget"), mixing.MIX_SQL.format(docs="documents"), documents=docs)


def test_item_over_rows_of_one_document(spark):
    item = [f"t{i}" for i in range(24)]  # 20 shingles
    boiler = "answer the following question with one word only please".split()
    rows = [(1, " ".join(item[:14])), (1, " ".join(item[10:])), (2, " ".join(item[:14])), (3, " ".join(["x"] * 50 + boiler)), (4, " ".join(boiler + item))]
    items = spark.createDataFrame([(9, " ".join(item))] + [(i, " ".join(boiler + [f"u{i}v{k}" for k in range(4)])) for i in range(20, 60)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS __dirty", "2 AS item_id", "3 AS shingle")
    got = decontamination.contained(docs, items)
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(1, 9), (4, 9)]
    against(got, decontamination.ORACLE_SQL, documents=docs.select("doc_id", "text"), benchmark=items)
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def test_odd_decontamination(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "Released under the MIT license general public"), (2, None), (3, ""), (4, "four"), (4, "four"), (None, "no id at all but words"), (5, "w0x0 w1x1 w2x2 w3x3 w4x4 w5x5")], "item_id long, text string")
    against(decontamination.contained(odd_docs, items), decontamination.ORACLE_SQL.replace("USING (shingle) JOIN n USING (item_id)", "USING (shingle) JOIN n ON n.item_id IS NOT DISTINCT FROM bs.item_id").replace("SELECT doc_id, item_id, n_item", "SELECT doc_id, bs.item_id AS item_id, n_item").replace("GROUP BY doc_id, item_id, n_item", "GROUP BY doc_id, bs.item_id, n_item"), documents=odd_docs.select("doc_id", "text"), benchmark=items)
    assert decontamination.contained(no_docs, items).count() == 0
    assert decontamination.contained(odd_docs, items.limit(0)).count() == 0
    clean = decontamination.clean(odd_docs, items)
    assert clean.columns == odd_docs.columns and 1 not in {r["doc_id"] for r in clean.collect()}


def test_short_items_inside_long_texts(spark):
    filler = [f"f{i}" for i in range(3000)]
    texts = {1: "we found four words here now and more", 2: " ".join([*filler, "four", "words", "here", "now", *filler]), 3: "four words here", 4: "FOUR words, here now", 5: "word", 6: "four words then here now"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(1, "four words here now"), (2, "word"), (3, "four words")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contained(docs, items).collect()}
    assert got == {(d, 1) for d in (1, 2, 4)} | {(5, 2)} | {(d, 3) for d in (1, 2, 3, 4, 6)}
    against(decontamination.contained(docs, items), decontamination.ORACLE_SQL, documents=docs, benchmark=items)
    assert {r["doc_id"] for r in decontamination.clean(docs, items.filter("item_id = 1")).collect()} == {3, 5, 6}


def test_four_fifths_of_an_item_are_enough(spark):
    item = [f"t{i}" for i in range(44)]  # 40 shingles
    texts = {1: item[:36], 2: item[:35], 3: ["x"] * 20_000 + item + ["y"] * 20_000}
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["containment"] for r in decontamination.contained(docs, items).collect()}
    assert got == {1: 0.8, 3: 1.0}


def test_odd_pages(spark):
    big = "é" * 600
    rows = [(1, "u", big), (2, "u\n", big), (3, None, None), (4, "", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", "y" * 1000), (7, "u", "y" * 1000), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS refers_to", "3 AS r_page")
    got = sorted((tuple(r) for r in warc.round_trip(pages).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=str)
    assert got == sorted([(1, 1200, "revisit", 2), (2, 1200, "response", None), (3, 0, "response", None), (4, 0, "response", None), (5, 999, "response", None), (6, 999, "response", None), (7, 1000, "response", None), (7, 1000, "response", None), (None, 1200, "response", None)], key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pages_of_one_id_with_other_payloads(spark):
    same_, other, small = "é" * 600, "z" * 1500, "tiny"
    rows = [(1, "u", same_), (1, "u", other), (1, "u", small), (9, "u", same_), (2, "u", "q" * 1000), (3, "u", "q" * 1000), (2, "u", same_), (2, "u", "q" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    against(warc.round_trip(pages).drop("archive", "offset", "length"), warc.ORACLE_SQL, pages=pages)
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect() if r["page_id"] == 1)
    assert got == [(1, 4, "response", None), (1, 1200, "revisit", 9), (1, 1500, "response", None)]


def test_normaliser(tmp_path):
    import gzip
    import io

    records = [warc.page_record(i, "http://x", "p" * i, None if i % 2 else 1) for i in range(40)]
    out = io.BytesIO()
    index = warc.normalise(io.BytesIO(gzip.compress(b"".join(records))), out)
    assert len(index) == 40
    for i, (offset, length, _) in enumerate(index):
        member = out.getvalue()[offset : offset + length]
        assert gzip.decompress(member) == records[i]
        head, payload = warc.read_at(io.BytesIO(out.getvalue()), offset, length)
        assert head["WARC-Record-ID"] == f"<urn:page:{i}>" and payload == (b"p" * i if i % 2 else b"")
    assert warc.normalise(io.BytesIO(gzip.compress(b"")), io.BytesIO()) == []
    with pytest.raises((EOFError, ValueError)):
        warc.normalise(io.BytesIO(gzip.compress(b"".join(records))[:-40]), io.BytesIO())
    with pytest.raises(ValueError):
        warc.normalise(io.BytesIO(gzip.compress(b"HTTP/1.1 200\r\n\r\n")), io.BytesIO())


# --- tool calls -------------------------------------------------------------------


CALLS = "conv_id long, turn long, call_id string, tool string, arguments string, needs array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False}}


def test_linking(spark):
    calls = spark.createDataFrame([
        (1, 1, "late", "add", '{"a": 1}', ["first"]), (1, 5, "first", "add", '{"b": ["é"], "a": 2.0}', []), (1, 6, "last", "add", '{"a": 2}', ["late", "nobody"]),
        (2, 1, "x", "add", '{"a": 1}', ["y"]), (2, 2, "y", "add", '{"a": 1}', ["x"]), (2, 3, "z", "add", '{"a": 1}', ["y"]), (2, 4, "free", "none", "{}", []),
        (3, 1, "p", "add", "{", []), (3, 2, "q", "add", '{"a": -1}', []), (3, 2, "q", "add", '{"a": -1}', []), (3, None, None, None, None, None), (None, 1, "p", "add", '{"a": 1, "a": 2}', []),
    ], CALLS)
    results = spark.createDataFrame([(1, 9, "first", "late answer"), (1, 7, "first", "answer"), (1, 8, "ghost", "boo"), (None, 3, "p", None)], RESULTS)
    rows = toolcalls.link(calls, results, SCHEMAS).collect()
    got = {(r["conv_id"], r["call_id"]): r for r in rows}
    assert len(rows) == 13
    assert [got[1, c]["position"] for c in ("first", "late", "last")] == [0, 1, 2]
    assert got[1, "first"]["error"] == "$: not of type object" or not got[1, "first"]["valid"]
    assert got[1, "first"]["n_results"] == 2 and '"result":"answer"' in got[1, "first"]["canonical"]
    assert got[1, "first"]["canonical"] == '{"arguments":{"a":2,"b":["é"]},"id":"first","name":"add","result":"answer"}'
    assert [got[2, c]["position"] for c in "xyz"] == [None] * 3 and got[2, "x"]["error"] == "cycle" and got[2, "free"]["position"] == 0
    assert got[2, "free"]["error"] == "unknown tool" and got[3, "p"]["error"] == "not JSON" and got[3, "q"]["error"] == "$.a: out of range"
    assert got[None, "p"]["error"] == "not JSON" and got[None, "p"]["n_results"] == 1
    assert got[1, "ghost"]["error"] == "orphan result" and got[1, "ghost"]["turn"] == 8
    assert toolcalls.link(calls.limit(0), results.limit(0), SCHEMAS).count() == 0


def test_order_is_the_same_on_tables(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(c, 100 - i, f"k{i}", "add", '{"a": 1}', [f"k{j}" for j in rng.sample(range(i), min(i, 2))]) for c in range(3) for i in range(12)]
    rows += [(9, 1, "a", "add", "{}", ["b"]), (9, 2, "b", "add", "{}", ["a"]), (9, 3, "c", "add", "{}", [])]
    calls, results = spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS)
    position = lambda: {(r["conv_id"], r["call_id"]): r["position"] for r in toolcalls.link(calls, results, SCHEMAS).collect()}
    small = position()
    monkeypatch.setattr(toolcalls, "KAHN_CALLS", 0)
    monkeypatch.setattr(toolcalls, "RANGE", 3)
    assert position() == small
    for c, _, k, _, _, needs in rows[:36]:
        assert all(small[c, n] < small[c, k] for n in needs)


def test_order_with_nulls_is_the_same_on_tables(spark, monkeypatch):
    rows = [(c, 10 - i, f"k{i}", "add", '{"a": 1}', [f"k{j}" for j in range(i)]) for c in (1, None) for i in range(5)]
    rows += [(c, 20, None, "add", '{"a": 1}', needs) for c in (1, None) for needs in (["k4"], [None], None)]
    rows += [(None, 21, "x", "add", '{"a": 1}', ["y"]), (None, 22, "y", "add", '{"a": 1}', ["x"])]
    calls, results = spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS)
    linked = lambda: sorted(map(repr, toolcalls.link(calls, results, SCHEMAS).select("conv_id", "call_id", "position", "valid", "error").collect()))
    small = linked()
    assert sum("error='cycle'" in r for r in small) == 2 and len(small) == 18
    monkeypatch.setattr(toolcalls, "KAHN_CALLS", 0)
    assert linked() == small


@pytest.mark.parametrize(("text", "wrong"), [('{"a": 1e400}', "not JSON"), ('{"a": "\\ud800"}', "not JSON"), ('{"a": "\\ud83d\\ude00"}', None), ("[" * 101 + "]" * 101, "nested too deep"), ("[" * 100 + "]" * 100, None), ("[" * 200_000, "nested too deep"), ('{"a": NaN}', "not JSON"), ('{"a": ' + "1" * 5000 + "}", "not JSON")])
def test_odd_arguments(text, wrong):
    value, error = toolcalls.parsed(text)
    assert error == wrong and (toolcalls.canonical(value).encode() if error is None else value is None)


def test_odd_arguments_are_errors_not_failures(spark):
    texts = ['{"a": 1e400}', '{"a": "\\ud800"}', "[" * 3000 + "]" * 3000]
    calls = spark.createDataFrame([(1, i, f"c{i}", "add", t, []) for i, t in enumerate(texts)], CALLS)
    rows = toolcalls.link(calls, spark.createDataFrame([], RESULTS), SCHEMAS).collect()
    assert sorted(r["error"] for r in rows) == ["nested too deep", "not JSON", "not JSON"] and not any(r["valid"] for r in rows)


def test_needs_that_turns_do_not_order(spark, monkeypatch):
    """The query on a large conversation, in many ranges and by rounds, has SQL's order and cycles."""
    n = 600
    rows = [(c, i, ("user", "assistant")[i % 2], f"t{i}") for c in (1, 2) for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(toolcalls, "RANGE", 7)
    got = lambda: toolcalls.link(*toolcalls.turns_as_calls(df), toolcalls.TURN_SCHEMAS)
    against(got(), toolcalls.ORACLE_SQL, conversations=df)
    found = [r["error"] for r in got().collect()]
    assert 0 < found.count("cycle") < n / 4
    monkeypatch.setattr(toolcalls, "KAHN_CALLS", 10)
    against(got(), toolcalls.ORACLE_SQL, conversations=df)


def test_calls_written_in_messages(spark):
    text = '{"tool_calls": [{"id": "i", "name": "add", "arguments": "{\\"a\\": 1}"}]}'
    m = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", text), (1, 2, "tool", '{"tool_call_id": "i", "content": "2"}'), (1, 3, "assistant", "plain")], "conv_id long, turn long, role string, text string")
    row = toolcalls.link(*toolcalls.calls_in_messages(m), SCHEMAS).collect()
    assert [(r["call_id"], r["valid"], r["n_results"]) for r in row] == [("i", True, 1)]


def test_odd_conversations(spark):
    rows = [(1, 0, "assistant", "first"), (1, 1, "user", None), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (None, 0, "user", "q"), (2, None, "user", "x"), (2, 1, None, "y"), (2, 2, "tool", None), (3, 5000, "system", "s\n\"q\"")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS range", "2 AS prior", "3 AS needs")
    got = toolcalls.link(*toolcalls.turns_as_calls(df), toolcalls.TURN_SCHEMAS).collect()
    assert sorted((r["tool"] or "-", r["n_results"], r["error"] or "") for r in got) == [("-", 1, "orphan result"), ("answer", 0, "no result"), ("answer", 0, "no result"), ("answer", 2, "$.prompt: too short"), ("configure", 0, "no result")]


def test_types_may_be_lists_and_unknown_keywords_are_refused(spark):
    schema = {"type": ["object", "null"], "properties": {"n": {"type": ["integer", "string"], "minimum": 2}}}
    assert toolcalls.fault(None, schema) is None and toolcalls.fault({"n": "x"}, schema) is None and toolcalls.fault({"n": 2}, schema) is None
    assert toolcalls.fault({"n": 1}, schema) == "$.n: out of range" and toolcalls.fault({"n": True}, schema) == "$.n: not of type integer or string" and toolcalls.fault([], schema) == "$: not of type object or null"
    calls = spark.createDataFrame([(1, 1, "a", "t", "{}", [])], CALLS)
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    for wrong in ({"oneOf": []}, {"properties": {"x": {"pattern": "a"}}}, {"items": {"type": "int"}}, {"additionalProperties": {}}):
        with pytest.raises(ValueError, match="not supported"):
            toolcalls.link(calls, results, {"t": wrong})


def test_written_calls_join_the_turns(spark):
    rows = [(1, 1, "user", "add up"), (1, 2, "assistant", '{"tool_calls": [{"id": "c1", "name": "sum", "arguments": "{\\"n\\": 1}", "needs": []}]}'), (1, 3, "tool", '{"tool_call_id": "c1", "content": "1"}'), (1, 4, "assistant", "done")]
    got = toolcalls.link(*toolcalls.every_call(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), {**toolcalls.TURN_SCHEMAS, "sum": {"type": "object"}}).collect()
    assert sorted((r["tool"], r["call_id"], r["n_results"], r["error"]) for r in got) == [("answer", "1:1", 2, None), ("sum", "c1", 1, None)]
