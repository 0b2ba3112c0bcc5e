"""Long texts of one row: each pattern and each list is worked through once."""

import time

from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import codefacts as CF, structure as ST, synth as SY
from tallyloom.plans import load
from tallyloom.plans.catalog import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _one(spark, value, kind="string"):
    return spark.createDataFrame([(1, value)], f"artifact_id long, v {kind}")


def test_functions_without_semicolons(spark):
    text = "int open(int a) {" + " call f(x) and" * 40000
    start = time.time()
    row = _one(spark, text).select(CF.braced_functions(F.col("v")).alias("b"), CF.c_functions(F.col("v")).alias("c")).first()
    assert (row.b, row.c) == (["open"], ["open"])
    assert time.time() - start < 15


def test_functions_as_one_pattern_finds_them(spark):
    braced = r"\b(?:public|private|protected)?\s*(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\([^;]*\)\s*\{"
    plain = r"(?md)^(?:static\s+)?(?:const\s+)?(?:struct\s+)?([\w\s*]+?)\s+(\w+)\s*\([^;]*\)\s*(?:\{|;)"
    texts = [
        "", ";", "int a(void);\nint b(int x) { return x; } int c() {}\n", "void f(A* s) { }\nvoid g(A* s) { }\nint h(", ";int k(x);\nint l(y) ;",
        "public static int m(int[] q) { if (q) { n(q); } }\nList<A> o() {\n}", "typedef struct A {\n int id;\n} A;void A_load(A* self) { }\nvoid B_load(B* b) { }",
        "int p(a)\n{ q(b) ; r s(c) { t u(d); } }", "x y(z) { a b(c) ; d e(f) \n ; g h(i) } j k(l) {",
    ]
    rows = spark.createDataFrame([(x,) for x in texts], "v string")
    for r in rows.select(
        CF.braced_functions(F.col("v")).alias("b"), F.regexp_extract_all("v", F.lit(braced), F.lit(1)).alias("b0"),
        CF.c_functions(F.col("v")).alias("c"), F.regexp_extract_all("v", F.lit(plain), F.lit(2)).alias("c0"),
    ).collect():
        assert (r.b, r.c) == (r.b0, r.c0)


def test_names_of_a_diagram_are_filled_up_once(spark):
    names = [f"Name{i}" for i in range(3000)]
    rows = spark.createDataFrame([(names, [(n, [names[i - 1]]) for i, n in enumerate(names) if i])], "n array<string>, b array<struct<owner:string,parents:array<string>>>")
    start = time.time()
    code = rows.select(SY.complete_diagram(F.col("n"), F.lit("class"), bases=F.col("b")).alias("c")).first().c
    assert code.count(" <|-- ") == 2999 and code.count("class Name") == 3000
    assert time.time() - start < 15


def test_block_is_searched_once(spark):
    texts = [
        None, "", "a", "@startuml\na\n@enduml tail", "x @STARTUML\nb\n@EndUml y @startuml c @enduml", "@enduml @startuml z", "İ@startuml\nİ\n@enduml İ", "```plantuml\n@startuml\n@enduml\n```",
        "```\nclass A\n```", "a ``` b", "```  ", "ß\U0001f600 @startuml \U0001f600 @enduml é", "@startuml@startuml@enduml@enduml",
    ]
    rows = spark.createDataFrame([(x,) for x in texts], "v string")
    s = F.regexp_replace(X.strip(F.coalesce("v", F.lit(""))), r"(?i)^```(?:plantuml)?\s*", "")
    s = F.regexp_replace(s, r"\s*```$", "")
    s = F.when(~X.has_open_tag(s), F.concat(F.lit("@startuml\n"), s, F.lit("\n@enduml"))).when(~X.has_close_tag(s), F.concat(s, F.lit("\n@enduml"))).otherwise(s)
    found = F.regexp_extract(s, X.BLOCK, 1)
    out = rows.select(X.bounded_block(F.col("v")).alias("now"), F.when(found != "", found).otherwise(s).alias("was"))
    for r in out.collect():
        assert r.now == r.was
    assert _plan(rows.select(X.bounded_block(F.col("v")).alias("x"))).count(".*?@enduml") == 1


def test_signs_of_a_flowchart_are_looked_for_once(spark):
    plan = _plan(_one(spark, "start").select(ST.flowchart_messages(F.col("v")).alias("x")))
    assert plan.count("@startuml|@enduml") == 1 and plan.count("(stop|end)") == 1


def test_cleaning_sorts_without_a_lambda(spark):
    plan = _plan(ST.cleaned(_one(spark, "x").withColumnRenamed("v", "plantuml_code")))
    assert "array_sort" not in plan and "sort_array" in plan


def test_edges_between_known_names_only(spark):
    code = "A --> B\nB --> C\nC --> D\nnote\nA ..> X"
    rows = spark.createDataFrame([(1, code, ["A", "B", "C"])], "artifact_id long, plantuml_code string, names array<string>")
    assert [(e.src, e.dst) for e in ST.with_edges(rows, "names").first().edges] == [("A", "B"), ("B", "C")]
    assert "map_from_arrays" not in _plan(ST.with_edges(rows, "names"))


def _documents(spark, folder):
    rows = [(i, "en", f"alphabet numbered{'x' * i} document", "web") for i in range(1, 30)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_resolved_types_read_the_texts_once(spark, tmp_path):
    load()
    df = QUERIES["b14_resolve_type"](spark, _documents(spark, tmp_path))
    assert "parquet" not in _plan(df)
    assert {r["mode"] for r in df.collect()} == {"allow", "forced", "free"}


def test_exports_join_once(spark, tmp_path, monkeypatch):
    load()
    from tallyloom.sources import sinks

    plans, write = [], sinks.export_dataset
    monkeypatch.setattr(sinks, "export_dataset", lambda df, path, fmt="jsonl": plans.append(_plan(df)) or write(df, path, fmt))
    rows = QUERIES["a11_export"](spark, _documents(spark, tmp_path)).collect()
    assert {(r["format"], r["n"], r["texts"]) for r in rows} == {(f, 29, 29) for f in ("jsonl", "csv", "parquet", "xml")}
    assert sum("Join" in p for p in plans) == 1 and len(plans) == 4


def odd_texts(n=400):
    import random

    pick = random.Random(11)
    parts = [
        "@startuml", "@enduml", "@StartUML", "@EndUml", "@end", "uml", "start", "@", "\n", "\n", "\n", " ", "\t", "\r", "title a", "skinparam x", "Title", "hide all",
        "!theme b", "left to right direction", "class A", "abcdefg", "abcdefgh", "a b c d e f", "{", "}", "```", "```plantuml\n", "é", "İ", "K", "-->", "x",
    ]
    return ["".join(pick.choice(parts) for _ in range(pick.randint(0, 14))) for _ in range(n)] + ["@startuml\n" + "".join(pick.choice(parts[8:]) for _ in range(6)) + "\n@enduml" for _ in range(n)]


def test_blocks_and_tags_are_those_of_the_patterns(spark):
    df = spark.createDataFrame([(t,) for t in odd_texts()], "t string")
    s = F.col("t")
    bare = F.regexp_replace(s, r"(?i)@startuml|@enduml", "")
    block = F.regexp_extract(s, X.BLOCK, 1)
    told = df.select("t", bare.alias("bare"), X.without_tags(s).alias("bare2"), F.when(block != "", block).otherwise(s).alias("block"), X._first_block(s).alias("block2"),
                     X.strip(s).alias("strip"), X.trimmed(s).alias("strip2"), F.contains(F.lower(s), F.lit("@enduml")).alias("close"), X.has_close_tag(s).alias("close2"))
    rows = told.collect()
    assert sum(r["t"].count("@") == 2 and r["t"].startswith("@startuml") and r["t"].endswith("@enduml") for r in rows) > 100
    for r in rows:
        assert (r["bare"], r["block"], r["strip"], r["close"]) == (r["bare2"], r["block2"], r["strip2"], r["close2"]), r["t"]


def test_bodies_are_short_where_the_patterns_leave_little(spark):
    df = spark.createDataFrame([(t,) for t in odd_texts()], "t string")
    body = F.regexp_replace("t", r"(?imd)@startuml|@enduml|^\s*title\b[^\n]*$|^\s*skinparam\b[^\n]*$", "")
    body = F.regexp_replace(body, r"(?md)^\s*(left to right direction|hide\b.*|!theme\b.*)$", "")
    said = F.array_contains(ST.syntax_messages(F.col("t")), "Diagram body is empty or incomplete")
    rows = df.select("t", (F.length(X.strip(body)) < 8).alias("short"), said.alias("said"), F.rlike("t", F.lit(ST.BODY_LINE)).alias("told")).collect()
    assert sum(r["told"] for r in rows) > 100 and sum(r["short"] for r in rows) > 50
    for r in rows:
        assert r["short"] == r["said"], r["t"]


def test_stems_lose_role_words_before_a_line_break_too(spark):
    words = ["cartservices", "CartService", "itemapi", "api", "storestores", "cartservice\n", "cartapi ", "modules\r\n", "Orders", "", "cartpackages", "bigitem"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    low = F.lower("w")
    cut = F.regexp_replace(low, r"(service|api|store|repository|module|package|item)s?$", "")
    for r in df.select("w", F.when(F.length(cut) >= 5, cut).otherwise(low).alias("want"), X.stem(F.col("w")).alias("got")).collect():
        assert r["want"] == r["got"], r["w"]
