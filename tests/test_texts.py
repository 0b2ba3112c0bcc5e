"""Text functions, parsers and clean-up on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import code as CD, messages as M, replies as RP, text as X
from tallyloom.operators import coverage as CV, failures as FA, specs as SP, structure as ST


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "reply, score, parsed",
    [
        ("SCORE: 5", 5, True),
        ("**SCORE:** 4/6\nfine", 4, True),
        ("SEMANTIC: 5\nSTRUCTURAL: 4\nSYNTACTIC: 6\nCOHERENCE: 3", 4, True),  # 4.5 goes to the even 4
        ("SEMANTIC: 2\nOVERALL SCORE: 6", 6, True),
        ("SCORE: 1\nSCORE: 3", 3, True),
        ("rated 5 out of 6", 5, True),
        ("SCORE: <0-6>", 0, False),
        ("it scores 4 here", 4, False),
        ("", 0, False),
    ],
)
def test_reply_scores(spark, reply, score, parsed):
    scrub = RP.scrubbed(F.col("r"))
    clean = RP.without_placeholders(scrub)
    assert one(spark, RP.score(clean), r=reply) == score
    assert one(spark, RP.is_parsed(scrub), r=reply) is parsed


def test_explanations(spark):
    def said(reply):
        scrub = RP.scrubbed(F.col("r"))
        clean = RP.without_placeholders(scrub)
        return one(spark, RP.explanation(scrub, clean, RP.score(clean)), r=reply)

    assert said("EXPLANATION: good  arrows\nSCORE: 5") == "good arrows"
    assert said("SCORE: 5\nEXPLANATION: tidy") == "tidy"
    assert said("SCORE: 5") is None


@pytest.mark.parametrize(
    "code, language",
    [
        ("#include <a.h>\nint x;", "c"), ("#include <a.h>\nstd::string s;", "cpp"), ("public class A { }", "java"),
        ("def f(x):\n    return x", "python"), ("package main\nfunc (a *T) F() {}", "go"),
        ("const x = (a) => a; let t: T", "typescript"), ("function f() {}", "javascript"), ("plain words", "unknown"),
    ],
)
def test_languages(spark, code, language):
    assert one(spark, CD.language(F.col("c")), c=code) == language


@pytest.mark.parametrize(
    "code, kind",
    [
        ("@startuml\nactor U\n@enduml", "usecase"), ('object "a" as b', "object"), ("package P {\n class A\n}", "package"),
        ("[A] as B", "component"), ("[*] --> S", "state"), ("node N", "deployment"), ("participant A", "sequence"),
        ("start\n:go;\nstop", "flowchart"), ("class A", "class"), ("hello", "unknown"),
    ],
)
def test_inferred_types(spark, code, kind):
    assert one(spark, ST.inferred_type(F.col("c")), c=code) == kind


def test_fingerprint_ignores_indentation(spark):
    a = one(spark, X.line_fingerprint(F.col("c")), c="class A\n  x\n\n")
    assert a == one(spark, X.line_fingerprint(F.col("c")), c="  class A\nx")


def test_strip_takes_all_whitespace(spark):
    assert one(spark, X.strip(F.col("c")), c="\n\t a b \r\n") == "a b"


def test_failure_labels(spark):
    def labels(code, said="", broken=False):
        return one(spark, FA.failure_labels(F.col("c"), F.col("m"), F.lit(broken)), c=code, m=said)

    assert labels("@startuml\n@enduml") == ["empty_or_incomplete", "missing_package_block"]
    assert labels("@startuml\npackage core {\n class A\n@enduml") == ["unbalanced_braces"]
    assert labels("package p {\n class A\n}\ncore ..> core") == ["self_dependency"]
    assert labels("class Alpha\nclass Beta") == ["missing_package_block", "wrong_diagram_type"]
    assert labels("package p {\n class A\n}", "odd arrow") == ["invalid_syntax_other"]
    assert labels("package p {\n class A\n}") == ["unknown"]
    assert labels("package p {\n class A\n}", broken=True) == ["render_engine_error"]


def cleaned(spark, code, **kw):
    df = spark.createDataFrame([(1, code)], "artifact_id long, plantuml_code string")
    lines = ST.cleaned(df, **kw).first().plantuml_code.split("\n")
    return [x for x in lines if not x.startswith("skinparam")]


def test_clean_up(spark):
    code = (
        "@startuml\n!include x\nskinparam a b\nclass A;\nclass A;\nA --inheritance--> B;\nclass B #Red {\n  +run();\n}\nclass C {\n}\n@enduml"
    )
    assert cleaned(spark, code) == [
        "@startuml", "class A", "A --|> B", "class B {", "  +run()", "}", "class C {", "}", "@enduml",
    ]


def test_clean_up_balances_braces(spark):
    assert cleaned(spark, "@startuml\npackage P {\nclass A\n@enduml")[-3:] == ["class A", "}", "@enduml"]
    assert cleaned(spark, "@startuml\nclass A {\n}\n}\n@enduml") == ["@startuml", "class A {", "}", "@enduml"]


def test_clean_up_cuts_runaway_output_only_when_asked(spark):
    code = "@startuml\n" + "\n".join(f"class A{i}" for i in range(300)) + "\n@enduml"
    cut = cleaned(spark, code, max_lines=180)
    assert len(cut) == 181 and cut[-1] == "@enduml"
    assert len(cleaned(spark, code)) == 302


def test_concepts_of_requirements(spark):
    def names(text):
        return one(spark, CV.concepts(F.col("t")), t=text)

    assert names("Classes Book, Member, and Librarian. A Member borrows a Book through a Loan.")[:3] == ["Book", "Member", "Librarian"]
    assert {"Patient", "Doctor", "Room"} <= set(names("Scheduling for patients, doctors and clinic rooms."))
    assert "Cart" in names("An online shop with a shopping cart")
    assert names("patient Alice (Patient)")[0] == "Patient"


def test_stated_relations(spark):
    rows = one(spark, CV.stated_relations(F.col("t")), t="Member borrows a Book through a Loan. Doctor manages Patients. Nurse inherits from Doctor.")
    assert [(r.source, r.target, r.type) for r in rows] == [
        ("Member", "Loan", "association"), ("Loan", "Book", "association"), ("Doctor", "Patient", "association"), ("Nurse", "Doctor", "inheritance"),
    ]


def test_repairs(spark):
    assert one(spark, CV.close_braces(F.col("c")), c="@startuml\npackage P {\n@enduml").count("}") == 1
    added = one(spark, CV.inject_missing(F.col("c"), F.array(F.lit("Loan")), F.lit("object")), c="@startuml\n@enduml")
    assert "object Loan1 : Loan" in added
    text = "@startuml\nclass A {\n  x\n}\nclass Ghost {\n  y\n}\nGhost --> A\n@enduml"
    df = spark.createDataFrame([(text, ["A"])], "plantuml_code string, expected array<string>")
    assert CV.strip_extra(df, "out").first().out == "@startuml\nclass A {\n  x\n}\n@enduml"


def test_spec_parsing(spark):
    def spec(text):
        df = SP.parsed(spark.createDataFrame([(text,)], "t string"), "t")
        row = df.select("spec", SP.messages(F.col("spec"), F.lit("class")).alias("m")).first()
        return row.spec, row.m

    good, said = spec('Sure:\n{"diagram_type": "class", "entities": [{"name": "A"}], "relationships": [{"source": "A", "target": "A"}]} done')
    assert good.entities[0].name == "A" and said == []
    assert spec("no json")[1] == ["Specification is not a JSON object"]
    assert "relationships must be a list" in spec('{"diagram_type": "class", "entities": [{"name": "A"}]}')[1]


@pytest.mark.parametrize(
    "message, has, intent",
    [
        ("", False, "chat"), ("What is a class?", False, "chat"), ("Please generate a class diagram", False, "generate"),
        ("fix the arrow", True, "correct"), ("a shop with carts", False, "chat"), ("customers have carts", True, "correct"),
    ],
)
def test_intents(spark, message, has, intent):
    assert one(spark, M.intent(F.col("m"), F.lit(has)), m=message) == intent
