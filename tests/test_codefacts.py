"""Facts of source texts, case by case."""

from pyspark.sql import functions as F

from tallyloom.operators import codefacts as CF


def facts(spark, code):
    row = CF.with_structure(spark.createDataFrame([(1, code)], "artifact_id long, code string")).first()
    return row, [(m["owner"], m["name"]) for m in row["methods"]], {b["owner"]: b["parents"] for b in row["bases"]}


def test_python_types_keep_their_methods_until_the_margin(spark):
    code = (
        "import os\nclass Shop(Base, object):\n    limit = 3\n    @cached\n    def open(self):\n        def inner():\n            pass\n"
        "# still the shop\n    def close(self):\n        pass\n@decorated\n    def late(self):\n        pass\ntotal = 1\n    def lost(self):\n        pass\n"
        "class Shop(Other):\n    def open(self):\n        pass\n"
    )
    row, methods, bases = facts(spark, code)
    assert row["language"] == "python" and row["types"] == ["Shop"]
    assert methods == [("Shop", x) for x in ("open", "close", "late", "open")]
    assert bases == {"Shop": ["Other"]}
    assert row["functions"] == ["open", "inner", "close", "late", "lost"]
    assert row["imports"] == ["import os"] and row["variables"] == ["limit", "total"]


def test_c_functions_find_the_first_type_they_are_named_after(spark):
    code = (
        "#include <stdio.h>\ntypedef struct node {\n int id;\n} Node;\nstruct Node_List {\n int n;\n};\n"
        "static int node_list_add(int n);\nvoid node(int a) { }\nint nodes_all(void);\nint main(void) {\n  while (1) {\n  }\n}\n"
    )
    row, methods, _ = facts(spark, code)
    assert row["language"] == "c" and row["types"] == ["Node", "Node_List"]
    assert ("Node", "node_list_add") in methods and ("Node", "node") in methods
    assert not any(name in ("nodes_all", "main") for _, name in methods)


def test_braced_functions_and_lists_of_their_own(spark):
    code = "public class Depot extends Place implements Open, Shut {\n  static List<String> names(int a) {\n  int x;  }\n  void main(int b) {\n  int y;  }\n  else catch (int e) {\n  }\n}\n"
    row, _, bases = facts(spark, code)
    assert row["language"] == "java" and bases == {"Depot": ["Place", "Open", "Shut"]}
    assert row["functions"] == ["names", "main"] and "catch" not in row["functions"]


def test_steps_variables_and_the_text_of_a_script(spark):
    code = '# Read numbers\nfrom sys import argv\nleft = 1\nprint(f"Adding {left}:")\nprint("Success")\n'
    df = spark.createDataFrame([(1, code), (2, None), (3, "")], "artifact_id long, code string")
    rows = {r["artifact_id"]: r["spec"] for r in CF.spec_text(df).collect()}
    assert "1. Import dependencies\n2. Configure paths / parameters\n3. Report success\n4. Read numbers\n5. Adding <value>\n6. Success" in rows[1]
    assert "- left: configuration / local binding" in rows[1] and "Do NOT invent classes" in rows[1]
    assert rows[2] == rows[3] and "1. Initialize\n2. Run script logic\n3. Finish" in rows[2]
    short = CF.spec_text(df.where("artifact_id = 1"), F.lit("flowchart"), steps=2).first()["spec"]
    assert "2. Configure paths" in short and "3." not in short
