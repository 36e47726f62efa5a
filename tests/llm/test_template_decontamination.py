import pytest
from pyspark.sql import functions as F

from sheaf.llm import template_decontamination as td

ITEM = ("Yesterday Tom bought 12 red apples at the market for 3 dollars each. Later that same day he gave 5 apples to his "
        "friend Anna and ate 2 of the others. How many apples does Tom have left now?")
PLAIN = "The quick red fox jumps over a lazy dog. Then it runs far away from the old farm. Nobody saw where it went."
FILL = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x" for i in range(300))


@pytest.fixture
def bench(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def test_verbatim_and_reparameterised_are_caught_inconsistent_and_clean_are_not(docs, bench):
    other = ITEM.replace("Tom", "Peter").replace("Anna", "Maria").replace("12", "30").replace("5", "9").replace("dollars", "euros")
    mixed = ITEM.replace("Tom have", "Carl have")
    rows = [(1, FILL), (2, FILL + ". " + ITEM + " " + FILL), (3, other), (4, mixed), (5, ITEM.upper()), (6, ITEM.replace(",", "")),
            (7, " ".join(ITEM.split()[4:24])), (8, "Tom bought 12 apples"), (9, None), (10, ""), (11, ITEM.title()), (12, FILL + " " + ITEM.lower().replace(".", ""))]
    got = {r.doc_id: r for r in td.matches(docs(rows), bench([(77, ITEM), (78, "Too short"), (79, None)])).collect()}
    assert set(got) == {2, 3, 5, 6, 7, 11} | ({4, 12} & set(got))
    assert got[2].verbatim and not got[3].verbatim and got[2].matched_tokens == got[2].item_tokens == got[3].matched_tokens
    assert got[3].slots == 8 and {r.item_id for r in got.values()} == {77}
    plain = td.matches(docs([(1, ITEM.title()), (2, PLAIN.title()), (3, PLAIN.lower()), (4, PLAIN.upper().replace(".", " "))]), bench([(1, PLAIN)]))
    assert {r.doc_id for r in plain.collect()} == {2, 3, 4}
    full = [r for r in got.values() if r.doc_id == 4]
    assert not full or full[0].matched_tokens < got[2].matched_tokens


CAPITAL = "What is the capital city of the country of France?"
LEGS = "How many legs do 3 spiders and 2 ants have together?"
HAMLET = "Who wrote the play called Hamlet in London?"
BRIEF = "Name Newton's third law"


def test_short_items_are_found_whatever_stands_beside_them(docs, bench):
    rows = [(1, f"Question: {CAPITAL}"), (2, HAMLET.lower().strip("?")), (3, f"Answer this 1) {LEGS} Thanks"), (4, LEGS.upper()),
            (5, f"Please tell me {CAPITAL.lower()} and why"), (6, f"Quiz: {LEGS.replace('3 spiders', '7 cows').replace('ants', 'ants')}"),
            (7, f"Question: {LEGS.replace('3', '40').replace('2', '5')}"), (8, f"{FILL} please NAME NEWTON'S THIRD LAW, and explain it"),
            (9, "The capital city of the country of Peru is Lima."), (10, "Who wrote the book?"), (11, "Newton's second law"), (12, FILL)]
    items = bench([(1, CAPITAL), (2, LEGS), (3, HAMLET), (4, BRIEF), (5, "Why not")])
    got = {(r.doc_id, r.item_id) for r in td.matches(docs(rows + [(13, "Why not"), (14, "why not go there")]), items).collect()}
    assert got == {(1, 1), (2, 3), (3, 2), (4, 2), (5, 1), (7, 2), (8, 4)}


def test_clean_keeps_rows_and_columns(docs, bench):
    df = docs([(1, ITEM), (1, ITEM), (None, FILL), (None, FILL), (2, None)]).withColumn("__raw", F.lit(1)).withColumn("pos", F.lit(2))
    kept = td.clean(df, bench([(1, ITEM), (1, ITEM), (None, ITEM)]))
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 2]
    assert td.matches(df, bench([(1, ITEM), (1, ITEM)])).count() == 1
    assert td.clean(df, bench([])).count() == 5 and td.clean(docs([]), bench([(1, ITEM)])).count() == 0
    assert td.matches(docs([(1, FILL * 300 + ITEM)]), bench([(1, ITEM)])).count() == 1


def test_no_python_in_the_plan(docs, bench):
    plan = td.matches(docs([(1, ITEM)]), bench([(1, ITEM)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    con.execute("CREATE VIEW benchmark AS SELECT * FROM read_parquet('/root/testdata/sf0.001/benchmark.parquet') "
                "UNION ALL SELECT 900 + n, array_to_string(string_split(text, ' ')[4:3 + n], ' ') "
                "FROM (SELECT text, unnest([2, 3, 5, 7]) AS n FROM read_parquet('/root/testdata/sf0.001/documents.parquet') WHERE doc_id = 3)")
    want = con.execute(f"SELECT * FROM ({td.SQL}) ORDER BY doc_id, item_id").fetchall()
    more = spark.createDataFrame(con.execute("SELECT * FROM benchmark WHERE item_id >= 900").fetchall(), "item_id long, text string")
    read = lambda t: (lambda d: d.unionByName(more) if t == "benchmark" else d)(spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet"))
    got = td.matches(read("documents"), read("benchmark")).drop("__key").orderBy("doc_id", "item_id").collect()
    assert want and [tuple(r) for r in got] == [tuple(r) for r in want]
