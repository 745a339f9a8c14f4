import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import duckdb
from oracle import same

from vivaspark.llm import line_templates as lt


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert same(lt.op9_line_templates(spark, sf), lt.ORACLE_SQL, sf) == 1000


def test_defined_cases(spark):
    boiler = "this line stands in many documents word for word"
    rows = [
        (1, f"own one\n{boiler}\nend 1"),
        (2, f"{boiler}\nown two"),
        (2, f"{boiler}\nown two"),
        (3, f"  {boiler.upper()} "),
        (4, "order 17 was sent to you on day 12 of may"),
        (5, "order 99 was sent to you on day 31 of may"),
        (6, None),
        (7, ""),
        (None, boiler),
        (8, "}\n}\n17 18 19 20"),
        (9, "}\n17 18 19 21"),
    ]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_lines int, place string")
    out = lt.drop_recurring_lines(docs)
    assert out.columns == ["doc_id", "text", "place", "n_lines", "n_dropped"]
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()]
    assert len(got) == len(rows)
    by = {g[0]: g for g in got}
    assert by[1] == (1, rows[0][1], 3, 0)
    assert by[2] == (2, "own two", 2, 1) and got.count(by[2]) == 2
    assert by[3][1:] == ("", 1, 1) and by[None][1:] == ("", 1, 1)
    assert by[4][3] == 0 and by[5][1:] == ("", 1, 1)
    assert by[6][1:] == (None, 0, 0) and by[7][1:] == ("", 1, 0)
    assert by[8][3] == by[9][3] == 0
    assert lt.drop_recurring_lines(docs.limit(0)).count() == 0


def test_blanks_other_than_spaces_part_tokens(spark, tmp_path):
    head = "Name\tAge\tCity\tCountry\tPhone\tMail\tJob\tPay"
    texts = [f"own {i} here\n{head}\n{head.replace(chr(9), b)}\n\tone\ttwo\t\nRead{b}more\n{b}a{b}b{b}c{b}" for i, b in enumerate("\t\x0b\f\r ")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(lt.ORACLE_SQL).fetchall())
    got = sorted(map(tuple, lt.op9_line_templates(spark, str(tmp_path)).collect()))
    assert got == want and [r[3] for r in got] == [0, 3, 3, 3, 3]


def test_lines_that_differ_in_a_word_meet_in_one_template(spark, tmp_path):
    """The path alone would not do: the lines are all different, and no word holds a digit."""
    names = ["anna", "bert", "carla", "dirk", "eva", "frank"]
    log = [f"the system logged a new session for user {n} in the main office" for n in names]
    long = [f"all rights to this text and to the pictures in it stay with {n} unless the editors agree in writing to other terms" for n in names[:2]]
    lead = [f"{n} {n} logged a new session in the main office this morning" for n in names]
    far = ["one two three four five six seven eight", "one two three four nine ten seven twelve"]
    texts = [f"{a}\n{c}\nown {i}" for i, (a, c) in enumerate(zip(log, lead))] + long + far + [log[0]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(lt.ORACLE_SQL).fetchall())
    got = sorted(map(tuple, lt.op9_line_templates(spark, str(tmp_path)).collect()))
    assert got == want
    # A field among the leading tokens parts the lines, as it does in every tree that routes by them.
    assert [r[3] for r in got] == [0, 1, 1, 1, 1, 1, 0, 1, 0, 0, 1]


def test_very_long_line_and_text(spark):
    long = "x1" * 200_000 + " a b"
    many = "\n".join(f"line {k % 50} of a text of very many lines" for k in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, long), (3, many), (4, "tail " + "y" * 300_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in lt.drop_recurring_lines(docs).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (60_000, 0), 4: (1, 0)}


def test_columns_of_any_name_and_a_text_of_a_million_lines(spark):
    boiler = "this line stands in many documents word for word"
    rows = [(i, f"own {i}\n{boiler}\nend {i}") for i in range(3)] + [(7, "\n".join(f"a line of its own {i}" if i % 2 else boiler for i in range(1_000_000)))]
    names = ["_id", "_key", "_drop", "h1", "_text", "_c0", "place", "_lines", "a.b"]
    docs = spark.createDataFrame([(*r, *[r[0] * 10 + k for k in range(len(names))]) for r in rows], ["doc_id", "text", *names])
    out = lt.drop_recurring_lines(docs)
    assert out.columns == ["doc_id", "text", *names, "n_lines", "n_dropped"]
    got = {r.doc_id: r for r in out.collect()}
    assert all([r[n] for n in names] == [i * 10 + k for k in range(len(names))] for i, r in got.items())
    assert got[0].text == rows[0][1] and got[2].text == "own 2\nend 2"
    assert got[7].n_lines == 1_000_000 and got[7].n_dropped == 500_000 and got[7].text.count("\n") == 499_999 and boiler not in got[7].text
