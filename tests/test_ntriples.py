import pytest

from kinweave.sources import ntriples, rdf

GOOD = [
    r'<http://e.org/a> <http://e.org/p> "plain" .',
    r'<http://e.org/a> <http://e.org/p> "tab\tline\nquote\"back\\slashé\U0001F600" .',
    r'_:b1 <http://e.org/p> "Zürich"@de-CH .',
    r'<http://e.org/a><http://e.org/q>"5"^^<http://www.w3.org/2001/XMLSchema#integer>.',
    r"<http://e.org/a> <http://e.org/q> _:b1 .",
    r"  <http://e.org/a>	<http://e.org/q>  <http://e.org/b> . # a comment",
    r'<http://e.org/a> <http://e.org/p> "" .',
    r'<http://e.org/a> <http://e.org/p> "x" . # "quoted" .',
    r'<http://e.org/a> <http://e.org/p> "open \" . # not a comment" .',
]
BAD = [
    r'<http://e.org/a> <http://e.org/p> "no dot"',
    r'<http://e.org/a> <http://e.org/p> "bad \x escape" .',
    r'<http://e.org/a> <http://e.org/p> "half \uD83D pair" .',
    r'<http://e.org/a> <http://e.org/p> "beyond \U00110000" .',
    r'<http://e.org/a> "p" "o" .',
    r'<http://e.org/a> _:p "o" .',
    r'"s" <http://e.org/p> "o" .',
    r"<http://e.org/a> <http://e.org/p> .",
    r"<http://e.org/a b> <http://e.org/p> <http://e.org/c> .",
    r'<http://e.org/a> <http://e.org/p> "one" "two" .',
]


def test_good_lines_and_bad_ones(spark):
    rows = [(i, line) for i, line in enumerate(GOOD + BAD)]
    found = {r.request_key: r for r in ntriples.triples(spark.createDataFrame(rows, "request_key long, content string")).collect()}
    assert [k for k, r in sorted(found.items()) if r.error] == list(range(len(GOOD), len(rows)))
    values = [found[i].o for i in range(len(GOOD))]
    assert values[:4] == ["plain", 'tab\tline\nquote"back\\slashé😀', "Zürich", "5"]
    assert values[4:] == ["_:b1", "http://e.org/b", "", "x", 'open " . # not a comment']
    assert [found[i].o_kind for i in (3, 4, 5)] == [rdf.LITERAL, rdf.BLANK, rdf.IRI]
    assert found[2].s == "_:b1" and all(r.s is None and r.o is None for r in found.values() if r.error)


def test_lines_of_a_payload(spark):
    content = f"# head\r\n\r\n{GOOD[0]}\n\n{BAD[0]}\r  \n{GOOD[5]}"
    rows = [(1, content), (2, None), (3, ""), (4, "# only this")]
    found = ntriples.triples(spark.createDataFrame(rows, "request_key long, content string")).orderBy("line").collect()
    assert [(r.request_key, r.line, r.error) for r in found] == [(1, 3, None), (1, 5, "Line 5 is not valid N-Triples"), (1, 7, None)]


@pytest.mark.parametrize("text", ["", "a\\b", 'say "x"\r\nand\ty', "é 😀 \\u0041 \\n", "\\" * 7 + '"', "x" * 200_000 + "\\\n" * 20_000])
def test_escaping_comes_back(spark, text):
    frame = spark.createDataFrame([(1, text)], "request_key long, t string")
    line = frame.selectExpr("request_key", "t").withColumn("content", ntriples.escaped(frame["t"]))
    line = line.selectExpr("request_key", """concat('<u:s> <u:p> "', content, '" .') AS content""")
    assert [r.o for r in ntriples.triples(line).collect()] == [text]


def test_the_turtle_reader_agrees(spark):
    rows = [(i, line) for i, line in enumerate(GOOD) if "_:" not in line]
    frame = spark.createDataFrame(rows, "request_key long, content string")
    plain = {(r.request_key, r.s, r.p, r.o) for r in ntriples.triples(frame).collect()}
    assert plain == {(r.request_key, r.s, r.p, r.o) for r in rdf.triples(frame).collect()}
