"""Structured fields against a plain recursive parser."""

import random
import re

from pyspark.sql import functions as F

from headloom.functions import structured


class Bad(Exception):
    pass


class Plain:
    """RFC 9651 section 4.2, step by step."""

    def __init__(self, text):
        self.s, self.i = text.strip(" "), 0

    def peek(self):
        return self.s[self.i] if self.i < len(self.s) else ""

    def match(self, pattern):
        m = re.compile(pattern).match(self.s, self.i)
        if not m:
            raise Bad
        self.i = m.end()
        return m[0]

    def key(self):
        return self.match(r"[a-z*][a-z0-9_.*-]*")

    def bare(self):
        c = self.peek()
        if c == '"':
            self.match(r'"(?:[\x20\x21\x23-\x5B\x5D-\x7E]|\\["\\])*"')
        elif c == "?":
            self.match(r"\?[01]")
        elif c == ":":
            self.match(r":[A-Za-z0-9+/=]*:")
        elif c == "%":
            self.match(r'%"(?:[\x20\x21\x23\x24\x26-\x7E]|%[0-9a-f]{2})*"')
        elif c == "@":
            self.i += 1
            self.number(False)
        elif c.isdigit() and c.isascii() or c == "-":
            self.number(True)
        elif re.match("[A-Za-z*]", c):
            self.match(r"[A-Za-z*][!#$%&'*+.^_`|~:/0-9A-Za-z-]*")
        else:
            raise Bad

    def number(self, decimal):
        whole = self.match(r"-?[0-9]+").lstrip("-")
        if self.peek() == ".":
            if not decimal or len(whole) > 12:
                raise Bad
            if len(self.match(r"\.[0-9]*")) not in (2, 3, 4):
                raise Bad
        elif len(whole) > 15:
            raise Bad

    def params(self):
        while self.peek() == ";":
            self.i += 1
            self.match(" *")
            self.key()
            if self.peek() == "=":
                self.i += 1
                self.bare()

    def item(self, inner=True):
        if inner and self.peek() == "(":
            self.i += 1
            while True:
                self.match(" *")
                if self.peek() == ")":
                    self.i += 1
                    break
                self.bare()
                self.params()
                if self.peek() not in (" ", ")") or not self.peek():
                    raise Bad
        else:
            self.bare()
        self.params()

    def whole(self, kind):
        keys = []
        if kind == "item":
            self.item(False)
        elif self.s:
            while True:
                if kind == "dict":
                    keys.append(self.key())
                    if self.peek() == "=":
                        self.i += 1
                        self.item()
                    else:
                        self.params()
                else:
                    self.item()
                if not self.peek():
                    break
                self.match(r"[ \t]*,[ \t]*")
                if not self.peek():
                    raise Bad
        if self.i < len(self.s):
            raise Bad
        return keys


def plain(text, kind):
    try:
        return Plain(text).whole(kind)
    except Bad:
        return None


PARTS = [
    'a', 'b', 'k1', '*x', 'A', 'Tok/en', 'a:b', '"q"', '"a, b"', '"\\""', '"open', '1', '-12', '1.5', '1.2345', '1.', '123456789012345', '1234567890123456', '?1', '?2', ':aGk=:', ':no', '@12', '@1.5', '%"a%c3%a9"', '%"%C3"',
    '(', ')', '()', ',', ', ', '\t,', ';', '; ', '=', '=', '=', ' ', '  ', 'é', '\\', '-', '',
]


def generated(n):
    rng = random.Random(9)
    for _ in range(n):
        yield "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))
    items = ['a', '"x, y"', '1.5', '?0', ':aGk=:', '@5', '(a "b";p 1)', '()', '( a  b )', '%"z"']
    for _ in range(n):
        one = lambda: rng.choice(items) + "".join(rng.choice([";p", "; q=1", ';r="s;,"']) for _ in range(rng.randint(0, 2)))
        made = rng.choice([", ", ",", " ,\t"]).join((rng.choice(["k", "l", "*m"]) + rng.choice(["", "="]) if rng.random() < 0.5 else "") + one() for _ in range(rng.randint(1, 4)))
        cut = rng.randint(0, len(made))
        yield rng.choice([made, made[:cut], made[:cut] + rng.choice(PARTS) + made[cut:]])


def test_against_plain_parser(spark):
    rows = [(x, k) for x in dict.fromkeys(generated(700)) for k in ("item", "list", "dict")]
    df = spark.createDataFrame(rows, "value string, kind string").repartition(4)
    got = {(r.value, r.kind): r.p for r in df.select("value", "kind", structured.parse(F.col("value"), F.col("kind")).alias("p")).collect()}
    sound = 0
    for key in rows:
        want, p = plain(*key), got[key]
        assert (want is None) == (p.error is not None), (key, p)
        if want is not None:
            sound += 1
            assert (p.keys if key[1] == "dict" else []) == want and p.at == len(key[0].strip(" ")), (key, p)
        elif p.at < len(key[0].strip(" ")):  # no end makes what was read up to the place and the next lexeme sound
            bad = re.match(structured.LEXEME.replace("++", "+").replace("*+", "*"), key[0].strip(" ")[p.at :])[0]
            assert bad[0] in "0123456789-@ " or all(plain(key[0].strip(" ")[: p.at] + bad + end, key[1]) is None for end in ("", ")", "a", "=1", " a)", ")=1"))
    assert sound > 250


def test_messages_and_places(spark):
    cases = {
        ("dict", 'a="x",'): ("member expected", 6), ("dict", "a=1, B=2"): ("member expected", 5), ("dict", "a=,b"): ("value expected", 2), ("dict", 'a="x'): ("value expected", 2),
        ("dict", "a=(1 2"): ("blank or end of inner list expected", 6), ("dict", "a=("): ("inner list is not closed", 3), ("dict", "a=1;B"): ("parameter name expected", 4),
        ("dict", "a=1;b=,"): ("parameter value expected", 6), ("list", "a b"): ("parameter or comma expected", 1), ("list", "a,,b"): ("member expected", 2), ("item", ""): ("member expected", 0),
        ("item", "a, b"): ("parameter or comma expected", 1), ("dict", "a=(b;c=)"): ("parameter value expected", 7), ("dict", "a 1"): ("value, parameter or comma expected", 1),
        ("item", "é"): ("member expected", 0), ("dict", 'q="a, b", r=(x "y, z";p=1)'): (None, 26), ("list", ""): (None, 0), ("dict", "  a  "): (None, 1),
    }
    df = spark.createDataFrame(list(cases), "kind string, value string")
    for r in df.select("kind", "value", structured.parse(F.col("value"), F.col("kind")).alias("p")).collect():
        assert (r.p.error, r.p.at) == cases[r.kind, r.value], r


def test_long_fields(spark):
    """No pattern loops over a whole field, so none exhausts the stack."""
    values = [", ".join(f'k{i}="v, {i}"' for i in range(6000)), '"' + 'a\\"' * 30000 + '"', "(" + "a " * 20000 + ")", ";".join(["a"] + ["p=1"] * 9000), "a" * 200000, ":" + "a" * 200000]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = df.select(F.length("value").alias("n"), structured.parse(F.col("value"), F.lit("list")).alias("l"), structured.parse(F.col("value"), F.lit("dict")).alias("d")).collect()
    errors = {r.n: (r.l.error, r.d.error) for r in got}
    assert [errors[len(v)] for v in values] == [
        ("parameter or comma expected", None), (None, "member expected"), (None, "member expected"), (None, None), (None, None), ("member expected", "member expected"),
    ]
    assert len({k for r in got if r.n == len(values[0]) for k in r.d["keys"]}) == 6000


def test_lines_of_one_field(spark):
    h = [("permissions-policy", "camera=(), a=1"), ("server", "x"), ("permissions-policy", 'a=(self "https://a.example, b")'), ("accept-ch", "A, A"), ("priority", "u=1,")]
    df = spark.createDataFrame([([{"name": n, "value": v} for n, v in h],), ([],)], "h array<struct<name: string, value: string>>")
    got = {f.name: f for r in df.select(structured.fields(F.col("h")).alias("f")).collect() for f in r.f}
    assert set(got) == {"permissions-policy", "accept-ch", "priority"} and got["priority"].parsed.error == "member expected"
    assert got["permissions-policy"].parsed["keys"] == ["camera", "a", "a"] and got["permissions-policy"].parsed.error is None and got["accept-ch"].parsed["keys"] == []
    twice = df.select(F.explode(structured.fields(F.col("h"))).alias("f")).select("f.name", structured.repeated(F.col("f.parsed.keys")).alias("k")).filter("size(k) > 0").collect()
    assert [(r.name, r.k) for r in twice] == [("permissions-policy", ["a"])]


def test_parts_are_read_once(spark):
    """However many rules read a part of the header list, it is cut out once."""
    from headloom.functions import headers
    from headloom.plans import rules

    text = str(rules.notes(F.col("headers")))
    assert text.count(headers._OUTSIDE_QUOTES) == 1 and text.count("regexp_extract_all(") == 2  # keys and lexemes


def test_generated_headers_use_all_cores(spark):
    """A shuffle of numbers is small, so an exchange that the engine may merge made all headers in few tasks."""
    from headloom.queries import generated_notes

    made = generated_notes.generated(spark, "/root/testdata/sf0.001").select("resp_id", F.spark_partition_id().alias("p"))
    assert made.agg(F.countDistinct("p")).first()[0] == generated_notes.TASKS_A_CORE * spark.sparkContext.defaultParallelism
