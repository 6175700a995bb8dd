"""Lines that services' patterns match, made from the patterns, and what is run once."""

import random
import re
from re import _parser

from strata.operators import services


def a_match(parsed, r: random.Random) -> str:
    """A text that a parsed pattern matches."""

    def one(op, arg) -> str:
        op = str(op)
        if op == "LITERAL":
            return chr(arg)
        if op == "NOT_LITERAL":
            return r.choice([x for x in "aZ/:.é" if ord(x) != arg])
        if op == "ANY":
            return r.choice("aZ/ (é'")
        if op == "IN":
            ok = [x for x in "\"'`aZ_7/{} \t.:+=é" if re.fullmatch(r"[\s\S]", x) and inside(arg, x)]
            return r.choice(ok)
        if op == "SUBPATTERN":
            return a_match(arg[-1], r)
        if op == "BRANCH":
            return a_match(r.choice(arg[1]), r)
        if op == "MAX_REPEAT":
            low, high, body = arg
            return "".join(a_match(body, r) for _ in range(r.randint(low, min(int(high), low + 3))))
        return ""

    def inside(items, x) -> bool:
        kinds = {"CATEGORY_SPACE": r"\s", "CATEGORY_WORD": r"\w", "CATEGORY_DIGIT": r"\d"}
        hit, turned = False, False
        for op, arg in items:
            op = str(op)
            turned |= op == "NEGATE"
            hit |= op == "LITERAL" and ord(x) == arg
            hit |= op == "RANGE" and arg[0] <= ord(x) <= arg[1]
            hit |= op == "CATEGORY" and bool(re.fullmatch(kinds[str(arg)], x, re.ASCII))
        return hit != turned

    return "".join(one(op, arg) for op, arg in parsed)


def lines_of(patterns, n: int = 200):
    """``(number, line)`` of lines that the pattern of that number matches."""
    r = random.Random(3)
    for i, p in enumerate(patterns):
        parsed = _parser.parse(p[0])
        for _ in range(n):
            x = a_match(parsed, r)
            if re.search(p[0], x, re.ASCII):
                yield i, x


def test_every_match_holds_what_its_pattern_needs():
    for patterns, marks in ((services.ROUTES, services.ROUTE_MARKS), (services.CALLS, services.CALL_MARKS)):
        made = list(lines_of(patterns))
        assert {i for i, _ in made} == set(range(len(patterns)))
        assert not [(i, x) for i, x in made if not any(m in x for m in marks) or not any(n in x for n in patterns[i][-1].split())]


def test_lines_of_every_pattern_are_found(spark):
    for patterns, find, group in ((services.ROUTES, services.endpoints, 2), (services.CALLS, services.outbound_calls, None)):
        made = [(i, x) for i, x in lines_of(patterns, 100) if group is None or re.search(patterns[i][0], x, re.ASCII)[patterns[i][group]]]
        got = find(spark.createDataFrame([("s", str(k), f"x = 1\n{x}\n\ndef f(): pass") for k, (_, x) in enumerate(made)], "service string, file_path string, content string"))
        hits = {(r.file_path, r.pattern) for r in got.filter("line = 2").select("file_path", "pattern").collect()}
        if group is None:  # without a URL or a variable a call is left out
            made = [(i, x) if any(y and "/" in y for y in (re.search(patterns[i][0], x, re.ASCII)[g] for g in patterns[i][2])) else (None, x) for i, x in made]
        want = {(str(k), i) for k, (i, _) in enumerate(made) if i is not None}
        assert len({i for _, i in want}) == len(patterns) and want <= hits


def test_calls_are_looked_for_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    calls = spark.createDataFrame([("a", "http://h/users/1"), ("a", "http://h/users/2"), ("b", "http://h/none"), ("b", None)], "service string, url string").mapInArrow(counted, "service string, url string")
    got = services.resolve(calls, spark.createDataFrame([("b", "/users/{id}", 1)], "service string, path string, ord long"))
    assert sorted((r.url, r.provider) for r in got.collect()) == [("http://h/users/1", "b"), ("http://h/users/2", "b")]
    assert seen.value == 4
